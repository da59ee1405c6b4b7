import pytest
from pyspark.sql import functions as F

from ampliflow.functions import sequences as S
from ampliflow.functions import titles


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def scalar_cases():
    return [
        (S.md5_key(F.lit("acgt")), "f1f8f4bf413b16ad135722aa4591043e"),
        (S.reverse_complement(F.lit("AACGTR")), "YACGTT"),
        (S.primer_clean(F.lit("acIt")), "ACNT"),
        (S.is_iupac(F.lit("AC-GT")), False),
        (S.kmers(F.lit("ACGTA"), 3), ["ACG", "CGT", "GTA"]),
        (S.kmers(F.lit("AC"), 3), []),
        (S.expand_iupac(F.lit("ARY")), ["AAC", "AAT", "AGC", "AGT"]),
        (S.one_base_deletions(F.lit("AAC")), ["AC", "AA"]),
        (S.read_abundance(F.lit("abc_def_12")), 12),
        (S.read_abundance(F.lit("abc")), 1),
        (S.read_abundance(F.lit("abc_x")), 1),
        (S.read_prefix(F.lit("abc_def_12")), "abc_def"),
        (S.sample_name(F.lit("a/b/S1.fasta.gz")), "S1"),
        (S.sample_name(F.lit("a/b/S1.onebp.tsv")), "S1"),
        (S.genus_of(F.lit("Phytophthora x alni")), "Phytophthora"),
        (S.species_of(F.lit("Phytophthora x alni")), "x alni"),
        (S.species_of(F.lit("Phytophthora")), ""),
        (S.is_species(F.lit("Phytophthora")), False),
        (S.is_rejected_name(F.lit("uncultured fungus")), True),
        (S.is_rejected_name(F.lit("Phytophthora ramorum")), False),
        (S.is_marker_name(F.lit("ITS1-long")), True),
        (S.is_marker_name(F.lit("a b")), False),
        *((S.is_marker_name(F.lit(x)), ok) for x, ok in (("a_b", False), ("a.b", False), ("123", False), ("class", False), ("pooled", False), ("--", False), ("total", True), ("all", True), ("18S", True))),
        (S.is_rejected_name(F.lit("environmental samples")), True),
        (S.is_rejected_name(F.lit("environmental samples of soil")), False),
        (S.sample_name(F.lit("x/S1.tsv")), "S1"),
        (S.species_order(F.lit("Pythium")), "Pythium {unknown species}"),
        (S.unique_or_joined(F.array(F.lit("a"), F.lit("a"))), "a"),
        (S.unique_or_joined(F.array(F.lit("a"), F.lit("b"))), "a;b"),
        (S.dequoted(F.lit('"x y"')), "x y"),
        (S.month_text(F.lit("April-2016")), "2016-04"),
        (S.month_text(F.lit("unknown")), "unknown"),
        (S.size_header(F.lit("abc_12 x")), "abc;size=12 x"),
        (S.sintax_taxonomy(F.lit("k__Bacteria; p__Firmicutes; s__")), "d:Bacteria,p:Firmicutes"),
    ]


def test_scalars(spark):
    cases = scalar_cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [x for _, x in cases]


def test_one_base_neighbours(spark):
    subs = value(spark, S.one_base_substitutions(F.lit("AC")))
    assert len(subs) == 6 and "AC" not in subs
    inserts = value(spark, S.one_base_insertions(F.lit("A")))
    assert set(inserts) == {"AA", "CA", "GA", "TA", "AC", "AG", "AT"}


@pytest.mark.parametrize(
    "convention, title, expected",
    [
        ("simple", "HQ013219 Phytophthora arenaria", (0, "Phytophthora arenaria")),
        ("simple", "P13660 Phytophthora aff infestans ncbitaxid=907744 ignored text", (907744, "Phytophthora aff infestans")),
        ("simple", "P13660 Phytophthora  aff infestans [taxid=907744] ignored", (907744, "Phytophthora aff infestans")),
        ("taxid", "HQ013219 Phytophthora arenaria [taxid=NA] [taxid=456]", (456, "")),
        ("taxid", "HQ013219:Phytophthora_arenaria:taxid=456", (456, "")),
        ("sintax", "AB008314;tax=d:Bacteria,p:Firmicutes,g:Streptococcus;", (0, "Streptococcus")),
        ("sintax", ">X8;tax=d:Bacteria,g:Escherichia/Shigella,s:Escherichia_coli", (0, "Escherichia coli")),
        ("sintax", "X8;tax=d:Bacteria,g:Escherichia,s:coli", (0, "Escherichia coli")),
        ("obitools", "AP009202 species_name=Abalistes stellaris; taxid=392897; x", (392897, "Abalistes stellaris")),
        ("obitools", "AP009202 genus_name=Abalistes; x", (0, "Abalistes")),
        ("ncbi", "LC159493.1 Phytophthora drechsleri genes ...", (0, "Phytophthora drechsleri")),
        ("ncbi", "A57915.1 Sequence 20 from Patent EP0751227", (0, "")),
        ("ncbi", "Y08654.1 P.cambivora ribosomal internal ...", (0, "")),
        ("ncbi", "MG707849.1 Phytophthora humicola x Phytophthora inundata isolate", (0, "Phytophthora humicola x inundata")),
        ("ncbi", "MG707849.1 Phytophthora humicola x inundata isolate", (0, "Phytophthora humicola x inundata")),
        ("ncbi", "X1 Aus x cf. aff. bus strain 3", (0, "Aus x cf. aff. bus")),
        ("ncbi", "X1 Aus cf.", (0, "Aus cf.")),
        ("ncbi", "X1 Aus", (0, "Aus")),
    ],
)
def test_titles(spark, convention, title, expected):
    assert tuple(value(spark, titles.CONVENTIONS[convention](F.lit(title)))) == expected


def test_ncbi_longest_known_name(spark):
    rows = spark.createDataFrame([("A1 Phytophthora aff. infestans strain 3",), ("A2 Pythium ultimum var x",)], "title string")
    known = spark.createDataFrame([("Phytophthora aff. infestans",), ("Phytophthora",)], "name string")
    assert sorted(r["name"] for r in titles.ncbi(rows, known).collect()) == ["Phytophthora aff. infestans", "Pythium ultimum"]
