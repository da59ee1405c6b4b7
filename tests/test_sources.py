import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from ampliflow.sources import files


def test_fastq_pairs(spark, tmp_path):
    d = tmp_path / "plate"
    d.mkdir()
    for name in ("S1_R1_001.fastq.gz", "S1_R2_001.fastq.gz", "S1_I1_001.fastq.gz"):
        with gzip.open(d / name, "wt") as out:
            out.write("@r1\nacgt\n+\nIIII\n@r2\nGGGG\n+\nIIII\n")
    pairs = files.read_pairs(spark, f"file://{tmp_path}")
    assert sorted((r["sample"], r.f_seq, r.r_seq) for r in pairs.collect()) == [("S1", "ACGT", "ACGT"), ("S1", "GGGG", "GGGG")]
    (d / "S2_R1_001.fastq").write_text("@r\nA\n+\nI\n")
    with pytest.raises(Exception, match="not a pair"):
        files.paired_files(files.discover(spark, f"file://{tmp_path}", files.FASTQ_SUFFIXES)).collect()


def test_fasta_round_trip(spark, tmp_path):
    nr = spark.createDataFrame([("ACGT", 3), ("AAAA", 9), ("CC", 1)], "seq string, abundance long")
    lines = files.nr_fasta_lines(nr, {"marker": "ITS1", "abundance": 13}, minimum=2)
    path = f"file://{tmp_path}/S9.fasta"
    files.write_lines(lines, path)
    text = (next((tmp_path / "S9.fasta").glob("part-*"))).read_text()
    assert text.startswith("#marker:ITS1\n#abundance:13\n>") and text.index("AAAA") < text.index("ACGT") and "CC" not in text
    back = files.read_nr_fasta(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.abundance) for r in back] == [("AAAA", 9), ("ACGT", 3)]
    assert files.read_headers(spark, path).first().fields == {"marker": "ITS1", "abundance": "13"}


def test_fasta_titles_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a >b c\nAC\nGT\n>d\nTT\n")
    rows = files.read_fasta(spark, f"file://{tmp_path}/x.fasta").collect()
    assert {(r.title, r.seq) for r in rows} == {("a >b c", "ACGT"), ("d", "TT")}


def test_tally_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("M", "x", "ACGT", "a", 5), ("M", "x", "ACGT", "b", 2), ("M", "y", "CCCC", "b", 9)], "marker string, md5 string, seq string, sample string, abundance long")
    stats = spark.createDataFrame([("a", "Threshold", "10"), ("b", "Threshold", "20")], "sample string, field string, value string")
    path = f"file://{tmp_path}/t.tsv"
    files.write_lines(files.tally_lines(cells, ["a", "b"], stats), path)
    back, heads = files.read_tally(spark, path)
    key = lambda df: sorted((r.marker, r.md5, r.seq, r["sample"], r.abundance) for r in df.collect())
    assert key(back) == key(cells)
    assert sorted((r["sample"], r.field, r.value) for r in heads.collect()) == [("a", "Threshold", "10"), ("b", "Threshold", "20")]
    assert files.read_tally(spark, path, 5)[0].count() == 2


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('#Group\tName\tSamples\nB\t"x y"\traw/S1_R1_001.fastq.gz;S2\n\nA\tz\t\n')
    rows = files.read_metadata(spark, f"file://{tmp_path}/m.tsv", [1, 2], 3).collect()
    assert sorted((r.Group, r.Name, r["sample"] or "") for r in rows) == [("A", "z", ""), ("B", "x y", "S1"), ("B", "x y", "S2")]
    (tmp_path / "m2.tsv").write_text("#G\tS\na\tS1\nb\tS1\n")
    with pytest.raises(Exception, match="listed twice"):
        files.read_metadata(spark, f"file://{tmp_path}/m2.tsv", [1], 2).collect()


def test_dumps_and_archives(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\tx\t|\n9\t|\t1\t|\tgenus\t|\tx\t|\n")
    assert [tuple(r) for r in files.read_nodes(spark, f"file://{tmp_path}/nodes.dmp").orderBy("taxid").collect()] == [(1, 1, "no rank"), (9, 1, "genus")]
    with zipfile.ZipFile(tmp_path / "a.qza", "w") as z:
        z.writestr("x/data/taxonomy.tsv", "id\tT\nq\tk__B")
    assert [r.value for r in files.read_zip_member(spark, f"file://{tmp_path}/a.qza", "taxonomy.tsv").collect()] == ["id\tT", "q\tk__B"]
    (tmp_path / "k.known.tsv").write_text("#name\ttaxid\tgenus-species\n*\t1;2\tA b;C\n")
    assert files.read_species(spark, f"file://{tmp_path}/k.known.tsv", species_only=True).first().names == "A b"


def test_matrix(spark):
    cells = spark.createDataFrame([("M", "x", "a", 5), ("M", "y", "b", 9)], "marker string, md5 string, sample string, abundance long")
    assert sorted(tuple(r) for r in files.sparse_matrix(cells).collect()) == [(0, 0, 5), (1, 1, 9)]


def test_numbered_over_many_partitions(spark):
    rows = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [(r.v, r.at) for r in files.numbered(rows, ["v"], "at").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(found) == [(i, i) for i in range(500)]
    assert files.numbered(rows.limit(0), ["v"], "at").count() == 0


def test_lines_of_tables(spark):
    rows = spark.createDataFrame([("b", None), ("a", 2)], "k string, n int")
    assert [tuple(r) for r in files.table_lines(rows, {"Key": "k", "Count": "n"}, ["k"]).orderBy("line").collect()] == [(0, "#Key\tCount"), (1, "a\t2"), (2, "b\t")]
