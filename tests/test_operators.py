import math
import random

import pytest
from pyspark.sql import functions as F

from ampliflow.operators import assess, classify, denoise, distance, extras, graph, prepare, reads, refdb, reports, tally, thresholds


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants(n, seed, length=30):
    rng, out = random.Random(seed), []
    base = ["".join(rng.choices("ACGT", k=length)) for _ in range(4)]
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(s)), rng.random()
            s[i : i + 1] = [] if kind < 0.3 else [s[i], rng.choice("ACGT")] if kind < 0.5 else [rng.choice("ACGT")]
        out.append("".join(s))
    return sorted({*out, "AC", "A"})


@pytest.mark.parametrize("k", [1, 3])
def test_near_pairs_are_all_pairs(spark, k):
    seqs = variants(60, k)
    df = spark.createDataFrame([(s, s) for s in seqs], "l string, l_seq string")
    found = {(r.l, r.r, r.dist) for r in distance.near_pairs(df, df.toDF("r", "r_seq"), k).collect()}
    assert found == {(a, b, d) for a in seqs for b in seqs if (d := edits(a, b)) <= k}


def sequential_unoise(counts, alpha=2.0, gamma=4, greedy=False):
    top, centroids, out = max(counts.values()), [], {}
    for a, q in sorted(((a, s) for s, a in counts.items() if a >= gamma), key=lambda x: (-x[0], x[1])):
        cut = min(math.floor((math.log2(top / a) - 1) / alpha) if a * 2 < top else 0, 10)
        near = [(edits(q, c), counts[c], c) for c in centroids if counts[c] >= a * 2 ** (alpha + 1)]
        near = [x for x in near if x[0] <= cut and a * 2 ** (alpha * x[0] + 1) <= x[1]]
        if near:
            out[q] = (min(near, key=lambda x: (-x[1], x[2])) if greedy else min(near))[2]
        else:
            centroids.append(q)
            out[q] = q
    return out


@pytest.mark.parametrize("seed, greedy", [(1, False), (2, False), (3, True)])
def test_unoise_equals_one_sequential_pass(spark, seed, greedy):
    rng = random.Random(seed)
    counts = {s: int(2 ** rng.uniform(0, 18)) for s in variants(80, seed)}
    df = spark.createDataFrame(list(counts.items()), "seq string, abundance long")
    found = {r.seq: r.centroid for r in denoise.unoise(df, abundance_based=greedy).collect()}
    assert found == sequential_unoise(counts, greedy=greedy)


def test_unoise_boundary(spark):
    a, b = "ACGTACGTACGTACGT", "ACGTACGTACGTACGA"
    for n, merged in ((125_000, True), (125_001, False)):
        df = spark.createDataFrame([(a, 1_000_000), (b, n)], "seq string, abundance long")
        assert {r.seq: r.centroid for r in denoise.unoise(df).collect()}[b] == (a if merged else b)
    assert denoise.unoise(spark.createDataFrame([], "seq string, abundance long")).count() == 0


def refs(spark, rows):
    df = spark.createDataFrame(rows, "seq string, genus string, species string, taxid int")
    return df.select(F.lit("M").alias("marker"), F.md5("seq").alias("md5"), "seq", "genus", "species", "taxid")


def test_tiers(spark):
    base = "ACGTTGCATGCCATGACTGA"
    db = refs(spark, [
        (base, "Aus", "", 1), (base[:-1] + "C", "Aus", "bus", 12), (base[:-1] + "T", "Cus", "dus", 34),
        ("G" * 20, "Eus", "fus", 5), ("T" * 20, "Gus", "", 7), ("T" * 19 + "C", "Hus", "x", 8),
    ])
    wanted = {
        base: "Aus bus;Cus dus",  # an equal genus gives way to species at one edit
        "G" * 20: "Eus fus", "G" * 19 + "A": "Eus fus", "G" * 17 + "AAA": "Eus", "C" * 20: "",
        "T" * 20: "Gus;Hus x",
    }
    queries = spark.createDataFrame([(s,) for s in wanted], "seq string").select(F.md5("seq").alias("md5"), "seq")
    found = classify.by_distance(queries, db, 3).join(queries, "md5").collect()
    assert {r.seq: r.names for r in found} == wanted
    ident = classify.identity(queries, db).join(queries, "md5").collect()
    assert {r.seq: r.names for r in ident}[base] == "Aus" and {r.seq: r.taxids for r in ident}[base] == "1"
    sub = spark.createDataFrame([("x", base[2:19]), ("y", "GCAT")], "md5 string, seq string")
    assert {r.md5: r.names for r in classify.substring(sub, db).collect()} == {"x": "Aus bus;Cus dus", "y": "Aus bus;Cus dus"}


def test_controls_raise_their_pool(spark):
    samples = spark.createDataFrame([
        ("n1", "p", True, False, 1000, 0), ("s1", "p", False, True, 1000, 0), ("a", "p", False, False, 5000, 0), ("b", "q", False, False, 5000, 20),
    ], "sample string, pool string, is_negative boolean, is_synthetic boolean, primer_matched long, threshold long")
    maxima = spark.createDataFrame([("n1", 0, 150), ("s1", 900, 40), ("a", 0, 160), ("b", 0, 15)], "sample string, max_spike_in long, max_non_spike long")
    found = {r["sample"]: r for r in thresholds.sample_thresholds(samples, maxima, 10, 0.001).collect()}
    assert found["n1"].threshold == 10 and found["s1"].threshold == 5
    assert found["a"].threshold == 200  # 4 % of 5000 beats the negative control's 150
    assert found["b"].threshold == 20 and found["b"].max_non_spike == 0
    bad = maxima.withColumn("max_non_spike", F.lit(600).cast("long"))
    with pytest.raises(Exception, match="too high a fraction"):
        thresholds.sample_thresholds(samples, bad, 10, 0.001).collect()


def test_controls_of_one_marker_leave_the_others(spark):
    samples = spark.createDataFrame([("n", "p", True, False, 1000, 0), ("a", "p", False, False, 1000, 0)], "sample string, pool string, is_negative boolean, is_synthetic boolean, primer_matched long, threshold long")
    cells = spark.createDataFrame([("M1", "x", "AC", "n", 500), ("M1", "x", "AC", "a", 400), ("M2", "y", "GT", "a", 300)], "marker string, md5 string, seq string, sample string, abundance long")
    limits = thresholds.sample_thresholds(samples, thresholds.max_abundances(cells, cells.limit(0).select("md5")), 10, 0.001)
    kept = {(r.marker, r["sample"]) for r in tally.by_sample_threshold(cells, limits).collect()}
    assert kept == {("M1", "n"), ("M2", "a")}
    merged = {r["sample"]: r.threshold for r in reports.merged_limits(limits).collect()}
    assert merged == {"n": "10", "a": "By marker"}


def test_genera_keep_a_taxid_each(spark):
    taxonomy = spark.createDataFrame([("Aus", "", 0), ("Cus", "", 0)], "genus string, species string, taxid int")
    twins = refs(spark, [("A" * 20, "Aus", "bus", 3), ("A" * 18 + "CC", "Cus", "dus", 4)])
    middle = spark.createDataFrame([("q", "A" * 15 + "GGG" + "AC")], "md5 string, seq string")
    got = classify.by_distance(middle, twins, 5, taxonomy).collect()[0]
    assert (got.taxids, got.names) == ("0;0", "Aus;Cus")


def test_ambiguous_names_stay_bare(spark):
    rows = spark.createDataFrame([("s", "A;B c"), ("s", "D"), ("t", "")], "sample string, names string")
    assert {r["sample"]: r.summary for r in reports.classification_summary(rows).collect()} == {"s": "A(*), B c(*), D (unknown species)", "t": "Unknown"}


def test_missing_leaders(spark):
    have = spark.createDataFrame([("TTTGGGCCCAAA", "r1"), ("GGGCCCAAAT", "r2"), ("GACCC", "r0")], "seq string, title string")
    new = spark.createDataFrame([("AATTGGGCCC",), ("AATTC",), ("GGCC",), ("GACCC",), ("AATTAG",)], "seq string")
    found = {r.seq: r.titles for r in extras.missed_references(new, have, "AATT").collect()}
    assert found == {"aaTTGGGCCC": "r1", "aattGGGCCC": "r2", "aattC": "r0;r1;r2", "GGCC": "r1;r2"}
    texts = spark.createDataFrame([(1, "a short passage here"), (2, "none"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "short passage"), (8, "a short passage here"), (9, ""), (10, None), (11, "no")], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in extras.texts_holding(texts, passages).collect()} == {(1, 7), (1, 8), (2, 11)}


def test_assessment_rows(spark):
    rows = [(["A b"], ["A b"], 3), (["A b"], [], 1), ([], ["C d"], 2), ([], [], 4)]
    t = spark.createDataFrame(rows, "expected array<string>, predicted array<string>, n_samples long")
    classes = assess.species_classes(t, spark.createDataFrame([("E f",)], "species string"))
    found = {r.species: r for r in assess.assessment(assess.binary_counts(t, classes)).collect()}
    assert (found["A b"].tp, found["A b"].fp, found["A b"].fn, found["A b"].tn) == (3, 0, 1, 6)
    assert (found["C d"].fp, found["C d"].tn) == (2, 8)
    assert found["OTHER 1 SPECIES IN DB"].tn == 10
    assert found["OVERALL"].f1 == pytest.approx(6 / 9) and found["OVERALL"].ad_hoc_loss == 0.5
    cells = {(r.expected, r.label): r.n_samples for r in assess.confusion_cells(t).collect()}
    assert cells == {("A b", "A b"): 3, ("A b", "(FN)"): 1, ("", "C d"): 2, ("", "(TN)"): 4}


def test_redundant_edges_go(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("a", "d", 2), ("c", "d", 3)], "a string, b string, dist int")
    assert {(r.a, r.b) for r in graph.irredundant(e).collect()} == {("a", "b"), ("b", "c"), ("a", "d"), ("c", "d")}


def test_consolidation_and_conflicts(spark):
    rows = spark.createDataFrame([("m", "Aus", "", 1), ("m", "Aus", "b", 0), ("m", "Aus", "b", 2), ("m", "Cus", "", 3)], "md5 string, genus string, species string, taxid int")
    r = refdb.species_lists(rows, ["md5"]).first()
    assert (r.taxids, r.names) == ("2;3", "Aus b;Cus")
    found = refdb.conflicts(rows.withColumn("marker", F.lit("X"))).collect()
    assert [(x.level, x.conflicts) for x in found] == [("genus", "Aus;Cus")]


def test_taxonomy_loading(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "family"), (3, 2, "genus"), (4, 3, "species"), (5, 4, "subspecies"), (6, 3, "species"), (7, 3, "species group"), (8, 7, "species")], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(3, "Aus", "scientific name"), (4, "Aus bus", "scientific name"), (4, "Aus old", "synonym"), (5, "Aus bus minor", "scientific name"), (6, "uncultured Aus", "scientific name"), (7, "Aus grp", "scientific name"), (8, "Aus x Aus cus", "scientific name")], "taxid int, name string, class string")
    merged = spark.createDataFrame([(99, 4)], "old int, new int")
    taxonomy, synonyms = refdb.load_taxonomy(nodes, names, merged, [2])
    assert {(r.genus, r.species) for r in taxonomy.collect()} == {("Aus", ""), ("Aus", "bus"), ("Aus", "grp"), ("Aus", "x cus")}
    assert {(r.ncbi_taxid, r.name) for r in synonyms.where("ncbi_taxid = 4").collect()} == {(4, "Aus old"), (4, "Aus bus minor"), (4, "NCBI:taxid99"), (4, "NCBI:taxid5")}


def test_import_modes(spark):
    taxonomy = spark.createDataFrame([(1, 10, "Aus", ""), (2, 11, "Aus", "bus")], "id long, ncbi_taxid int, genus string, species string")
    synonyms = spark.createDataFrame([(2, "Aus old"), (2, "NCBI:taxid77")], "taxonomy_id long, name string")
    entries = spark.createDataFrame([("a", "acgt", 0, "Aus bus"), ("b", "ACGA", 0, "Aus old"), ("c", "ACGC", 77, ""), ("d", "ACGG", 0, "Aus novus"), ("e", "AC-G", 0, "Aus bus"), ("f", "ACCC", 0, "Zus z")], "accession string, seq string, taxid int, name string")
    run = lambda mode: {r.accession: (r.genus, r.species) for r in refdb.import_entries(entries, taxonomy, synonyms, mode).collect()}
    assert run("validate") == {"a": ("Aus", "bus"), "b": ("Aus", "bus"), "c": ("Aus", "bus"), "d": ("Aus", "")}
    assert run("lax") == {"a": ("Aus", "bus"), "b": ("Aus", "bus"), "c": ("Aus", "bus"), "d": ("Aus", "novus"), "f": ("Zus", "z")}
    assert set(run("genus").values()) == {("Aus", "")}


def test_merging_and_trimming(spark):
    rng = random.Random(4)
    insert = "".join(rng.choices("ACGT", k=120))
    left, right = "GAAGGTGAAGTCGTAACAAGG", "GCARRGACTTTCGTCCCYRC"
    flip = lambda s: s.translate(reads._COMPLEMENT)[::-1]
    read = left + insert + flip(right.replace("R", "A").replace("Y", "C"))
    f, r = read[:110], flip(read)[:110]
    assert reads.merge_pair(f, "I" * len(f), r, "I" * len(r)) == read
    assert reads.merge_pair("A" * 60, "I" * 60, "G" * 60, "I" * 60) is None
    wrong = read[:3] + ("A" if read[3] != "A" else "C") + read[4:]  # one mismatch in the primer
    rows = spark.createDataFrame([("s", read, 2), ("s", wrong, 1), ("s", "ACGT" * 40, 5), ("s", flip(read), 1)], "sample string, seq string, abundance long")
    got = reads.trim_primers(rows, [("ITS1", left, right, 50, 300)], flip=True).collect()
    assert [(x.marker, x.seq, x.abundance) for x in got] == [("ITS1", insert, 4)]


def test_small_reports(spark):
    c = spark.createDataFrame([("M", "x", "s", 5, "A b;A c"), ("M", "y", "s", 2, "A b"), ("M", "z", "s", 1, "A"), ("M", "w", "s", 1, ""), ("M", "x", "t", 1, "A b;A c")], "marker string, md5 string, sample string, abundance long, names string")
    text = {r["sample"]: r.summary for r in reports.classification_summary(c).collect()}
    assert text == {"s": "A b, A c(*), A (unknown species), Unknown", "t": "A b(*), A c(*)"}
    rows = reports.sample_report(c, spark.createDataFrame([("s",), ("t",), ("u",)], "sample string"))
    assert rows.columns[:2] == ["sample", "summary"] and {r["sample"]: r.accepted for r in rows.collect()} == {"s": 9, "t": 1, "u": 0}
    bands = reports.color_bands(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "i int, v string"), "v", ["i"]).orderBy("i").collect()
    assert [r.band for r in bands] == [1, 1, 2, 3] and [r.broken for r in bands] == [True, True, False, True]


def test_titles_and_checksums(spark):
    rows = spark.createDataFrame([("m1;m2", "ftp/a.gz;ftp/EM123")], "md5s string, urls string")
    assert [r.line for r in extras.checksum_lines(rows).collect()] == ["m1  a.gz", "m2  EM123.zip"]
    t = spark.createDataFrame([("AC", "b;a"), ("AC", "a")], "seq string, title string")
    assert tally.titles_by_sequence(t).first().titles == "a;b"


def test_preparation_from_read_pairs(spark):
    left, right = "ACGTACGTAA", "GGCCTTAACC"
    back = reads_reverse(right)
    rng = random.Random(5)
    often, rare = ("".join(rng.choices("ACGT", k=40)) for _ in range(2))

    def pair(sample, inner):
        whole = left + inner + back
        return (sample, whole, "I" * len(whole), reads_reverse(whole), "I" * len(whole))

    rows = [pair("S1", often)] * 6 + [pair("S1", rare)] + [("S2", "A" * 20, "I" * 20, "A" * 20, "I" * 20)]
    pairs = spark.createDataFrame(rows, "sample string, f_seq string, f_qual string, r_seq string, r_qual string")
    nr, stats = prepare.prepared(pairs, [("M", left, right, 20, 60)], min_abundance=2, min_fraction=0.5)
    assert [(r.marker, r.sample, r.seq, r.abundance) for r in nr.collect()] == [("M", "S1", often, 6)]
    found = {r["sample"]: r.asDict() for r in stats.collect()}
    assert (found["S1"]["raw"], found["S1"]["merged"], found["S1"]["primer_matched"], found["S1"]["threshold"]) == (7, 7, 7, 4)
    assert (found["S1"]["singletons"], found["S1"]["accepted"], found["S1"]["n_unique"]) == (1, 6, 1)
    assert (found["S2"]["raw"], found["S2"]["accepted"], found["S2"]["marker"]) == (1, 0, None)


def reads_reverse(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_spikes_of_genera_in_any_case(spark):
    rows = [("M", "acgt", "B", "Synthetic"), ("M", "ACGT", "A", "synthetic"), ("N", "TTTT", "C", "SYNTHETIC"), ("M", "GGGG", "D", "Aus")]
    refs = spark.createDataFrame(rows, "marker string, seq string, accession string, genus string")
    found = {(r.marker, r.spike, r.spike_seq) for r in prepare.spike_sequences(refs, ["sYnthetic ", ""]).collect()}
    assert found == {("M", "A", "ACGT"), ("N", "C", "TTTT")}
    assert prepare.spike_sequences(refs, []).count() == 0
