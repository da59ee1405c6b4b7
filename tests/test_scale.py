"""Steps that must not grow faster than the tables: the same results by the larger tables' ways, and plans without guessed broadcasts."""

import os

import pytest
from pyspark.sql import functions as F

from ampliflow.operators import assess, classify, extras, reports, thresholds
from ampliflow.plans import catalog

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("limit, hashes", [(100_000, 1_000_000), (0, 2)])
def test_passages_are_found_by_their_bytes(spark, monkeypatch, limit, hashes):
    monkeypatch.setattr(extras, "SEED_HASHES", hashes)
    monkeypatch.setattr(extras, "_STEP", 7)  # passages lie across the ends of steps
    texts = [(1, "año de la señal, " * 40 + "fin"), (2, None), (3, ""), (4, "x"), (None, "fin"), (5, "de la sen"), (6, "fi"), (7, "n")]
    passages = [(1, "señal"), (2, "fin"), (3, ""), (4, None), (5, "x"), (6, "año de la señal, año de la señal, fin"), (7, "de la señal, año de la señ"), (8, "fin")]
    found = extras.texts_holding(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, passage string"), broadcast=limit)
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, 2), (0, 8), (1, 1), (1, 2), (1, 6), (1, 7), (1, 8), (4, 5)]


def test_long_texts_are_searched_in_one_go(spark):
    texts = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("abcdefgh ñ"), 200_000), F.lit("needle")).alias("text"))
    passages = spark.createDataFrame([(1, "needle"), (2, "needles")], "item_id int, passage string")
    assert extras.texts_holding(texts, passages).count() == 4  # a text of two million letters is not read from its start for each of its places


def test_line_sums_take_no_table_of_keys_and_items(spark):
    rows = [(1, 1.0, 7), (1, 3.0, 7), (1, 1.0, None), (2, 5.0, 8), (None, 1.0, 9)]
    found = extras.line_sums(spark.createDataFrame(rows, "k int, q double, i int"), "k", "q", "i")
    assert {(r.k, r.n, r.total, r.ones, r.n_unique) for r in found.collect()} == {(1, 3, 5.0, 2, 1), (2, 1, 5.0, 0, 1), (None, 1, 1.0, 1, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert " HashAggregate" not in plan and "ENSURE_REQUIREMENTS" not in plan


@given
@pytest.mark.parametrize("name", ["derep_min_abundance", "revcomp_nr", "missed_refs", "classify_1s3g", "unoise_tally"])
def test_sequences_are_made_in_many_tasks_and_not_written_out_in_filters(spark, name):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert not [x for x in lines if "Filter" in x and "0123456789abcdef" in x]
    assert not [i for i, x in enumerate(lines) if "Relation" in x and "p_partkey" in x and not any("RepartitionByExpression [p_partkey" in y for y in lines[max(0, i - 6) : i])]


@given
@pytest.mark.parametrize("name", ["max_spike", "threshold_pools", "threshold_apply", "total_abundance_filter"])
def test_sequences_of_parts_are_not_broadcast_by_a_guess(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan


def test_spikes_of_any_number(spark, monkeypatch):
    seqs = spark.createDataFrame([("a", "ACGT" * 12), ("b", "TTGCA" * 10), ("c", "ACG")], "md5 string, seq string")
    spikes = spark.createDataFrame([("s1", 2, "ACGT" * 12 + "A"), ("s2", 1, "ACG")], "spike string, spike_order int, spike_seq string")
    each = []
    for limit in (100_000, 0):
        monkeypatch.setattr(thresholds.counted, "__defaults__", ("inner", limit))
        each.append({(r.md5, r.spike) for r in thresholds.spike_matches(seqs, spikes).collect()})
    assert each[0] == each[1] == {("a", "s1"), ("c", "s2")}


def _cells(spark):
    many = ";".join(f"G{i:03d} s{i % 7}" for i in range(150))
    names = [("m", "q1", "A b"), ("m", "q2", "A b;C d"), ("m", "q3", ""), ("m", "q4", "Genus"), ("n", "q1", many), ("n", "q5", "G007 s0")]
    found = spark.createDataFrame(names, "marker string, md5 string, names string").withColumn("taxids", F.lit("0"))
    rows = [("m", "q1", "S1", 5), ("m", "q2", "S1", 3), ("m", "q2", "S2", 2), ("m", "q3", "S2", 1), ("m", "q4", "S3", 0), ("n", "q1", "S3", 4), ("n", "q5", "S3", 9), ("m", "q3", "S4", 2), ("n", "q1", "S5", 2)]
    return spark.createDataFrame(rows, "marker string, md5 string, sample string, abundance long"), found


def test_names_joined_to_sums_give_the_same_reports(spark):
    cells, found = _cells(spark)
    classified = classify.with_names(cells, found)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for report in (reports.abundance_by_species, reports.classification_summary, lambda c, found=None: reports.read_report(c, found=found)):
        assert rows(report(cells, found=found)) == rows(report(classified)) != []
    assert rows(assess.predicted_sets(cells, found)) == rows(assess.species_sets(classified))
    stats = cells.select("sample").distinct()
    assert rows(reports.sample_report(reports.per_combination(classified), stats)) == rows(reports.sample_report(classified, stats))


def test_sums_hold_no_names(spark):
    cells, found = _cells(spark)
    plan = reports.abundance_by_species(cells, found)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [sample" in x and "names" in x]


def test_only_samples_with_known_species_are_assessed(spark):
    cells, found = _cells(spark)
    known = spark.createDataFrame([("S1", "A b"), ("S9", "C d")], "sample string, names string")
    sets = assess.species_sets(known)
    few = assess.expected_only(cells, known)
    assert {r["sample"] for r in few.collect()} == {"S1"}
    pairs = lambda c: assess.confusion_tally(assess.paired(sets, assess.predicted_sets(c, found))).collect()
    assert pairs(few) == pairs(cells) == [(["A b"], ["A b", "C d"], 1)]
    assert "Join" not in assess.confusion_tally(assess.paired(sets, assess.predicted_sets(cells, found)))._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_many_references_are_not_broadcast(spark, monkeypatch):
    have = spark.createDataFrame([("AAACCCGGGTTTACGTACGTACGTAA", "t1"), ("AAACCCGGGTTTACGTACGTACGTAA", "t2"), ("CCCC", "t3")], "seq string, title string")
    candidates = spark.createDataFrame([("GGTTCCGGGTTTACGTACGTACGT",), ("GGTTCCC",), ("TTTT",)], "seq string")
    each = []
    for limit in (100_000, 0):
        monkeypatch.setattr(extras.counted, "__defaults__", ("inner", limit))
        found = extras.missed_references(candidates, have, "GGTT")
        each.append({(r.seq, r.titles) for r in found.collect()})
    assert each[0] == each[1] and {t for _, t in each[0]} == {"t1;t2", "t1;t2;t3"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
