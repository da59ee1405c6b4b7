"""The query catalogue: every query with the SQL it is held against.

A query is registered with ``@query(sql)``; without SQL it is checked by tests on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import titles
from ..operators import assess, classify, denoise, distance, extras, graph, prepare, refdb, reports, tally, thresholds
from ..sources import files
from .fixture import ctes, frame

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


# ---- shared pieces of SQL -------------------------------------------------------------------------------------

_TALLY = """, tally AS (SELECT marker, sample, seq, md5(seq) AS md5, sum(abundance)::BIGINT AS abundance FROM reads GROUP BY marker, sample, seq)"""
_BINOMIAL = "trim(genus || ' ' || species)"


def _lists(taxa: str, key: str = "md5") -> str:
    """CTEs cons and lists over ``taxa`` (key, genus, species, taxid)."""
    return f""", cons AS (SELECT * FROM (SELECT *, max((species <> '')::INT) OVER (PARTITION BY {key}, genus) AS nm, max((taxid <> 0)::INT) OVER (PARTITION BY {key}, genus, species) AS kn
  FROM (SELECT DISTINCT {key}, genus, species, taxid FROM {taxa})) WHERE (species <> '' OR nm = 0) AND (taxid <> 0 OR kn = 0)),
lists AS (SELECT {key},
  CASE WHEN count(DISTINCT taxid) = 1 THEN min(taxid)::VARCHAR ELSE string_agg(taxid::VARCHAR, ';' ORDER BY genus, species, taxid) END AS taxids,
  CASE WHEN count(DISTINCT {_BINOMIAL}) = 1 THEN min({_BINOMIAL}) ELSE string_agg({_BINOMIAL}, ';' ORDER BY genus, species, taxid) END AS names FROM cons GROUP BY {key})"""


def _near(left: str, right: str, k: int) -> str:
    """CTE near (l, r, dist): pairs within k edits, of those that share one of the runs that k edits must leave."""
    q = 90 // (k + 1)
    grams = lambda t, n: f"{n} AS (SELECT DISTINCT md5 AS {n}_id, seq AS {n}_seq, substr(seq, i::INT, {q}) AS gram FROM {t}, unnest(range(1, length(seq) - {q - 2})) AS u(i))"
    return f""", {grams(left, "gl")}, {grams(right, "gr")},
near AS (SELECT l, r, dist FROM (SELECT l, r, levenshtein(ls, rs) AS dist FROM (SELECT DISTINCT gl_id AS l, gl_seq AS ls, gr_id AS r, gr_seq AS rs FROM gl JOIN gr USING (gram))) WHERE dist <= {k})"""


def _tally(spark, sf):
    return tally.dereplicate(frame(spark, sf, "reads"))


def _spike_md5(spark, sf, cells):
    return thresholds.spike_matches(cells.select("md5", "seq").distinct(), frame(spark, sf, "spikes"))


# ---- dereplication and tallies --------------------------------------------------------------------------------


@query(ctes("reads") + _TALLY + " SELECT marker, sample, md5, seq, abundance FROM tally")
def derep_md5(spark, sf):
    return _tally(spark, sf).select("marker", "sample", "md5", "seq", "abundance")


@query(ctes("reads") + _TALLY + " SELECT marker, sample, md5, abundance FROM tally WHERE abundance >= 30 AND length(seq) BETWEEN 95 AND 96")
def derep_min_abundance(spark, sf):
    return tally.by_length(tally.at_least(_tally(spark, sf), 30), 95, 96).select("marker", "sample", "md5", "abundance")


@query(ctes("reads") + _TALLY + " SELECT marker, sample, sum(abundance)::BIGINT AS accepted, count(*)::BIGINT AS n_unique, count(*) FILTER (abundance = 1)::BIGINT AS singletons, max(abundance) AS max_abundance FROM tally GROUP BY marker, sample")
def singletons(spark, sf):
    return tally.sample_stats(_tally(spark, sf))


@query(ctes("reads") + """, x AS (SELECT marker, seq, abundance FROM reads UNION ALL
SELECT marker, reverse(translate(seq, 'ACGT', 'TGCA')), abundance FROM reads)
SELECT marker, seq, md5(seq) AS md5, sum(abundance)::BIGINT AS abundance FROM x GROUP BY marker, seq HAVING sum(abundance) >= 100""")
def revcomp_nr(spark, sf):
    r = frame(spark, sf, "reads")
    return tally.pooled_nr(r, r, min_abundance=100)


@query(ctes("reads") + _TALLY + " SELECT marker, md5, sample, abundance, sum(abundance) OVER (PARTITION BY marker, md5)::BIGINT AS total FROM tally")
def tally_long(spark, sf):
    return tally.with_totals(_tally(spark, sf)).select("marker", "md5", "sample", "abundance", "total")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(ctes("reads", "meta") + " SELECT marker, md5(seq) AS md5, " + ", ".join(f"coalesce(sum(abundance) FILTER (region = '{r}'), 0)::BIGINT AS \"{r}\"" for r in _REGIONS) + " FROM reads JOIN meta USING (sample) GROUP BY marker, seq")
def tally_wide(spark, sf):
    pooled = _tally(spark, sf).join(frame(spark, sf, "meta"), "sample")
    return tally.wide(pooled, _REGIONS, "region")


@query(ctes("reads", "meta") + " SELECT marker, md5(seq) AS md5, region AS sample, sum(abundance)::BIGINT AS abundance FROM reads JOIN meta USING (sample) GROUP BY marker, seq, region")
def tally_unpivot(spark, sf):
    return tally.long(tally_wide(spark, sf), _REGIONS)


@query(ctes("reads") + _TALLY + " SELECT marker, md5, sum(abundance)::BIGINT AS total, max(abundance) AS max_abundance, count(DISTINCT sample)::BIGINT AS n_samples FROM tally GROUP BY marker, md5")
def sequence_stats(spark, sf):
    return tally.sequence_stats(_tally(spark, sf))


@query(ctes("families") + " SELECT seq, string_agg(DISTINCT t, ';' ORDER BY t) AS titles FROM (SELECT seq, unnest(string_split(accession || ';' || genus, ';')) AS t FROM families) GROUP BY seq")
def titles_by_sequence(spark, sf):
    rows = frame(spark, sf, "families")
    return tally.titles_by_sequence(rows.select("seq", F.concat_ws(";", "accession", "genus").alias("title")))


# ---- controls and thresholds ----------------------------------------------------------------------------------

_SPIKED = """, sk AS (SELECT DISTINCT spike, spike_seq, substr(spike_seq, i::INT, 31) AS kmer FROM spikes, unnest(range(1, length(spike_seq) - 29)) AS u(i)),
qk AS (SELECT md5, substr(seq, i::INT, 31) AS kmer FROM (SELECT DISTINCT md5, seq FROM tally), unnest(range(1, length(seq) - 29)) AS u(i)),
spiked AS (SELECT md5, arg_min(spike, spike_seq) AS spike FROM (
  SELECT md5, spike, spike_seq FROM qk JOIN sk USING (kmer) GROUP BY md5, spike, spike_seq HAVING count(*) >= greatest((length(spike_seq) - 31) / 3::DOUBLE, 10)
  UNION ALL SELECT DISTINCT md5, spike, spike_seq FROM tally JOIN spikes ON seq = spike_seq) GROUP BY md5)"""
_MAXIMA = """, maxima AS (SELECT sample, coalesce(max(abundance) FILTER (spike IS NOT NULL), 0) AS max_spike_in, coalesce(max(abundance) FILTER (spike IS NULL), 0) AS max_non_spike FROM tally LEFT JOIN spiked USING (md5) GROUP BY sample)"""
_LIMITS = """, own AS (SELECT *, greatest(threshold, CASE WHEN is_synthetic THEN ceil(30 * 0.5::DOUBLE) ELSE 30 END,
  ceil(primer_matched * 0.001::DOUBLE * CASE WHEN is_negative THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END))::BIGINT AS own, is_negative OR is_synthetic AS is_control
  FROM samples LEFT JOIN maxima USING (sample)),
pools AS (SELECT pool, max(CASE WHEN is_control AND max_non_spike >= own AND is_negative AND max_non_spike > 30 THEN max_non_spike END) AS pa,
  max(CASE WHEN is_control AND max_non_spike >= own AND is_synthetic AND 0.001::DOUBLE * primer_matched < max_non_spike THEN max_non_spike::DOUBLE / primer_matched END) AS pf FROM own GROUP BY pool),
lim AS (SELECT sample, own.pool, CASE WHEN is_negative AND is_synthetic THEN 'Neg/Synth' WHEN is_negative THEN 'Negative' WHEN is_synthetic THEN 'Synthetic' ELSE 'Sample' END AS control,
  CASE WHEN is_control THEN own ELSE greatest(threshold, coalesce(pa, 30), ceil(primer_matched * greatest(coalesce(pf, 0.001::DOUBLE), 0.001::DOUBLE)))::BIGINT END AS threshold, max_non_spike, max_spike_in
  FROM own LEFT JOIN pools ON own.pool = pools.pool),
limits AS (SELECT sample, pool, control, threshold, CASE WHEN max_non_spike < threshold THEN 0 ELSE max_non_spike END::BIGINT AS max_non_spike, CASE WHEN max_spike_in < threshold THEN 0 ELSE max_spike_in END::BIGINT AS max_spike_in FROM lim)"""
_CONTROLLED = ctes("reads", "spikes", "samples") + _TALLY + _SPIKED + _MAXIMA + _LIMITS


def _limits(spark, sf):
    cells = _tally(spark, sf)
    return thresholds.sample_thresholds(frame(spark, sf, "samples"), thresholds.max_abundances(cells, _spike_md5(spark, sf, cells)), 30, 0.001)


@query(ctes("samples") + " SELECT sample, primer_matched, greatest(100, ceil(0.01::DOUBLE * primer_matched))::BIGINT AS threshold FROM samples")
def threshold_sample(spark, sf):
    return thresholds.fractional_threshold(frame(spark, sf, "samples").select("sample", "primer_matched"), 100, 0.01)


@query(ctes("reads", "spikes") + _TALLY + _SPIKED + " SELECT md5, spike FROM spiked")
def spikein_kmer(spark, sf):
    return _spike_md5(spark, sf, _tally(spark, sf))


@query(ctes("reads", "spikes") + _TALLY + _SPIKED + _MAXIMA + " SELECT * FROM maxima")
def max_spike(spark, sf):
    cells = _tally(spark, sf)
    return thresholds.max_abundances(cells, _spike_md5(spark, sf, cells)).drop("marker")


@query(_CONTROLLED + " SELECT * FROM limits")
def threshold_pools(spark, sf):
    return _limits(spark, sf).drop("marker")


@query(_CONTROLLED + " SELECT marker, md5, sample, abundance FROM tally JOIN limits USING (sample) WHERE abundance >= 15 AND abundance >= threshold")
def threshold_apply(spark, sf):
    return tally.by_sample_threshold(tally.without_ultra_low(_tally(spark, sf), 30), _limits(spark, sf)).select("marker", "md5", "sample", "abundance")


@query(_CONTROLLED + ", kept AS (SELECT marker, md5, sample, abundance FROM tally JOIN limits USING (sample) WHERE abundance >= threshold) SELECT * FROM kept QUALIFY sum(abundance) OVER (PARTITION BY marker, md5) >= 400")
def total_abundance_filter(spark, sf):
    return tally.by_total(tally.by_sample_threshold(_tally(spark, sf), _limits(spark, sf)), 400).select("marker", "md5", "sample", "abundance")


# ---- noise correction -----------------------------------------------------------------------------------------


@query()
def unoise_corrections(spark, sf):
    return denoise.unoise_by_marker(tally.dereplicate(frame(spark, sf, "noisy"))).select("marker", F.md5("seq").alias("md5"), F.md5("centroid").alias("centroid"))


@query()
def unoise_tally(spark, sf):
    cells = tally.dereplicate(frame(spark, sf, "noisy"))
    return tally.corrected(cells, denoise.unoise_by_marker(cells)).select("marker", "md5", "sample", "abundance")


# ---- reference database ---------------------------------------------------------------------------------------


@query(ctes("families") + """ SELECT md5, 'marker' AS level, string_agg(DISTINCT marker, ';' ORDER BY marker) AS conflicts FROM families GROUP BY md5 HAVING count(DISTINCT marker) > 1
UNION ALL SELECT md5, 'genus', string_agg(DISTINCT genus, ';' ORDER BY genus) FROM families GROUP BY md5 HAVING count(DISTINCT genus) > 1
UNION ALL SELECT md5, 'species', string_agg(DISTINCT s, ';' ORDER BY s) FROM (SELECT md5, genus || ' ' || species AS s FROM families WHERE species <> '') GROUP BY md5 HAVING count(DISTINCT s) > 1""")
def conflicts(spark, sf):
    return refdb.conflicts(frame(spark, sf, "families")).drop("level_order")


@query(ctes("families") + _lists("families") + " SELECT md5, taxids, names FROM lists")
def ref_minimal(spark, sf):
    return refdb.minimal_dump(frame(spark, sf, "families"))


@query(ctes("families") + _lists("families") + " SELECT md5, genus, species, taxid FROM cons")
def taxonomy_consolidate(spark, sf):
    return refdb.consolidated(frame(spark, sf, "families"), ["md5"])


@query(ctes("refs") + " SELECT marker, accession, taxid, genus, species, md5, seq FROM refs WHERE genus IN ('PROMO', 'SMALL') AND marker = 'ITS1'")
def ref_dump(spark, sf):
    return refdb.dump(frame(spark, sf, "refs"), ["PROMO", "SMALL"], marker="ITS1")


@query(ctes("families") + f" SELECT seq, string_agg(DISTINCT e, ';' ORDER BY e) AS title FROM (SELECT seq, accession || ' ' || {_BINOMIAL} || CASE WHEN taxid <> 0 THEN ' taxid=' || taxid ELSE '' END AS e FROM families) GROUP BY seq")
def ref_fasta(spark, sf):
    return refdb.fasta_titles(frame(spark, sf, "families"))


@query(ctes("refs") + " SELECT marker, count(DISTINCT md5)::BIGINT AS n_sequences, count(DISTINCT CASE WHEN species <> '' THEN genus || '|' || species END)::BIGINT AS n_species, count(DISTINCT genus)::BIGINT AS n_genera FROM refs GROUP BY marker")
def ref_counts(spark, sf):
    return refdb.marker_counts(frame(spark, sf, "refs"))


@query("SELECT c_name AS name, coalesce(s.s_suppkey, n.n_nationkey)::BIGINT AS taxonomy_id FROM customer LEFT JOIN supplier s ON s.s_name = replace(c_name, 'Customer', 'Supplier') LEFT JOIN nation n ON n.n_nationkey = c_custkey")
def synonym_lookup(spark, sf):
    t = lambda n: frame(spark, sf, n)
    taxonomy = t("supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("genus"), F.lit("").alias("species"))
    synonyms = t("customer").join(t("nation"), F.col("c_custkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("taxonomy_id"), F.col("c_name").alias("name"))
    return refdb.by_name(t("customer").select(F.col("c_name").alias("name")), taxonomy, synonyms)


@query(ctes("nodes") + """, t AS (SELECT n.taxid, 10 AS root, 0 AS depth FROM nodes n WHERE n.taxid = 10
UNION ALL SELECT n.taxid, 10, 1 FROM nodes n WHERE n.parent = 10 UNION ALL SELECT s.taxid, 10, 2 FROM nodes n JOIN nodes s ON s.parent = n.taxid WHERE n.parent = 10) SELECT taxid, root, depth FROM t""")
def tax_subtree(spark, sf):
    return refdb.subtree(frame(spark, sf, "nodes"), spark.createDataFrame([(10,)], "taxid int"))


# ---- classification -------------------------------------------------------------------------------------------

_ITS1 = ", r1 AS (SELECT * FROM refs WHERE marker = 'ITS1')"


def _classified_sql(hits: str, before: str = "") -> str:
    return ctes("queries", "refs") + _ITS1 + before + f", hits AS ({hits}), taxa AS (SELECT DISTINCT hits.md5, genus, species, taxid FROM hits JOIN r1 ON r1.md5 = hits.ref)" + _lists("taxa") + " SELECT q.md5, coalesce(taxids, '0') AS taxids, coalesce(names, '') AS names FROM queries q LEFT JOIN lists USING (md5)"


def _tiers_sql(k: int, select: str = " SELECT q.md5, coalesce(taxids, '0') AS taxids, coalesce(names, '') AS names FROM queries q LEFT JOIN lists USING (md5)") -> str:
    return ctes("queries", "refs", "reads") + _ITS1 + ", rs AS (SELECT DISTINCT md5, seq FROM r1)" + _near("queries", "rs", k) + f""",
lev AS (SELECT md5, bool_or(species <> '') AS named FROM r1 GROUP BY md5),
n2 AS (SELECT l, r, dist, bool_or(dist = 0) OVER w AS exact, bool_or(dist = 0 AND named) OVER w AS exact_named, min(CASE WHEN dist > 0 THEN dist END) OVER w AS nxt FROM near JOIN lev ON lev.md5 = r WINDOW w AS (PARTITION BY l)),
n3 AS (SELECT *, CASE WHEN exact_named THEN 'exact' WHEN nxt = 1 THEN 'one' WHEN exact THEN 'exact' ELSE 'genus' END AS tier FROM n2),
gid AS (SELECT genus, max(taxid) AS taxid FROM refs WHERE species = '' AND taxid <> 0 GROUP BY genus),
taxa AS (SELECT n3.l AS md5, genus, species, taxid FROM n3 JOIN r1 ON r1.md5 = n3.r WHERE (tier = 'exact' AND dist = 0) OR (tier = 'one' AND dist <= 1)),
far AS (SELECT DISTINCT n3.l AS md5, r1.genus, coalesce(gid.taxid, 0) AS taxid FROM n3 JOIN r1 ON r1.md5 = n3.r LEFT JOIN gid ON gid.genus = r1.genus WHERE tier = 'genus' AND dist = nxt)""" + _lists("taxa").replace("lists AS", "sure_lists AS") + """,
lists AS (SELECT md5, taxids, names FROM sure_lists UNION ALL SELECT md5, string_agg(taxid::VARCHAR, ';' ORDER BY genus), string_agg(genus, ';' ORDER BY genus) FROM far GROUP BY md5)""" + select


def _its1(spark, sf):
    return frame(spark, sf, "refs").where("marker = 'ITS1'")


@query(_classified_sql("SELECT q.md5, q.md5 AS ref FROM queries q WHERE q.md5 IN (SELECT md5 FROM r1)"))
def classify_identity(spark, sf):
    return classify.identity(frame(spark, sf, "queries"), _its1(spark, sf))


@query(ctes("queries", "refs") + _ITS1 + ", cut AS (SELECT md5, substr(seq, 5, 80) AS seq FROM queries), hits AS (SELECT DISTINCT cut.md5, r1.md5 AS ref FROM cut JOIN r1 ON contains(r1.seq, cut.seq)), taxa AS (SELECT DISTINCT hits.md5, genus, species, taxid FROM hits JOIN r1 ON r1.md5 = hits.ref)" + _lists("taxa") + " SELECT q.md5, coalesce(taxids, '0') AS taxids, coalesce(names, '') AS names FROM queries q LEFT JOIN lists USING (md5)")
def classify_substr(spark, sf):
    cut = frame(spark, sf, "queries").select("md5", F.substring("seq", 5, 80).alias("seq"))
    return classify.substring(cut, _its1(spark, sf))


@query(_tiers_sql(1))
def classify_onebp(spark, sf):
    return classify.by_distance(frame(spark, sf, "queries"), _its1(spark, sf), 1, frame(spark, sf, "refs"))


@query(_tiers_sql(3))
def classify_1s3g(spark, sf):
    return classify.by_distance(frame(spark, sf, "queries"), _its1(spark, sf), 3, frame(spark, sf, "refs"))


@query(_classified_sql("""SELECT md5, ref FROM (SELECT l AS md5, r AS ref, rank() OVER (PARTITION BY l ORDER BY 2.0 * length(q.seq) - 5.0 * dist DESC) AS k FROM near JOIN queries q ON q.md5 = l WHERE 100.0::DOUBLE * (length(q.seq) - dist) / length(q.seq) >= 95.0) WHERE k = 1""", ", rs AS (SELECT DISTINCT md5, seq FROM r1)" + _near("queries", "rs", 4)))
def classify_topscore(spark, sf):
    return classify.METHODS["topscore"](frame(spark, sf, "queries"), _its1(spark, sf))


_BY_SPECIES = """, tl AS (SELECT sample, md5(seq) AS md5, sum(abundance)::BIGINT AS abundance FROM reads GROUP BY sample, seq),
classified AS (SELECT 'ITS1' AS marker, sample, md5, abundance, coalesce(names, '') AS names FROM tl LEFT JOIN lists USING (md5))"""


def _found(spark, sf, cells):
    return classify.found(cells, frame(spark, sf, "refs"), "onebp")


@query(_tiers_sql(1, _BY_SPECIES + " SELECT sample, names, sum(abundance)::BIGINT AS abundance FROM classified GROUP BY sample, names"))
def classify_onebp_report(spark, sf):
    cells = _tally(spark, sf)
    return reports.abundance_by_species(cells, _found(spark, sf, cells))


# ---- reports --------------------------------------------------------------------------------------------------


@query(_tiers_sql(1, _BY_SPECIES + """, p AS (SELECT sample, unnest(string_split(names, ';')) AS sp, NOT contains(names, ';') AS sure FROM classified),
o AS (SELECT sample, CASE WHEN contains(sp, ' ') THEN sp WHEN sp <> '' THEN sp || ' {unknown species}' ELSE '{Unknown}' END AS o,
  CASE WHEN NOT bool_or(sure) THEN sp || '(*)' WHEN sp = '' THEN 'Unknown' WHEN NOT contains(sp, ' ') THEN sp || ' (unknown species)' ELSE sp END AS t FROM p GROUP BY sample, sp)
SELECT sample, string_agg(t, ', ' ORDER BY o, t) AS summary FROM o GROUP BY sample"""))
def classification_summary(spark, sf):
    cells = _tally(spark, sf)
    return reports.classification_summary(cells, _found(spark, sf, cells))


@query(ctes("reads") + _TALLY + " SELECT sample, sum(abundance)::BIGINT AS accepted, count(*)::BIGINT AS n_unique FROM tally WHERE abundance >= 20 GROUP BY sample")
def accepted_unique(spark, sf):
    return reports.accepted_unique(_tally(spark, sf), 20)


_KINDS = ["species", "genus", "unknown"]


@query(_tiers_sql(1, _BY_SPECIES + """, k AS (SELECT sample, CASE WHEN contains(names, ' ') THEN 'species' WHEN names <> '' THEN 'genus' ELSE 'unknown' END AS kind, abundance FROM classified)
SELECT sample, coalesce(sum(abundance) FILTER (kind = 'species'), 0)::BIGINT AS species, coalesce(sum(abundance) FILTER (kind = 'genus'), 0)::BIGINT AS genus, coalesce(sum(abundance) FILTER (kind = 'unknown'), 0)::BIGINT AS unknown, sum(abundance)::BIGINT AS accepted, count(*)::BIGINT AS n_unique FROM k GROUP BY sample"""))
def report_samples(spark, sf):
    cells = _tally(spark, sf)
    kind = F.when(F.col("names").contains(" "), "species").when(F.col("names") != "", "genus").otherwise("unknown")
    sums = denoise.kept(spark, reports.per_combination(classify.with_names(cells, _found(spark, sf, cells).withColumn("names", kind))))
    return reports.sample_report(sums, sums.select("sample").distinct(), _KINDS).drop("summary")


def _read_report(spark, sf):
    cells = _tally(spark, sf)
    return reports.read_report(cells, found=_found(spark, sf, cells))


@query(_tiers_sql(1, _BY_SPECIES + " SELECT marker, md5, names, count(DISTINCT sample)::BIGINT AS sample_count, max(abundance) AS max_abundance, sum(abundance)::BIGINT AS total_abundance FROM classified GROUP BY marker, md5, names"))
def report_reads(spark, sf):
    return reports.read_order(_read_report(spark, sf))


@query(_tiers_sql(1, _BY_SPECIES + ", r AS (SELECT md5, count(DISTINCT sample)::BIGINT AS sample_count, max(abundance) AS max_abundance, sum(abundance)::BIGINT AS total_abundance FROM classified GROUP BY md5) SELECT max(sample_count) AS sample_count, max(max_abundance) AS max_abundance, sum(total_abundance)::BIGINT AS total_abundance FROM r"))
def report_totals(spark, sf):
    return reports.totals_row(_read_report(spark, sf))


@query(ctes("reads") + _TALLY + " SELECT marker, sample, sum(abundance)::BIGINT AS abundance, count(*)::BIGINT AS cells, grouping_id(marker, sample)::BIGINT AS level FROM tally GROUP BY ROLLUP (marker, sample)")
def report_rollup(spark, sf):
    return reports.with_rollup(_tally(spark, sf))


@query(ctes("reads", "meta") + _TALLY + """, b AS (SELECT sample, region, nation, label, sum(n) OVER (ORDER BY nation, label, sample ROWS UNBOUNDED PRECEDING)::BIGINT AS band,
  sum(n) OVER (PARTITION BY region) > 1 AS broken FROM (SELECT *, CASE WHEN region IS NOT DISTINCT FROM lag(region) OVER o AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS n FROM meta WINDOW o AS (ORDER BY nation, label, sample))) SELECT sample, region, nation, label, band, broken FROM b""")
def color_bands(spark, sf):
    return reports.color_bands(frame(spark, sf, "meta"), "region", ["nation", "label", "sample"])


@query(ctes("reads", "meta") + _TALLY + " SELECT sample, accepted, n_unique, region, nation, label FROM (SELECT sample, sum(abundance)::BIGINT AS accepted, count(*)::BIGINT AS n_unique FROM tally GROUP BY sample) FULL JOIN meta USING (sample)")
def report_metadata(spark, sf):
    return reports.with_metadata(reports.accepted_unique(_tally(spark, sf)), frame(spark, sf, "meta"), unsequenced=True)


_STATS_SQL = """SELECT concat('S', l_suppkey::VARCHAR) AS sample, l_returnflag AS marker, 1000::BIGINT AS raw, sum(l_quantity)::BIGINT AS primer_matched, count(*) FILTER (l_quantity = 1)::BIGINT AS singletons,
  max(l_quantity)::BIGINT AS max_non_spike, min(l_quantity)::BIGINT AS max_spike_in, (10 + count(*) % 2)::BIGINT AS threshold FROM lineitem GROUP BY l_suppkey, l_returnflag"""


@query(f"WITH s AS ({_STATS_SQL}) SELECT sample, min(raw) AS raw, sum(primer_matched)::BIGINT AS primer_matched, sum(singletons)::BIGINT AS singletons, max(max_non_spike) AS max_non_spike, max(max_spike_in) AS max_spike_in, CASE WHEN count(DISTINCT threshold) = 1 THEN min(threshold)::VARCHAR ELSE 'By marker' END AS threshold FROM s GROUP BY sample")
def marker_stats_merge(spark, sf):
    rows = frame(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("marker")).agg(
        F.sum("l_quantity").cast("long").alias("primer_matched"), F.count_if(F.col("l_quantity") == 1).alias("singletons"), F.max("l_quantity").cast("long").alias("max_non_spike"), F.min("l_quantity").cast("long").alias("max_spike_in"), (F.count(F.lit(1)) % 2 + 10).alias("threshold"))
    return reports.merged_stats(rows.withColumn("sample", F.concat(F.lit("S"), F.col("l_suppkey"))).withColumn("raw", F.lit(1000).cast("long")))


# ---- assessment -----------------------------------------------------------------------------------------------

_PAIRS = _BY_SPECIES + """, kn AS (SELECT sample, list_sort(list(DISTINCT names)) AS e FROM known GROUP BY sample),
pr AS (SELECT sample, list_sort(list_distinct(list(sp) FILTER (contains(sp, ' ')))) AS p FROM (SELECT sample, unnest(string_split(names, ';')) AS sp FROM classified) GROUP BY sample),
tl2 AS (SELECT e, coalesce(p, []) AS p, count(*)::BIGINT AS n FROM kn JOIN pr USING (sample) GROUP BY 1, 2)"""
_BINARY = """, cls AS (SELECT DISTINCT genus || ' ' || species AS species FROM r1 WHERE species <> '' UNION SELECT unnest(e) FROM tl2 UNION SELECT unnest(p) FROM tl2),
bin AS (SELECT species, coalesce(sum(n) FILTER (list_contains(e, species) AND list_contains(p, species)), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (NOT list_contains(e, species) AND list_contains(p, species)), 0)::BIGINT AS fp,
  coalesce(sum(n) FILTER (list_contains(e, species) AND NOT list_contains(p, species)), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (NOT list_contains(e, species) AND NOT list_contains(p, species)), 0)::BIGINT AS tn FROM cls, tl2 GROUP BY species)"""
_METRICS = """CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0::DOUBLE END AS specificity, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (fp + fn)::DOUBLE / (tp + fp + fn + tn) ELSE 0.0::DOUBLE END AS hamming_loss, CASE WHEN tp + fp + fn > 0 THEN (fp + fn)::DOUBLE / (tp + fp + fn) ELSE 0.0::DOUBLE END AS ad_hoc_loss"""


def _assess_sql(tail: str) -> str:
    known = ctes("known").split("known AS (", 1)[1]
    return _tiers_sql(1, _PAIRS + tail).replace(", r1 AS (SELECT", f", known AS ({known}, r1 AS (SELECT", 1)


def _confusion(spark, sf):
    known = denoise.kept(spark, assess.species_sets(frame(spark, sf, "known")))
    cells = tally.dereplicate(assess.expected_only(frame(spark, sf, "reads"), known))
    return assess.confusion_tally(assess.paired(known, assess.predicted_sets(cells, _found(spark, sf, cells))))


def _binary(spark, sf):
    t = _confusion(spark, sf)
    database = _its1(spark, sf).where("species <> ''").select(F.concat_ws(" ", "genus", "species").alias("species")).distinct()
    return assess.binary_counts(t, assess.species_classes(t, database))


@query(_assess_sql(" SELECT array_to_string(e, ';') AS expected, array_to_string(p, ';') AS predicted, n AS n_samples FROM tl2"))
def assess_tally(spark, sf):
    return _confusion(spark, sf).select(F.array_join("expected", ";").alias("expected"), F.array_join("predicted", ";").alias("predicted"), "n_samples")


@query(_assess_sql(", cells AS (SELECT array_to_string(e, ';') AS expected, unnest(CASE WHEN len(p) > 0 THEN p WHEN len(e) > 0 THEN ['(FN)'] ELSE ['(TN)'] END) AS label, n FROM tl2) SELECT expected, label, sum(n)::BIGINT AS n_samples FROM cells GROUP BY 1, 2"))
def assess_confusion(spark, sf):
    return assess.confusion_cells(_confusion(spark, sf))


@query(_assess_sql(_BINARY + f" SELECT species, tp, fp, fn, tn, {_METRICS} FROM bin"))
def assess_species(spark, sf):
    return assess.with_metrics(_binary(spark, sf))


@query(_assess_sql(_BINARY + f""", rw AS (SELECT 0 AS part, 'OVERALL' AS species, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM bin
UNION ALL SELECT 1, species, tp, fp, fn, tn FROM bin WHERE NOT (tp = fp AND fp = fn) UNION ALL SELECT 2, 'OTHER ' || count(*) || ' SPECIES IN DB', 0, 0, 0, sum(tn)::BIGINT FROM bin WHERE tp = fp AND fp = fn HAVING count(*) > 0) SELECT part, species, tp, fp, fn, tn, {_METRICS} FROM rw"""))
def assess_overall(spark, sf):
    return assess.assessment(_binary(spark, sf))


# ---- edit graph -----------------------------------------------------------------------------------------------

_EDGES = ctes("queries", "refs", "reads") + _near("queries", "queries", 3) + ", e AS (SELECT l AS a, r AS b, dist FROM near WHERE l < r)"


@query(_EDGES + " SELECT a, b, dist, 3 - dist + 1 AS weight, 0.3::DOUBLE * dist / 3 AS length, CASE WHEN dist = 1 THEN 'solid' WHEN dist = 2 THEN 'dashed' ELSE 'dotted' END AS style FROM e")
def edges_k3(spark, sf):
    return graph.edge_attributes(graph.edges(frame(spark, sf, "queries")))


@query(_EDGES + """, w AS (SELECT a AS x, b AS y, dist AS d FROM e UNION ALL SELECT b, a, dist FROM e), p AS (SELECT DISTINCT p.x AS a, q.y AS b, p.d + q.d AS dist FROM w p JOIN w q ON p.y = q.x AND p.x < q.y AND p.d + q.d <= 3)
SELECT a, b, dist FROM e ANTI JOIN p USING (a, b, dist)""")
def edges_irredundant(spark, sf):
    return graph.irredundant(graph.edges(frame(spark, sf, "queries")))


@query(_EDGES + f""", st AS (SELECT md5(seq) AS md5, count(DISTINCT sample) AS ns, sum(abundance) AS total FROM reads GROUP BY seq),
kept AS (SELECT * FROM st WHERE md5 IN (SELECT a FROM e UNION SELECT b FROM e) OR total >= 500)
{_lists('refs')}
SELECT k.md5, greatest(1.0::DOUBLE, 100.0::DOUBLE / (SELECT max(ns) FROM kept) * ns) AS size, CASE WHEN coalesce(names, '') = '' THEN substr(k.md5, 1, 6) ELSE replace(names, ';', chr(10)) END AS label,
  CASE WHEN coalesce(names, '') = '' THEN '#808080' WHEN contains(names, ';') THEN '#ff8c00' WHEN contains(names, ' ') THEN '#ff0000' ELSE '#8b0000' END AS colour, names IS NOT NULL AS in_db FROM kept k LEFT JOIN lists USING (md5)""")
def graph_nodes(spark, sf):
    edges = graph.edges(frame(spark, sf, "queries"))
    stats = graph.wanted(tally.sequence_stats(_tally(spark, sf)), edges, keep_total=500)
    return graph.nodes(stats, refdb.minimal_dump(frame(spark, sf, "refs")))


@query(ctes("families") + ", f AS (SELECT DISTINCT md5, seq FROM families) SELECT x.md5 AS l, y.md5 AS r, levenshtein(x.seq, y.seq)::INT AS dist FROM f x, f y")
def edit_matrix(spark, sf):
    f = frame(spark, sf, "families").select("md5", "seq").distinct()
    return distance.all_distances(f.select(F.col("md5").alias("l"), F.col("seq").alias("l_seq")), f.select(F.col("md5").alias("r"), F.col("seq").alias("r_seq")))


# ---- side reports ---------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT n_name AS nation, s_suppkey, l_returnflag AS species, l_quantity FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey)
SELECT nation, species, sum(l_quantity)::BIGINT AS abundance, count(DISTINCT s_suppkey)::BIGINT AS n_samples FROM g GROUP BY 1, 2""")
def pool_replicates(spark, sf):
    t = lambda n: frame(spark, sf, n)
    g = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return extras.pooled_replicates(g.select(F.col("n_name").alias("nation"), F.col("s_suppkey").alias("sample"), F.col("l_returnflag").alias("species"), F.col("l_quantity").alias("abundance")), ["nation"])


@query("""WITH g AS (SELECT n_name AS nation, s_suppkey, l_linestatus AS species, l_quantity FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49)
SELECT nation, CASE WHEN count(DISTINCT s_suppkey) = 0 THEN '-' WHEN coalesce(max(l_quantity) FILTER (species = 'O'), 0) > 0 THEN 'Positive' WHEN coalesce(max(l_quantity) FILTER (species <> 'O'), 0) > 0 THEN 'Positive (NS)' ELSE 'Negative' END AS pcr_status FROM g GROUP BY 1""")
def pcr_status(spark, sf):
    t = lambda n: frame(spark, sf, n)
    g = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("lineitem").where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return extras.pcr_status(g.select(F.col("n_name").alias("nation"), F.col("s_suppkey").alias("sample"), F.col("l_linestatus").alias("species"), F.col("l_quantity").alias("abundance")), ["nation"], "O")


@query("""WITH s AS (SELECT o_orderpriority AS caption, o_orderkey, count(*) AS raw, sum(l_quantity)::BIGINT AS primer, count(*) FILTER (l_quantity = 1) AS single, count(DISTINCT l_partkey) AS uniq FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT caption, sum(raw)::BIGINT AS raw, sum(raw)::BIGINT AS merged, sum(primer)::BIGINT AS primer_matched, sum(primer - single)::BIGINT AS no_singletons, sum(primer - 2 * single)::BIGINT AS accepted, sum(uniq)::BIGINT AS n_unique FROM s WHERE raw >= 2 GROUP BY caption""")
def read_reduction(spark, sf):
    orders = frame(spark, sf, "orders").groupBy("o_orderkey", F.col("o_orderpriority").alias("caption")).agg(F.count(F.lit(1)).alias("times"))
    s = orders.join(extras.line_sums(frame(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = s.select("caption", (F.col("n") * F.col("times")).alias("raw"), (F.col("total") * F.col("times")).cast("long").alias("primer_matched"), (F.col("ones") * F.col("times")).alias("singletons"), "n_unique")
    s = s.withColumn("merged", F.col("raw")).withColumn("accepted", F.col("primer_matched") - 2 * F.col("singletons"))
    return extras.read_reduction(s, "caption", 2)


@query(_tiers_sql(1, _BY_SPECIES + ", r AS (SELECT marker, md5, names, count(DISTINCT sample)::BIGINT AS sample_count, max(abundance) AS max_abundance, sum(abundance)::BIGINT AS total_abundance FROM classified GROUP BY marker, md5, names) SELECT * FROM r WHERE names IN ('', '-') AND sample_count >= 5 AND total_abundance >= 600"))
def unknowns(spark, sf):
    return extras.unknowns(_read_report(spark, sf), 5, 600)


@query(ctes("reads") + _TALLY + " SELECT sample, md5, abundance FROM tally WHERE NOT regexp_matches(sample, '^(?:S[1-3]|S5$)')")
def regex_samples(spark, sf):
    return extras.samples_matching(_tally(spark, sf), "S[1-3]|S5$", invert=True).select("sample", "md5", "abundance")


@query(ctes("queries", "refs") + """, c AS (SELECT DISTINCT 'GATTACAGAT' || substr(seq, 11, CASE WHEN substr(md5, 1, 1) < '4' THEN 12 ELSE 70 END) AS seq FROM queries),
h AS (SELECT DISTINCT c.seq, r.seq AS ref, r.accession FROM c JOIN refs r ON contains(r.seq, substr(c.seq, 11)) WHERE c.seq NOT IN (SELECT seq FROM refs)),
k AS (SELECT *, list_filter(range(0, 11), lambda i: contains(ref, substr(seq, i + 1)))[1] AS cut FROM h)
SELECT lower(substr(seq, 1, cut)) || substr(seq, cut + 1) AS seq, string_agg(DISTINCT accession, ';' ORDER BY accession) AS titles FROM k GROUP BY 1""")
def missed_refs(spark, sf):
    """Amplicons of all lengths behind a leader that no reference has; a quarter of them are shorter than the seed."""
    size = F.when(F.substring("md5", 1, 1) < "4", 12).otherwise(70)
    q = frame(spark, sf, "queries").select(F.concat(F.lit("GATTACAGAT"), F.substring("seq", F.lit(11), size)).alias("seq"))
    return extras.missed_references(q, frame(spark, sf, "refs").select("seq", F.col("accession").alias("title")), "GATTACAGAT")


@query("""WITH c AS (SELECT l_suppkey AS sample, p_type || ';' || p_brand AS names, p_type, p_brand, sum(l_quantity) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT sample, grp, sum(a) AS n FROM (SELECT DISTINCT sample, names, a, grp FROM c, (VALUES ('g1', ['ECONOMY', 'SMALL']), ('g2', ['Brand#1', 'PROMO']), ('g3', ['Brand#2'])) v(grp, ms) WHERE list_contains(ms, p_type) OR list_contains(ms, p_brand)) GROUP BY 1, 2)
SELECT sample, grp, n / sum(n) OVER (PARTITION BY sample) AS share FROM m""")
def relative_abundance(spark, sf):
    rows = frame(spark, sf, "lineitem").join(frame(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy(F.col("l_suppkey").alias("sample"), F.concat_ws(";", "p_type", "p_brand").alias("names")).agg(F.sum("l_quantity").alias("abundance"))
    groups = spark.createDataFrame([("g1", ["ECONOMY", "SMALL"]), ("g2", ["Brand#1", "PROMO"]), ("g3", ["Brand#2"])], "grp string, members array<string>")
    return extras.relative_abundance(counts, groups)


# ---- scalars and titles ---------------------------------------------------------------------------------------


@query(ctes("recipe") + """ SELECT p_partkey, md5(seq) AS md5, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, length(seq) - 30 AS n_kmers, concat(p_type, ' ', p_brand) AS binomial, p_type AS genus, p_brand AS species,
 regexp_matches(seq, '^[GATCRYWSMKHBVDN]+$') AS iupac, p_size::BIGINT AS abundance, 'n' || p_partkey AS prefix, CASE WHEN p_size > 25 THEN 'Y' ELSE 'N' END AS large, p_brand || ';size=' || p_size AS header FROM recipe""")
def seq_scalars(spark, sf):
    r = frame(spark, sf, "recipe")
    name = F.concat(F.lit("n"), F.col("p_partkey"), F.lit("_"), F.col("p_size"))
    whole = S.binomial(F.col("p_type"), F.col("p_brand"))
    return r.select("p_partkey", S.md5_key(F.lower("seq")).alias("md5"), S.reverse_complement(F.col("seq")).alias("revcomp"), F.size(S.kmers(F.col("seq"))).alias("n_kmers"), whole.alias("binomial"), S.genus_of(whole).alias("genus"), S.species_of(whole).alias("species"), S.is_iupac(F.col("seq")).alias("iupac"), S.read_abundance(name).alias("abundance"), S.read_prefix(name).alias("prefix"), S.yes_no(F.col("p_size") - 25).alias("large"), S.size_header(F.concat_ws("_", "p_brand", "p_size")).alias("header"))


def _title_query(convention: str, title, sql: str):
    def run(spark, sf):
        return frame(spark, sf, "part").select("p_partkey", titles.CONVENTIONS[convention](F.format_string(*title)).alias("t")).select("p_partkey", "t.taxid", "t.name")

    run.__name__ = f"name_parse_{convention}"
    return query(sql)(run)


_title_query("simple", ("P%d %s  %s [taxid=%d] more", "p_partkey", "p_type", "p_brand", "p_size"), "SELECT p_partkey, p_size AS taxid, p_type || ' ' || p_brand AS name FROM part")
_title_query("taxid", ("P%d:%s:taxid=%d", "p_partkey", "p_type", "p_size"), "SELECT p_partkey, p_size AS taxid, '' AS name FROM part")
_title_query("sintax", ("P%d;tax=d:X,g:%s,s:%s_%s;", "p_partkey", "p_type", "p_type", "p_brand"), "SELECT p_partkey, 0 AS taxid, p_type || ' ' || p_brand AS name FROM part")
_title_query("obitools", ("P%d species_name=%s; taxid=%d; other", "p_partkey", "p_name", "p_size"), "SELECT p_partkey, p_size AS taxid, p_name AS name FROM part")
_title_query("ncbi", ("P%d.1 %s cf. aff. x more words", "p_partkey", "p_type"), "SELECT p_partkey, 0 AS taxid, p_type || ' cf. aff. x more' AS name FROM part")


# ---- documents as sequences -----------------------------------------------------------------------------------


@query("SELECT md5(text) AS md5, count(*)::BIGINT AS abundance, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def dedupe_documents(spark, sf):
    return frame(spark, sf, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("abundance"), F.min("doc_id").alias("first_doc"))


@query("SELECT item_id, doc_id FROM (SELECT item_id, text AS passage FROM benchmark UNION ALL SELECT 1000000 + item_id, substr(text, 5, 15) FROM benchmark) b JOIN documents d ON contains(d.text, b.passage) WHERE passage <> ''")
def benchmark_substring(spark, sf):
    """Documents that hold a benchmark passage, or fifteen letters of one, as they are."""
    d, b = frame(spark, sf, "documents"), frame(spark, sf, "benchmark")
    passages = b.select("item_id", F.col("text").alias("passage")).unionByName(b.select((F.col("item_id") + 1000000).alias("item_id"), F.substring("text", 5, 15).alias("passage")))
    return extras.texts_holding(d, passages).select("item_id", "doc_id")


@query("SELECT l.quality AS quality, l.toxic AS toxic, d.lang AS lang, count(*)::BIGINT AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2, 3")
def label_counts(spark, sf):
    return frame(spark, sf, "labels").join(frame(spark, sf, "documents"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS marker, 'U' || user_id AS sample, md5(upper(event_type)) AS md5, count(*)::BIGINT AS abundance FROM events GROUP BY ALL")
def streaming_derep(spark, sf):
    """Dereplication by Structured Streaming, drained to the end of the events table."""
    import uuid

    from ..streaming.derep import run_to_end, streaming_dereplicate

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(_folder(spark, path))
    reads = stream.select(F.col("event_type").alias("marker"), F.concat(F.lit("U"), F.col("user_id")).alias("sample"), F.col("event_type").alias("seq"), F.lit(1).cast("long").alias("abundance"))
    return run_to_end(streaming_dereplicate(reads), "derep_" + uuid.uuid4().hex[:8])


def _folder(spark, path: str) -> str:
    """A glob that a file stream accepts for one file or a folder of files."""
    return path if spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1 else path.rsplit("/", 1)[0] + "/events.parque[t]"


# ---- preparation ----------------------------------------------------------------------------------------------

_ACCEPT = _TALLY + """, totals AS (SELECT marker, sample, sum(abundance)::BIGINT AS primer_matched, greatest(40, ceil(0.003::DOUBLE * sum(abundance)))::BIGINT AS threshold FROM tally GROUP BY marker, sample)"""


@query(ctes("reads") + _ACCEPT + """ SELECT marker, sample, md5, seq, abundance FROM tally JOIN totals USING (marker, sample) WHERE abundance >= threshold""")
def prepare_nr(spark, sf):
    return prepare.accepted(frame(spark, sf, "reads"), 40, 0.003)


@query(ctes("reads") + _ACCEPT + """ SELECT marker, sample, any_value(primer_matched) AS primer_matched, any_value(threshold) AS threshold, count(*) FILTER (abundance = 1) AS singletons,
  coalesce(sum(abundance) FILTER (abundance >= threshold), 0)::BIGINT AS accepted, count(*) FILTER (abundance >= threshold) AS n_unique FROM tally JOIN totals USING (marker, sample) GROUP BY marker, sample""")
def prepare_stats(spark, sf):
    return prepare.statistics(frame(spark, sf, "reads"), 40, 0.003)


@query(ctes("refs") + """ SELECT marker, min(accession) AS spike, seq AS spike_order, seq AS spike_seq FROM refs WHERE lower(genus) IN ('promo', 'small') GROUP BY marker, seq""")
def spike_genera(spark, sf):
    return prepare.spike_sequences(frame(spark, sf, "refs"), ["promo", " Small"])


@query(ctes("refs", "reads") + """ SELECT DISTINCT marker, md5, accession FROM refs WHERE seq IN (SELECT seq FROM reads)""")
def refs_in_reads(spark, sf):
    return refdb.among(frame(spark, sf, "refs"), _tally(spark, sf)).select("marker", "md5", "accession").distinct()


@query(ctes("refs", "reads") + """ SELECT DISTINCT md5(seq) AS md5, seq FROM reads WHERE seq NOT IN (SELECT seq FROM refs)""")
def reads_not_in_refs(spark, sf):
    return refdb.unknown(_tally(spark, sf), frame(spark, sf, "refs")).select("md5", "seq").distinct()


@query(ctes("refs") + """ SELECT seq, arg_min(accession, taxid::VARCHAR || accession) AS name FROM refs GROUP BY seq""")
def first_names(spark, sf):
    rows = frame(spark, sf, "refs")
    return tally.first_names(rows.select("seq", F.concat(F.col("taxid").cast("string"), "accession").alias("ordinal"), F.col("accession").alias("name")))


# ---- tables as ordered lines ----------------------------------------------------------------------------------


def _lines_sql(title: str, cells: str, order: str, source: str) -> str:
    return f""" SELECT 0::BIGINT AS line, '#{title}' AS value UNION ALL SELECT row_number() OVER (ORDER BY {order}) AS line, concat_ws(chr(9), {cells}) AS value FROM {source}"""


@query(ctes("refs") + _lines_sql("Marker\tIdentifier\tGenus\tSpecies\tTaxID\tMD5\tSequence", "marker, accession, genus, species, taxid, md5, seq", "marker, seq, accession", "refs"))
def dump_lines(spark, sf):
    return files.dump_lines(frame(spark, sf, "refs"))


@query(_assess_sql(", joined AS (SELECT array_to_string(e, ';') AS e1, array_to_string(p, ';') AS p1, n FROM tl2)" + _lines_sql("sample-count\tExpected\tPredicted", "n, e1, p1", "e1, p1", "joined")))
def mapping_lines(spark, sf):
    return files.mapping_lines(_confusion(spark, sf))


@query(ctes("families") + """, found AS (SELECT 0 AS o, md5, 'marker' AS level, string_agg(DISTINCT marker, ';' ORDER BY marker) AS conflicts FROM families GROUP BY md5 HAVING count(DISTINCT marker) > 1
  UNION ALL SELECT 1, md5, 'genus', string_agg(DISTINCT genus, ';' ORDER BY genus) FROM families GROUP BY md5 HAVING count(DISTINCT genus) > 1
  UNION ALL SELECT 2, md5, 'species', string_agg(DISTINCT trim(genus || ' ' || species), ';' ORDER BY trim(genus || ' ' || species)) FROM families WHERE species <> '' GROUP BY md5 HAVING count(DISTINCT trim(genus || ' ' || species)) > 1)"""
  + _lines_sql("MD5\tLevel\tConflicts", "md5, level, conflicts", "o, md5", "found"))
def conflict_lines(spark, sf):
    return files.conflict_lines(refdb.conflicts(frame(spark, sf, "families")))


@query(ctes("reads") + _TALLY + """ SELECT dense_rank() OVER (ORDER BY marker, md5) - 1 AS "row", dense_rank() OVER (ORDER BY sample) - 1 AS col, abundance AS value FROM tally""")
def sparse_matrix(spark, sf):
    return files.sparse_matrix(_tally(spark, sf))
