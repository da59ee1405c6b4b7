"""Amplicon tables derived from the star-schema tables, by SQL that Spark and DuckDB evaluate alike.

Roles are given by attributes: parts up to size 12 are reference sequences, those of size 1 spike-ins; suppliers are
samples, their nations pools, and their balances make some of them controls.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()

_PARTS = {
    "recipe": (("part",), """
WITH b AS (SELECT p_partkey, CAST(p_partkey % 40 AS INT) g, CAST(floor(p_partkey / 40) AS INT) v, p_name, p_type, p_brand, p_size FROM part),
c AS (SELECT *, translate(concat(md5(concat('A', CAST(g AS {S}))), md5(concat('B', CAST(g AS {S}))), md5(concat('C', CAST(g AS {S})))),
  '0123456789abcdef', 'ACGTACGTACGTACGT') base0 FROM b),
d AS (SELECT *, CASE WHEN v = 0 THEN base0 ELSE concat(substr(base0, 1, (v * 7) % 96),
  translate(substr(base0, (v * 7) % 96 + 1, 1), 'ACGT', 'CGTA'), substr(base0, (v * 7) % 96 + 2)) END s1 FROM c)
SELECT p_partkey, g, v, p_name, p_type, p_brand, p_size, base0,
  CASE WHEN v % 3 = 2 THEN concat(substr(s1, 1, (v * 11) % 96), substr(s1, (v * 11) % 96 + 2)) ELSE s1 END seq FROM d"""),
    "reads": (("lineitem", "recipe"), """
SELECT 'ITS1' AS marker, concat('S', CAST(l_suppkey AS {S})) AS sample, seq, CAST(l_quantity AS BIGINT) AS abundance
FROM lineitem JOIN recipe ON l_partkey = p_partkey"""),
    "noisy": (("lineitem", "recipe"), """
SELECT 'ITS1' AS marker, concat('S', CAST(l_suppkey AS {S})) AS sample, seq, CAST(l_quantity AS BIGINT) * (CASE WHEN v = 0 THEN 200 ELSE 1 END) AS abundance
FROM lineitem JOIN recipe ON l_partkey = p_partkey"""),
    "refs": (("recipe",), """
SELECT CASE WHEN p_size = 12 THEN 'COI' ELSE 'ITS1' END AS marker, md5(seq) AS md5, seq, concat('P', CAST(p_partkey AS {S})) AS accession,
  CASE WHEN p_size = 3 THEN 0 ELSE CAST(100 * length(p_type) + CAST(substr(p_brand, 7) AS INT) AS INT) END AS taxid,
  p_type AS genus, CASE WHEN p_size IN (5, 10) THEN '' ELSE p_brand END AS species FROM recipe WHERE p_size <= 12"""),
    "families": (("recipe",), """
SELECT CASE WHEN p_size = 12 THEN 'COI' ELSE 'ITS1' END AS marker, md5(base0) AS md5, base0 AS seq, concat('P', CAST(p_partkey AS {S})) AS accession,
  CASE WHEN p_size = 3 THEN 0 ELSE CAST(100 * length(p_type) + CAST(substr(p_brand, 7) AS INT) AS INT) END AS taxid,
  p_type AS genus, CASE WHEN p_size IN (5, 10) THEN '' ELSE p_brand END AS species FROM recipe WHERE p_size <= 12"""),
    "samples": (("lineitem", "supplier", "nation"), """
SELECT concat('S', CAST(s_suppkey AS {S})) AS sample, n_name AS pool, s_acctbal < 0 AS is_negative, s_acctbal >= 0 AND s_acctbal < 600 AS is_synthetic,
  CAST(sum(l_quantity) AS BIGINT) AS primer_matched, CAST(10 AS BIGINT) AS threshold
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY s_suppkey, n_name, s_acctbal"""),
    "spikes": (("recipe",), "SELECT DISTINCT md5(seq) AS spike, seq AS spike_order, seq AS spike_seq FROM recipe WHERE p_size = 1"),
    "queries": (("recipe",), "SELECT DISTINCT md5(seq) AS md5, seq FROM recipe"),
    "known": (("lineitem", "recipe"), """
SELECT DISTINCT concat('S', CAST(l_suppkey AS {S})) AS sample, concat(p_type, ' ', p_brand) AS names
FROM lineitem JOIN recipe ON l_partkey = p_partkey WHERE v = 0"""),
    "meta": (("supplier", "nation", "region"), """
SELECT concat('S', CAST(s_suppkey AS {S})) AS sample, r_name AS region, n_name AS nation, s_name AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "nodes": (("region", "nation", "supplier"), """
SELECT 1 AS taxid, 1 AS parent, 'no rank' AS rank UNION ALL SELECT CAST(10 + r_regionkey AS INT), 1, 'family' FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS INT), CAST(10 + n_regionkey AS INT), 'genus' FROM nation
UNION ALL SELECT CAST(1000 + s_suppkey AS INT), CAST(100 + s_nationkey AS INT), 'species' FROM supplier"""),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table, or one of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = _PARTS[name]
    text = sql.replace("{S}", "STRING")
    views = {n: frame(spark, sf_dir, n) for n in needs}
    if name == "recipe":  # a small file of many parts: the sequences are made where the parts are joined by key
        views["part"] = views["part"].repartition("p_partkey")
    if "recipe" in needs and len(needs) > 1:  # its size is guessed from the parts' file, which has no sequences
        text = text.replace("SELECT", "SELECT /*+ MERGE(recipe) */", 1)
    for n in needs:  # braces are filled with the frames
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}", text)
    out = spark.sql(text, **views)
    if name == "recipe":  # always true, and not deterministic: filters on sequences stay above, and don't write out their whole expression
        out = out.withColumn("seq", F.when(F.spark_partition_id() >= 0, F.col("seq")))
    return out


def ctes(*names: str) -> str:
    """'WITH ...' of the named fixture tables and what they need, in DuckDB's types."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in _PARTS and n not in order:
            for x in _PARTS[n][0]:
                add(x)
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1].replace('{S}', 'VARCHAR').strip()})" for n in order)
