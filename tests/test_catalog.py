"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from ampliflow.plans import catalog, pipeline
from ampliflow.plans.fixture import TABLES, frame

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = lambda v: "-" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(flat(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    wanted = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, wanted.fetchall())


def test_whole_analysis(spark):
    out = pipeline.run(frame(spark, SF, "reads"), frame(spark, SF, "samples"), frame(spark, SF, "refs"), frame(spark, SF, "spikes"), settings=pipeline.Settings(min_abundance=20))
    assert out["classified"].count() == out["tally"].count() > 0
    assert set(out["samples"].columns) > {"sample", "threshold", "summary", "accepted"}


def test_streaming_equals_batch(spark):
    s = {(r.marker, r["sample"]): r.abundance for r in catalog.queries()["streaming_derep"](spark, SF).collect()}
    b = frame(spark, SF, "events").groupBy("event_type", "user_id").count().collect()
    assert s == {(r.event_type, f"U{r.user_id}"): r["count"] for r in b}
