import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recordscope.queries import core


def plain(x):
    if x is None:
        return "~"
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, data, name):
    df = core.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in core.SQL:
        rel = con.execute(core.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_every_recorded_value_gets_a_score(spark, data):
    """field_scores_dispatched has every row of field_scores, and the ratio of the whole values where the row names one."""
    from recordscope.functions.metrics import text_ratio
    from recordscope.queries import core

    got = {r["score_id"]: r["rescored"] for r in core.QUERIES["field_scores_dispatched"](spark, data).collect()}
    recorded = spark.read.parquet(f"{data}/field_scores.parquet").select("score_id", "metric_type", "predicted_value", "gold_value").collect()
    assert len(got) == len(recorded)
    close = [r for r in recorded if r["metric_type"] in ("string_fuzzy", "string_semantic")]
    assert close
    for r in close:
        p, g = (None if v is None else v.strip() for v in (r["predicted_value"], r["gold_value"]))
        want = float(p is None and g is None) if p is None or g is None else text_ratio(p, g)
        assert abs(got[r["score_id"]] - want) < 1e-6, r
