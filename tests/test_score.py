import itertools
import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from recordscope.functions import metrics, text
from recordscope.functions.hashing import metric_key
from recordscope.operators import score
from recordscope.operators.assign import align, likeness
from recordscope.plans.schema_plan import compile_schema, eval_configs, resolve, without_rules
from tests.conftest import rows

EXACT, INT = {"evaluation_config": "string_exact"}, {"evaluation_config": {"metrics": [{"metric_id": "integer_exact"}]}}
AUTHORS = {"properties": {"title": EXACT, "authors": {"type": "array", "items": {"properties": {"name": EXACT, "year": INT}}}}}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = map(int, rng.integers(0, 6, 2))
        sims = np.round(rng.random((m, n)), 1)
        got = align(n, m, sims.tolist())
        few, many = sorted((n, m))
        best = max((sum(sims[g, p] for p, g in (zip(range(n), q) if n <= m else zip(q, range(m)))) for q in itertools.permutations(range(many), few)), default=0)
        assert sum(x[2] for x in got) == pytest.approx(best)
        assert sorted(p for p, _, _ in got if p >= 0) == list(range(n)) and sorted(g for _, g, _ in got if g >= 0) == list(range(m))


def scored(spark, schema, predicted, gold):
    df = spark.createDataFrame([("d", predicted and json.dumps(predicted), gold and json.dumps(gold))], "doc_id string, predicted string, gold string")
    f = score.field_scores(df, compile_schema(schema))
    return {r["field_key"]: r["score"] for r in f.collect()}, score.doc_scores(df, f).first(), dict(rows(score.doc_subtrees(f).select("top_key", "score")))


def test_array_with_lost_item(spark):
    gold = {"title": "T", "authors": [{"name": "A", "year": 1}, {"name": "B", "year": 2}, {"name": "C", "year": 3}]}
    keys, doc, tops = scored(spark, AUTHORS, {"title": "T", "authors": [{"name": "B", "year": 2}, {"name": "A", "year": 9}]}, gold)
    assert keys == pytest.approx({"title": 1, "authors[1].name": 1, "authors[1].year": 1, "authors[0].name": 1, "authors[0].year": 0, "authors._array_avg": 0.6})
    assert doc["aggregate_score"] == pytest.approx(4.6 / 6) and doc["recall"] == pytest.approx(5 / 7) and doc["f1"] == pytest.approx(0.833333, abs=1e-6)
    assert tops == pytest.approx({"title": 1.0, "authors": 0.72})


def test_nested_arrays_keep_their_own_keys(spark):
    schema = {"properties": {"authors": {"type": "array", "items": {"properties": {"name": EXACT, "affs": {"type": "array", "items": {"properties": {"org": EXACT}}}}}}}}
    one = lambda org: {"authors": [{"name": "A", "affs": [{"org": org}]}, {"name": "B", "affs": [{"org": "Y"}]}]}
    keys, doc, _ = scored(spark, schema, one("Z"), one("X"))
    assert len(keys) == 7 and doc["aggregate_score"] == pytest.approx(2 / 3) and keys["authors._array_avg"] == pytest.approx(4 / 6)


def test_primitive_arrays_and_missing_records(spark):
    schema = {"properties": {"tags": {"type": "array", "items": {"type": "string"}}, "n": EXACT}}
    keys, _, _ = scored(spark, schema, {"tags": ["a", "x"]}, {"tags": ["a", "b"], "n": "1"})
    assert keys["tags[0]"] == 1.0 and keys["tags[1]"] == 0.0 and keys["tags._array_avg"] == 0.5 and keys["n"] == 0.0
    keys, doc, _ = scored(spark, schema, None, {"n": "1"})
    assert keys == {"n": 0.0} and doc["missing_fields"] == 1


def test_schema_compiler():
    schema = {"schema_definition": {"properties": {"a": {"$ref": "#/$defs/x"}, "b": {"anyOf": [{"type": "null"}, {"properties": {"c": EXACT}}]}}}, "$defs": {"x": {"type": "string", "evaluation_config": {"metric_id": "number_tolerance", "params": {"tolerance": 0.1}}}}}
    assert eval_configs(compile_schema(schema)) == [("a", "number_tolerance", {"tolerance": "0.1"}), ("b.c", "string_exact", {})]
    assert without_rules(resolve(schema))["schema_definition"]["properties"]["a"] == {"type": "string"}


def test_root_arrays_and_schemas_without_rules(spark):
    schema = {"type": "array", "items": {"properties": {"name": EXACT, "year": INT}}}
    keys, doc, tops = scored(spark, schema, [{"name": "B", "year": 2}], [{"name": "A", "year": 1}, {"name": "B", "year": 2}])
    assert keys == {"[1].name": 1.0, "[1].year": 1.0} and tops == {"": 1.0}
    keys, doc, _ = scored(spark, {"type": "array", "items": {"type": "string"}}, ["a"], ["a", "b"])
    assert keys == {"[0]": 1.0}
    keys, doc, tops = scored(spark, {"properties": {"a": {"type": "string"}}}, {"a": "1"}, {"a": "1"})
    assert keys == {} == tops and doc["aggregate_score"] == 0.0 and doc["total_fields"] == 0


def test_items_without_rules_are_alike_by_their_members():
    """The share of all members that both have with a ratio of 0.8 or more; a nested value is one text."""
    assert likeness('{"a": "x", "b": "hello world"}', '{"b": "hello worle", "a": "y"}') == 0.5
    assert likeness('{"a": null}', '{"a": null}') == 1.0 and likeness('{"a": null}', '{"a": "x"}') == 0.0 and likeness("{}", "{}") == 1.0
    assert likeness('{"a": 1}', '{"b": 1}') == 0.0 and likeness('{"a": [1, 2]}', '{"a": [1, 2], "c": 5}') == 0.5
    assert likeness("abc", "abd") == pytest.approx(2 / 3)


def test_items_without_rules(spark):
    """Their likeness decides who is whose partner: the JSON text alone would pair them the other way."""
    schema = {"properties": {"xs": {"type": "array", "items": {"type": "object"}}}}
    gold = [{"k": "same", "t": "q" * 40}, {"k": "other", "t": "z" * 40}]
    keys, _, _ = scored(spark, schema, {"xs": [{"k": "other", "t": "q" * 20 + "z" * 33}, {"k": "same", "t": "q" * 40}]}, {"xs": gold})
    assert keys["xs[0]"] == 1.0 and keys["xs[1]"] < 1.0


SEMANTIC, WHOLE = {"evaluation_config": "string_semantic"}, {"type": "array", "evaluation_config": "array_llm"}


def test_judge_cache_and_reasons(spark):
    """The judge sees each distinct pair that the cache lacks once, and its scores enter arrays' averages."""
    schema = {"properties": {"t": SEMANTIC, "tags": WHOLE, "xs": {"type": "array", "items": {"properties": {"n": SEMANTIC, "i": INT}}}}}
    record = lambda t, tags, n: json.dumps({"t": t, "tags": tags, "xs": [{"n": n, "i": 1}]})
    data = [(1, record("a", ["x"], "p"), record("b", ["y"], "q")), (2, record("a", [], "p"), record("b", ["y"], "p")), (3, record("c", ["y"], None), record("d", ["x"], "q"))]
    seen = []

    def ask(rows):
        seen.extend((r["predicted"], r["gold"]) for r in rows.collect())
        return rows.select("key", F.lit(1.7).alias("score"), F.lit("said so").alias("reason"))

    known = spark.createDataFrame([("c", "d")], "p string, g string").select(metric_key(F.lit("string_semantic"), F.col("p"), F.col("g")).alias("key"), F.lit(0.25).alias("score"), F.lit("kept").alias("reason"))
    judge = score.Judge(ask, known)
    df = spark.createDataFrame(data, "doc_id int, predicted string, gold string")
    got = {(r["doc_id"], r["field_key"]): (r["score"], r["reason"]) for r in score.field_scores(df, compile_schema(schema), judge).collect()}
    assert got[1, "t"] == got[2, "t"] == (1.0, "said so") and got[3, "t"] == (0.25, "kept")
    assert got[1, "tags"] == (1.0, "said so") and got[2, "tags"] == (0.0, "Predicted is empty but gold has 1 items")
    assert got[1, "xs[0].n"] == (1.0, "said so") and got[2, "xs[0].n"] == (1.0, "Exact match (semantic shortcut)") and got[3, "xs[0].n"][0] == 0.0
    assert got[1, "xs._array_avg"][0] == 1.0 and got[3, "xs._array_avg"][0] == 0.5
    assert sorted(seen) == sorted(set(seen)) and ("a", "b") in seen and ("c", "d") not in seen
    assert judge.cache.count() == 1 + len(seen)


def test_reasons(spark):
    cases = {"string_exact": ("a", "b", "Mismatch: 'a' != 'b'"), "string_case_insensitive": ("A", "a", "Case-insensitive match"), "string_fuzzy": ("abcd", "abce", "Fuzzy ratio=0.750"), "integer_exact": ("x", "5", "Null/type mismatch: pred='x', gold='5'"), "number_tolerance": ("1.1", "1", "Outside tolerance: err=0.100000 > 0.001"), "number_exact": ("2", "2.0", "Exact number match: 2.0"), "boolean_exact": ("yes", "no", "Boolean mismatch: True != False"), "nonsense": ("a", "a", "Unknown metric: nonsense")}
    rows_ = [(m, p, g) for m, (p, g, _) in cases.items()] + [("string_exact", None, None), ("string_exact", None, "b")]
    out = metrics.dispatch(spark.createDataFrame(rows_, "m string, p string, g string"), "m", "p", "g", reasons=True).collect()
    got = {(r["m"], r["p"]): r["reason"] for r in out}
    assert {m: got[m, p] for m, (p, _, _) in cases.items()} == {m: why for m, (_, _, why) in cases.items()}
    assert sorted(r["reason"] for r in out if r["m"] == "string_exact" and r["p"] is None) == ["Both null", "Null mismatch: pred=None, gold='b'"]


def test_flat_scores_need_no_shuffle_and_arrays_one_pass(spark):
    """Flat records are scored in their rows; an array is assigned in one pass over its records and averaged in its row."""
    from recordscope.queries import pairs

    orders = spark.createDataFrame([(1, "O", 10.5, "1-URGENT"), (5, "F", 2.0, "2-HIGH")], "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    p = pairs.order_pairs(orders)
    flat, plan = score.flat_doc_scores(p, compile_schema(pairs.ORDER_SCHEMA)), compile_schema(pairs.ORDER_SCHEMA)
    shown = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Python" not in shown and "Arrow" not in shown
    assert rows(flat) == rows(score.doc_scores(p, score.field_scores(p, plan)))
    items = spark.createDataFrame([("d", '{"lines": []}', '{"lines": [{"part": 1}]}')], "doc_id string, predicted string, gold string")
    shown = score.field_scores(items, compile_schema(pairs.ITEM_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert shown.count("MapInArrow") == 1 and "Exchange" not in shown


def test_item_values_are_computed_once(spark):
    """However often an item's score and reason name a value, the plan computes it once for each side, and no inferred filter computes the fields again."""
    from recordscope.queries import pairs

    items = spark.createDataFrame([("d", '{"lines": []}', '{"lines": [{"part": 1}]}')], "doc_id string, predicted string, gold string")
    shown = score.field_scores(items, compile_schema(pairs.ITEM_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("$['part']") == 4 and shown.count("RLIKE") <= 16


def test_native_leaf_count(spark):
    values = [{"a": [], "b": {}, "c": [1, {"d": None}]}, [], {}, 5, "a, b", {"a,b": 'x, " y, ['}, [[1, 2], [3]], None]
    texts = [json.dumps(v) for v in values] + ["{", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.leaf_count(F.col("t"))).collect()] == [text.leaves(v) for v in values] + [0, 0]


def test_leaf_count_of_long_strings(spark):
    """Strings of a million characters, plain or all escapes, neither overflow a stack nor hide a comma."""
    values = [{"a": "x, " * 300_000, "b": [1, 2]}, {"a": '", \\' * 300_000, "b": [1, 2]}, ["\\" * 500_000, "\n," * 500_000]]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    assert [r[0] for r in df.select(text.leaf_count(F.col("t"))).collect()] == [3, 3, 2]
