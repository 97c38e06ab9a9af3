import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordscope.functions import coerce, metrics, text
from recordscope.functions.coerce import float_pattern

CASES = [
    ("string_exact", "42", "42", 1.0),
    ("string_exact", "  hello  ", "hello", 1.0),
    ("string_exact", " hello ", "hello", 1.0),
    ("string_exact", "Hello", "hello", 0.0),
    ("string_exact", None, None, 1.0),
    ("string_exact", "a", None, 0.0),
    ("string_case_insensitive", " Hello", "hello ", 1.0),
    ("integer_exact", "42.7", "42", 1.0),
    ("integer_exact", "abc", "xyz", 1.0),
    ("integer_exact", "1_000", "1000", 1.0),
    ("integer_exact", "inf", "inf", 1.0),
    ("number_tolerance", "100.05", "100.0", 1.0),
    ("number_tolerance", "110.0", "100.0", 0.0),
    ("number_tolerance", "0", "0.0", 1.0),
    ("number_exact", "nan", "nan", 0.0),
    ("number_exact", "1d", "1", 0.0),
    ("boolean_exact", "TRUE", "1", 1.0),
    ("boolean_exact", "no", "true", 0.0),
    ("boolean_exact", "maybe", "perhaps", 1.0),
    ("string_fuzzy", "hello world", "hello worl", 0.9523809523809523),
    ("string_fuzzy", "tide", "diet", 0.25),
    ("string_fuzzy", "diet", "tide", 0.5),
    ("string_fuzzy", "", "", 1.0),
    ("string_semantic", "abcd", "bcde", 0.75),
    ("array_llm", "[]", "[]", 1.0),
    ("array_llm", "[]", '["a","b"]', 0.0),
    ("array_llm", '["a","c"]', '["A ","b"]', 0.5),
    ("no_such_metric", "a", "a", 0.0),
]


def test_every_metric_by_dispatch(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, metric string, p string, g string, want double")
    for r in metrics.dispatch(df, "metric", "p", "g").collect():
        assert r["score"] == pytest.approx(r["want"]), r


def test_columns_agree_with_dispatch(spark):
    df = spark.createDataFrame([(m, p, g, w) for m, p, g, w in CASES if m in metrics.METRICS and m != "array_llm"], "metric string, p string, g string, want double")
    for name in metrics.METRICS:
        if name != "array_llm":
            for r in df.where(F.col("metric") == name).withColumn("score", metrics.score(name, F.col("p"), F.col("g"))).collect():
                assert r["score"] == pytest.approx(r["want"]), r


def test_floats_follow_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789_.eE+- infa") for _ in range(rng.randint(0, 7))) for _ in range(3000)] + ["+nan", " 42 ", "1e400", ".5", "5.", "Infinity"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", coerce.to_float(F.col("t")).alias("f")).collect()
    for r in got:
        try:
            want = float(r["t"])
        except ValueError:
            want = None
        assert (r["f"] is None) == (want is None), r
        assert want is None or r["f"] == want or math.isnan(want) and math.isnan(r["f"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789_.eE+-infa ", max_size=9))
def test_float_pattern(t):
    try:
        float(t)
        ok = True
    except ValueError:
        ok = False
    assert bool(float_pattern().match(t.strip())) == ok


def test_text_of_responses(spark):
    df = spark.createDataFrame([('a <PROMPT> x\ny </PROMPT> b', 'say {"a": [1, 2'), (" plain ", '```json\n{"a": 1}\n```'), (None, None)], "t string, j string")
    out = df.select(text.extract_prompt_tag(F.col("t")), text.parse_lenient_udf("j"), text.parse_json(F.col("j")).isNotNull()).collect()
    assert [tuple(r) for r in out] == [("x\ny", "{}", False), ("plain", '{"a": 1}', True), (None, None, False)]
    assert text.parse_lenient('{"a": [1, 2,') == '{"a": [1, 2]}'
    assert text.leaves({"a": [], "b": {}, "c": [1, {"d": None}]}) == 4
    keys = spark.createDataFrame([("doc::a[0].b",), ("a.b",), ("[0]",)], "k string").select(text.top_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["a", "a", ""]


def test_lenient_parsing_of_fences_and_lists():
    fence = "`" * 3
    for raw in (f'{fence}json {{"a": 1}} {fence}', f'{fence}json {{"a": 1}}\n{fence}', f'{fence}\n{{"a": 1}}', f'{{"a": 1}}\n{fence}', '{"a": 1,'):
        assert text.parse_lenient(raw) == '{"a": 1}', raw
    assert text.parse_lenient('[{"a":1}]') == '[{"a": 1}]' and text.parse_lenient("no json") == text.parse_lenient("") == "{}"
    for raw, want in [('{"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'), ('{"a": "x\\" {"', '{"a": "x\\" {"}'), ("[1, 2],", "[1, 2]"), ("]{", "]{}"), ('{"a": "open [', '{"a": "open [}')]:
        assert text.repaired(raw) == want
