import json
import re

import pytest
from pyspark.sql import functions as F

from recordscope.operators import memo, nested, trajectory, usage
from recordscope.operators.components import components
from recordscope.operators.scan import running
from recordscope.operators.skew import hot_keys, salted_join, tiled_join
from recordscope.sources import discovery
from tests.conftest import rows

GOLD = "doc_no bigint, schema_name string, gold_data string, post string"
CATALOG = json.dumps({"properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "array", "items": {"properties": {"x": {}}}}}}}}})


def found(spark, *texts):
    docs = spark.createDataFrame([(i, "s", t, "clash") for i, t in enumerate(texts)], GOLD)
    return rows(nested.p6_found(docs, spark.createDataFrame([(" S", CATALOG)], "schema_name string, schema_json string")))


def test_nested_items(spark):
    text = json.dumps({"a": [{"b": [{"x": 1}, 2, {"x": 3}], "c": [[{"y": 1}]]}, {"b": {"x": 4}}], "z": {"q": [{"r": None}]}})
    want = [(0, "", "a[0]"), (0, "a[0]", "a[0].b[0]"), (0, "a[0]", "a[0].b[2]"), (0, "a[0]", "a[0].c[0][0]"), (0, "", "a[1]"), (0, "a[1]", "a[1].b[0]"), (0, "", "z.q[0]")]
    assert found(spark, text) == sorted(want, key=repr)
    assert found(spark, json.dumps(json.dumps({"a": {"b": []}}))) == [(0, "", "a[0]")]


@pytest.mark.parametrize("text", [None, "", "null", "3", '{"a": [{"b"', '{"a": []}', '"not json"', "[" * 100_000])
def test_nested_without_items(spark, text):
    assert found(spark, text) == []


def test_nested_empty_table_and_repeats(spark):
    assert found(spark) == []
    docs = spark.createDataFrame([(None, "s", '{"a": [{}]}', ""), (1, None, '[{"k": {"n": 2}}]', "")], GOLD)
    out = nested.flat_tables(docs, spark.createDataFrame([], "schema_name string, schema_json string")).collect()
    assert [(r["doc_no"], r["parent_path"], r["child_path"], r["list_path"], r["fields"]) for r in out] == [(1, "", "[0]", "", {"k.n": "2"})]


def rebuilt(found):
    """The record that the rows of all_tables() hold."""
    at = {}
    for r in sorted(found, key=lambda r: r["pre"]):
        new = json.loads(r["fields"][""]) if r["kind"] == "value" else [] if r["kind"] == "list" else {}
        if r["kind"] != "root":
            steps = re.findall(r"\[(\d+)\]|([^.\[\]]+)", r["child_path"])
            # every item has a row, so only member names lie between a row and the one around it
            near = next(n for n in range(len(steps) - 1, -1, -1) if path_of(steps[:n]) in at)
            names, place = [k for _, k in steps[near:-1]], at[path_of(steps[:near])]
            for name in names[:-1]:
                place = place.setdefault(name, {})
            if r["kind"] == "lone":
                place[names[-1]] = new
            else:
                (place.setdefault(names[-1], []) if names else place).append(new)
        at[r["child_path"]] = new
        if r["kind"] in ("root", "item", "lone"):
            for name, value in r["fields"].items():
                inner, (*before, last) = new, name.split(".")
                for b in before:
                    inner = inner.setdefault(b, {})
                inner[last] = json.loads(value)
    return at[""]


def path_of(steps):
    return "".join(f"[{n}]" if n else f".{k}" for n, k in steps).removeprefix(".")


def test_tables_hold_the_whole_record(spark):
    """Root members, inner objects, lists of scalars and of lists, nulls and empty values come out, and the record can be put together again."""
    text = '{"a":1,"o":{"b":2,"e":{}},"xs":[{"k":1,"tags":["p","q"],"n":null,"in":{"z":3.50,"ys":[{"w":true}]}},7,null,[],[1,{"v":[]}]],"plain":["u","v"],"none":[],"lone":{"m":{"x":"\\u00e9"}}}'
    catalog = json.dumps({"properties": {"lone": {"type": "array", "items": {"type": "object"}}}})
    docs = spark.createDataFrame([(1, "s", text, "clash"), (2, "s", json.dumps(text), "clash"), (3, "s", "{", ""), (4, "s", "5", "")], GOLD)
    out = nested.all_tables(docs, spark.createDataFrame([("s", catalog)], "schema_name string, schema_json string")).collect()
    for doc in (1, 2):
        mine = [r for r in out if r["doc_no"] == doc]
        assert rebuilt(mine) == json.loads(text)
        kinds = {r["child_path"]: (r["kind"], r["parent_path"]) for r in mine}
        assert kinds[""] == ("root", None) and kinds["lone[0]"] == ("lone", "") and kinds["xs[0].tags[1]"] == ("value", "xs[0]") and kinds["xs[4][1]"] == ("item", "") and kinds["xs[0].in.ys[0]"] == ("item", "xs[0]")
        assert next(r for r in mine if r["child_path"] == "xs[0]")["fields"] == {"k": "1", "n": "null", "in.z": "3.50"}
    assert {r["doc_no"] for r in out} == {1, 2}


def test_nested_deep_and_long(spark):
    value = {"x": 1}
    for _ in range(200):
        value = {"m": [value]}
    deep = found(spark, json.dumps(value), json.dumps({"m": [{"t": "y" * 50_000}] * 500}))
    assert sum(r[0] == 0 for r in deep) == 200 and sum(r[0] == 1 for r in deep) == 500
    assert all(c.startswith(p) for _, p, c in deep)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (None, 4)] + [(100, i) for i in range(101, 400)], "a bigint, b bigint")
    got = dict(rows(components(links)))
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} and set(v for k, v in got.items() if k >= 100) == {100}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert set(dict(rows(components(chain))).values()) == {0}
    assert rows(components(links.limit(0))) == []


def test_salted_join_keeps_all_rows(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, i int")
    right = left.groupBy("k").agg(F.count("*").alias("copies"))
    out = salted_join(left, right.where("k is not null"), "k", "i", hot_keys(right, "k"))
    assert out.count() == 501 and out.where("k = 'hot'").select("i").distinct().count() == 500


def test_running_values(spark):
    data = [(None if i % 5 == 0 else i % 3, i, float((i * 37) % 11)) for i in range(120)]
    out = running(spark.createDataFrame(data, "k int, i int, v double"), ["k"], ["i"], total=("sum", F.col("v")), before_top=("max", F.col("v")), n=("count", F.lit(1)))
    for r in out.collect():
        mine = [v for k, i, v in data if k == r["k"] and i <= r["i"]]
        assert (r["total"], r["n"], r["before_top"]) == (sum(mine), len(mine), max(mine[:-1], default=None))


def test_judge_is_called_once_per_pair(spark, tmp_path):
    log = tmp_path / "calls"
    path = str(log)

    def judge(df):
        def run(batches):
            for pdf in batches:
                with open(path, "a") as f:
                    f.writelines(f"{p}|{g}\n" for p, g in zip(pdf["predicted"], pdf["gold"]))
                yield pdf.assign(score=[2.0 if p == "a" else None for p in pdf["predicted"]], reason="x")[["key", "score", "reason"]]

        return df.mapInPandas(run, "key string, score double, reason string")

    pairs = spark.createDataFrame([("a", "b")] * 5 + [("c", None)], "predicted string, gold string")
    empty = spark.createDataFrame([], "key string, score double, reason string")
    out, cache = memo.judged(pairs, empty, judge)
    assert sorted((r["predicted"], r["score"]) for r in out.where("score is not null").collect()) == [("a", 1.0)] * 5
    assert sorted(log.read_text().split()) == ["a|b", "c|None"] and cache.count() == 1
    memo.judged(pairs.where("predicted = 'a'"), cache, judge)[0].collect()
    assert len(log.read_text().split()) == 2


def test_budget_and_prices(spark):
    calls = spark.createDataFrame([("r", i, "M1 " if i % 2 else "other", 1_000_000, 0, 10, 1.0) for i in range(1, 6)], "run_id string, call_id bigint, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, latency_seconds double").withColumn("logged_at", F.timestamp_seconds("call_id"))
    priced = usage.priced(calls, spark.createDataFrame([("m1", 2.0, 0.0)], "model string, input_per_m double, output_per_m double"))
    assert [round(r["cost"], 6) for r in priced.orderBy("call_id").collect()] == [2.0, 0.1, 2.0, 0.1, 2.0]
    assert rows(usage.exhaustion(priced, 9, 30, 4.05, 99.0)) == [("r", 3, 3, 30, "tokens")]
    assert rows(usage.exhaustion(priced, 9, 999, 999.0, 99.0)) == []


def test_trajectory(spark):
    h = spark.createDataFrame([("r", i, i, s, i % 2 == 0, {"f": s or 0.0}, f"p{i % 3}\nq") for i, s in enumerate([0.5, 0.4, None, 0.6, 0.5, 0.6, 0.1])], "run_id string, iteration int, record_id bigint, validation_score double, accepted boolean, field_scores_summary map<string,double>, prompt string")
    assert [r["improved"] for r in trajectory.greedy(h).orderBy("iteration").collect()] == [True, False, False, True, False, False, False]
    assert [r["rejected_before"] for r in trajectory.stalls(h).orderBy("iteration").collect()] == [0, 0, 1, 2, 0, 1, 2]
    assert rows(trajectory.duplicate_prompts(h)) == [("r", 3, 0), ("r", 4, 1), ("r", 5, 2), ("r", 6, 0)]
    assert [(r["previous"], r["iteration"]) for r in trajectory.regressions(h).orderBy("iteration").collect()] == [(0, 2), (4, 6)]
    assert rows(trajectory.line_changes(h)) == [("r", 2, 1, 1), ("r", 4, 1, 1), ("r", 6, 1, 1)]


def test_discovery_and_splits(spark, tmp_path):
    for n in ("a.gold.json", "a.pdf", "b.gold.json", "c.pdf"):
        (tmp_path / n).write_text('{"k":\n1}')
    out = discovery.read_records(spark, str(tmp_path)).collect()
    assert [(r["doc"], json.loads(r["gold_data"])) for r in out] == [("a", {"k": 1})]
    sizes = spark.createDataFrame([("s", n) for n in (2, 3, 6, 10, 100)], "schema_name string, n bigint")
    assert [(r["n_train"], r["n_val"], r["n_test"]) for r in discovery.split_sizes(sizes).orderBy("n").collect()] == [(2, 0, 0), (1, 1, 1), (4, 1, 1), (6, 2, 2), (70, 15, 15)]
    split = discovery.assign_splits(spark.createDataFrame([("s", i) for i in range(10)], "schema_name string, doc_no bigint"))
    assert {r["new_split"]: r["count"] for r in split.groupBy("new_split").count().collect()} == {"train": 6, "val": 2, "test": 2}


def test_tiled_join_gives_every_pair_once(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 7), ("cold", 8), (None, 3)], "k string, b int")
    out = tiled_join(left, right, "k", "a", "b")
    assert out.columns == ["k", "a", "b"] and out.count() == 60_002 == out.distinct().count()
    assert rows(out.where("k = 'cold'").select("a", "b")) == [(1, 7), (1, 8)] and rows(tiled_join(left.limit(0), right, "k", "a", "b")) == []


def test_saved_runs_and_pdfs(spark, tmp_path):
    for run, state in [("a", {"run_id": "a", "status": "completed"}), ("b", {"run_id": "b", "status": "running", "current_iteration": 3, "prompt_history": [{"iteration": 0, "prompt": "p", "field_scores_summary": {"x": 0.5}}]}), ("c", {"run_id": "c", "status": "interrupted"})]:
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run_state.json").write_text(json.dumps(state, indent=1))
    (tmp_path / "runs" / "0").mkdir()
    (tmp_path / "runs" / "0" / "run_state.json").write_text("{ broken")
    states = discovery.read_states(spark, f"{tmp_path}/runs")
    found = discovery.resumable(states).collect()
    assert [(r["run_id"], r["current_iteration"], r["prompt_history"][0]["field_scores_summary"]) for r in found] == [("b", 3, {"x": 0.5})]
    assert discovery.resumable(states.where("status = 'completed'")).count() == 0
    (tmp_path / "docs").mkdir()
    for name in ("x.gold.json", "x.pdf", "y.pdf", "z.gold.json"):
        (tmp_path / "docs" / name).write_bytes(b"%PDF " + name.encode())
    assert [(r["doc"], bytes(r["content"])) for r in discovery.read_pdfs(spark, f"{tmp_path}/docs").collect()] == [("x", b"%PDF x.pdf")]


def test_call_log_is_appended(spark, tmp_path):
    names = "call_id bigint, logged_at timestamp, call_type string, provider string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, estimated_cost_usd double, latency_seconds double, success boolean, error_text string"
    calls = spark.createDataFrame([(1, None, "judge", None, "m", 1, 2, 3, 0.00001249, 1.23456, True, None)], names)
    for _ in range(2):
        usage.append_log(calls, f"{tmp_path}/log")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(lines) == 2 and lines[0] == {"logged_at": None, "call_type": "judge", "provider": None, "model": "m", "input_tokens": 1, "output_tokens": 2, "total_tokens": 3, "estimated_cost_usd": 0.000012, "latency_seconds": 1.235, "success": True, "error": None}


def test_near_copies_and_diffs(spark):
    base = "line one of the prompt\nline two of the prompt\n"
    data = [(0, base, 0.5, True), (1, base + "!", 0.4, False), (2, "something else\n", 0.9, True), (3, base, 0.1, False), (4, None, 0.2, False), (5, "something else!\n", 0.95, True)]
    h = spark.createDataFrame([("r", i, p, s, a) for i, p, s, a in data], "run_id string, iteration int, prompt string, validation_score double, accepted boolean")
    assert rows(trajectory.near_copies(h)) == [("r", 1, 0, 0.989247), ("r", 5, 2, 0.967742)]
    diffs = {r["iteration"]: r["diff"] for r in trajectory.prompt_diffs(h).collect()}
    assert set(diffs) == {2, 5} and diffs[5].splitlines()[:2] == ["--- iteration_2", "+++ iteration_5"] and "+something else!" in diffs[5]
    assert rows(trajectory.prompt_at(h, 3)) == [("r", 3, base)] and rows(trajectory.prompt_at(h, 77)) == [("r", 0, base)]
    assert rows(trajectory.near_copies(h.limit(0))) == rows(trajectory.prompt_diffs(h.limit(0))) == []


def test_load_a_folder(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"r{i}.gold.json").write_text(json.dumps({"i": i}))
        (tmp_path / f"r{i}.pdf").write_bytes(b"%PDF")
    out = discovery.load(spark, str(tmp_path), "s").collect()
    assert sorted(json.loads(r["gold_data"])["i"] for r in out) == list(range(10))
    assert sorted(r["split"] for r in out) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2
    assert discovery.load(spark, str(tmp_path), "s", most=1).count() == 3
