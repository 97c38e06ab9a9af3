"""Scoring predicted records against gold records by the rules of a schema.

Scalar members become one Column each and are unpivoted without a shuffle. Arrays are compared item by item inside each
record, assigned one to one, and the matched items are scored like records of their own; where items hold no
further arrays, all of that and the array's average happen in the record's row, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordscope.functions import metrics
from recordscope.functions.coerce import strip, to_float
from recordscope.functions.text import leaf_count, top_key
from recordscope.operators import memo
from recordscope.operators.assign import assigned
from recordscope.plans.schema_plan import Node, Rule
from recordscope.session import cut

COLUMNS = ["doc_id", "field_key", "field_path", "metric_type", "score", "passed", "gold_value", "predicted_value", "reason"]
TYPES = "doc_id {}, field_key string, field_path string, metric_type string, score double, passed boolean, gold_value string, predicted_value string, reason string"
#: Metrics that ask a judge where there is one.
ASKING = ("string_semantic", "array_llm")


class Judge:
    """A judge for the metrics in ``ASKING``, and the table of what it has said.

    ``ask`` takes a DataFrame (key, predicted, gold) and returns (key, score, reason); it sees each distinct pair that the
    cache lacks once. After scoring, ``cache`` holds the old and the new answers, for the caller to write.
    """

    def __init__(self, ask: Callable[[DataFrame], DataFrame], cache: DataFrame):
        self.ask, self.cache = ask, cache.select("key", "score", "reason")

    def apply(self, rows: DataFrame, asking: set[str]) -> DataFrame:
        """``rows`` with the judge's score and reason where a metric asks: neither side missing or empty, and texts not equal."""
        p, g = strip(F.col("predicted_value")), strip(F.col("gold_value"))
        for metric in sorted(asking & set(ASKING)):
            differ = p.isNotNull() & g.isNotNull() & (p != g) if metric == "string_semantic" else (F.size(metrics.items_of(p)) > 0) & (F.size(metrics.items_of(g)) > 0)
            mine = (F.col("metric_type") == metric) & differ
            pairs = rows.where(mine).select(p.alias("predicted"), g.alias("gold")).distinct()
            told, self.cache = memo.judged(pairs, self.cache, self.ask, metric)
            said = told.where("score is not null").select(F.col("predicted").alias("_jp"), F.col("gold").alias("_jg"), F.col("score").alias("_js"), F.col("reason").alias("_jr"))
            rows = rows.join(said, mine & (p == F.col("_jp")) & (g == F.col("_jg")), "left")
            rows = rows.withColumns({"score": F.coalesce("_js", "score"), "reason": F.when(F.col("_js").isNotNull(), F.col("_jr")).otherwise(F.col("reason"))}).drop("_jp", "_jg", "_js", "_jr")
        return rows


def member(record: Column, path: str) -> Column:
    """A member of a JSON text by dotted path; missing members and nulls are null."""
    return F.get_json_object(record, "$" + "".join(f"['{p}']" for p in path.split("."))) if path else record


def items(record: Column, path: str) -> Column:
    """An array member as JSON text per item; anything but a list is empty."""
    return metrics.items_of(member(record, path))


def _scalars(node: Node, prefix: str = "") -> list[tuple[str, Node]]:
    out = []
    for name, child in node.members.items():
        path = f"{prefix}.{name}" if prefix else name
        if child.members:
            out += _scalars(child, path)
        elif child.rule and not (child.is_array and child.rule.metric != "array_llm"):
            out.append((path, child))
    return out


def _arrays(node: Node, prefix: str = "") -> list[tuple[str, Node]]:
    out = []
    for name, child in node.members.items():
        path = f"{prefix}.{name}" if prefix else name
        if child.is_array and not (child.rule and child.rule.metric == "array_llm"):
            out.append((path, child))
        out += _arrays(child, path)
    return out


def _leaf(path: str, metric: str, params: dict, is_array: bool, key: Column, name: str) -> Column:
    """The two values of a member and its rule, before scoring."""
    need = F.lit(metrics.PASS_ARRAY) if is_array else metrics.pass_threshold(F.lit(metric))
    tolerance = F.lit(float(params["tolerance"])) if "tolerance" in params else F.lit(None).cast("double")
    return F.struct(F.concat(key, F.lit(path)).alias("field_key"), F.lit(name).alias("field_path"), F.lit(metric).alias("metric_type"), tolerance.alias("_tolerance"), need.alias("_need"), member(F.col("gold"), path).alias("gold_value"), member(F.col("predicted"), path).alias("predicted_value"))


#: What items without rules are compared by: as wholes.
FREE = Rule("string_fuzzy")


def _item_rules(node: Node) -> tuple[list[tuple[str, Rule]], int]:
    """The rules by which items are compared, and how many rules of nested lists count 1 each beside them."""
    rules = node.item_paths() if node.members else []
    flat = [(path, r) for path, r in rules if "[]" not in path]
    return (flat, len(rules) - len(flat)) if rules else ([("", FREE)], 0)


def _number(rule: Rule, stripped: Column) -> Column:
    """The number of a stripped text, for the rules that compare numbers."""
    return to_float(stripped, stripped=True) if rule.metric in metrics.NUMERIC else F.lit(None).cast("double")


def _ready(xs: Column, rules: list[tuple[str, Rule]]) -> Column:
    """Each item as a struct of its stripped texts and numbers by rule, computed once an item and not once a pair."""
    texts = F.transform(xs, lambda x: F.struct(*(strip(member(x, path)).alias(f"t{i}") for i, (path, _) in enumerate(rules))))
    return F.transform(texts, lambda x: F.struct(*(x[f"t{i}"].alias(f"t{i}") for i in range(len(rules))), *(_number(r, x[f"t{i}"]).alias(f"f{i}") for i, (_, r) in enumerate(rules))))


def _base(rules: list[tuple[str, Rule]], nested: int) -> Column:
    """Per gold and predicted item, the sum of the rules that need no Python; a nested list counts 1."""

    def total(p: Column, g: Column) -> Column:
        out = F.lit(float(nested))
        for i, (_, r) in enumerate(rules):
            if r.metric not in metrics.CLOSE:
                limit = F.lit(float(dict(r.params).get("tolerance", metrics.TOLERANCE)))
                out = out + metrics.prepared(r.metric, p[f"t{i}"], g[f"t{i}"], p[f"f{i}"], g[f"f{i}"], None, limit)
        return out

    return F.transform("rg", lambda g: F.transform("rp", lambda p: total(p, g)))


def alignments(pairs: DataFrame, path: str, node: Node) -> DataFrame:
    """(doc_id, key, ps, gs, pairs) of one array: predicted and gold items and their assignment.

    ``pairs`` has doc_id, key, predicted and gold. Records without items on either side are left out. A record's array
    is compared inside its row, so nothing is shuffled and a task holds the array of one record at a time.
    """
    rules, nested = _item_rules(node.items)
    both = pairs.select("doc_id", "key", items(F.col("predicted"), path).alias("ps"), items(F.col("gold"), path).alias("gs")).where("size(ps) + size(gs) > 0")
    ready = both.select("*", _ready(F.col("ps"), rules).alias("rp"), _ready(F.col("gs"), rules).alias("rg"))
    close = [i for i, (_, r) in enumerate(rules) if r.metric in metrics.CLOSE]
    text_of = lambda i: lambda x: x[f"t{i}"]
    texts = lambda c: F.array(*(F.transform(c, text_of(i)) for i in close)).cast("array<array<string>>")
    # the sizes refer to rp and rg once more, so that the optimizer doesn't move their making into the loops over pairs
    ready = ready.select("doc_id", "key", "ps", "gs", _base(rules, nested).alias("base"), texts("rp").alias("pred"), texts("rg").alias("gold"), F.size("rp").alias("n"), F.size("rg").alias("m"))
    return assigned(ready, len(rules) + nested, rules[0][1] is FREE)


def _need(metric: str, is_array: bool) -> Column:
    return F.lit(metrics.PASS_ARRAY) if is_array else metrics.pass_threshold(F.lit(metric))


def _scored(pairs: DataFrame, node: Node, general: str, judge: Judge | None) -> DataFrame | None:
    """Field rows of ``pairs`` (doc_id, key, predicted, gold), key being what comes before a member's name; None without any rule."""
    key = F.col("key")
    if node.is_array:
        return _scored_array(pairs, "", node, general, judge)
    scalars = [_leaf(path, c.rule.metric, dict(c.rule.params), c.is_array, key, f"{general}.{path}" if general else path) for path, c in _scalars(node)]
    out = None
    if scalars:
        rows = pairs.select("doc_id", "key", F.inline(F.array(*scalars)))
        kinds = {c.rule.metric for _, c in _scalars(node)}
        scored = metrics.dispatch(rows, "metric_type", "predicted_value", "gold_value", "_tolerance", kinds, reasons=True)
        scored = judge.apply(scored, kinds) if judge else scored
        out = scored.withColumn("passed", F.col("score") >= F.col("_need")).select("doc_id", "key", *COLUMNS[1:])
    for path, child in _arrays(node):
        rows = _scored_array(pairs, path, child, f"{general}.{path}" if general else path, judge)
        out = rows if out is None else out.unionByName(rows)
    return out


def _average(outer: Column, path: str, general: str, score: Column) -> list[Column]:
    null = F.lit(None).cast("string")
    return [F.concat(outer, F.lit(f"{path}._array_avg")).alias("field_key"), F.lit(f"{general}._array_avg").alias("field_path"), F.lit("array_avg").alias("metric_type"), score.alias("score"), (score >= metrics.PASS_ARRAY).alias("passed"), null.alias("gold_value"), null.alias("predicted_value"), null.alias("reason")]


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of ``values``, each computed once however often the body has it: inside a lambda Spark computes a value at each place that names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))


def _item_leaves(node: Node, path: str, general: str) -> list[Callable[[Column, Column, Column, Column], Column]]:
    """For each scored member of an item, its field row as a function of (key before the item, predicted item, gold item, ratios)."""
    rules, _ = _item_rules(node.items)
    close = [name for name, r in rules if r.metric in metrics.CLOSE]
    members = [(name, c.rule, c.is_array) for name, c in _scalars(node.items)] if node.items.members else [("", FREE, False)]

    def leaf(name: str, rule: Rule, is_array: bool) -> Callable[[Column, Column, Column, Column], Column]:
        def row(item: Column, p: Column, g: Column, ratios: Column) -> Column:
            limit = F.lit(float(dict(rule.params).get("tolerance", metrics.TOLERANCE)))

            def scored(raw: Column, v: Column, n: Column) -> Column:
                x, y, a, b = v["x"], v["y"], n["a"], n["b"]
                ratio = ratios[close.index(name)] if name in close and name else metrics.ratio_udf(x, y) if name else None
                return _let({"score": metrics.prepared(rule.metric, x, y, a, b, ratio, limit)}, lambda t: told(raw, x, y, a, b, t["score"]))

            def told(raw: Column, x: Column, y: Column, a: Column, b: Column, score: Column) -> Column:
                return F.struct(F.concat(item, F.lit(f".{name}" if name else "")).alias("field_key"), F.lit(f"{general}[].{name}" if name else f"{general}[]").alias("field_path"), F.lit(rule.metric).alias("metric_type"), score.alias("score"), (score >= _need(rule.metric, is_array)).alias("passed"), raw["g"].alias("gold_value"), raw["p"].alias("predicted_value"), metrics.reason(rule.metric, x, y, a, b, score, limit).alias("reason"))

            return _let({"p": member(p, name), "g": member(g, name)}, lambda raw: _let({"x": strip(raw["p"]), "y": strip(raw["g"])}, lambda v: _let({"a": _number(rule, v["x"]), "b": _number(rule, v["y"])}, lambda n: scored(raw, v, n))))

        return row

    return [leaf(*m) for m in members]


def _scored_array(pairs: DataFrame, path: str, node: Node, general: str, judge: Judge | None) -> DataFrame:
    """Field rows of one array and all inside it, and its average, in which every gold item without a partner counts 0. An array that is the root has no average."""
    scalars = _scalars(node.items)
    plain = bool(node.items.members) and not _arrays(node.items) and not (judge and any(c.rule.metric in ASKING for _, c in scalars))
    if plain and scalars:
        leaves = _item_leaves(node, path, general)
        aligned = alignments(pairs, path, node)
        item = lambda m: F.concat(F.col("key"), F.lit(f"{path}["), m["gold_idx"].cast("string"), F.lit("]"))
        at = lambda xs, i: F.get(F.col(xs), i)
        matched = F.filter("pairs", lambda m: (m["pred_idx"] >= 0) & (m["gold_idx"] >= 0))
        fields = F.flatten(F.transform(matched, lambda m: F.array(*(f(item(m), at("ps", m["pred_idx"]), at("gs", m["gold_idx"]), m["close"]) for f in leaves))))
        lost = F.size(F.filter("pairs", lambda m: m["pred_idx"] < 0))
        told = aligned.select("doc_id", "key", fields.alias("fields"), lost.alias("lost"))
        if general:
            n = F.size("fields") + F.col("lost")
            mean = F.when(n > 0, F.aggregate("fields", F.lit(0.0), lambda x, f: x + f["score"]) / n)
            average = F.struct(*_average(F.col("key"), path, general, mean))
            told = told.select("doc_id", "key", F.when(n > 0, F.concat("fields", F.array(average))).otherwise(F.col("fields")).alias("fields"))
        # of a plain inline() Spark infers a filter on the size of its input, which computes all fields many times
        return told.select("doc_id", "key", F.inline_outer("fields")).where("metric_type is not null").select("doc_id", "key", *COLUMNS[1:])
    # items with arrays of their own, without members or for a judge: the assignment is written once and read by each part
    one = cut(alignments(pairs, path, node).select("doc_id", "key", "ps", "gs", F.explode("pairs").alias("m")))
    matched = one.where("m.pred_idx >= 0 and m.gold_idx >= 0").select("doc_id", F.col("key").alias("outer"), F.concat("key", F.lit(path), F.lit("["), F.col("m.gold_idx").cast("string"), F.lit("]")).alias("item"), F.expr("ps[m.pred_idx]").alias("predicted"), F.expr("gs[m.gold_idx]").alias("gold"))
    rows = _scored(matched.select("doc_id", F.concat("item", F.lit(".")).alias("key"), "predicted", "gold"), node.items, f"{general}[]", judge) if node.items.members else None
    if rows is None:
        texts = matched.select("doc_id", F.col("item").alias("key"), F.col("item").alias("field_key"), F.lit(f"{general}[]").alias("field_path"), F.lit("string_fuzzy").alias("metric_type"), F.col("gold").alias("gold_value"), F.col("predicted").alias("predicted_value"))
        rows = metrics.dispatch(texts, "metric_type", "predicted_value", "gold_value", only={"string_fuzzy"}, reasons=True).withColumn("passed", F.col("score") >= metrics.PASS_CLOSE).select("doc_id", "key", *COLUMNS[1:])
    if not general:
        return rows
    lost = one.where("m.pred_idx < 0").select("doc_id", F.col("key").alias("outer"), F.lit(0.0).alias("score"))
    inside = rows.select("doc_id", F.regexp_extract("key", _outer(general), 1).alias("outer"), "score")
    average = lost.unionByName(inside).groupBy("doc_id", "outer").agg(F.avg("score").alias("score"))
    return rows.unionByName(average.select("doc_id", F.col("outer").alias("key"), *_average(F.col("outer"), path, general, F.col("score"))))


def _outer(general: str) -> str:
    """Pattern whose first group is what comes before the array ``general`` in the key of anything inside it."""
    *before, last = general.split("[]")
    step = lambda x: x.replace(".", r"\.")
    head = "".join(step(x) + r"\[\d+\]" for x in before)
    dot = r"\." if before else ""
    return f"^({head}{dot})" + step(last.removeprefix(".")) + r"\[\d+\].*$"


def field_scores(pairs: DataFrame, plan: Node, judge: Judge | None = None) -> DataFrame:
    """The long table of field scores (``COLUMNS``) of ``pairs`` (doc_id, predicted, gold as JSON text).

    Broken or null JSON scores as a record without members. A root array has keys such as ``[0].name`` and no average; a
    schema without rules gives no rows. Rows that repeat a doc_id are one record each only if doc_id is made unique
    before. With a ``judge`` the metrics in ``ASKING`` have its scores and reasons; items are still assigned by ratio. Extra columns play no part.
    """
    keyed = pairs.select("doc_id", F.lit("").alias("key"), F.col("predicted").cast("string").alias("predicted"), F.col("gold").cast("string").alias("gold"))
    rows = _scored(keyed, plan, "", judge)
    if rows is None:
        return pairs.sparkSession.createDataFrame([], TYPES.format(pairs.schema["doc_id"].dataType.simpleString()))
    return rows.select(*COLUMNS)


def _summary(per: DataFrame) -> DataFrame:
    """The result columns from doc_id, s (mean score), p and g (leaves), matched, total and missing."""
    precision, recall = F.col("matched") / F.greatest("p", F.lit(1)), F.col("matched") / F.greatest("g", F.lit(1))
    return per.select(
        "doc_id", F.coalesce("s", F.lit(0.0)).alias("aggregate_score"), precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.col("total").alias("total_fields"), F.col("matched").alias("matched_fields"), F.col("missing").alias("missing_fields"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("extra_fields"),
    )


def doc_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per record: mean score, passed share of predicted and of gold leaves, their harmonic mean and counts.

    A record without scored fields has zeros. Averages of arrays are fields like the others here, so precision and recall may exceed 1.
    """
    leaves = pairs.select("doc_id", leaf_count(F.col("predicted").cast("string")).alias("p"), leaf_count(F.col("gold").cast("string")).alias("g"))
    per = scores.groupBy("doc_id").agg(F.avg("score").alias("s"), F.count_if("passed").alias("matched"), F.count("*").alias("total"), F.count_if(F.col("predicted_value").isNull() & F.col("gold_value").isNotNull()).alias("missing"))
    return _summary(leaves.join(per, "doc_id", "left").na.fill(0, ["matched", "total", "missing"]))


def flat_doc_scores(pairs: DataFrame, plan: Node) -> DataFrame:
    """doc_scores() for a plan whose rules are all of scalar root members that need no ratio: each record is scored in its row, without a shuffle or Python.

    Both records are parsed once. Rows that repeat a doc_id are one record each.
    """
    rules = [(name, c.rule) for name, c in plan.members.items() if c.rule]
    if plan.is_array or any(c.members or c.is_array for c in plan.members.values()) or any(r.metric in metrics.CLOSE + ASKING for _, r in rules):
        raise ValueError("flat_doc_scores takes plans of scalar root members only, without ratios")
    shape = ", ".join(f"`{name}` string" for name, _ in rules)
    texts = pairs.select("doc_id", *(F.from_json(F.col(c).cast("string"), shape).alias(f"_{c[0]}") for c in ("predicted", "gold")), *(leaf_count(F.col(c).cast("string")).alias(c[0]) for c in ("predicted", "gold")))
    # a column for each coerced value, so that nothing is computed twice
    ready = texts.select("doc_id", "p", "g", *(strip(F.col(f"_{side}")[name]).alias(f"{side}{i}") for side in "pg" for i, (name, _) in enumerate(rules)))
    ready = ready.select("*", *(to_float(F.col(f"{side}{i}")).alias(f"f{side}{i}") for side in "pg" for i in range(len(rules))))
    told = [metrics.prepared(r.metric, F.col(f"p{i}"), F.col(f"g{i}"), F.col(f"fp{i}"), F.col(f"fg{i}"), None, F.lit(float(dict(r.params).get("tolerance", metrics.TOLERANCE)))).alias(f"s{i}") for i, (_, r) in enumerate(rules)]
    scored = ready.select("*", *told)
    total = lambda xs: sum(xs, F.lit(0)).cast("bigint")
    mean = sum((F.col(f"s{i}") for i in range(len(rules))), F.lit(0.0)) / F.lit(max(1, len(rules)))
    return _summary(scored.select("doc_id", "p", "g", mean.alias("s"), total((F.col(f"s{i}") >= metrics.pass_threshold(F.lit(r.metric))).cast("int") for i, (_, r) in enumerate(rules)).alias("matched"), F.lit(len(rules)).cast("bigint").alias("total"), total((F.col(f"p{i}").isNull() & F.col(f"g{i}").isNotNull()).cast("int") for i in range(len(rules))).alias("missing")))


def doc_subtrees(scores: DataFrame) -> DataFrame:
    """(doc_id, top_key, score): mean score of each top member of each record."""
    return scores.groupBy("doc_id", top_key(F.col("field_key")).alias("top_key")).agg(F.avg("score").alias("score"))


def corpus_scores(docs: DataFrame) -> DataFrame:
    """(score, docs): the mean of the records' means."""
    return docs.agg(F.coalesce(F.avg("aggregate_score"), F.lit(0.0)).alias("score"), F.count("*").alias("docs"))


def corpus_subtrees(scores: DataFrame) -> DataFrame:
    """(top_key, score, fields): the mean over all fields under each top member, whatever their record."""
    return scores.groupBy(top_key(F.col("field_key")).alias("top_key")).agg(F.avg("score").alias("score"), F.count("*").alias("fields"))
