"""Registered queries of the core: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordscope.functions import coerce, hashing, metrics, text
from recordscope.operators import memo, nested, score, trajectory, usage
from recordscope.plans.schema_plan import compile_schema, eval_configs
from recordscope.queries import pairs
from recordscope.session import table
from recordscope.sources import discovery
from recordscope.streaming import call_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _mean(c: str) -> F.Column:
    """Mean to 6 decimals of an exact sum, so that the order of the rows decides nothing."""
    return F.round(F.sum(F.col(c).cast("decimal(20,12)")).cast("double") / F.count(c), 6).alias("score")


# --- problem 6 ---------------------------------------------------------------------------------------------------------


_DOCS_JSON = """
  docs as (select doc_no, lower(trim(schema_name)) as s, try_cast(case when json_type(j) = 'VARCHAR' then (j ->> '$') else j::varchar end as json) as v from (select doc_no, schema_name, try_cast(gold_data as json) as j from gold_documents where doc_no is not null)),
  sub(s, path, v) as (
    select lower(trim(schema_name)), '', coalesce((schema_json::json -> 'schema_definition'), schema_json::json) from schema_catalog
    union all
    select s, case when c.k is null then path || '[]' when path = '' then c.k else path || '.' || c.k end, c.x
    from sub, lateral (select null::varchar as k, (sub.v -> 'items') as x union all select key, value from json_each((sub.v -> 'properties'))) c where json_type(c.x) = 'OBJECT'),
  arrays as (select distinct s, path from sub where json_type(((v -> 'items') -> 'properties')) = 'OBJECT' or ((v -> 'items') ->> 'type') = 'object'),
  t(doc_no, s, at_list, path, general, owner, name, v) as (
    select doc_no, s, false, '', '', null::varchar, '', v from docs where json_type(v) in ('OBJECT', 'ARRAY')
    union all
    select doc_no, s, not c.is_key, c.path, c.general, c.owner, c.name, c.x from (
      select t.doc_no, t.s, t.v as v, row_path, row_general, row_path is not null or t.owner is null as own_row, t.at_list, coalesce(row_path, t.path) as here, coalesce(row_general, t.general) as kind,
        case when t.owner is null or row_path is not null then coalesce(row_path, '') else t.owner end as around, case when t.owner is null or row_path is not null then '' else t.name end as prefix
      from (select t.*, case when json_type(v) = 'OBJECT' and owner is not null and (at_list or a.path is not null) then case when at_list then t.path else t.path || '[0]' end end as row_path,
        case when json_type(v) = 'OBJECT' and owner is not null and (at_list or a.path is not null) then case when at_list then general else general || '[]' end end as row_general
        from t left join arrays a on a.s = t.s and a.path = t.general) t) r,
      lateral (select json_type(r.v) = 'OBJECT' as is_key, case when json_type(r.v) = 'ARRAY' then r.here || '[' || e.key || ']' when r.here = '' then e.key else r.here || '.' || e.key end as path,
        case when json_type(r.v) = 'ARRAY' then r.kind || '[]' when r.kind = '' then e.key else r.kind || '.' || e.key end as general, r.around as owner,
        case when json_type(r.v) = 'ARRAY' then '' when r.prefix = '' then e.key else r.prefix || '.' || e.key end as name, e.value as x
        from json_each(case when json_type(r.v) in ('OBJECT', 'ARRAY') then r.v end) e) c)"""
_ITEMS = "select doc_no, owner as parent_path, case when at_list then t.path else t.path || '[0]' end as child_path from t left join arrays a on a.s = t.s and a.path = t.general where owner is not null and json_type(v) = 'OBJECT' and (at_list or a.path is not null)"


@query("p6_found", f"with recursive {_DOCS_JSON} {_ITEMS}")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.p6_found(table(spark, d, "gold_documents"), table(spark, d, "schema_catalog"))


@query("p6_tables")
def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.all_tables(table(spark, d, "gold_documents"), table(spark, d, "schema_catalog"))


@query(
    "p6_cells",
    f"""with recursive {_DOCS_JSON}
    select doc_no, regexp_replace(case when at_list then general else regexp_replace(owner, '\\[\\d+\\]', '[]', 'g') end, '\\[\\]$', '') as list_path, case when at_list then t.path else owner end as child_path, case when at_list then owner end as item_in, name, v::varchar as value
    from t left join arrays a on a.s = t.s and a.path = t.general where owner is not null and (json_type(v) not in ('OBJECT', 'ARRAY') or v::varchar in ('{{}}', '[]') and not at_list and (json_type(v) = 'ARRAY' or a.path is null))""",
)
def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """(list_path, doc_no, child_path, item_in, name, value): a row per member of each row of the flat tables; item_in is the parent of a scalar in a list."""
    rows = nested.cells(nested.all_tables(table(spark, d, "gold_documents"), table(spark, d, "schema_catalog")))
    return rows.select("doc_no", "list_path", "child_path", F.when(F.col("name") == "", F.col("parent_path")).alias("item_in"), "name", "value")


@query("p6_scores_by_list", f"""with recursive {_DOCS_JSON},
    items as (select distinct doc_no, child_path from ({_ITEMS})),
    leaf as (select doc_no, score, regexp_extract(regexp_replace(field_key, '\\[\\d+\\]$', ''), '^(.*\\])[^\\]]*$', 1) as child_path from field_scores where not ends_with(field_key, '._array_avg'))
    select regexp_replace(regexp_replace(l.child_path, '\\[\\d+\\]', '[]', 'g'), '\\[\\]$', '') as list_path, count(*) as scores, count(i.doc_no) as attached, round(sum(score::decimal(20,12))::double / count(score), 6) as mean_score
    from leaf l left join items i on i.doc_no = l.doc_no and i.child_path = l.child_path where l.child_path <> '' group by 1""")
def p6_scores_by_list(spark: SparkSession, d: str) -> DataFrame:
    return nested.p6_scores_by_list(table(spark, d, "gold_documents"), table(spark, d, "schema_catalog"), table(spark, d, "field_scores"))


# --- coercions and metrics ---------------------------------------------------------------------------------------------

_W = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}]"
_FLOAT = r"[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _float(x: str) -> str:
    return f"case when regexp_full_match(lower({_strip(x)}), '{_FLOAT}') then try_cast(replace({_strip(x)}, '_', '') as double) end"


def _int(x: str) -> str:
    return f"case when abs({_float(x)}) < 9.2e18 then try_cast(trunc({_float(x)}) as bigint) end"


def _bool(x: str) -> str:
    return f"case when lower({_strip(x)}) in ('true', '1', 'yes') then true when lower({_strip(x)}) in ('false', '0', 'no') then false end"


def _both(p: str, g: str, equal: str) -> str:
    return f"case when ({p}) is null and ({g}) is null then 1.0::double when ({p}) is null or ({g}) is null then 0.0::double when {equal} then 1.0::double else 0.0::double end"


@query("coerce_values", f"select score_id, {_strip('predicted_value')} as s, {_float('predicted_value')} as f, cast({_int('predicted_value')} as varchar) as i, cast({_bool('predicted_value')} as varchar) as b from field_scores")
def coerce_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("predicted_value")
    return table(spark, d, "field_scores").select("score_id", coerce.strip(v).alias("s"), coerce.to_float(v).alias("f"), coerce.to_int(v).cast("string").alias("i"), coerce.to_bool(v).cast("string").alias("b"))


_P, _G = "predicted_value", "gold_value"
_METRIC_SQL = {
    "string_exact": _both(_strip(_P), _strip(_G), f"{_strip(_P)} = {_strip(_G)}"),
    "string_case_insensitive": _both(_P, _G, f"lower({_strip(_P)}) = lower({_strip(_G)})"),
    "integer_exact": _both(_int(_P), _int(_G), f"{_int(_P)} = {_int(_G)}"),
    "number_tolerance": _both(_float(_P), _float(_G), f"abs({_float(_P)} - {_float(_G)}) / greatest(abs({_float(_G)}), 1e-9) <= 0.001"),
    "number_exact": _both(_float(_P), _float(_G), f"{_float(_P)} = {_float(_G)} and not isnan({_float(_P)})"),
    "boolean_exact": _both(_bool(_P), _bool(_G), f"({_bool(_P)}) = ({_bool(_G)})"),
}


def _metric_query(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "field_scores").select("score_id", metrics.score(name, F.col(_P), F.col(_G)).alias("score"))

    query(f"metric_{name}", f"select score_id, {_METRIC_SQL[name]} as score from field_scores")(run)


for _name in _METRIC_SQL:
    _metric_query(_name)

_NATIVE = "('string_exact', 'integer_exact', 'number_tolerance')"


@query(
    "metric_dispatch",
    "select score_id, metric_type, round(case metric_type " + " ".join(f"when '{m}' then {_METRIC_SQL[m]}" for m in ("string_exact", "integer_exact", "number_tolerance")) + f" else 0.0::double end, 6) as rescored from field_scores where metric_type in {_NATIVE} or metric_type = 'array_avg'",
)
def metric_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the metric that each row names; array_avg is no metric and scores 0."""
    rows = table(spark, d, "field_scores").where(F.expr(f"metric_type in {_NATIVE} or metric_type = 'array_avg'"))
    return metrics.dispatch(rows.withColumnRenamed("score", "_was"), "metric_type", _P, _G).select("score_id", "metric_type", F.round("score", 6).alias("rescored"))


@query("pass_threshold", "select score_id, score >= case when metric_type in ('string_fuzzy', 'string_semantic') then 0.8 when metric_type = 'array_avg' then 0.5 else 1.0 end as passes from field_scores")
def pass_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_scores").select("score_id", (F.col("score") >= metrics.pass_threshold(F.col("metric_type"))).alias("passes"))


_NAMES = "select p_partkey as id, reverse(left(p_name, 3)) || replace(substr(p_name, 4), 'e', '') as a, p_name as b from part"
_RATIO = f"""
with recursive p as ({_NAMES}),
sub(id, a, b, alo, ahi, blo, bhi, i, j, k) as (
  select id, a, b, 0, length(a), 0, length(b), m.i, m.j, m.k from p, lateral (
    select x.i, y.j, (select count(*) from range(0, least(length(p.a) - x.i, length(p.b) - y.j)) r(n) where substr(p.a, x.i + 1, r.n + 1) = substr(p.b, y.j + 1, r.n + 1)) k
    from range(0, length(p.a)) x(i), range(0, length(p.b)) y(j) order by k desc, i, j limit 1) m
  where m.k > 0
  union all
  select q.id, q.a, q.b, q.alo, q.ahi, q.blo, q.bhi, m.i, m.j, m.k from (
    select id, a, b, unnest([alo, i + k]) alo, unnest([i, ahi]) ahi, unnest([blo, j + k]) blo, unnest([j, bhi]) bhi from sub) q,
  lateral (
    select x.i, y.j, (select count(*) from range(0, least(q.ahi - x.i, q.bhi - y.j)) r(n) where substr(q.a, x.i + 1, r.n + 1) = substr(q.b, y.j + 1, r.n + 1)) k
    from range(q.alo, q.ahi) x(i), range(q.blo, q.bhi) y(j) order by k desc, i, j limit 1) m
  where m.k > 0)
select p.id as p_partkey, round(case when a = b or length(a) + length(b) = 0 then 1.0::double else 2.0::double * coalesce(s.m, 0) / (length(a) + length(b)) end, 6) as score
from p left join (select id, sum(k) m from sub group by id) s using (id)
"""


@query("metric_string_fuzzy", _RATIO)
def metric_string_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return pairs.name_pairs(table(spark, d, "part")).select("p_partkey", F.round(metrics.string_fuzzy(F.col("predicted"), F.col("gold")), 6).alias("score"))


@query("metric_string_semantic_fallback", _RATIO)
def metric_string_semantic_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Without a judge the semantic metric is the ratio."""
    return pairs.name_pairs(table(spark, d, "part")).select("p_partkey", F.round(metrics.string_semantic(F.col("predicted"), F.col("gold")), 6).alias("score"))


@query("field_scores_dispatched")
def field_scores_dispatched(spark: SparkSession, d: str) -> DataFrame:
    """The score of every row of field_scores by the metric that it names, of its whole values; no SQL, which is too slow for the ratio."""
    rows = table(spark, d, "field_scores").withColumnRenamed("score", "_was")
    return metrics.dispatch(rows, "metric_type", _P, _G).select("score_id", "metric_type", F.round("score", 6).alias("rescored"))


@query("field_scores_rescored")
def field_scores_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded leaf score beside the one that its metric gives now, with the ratio metrics."""
    rows = table(spark, d, "field_scores").where("metric_type <> 'array_avg'").withColumnRenamed("score", "recorded")
    return metrics.dispatch(rows, "metric_type", _P, _G).groupBy("metric_type").agg(F.count("*").alias("scores"), F.round(F.avg("recorded"), 6).alias("recorded"), F.round(F.avg("score"), 6).alias("rescored"))


# --- scoring of records ------------------------------------------------------------------------------------------------

_ORDER_FIELDS = """
  select o_orderkey as doc_id, 'key' as field_key, 'integer_exact' as metric_type, case when o_orderkey % 11 = 0 then 0.0 else 1.0 end::double as score, false as gone from orders
  union all select o_orderkey, 'status', 'string_exact', case when o_orderkey % 3 = 0 and lower(o_orderstatus) <> o_orderstatus then 0.0 else 1.0 end::double, false from orders
  union all select o_orderkey, 'price', 'number_tolerance', case when abs(o_totalprice * (1.0::double + (o_orderkey % 7 - 3)::double * 0.0004::double) - o_totalprice) / greatest(abs(o_totalprice), 1e-9) <= 0.001 then 1.0 else 0.0 end::double, false from orders
  union all select o_orderkey, 'priority', 'string_case_insensitive', case when o_orderkey % 5 = 0 then 0.0 else 1.0 end::double, o_orderkey % 5 = 0 from orders"""
_DOCS = f"""
  select doc_id, avg(score) as a, sum(case when score >= 1 then 1 else 0 end) as m, count(*) as n, sum(case when gone then 1 else 0 end) as gone,
    case when doc_id % 5 = 0 then 3 else 4 end as pl, 4 as gl from ({_ORDER_FIELDS}) group by doc_id"""


def _order_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pairs.order_pairs(table(spark, d, "orders"))
    return p, score.field_scores(p, compile_schema(pairs.ORDER_SCHEMA))


@query("field_scores_flat", f"select doc_id, field_key, metric_type, score, score >= 1 as passed from ({_ORDER_FIELDS})")
def field_scores_flat(spark: SparkSession, d: str) -> DataFrame:
    return _order_scores(spark, d)[1].select("doc_id", "field_key", "metric_type", "score", "passed")


@query(
    "doc_scores",
    f"""select doc_id, round(a, 6) as aggregate_score, round(m / pl, 6) as precision, round(m / gl, 6) as recall,
    round(case when m = 0 then 0.0 else 2 * (m / pl) * (m / gl) / (m / pl + m / gl) end::double, 6) as f1, n::bigint as total_fields, m::bigint as matched_fields, gone::bigint as missing_fields, greatest(pl - gl, 0)::bigint as extra_fields
    from (select doc_id, a, m::double as m, n, gone, pl, gl from ({_DOCS}))""",
)
def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    """Flat records are scored in their rows, without a shuffle."""
    out = score.flat_doc_scores(pairs.order_pairs(table(spark, d, "orders")), compile_schema(pairs.ORDER_SCHEMA))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("aggregate_score", "precision", "recall", "f1")), "total_fields", "matched_fields", "missing_fields", F.col("extra_fields").cast("bigint").alias("extra_fields"))


@query("doc_scores_long", SQL["doc_scores"])
def doc_scores_long(spark: SparkSession, d: str) -> DataFrame:
    """The same from the long table of field scores, as records with arrays need it."""
    out = score.doc_scores(*_order_scores(spark, d))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("aggregate_score", "precision", "recall", "f1")), "total_fields", "matched_fields", "missing_fields", F.col("extra_fields").cast("bigint").alias("extra_fields"))


_KEPT = "length(g) % 2 = 0"
_SAID = "round(least(length(p), length(g)) / greatest(length(p), length(g)), 6)"


def _asked(rows: DataFrame) -> DataFrame:
    """A judge that compares lengths."""
    n, m = F.length("predicted"), F.length("gold")
    return rows.select("key", F.round(F.least(n, m) / F.greatest(n, m), 6).alias("score"), F.lit("lengths").alias("reason"))


@query(
    "judged_scores",
    f"""with c as (select p_partkey as doc_id, p_name as g, case when p_partkey % 7 = 0 then p_name else reverse(left(p_name, 3)) || substr(p_name, 4) end as p, p_brand as b, case when p_partkey % 4 = 0 then lower(p_brand) else p_brand end as pb,
      '["' || p_size || '","a"]' as ps, '["' || p_size || '","b"]' as gs from part)
    select doc_id, 'name' as field_key, case when p = g then 1.0 when {_KEPT} then 0.25 else {_SAID} end::double as score, case when p = g then 'Exact match (semantic shortcut)' when {_KEPT} then 'kept' else 'lengths' end as reason from c
    union all select doc_id, 'sizes', 1.0::double, 'lengths' from c
    union all select doc_id, 'brand', case when b = pb then 1.0 else 0.0 end::double, case when b = pb then 'Exact match' else 'Mismatch: ' || $$'$$ || pb || $$' != '$$ || b || $$'$$ end from c""",
)
def judged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Records scored with a judge: names whose length is even have an answer in the cache already, the others are asked for once."""
    p = pairs.part_pairs(table(spark, d, "part"))
    names = p.select(F.get_json_object("predicted", "$.name").alias("p"), F.get_json_object("gold", "$.name").alias("g")).where("length(g) % 2 = 0").distinct()
    kept = names.select(hashing.metric_key(F.lit("string_semantic"), F.col("p"), F.col("g")).alias("key"), F.lit(0.25).alias("score"), F.lit("kept").alias("reason"))
    rows = score.field_scores(p, compile_schema(pairs.PART_SCHEMA), score.Judge(_asked, kept))
    return rows.select("doc_id", "field_key", "score", "reason")


_WHY = "case when {p} is null and {g} is null then 'Both null' when {p} is null or {g} is null then 'Null mismatch: pred=' || coalesce($$'$$ || {p} || $$'$$, 'None') || ', gold=' || coalesce($$'$$ || {g} || $$'$$, 'None') when {p} = {g} then 'Exact match' else 'Mismatch: ' || $$'$$ || {p} || $$' != '$$ || {g} || $$'$$ end"
_WHY_INT = "case when {a} is null and {b} is null then 'Both null' when {a} is null or {b} is null then 'Null/type mismatch: pred=' || coalesce($$'$$ || {p} || $$'$$, 'None') || ', gold=' || coalesce($$'$$ || {g} || $$'$$, 'None') when {a} = {b} then 'Exact integer match: ' || {a} else 'Integer mismatch: ' || {a} || ' != ' || {b} end"


@query("metric_reasons", f"select score_id, {_WHY.format(p='p', g='g')} as exact, {_WHY_INT.format(a='a', b='b', p='p', g='g')} as whole from (select score_id, {_strip(_P)} as p, {_strip(_G)} as g, {_int(_P)} as a, {_int(_G)} as b from field_scores where ({_float(_P)} is null or {_int(_P)} is not null) and ({_float(_G)} is null or {_int(_G)} is not null) union all select score_id, {_strip(_P)}, {_strip(_G)}, null, null from field_scores where not (({_float(_P)} is null or {_int(_P)} is not null) and ({_float(_G)} is null or {_int(_G)} is not null)))")
def metric_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why two values are or are not the same text and the same whole number."""
    rows = table(spark, d, "field_scores").select("score_id", coerce.strip(F.col(_P)).alias("p"), coerce.strip(F.col(_G)).alias("g")).select("*", coerce.to_float(F.col("p")).alias("a"), coerce.to_float(F.col("g")).alias("b"))
    why = lambda m: metrics.reason(m, *(F.col(c) for c in "pgab"), metrics.prepared(m, *(F.col(c) for c in "pgab")))
    return rows.select("score_id", why("string_exact").alias("exact"), why("integer_exact").alias("whole"))


@query("doc_subtrees", f"select doc_id, field_key as top_key, round(avg(score), 6) as score from ({_ORDER_FIELDS}) group by all")
def doc_subtrees(spark: SparkSession, d: str) -> DataFrame:
    return score.doc_subtrees(_order_scores(spark, d)[1]).select("doc_id", "top_key", F.round("score", 6).alias("score"))


@query("corpus_macro", f"select round(avg(a), 6) as score, count(*) as docs from ({_DOCS})")
def corpus_macro(spark: SparkSession, d: str) -> DataFrame:
    return score.corpus_scores(score.doc_scores(*_order_scores(spark, d))).select(F.round("score", 6).alias("score"), "docs")


@query("corpus_subtree_micro", "select run_id, regexp_extract(field_key, '^[^.\\[]*') as top_key, round(sum(score::decimal(20,12))::double / count(score), 6) as score, count(*) as fields from field_scores group by all")
def corpus_subtree_micro(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_scores").groupBy("run_id", text.top_key(F.col("field_key")).alias("top_key")).agg(_mean("score"), F.count("*").alias("fields"))


@query("run_macro", "select run_id, iteration, round(sum(s::decimal(20,12))::double / count(s), 6) as score, count(*) as docs from (select run_id, iteration, doc_no, avg(score) as s from field_scores group by all) group by all")
def run_macro(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the documents' means, per run and iteration."""
    per = table(spark, d, "field_scores").groupBy("run_id", "iteration", "doc_no").agg(F.avg("score").alias("s"))
    return per.groupBy("run_id", "iteration").agg(_mean("s"), F.count("*").alias("docs"))


@query("subtree_lines", "select run_id, string_agg(top || ': ' || round(m, 4)::decimal(10,4), chr(10) order by top) as lines from (select run_id, regexp_extract(field_key, '^[^.\\[]*') as top, sum(score::decimal(20,12))::double / count(score) as m from field_scores group by all) group by run_id")
def subtree_lines(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.subtree_lines(table(spark, d, "field_scores"))


@query("missing_extra", "select doc_no, count(*) filter (predicted_value is null and gold_value is not null) as missing, count(*) filter (predicted_value is not null and gold_value is null) as extra from field_scores group by doc_no")
def missing_extra(spark: SparkSession, d: str) -> DataFrame:
    p, g = F.col(_P), F.col(_G)
    return table(spark, d, "field_scores").groupBy("doc_no").agg(F.count_if(p.isNull() & g.isNotNull()).alias("missing"), F.count_if(p.isNotNull() & g.isNull()).alias("extra"))


@query("leaf_count", "select doc_no, case when json_valid(gold_data) then (select count(*) from json_tree(try_cast(gold_data as json)) where type not in ('OBJECT', 'ARRAY') or value::varchar in ('{}', '[]')) else 0 end as leaves from gold_documents")
def leaf_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_documents").select("doc_no", text.leaf_count(F.col("gold_data")).alias("leaves"))


@query("nested_path_project", "select doc_no, try_cast(gold_data as json) ->> '$.company.address.city' as city, try_cast(gold_data as json) ->> '$.meet.pool.city' as pool_city from gold_documents")
def nested_path_project(spark: SparkSession, d: str) -> DataFrame:
    whole = F.try_parse_json("gold_data")
    get = lambda p: F.try_variant_get(whole, p, "string")
    return table(spark, d, "gold_documents").select("doc_no", get("$.company.address.city").alias("city"), get("$.meet.pool.city").alias("pool_city"))


@query(
    "eval_config_rows",
    """with recursive n(s, path, v) as (
      select schema_name, '', coalesce((schema_json::json -> 'schema_definition'), schema_json::json) from schema_catalog
      union all
      select s, case when c.k is null then path || '[]' when path = '' then c.k else path || '.' || c.k end, c.x
      from n, lateral (select null::varchar as k, (n.v -> 'items') as x union all select key, value from json_each((n.v -> 'properties'))) c where json_type(c.x) = 'OBJECT'),
    r as (select s, path, (v -> 'evaluation_config') as e from n where path <> '' and json_exists(v, '$.evaluation_config')),
    m as (select s, path, case when json_type(e) = 'VARCHAR' then (e ->> '$') else coalesce((e ->> '$.metrics[0].metric_id'), (e ->> '$.metric_id'), (e ->> '$.metrics[0]')) end as metric_id, coalesce((e ->> '$.metrics[0].params.tolerance'), (e ->> '$.params.tolerance')) as tolerance from r),
    seen as (select regexp_replace(field_key, '\\[\\d+\\]', '[]', 'g') as path, metric_type as metric_id, count(*) as leaves from field_scores group by all)
    select s as schema_name, path, metric_id, tolerance, coalesce(leaves, 0) as leaves from m left join seen using (path, metric_id)""",
)
def eval_config_rows(spark: SparkSession, d: str) -> DataFrame:
    """(schema_name, path, metric_id, tolerance, leaves): the compiled rules, with the recorded leaf scores of each path."""
    schemas = table(spark, d, "schema_catalog").select("schema_name", "schema_json").collect()
    rules = [(r["schema_name"], path, m, params.get("tolerance")) for r in schemas for path, m, params in eval_configs(compile_schema(r["schema_json"]))]
    plan = spark.createDataFrame(rules, "schema_name string, path string, metric_id string, tolerance string")
    seen = table(spark, d, "field_scores").groupBy(F.regexp_replace("field_key", r"\[\d+\]", "[]").alias("path"), F.col("metric_type").alias("metric_id")).agg(F.count("*").alias("leaves"))
    return plan.join(seen, ["path", "metric_id"], "left").select("schema_name", "path", "metric_id", "tolerance", F.coalesce("leaves", F.lit(0).cast("bigint")).alias("leaves"))


# --- arrays ------------------------------------------------------------------------------------------------------------

_TAGS = """
  with g as (select l_orderkey as doc_id, lower(l_returnflag) as t, count(*) as n from lineitem group by all),
  p as (select l_orderkey as doc_id, lower(l_returnflag) as t, count(*) as n from lineitem where not (l_orderkey % 2 = 0 and l_linenumber = 1) group by all),
  gn as (select doc_id, sum(n) as n from g group by doc_id), pn as (select doc_id, sum(n) as n from p group by doc_id),
  m as (select doc_id, sum(least(g.n, p.n)) as n from g join p using (doc_id, t) group by doc_id)
  select doc_id, coalesce(m.n, 0) / gn.n as overlap, coalesce(pn.n, 0) as pn from gn left join pn using (doc_id) left join m using (doc_id)"""


@query("array_set_overlap", f"select doc_id, round(overlap, 6) as score from ({_TAGS})")
def array_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pairs.tag_pairs(table(spark, d, "lineitem")).select("doc_id", F.round(metrics.set_overlap(F.col("predicted"), F.col("gold")), 6).alias("score"))


@query("array_llm_fallback", f"select doc_id, case when pn = 0 then 0.0::double else round(overlap, 6) end as score from ({_TAGS})")
def array_llm_fallback(spark: SparkSession, d: str) -> DataFrame:
    return pairs.tag_pairs(table(spark, d, "lineitem")).select("doc_id", F.round(metrics.array_llm(F.col("predicted"), F.col("gold")), 6).alias("score"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    node = compile_schema(pairs.ITEM_SCHEMA).members["lines"]
    both = pairs.item_pairs(table(spark, d, "lineitem")).withColumn("key", F.lit(""))
    return score.alignments(both, "lines", node)


@query("array_assignment")
def array_assignment(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, gold_items, predicted_items, total): the greatest total similarity of a one-to-one assignment."""
    total = F.aggregate("pairs", F.lit(0.0), lambda n, x: n + x["sim"])
    return _aligned(spark, d).select("doc_id", F.size("gs").alias("gold_items"), F.size("ps").alias("predicted_items"), F.round(total, 6).alias("total"))


@query("array_scores")
def array_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = score.field_scores(pairs.item_pairs(table(spark, d, "lineitem")), compile_schema(pairs.ITEM_SCHEMA))
    return rows.groupBy("field_path", "metric_type").agg(F.count("*").alias("fields"), F.round(F.avg("score"), 6).alias("score"))


@query(
    "array_match_sizes",
    """select doc_id, least(n, p)::bigint as matched, greatest(p - n, 0)::bigint as extra, greatest(n - p, 0)::bigint as lost
    from (select l_orderkey as doc_id, count(*) as n, count(*) - case when l_orderkey % 4 = 0 then 1 else 0 end as p from lineitem group by l_orderkey)""",
)
def array_match_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, matched, extra, lost): all items of the shorter side are matched, the rest is unmatched."""
    n = lambda f: F.size(F.filter("pairs", f)).cast("bigint")
    return _aligned(spark, d).select("doc_id", n(lambda x: (x["pred_idx"] >= 0) & (x["gold_idx"] >= 0)).alias("matched"), n(lambda x: x["gold_idx"] < 0).alias("extra"), n(lambda x: x["pred_idx"] < 0).alias("lost"))


# --- text, JSON, hashes ------------------------------------------------------------------------------------------------


@query("extract_prompt_tag", f"select call_id, any_value({_strip('case when regexp_matches(output, $$(?s)<PROMPT>(.*?)</PROMPT>$$) then regexp_extract(output, $$(?s)<PROMPT>(.*?)</PROMPT>$$, 1) else output end')}) as prompt from (select distinct call_id, output from llm_calls where call_type = 'generate') group by call_id")
def extract_prompt_tag(spark: SparkSession, d: str) -> DataFrame:
    calls = usage.latest_calls(table(spark, d, "llm_calls").where("call_type = 'generate'"), "output")
    return calls.select("call_id", text.extract_prompt_tag(F.col("output")).alias("prompt"))


@query("render_prompt", "select record_id, schema_name, sha256(replace(prompt, '{schema}', schema_json)) as rendered, length(replace(prompt, '{schema}', schema_json)) as chars from prompt_history, schema_catalog where prompt is not null")
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Every prompt with every schema of the catalog, which is a bounded table."""
    schemas = table(spark, d, "schema_catalog").select("schema_name", "schema_json").limit(nested.MAX_SCHEMAS).collect()
    each = F.inline(F.array(*(F.struct(F.lit(r["schema_name"]).alias("schema_name"), F.lit(r["schema_json"]).alias("schema")) for r in schemas)))
    done = table(spark, d, "prompt_history").where("prompt is not null").select("record_id", "prompt", each).select("record_id", "schema_name", text.render_prompt(F.col("prompt"), F.col("schema")).alias("r"))
    return done.select("record_id", "schema_name", F.sha2("r", 256).alias("rendered"), F.length("r").cast("bigint").alias("chars"))


@query("truncate_repr", "select score_id, case when length(gold_value) > 20 then left(gold_value, 17) || '...' else gold_value end as shown from field_scores")
def truncate_repr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_scores").select("score_id", text.truncate(F.col("gold_value"), 20).alias("shown"))


@query("top_key", "select score_id, regexp_extract(field_key, '^[^.\\[]*') as top from field_scores")
def top_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_scores").select("score_id", text.top_key(F.col("field_key")).alias("top"))


@query("parse_json_fenced")
def parse_json_fenced(spark: SparkSession, d: str) -> DataFrame:
    """(call_type, calls, strict, repaired): extractions whose output parses as it is, and after closing what is open."""
    calls = usage.latest_calls(table(spark, d, "llm_calls"), "call_type", "output").where("output is not null")
    strict = text.parse_json(F.col("output")).isNotNull()
    lenient = text.parse_lenient_udf("output") != "{}"
    return calls.select("call_type", strict.alias("s"), lenient.alias("l")).groupBy("call_type").agg(F.count("*").alias("calls"), F.count_if("s").alias("strict"), F.count_if("l").alias("repaired"))


@query("json_repair")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """(call_id, record): the JSON value of every output, repaired where it was cut."""
    calls = usage.latest_calls(table(spark, d, "llm_calls"), "output").where("output is not null")
    return calls.select("call_id", text.parse_lenient_udf("output").alias("record"))


@query("log_prefixes", "select call_id, left(input_prompt, 200) as asked, left(output, 300) as answered from (select call_id, input_prompt, output from llm_calls where call_id is not null qualify row_number() over (partition by call_id order by ingested_at desc) = 1)")
def log_prefixes(spark: SparkSession, d: str) -> DataFrame:
    calls = usage.latest_calls(table(spark, d, "llm_calls"), "input_prompt", "output")
    return calls.select("call_id", usage.logged_text(F.col("input_prompt"), 200).alias("asked"), usage.logged_text(F.col("output"), 300).alias("answered"))


@query("prompt_hash", "select record_id, left(sha256(prompt), 16) as h, coalesce(lower(prompt_hash) = left(sha256(prompt), 16), false) as fresh from prompt_history where prompt is not null")
def prompt_hash(spark: SparkSession, d: str) -> DataFrame:
    h = hashing.prompt_hash(F.col("prompt"))
    return table(spark, d, "prompt_history").where("prompt is not null").select("record_id", h.alias("h"), F.coalesce(F.lower("prompt_hash") == h, F.lit(False)).alias("fresh"))


@query("extraction_key", "select doc_no, sha256(pdf_path || '||' || schema_name) as k from gold_documents")
def extraction_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_documents").select("doc_no", hashing.extraction_key(F.col("pdf_path"), F.col("schema_name")).alias("k"))


@query("metric_key", """select score_id, sha256('{"g": ' || coalesce(to_json(gold_value)::varchar, 'null') || ', "m": ' || to_json(metric_type)::varchar || ', "p": ' || coalesce(to_json(predicted_value)::varchar, 'null') || '}') as k from field_scores""")
def metric_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_scores").select("score_id", hashing.metric_key(F.col("metric_type"), F.col(_P), F.col(_G)).alias("k"))


_KEYED = "select *, md5(coalesce(metric_type, '') || '|' || coalesce(gold_value, '') || '|' || coalesce(predicted_value, '')) as key from field_scores"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return table(spark, d, "field_scores").withColumn("key", F.md5(F.concat_ws("|", e("metric_type"), e(_G), e(_P))))


@query("cache_lookup_misses", f"with k as ({_KEYED}) select distinct key from k where iteration >= 5 and key not in (select key from k where iteration < 5)")
def cache_lookup_misses(spark: SparkSession, d: str) -> DataFrame:
    """Metric calls from iteration 5 on that the iterations before did not make."""
    rows = _keyed(spark, d)
    return memo.misses(rows.where("iteration >= 5"), rows.where("iteration < 5").select("key").distinct())


@query("extraction_cache", "select key, md5(max_by(gold_data, (annotated_at, gold_data))) as result, max(annotated_at) as saved_at from (select sha256(pdf_path || '||' || schema_name) as key, gold_data, annotated_at from gold_documents where gold_data is not null and annotated_at is not null and pdf_path is not null and schema_name is not null) group by key")
def extraction_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache of extractions from the records of all splits, those of val and test saved after the others."""
    docs = table(spark, d, "gold_documents").where("gold_data is not null and annotated_at is not null and pdf_path is not null and schema_name is not null").select(F.col("pdf_path").alias("path"), F.col("schema_name").alias("prompt"), F.col("gold_data").alias("result"), F.col("annotated_at").alias("saved_at"), "split")
    first = docs.where("split = 'train'").select(hashing.extraction_key(F.col("path"), F.col("prompt")).alias("key"), "result", "saved_at")
    return memo.put_extractions(first, docs.where("split is null or split <> 'train'")).select("key", F.md5("result").alias("result"), "saved_at")


@query("cache_upsert", f"with k as ({_KEYED}) select key, max_by(score, (iteration, score_id)) as score, max_by(score_id, (iteration, score_id)) as score_id from k group by key")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The cache of metric calls, the last score of each key winning."""
    rows = _keyed(spark, d).select("key", "score", "iteration", "score_id")
    return memo.upsert(rows.where("iteration < 5"), rows.where("iteration >= 5"), "key", ["iteration", "score_id"]).select("key", "score", "score_id")


# --- sources and splits ------------------------------------------------------------------------------------------------


@query("discover_pairs", "select regexp_extract(gold_path, '([^/]*)\\.gold\\.json$', 1) as doc, min(gold_path) as gold_path from gold_documents where gold_path like '%.gold.json' and regexp_extract(gold_path, '([^/]*)\\.gold\\.json$', 1) in (select regexp_extract(pdf_path, '([^/]*)\\.pdf$', 1) from gold_documents where pdf_path like '%.pdf' and source <> 'public_pool') group by 1")
def discover_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Gold files whose PDF comes from a source other than public_pool."""
    docs = table(spark, d, "gold_documents")
    return discovery.with_pdf(docs.select(F.col("gold_path").alias("path")), docs.where("source <> 'public_pool'").select(F.col("pdf_path").alias("path")))


_SIZES = """
  select schema_name, n, n - v - t as n_train, v as n_val, t as n_test from (
    select schema_name, n, case when n < 3 then 0 else greatest(1, round_even(n * 0.15::double, 0)::int) end as v, v as t from (select schema_name, count(distinct doc_no) as n from gold_documents where doc_no is not null group by 1))"""


@query("split_sizes", f"select schema_name, n, n_train::bigint as n_train, n_val::bigint as n_val, n_test::bigint as n_test from ({_SIZES})")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "gold_documents").where("doc_no is not null").groupBy("schema_name").agg(F.countDistinct("doc_no").alias("n"))
    return discovery.split_sizes(n).select("schema_name", "n", *(F.col(c).cast("bigint").alias(c) for c in ("n_train", "n_val", "n_test")))


_SPLIT = f"""
  select schema_name, doc_no, case when k < n_train then 'train' when k < n_train + n_val then 'val' else 'test' end as new_split,
    (k - case when k < n_train then 0 when k < n_train + n_val then n_train else n_train + n_val end)::bigint as ord
  from (select schema_name, doc_no, row_number() over (partition by schema_name order by md5(doc_no || ':42'), doc_no) - 1 as k from (select distinct schema_name, doc_no from gold_documents)) join ({_SIZES}) using (schema_name)"""


@query("split_assign", _SPLIT)
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return discovery.assign_splits(table(spark, d, "gold_documents"))


@query("dry_run_cap", f"select schema_name, new_split, count(*) as docs from ({_SPLIT}) where ord < 5 group by all")
def dry_run_cap(spark: SparkSession, d: str) -> DataFrame:
    return discovery.first_of_each(discovery.assign_splits(table(spark, d, "gold_documents")), 5).groupBy("schema_name", "new_split").agg(F.count("*").alias("docs"))


@query("split_summary", "select schema_name, 'Schema: ' || schema_name || ' | Train: ' || count(*) filter (split = 'train') || ' | Val: ' || count(*) filter (split = 'val') || ' | Test: ' || count(*) filter (split = 'test') || ' | Total: ' || count(*) filter (split in ('train', 'val', 'test')) as summary from gold_documents group by schema_name")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return discovery.split_summary(table(spark, d, "gold_documents"))


@query("run_dirs", "select distinct run_id, '/runs/' || replace(schema_name, '/', '_') || '/' || run_id as dir from (select distinct f.run_id, g.schema_name from field_scores f join gold_documents g using (doc_no)) where run_id is not null and schema_name is not null")
def run_dirs(spark: SparkSession, d: str) -> DataFrame:
    """The folder of each run and schema that it scored."""
    docs = table(spark, d, "gold_documents").select("doc_no", "schema_name").where("schema_name is not null")
    runs = table(spark, d, "field_scores").select("doc_no", "run_id").where("run_id is not null").distinct().join(docs, "doc_no").select("run_id", "schema_name").distinct()
    return runs.select("run_id", discovery.run_dir("/runs", F.col("schema_name"), F.col("run_id")).alias("dir"))


@query("split_union", "select doc_no, split from gold_documents where split = 'train' union all select doc_no, split from gold_documents where split = 'val' union all select doc_no, split from gold_documents where split = 'test'")
def split_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "gold_documents").select("doc_no", "split")
    return docs.where("split = 'train'").unionByName(docs.where("split = 'val'")).unionByName(docs.where("split = 'test'"))


# --- usage -------------------------------------------------------------------------------------------------------------

_CALL_COLUMNS = ["run_id", "logged_at", "model", "input_tokens", "output_tokens", "total_tokens", "latency_seconds"]
_PRICED = """
  select call_id, run_id, logged_at, lower(trim(c.model)) as model, input_tokens, output_tokens, total_tokens, latency_seconds,
    coalesce(input_tokens, 0) / 1e6 * coalesce(input_per_m, 0.10) + coalesce(output_tokens, 0) / 1e6 * coalesce(output_per_m, 0.40) as cost
  from (select * from llm_calls qualify row_number() over (partition by call_id order by ingested_at desc) = 1) c left join model_prices p on lower(trim(c.model)) = lower(p.model)"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    calls = usage.latest_calls(table(spark, d, "llm_calls"), *_CALL_COLUMNS).withColumn("model", usage.model_name("model"))
    return usage.priced(calls, table(spark, d, "model_prices"))


@query("call_cost", f"select call_id, model, round(cost, 9) as cost from ({_PRICED})")
def call_cost(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("call_id", "model", F.round("cost", 9).alias("cost"))


@query("usage_summary", f"select run_id, model, count(*) as calls, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens, coalesce(sum(total_tokens), 0)::bigint as total_tokens, round(sum(cost), 4) as cost from ({_PRICED}) group by all")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage(_priced(spark, d), "run_id", "model")


@query(
    "budget_exhaustion",
    f"""select run_id, call_id, calls, tokens, reason from (
      select *, row_number() over (partition by run_id order by calls) as k from (
        select run_id, call_id, calls, tokens::bigint as tokens, case when calls >= 15 then 'calls' when tokens >= 4000 then 'tokens' when round(cost, 9) >= 0.002 then 'cost' when round(seconds, 6) >= 40 then 'time' end as reason from (
          select run_id, call_id, count(*) over w as calls, sum(coalesce(total_tokens, 0)) over w as tokens, sum(cost) over w as cost, sum(coalesce(latency_seconds, 0)) over w as seconds from ({_PRICED})
          window w as (partition by run_id order by logged_at nulls first, call_id rows unbounded preceding)))
      where reason is not null) where k = 1""",
)
def budget_exhaustion(spark: SparkSession, d: str) -> DataFrame:
    return usage.exhaustion(_priced(spark, d), 15, 4000, 0.002, 40.0)


@query(
    "budget_snapshots",
    f"""select run_id, call_id, count(*) over w as calls, (sum(coalesce(total_tokens, 0)) over w)::bigint as tokens, round(sum(cost::decimal(28,12)) over w, 6)::double as cost, round(sum(coalesce(latency_seconds, 0)::decimal(28,12)) over w, 2)::double as seconds from ({_PRICED})
    window w as (partition by run_id order by logged_at nulls first, call_id rows unbounded preceding)""",
)
def budget_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return usage.snapshots(_priced(spark, d))


@query("call_log_lines", """select call_id, to_json({logged_at: regexp_replace(c.logged_at::varchar, '(\\.[0-9]*[1-9])0+$|\\.0+$', '\\1'), call_type: c.call_type, provider: c.provider, model: c.model, input_tokens: c.input_tokens, output_tokens: c.output_tokens, total_tokens: c.total_tokens,
    estimated_cost_usd: round(c.estimated_cost_usd, 6)::decimal(20,6), latency_seconds: round(c.latency_seconds, 3)::decimal(20,3), success: c.success, error: c.error_text})::varchar as line
    from (select * from llm_calls where call_id is not null qualify row_number() over (partition by call_id order by ingested_at desc) = 1) c""")
def call_log_lines(spark: SparkSession, d: str) -> DataFrame:
    names = ["logged_at", "call_type", "provider", "model", "input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd", "latency_seconds", "success", "error_text"]
    return usage.log_lines(usage.latest_calls(table(spark, d, "llm_calls"), *names))


@query("stream_hourly_usage", "select date_trunc('hour', logged_at) as hour, lower(trim(model)) as model, count(*) as calls, coalesce(sum(coalesce(total_tokens, 0)), 0)::bigint as tokens from (select * from llm_calls where logged_at is not null qualify row_number() over (partition by call_id order by ingested_at) = 1) group by all")
def stream_hourly_usage(spark: SparkSession, d: str) -> DataFrame:
    return call_log.run_hourly(spark, f"{d}/llm_calls.parquet")


# --- trajectories ------------------------------------------------------------------------------------------------------

_ITERATIONS = "select * from prompt_history where run_id is not null and iteration is not null qualify row_number() over (partition by run_id, iteration order by record_id) = 1"
_GREEDY = f"""
  select *, coalesce(n = 1 or (best_before is null and validation_score is not null) or validation_score > best_before, false) as improved from (
    select *, count(*) over (partition by run_id order by iteration) as n, max(validation_score) over (partition by run_id order by iteration rows between unbounded preceding and 1 preceding) as best_before from ({_ITERATIONS}))"""
_STEPS = f"select *, lag(iteration) over (partition by run_id order by iteration) as previous from ({_ITERATIONS}) where accepted"


def _history(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return trajectory.iterations(table(spark, d, "prompt_history").select("run_id", "iteration", "record_id", *columns))


@query("greedy_accept", f"select run_id, iteration, best_before, improved from ({_GREEDY})")
def greedy_accept(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.greedy(_history(spark, d, "validation_score")).select("run_id", "iteration", "best_before", "improved")


@query(
    "stall_diversify",
    f"""select run_id, iteration, rejected_before, rejected_before >= 3 as diversify from (
      select run_id, iteration, n - 1 - coalesce(max(case when improved then n end) over (partition by run_id order by iteration rows between unbounded preceding and 1 preceding), 0) as rejected_before from ({_GREEDY}))""",
)
def stall_diversify(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.stalls(_history(spark, d, "validation_score"))


@query("duplicate_prompts", f"select run_id, iteration, f as first_iteration from (select run_id, iteration, min(iteration) over (partition by run_id, prompt) as f from ({_ITERATIONS}) where prompt is not null) where iteration > f")
def duplicate_prompts(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.duplicate_prompts(_history(spark, d, "prompt"))


@query("near_copy_prompts")
def near_copy_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that are near copies of the best one before them; no SQL, which is too slow for the ratio of whole prompts."""
    return trajectory.near_copies(_history(spark, d, "validation_score", "prompt"))


@query("prompt_diffs")
def prompt_diffs(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.prompt_diffs(_history(spark, d, "accepted", "prompt"))


@query("prompt_at", f"select run_id, iteration, prompt from ({_ITERATIONS}) qualify row_number() over (partition by run_id order by iteration = 3 desc, iteration) = 1")
def prompt_at(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.prompt_at(_history(spark, d, "prompt"), 3)


@query(
    "regressions",
    f"""with s as ({_STEPS}), f as (select run_id, iteration, unnest(map_keys(field_scores_summary)) as field, unnest(map_values(field_scores_summary)) as v from s)
    select s.run_id, s.iteration, s.previous, b.field, b.v as score_before, coalesce(a.v, 0.0) as score_after
    from s join f b on b.run_id = s.run_id and b.iteration = s.previous left join f a on a.run_id = s.run_id and a.iteration = s.iteration and a.field = b.field
    where round(b.v - coalesce(a.v, 0.0), 9) >= 0.05""",
)
def regressions(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.regressions(_history(spark, d, "accepted", "field_scores_summary"))


@query("overfit_gaps", f"select run_id, iteration, round(validation_score - test_score, 9) as gap from ({_ITERATIONS}) where accepted and iteration % 3 = 0 and round(validation_score - test_score, 9) > 0.1")
def overfit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.overfit(_history(spark, d, "accepted", "validation_score", "test_score"))


@query("score_curve", f"select run_id, iteration, validation_score, max(validation_score) over (partition by run_id order by iteration) as best, left(sha256(prompt), 8) as prompt_key from ({_ITERATIONS})")
def score_curve(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.score_curve(_history(spark, d, "validation_score", "prompt"))


@query("recent_history", f"select run_id, string_agg('#' || iteration || ' ' || case when accepted then 'accepted' else 'rejected' end || ' ' || coalesce(reason, ''), chr(10) order by iteration) as lines from (select * from ({_ITERATIONS}) qualify row_number() over (partition by run_id order by iteration desc) <= 5) group by run_id")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.recent(_history(spark, d, "accepted", "reason"))


@query("worst_fields", "select run_id, k as rank, score_id, field_key, score from (select *, row_number() over (partition by run_id order by score, score_id)::int as k from field_scores where field_key not like '%.\\_array\\_avg' escape '\\' and score is not null) where k <= 5")
def worst_fields(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.worst_fields(table(spark, d, "field_scores"))


@query(
    "line_diff_summary",
    f"""with s as ({_STEPS}), l as (select run_id, iteration, unnest(string_split(prompt, chr(10))) as line from s), k as (select run_id, iteration, previous from s where previous is not null)
    select k.run_id, k.iteration,
      (select count(*) from l a where a.run_id = k.run_id and a.iteration = k.iteration and not exists (select 1 from l b where b.run_id = k.run_id and b.iteration = k.previous and b.line = a.line)) as added,
      (select count(*) from l a where a.run_id = k.run_id and a.iteration = k.previous and not exists (select 1 from l b where b.run_id = k.run_id and b.iteration = k.iteration and b.line = a.line)) as removed
    from k""",
)
def line_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.line_changes(_history(spark, d, "accepted", "prompt"))


@query(
    "run_overview",
    f"""select run_id, tried, accepted, best, last_test, case when round(last_test - first_test, 9) > 0 then 'up' when round(last_test - first_test, 9) < 0 then 'down' when round(last_test - first_test, 9) = 0 then 'same' end as trend from (
      select run_id, count(*) - 1 as tried, count(*) filter (accepted and iteration > 0) as accepted, max(validation_score) as best,
        arg_min(test_score, iteration) filter (test_score is not null) as first_test, arg_max(test_score, iteration) filter (test_score is not null) as last_test from ({_ITERATIONS}) group by run_id)""",
)
def run_overview(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.overview(_history(spark, d, "accepted", "validation_score", "test_score"))
