"""Registered queries of the subpackage llm: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordscope.llm import p1_copies, p2_cut, p3_versions, p4_splits, p5_pairs, p7_leaks, p8_mix, p9_lookalikes
from recordscope.session import table

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


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_copies.p1_found(table(spark, d, "prompt_history"))


@query("p1_distinct")
def p1_distinct(spark: SparkSession, d: str) -> DataFrame:
    return p1_copies.p1_distinct(table(spark, d, "prompt_history"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_versions.p3_found(table(spark, d, "prompt_history"))


@query("p3_group_sizes")
def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p3_versions.p3_group_sizes(table(spark, d, "prompt_history"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_cut.p2_found(table(spark, d, "llm_calls"))


@query("p2_rates")
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return p2_cut.p2_rates(table(spark, d, "llm_calls"))


@query("p2_prompt_rates")
def p2_prompt_rates(spark: SparkSession, d: str) -> DataFrame:
    return p2_cut.p2_prompt_rates(table(spark, d, "llm_calls"))


@query("p2_limits")
def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return p2_cut.p2_limits(table(spark, d, "llm_calls"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_splits.p4_found(table(spark, d, "gold_documents"))


@query("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return p4_splits.p4_report(table(spark, d, "gold_documents"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs.p5_found(table(spark, d, "llm_calls"), table(spark, d, "documents"))


@query("p5_rates")
def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs.p5_rates(table(spark, d, "llm_calls"), table(spark, d, "documents"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks.p7_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks.p7_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_mix")
def p8_mix_(spark: SparkSession, d: str) -> DataFrame:
    return p8_mix.p8_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return p8_mix.p8_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_lookalikes.p9_found(table(spark, d, "documents"))


@query("p9_forms")
def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return p9_lookalikes.p9_forms(table(spark, d, "documents"))
