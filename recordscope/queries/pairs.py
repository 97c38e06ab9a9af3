"""Predicted and gold records derived from the given tables, by fixed rules that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER_SCHEMA = {
    "type": "object",
    "properties": {
        "key": {"type": "integer", "evaluation_config": "integer_exact"},
        "status": {"type": "string", "evaluation_config": "string_exact"},
        "price": {"type": "number", "evaluation_config": {"metrics": [{"metric_id": "number_tolerance", "params": {"tolerance": 0.001}}]}},
        "priority": {"type": "string", "evaluation_config": "string_case_insensitive"},
    },
}
ITEM_SCHEMA = {
    "type": "object",
    "properties": {
        "lines": {
            "type": "array",
            "items": {"type": "object", "properties": {"part": {"evaluation_config": "integer_exact"}, "quantity": {"evaluation_config": "number_exact"}, "flag": {"evaluation_config": "string_exact"}}},
        }
    },
}


def order_pairs(orders: DataFrame) -> DataFrame:
    """(doc_id, predicted, gold) of every order."""
    k = F.col("o_orderkey")
    gold = F.struct(k.alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    predicted = F.struct(
        F.when(k % 11 == 0, k + 1).otherwise(k).alias("key"),
        F.when(k % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status"),
        (F.col("o_totalprice") * (F.lit(1.0) + (k % 7 - 3).cast("double") * F.lit(0.0004))).alias("price"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" "))).otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    return orders.select(k.alias("doc_id"), F.to_json(predicted).alias("predicted"), F.to_json(gold).alias("gold"))


def item_pairs(lineitem: DataFrame) -> DataFrame:
    """(doc_id, predicted, gold) of every order's lines: predicted in reverse, some quantities one more, every fourth order without its first."""
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    all_lines = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    kept = F.when(F.col("doc_id") % 4 == 0, F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines"))
    changed = F.transform(F.reverse(kept), lambda x: F.struct(x["part"].alias("part"), F.when(x["part"] % 6 == 0, x["quantity"] + 1).otherwise(x["quantity"]).alias("quantity"), x["flag"].alias("flag")))
    return all_lines.select("doc_id", F.to_json(F.struct(changed.alias("lines"))).alias("predicted"), F.to_json(F.struct("lines")).alias("gold"))


def tag_pairs(lineitem: DataFrame) -> DataFrame:
    """(doc_id, predicted, gold) arrays of return flags: predicted in mixed case, without first lines in every second order."""
    k, n, flag = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")
    said = F.when(n % 2 == 0, F.concat(F.lower(flag), F.lit(" "))).otherwise(flag)
    return lineitem.groupBy(k.alias("doc_id")).agg(F.collect_list(F.when(~((k % 2 == 0) & (n == 1)), said)).alias("predicted"), F.collect_list(flag).alias("gold"))


def name_pairs(part: DataFrame) -> DataFrame:
    """(p_partkey, predicted, gold) names, predicted without e and with its first three letters reversed."""
    name = F.col("p_name")
    return part.select("p_partkey", F.concat(F.reverse(F.left(name, F.lit(3))), F.replace(F.substring(name, 4, 100), F.lit("e"), F.lit(""))).alias("predicted"), name.alias("gold"))


PART_SCHEMA = {
    "type": "object",
    "properties": {
        "name": {"type": "string", "evaluation_config": "string_semantic"},
        "sizes": {"type": "array", "evaluation_config": {"metric_id": "array_llm"}},
        "brand": {"type": "string", "evaluation_config": "string_exact"},
    },
}


def part_pairs(part: DataFrame) -> DataFrame:
    """(doc_id, predicted, gold) of every part: names changed as in name_pairs(), every seventh the same; predicted brands in lower case for every fourth."""
    k, name = F.col("p_partkey"), F.col("p_name")
    changed = F.when(k % 7 == 0, name).otherwise(F.concat(F.reverse(F.left(name, F.lit(3))), F.substring(name, 4, 100)))
    sizes = lambda n: F.array(F.col("p_size").cast("string"), F.lit(n))
    record = lambda name, brand, s: F.to_json(F.struct(name.alias("name"), s.alias("sizes"), brand.alias("brand")))
    brand = F.col("p_brand")
    return part.select(k.alias("doc_id"), record(changed, F.when(k % 4 == 0, F.lower(brand)).otherwise(brand), sizes("a")).alias("predicted"), record(name, brand, sizes("b")).alias("gold"))
