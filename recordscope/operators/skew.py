"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one part in HOT_PARTS of all rows on; there are never more hot keys than that.
HOT_PARTS = 256
SALTS = 64


def hot_keys(counts: DataFrame, key: str, count: str = "copies") -> DataFrame:
    """The keys that hold at least one part in ``HOT_PARTS`` of all rows, from rows per key.

    ``counts`` has a row per key. The result has at most ``HOT_PARTS`` rows, whatever the input.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) * HOT_PARTS >= F.lit(total)).select(key)


def salted_join(rows: DataFrame, by_key: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row per ``key``.

    The rows of the keys in ``hot`` (at most ``HOT_PARTS`` keys, broadcast) are spread over ``SALTS``
    tasks by a hash of the column ``spread``, and their one row of ``by_key`` is repeated for each.
    Null keys match nothing.
    """
    mark = F.broadcast(hot.select(F.col(key).alias("_hot")))
    left = rows.join(mark, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    )
    right = by_key.join(mark, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))),
    )
    return left.drop("_hot").join(right.drop("_hot"), [key, "_salt"], how).drop("_salt")


def tiled_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """The inner join of two tables on ``key``, which may come in very many rows of both.

    A key with more than one part in ``HOT_PARTS`` of a side's rows is cut into tiles: its rows of that side are spread over
    parts of about that size by a hash of their id, the other side's rows are repeated for each part, and every pair meets in exactly one
    tile. At most ``HOT_PARTS`` keys of a side are hot, so their table is broadcast. Other columns must differ in name. Null
    keys match nothing.
    """
    parts = []
    for rows in (left, right):
        per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        total = per.agg(F.sum("_n")).first()[0] or 0
        parts.append(per.where(F.col("_n") * HOT_PARTS > F.lit(total)).select(key, F.ceil(F.col("_n") * HOT_PARTS / F.lit(max(1, total))).cast("int").alias("_parts")))
    hot = parts[0].withColumnRenamed("_parts", "_l").join(parts[1].withColumnRenamed("_parts", "_r"), key, "full").select(F.col(key).alias("_hot"), F.coalesce("_l", F.lit(1)).alias("_l"), F.coalesce("_r", F.lit(1)).alias("_r"))

    def placed(rows: DataFrame, own: str, other: str, by: str, mine: str, theirs: str) -> DataFrame:
        marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(1))
        return marked.withColumn(mine, F.pmod(F.xxhash64(by), n(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), n(other) - 1))).drop("_hot", "_l", "_r")

    a, b = placed(left, "_l", "_r", left_id, "_i", "_j"), placed(right, "_r", "_l", right_id, "_j", "_i")
    return a.join(b, [key, "_i", "_j"]).drop("_i", "_j")
