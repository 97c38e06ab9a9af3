"""Running values over an order, for keys of any size.

A window over a key gathers all its rows in one task. Here the rows are range-partitioned by key and order, each part is
scanned by itself, and the totals of the parts before it, a few rows per key, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordscope.session import cut


def running(df: DataFrame, by: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """``df`` with a column per value: its running 'sum', 'max' or 'count' over the rows of the key before and at each row.

    A name that starts with ``before_`` leaves the row itself out. ``order`` must tell the rows of a key apart;
    nulls come first. A key's first row has 0 before it for sums and counts, null for maxima.
    """
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    totals = {n: (F.sum(c) if how == "sum" else F.max(c) if how == "max" else F.count(c)) for n, (how, c) in values.items()}
    per = parts.groupBy("_part", *by).agg(*(t.alias(f"_t_{n}") for n, t in totals.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.max(f"_t_{n}").over(earlier) if how == "max" else F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n, (how, _) in values.items()}
    names = {k: f"_k_{k}" for k in ["_part", *by]}
    carried = per.select(*(F.col(k).alias(n) for k, n in names.items()), *(c.alias(f"_c_{n}") for n, c in before.items()))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = parts.join(carried, same).drop(*names.values())
    out = []
    for n, (how, c) in values.items():
        last = -1 if n.startswith("before_") else Window.currentRow
        frame = inside.rowsBetween(Window.unboundedPreceding, last)
        own = (F.sum(c) if how == "sum" else F.max(c) if how == "max" else F.count(c)).over(frame)
        out.append((F.greatest(own, F.col(f"_c_{n}")) if how == "max" else F.coalesce(own, F.lit(0)) + F.col(f"_c_{n}")).alias(n))
    return joined.select(*df.columns, *out)
