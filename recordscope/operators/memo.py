"""Content-addressed caches as tables: lookups, misses, merges, and judges that are called once per distinct pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordscope.functions.hashing import extraction_key, metric_key
from recordscope.session import cut


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys of ``requests`` that the cache does not hold; null keys can't be cached and are left out."""
    return requests.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``requests`` with the cache's columns, null where it holds nothing."""
    return requests.join(cache, key, "left")


def upsert(cache: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Both tables with one row per key: the last one by ``order``. Rows with a null key are left out."""
    rest = [c for c in cache.columns if c != key]
    both = cache.unionByName(new.select(*cache.columns)).where(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def put_extractions(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (key, result, saved_at) of extractions with new ones from (path, prompt, result, saved_at); a null time is now, the last one by time counts, then the greater result."""
    rows = new.select(extraction_key(F.col("path"), F.col("prompt")).alias("key"), "result", F.coalesce("saved_at", F.current_timestamp().cast("timestamp_ntz")).alias("saved_at"))
    return upsert(cache, rows, "key", ["saved_at", "result"])


def judged(pairs: DataFrame, cache: DataFrame, judge: Callable[[DataFrame], DataFrame], metric: str = "judge") -> tuple[DataFrame, DataFrame]:
    """(pairs with score and reason, merged cache). The judge sees each distinct pair that the cache lacks once.

    ``pairs`` has predicted and gold; ``judge`` takes (key, predicted, gold) and returns (key, score, reason). What it
    returned is written before it is joined, so no retry calls it again for a pair that is done. Scores are
    clamped to [0, 1]; a null score is a failure and isn't cached.
    """
    keyed = pairs.withColumn("key", metric_key(F.lit(metric), F.col("predicted"), F.col("gold")))
    missing = keyed.select("key", "predicted", "gold").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    told = cut(judge(missing).select("key", "score", "reason").where("score is not null").withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))))
    merged = cache.select("key", "score", "reason").unionByName(told)
    return keyed.join(merged, "key", "left").drop("key"), merged
