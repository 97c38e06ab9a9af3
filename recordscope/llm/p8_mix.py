"""Problem 8: mixing sources to target weights.

The mix is a schedule of slots of equal size in tokens. Slot i takes the source in whose part of the cumulative
weights the golden-ratio point frac(i * phi) falls, so every stretch of the schedule holds the sources close to their weights.
The texts of each source are shuffled and laid end to end; a text starts in one block of a slot's size. The r-th
slot of a source takes its block r, and after the last block the next round begins, up to the source's most repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordscope.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer's vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The schedule has at most so many slots, and a slot at least so many tokens.
SLOTS = 1 << 20
LEAST_SLOT = 64
#: Texts of a source are numbered in buckets of about so many; slots are ranked in chunks of so many.
BUCKET_TEXTS = 20_000
CHUNK_SLOTS = 4096
#: mix_targets is a table of sources; more are refused.
MAX_SOURCES = 10_000
PHI = 0.6180339887498949


def source_key(col: str) -> Column:
    """A source's name without letter case, outer blanks and kind of separator."""
    name = F.regexp_replace(F.trim(F.lower(F.col(col).cast("string"))), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def sized(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, digest, tokens) of the rows (doc_id, source, digest, text), in tokens of a public tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        count = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            tokens = [len(count(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.int64())], ["doc_id", "source", "digest", "tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, digest string, tokens bigint")


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), each source once: shares added, the most repeats; rows without a positive share left out."""
    return targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.greatest(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(1)).alias("max_repeats")).where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _texts(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int) -> DataFrame:
    """One row per distinct text of a source with a target: its first document by doc_id.

    Repeats are told by digest before anything is counted in tokens. Only they are named and taken off, so texts are not
    shuffled where repeats are few.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), source_key("source").alias("source"), F.md5("text").alias("digest"), F.col("text").cast("string")).where("doc_id is not null and source is not null and text <> ''").join(F.broadcast(targets.select("source")), "source", "left_semi")
    keys = rows.select("digest", "doc_id", "source")
    repeated = keys.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "source")).alias("first")).where("n > 1")
    spare = cut(keys.join(repeated, "digest").where("struct(doc_id, source) <> first").select("digest", "doc_id", "source").distinct())
    kept = rows.join(spare, ["digest", "doc_id", "source"], "left_anti").select("doc_id", "source", "digest", "text")
    # rows that repeat a whole document are still one
    once = sized(kept, tokenizer).where("tokens > 0").dropDuplicates(["digest"])
    return once.select("doc_id", "source", "tokens").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))


def _laid_out(texts: DataFrame, buckets: int) -> DataFrame:
    """``texts`` with _start, the tokens of its source before it in shuffled order.

    The order is by bucket of the hash, then by hash. Sums per bucket give each bucket its offset, so no task
    sees more of a source than one bucket.
    """
    rows = texts.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    per = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    offset = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offset, ["source", "_b"]).withColumn("_start", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before", "_h")


def _plan(texts: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[list[dict], int, int]:
    """Sources with text (at most MAX_SOURCES rows), tokens of a slot, number of slots."""
    have = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    rows = targets.join(have, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"mix_targets names more than {MAX_SOURCES} sources")
    plan = [r.asDict() for r in rows if r["tokens"] and r["max_repeats"] > 0]
    whole = sum(r["target_share"] for r in plan)
    if not plan:
        return [], LEAST_SLOT, 0
    low = 0.0
    for r in plan:
        r["weight"] = r["target_share"] / whole
        r["low"], low = low, low + r["weight"]
    # the largest mix in which no source needs more than its repeats, unless a size is asked for
    total = total_tokens or int(min(r["tokens"] * r["max_repeats"] / r["weight"] for r in plan))
    slot = max(LEAST_SLOT, -(-total // SLOTS))
    for r in plan:
        r["blocks"] = -(-r["tokens"] // slot)
    return plan, slot, total // slot


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mix (slot, source, repeat, doc_id, tokens) and the plan (source, target_share, weight, max_repeats, tokens, texts).

    Sources are compared without case, outer blanks and kind of separator. A source without text or without a target
    gives nothing, and the shares of the others are scaled to sum to 1 (weight). Equal texts count as one
    text, that of the smallest doc_id. No text comes more than max_repeats times: slots of a source that has no more to
    give stay empty, which can only happen if ``total_tokens`` asks for a larger mix than the sources can
    give. Null texts, sources and doc_ids are left out. Empty tables give an empty mix. Extra columns play no part.
    """
    spark = documents.sparkSession
    wanted = targets_of(targets)
    texts = cut(_texts(documents, wanted, tokenizer, seed))
    plan, slot, slots = _plan(texts, wanted, total_tokens)
    known = spark.createDataFrame(
        [(i, r["source"], r["target_share"], r["weight"], r["max_repeats"], r["tokens"], r["texts"], r["blocks"]) for i, r in enumerate(plan)],
        "_at int, source string, target_share double, weight double, max_repeats int, tokens bigint, texts bigint, _blocks bigint",
    )
    buckets = max(1, sum(r["texts"] for r in plan) // BUCKET_TEXTS)
    laid = _laid_out(texts, buckets).withColumn("_block", F.floor(F.col("_start") / F.lit(slot)).cast("bigint"))
    point = (F.col("id") + 1) * F.lit(PHI)
    lows = np.array([r["low"] for r in plan])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(lows, batch.column(1).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], ["slot", "_at"])

    # a point falls in the part whose lower bound is the last one below it
    drawn = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("_u")).mapInArrow(draw, "slot bigint, _at int")
    schedule = drawn.join(F.broadcast(known.select("_at", "source", "max_repeats", "_blocks")), "_at").drop("_at")
    schedule = schedule.withColumn("_c", F.floor(F.col("slot") / CHUNK_SLOTS))
    before = schedule.groupBy("source", "_c").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = schedule.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_c").orderBy("slot")) - 1).join(before, ["source", "_c"]).withColumn("_r", F.col("_r") + F.col("_off"))
    filled = ranked.select("slot", "source", (F.floor(F.col("_r") / F.col("_blocks")) + 1).cast("int").alias("repeat"), F.pmod("_r", "_blocks").cast("bigint").alias("_block"), "max_repeats").where("repeat <= max_repeats")
    return filled.join(laid, ["source", "_block"]).select("slot", "source", "repeat", "doc_id", "tokens"), known.select("source", "target_share", "weight", "max_repeats", "tokens", "texts")


def p8_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, repeats, first_slot): the chosen texts, how often each is used and where first."""
    chosen, _ = mix(documents, targets)
    return chosen.groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("repeats"), F.min("slot").alias("first_slot"))


def p8_shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, weight, actual_share, used_tokens, texts, used_texts, most_repeats, max_repeats) of every target.

    weight is the target share among the sources that have text; actual_share the share of the mix's tokens.
    """
    chosen, plan = mix(documents, targets)
    per = chosen.groupBy("source", "doc_id", "tokens").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("used_tokens"), F.count("*").alias("used_texts"), F.max("n").alias("most_repeats"))
    all_targets = targets_of(targets).select("source", "target_share", "max_repeats")
    zero = F.lit(0).cast("bigint")
    out = all_targets.join(plan.select("source", "weight", "texts"), "source", "left").join(per, "source", "left").select("source", "target_share", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce("texts", zero).alias("texts"), F.coalesce("used_texts", zero).alias("used_texts"), F.coalesce("most_repeats", zero).alias("most_repeats"), "max_repeats")
    # one row per target, so a single window holds a bounded table
    total = F.sum("used_tokens").over(Window.partitionBy())
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide("used_tokens", total), F.lit(0.0)), 6))
