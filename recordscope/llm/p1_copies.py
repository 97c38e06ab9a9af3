"""Problem 1: duplicates hidden by formatting differences.

Every record gets the digest of its canonical form. The digest space is cut into segments, 24 bits of filter for each record.
Each task builds, for the segments of the digests it sees, a Bloom filter of the digests seen once and one of those seen
repeatedly; the filters are merged by segment, in a tree. The merged filters of repeats probe all records, a bounded
number of segments at a time. Only records whose digest may be a repeat are shuffled for exact grouping; the others
are singletons and stay where they are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordscope.llm.canon import canonical_text
from recordscope.operators.skew import hot_keys, salted_join
from recordscope.session import cut

#: Bits of a segment of the filter, bits set for each digest, bits of filter for each record; the filter grows with the records.
SEGMENT_BITS = 1 << 17
PROBES = 2
BITS_PER_RECORD = 24
#: Segments of the filter that probe the records in one pass (128 MiB); a filter of more segments takes more passes.
PASS_SEGMENTS = 8192
#: Digests that a task holds before it writes a filter, digests for which a task is worth while, filters merged by one task.
CHUNK, TASK_DIGESTS, FAN_IN = 1 << 20, 1 << 22, 16


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def digests(records: DataFrame, key: str = "record_id", text: str = "prompt", **carry: Column) -> DataFrame:
    """(record_id, *carry, digest, lane) of every record with a text; the digest is that of the canonical form, lane its first 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(canonical_text(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            lane = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary()), pa.array(lane, pa.int64())], [*batch.schema.names[:-1], "digest", "lane"])

    source = records.select(F.col(key).cast("bigint").alias("record_id"), *(c.cast("bigint").alias(n) for n, c in carry.items()), F.col(text).cast("string").alias("text")).where("record_id is not null and text is not null")
    return source.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["record_id", *carry]) + ", digest binary, lane bigint")


def _bits(words: np.ndarray, segments: int) -> np.ndarray:
    """The places (digests, PROBES) of digests, given as two words each, in the whole filter; all of one digest are in one segment."""
    segment = words[:, 0] % segments
    high, step = words[:, 0].view(np.uint64) >> np.uint64(32), words[:, 1].view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        bit = ((high[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) >> np.uint64(20)) % np.uint64(SEGMENT_BITS)
    return segment[:, None] * SEGMENT_BITS + bit.astype(np.int64)


def _packed(places: np.ndarray) -> bytes:
    """Sorted places of a segment, as steps."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64))


def repeat_filter(keys: DataFrame, records: int) -> tuple[DataFrame, int]:
    """(segment, twice) of the merged filter of repeatedly seen digests, and the number of segments.

    The filter grows with ``records``, so the share of singletons that pass it by chance stays below one in a hundred. No
    repeat is ever lost.
    """
    segments = max(1, math.ceil(records * BITS_PER_RECORD / SEGMENT_BITS))

    def filters(task: int, raw: list[bytes]) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        words = words[order]
        again = np.concatenate([[False], (words[1:] == words[:-1]).all(axis=1)]) if len(words) else np.zeros(0, bool)
        once, twice = (np.unique(_bits(words[x], segments)) for x in (~again, again))
        names = np.unique(once // SEGMENT_BITS)
        cols = [[_packed(x[a:b] - n * SEGMENT_BITS) for n, a, b in zip(names, np.searchsorted(x, names * SEGMENT_BITS), np.searchsorted(x, (names + 1) * SEGMENT_BITS))] for x in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([task] * len(names), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["segment", "part", "once", "twice"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, raw = TaskContext.get().partitionId(), []
        for batch in batches:
            raw += batch.column(0).to_pylist()
            if len(raw) >= CHUNK:
                yield filters(task, raw)
                raw = []
        if raw:
            yield filters(task, raw)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, seen = np.unique(np.concatenate([_unpacked(x) for x in group["once"]]), return_counts=True)
        twice = np.union1d(once[seen > 1], np.concatenate([_unpacked(x) for x in group["twice"]]))
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "part": [group["part"].iloc[0] // FAN_IN], "once": [_packed(once)], "twice": [_packed(twice)]})

    schema = "segment bigint, part int, once binary, twice binary"
    # fewer and larger tasks merge more on their side of the shuffle
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, records // TASK_DIGESTS)
    few = keys.select("digest").coalesce(parts)
    merged, parts = few.mapInArrow(build, schema), few.rdd.getNumPartitions()
    while True:
        merged = merged.groupBy("segment", F.floor(F.col("part") / FAN_IN).alias("_to")).applyInPandas(merge, schema)
        parts = math.ceil(parts / FAN_IN)
        if parts <= 1:
            break
    return cut(merged.select("segment", "twice")), segments


def mark_repeats(keys: DataFrame, records: int) -> DataFrame:
    """``keys`` with the column maybe_repeat, which is true for every digest that comes more than once."""
    found, segments = repeat_filter(keys, records)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields) + ", maybe_repeat boolean"

    def probing(first: int, last: int) -> DataFrame:
        # at most PASS_SEGMENTS segments of SEGMENT_BITS bits
        packed = [(r["segment"], r["twice"]) for r in found.where(F.col("segment").between(first, last - 1)).collect()]
        shared = keys.sparkSession.sparkContext.broadcast(packed)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros((last - first) * SEGMENT_BITS // 8, np.uint8)
            for segment, steps in shared.value:
                bits = np.zeros(SEGMENT_BITS, np.uint8)
                bits[_unpacked(steps)] = 1
                at = (segment - first) * SEGMENT_BITS // 8
                table[at : at + SEGMENT_BITS // 8] = np.packbits(bits)
            for batch in batches:
                words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<i8").reshape(-1, 2)
                bit = _bits(words, segments) - first * SEGMENT_BITS
                held = (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.all(axis=1))], [*batch.schema.names, "maybe_repeat"])

        mine = keys if segments <= PASS_SEGMENTS else keys.where(F.pmod("lane", F.lit(segments)).between(first, last - 1))
        return mine.mapInArrow(probe, schema)

    out = None
    for first in range(0, segments, PASS_SEGMENTS):
        part = probing(first, min(segments, first + PASS_SEGMENTS))
        out = part if out is None else out.unionByName(part)
    return out


def marked_keys(records: DataFrame, key: str, text: str, **carry: Column) -> DataFrame:
    keys = cut(digests(records, key, text, **carry))
    return cut(mark_repeats(keys, keys.count()))


def copy_groups(records: DataFrame, key: str = "record_id", text: str = "prompt") -> DataFrame:
    """(record_id, keep_id, copies) of every record with a text.

    keep_id is the smallest record_id with the same canonical form, copies the number of records that
    have it. Records without a key or text are left out; texts without letters and digits are copies
    of each other; rows that repeat a record_id count once each; an empty table gives no rows. Other
    columns of ``records`` play no part.
    """
    marked = marked_keys(records, key, text)
    maybe = marked.where("maybe_repeat").select("record_id", "digest")
    groups = cut(maybe.groupBy("digest").agg(F.min("record_id").alias("keep_id"), F.count("*").alias("copies")))
    grouped = salted_join(maybe, groups, "digest", "record_id", hot_keys(groups, "digest"))
    single = marked.where("not maybe_repeat").select("record_id", F.col("record_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return grouped.select("record_id", "keep_id", "copies").unionByName(single)


def p1_found(records: DataFrame) -> DataFrame:
    """(keep_id, record_id), a row for each record that copies a smaller one."""
    return copy_groups(records).where("record_id <> keep_id").select("keep_id", "record_id")


def p1_distinct(records: DataFrame) -> DataFrame:
    """(record_id, copies, saved_hashes, stale_hashes), a row for each distinct prompt.

    saved_hashes counts the prompt_hash values of its copies that are neither null nor empty,
    stale_hashes those of them that are not the first 16 hex digits of the prompt's SHA-256 in
    either letter case.
    """
    saved = F.lower(F.trim("prompt_hash"))
    given = F.coalesce(saved != "", F.lit(False))
    # what is counted travels with the digest, so the records are not joined again
    marked = marked_keys(records, "record_id", "prompt", given=given, stale=given & (saved != F.substring(F.sha2("prompt", 256), 1, 16)))
    counts = [F.count("*").alias("copies"), F.sum("given").alias("saved_hashes"), F.sum("stale").alias("stale_hashes")]
    grouped = marked.where("maybe_repeat").groupBy("digest").agg(F.min("record_id").alias("record_id"), *counts).drop("digest")
    single = marked.where("not maybe_repeat").select("record_id", F.lit(1).cast("bigint").alias("copies"), F.col("given").alias("saved_hashes"), F.col("stale").alias("stale_hashes"))
    return grouped.unionByName(single)
