"""Problem 4: the same or nearly the same records in the training and the evaluation splits.

Two records match by doc_id or by their leaf entries. The entries are compared by an exact bipartite prefix-filter
join: under one global order of the entries, rare ones first by their exact counts, two sets that share enough must share
one of their first entries. The prefixes of the evaluation sets are the index; the training prefixes probe it, with
a length filter and a position filter (what can still be shared after this entry); the whole sets decide.
Records with equal sets are one set; pairs of sets become pairs of records only where pairs are asked for, and all joins
split hot keys into tiles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordscope.llm.p3_versions import TENTHS, prefixes, shares_enough
from recordscope.operators.skew import tiled_join
from recordscope.session import cut


def leaf_entries(text: str | None) -> set[tuple[str, str]]:
    """The (path, value) leaf entries of a record; none if it is null, broken or no object or list.

    Lists add ``[]`` to the path. Values are compared as text without outer blanks and case, numbers as they
    are written. JSON inside JSON strings counts as its content. Null members, empty lists and empty objects
    have no entries; of members with one name the last counts.
    """
    value: object = text
    try:
        # numbers are kept as text, so only what opens like a string, object or list is read again
        while isinstance(value, str) and value.lstrip()[:1] in ('"', "{", "["):
            value = json.loads(value, strict=False, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        return set()
    out: set[tuple[str, str]] = set()
    todo = [("", value)] if isinstance(value, (dict, list)) else []
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{path}[]", v) for v in x]
        elif x is not None:
            out.add((path, ("true" if x else "false") if isinstance(x, bool) else str(x).strip().casefold()))
    return out


def doc_key(col: Column) -> Column:
    """doc_id without letter case, outer blanks and the separators ``-``, ``_`` and blank; null if nothing is left."""
    bare = F.regexp_replace(F.lower(col), r"[\s_\- ]+", "")
    return F.when(bare != "", bare)


def entry_sets(records: DataFrame) -> DataFrame:
    """(doc_no, evaluation, key, source, split, set_id, tokens) of the records in a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = np.unique(np.array([xxhash.xxh3_64_intdigest(f"{p}\x00{v}") for p, v in leaf_entries(text)], np.uint64).astype(np.int64))
                sets.append(found)
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "set_id", "tokens"])

    split = F.lower(F.trim("split"))
    source = F.lower(F.trim(F.coalesce(F.col("source").cast("string"), F.lit("unknown"))))
    rows = records.where("doc_no is not null").select(F.col("doc_no").cast("bigint").alias("doc_no"), (split != "train").alias("evaluation"), doc_key(F.col("doc_id").cast("string")).alias("key"), source.alias("source"), split.alias("split"), F.col("gold_data").cast("string").alias("_text")).where(F.col("split").isin("train", "val", "test"))
    return rows.mapInArrow(run, "doc_no bigint, evaluation boolean, key string, source string, split string, set_id binary, tokens array<bigint>")


def similar_sets(sets: DataFrame) -> DataFrame:
    """(e, t): all pairs of an evaluation set and a training set, not the same set, that share enough of their union."""
    posted = cut(prefixes(sets, "set_id", "train", "evaluation"))
    index = posted.where("evaluation").select("token", F.col("position").alias("pe"), F.col("n").alias("ne"), F.col("set_id").alias("e"))
    probe = posted.where("train").select("token", F.col("position").alias("pt"), F.col("n").alias("nt"), F.col("set_id").alias("t"))
    need = F.ceil((F.col("ne") + F.col("nt")) * TENTHS / F.lit(10 + TENTHS))
    found = tiled_join(index, probe, "token", "e", "t").where(
        (F.col("e") != F.col("t")) & (F.least("ne", "nt") * 10 >= F.greatest("ne", "nt") * TENTHS) & (F.least(F.col("ne") - F.col("pe"), F.col("nt") - F.col("pt")) >= need)
    ).select("e", "t").distinct()
    left, right = sets.select(F.col("set_id").alias("e"), F.col("tokens").alias("te")), sets.select(F.col("set_id").alias("t"), F.col("tokens").alias("tt"))
    both = found.join(left, "e").join(right, "t")
    return both.where(shares_enough(F.size(F.array_intersect("te", "tt")), F.size("te"), F.size("tt"))).select("e", "t")


def set_pairs(rows: DataFrame) -> DataFrame:
    """(e, t): all pairs of an evaluation set and a training set that match, a set with itself where both splits have it."""
    sets = cut(rows.where("set_id is not null").groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.max(~F.col("evaluation")).alias("train"), F.max("evaluation").alias("evaluation")))
    same = sets.where("train and evaluation").select(F.col("set_id").alias("e"), F.col("set_id").alias("t"))
    return cut(similar_sets(sets).unionByName(same))


def overlaps(records: DataFrame) -> DataFrame:
    """(train_no, eval_no, by_id, by_entries): all pairs of a record in train and one in val or test that match.

    Splits and sources are compared without case and outer blanks; rows of other splits or without doc_no are left
    out. A null doc_id or one of separators only matches none; a record without entries matches by doc_id only.
    Rows that repeat a doc_no give each pair once. An empty table gives no rows; extra columns play no part.
    """
    rows = cut(entry_sets(records))
    pairs = set_pairs(rows)
    train, held = rows.where("not evaluation"), rows.where("evaluation")
    with_eval = cut(tiled_join(pairs, held.select(F.col("set_id").alias("e"), F.col("doc_no").alias("eval_no")), "e", "t", "eval_no").select("t", "eval_no"))
    by_entries = tiled_join(with_eval, train.select(F.col("set_id").alias("t"), F.col("doc_no").alias("train_no")), "t", "eval_no", "train_no").select("train_no", "eval_no", F.lit(False).alias("by_id"), F.lit(True).alias("by_entries"))
    by_id = tiled_join(train.select("key", F.col("doc_no").alias("train_no")), held.select("key", F.col("doc_no").alias("eval_no")), "key", "train_no", "eval_no").select("train_no", "eval_no", F.lit(True).alias("by_id"), F.lit(False).alias("by_entries"))
    return by_entries.unionByName(by_id).where("train_no <> eval_no").groupBy("train_no", "eval_no").agg(F.max("by_id").alias("by_id"), F.max("by_entries").alias("by_entries"))


def p4_found(records: DataFrame) -> DataFrame:
    """(doc_no_a, doc_no_b), smaller first."""
    return overlaps(records).select(F.least("train_no", "eval_no").alias("doc_no_a"), F.greatest("train_no", "eval_no").alias("doc_no_b")).distinct()


def p4_report(records: DataFrame) -> DataFrame:
    """(split, source, pairs, by_id, by_entries, records): overlaps of each evaluation split and source with train.

    Pairs are counted by classes of records with one doc_id and one set of entries, and never written out. Of rows that repeat a
    doc_no the first in the order of split, doc_id and entries counts.
    """
    rows = cut(entry_sets(records))
    pairs = set_pairs(rows)
    once = rows.groupBy("doc_no").agg(F.min(F.struct("split", "evaluation", "key", "set_id", "source")).alias("r")).select("r.*")
    held = cut(once.where("evaluation").groupBy("split", "source", "key", "set_id").agg(F.count("*").alias("n")))
    train = cut(once.where("not evaluation").groupBy("key", "set_id").agg(F.count("*").alias("n")))
    by_key = train.where("key is not null").groupBy("key").agg(F.sum("n").alias("by_id"))
    linked = tiled_join(pairs, train.where("set_id is not null").select(F.col("set_id").alias("t"), F.col("key").alias("train_key"), "n"), "t", "e", "train_key").select(F.col("e").alias("set_id"), "train_key", "n")
    by_set = linked.groupBy("set_id").agg(F.sum("n").alias("by_entries"))
    by_both = linked.where("train_key is not null").groupBy("set_id", F.col("train_key").alias("key")).agg(F.sum("n").alias("both"))
    zero = F.lit(0).cast("bigint")
    told = held.join(by_key, "key", "left").join(by_set, "set_id", "left").join(by_both, ["set_id", "key"], "left").na.fill(0, ["by_id", "by_entries", "both"])
    told = told.withColumn("pairs", F.col("by_id") + F.col("by_entries") - F.col("both")).where(F.col("pairs") > zero)
    total = lambda c: F.sum(F.col(c) * F.col("n")).alias(c)
    return told.groupBy("split", "source").agg(total("pairs"), total("by_id"), total("by_entries"), F.sum("n").alias("records"))
