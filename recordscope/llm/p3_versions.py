"""Problem 3: near-duplicate records with small edits.

Records that copy each other (problem 1) are first reduced to one representative. Two representatives are
versions if they share at least 0.7 of the distinct word sequences that either has. Candidates are exact: under one
global order of the sequences, rare ones first by their exact counts, two versions share a sequence of their prefixes. The
records that share a prefix sequence form a block; inside the blocks bit-sliced Hamming distances of
parity signatures leave the pairs within the radius that the threshold allows, and the sets decide.

Blocks are compared in two rounds. The first compares each record only with a few leaders of its blocks and joins
what it finds into components; the second compares only the blocks that still hold several components, and keeps pairs of
different components. A block of very many versions of one text thus gives about as many links as it has records, and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordscope.llm.bitslice import close_pairs, close_to_leader, signature
from recordscope.llm.canon import canonical_text
from recordscope.llm.p1_copies import copy_groups
from recordscope.operators.components import components
from recordscope.operators.skew import hot_keys, salted_join
from recordscope.session import cut

#: Similarity of versions in tenths, words of a sequence.
TENTHS = 7
WIDTH = 3
#: A block of more records than this is compared in tiles of about so many records.
TILE_ROWS = 4096
#: Leaders of a block in the first round.
LEADERS = 4

POSTINGS = "token bigint, tile int, side int, rep bigint, n int, sig binary, comp bigint"
PAIRS = "a bigint, b bigint"


def sequences(text: str) -> np.ndarray:
    """Hashes of the distinct word sequences of the canonical form, sorted; texts of fewer words have none."""
    words = canonical_text(text).split()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + WIDTH])) for i in range(len(words) - WIDTH + 1)], dtype=np.uint64).astype(np.int64))


def prefix_length(n: Column) -> Column:
    """How many of its first entries a set of n entries needs so that every set that shares enough with it holds one of them."""
    return n - F.ceil(n * TENTHS / F.lit(10)).cast("int") + 1


def reach(n: np.ndarray) -> np.ndarray:
    """Most sequences in which a record with n of them and any version of it can differ: the largest version has n * 10 / TENTHS."""
    return n * 10 // TENTHS - n


def radius(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most sequences in which versions with n and m sequences can differ: they share TENTHS / (10 + TENTHS) of n + m at least."""
    return n + m - 2 * -(-TENTHS * (n + m) // (10 + TENTHS))


def shares_enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether two sets of n and m entries have at least TENTHS tenths of their union in common."""
    return shared * 10 >= (n + m - shared) * TENTHS


def sets_of(texts: DataFrame) -> DataFrame:
    """(rep, tokens, sig) of a table (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sequences(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array([signature(t).tobytes() for t in sets], pa.binary())], ["rep", "tokens", "sig"])

    return texts.mapInArrow(run, "rep bigint, tokens array<bigint>, sig binary")


def prefixes(sets: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n, token, position): the entries of each set's prefix that another set holds too, rare ones first.

    The counts are exact: the entries are counted with map-side sums, and joined back where more than one set holds them.
    Entries of one set only come first in the order, so they use up the prefix without a row.
    """
    each = sets.select(*keys, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(held, "token").groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    kept = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix_length(F.col("n")) - alone))
    return ranked.select(*keys, "n", alone.alias("alone"), F.posexplode(kept).alias("at", "x")).select(*keys, "n", "x.token", (F.col("alone") + F.col("at")).alias("position"))


def blocks(prefix: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(token, members) of the blocks of at least two records; with the records' components, (token, members, main, others) of
    those of several components: the component with most of them and how many records have another."""
    if comps is None:
        return prefix.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    per = prefix.join(comps, "rep", "left").groupBy("token", F.coalesce("comp", "rep").alias("comp")).agg(F.count("*").alias("c"))
    mixed = per.groupBy("token").agg(F.sum("c").alias("members"), F.max(F.struct("c", "comp")).alias("m"))
    return mixed.select("token", "members", F.col("m.comp").alias("main"), (F.col("members") - F.col("m.c")).alias("others")).where("others > 0")


def postings(prefix: DataFrame, sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """A row (``POSTINGS``) per record and block, and in the second round, which has components, per tile of a large block.

    The first round only cuts large blocks into parts. In the second the records of the main component are not compared with
    each other: they and the other records are cut into parts of their own, and there is a tile for each two parts that are not
    both of the main component. A large block of versions with a few other records thus costs little more than one pass.
    """
    named = sets.select("rep", "sig", F.size("tokens").alias("n"))
    named = named.withColumn("comp", F.col("rep")) if comps is None else named.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rows = prefix.select("rep", "token").join(blocks(prefix, comps), "token").join(named.hint("merge"), "rep")
    parts = lambda n: F.ceil(n / F.lit(TILE_ROWS)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    if comps is None:
        return rows.withColumn("side", place(parts(F.col("members")))).select("token", F.col("side").alias("tile"), "side", "rep", "n", "sig", "comp")
    a, b, main = parts(F.col("others")), parts(F.col("members") - F.col("others")), F.col("comp") == F.col("main")
    rows = rows.withColumns({"a": a, "k": a + b}).withColumn("side", F.when(F.col("members") <= TILE_ROWS, 0).when(main, F.col("a") + place(b)).otherwise(place(a)))
    other = F.when(F.col("members") <= TILE_ROWS, F.array(F.lit(0))).when(main, F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    rows = rows.withColumn("other", F.explode(other)).withColumn("tile", F.least("side", "other") * F.col("k") + F.greatest("side", "other"))
    return rows.select("token", "tile", "side", "rep", "n", "sig", "comp")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables that end where a (token, tile) ends."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if table.num_rows:
            token, tile = table.column("token").to_numpy(), table.column("tile").to_numpy()
            last = np.flatnonzero((token != token[-1]) | (tile != tile[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield table.slice(0, end)
            rest = table.slice(end)
    if rest is not None and rest.num_rows:
        yield rest


def _leader_pairs(sigs: np.ndarray, limits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leader, row) of the near rows of each block: the first row leads, then the first that is near no leader so far."""
    left = np.ones(len(sigs), bool)
    rows = np.arange(len(sigs))
    for _ in range(LEADERS):
        open_ = rows[left[rows]]
        block = np.searchsorted(starts, open_, "right") - 1
        first = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(np.append(first, len(open_)))
        several = size > 1
        if not several.any():
            return
        keep = np.repeat(several, size)
        open_, size = open_[keep], size[several]
        begin = np.cumsum(size) - size
        a, b = close_to_leader(sigs[open_], limits[open_], begin, begin, size)
        yield open_[a], open_[b]
        left[:] = False
        left[open_] = True
        left[open_[begin]] = False
        left[open_[b]] = False


def _late(starts: np.ndarray, sizes: np.ndarray, comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The rows of each block that need not be compared with each other: of two sides the second, else the most frequent component."""
    block = np.repeat(np.arange(len(starts)), sizes)
    low, high = (f.reduceat(side, starts) for f in (np.minimum, np.maximum))
    order = np.lexsort((comp, block))
    new = np.flatnonzero((np.diff(block[order], prepend=-1) != 0) | (np.diff(comp[order], prepend=comp[order][:1]) != 0))
    count = np.diff(np.append(new, len(order)))
    most = np.lexsort((count, block[order][new]))
    last = most[np.append(np.flatnonzero(np.diff(block[order][new][most])), len(most) - 1)]
    main = comp[order][new][last]
    return np.where((low < high)[block], side > low[block], comp == main[block])


def candidates(posted: DataFrame, first_round: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the blocks: with the leaders only, or between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            token, tile, rep, comp, side = (table.column(c).to_numpy() for c in ("token", "tile", "rep", "comp", "side"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, 8)
            n = table.column("n").to_numpy().astype(np.int64)
            limits = reach(n)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(tile) != 0)) + 1])
            sizes = np.diff(np.append(starts, len(token)))
            if first_round:
                found = list(_leader_pairs(sigs, limits, starts, sizes))
                a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
                b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
                keep = np.ones(len(a), bool)
            else:
                # rows are sorted by side and component size, so those that are compared with all come first
                late = _late(starts, sizes, comp, side)
                order = np.lexsort((late, np.repeat(np.arange(len(starts)), sizes)))
                rep, comp, side, sigs, limits, n, late = (x[order] for x in (rep, comp, side, sigs, limits, n, late))
                heads = sizes - np.add.reduceat(late.astype(np.int64), starts)
                mixed = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)
                a, b = close_pairs(sigs, limits, starts[mixed], sizes[mixed], heads=heads[mixed])
                # a tile of two parts compares them with each other; the parts' own tiles do the rest
                twofold = np.minimum.reduceat(side, starts) < np.maximum.reduceat(side, starts)
                block = np.searchsorted(starts, a, "right") - 1
                keep = (comp[a] != comp[b]) & (~twofold[block] | (side[a] != side[b]))
            keep &= np.bitwise_count(sigs[a] ^ sigs[b]).sum(axis=1, dtype=np.int64) <= radius(n[a], n[b])
            pairs = np.unique(np.sort(np.stack([rep[a[keep]], rep[b[keep]]]), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

    return posted.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "rep").mapInArrow(run, PAIRS).distinct()


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share enough sequences."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    both = found.join(left, "a").join(right, "b")
    return both.where(shares_enough(F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb"))).select("a", "b")


def version_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between versions that join every group of versions; not every pair of a group has one. ``sets`` has rep, tokens and sig."""
    # the optimizer takes sets for much smaller than they are, from the records' compressed files, so they are never broadcast
    sets = sets.hint("merge")
    prefix = cut(prefixes(sets, "rep").select("rep", "token")).hint("merge")
    stars = cut(verified(candidates(postings(prefix, sets, None), True), sets))
    known = cut(components(stars).select(F.col("node").alias("rep"), F.col("root").alias("comp")))
    across = verified(candidates(postings(prefix, sets, known), False), sets)
    return stars.unionByName(across)


def version_groups(records: DataFrame, key: str = "record_id", text: str = "prompt") -> DataFrame:
    """(record_id, keep_id) of every record with a text; keep_id is the smallest record_id of its group of versions.

    Copies are versions. A text of fewer than three words has no sequences and only its copies as versions.
    Records without a key or text are left out; an empty table gives no rows; repeated rows with one record_id
    are one record if their texts are copies. Other columns of ``records`` play no part.
    """
    copies = cut(copy_groups(records, key, text))
    reps = copies.where("record_id = keep_id").select(F.col("record_id").alias("rep"), "copies").dropDuplicates(["rep"])
    texts = records.select(F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text")).where("text is not null").join(reps.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    sets = cut(sets_of(texts))
    roots = cut(components(version_links(sets)))
    labels = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(F.col("rep").alias("keep_id"), F.coalesce("root", "rep").alias("_root"), "copies")
    members = copies.select("record_id", "keep_id")
    return salted_join(members, labels.drop("copies"), "keep_id", "record_id", hot_keys(labels, "keep_id")).select("record_id", F.col("_root").alias("keep_id"))


def p3_found(records: DataFrame) -> DataFrame:
    """(keep_id, record_id), a row for each member of a group of versions other than the smallest."""
    return version_groups(records).where("record_id <> keep_id").select("keep_id", "record_id")


def p3_group_sizes(records: DataFrame) -> DataFrame:
    """(size, groups): how many groups of versions have so many records."""
    return version_groups(records).groupBy("keep_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
