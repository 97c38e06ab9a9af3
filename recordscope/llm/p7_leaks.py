"""Problem 7: evaluation passages leaking into documents.

Each passage has an error budget of k edits and is split into k + 1 pieces, so that a leak with at most k edits leaves a
piece whole (pigeonhole). A piece has at most half of ``RUN`` words, so every run of RUN words of the passage holds a whole piece too. Documents
are searched for exact pieces by rolling hashes. Each hit is verified at its place by Myers' bit-parallel distance over words: a
document leaks a passage if the whole passage is there with at most k edits, or RUN of its words in a row without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordscope.llm.visual import visual_form
from recordscope.operators.skew import tiled_join
from recordscope.session import cut

#: Consecutive words of a passage that make a leak; words of a passage for each piece, which makes the budget one edit in PIECE words.
RUN, PIECE = 12, 5
#: Up to so many pieces the held-out set is sent to every task (about 20 MB at most); beyond it is joined by shuffle, with the same result.
BROADCAST_PIECES = 100_000

WORD = re.compile(r"[^\W_]+")
HITS = "doc_id bigint, item_id bigint, run int, part_edits int, edits int, budget int, words int"
#: Multipliers of the words of a piece.
WEIGHTS = np.random.default_rng(7).integers(1, 2**63, RUN, dtype=np.uint64) | np.uint64(1)


def words_of(form, text: str) -> list[str]:
    return WORD.findall(form(text).casefold())


def myers(pattern: list[str], text: list[str], enough: int | None = None) -> tuple[int, int]:
    """(least edits, end) of the best place of the whole pattern in the text: Myers' bit vectors over words, of any width.

    ``enough`` edits or more are of no interest: a text with too few of the pattern's words for less is not searched.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    held = [peq.get(w, 0) for w in text]
    full, top = (1 << m) - 1, 1 << (m - 1)
    if enough is not None and m - sum(1 for x in held if x) >= enough:
        return enough, 0
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, eq in enumerate(held):
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # free start: the row above the pattern stays 0
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def common_run(passage: list[str], text: list[str], at: int, pos: int, size: int) -> tuple[int, int]:
    """Words in common, consecutive in both, before and from a hit of ``size`` words at passage[at] and text[pos] on."""
    left = 0
    while left < min(at, pos) and passage[at - left - 1] == text[pos - left - 1]:
        left += 1
    right = size
    while at + right < len(passage) and pos + right < len(text) and passage[at + right] == text[pos + right]:
        right += 1
    return left, right


def pieces(words: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a passage of so many words: budget + 1 of them, as even as can be; none if it is shorter than PIECE."""
    if words < PIECE:
        return []
    n = max(words // PIECE, -(-words // (RUN // 2)))
    ends = [words * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def verify(passage: list[str], text: list[str], hits: Iterable[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(run, part_edits, edits) of the passage at its hits (at, size, pos), the best of each.

    run counts the words in common around a hit, part_edits the least edits of RUN words of the passage that hold the piece,
    edits the least edits of the whole passage within a window as wide as the passage on both sides.
    """
    run, part, edits = 0, RUN, len(passage)
    looked: dict[int, int] = {}
    for at, size, pos in sorted(hits, key=lambda h: h[2]):
        # a piece inside a run that was looked at already gives nothing new
        if looked.get(pos - at, -1) >= pos + size or text[pos : pos + size] != passage[at : at + size]:
            continue
        left, right = common_run(passage, text, at, pos, size)
        looked[pos - at] = pos + right
        run = max(run, left + right)
        first, last = max(0, at + size - RUN), min(at, len(passage) - RUN)
        if part and first <= last:
            near = text[max(0, pos - RUN) : pos + size + RUN]
            part = min(part, *(myers(passage[start : start + RUN], near, part)[0] for start in range(first, last + 1)))
        if edits:
            edits = min(edits, myers(passage, text[max(0, pos - at - len(passage)) : pos - at + 2 * len(passage)], edits)[0])
    return run, part, edits


class Windows:
    """Hashes of the windows of words of texts, by size of the window."""

    def __init__(self, sizes: Iterable[int]):
        self.sizes, self.form, self.known = sorted(sizes), visual_form(), {}

    def words(self, text: str) -> list[str]:
        return words_of(self.form, text)

    def hashed(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        return np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)

    def of(self, hashed: np.ndarray, size: int) -> np.ndarray:
        """A hash for every window of ``size`` words, by its first word."""
        n = len(hashed) - size + 1
        out = np.full(max(0, n), size, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size if n > 0 else 0):
                out += hashed[i : i + n] * WEIGHTS[i]
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    types = [pa.int64(), pa.int64()] + [pa.int32()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in HITS.split(", ")])


def _verified(found: DataFrame) -> DataFrame:
    """The best of each document and item that is a leak by either measure."""
    best = found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("part_edits").alias("part_edits"), F.min("edits").alias("edits"), F.max("budget").alias("budget"), F.max("words").alias("words"))
    return best.where("part_edits = 0 or edits <= budget")


def leaks(documents: DataFrame, items: DataFrame, broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """(doc_id, item_id, run, part_edits, edits, budget, words) of every document that leaks an item.

    run is the longest run of words in common at a hit, part_edits the least edits (words) of RUN words of the passage there, edits
    those that turn the whole passage into a part of the document near a hit, budget the edits that the passage may have, words
    its length. Words are compared without case, white space, punctuation and look-alike characters. Items shorter
    than PIECE words can't leak; null texts and passages have no words; rows with a null key are left out; an item_id or doc_id that recurs
    keeps each of its texts, and the best counts. Empty tables give no rows; extra columns play no part.
    """
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    held = items.select(F.col("item_id").cast("bigint"), F.col("passage").cast("string")).where("item_id is not null and passage is not null").distinct()
    # characters bound the number of pieces, so the table is measured before anything of it is collected
    size = held.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0] / (2 * PIECE)
    if size > broadcast_pieces:
        return _leaks_by_shuffle(docs, held)
    own = Windows(())
    passages, places = [], {}
    for r in held.orderBy("item_id", "passage").collect():
        words = own.words(r["passage"])
        hashed = own.hashed(words)
        for at, size in pieces(len(words)):
            places.setdefault((size, int(own.of(hashed[at : at + size], size)[0])), []).append((len(passages), at))
        passages.append((r["item_id"], words))
    shared = documents.sparkSession.sparkContext.broadcast((passages, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at_piece = shared.value
        windows = Windows({s for s, _ in at_piece})
        keys = {s: np.array(sorted(h for t, h in at_piece if t == s), np.int64) for s in windows.sizes}
        for batch in batches:
            rows = []
            # the words of many documents are searched at once
            for lo in range(0, batch.num_rows, 512):
                docs, texts = (batch.column(c).slice(lo, 512).to_pylist() for c in (0, 1))
                words = [windows.words(t) for t in texts]
                ends = np.cumsum([len(w) for w in words])
                hashed = windows.hashed([w for of_one in words for w in of_one])
                hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for s in windows.sizes:
                    w = windows.of(hashed, s)
                    near = np.searchsorted(keys[s], w)
                    found = np.flatnonzero(keys[s][np.minimum(near, len(keys[s]) - 1)] == w)
                    doc = np.searchsorted(ends, found, "right")
                    inside = found + s <= ends[doc]
                    for d, pos, h in zip(doc[inside].tolist(), found[inside].tolist(), w[found[inside]].tolist()):
                        for item, at in at_piece[s, h]:
                            hits.setdefault((d, item), []).append((at, s, pos - int(ends[d]) + len(words[d])))
                for (d, item), where in hits.items():
                    item_id, passage = known[item]
                    rows.append((docs[d], item_id, *verify(passage, words[d], where), len(pieces(len(passage))) - 1, len(passage)))
            yield _batch(rows)

    return _verified(docs.mapInArrow(run, HITS))


def _leaks_by_shuffle(docs: DataFrame, held: DataFrame) -> DataFrame:
    """The same for a held-out set of any size: hashes of pieces and of the documents' windows meet by shuffle, without any text.

    Only the documents and passages with a hit are then joined by their keys, and each pair is verified on its whole text.
    """
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    held = held.withColumn("item_key", F.xxhash64("item_id", "passage"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(())
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashed = windows.hashed(windows.words(text))
                rows += [(key, int(windows.of(hashed[at : at + size], size)[0]), at, size) for at, size in pieces(len(hashed))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["item_key", "piece", "at", "size"])

    known = cut(held.select("item_key", "passage").mapInArrow(split, "item_key bigint, piece bigint, at int, size int"))
    sizes = [r[0] for r in known.select("size").distinct().collect()]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sizes)
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashed = windows.hashed(windows.words(text))
                for s in windows.sizes:
                    w = windows.of(hashed, s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), key), pa.int64()), pa.array(w, pa.int64()), pa.array(np.arange(len(w)), pa.int32())], ["doc_key", "piece", "pos"])

    slid = docs.select("doc_key", "text").mapInArrow(slide, "doc_key bigint, piece bigint, pos int")
    met = cut(slid.join(known.select("piece").distinct(), "piece", "left_semi"))
    hits = tiled_join(met, known, "piece", "doc_key", "item_key").groupBy("doc_key", "item_key").agg(F.collect_set(F.struct("at", "size", "pos")).alias("hits"))
    pairs = hits.join(docs, "doc_key").join(held, "item_key").select("doc_id", "item_id", "text", "passage", "hits")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(())
        for batch in batches:
            rows = []
            for doc, item, text, passage, where in zip(*(c.to_pylist() for c in batch.columns)):
                words = windows.words(passage)
                rows.append((doc, item, *verify(words, windows.words(text), [(h["at"], h["size"], h["pos"]) for h in where]), len(pieces(len(words))) - 1, len(words)))
            yield _batch(rows)

    return _verified(pairs.mapInArrow(check, HITS))


def p7_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document has at least RUN consecutive words of the item's passage."""
    return leaks(documents, items).where("part_edits = 0").select("doc_id", "item_id")


def p7_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents, parts, whole, edited, longest_run, least_edits) per item that leaked.

    parts counts the documents with RUN of its words in a row, whole those with all of it, edited those with all of it within its budget of edits.
    """
    found = leaks(documents, items)
    n = lambda c: F.count_if(F.expr(c))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), n("part_edits = 0").alias("parts"), n("edits = 0").alias("whole"), n("edits > 0 and edits <= budget").alias("edited"), F.max("run").alias("longest_run"), F.min("edits").alias("least_edits"))
