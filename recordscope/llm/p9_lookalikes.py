"""Problem 9: visually identical text with different characters."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordscope.llm.visual import Model, pair_counts, pair_scores, visual_form
from recordscope.operators.skew import tiled_join
from recordscope.session import cut


def script_model(documents: DataFrame, text: str = "text") -> Model:
    """Letter-pair scores by script from all words of all documents.

    The pairs of each distinct word are counted in the tasks and summed exactly; the driver gets a row for each script and pair of
    letters that occur, so as many as the alphabets allow, whatever the number of words.
    """
    words = documents.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pair_counts((unicodedata.normalize("NFD", w), n) for w, n in zip(*(c.to_pylist() for c in batch.columns)))
            yield pa.RecordBatch.from_pylist([{"script": s, "a": a, "b": b, "n": n} for (s, a, b), n in pairs.items()], schema)

    schema = pa.schema([("script", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    counted = words.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(run, "script int, a string, b string, n bigint")
    sums = counted.groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    return pair_scores({(r["script"], r["a"], r["b"]): r["n"] for r in sums})


def forms(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, form, changed) of every document with a text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = visual_form(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [form(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([a != b for a, b in zip(texts, out)], pa.bool_())], ["doc_id", "form", "changed"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, form string, changed boolean")


def form_digests(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, form, raw): digests of the form and of the text itself."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def short(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = visual_form(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([short(form(t)) for t in texts], pa.binary()), pa.array([short(t) for t in texts], pa.binary())], ["doc_id", "form", "raw"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, form binary, raw binary")


def p9_found(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: all pairs of documents that read the same and are not the same string.

    Null texts read like nothing; an empty text reads like one of invisible characters only. Exact copies are no
    pair of each other but each pairs with every differing text. Forms of very many documents are joined in tiles. Rows that repeat a doc_id with one text count
    once. An empty table gives no rows; extra columns play no part.
    """
    rows = cut(form_digests(documents, script_model(documents)))
    # only forms that come with several texts take part in the join
    several = rows.groupBy("form").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b")).where("_a <> _b").select("form")
    rows = cut(rows.join(several, "form", "left_semi").distinct())
    a = rows.select("form", F.col("raw").alias("ra"), F.col("doc_id").alias("doc_id_a"))
    b = rows.select("form", F.col("raw").alias("rb"), F.col("doc_id").alias("doc_id_b"))
    return tiled_join(a, b, "form", "doc_id_a", "doc_id_b").where("ra <> rb and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def p9_forms(documents: DataFrame) -> DataFrame:
    """(doc_id, form, changed): the one form of every text."""
    return forms(documents, script_model(documents))
