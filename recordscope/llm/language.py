"""Which of a few languages a text is in, by word counts learnt from labelled documents.

The counts are taken over all documents with Spark; the model keeps at most ``WORDS`` words per language,
so its size is bounded whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most frequent words kept per language.
WORDS = 2000
#: Words of a text that must be known, and the log odds per known word, before a language is named.
KNOWN, MARGIN = 4, 0.4

#: Words and what is written together with them; a plain word is at the beginning of such a run, and nothing or an apostrophe follows it.
RUN, PLAIN_WORD = re.compile(r"[\w'’-]+"), re.compile(r"[^\W\d_]+(?![\w-])")
#: Runs whose rows a task keeps.
KEPT = 50_000


def language_code(column: str) -> F.Column:
    """Language labels without case and region, so that ``EN-us`` is ``en``; empty labels are null."""
    code = F.regexp_extract(F.lower(F.trim(F.col(column))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def word_model(documents: DataFrame, text: str = "text", label: str = "lang") -> dict[str, dict[str, float]]:
    """word -> language -> log probability, for the words that tell the labelled documents' languages.

    Words written with a capital, with digits or with underscores are names or codes and don't count. Wrong labels of a
    few documents only flatten the counts.
    """
    labelled = documents.select(language_code(label).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    words = labelled.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_'’-])\p{Ll}+(?![\p{L}\p{N}_-])"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counts.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("_k") <= WORDS)
    rows = top.join(F.broadcast(total), "lang").select("lang", "word", "n", "total").collect()
    totals = {r["lang"]: r["total"] for r in rows}
    seen: dict[str, dict[str, int]] = {}
    for r in rows:
        seen.setdefault(r["word"], {})[r["lang"]] = r["n"]
    return {w: {g: math.log((by.get(g, 0) + 0.5) / (totals[g] + WORDS)) for g in totals} for w, by in seen.items()}


class _Rows(dict):
    """Run -> row of its plain word in the model's table, or -1. The rows of the first KEPT runs are kept."""

    def __init__(self, model: dict[str, dict[str, float]]):
        super().__init__()
        self.of = {w: i for i, w in enumerate(model)}

    def __missing__(self, run: str) -> int:
        row, m = -1, PLAIN_WORD.match(run)
        if m:
            w = m[0]
            row = self.of.get(w, -1)
            if row < 0 and len(w) > 1 and w.isupper():
                row = self.of.get(w.lower(), -1)
        if len(self) < KEPT:
            self[run] = row
        return row


def guess(model: dict[str, dict[str, float]]) -> Callable[[str], str | None]:
    """A function from text to its language, or to None where too little of it is known."""
    names = list(next(iter(model.values()), {}))
    table = np.array([[by[g] for g in names] for by in model.values()]).reshape(len(model), len(names))
    rows = _Rows(model)

    def language(text: str) -> str | None:
        runs = RUN.findall(text)
        found = list(map(rows.__getitem__, runs))
        for i, run in enumerate(runs):
            if m := PLAIN_WORD.match(run):  # the first word may have a capital
                found[i] = rows.of.get(m[0].lower(), -1)
                break
        found = [x for x in found if x >= 0]
        if len(found) < KNOWN:
            return None
        score = np.add.reduce(table[found], axis=0).tolist()  # row by row, in the order of the text
        order = sorted(range(len(names)), key=score.__getitem__, reverse=True)
        if len(order) > 1 and score[order[0]] - score[order[1]] < MARGIN * len(found):
            return None
        return names[order[0]]

    return language
