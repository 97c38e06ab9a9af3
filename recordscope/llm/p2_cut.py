"""Problem 2: text cut off by field limits, in the middle of a transfer or anywhere else.

Three sources of evidence, each of its own:

- limit: histograms of the lengths, in characters and in bytes, per source and column. A length that comes far more often than its
  neighbours is a limit, at the maximum of the source or, where a limit holds for a part of its calls, below. A value of that
  length that lacks terminal punctuation is cut, whatever its last line;
- structure: brackets, JSON strings, code fences and tags that are never closed, and running text without terminal punctuation;
- line: a short last line without terminal punctuation is a closing line, a list item or a short answer if a certain share of the
  collection's values end with it; else the value is cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordscope.session import cut

#: A length is a spike if at least SPIKE_LEAST values have it and SPIKE_TIMES as many as lengths in the SPIKE_SPAN around it on average.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_SPAN = 5, 8.0, 50
#: Lengths under SPIKE_PART * SPIKE_SPAN have neighbours within that part of themselves; a limit leaves so much of its values unfinished.
SPIKE_PART, SPIKE_UNFINISHED = 4, 0.5
#: A last line without terminal punctuation is whole if it makes up so much of all such lines; fewer than LEAST_ENDS show nothing.
KNOWN_SHARE, LEAST_ENDS = 0.001, 3
#: A limit is at the maximum of its source if no more than this share of the values are longer.
ABOVE_MAXIMUM = 0.01
#: Longer last lines are running text, which needs terminal punctuation.
UNIT_CHARS, UNIT_WORDS = 80, 8

INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
_EDGE = "".join(c for c in map(chr, range(0x10000)) if c.isspace() or re.match(f"[{INVISIBLE}]", c))
TERMINAL = re.compile(r"[.!?。！？…؟।]$")
CLOSERS = "\"'”’»«`*_)]}"
ELLIPSIS = re.compile(r"(?:\.\.+|…|\[\s*(?:…|\.\.\.|truncated|cut|continued)\s*\]|\ufffd)$", re.I)
BULLET = re.compile(r"^\s*(?:[-*+•>–]|\d+[.)])\s+")
BULLETS = frozenset("-*+•>–")
NUMBER = re.compile(r"^[-+]?\d+(?:[.,]\d+)*\s*%?$")
JSON_START = re.compile(r'\{(?=\s*(?:"|\}|$))|\[(?=\s*(?:["{\[\]\-\d]|$))')
TAG = re.compile(r"^<([A-Za-z][\w.-]*)[^<>]*>")


def trim(text: str) -> str:
    """``text`` without blanks and invisible characters at its ends."""
    return text.strip(_EDGE)


class _Decoder:
    """The JSON value that opens at a place of a text and where it ends; None if it is no JSON. The last one is kept, since the checks of one row ask for the same; don't change it."""

    def __init__(self):
        self.decode = json.JSONDecoder(strict=False).raw_decode
        self.asked, self.found = None, None

    def __reduce__(self):  # tasks begin with an empty one
        return _Decoder, ()

    def __call__(self, text: str, at: int) -> tuple[object, int] | None:
        if self.asked != (text, at):
            try:
                self.found = self.decode(text, at)
            except (ValueError, RecursionError):
                self.found = None
            self.asked = text, at
        return self.found


decoded = _Decoder()


def _balanced_end(text: str, at: int) -> int:
    """Where the JSON value that opens at ``at`` ends, or -1 if it never does. Values that are no JSON but balanced end too."""
    if (found := decoded(text, at)) is not None:
        return found[1]
    depth, quoted, i = 0, False, at
    for m in re.finditer(r'\\.|["{}\[\]]', text[at:], re.S):
        c = m[0]
        if quoted:
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                i = at + m.end()
                return i
    return -1


def ending(text: str | None) -> tuple[str, str]:
    """(state, unit) of a value: 'empty', 'whole', 'cut', or 'line' with the last line that decides."""
    s = trim(text or "")
    if not s:
        return "empty", ""
    s0 = s
    # a fence that is never closed, or closed halfway
    if "```" in s:
        if s.count("```") % 2:
            return "cut", ""
        head, _, tail = s.rpartition("```")
        tail = trim(tail)
        if not tail:
            body = head.rpartition("```")[2]
            body = trim(re.sub(r"^[\w+-]*[^\S\n]*\n", "", body))
            if body[:1] in ("{", "[") and _balanced_end(body, 0) < 0:
                return "cut", ""
            return "whole", ""
        s = tail
    elif s.startswith("``") or s.endswith("``"):
        return "cut", ""
    # a tag around the value
    m = TAG.match(s)
    if m:
        close = f"</{m[1]}>"
        at = s.rfind(close)
        if at < 0:
            return "cut", ""
        s = trim(s[at + len(close) :])
        if not s:
            return "whole", ""
    elif s[0] == "<" and re.match(r"^</?[A-Za-z][\w.-]*$", s):
        return "cut", ""
    # a JSON value, maybe after a line of text
    m = JSON_START.search(s)
    if m and (m.start() == 0 or s[m.start()] == "{" or s[: m.start()].rstrip()[-1:] in (".", ":")):
        end = _balanced_end(s, m.start())
        if end < 0:
            return "cut", ""
        s = trim(s[end:])
        if not s:
            return "whole", ""
    elif s[0] == '"' and s0 is s:
        # a lone JSON string
        if not re.match(r'^"(?:[^"\\]|\\.)*"', s, re.S):
            return "cut", ""
        if re.match(r'^"(?:[^"\\]|\\.)*"$', s, re.S):
            return "whole", ""
    if NUMBER.match(s):
        return "whole", ""
    if ELLIPSIS.search(s) or re.search(r"(?:^|\s)0\.$", s):
        return "cut", ""
    bare = s.rstrip(CLOSERS)
    if TERMINAL.search(bare) and not re.search(r"\w[({\[][^)}\]]*$", bare):
        return "whole", ""
    if s[-1] == ")" and (at := s.rfind("(")) >= 0 and (not s[:at].strip() or TERMINAL.search(s[:at].rstrip())):
        return "whole", ""
    line = s.rsplit("\n", 1)[-1]
    unit = BULLET.sub("", line).strip()
    if not unit or len(unit) > UNIT_CHARS or len(unit.split()) > UNIT_WORDS:
        return "cut", ""
    return "line", unit


def inner_items(text: str | None) -> list[str]:
    """List items of a value before its last line."""
    if not text or "\n" not in text:
        return []
    return [u for line in text.rstrip().split("\n")[:-1] if ((c := line.lstrip()[:1]) in BULLETS or c.isdecimal()) and (m := BULLET.match(line)) and 0 < len(u := line[m.end() :].strip()) <= UNIT_CHARS and len(u.split()) <= UNIT_WORDS]


def endings(calls: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, chars, bytes, state, unit, items) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [ending(t) for t in texts]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([inner_items(t) for t in texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "state", "unit", "items"])

    source = calls.select(*keep, F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.col(text).cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, "state string", "unit string", "items array<string>"]))


def source_name(col: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(col).cast("string"), F.lit("unknown"))))


def length_spikes(measured: DataFrame, source: list[str]) -> DataFrame:
    """(*source, measure, length, values, share) of the lengths that come far more often than their neighbours.

    ``measured`` has chars, bytes and whole (line_ends()); the histograms are per source. A spike is a limit only if most of its values
    show no end of their own, so an answer that is often repeated is none. Longer values don't count against it, since a limit may
    hold for a part of a source's calls; top is the share of the source's values that are no longer than the spike.
    """
    measured = measured.withColumn("unfinished", ~F.col("whole"))
    both = measured.where("chars > 0").select(*source, "unfinished", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")))).alias("m")).select(*source, "unfinished", "m.*")
    bars = both.groupBy(*source, "measure", "length").agg(F.count("*").alias("values"), F.avg(F.col("unfinished").cast("int")).alias("unfinished"))
    by = Window.partitionBy(*source, "measure")
    around = by.orderBy("length").rangeBetween(-SPIKE_SPAN, SPIKE_SPAN)
    up_to = by.orderBy("length").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    span = F.greatest(F.lit(1), F.least(F.lit(SPIKE_SPAN), F.floor(F.col("length") / SPIKE_PART)))
    close = F.filter("_around", lambda x: F.abs(x["length"] - F.col("length")) <= span)
    near = (F.aggregate(close, F.lit(0).cast("bigint"), lambda n, x: n + x["values"]) - F.col("values")) / (2.0 * span)
    marked = bars.withColumn("_around", F.collect_list(F.struct("length", "values")).over(around)).withColumn("near", near).withColumn("top", F.sum("values").over(up_to) / F.sum("values").over(by)).withColumn("share", F.col("values") / F.sum("values").over(by))
    return marked.where((F.col("values") >= SPIKE_LEAST) & (F.col("values") >= SPIKE_TIMES * F.greatest(F.col("near"), F.lit(0.25)))).where(F.col("unfinished") >= SPIKE_UNFINISHED).select(*source, "measure", "length", "values", "share", "top")


def line_ends(rows: DataFrame) -> DataFrame:
    """``rows`` of endings() with whole: whether the structure and the last line show a finished value."""
    # how often the collection has each line at an end, and as an earlier item of a list
    ends = rows.where("state = 'line'").groupBy("unit").agg(F.count("*").alias("ends"))
    inner = rows.select(F.explode("items").alias("unit")).groupBy("unit").agg(F.count("*").alias("inner"))
    lines = ends.join(inner, "unit", "full").select("unit", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("inner", F.lit(0)).alias("inner")).withColumn("n", F.col("ends") + F.col("inner"))
    lines = cut(lines)
    enough = max(LEAST_ENDS, KNOWN_SHARE * (lines.agg(F.sum("ends")).first()[0] or 0))
    # a line that is the beginning of a more frequent line was cut
    longer = lines.where(F.col("n") >= enough).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("unit") - 1, F.lit(1))), lambda i: F.substring("unit", 1, i))).alias("unit")).groupBy("unit").agg(F.max("n").alias("longer"))
    known = lines.where("ends > 0").join(longer, "unit", "left").select("unit", (((F.col("ends") >= enough) | (F.col("inner") >= 1)) & (F.col("n") >= F.coalesce("longer", F.lit(0)))).alias("whole"))
    lined = rows.where("state = 'line'").join(known, "unit", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return lined.unionByName(rows.where("state <> 'line'").withColumn("whole", F.col("state") != "cut"))


def decided(rows: DataFrame, source: list[str]) -> DataFrame:
    """``rows`` of endings() with at_spike and evidence: limit, structure or line for a value that is cut, else null."""
    ended = cut(line_ends(rows))
    spikes = length_spikes(ended, source).groupBy(*source).agg(F.collect_set(F.when(F.col("measure") == "chars", F.col("length"))).alias("_chars"), F.collect_set(F.when(F.col("measure") == "bytes", F.col("length"))).alias("_bytes"))
    at = F.coalesce(F.array_contains("_chars", F.col("chars")) | F.array_contains("_bytes", F.col("bytes")), F.lit(False))
    evidence = F.when(F.col("at_spike") & F.col("state").isin("cut", "line"), "limit").when(F.col("state") == "cut", "structure").when((F.col("state") == "line") & ~F.col("whole"), "line")
    return ended.join(spikes, source, "left").withColumn("at_spike", at).drop("_chars", "_bytes").withColumn("evidence", evidence)


def classified(calls: DataFrame, key: str = "call_id", text: str = "output", source: tuple[str, ...] = ("provider", "model", "call_type"), latest: str | None = "ingested_at") -> DataFrame:
    """(key, *source, chars, bytes, at_spike, evidence) of each value, each key once; evidence is null for a value that is not cut.

    Of rows with one key the latest counts (by ``latest``, then the longest value). Null and blank values are
    not cut. Rows with a null key are left out. Sources are compared without case and outer blanks; a null source
    is named 'unknown'. An empty table gives no rows. Extra columns play no part.
    """
    named = calls.where(F.col(key).isNotNull()).select(F.col(key), *(source_name(c).alias(c) for c in source), (F.col(latest) if latest else F.lit(None).cast("timestamp")).alias("_latest"), F.col(text).cast("string").alias(text))
    rows = endings(named, text, key, *source, "_latest").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("_latest"), F.desc("chars"), "state", "unit"))).where("_n = 1").drop("_n", "_latest")
    return decided(cut(rows), list(source[:2])).select(key, *source, "chars", "bytes", "at_spike", "evidence")


def p2_found(calls: DataFrame) -> DataFrame:
    """(call_id) of every call, each once, whose output breaks off."""
    return classified(calls).where("evidence is not null").select("call_id")


def p2_rates(calls: DataFrame, text: str = "output") -> DataFrame:
    """(provider, model, call_type, calls, cut, at_limit, cut_share): how often each source breaks off, and how often by a length limit."""
    rows = classified(calls, text=text).groupBy("provider", "model", "call_type").agg(F.count("*").alias("calls"), F.count("evidence").alias("cut"), F.count_if(F.col("evidence") == "limit").alias("at_limit"))
    return rows.withColumn("cut_share", F.round(F.col("cut") / F.col("calls"), 6))


def p2_prompt_rates(calls: DataFrame) -> DataFrame:
    """p2_rates() of the logged prompts."""
    return p2_rates(calls, "input_prompt")


def p2_limits(calls: DataFrame, columns: tuple[str, ...] = ("input_prompt", "output")) -> DataFrame:
    """(column, provider, model, measure, length, values, share, top, at_maximum): the length limits seen per column and source."""
    source = ["column", "provider", "model"]
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    named = calls.select(source_name("provider").alias("provider"), source_name("model").alias("model"), each)
    limits = length_spikes(cut(line_ends(cut(endings(named, "value", *source)))), source)
    return limits.select(*source, "measure", "length", "values", F.round("share", 6).alias("share"), F.round("top", 6).alias("top"), (F.col("top") >= 1 - ABOVE_MAXIMUM).alias("at_maximum"))
