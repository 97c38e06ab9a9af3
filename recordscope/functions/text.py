"""Text of prompts and model responses, as Column expressions and one Arrow UDF."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordscope.functions.coerce import strip


def render_prompt(prompt: Column, schema: Column) -> Column:
    """The prompt with every ``{schema}`` replaced."""
    return F.replace(prompt, F.lit("{schema}"), schema)


def extract_prompt_tag(text: Column) -> Column:
    """What stands in the first <PROMPT> tag, or the whole text, without outer blanks."""
    tag = r"(?s)<PROMPT>(.*?)</PROMPT>"
    return strip(F.when(text.rlike(tag), F.regexp_extract(text, tag, 1)).otherwise(text))


def truncate(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def top_key(key: Column) -> Column:
    """A field key's first member, without a document prefix ``doc::``."""
    return F.regexp_extract(F.substring_index(key, "::", -1), r"^[^.\[]*", 0)


def json_candidates(text: Column) -> list[Column]:
    """Where the JSON object of a response may stand: in a code fence, as the whole, between the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    start, end = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
    braces = F.when((start > 0) & (F.locate("}", text) > 0) & (end > start), text.substr(start, end - start + 1))
    return [F.when(fenced != "", fenced), strip(text), braces]


def parse_json(text: Column) -> Column:
    """The JSON text of the first candidate that parses, as a VARIANT; null if none does."""
    return F.coalesce(*(F.try_parse_json(c) for c in json_candidates(text)))


#: What matters to find the open brackets of JSON text: strings, also one that is never closed, and brackets.
JSON_SIGNS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
FENCE = re.compile(r"^```[a-zA-Z]*\s*(.*?)\s*(?:```)?$", re.S)


def repaired(raw: str) -> str:
    """JSON text without a trailing comma and with its open brackets closed; an open string is left open."""
    signs = [s for s in JSON_SIGNS.findall(raw) if s[0] != '"']
    open_ = 0
    # from the end, every bracket that no later one answers
    tail = []
    for s in reversed(signs):
        if s in "}]":
            open_ += 1
        elif open_:
            open_ -= 1
        else:
            tail.append({"{": "}", "[": "]"}[s])
    return raw.rstrip().rstrip(",") + "".join(tail)


def parse_lenient(text: str | None) -> str | None:
    """The JSON value of a response: fences stripped, also on one line, parsed, else repaired and parsed, else ``{}``."""
    if text is None:
        return None
    raw = text.strip()
    raw = FENCE.sub(r"\1", raw) if raw.startswith("```") else raw.removesuffix("```").strip()
    for candidate in (raw, repaired(raw)):
        try:
            return json.dumps(json.loads(candidate))
        except (ValueError, RecursionError):
            continue
    return "{}"


@F.pandas_udf(StringType())
def parse_lenient_udf(text: pd.Series) -> pd.Series:
    return text.map(parse_lenient)


def leaves(value: object, depth: int = 0) -> int:
    """Leaves of a JSON value: scalars and nulls, empty lists and objects count one, deeper than 20 levels too."""
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return sum(leaves(x, depth + 1) for x in inner) if inner and depth <= 20 else 1


def leaf_count(text: Column) -> Column:
    """Leaves of JSON text: scalars and nulls, and empty lists and objects; 0 for text that is missing or broken.

    Every leaf but the first has a comma before it that stands outside strings, so commas are counted. Members of
    one name make a record broken, and unlike in leaves() there is no bound on depth.
    """
    # possessive, since Java matches a choice in a loop by recursion, and a long string overflows the stack of the executor
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(",")))
    return F.when(F.try_parse_json(text).isNotNull(), commas + 1).otherwise(0).cast("bigint")


@F.pandas_udf(StringType())
def unified_diff_udf(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else "\n".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile=x, tofile=y, lineterm="")) for a, b, x, y in zip(old, new, old_name, new_name)], dtype="object")
