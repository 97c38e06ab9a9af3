"""One form for prompts that differ only in layout.

Two prompts get the same form when they have the same letters and digits in the same order, after
punctuation, white space and letter case are ignored and the members of JSON objects and the adjacent
``name: description`` lines of a field list are brought into one order. The order of lists inside JSON
and of all other lines is kept.
"""

from __future__ import annotations

import json
import re

WORD = re.compile(r"[^\W_]+")
OBJECT = re.compile(r'\{(?=\s*["}])')
FIELD_LINE = re.compile(r"^[^\w\n]*(?:\d+[.)]\s+)?[*_`\"']*[^\W\d]\w*[*_`\"']*\s*:[*_`\"']*[^\S\n]+\S")
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
SCALAR = re.compile(r'[^\s,:{}\[\]"]+')
BLANK = re.compile(r"\s*")


class NotJson(ValueError):
    pass


def _string(raw: str) -> str:
    if "\\" not in raw:
        return raw
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw


def _value(text: str, at: int, depth: int) -> tuple[str, int]:
    """The form of the JSON value at ``at`` and where it ends; scalars keep their characters."""
    at = BLANK.match(text, at).end()
    c = text[at : at + 1]
    if c == '"':
        m = STRING.match(text, at)
        if not m:
            raise NotJson
        return canonical_text(_string(m[1])), m.end()
    if c in ("{", "["):
        if depth > 100:
            raise NotJson
        parts, close = [], "}" if c == "{" else "]"
        at = BLANK.match(text, at + 1).end()
        while text[at : at + 1] != close:
            if c == "{":
                m = STRING.match(text, at)
                if not m:
                    raise NotJson
                at = BLANK.match(text, m.end()).end()
                if text[at : at + 1] != ":":
                    raise NotJson
                inner, at = _value(text, at + 1, depth + 1)
                parts.append(f"{canonical_text(_string(m[1]))} {inner}".strip())
            else:
                inner, at = _value(text, at, depth + 1)
                parts.append(inner)
            at = BLANK.match(text, at).end()
            if text[at : at + 1] == ",":
                at = BLANK.match(text, at + 1).end()
            elif text[at : at + 1] != close:
                raise NotJson
        return " ".join(x for x in (sorted(parts) if c == "{" else parts) if x), at + 1
    m = SCALAR.match(text, at)
    if not m:
        raise NotJson
    return " ".join(WORD.findall(m[0].casefold())), m.end()


def _lines(text: str) -> list[str]:
    """Words of plain text, line by line, with runs of field lines in one order."""
    if ":" not in text or "\n" not in text:
        return [" ".join(WORD.findall(text.casefold()))]
    out: list[str] = []
    run: list[str] = []
    for line in text.splitlines():
        words = " ".join(WORD.findall(line.casefold()))
        if not words:
            continue
        if FIELD_LINE.match(line):
            run.append(words)
        else:
            out += sorted(run)
            run = []
            out.append(words)
    return out + sorted(run)


def canonical_text(text: str) -> str:
    """The form of ``text``: its words, lower case, one blank between them."""
    out: list[str] = []
    start = 0
    for m in OBJECT.finditer(text):
        if m.start() < start:
            continue
        try:
            form, end = _value(text, m.start(), 0)
        except NotJson:
            continue
        out += _lines(text[start : m.start()])
        out.append(form)
        start = end
    out += _lines(text[start:])
    return " ".join(x for x in out if x)
