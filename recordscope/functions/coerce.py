"""Coercion of values as Column expressions: text, integer, float and boolean out of any text value.

A value that can't be coerced is null, as a missing value is. ANSI mode never raises here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that are stripped at both ends of a text.
BLANKS = "\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
NAN = r"(?i)^[+-]?nan$"
#: Texts that stand for true and false.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def strip(c: Column) -> Column:
    """Text without blanks at its ends, of any kind and not only U+0020."""
    return F.regexp_replace(c.cast("string"), f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def to_float(c: Column, stripped: bool = False) -> Column:
    """The number a text writes, with ``_`` between digits allowed; null for other texts. ``stripped`` texts have no blanks at their ends."""
    s = c if stripped else strip(c)
    return F.when(s.rlike(NAN), F.lit(float("nan"))).when(s.rlike(FLOAT), F.regexp_replace(s, "_", "").try_cast("double"))


def to_int(c: Column) -> Column:
    """The number cut to an integer; null for texts that are none and for numbers without an integer value."""
    x = to_float(c)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(9.2e18)), x.try_cast("bigint"))


def to_bool(c: Column) -> Column:
    """true, 1, yes and false, 0, no in any letter case; null for other texts."""
    s = F.lower(strip(c))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def float_pattern() -> re.Pattern:
    """The same pattern for tests against Python's own conversion."""
    return re.compile(FLOAT)
