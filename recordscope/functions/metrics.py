"""Field metrics: (predicted, gold) -> score in [0, 1], as Column expressions.

Both values missing score 1, one missing 0; a value that can't be coerced counts as missing. Only the text ratio needs
Python; it runs in Arrow batches, over distinct pairs where the caller has any.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recordscope.functions.coerce import strip, to_bool, to_float, to_int

TOLERANCE = 0.001
#: A ratio passes from here on; all other metrics need the full score, arrays half of it.
PASS_CLOSE, PASS_EXACT, PASS_ARRAY = 0.8, 1.0, 0.5
CLOSE = ("string_fuzzy", "string_semantic")
NUMERIC = ("integer_exact", "number_tolerance", "number_exact")


def _both(p: Column, g: Column, equal: Column) -> Column:
    return F.when(p.isNull() & g.isNull(), F.lit(1.0)).when(p.isNull() | g.isNull(), F.lit(0.0)).otherwise(equal.cast("double"))


def string_exact(p: Column, g: Column, **_: object) -> Column:
    return _both(strip(p), strip(g), strip(p) == strip(g))


def string_case_insensitive(p: Column, g: Column, **_: object) -> Column:
    return _both(p, g, F.lower(strip(p)) == F.lower(strip(g)))


def integer_exact(p: Column, g: Column, **_: object) -> Column:
    return _both(to_int(p), to_int(g), to_int(p) == to_int(g))


def number_tolerance(p: Column, g: Column, tolerance: float = TOLERANCE, **_: object) -> Column:
    """Relative error within the tolerance; an error that is no number is not within it."""
    a, b = to_float(p), to_float(g)
    error = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9))
    return _both(a, b, ~F.isnan(error) & (error <= F.lit(float(tolerance))))


def number_exact(p: Column, g: Column, **_: object) -> Column:
    """Equal numbers; NaN equals nothing."""
    a, b = to_float(p), to_float(g)
    return _both(a, b, (a == b) & ~F.isnan(a))


def boolean_exact(p: Column, g: Column, **_: object) -> Column:
    return _both(to_bool(p), to_bool(g), to_bool(p) == to_bool(g))


def text_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters (Ratcliff and Obershelp), from a to b."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio_udf(p: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else text_ratio(a, b) for a, b in zip(p, g)], dtype="float64")


def string_fuzzy(p: Column, g: Column, **_: object) -> Column:
    a, b = strip(p), strip(g)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(ratio_udf(a, b))


def string_semantic(p: Column, g: Column, judge: Callable[[Column, Column], Column] | None = None, **_: object) -> Column:
    """Equal texts score 1; others what the judge says, clamped to [0, 1], or the ratio without a judge."""
    a, b = strip(p), strip(g)
    told = ratio_udf(a, b) if judge is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), judge(a, b)))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(told)


def _normal(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.lower(strip(F.coalesce(x.cast("string"), F.lit("none")))))


def set_overlap(p: Column, g: Column) -> Column:
    """Elements in common, each as often as in both, over the gold elements; letter case and outer blanks are ignored."""
    a, b = _normal(F.coalesce(p, F.array())), _normal(F.coalesce(g, F.array()))
    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return common.cast("double") / F.greatest(F.size(b), F.lit(1))


def array_llm(p: Column, g: Column, judge: Callable[[Column, Column], Column] | None = None, **_: object) -> Column:
    """Arrays as a whole: both empty 1, one empty 0, else the judge's score or the overlap of the elements. A missing array is empty."""
    n, m = F.size(F.coalesce(p, F.array())), F.size(F.coalesce(g, F.array()))
    told = set_overlap(p, g) if judge is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), judge(p, g)))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(told)


METRICS: dict[str, Callable[..., Column]] = {
    "string_exact": string_exact,
    "string_semantic": string_semantic,
    "string_fuzzy": string_fuzzy,
    "string_case_insensitive": string_case_insensitive,
    "integer_exact": integer_exact,
    "number_tolerance": number_tolerance,
    "number_exact": number_exact,
    "boolean_exact": boolean_exact,
    "array_llm": array_llm,
}


def score(metric: str, p: Column, g: Column, **params: object) -> Column:
    """The metric's score; an unknown metric scores 0."""
    return METRICS[metric](p, g, **params) if metric in METRICS else F.lit(0.0)


def items_of(text: Column) -> Column:
    """A JSON list as JSON text per item; anything but a list is empty."""
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def prepared(metric: str, p: Column, g: Column, a: Column, b: Column, ratio: Column | None = None, limit: Column | None = None) -> Column:
    """The metric's score from stripped texts p and g, their numbers a and b and, where it needs one, their ratio."""
    if metric in CLOSE:
        return _both(p, g, F.when(p == g, F.lit(1.0)).otherwise(ratio))
    if metric == "string_exact":
        return _both(p, g, p == g)
    if metric == "string_case_insensitive":
        return _both(p, g, F.lower(p) == F.lower(g))
    if metric == "integer_exact":
        x, y = (F.when(~F.isnan(n) & (F.abs(n) < F.lit(9.2e18)), n.try_cast("bigint")) for n in (a, b))
        return _both(x, y, x == y)
    if metric == "number_tolerance":
        error = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9))
        return _both(a, b, ~F.isnan(error) & (error <= (F.lit(TOLERANCE) if limit is None else limit)))
    if metric == "number_exact":
        return _both(a, b, (a == b) & ~F.isnan(a))
    if metric == "boolean_exact":
        return boolean_exact(p, g)
    if metric == "array_llm":
        return array_llm(items_of(p), items_of(g))
    return F.lit(0.0)


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _truth(c: Column) -> Column:
    return F.when(to_bool(c), "True").otherwise("False")


def reason(metric: str, p: Column, g: Column, a: Column, b: Column, told: Column, limit: Column | None = None) -> Column:
    """In words, why the metric gave the score ``told``, from what prepared() takes.

    Fixed values: the wording, which readers of the results search for. Texts stand in single quotes, a missing one is None.
    """
    text = lambda x: _quoted(x)
    both, one = p.isNull() & g.isNull(), p.isNull() | g.isNull()
    null = F.concat(F.lit("Null mismatch: pred="), text(p), F.lit(", gold="), text(g))
    kind = F.concat(F.lit("Null/type mismatch: pred="), text(p), F.lit(", gold="), text(g))
    versus = lambda what, x, y: F.concat(F.lit(what), x, F.lit(" != "), y)
    full = told == 1.0
    if metric == "string_exact":
        out = F.when(full, "Exact match").otherwise(versus("Mismatch: ", text(p), text(g)))
    elif metric == "string_case_insensitive":
        out = F.when(full, "Case-insensitive match").otherwise(versus("Mismatch (ci): ", text(p), text(g)))
    elif metric in CLOSE:
        ratio = F.format_string("Fuzzy ratio=%.3f", told)
        out = F.when(p == g, "Exact match (semantic shortcut)").otherwise(ratio) if metric == "string_semantic" else ratio
    elif metric == "array_llm":
        n, m = F.size(items_of(p)), F.size(items_of(g))
        count = lambda what, k: F.concat(F.lit(what), k.cast("string"), F.lit(" items"))
        return F.when((n == 0) & (m == 0), "Both empty arrays").when(m == 0, count("Gold is empty but predicted has ", n)).when(n == 0, count("Predicted is empty but gold has ", m)).otherwise(F.format_string("Set overlap=%.3f", told))
    elif metric in ("integer_exact", "number_exact", "number_tolerance", "boolean_exact"):
        if metric == "integer_exact":
            x, y = (_shown(n.try_cast("bigint")) for n in (a, b))
            said = F.when(full, F.concat(F.lit("Exact integer match: "), x)).otherwise(versus("Integer mismatch: ", x, y))
        elif metric == "number_exact":
            said = F.when(full, F.concat(F.lit("Exact number match: "), _shown(a))).otherwise(versus("Number mismatch: ", _shown(a), _shown(b)))
        elif metric == "boolean_exact":
            said = F.when(full, F.concat(F.lit("Boolean match: "), _truth(p))).otherwise(versus("Boolean mismatch: ", _truth(p), _truth(g)))
        else:
            most = F.lit(TOLERANCE) if limit is None else limit
            error = F.format_string("%.6f", F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)))
            said = F.when(full, F.concat(F.lit("Within tolerance: err="), error, F.lit(" <= "), most.cast("string"))).otherwise(F.concat(F.lit("Outside tolerance: err="), error, F.lit(" > "), most.cast("string")))
        x, y = (to_bool(p), to_bool(g)) if metric == "boolean_exact" else (a, b)
        # two values that are no numbers count as missing
        return F.when(x.isNull() & y.isNull(), "Both null").when(x.isNull() | y.isNull(), kind).otherwise(said)
    else:
        return F.lit(f"Unknown metric: {metric}")
    return F.when(both, "Both null").when(one, null).otherwise(out)


def dispatch(rows: DataFrame, metric: str, predicted: str, gold: str, tolerance: str | None = None, only: set[str] | None = None, reasons: bool = False) -> DataFrame:
    """``rows`` with a column score, and reason if asked for: the metric that each row names, of its two text values; unknown metrics score 0.

    Coercions are columns of their own, so each is computed once a row, and the ratio only sees the rows that need it.
    ``only`` names the metrics that can occur, where the caller knows them; without ratio metrics no Python runs.
    """
    names = [n for n in METRICS if only is None or n in only]
    m, p, g = F.col(metric), F.col("_p"), F.col("_g")
    ready = rows.withColumns({"_p": strip(F.col(predicted)), "_g": strip(F.col(gold))}).withColumns({"_fp": to_float(p), "_fg": to_float(g)})
    ratio = None
    if any(n in CLOSE for n in names):
        needs = m.isin(*CLOSE) & (p != g)
        ready, ratio = ready.withColumn("_ratio", ratio_udf(F.when(needs, p), F.when(needs, g))), F.col("_ratio")
    limit = None if tolerance is None else F.coalesce(F.col(tolerance), F.lit(TOLERANCE))
    told = F.lit(0.0)
    for n in names:
        told = F.when(m == n, prepared(n, p, g, F.col("_fp"), F.col("_fg"), ratio, limit)).otherwise(told)
    ready = ready.withColumn("score", told)
    if reasons:
        why = F.concat(F.lit("Unknown metric: "), F.coalesce(m, F.lit("None")))
        for n in names:
            why = F.when(m == n, reason(n, p, g, F.col("_fp"), F.col("_fg"), F.col("score"), limit)).otherwise(why)
        ready = ready.withColumn("reason", why)
    return ready.drop("_p", "_g", "_fp", "_fg", "_ratio")


def pass_threshold(metric: Column) -> Column:
    return F.when(metric.isin(*CLOSE), F.lit(PASS_CLOSE)).when(metric == "array_avg", F.lit(PASS_ARRAY)).otherwise(F.lit(PASS_EXACT))
