"""Optimal one-to-one assignment of predicted to gold items."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from recordscope.functions.metrics import text_ratio

ASSIGNED = "array<struct<pred_idx:int,gold_idx:int,sim:double,close:array<double>>>"
#: Values of members from this ratio on count as equal where items have no rules.
LIKE = 0.8


def solve(cost: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of least cost (rows <= columns), by shortest augmenting paths.

    Arrays of a record are short, so plain lists are faster here than vectors.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    # rows whose best columns all differ are assigned at once
    best = [min(range(m), key=row.__getitem__) for row in cost]
    if len(set(best)) == n:
        return best
    u, v, row_of = [0.0] * n, [0.0] * m, [-1] * m
    col_of = [-1] * n
    for row in range(n):
        least, came, open_cols = [float("inf")] * m, [-1] * m, list(range(m))
        done: list[int] = []
        i, delta = row, 0.0
        while True:
            c, ui = cost[i], u[i]
            j = -1
            for k in open_cols:
                step = delta + c[k] - ui - v[k]
                if step < least[k]:
                    least[k], came[k] = step, i
                if j < 0 or least[k] < least[j]:
                    j = k
            delta = least[j]
            open_cols.remove(j)
            if row_of[j] < 0:
                break
            done.append(j)
            i = row_of[j]
        u[row] += delta
        for k in done:
            u[row_of[k]] += delta - least[k]
            v[k] -= delta - least[k]
        while j >= 0:
            i = came[j]
            row_of[j], j, col_of[i] = i, col_of[i], j
            if i == row:
                break
    return col_of


def align(n_pred: int, n_gold: int, sims: Sequence[Sequence[float]]) -> list[tuple[int, int, float]]:
    """(pred, gold, similarity): all items of the shorter side matched for the greatest total, then the rest with -1.

    ``sims`` has a row per gold item and a column per predicted item.
    """
    turned = n_pred > n_gold
    if turned:
        cost = [[1.0 - x for x in row] for row in sims]
    else:
        cost = [[1.0 - sims[g][p] for g in range(n_gold)] for p in range(n_pred)]
    pairs = [(c, r) if turned else (r, c) for r, c in enumerate(solve(cost))] if n_pred and n_gold else []
    out = [(p, g, float(sims[g][p])) for p, g in sorted(pairs)]
    used_p, used_g = {p for p, _, _ in out}, {g for _, g, _ in out}
    return out + [(p, -1, 0.0) for p in range(n_pred) if p not in used_p] + [(-1, g, 0.0) for g in range(n_gold) if g not in used_g]


def likeness(p: str, g: str) -> float:
    """How alike two items without rules are: of objects the share of all their members that both have with a ratio of LIKE or more, else the ratio."""
    try:
        a, b = json.loads(p), json.loads(g)
    except (ValueError, RecursionError):
        a = b = None
    if not isinstance(a, dict) or not isinstance(b, dict):
        return text_ratio(p, g)
    keys = a.keys() | b.keys()
    said = lambda x: None if x is None else (x if isinstance(x, str) else json.dumps(x)).strip()
    alike = sum(1 for k in a.keys() & b.keys() for x, y in [(said(a[k]), said(b[k]))] if (x is None) == (y is None) and (x is None or text_ratio(x, y) >= LIKE))
    return alike / len(keys) if keys else 1.0


def _ratios(pred: Sequence[Sequence[str]], gold: Sequence[Sequence[str]], free: bool) -> list[list[list[float]]]:
    """By rule, gold item and predicted item, the ratio of the texts, or the likeness of items without rules."""
    compare = likeness if free else text_ratio
    return [[[1.0 if p is None and g is None else 0.0 if p is None or g is None else compare(p, g) for p in ps] for g in gs] for ps, gs in zip(pred, gold)]


def _similar(base: Sequence[Sequence[float]], ratios: Sequence[Sequence[Sequence[float]]], rules: int) -> list[list[float]]:
    """Mean over the rules: the sums of ``base``, and the ratios of the rules that need one."""
    return [[(x + sum(r[g][p] for r in ratios)) / rules for p, x in enumerate(row)] for g, row in enumerate(base)]


def assigned(rows: DataFrame, rules: int, free: bool = False) -> DataFrame:
    """``rows`` with pairs (``ASSIGNED``) in place of its last five columns base, pred, gold, n and m.

    ``base`` has, per gold and predicted item, the sum of the scores that need no Python; pred and gold have the texts of
    the items for each rule that compares by ratio, n and m the numbers of predicted and gold items. A pair's close has its
    ratio for each of those rules. ``free`` items have no rules and are compared as wholes.
    """
    kind = pa.list_(pa.struct([("pred_idx", pa.int32()), ("gold_idx", pa.int32()), ("sim", pa.float64()), ("close", pa.list_(pa.float64()))]))
    names = [f.name for f in rows.schema.fields[:-5]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-5]) + f", pairs {ASSIGNED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, b, p, g in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "base", "pred", "gold"))):
                ratios = _ratios(p, g, free)
                out.append([{"pred_idx": x, "gold_idx": y, "sim": sim, "close": [r[y][x] for r in ratios] if x >= 0 and y >= 0 else []} for x, y, sim in align(i, j, _similar(b, ratios, rules))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, kind)], [*names, "pairs"])

    return rows.mapInArrow(run, schema)
