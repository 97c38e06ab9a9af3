"""Content-addressed keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def prompt_hash(prompt: Column) -> Column:
    return F.left(F.sha2(prompt, 256), F.lit(16))


def extraction_key(path: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("||"), prompt), 256)


@F.pandas_udf(StringType())
def _canonical_json(metric: pd.Series, predicted: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([json.dumps({"g": g, "m": m, "p": p}, sort_keys=True) for m, p, g in zip(metric, predicted, gold)], dtype="object")


def metric_key(metric: Column, predicted: Column, gold: Column) -> Column:
    """SHA-256 of the canonical JSON (sorted members, ASCII escapes) of a metric call; nulls are JSON nulls."""
    return F.sha2(_canonical_json(metric, predicted, gold), 256)
