"""The call log: one row per call, costs, totals, and where a budget runs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordscope.operators.scan import running

#: Prices per million tokens of models without a row.
DEFAULT_INPUT, DEFAULT_OUTPUT = 0.10, 0.40


def latest_calls(calls: DataFrame, *columns: str) -> DataFrame:
    """Each call once, with ``columns`` of the row ingested last. Rows without call_id are left out."""
    return calls.where("call_id is not null").groupBy("call_id").agg(F.max_by(F.struct(*columns), F.struct(F.coalesce("ingested_at", F.lit(0).cast("timestamp")), *columns)).alias("c")).select("call_id", "c.*")


def model_name(col: str) -> Column:
    return F.lower(F.trim(F.col(col)))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with cost, from the price of their model (letter case ignored) or the default price."""
    table = prices.select(model_name("model").alias("_model"), "input_per_m", "output_per_m").dropDuplicates(["_model"])
    joined = calls.join(table, model_name("model") == F.col("_model"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(1e6)
    cost = n("input_tokens") * F.coalesce("input_per_m", F.lit(DEFAULT_INPUT)) + n("output_tokens") * F.coalesce("output_per_m", F.lit(DEFAULT_OUTPUT))
    return joined.withColumn("cost", cost).drop("_model", "input_per_m", "output_per_m")


def usage(priced_calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost (4 decimals), in all or per ``by``."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return priced_calls.groupBy(*by).agg(F.count("*").alias("calls"), s("input_tokens"), s("output_tokens"), s("total_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


def exhaustion(priced_calls: DataFrame, max_calls: int, max_tokens: int, max_cost: float, max_seconds: float) -> DataFrame:
    """(run_id, call_id, calls, tokens, reason): the first call of each run by which a limit is reached.

    Of several limits reached at once the first of calls, tokens, cost and time is the reason. Calls are in the order of
    logged_at, then call_id. Runs within their budget give no row.
    """
    rows = priced_calls.select("run_id", F.col("logged_at"), "call_id", "total_tokens", "cost", "latency_seconds")
    sums = running(rows, ["run_id"], ["logged_at", "call_id"], calls=("count", F.lit(1)), tokens=("sum", F.coalesce("total_tokens", F.lit(0))), spent=("sum", F.coalesce("cost", F.lit(0.0))), seconds=("sum", F.coalesce("latency_seconds", F.lit(0.0))))
    reason = F.when(F.col("calls") >= max_calls, "calls").when(F.col("tokens") >= max_tokens, "tokens").when(F.round("spent", 9) >= max_cost, "cost").when(F.round("seconds", 6) >= max_seconds, "time")
    return sums.withColumn("reason", reason).where("reason is not null").groupBy("run_id").agg(F.min(F.struct("calls", "call_id", "tokens", "reason")).alias("f")).select("run_id", "f.call_id", "f.calls", "f.tokens", "f.reason")


def snapshots(priced_calls: DataFrame) -> DataFrame:
    """(run_id, call_id, calls, tokens, cost, seconds): what each run has used after each call, cost with 6 and seconds with 2 decimals; order as in exhaustion()."""
    exact = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(28,12)")
    sums = running(priced_calls.select("run_id", "logged_at", "call_id", "total_tokens", "cost", "latency_seconds"), ["run_id"], ["logged_at", "call_id"], calls=("count", F.lit(1)), tokens=("sum", F.coalesce("total_tokens", F.lit(0))), spent=("sum", exact("cost")), seconds=("sum", exact("latency_seconds")))
    return sums.select("run_id", "call_id", "calls", "tokens", F.round("spent", 6).cast("double").alias("cost"), F.round("seconds", 2).cast("double").alias("seconds"))


def log_lines(calls: DataFrame) -> DataFrame:
    """(call_id, line): each call as a JSON line with nulls kept, costs with 6 and latencies with 3 decimals."""
    fields = ["logged_at", "call_type", "provider", "model", "input_tokens", "output_tokens", "total_tokens"]
    fixed = lambda c, n: F.round(c, n).cast(f"decimal(20,{n})")
    return calls.select("call_id", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c == "logged_at" else F.col(c) for c in fields), fixed("estimated_cost_usd", 6).alias("estimated_cost_usd"), fixed("latency_seconds", 3).alias("latency_seconds"), "success", F.col("error_text").alias("error")), {"ignoreNullFields": "false"}).alias("line"))


def append_log(calls: DataFrame, path: str) -> None:
    """Adds the calls' lines to the log, a folder of JSON lines. Each task writes a file of its own, so no call waits for another."""
    log_lines(calls).select("line").write.mode("append").text(path)


def logged_text(text: Column, most: int) -> Column:
    """As much of a text as the log keeps."""
    return F.left(text, F.lit(most))
