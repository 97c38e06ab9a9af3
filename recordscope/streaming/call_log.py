"""The call log as a stream: calls written twice count once, usage per model and hour, late rows within a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordscope.operators.usage import model_name
from recordscope.session import ensure_checkpoint_dir


def hourly_usage(calls: DataFrame, lateness: str) -> DataFrame:
    """(hour, model, calls, tokens) of a stream of calls, each call_id once within the watermark."""
    timed = calls.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    once = timed.where("call_id is not null and logged_at is not null").withWatermark("logged_at", lateness).dropDuplicatesWithinWatermark(["call_id"])
    return once.groupBy(F.window("logged_at", "1 hour").alias("w"), model_name("model").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"))


def stream_calls(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New files of the call log as they come."""
    # as a pattern the path may be one file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_hourly(spark: SparkSession, path: str, lateness: str = "30 days") -> DataFrame:
    """Everything that the log holds now, as one run of the stream; the result is read from its sink.

    The state and the sink are in the shared checkpoint folder, so a lost executor or a restart goes on from the last batch.
    The lateness bounds the state: a call that comes later than that after newer ones were counted is dropped. One run reads all waiting files as one batch.
    """
    base = f"{ensure_checkpoint_dir(spark)}/hourly-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select("call_id", "logged_at", "model", "total_tokens").schema
    out = hourly_usage(stream_calls(spark, path, schema), lateness)

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("hour"), "model", "calls", "tokens").write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/table")
    return rows.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "model").agg(F.max_by("calls", "batch").alias("calls"), F.max_by("tokens", "batch").alias("tokens"))
