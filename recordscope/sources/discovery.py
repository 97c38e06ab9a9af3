"""Finding records on disk and dividing them into splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordscope.operators.scan import running

GOLD, PDF = ".gold.json", ".pdf"
RATIOS = (0.7, 0.15, 0.15)
#: The members of a saved run.
RECORD = "iteration int, prompt string, validation_score double, test_score double, accepted boolean, reason string, timestamp string, prompt_hash string, field_scores_summary map<string,double>"
STATE = f"run_id string, schema_name string, seed_prompt string, current_best_prompt string, current_best_score double, current_iteration int, status string, budget_used map<string,double>, prompt_history array<struct<{', '.join(x.replace(' ', ': ', 1) for x in RECORD.split(', '))}>>, test_score_seed double, test_score_final double, created_at string, updated_at string"


def listing(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    """(path) of the files with a suffix in a directory; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory).select("path")


def stem(path: Column, suffix: str) -> Column:
    """The path without directories and suffix."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix)))


def with_pdf(gold: DataFrame, pdf: DataFrame) -> DataFrame:
    """(doc, gold_path) of the gold files that have a PDF of the same name; each name once, the first path."""
    names = pdf.select(stem(F.col("path"), PDF).alias("doc")).where("doc is not null")
    return gold.select(stem(F.col("path"), GOLD).alias("doc"), F.col("path").alias("gold_path")).where("doc is not null").join(names, "doc", "left_semi").groupBy("doc").agg(F.min("gold_path").alias("gold_path"))


def read_records(spark: SparkSession, directory: str) -> DataFrame:
    """(doc, gold_path, gold_data) of a directory of ``*.gold.json`` files with their PDFs."""
    found = with_pdf(listing(spark, directory, GOLD), listing(spark, directory, PDF))
    texts = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", f"*{GOLD}").load(directory).select(F.col("_metadata.file_path").alias("gold_path"), F.col("value").alias("gold_data"))
    return found.join(texts, "gold_path").select("doc", "gold_path", "gold_data")


def read_pdfs(spark: SparkSession, directory: str) -> DataFrame:
    """(doc, pdf_path, content) of the PDFs of a directory that have a gold file; the bytes are read by the tasks that use them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{PDF}").load(directory).select("path", "content")
    gold = listing(spark, directory, GOLD).select(stem(F.col("path"), GOLD).alias("doc")).where("doc is not null").distinct()
    return files.select(stem(F.col("path"), PDF).alias("doc"), F.col("path").alias("pdf_path"), "content").where("doc is not null").join(gold, "doc", "left_semi")


def run_dir(base: str, schema_name: Column, run_id: Column) -> Column:
    """The folder of a run: base, schema name with ``_`` for ``/``, run."""
    return F.concat_ws("/", F.lit(base), F.replace(schema_name, F.lit("/"), F.lit("_")), run_id)


def read_states(spark: SparkSession, directory: str) -> DataFrame:
    """(path, state columns) of the ``run_state.json`` of every run folder of a directory; broken files have null columns."""
    return spark.read.schema(STATE).option("multiLine", "true").option("pathGlobFilter", "run_state.json").option("recursiveFileLookup", "true").json(directory).select(F.col("_metadata.file_path").alias("path"), "*")


def resumable(states: DataFrame) -> DataFrame:
    """The state of the first run by path that is not completed, none if all are; broken states are passed over."""
    return states.where("status is not null and status <> 'completed'").orderBy("path").limit(1)


def split_summary(splits: DataFrame, by: str = "schema_name", split: str = "split") -> DataFrame:
    """(schema_name, summary): the sizes of the splits of each schema, in a line."""
    n = lambda s: F.count_if(F.col(split) == s)
    sizes = splits.groupBy(by).agg(n("train").alias("a"), n("val").alias("b"), n("test").alias("c"))
    return sizes.select(by, F.format_string("Schema: %s | Train: %d | Val: %d | Test: %d | Total: %d", by, "a", "b", "c", F.col("a") + F.col("b") + F.col("c")).alias("summary"))


def split_sizes(counts: DataFrame, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """``counts`` (schema_name, n) with n_train, n_val, n_test.

    Validation and test are rounded half to even and have one record at least; training has the rest, also one at
    least. Fewer than three records are all for training.
    """
    val, test = (F.greatest(F.lit(1), F.bround(F.col("n") * r).cast("int")) for r in ratios[1:])
    sized = counts.withColumn("n_val", F.when(F.col("n") < 3, 0).otherwise(val)).withColumn("n_test", F.when(F.col("n") < 3, 0).otherwise(test))
    over = F.greatest(F.lit(0), F.col("n_val") + F.col("n_test") + 1 - F.col("n"))
    sized = sized.withColumn("n_test", F.when(F.col("n") < 3, 0).otherwise(F.greatest(F.lit(1), F.col("n_test") - over)))
    over = F.greatest(F.lit(0), F.col("n_val") + F.col("n_test") + 1 - F.col("n"))
    sized = sized.withColumn("n_val", F.when(F.col("n") < 3, 0).otherwise(F.greatest(F.lit(1), F.col("n_val") - over)))
    return sized.withColumn("n_train", F.col("n") - F.col("n_val") - F.col("n_test"))


def assign_splits(records: DataFrame, seed: int = 42, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """(schema_name, doc_no, new_split, ord): every record's split, by its place in an order shuffled by a hash.

    The order is that of the MD5 of record number and seed, so it needs no driver and is the same on every run.
    """
    rows = records.where("doc_no is not null").select("schema_name", "doc_no").distinct().withColumn("_h", F.md5(F.concat_ws(":", F.col("doc_no").cast("string"), F.lit(str(seed)))))
    sizes = split_sizes(rows.groupBy("schema_name").agg(F.count("*").alias("n")), ratios)
    placed = running(rows, ["schema_name"], ["_h", "doc_no"], place=("count", F.lit(1))).join(sizes.withColumnRenamed("schema_name", "_s"), F.col("schema_name").eqNullSafe(F.col("_s")))
    at = F.col("place") - 1
    new = F.when(at < F.col("n_train"), "train").when(at < F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    first = F.when(at < F.col("n_train"), F.lit(0)).when(at < F.col("n_train") + F.col("n_val"), F.col("n_train")).otherwise(F.col("n_train") + F.col("n_val"))
    return placed.select("schema_name", "doc_no", new.alias("new_split"), (at - first).cast("bigint").alias("ord"))


def first_of_each(split: DataFrame, most: int) -> DataFrame:
    """The first ``most`` records of every split, for a dry run."""
    return split.where(F.col("ord") < most)


def load(spark: SparkSession, directory: str, schema_name: str, seed: int = 42, ratios: tuple[float, float, float] = RATIOS, most: int | None = None) -> DataFrame:
    """(schema_name, doc, split, ord, gold_path, gold_data): the records of a directory with their splits, of each at most ``most``."""
    records = read_records(spark, directory).withColumns({"schema_name": F.lit(schema_name), "doc_no": F.xxhash64("doc")})
    placed = assign_splits(records, seed, ratios)
    kept = placed if most is None else first_of_each(placed, most)
    return records.join(kept.select("doc_no", F.col("new_split").alias("split"), "ord"), "doc_no").select("schema_name", "doc", "split", "ord", "gold_path", "gold_data")
