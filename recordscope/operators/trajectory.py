"""Runs of iterations: what was accepted, where they stalled, got worse or overfitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordscope.functions.hashing import prompt_hash
from recordscope.functions.metrics import ratio_udf
from recordscope.functions.text import top_key, unified_diff_udf
from recordscope.operators.scan import running

STALL, DROP, GAP, EVERY, RECENT, WORST = 3, 0.05, 0.1, 3, 5, 5
#: A prompt with a greater ratio to the best one so far is a near copy of it.
NEAR_COPY = 0.95


def iterations(history: DataFrame) -> DataFrame:
    """One record per run and iteration: the one saved first (smallest record_id)."""
    rest = [c for c in history.columns if c not in ("run_id", "iteration", "record_id")]
    return history.where("run_id is not null and iteration is not null").groupBy("run_id", "iteration").agg(F.min("record_id").alias("record_id"), F.min_by(F.struct(*rest), "record_id").alias("r")).select("run_id", "iteration", "record_id", "r.*")


def greedy(history: DataFrame) -> DataFrame:
    """``history`` with best_before, n and improved: the run's first record, or a score strictly above all before."""
    scored = running(history, ["run_id"], ["iteration"], before_best=("max", F.col("validation_score")), n=("count", F.lit(1)))
    scored = scored.withColumnRenamed("before_best", "best_before")
    better = F.col("best_before").isNull() & F.col("validation_score").isNotNull() | (F.col("validation_score") > F.col("best_before"))
    return scored.withColumn("improved", F.coalesce((F.col("n") == 1) | better, F.lit(False)))


def stalls(history: DataFrame) -> DataFrame:
    """(run_id, iteration, rejected_before, diversify): rejections since the last improvement before each iteration."""
    marked = greedy(history).select("run_id", "iteration", "n", F.when(F.col("improved"), F.col("n")).alias("hit"))
    last = running(marked, ["run_id"], ["iteration"], before_hit=("max", F.col("hit")))
    rejected = F.col("n") - 1 - F.coalesce("before_hit", F.lit(0))
    return last.select("run_id", "iteration", rejected.alias("rejected_before"), (rejected >= STALL).alias("diversify"))


def duplicate_prompts(history: DataFrame) -> DataFrame:
    """(run_id, iteration, first_iteration): prompts that the run has had before, letter for letter."""
    keyed = history.where("prompt is not null").select("run_id", "iteration", prompt_hash(F.col("prompt")).alias("h"))
    first = keyed.groupBy("run_id", "h").agg(F.min("iteration").alias("first_iteration"))
    return keyed.join(first, ["run_id", "h"]).where("iteration > first_iteration").select("run_id", "iteration", "first_iteration")


def near_copies(history: DataFrame) -> DataFrame:
    """(run_id, iteration, best_iteration, ratio): prompts with a ratio above NEAR_COPY to the run's best prompt before them.

    The best prompt is that of the last improvement. Null prompts are near copies of none. The ratio sees each distinct pair of prompts once.
    """
    marked = greedy(history).select("run_id", "iteration", "prompt", F.when(F.col("improved"), F.col("iteration")).alias("hit"))
    told = running(marked, ["run_id"], ["iteration"], before_hit=("max", F.col("hit"))).where("before_hit is not null and prompt is not null")
    best = marked.where("hit is not null and prompt is not null").select("run_id", F.col("iteration").alias("before_hit"), F.col("prompt").alias("best"))
    both = told.join(best, ["run_id", "before_hit"])
    pairs = both.select("best", "prompt").distinct().withColumn("ratio", ratio_udf("best", "prompt")).where(F.col("ratio") > NEAR_COPY)
    return both.join(pairs, ["best", "prompt"]).select("run_id", "iteration", F.col("before_hit").alias("best_iteration"), F.round("ratio", 6).alias("ratio"))


def prompt_at(history: DataFrame, iteration: int) -> DataFrame:
    """(run_id, iteration, prompt) of one iteration of each run, or of its first where the run has no such iteration."""
    wanted = F.max_by(F.struct("iteration", "prompt"), F.struct((F.col("iteration") == iteration), -F.col("iteration"))).alias("r")
    return history.groupBy("run_id").agg(wanted).select("run_id", "r.iteration", "r.prompt")


def prompt_diffs(history: DataFrame) -> DataFrame:
    """(run_id, iteration, previous, diff): the unified diff of each accepted prompt with the one accepted before it."""
    steps = accepted_steps(history).select("run_id", "iteration", "previous", "prompt")
    before = steps.select("run_id", F.col("iteration").alias("previous"), F.col("prompt").alias("old"))
    name = lambda c: F.concat(F.lit("iteration_"), F.col(c).cast("string"))
    return steps.where("previous is not null").join(before, ["run_id", "previous"]).select("run_id", "iteration", "previous", unified_diff_udf("old", "prompt", name("previous"), name("iteration")).alias("diff"))


def accepted_steps(history: DataFrame) -> DataFrame:
    """The accepted records with previous, the iteration accepted before them in the run."""
    kept = history.where("accepted")
    return running(kept, ["run_id"], ["iteration"], before_it=("max", F.col("iteration"))).withColumnRenamed("before_it", "previous")


def regressions(history: DataFrame) -> DataFrame:
    """(run_id, iteration, previous, field, score_before, score_after): fields that fell by DROP or more from one accepted record to the next; a missing field has 0."""
    steps = accepted_steps(history)
    now = steps.where("previous is not null").select("run_id", "iteration", "previous", F.col("field_scores_summary").alias("after"))
    was = steps.select("run_id", F.col("iteration").alias("previous"), F.explode("field_scores_summary").alias("field", "score_before"))
    after = F.coalesce(F.try_element_at("after", F.col("field")), F.lit(0.0))
    return now.join(was, ["run_id", "previous"]).withColumn("score_after", after).where(F.round(F.col("score_before") - F.col("score_after"), 9) >= DROP).select("run_id", "iteration", "previous", "field", "score_before", "score_after")


def overfit(history: DataFrame) -> DataFrame:
    """(run_id, iteration, gap): accepted records, every third iteration, whose validation score exceeds the test score by more than GAP."""
    gap = F.round(F.col("validation_score") - F.col("test_score"), 9)
    return history.where(F.col("accepted") & (F.col("iteration") % EVERY == 0)).withColumn("gap", gap).where(F.col("gap") > GAP).select("run_id", "iteration", "gap")


def score_curve(history: DataFrame) -> DataFrame:
    best = running(history, ["run_id"], ["iteration"], best=("max", F.col("validation_score")))
    return best.select("run_id", "iteration", "validation_score", "best", F.left(prompt_hash(F.col("prompt")), F.lit(8)).alias("prompt_key"))


def recent(history: DataFrame) -> DataFrame:
    """(run_id, lines): the last RECENT iterations of each run, one line each."""
    ranked = history.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("iteration")))).where(F.col("k") <= RECENT)
    line = F.concat_ws(" ", F.concat(F.lit("#"), F.col("iteration").cast("string")), F.when(F.col("accepted"), "accepted").otherwise("rejected"), F.coalesce("reason", F.lit("")))
    return ranked.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("iteration", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def worst_fields(scores: DataFrame) -> DataFrame:
    """(run_id, rank, score_id, field_key, score): the WORST lowest leaf scores of each run; ties by score_id."""
    leaves = scores.where(~F.col("field_key").endswith("._array_avg") & F.col("score").isNotNull())
    return leaves.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("score", "score_id"))).where(F.col("rank") <= WORST).select("run_id", "rank", "score_id", "field_key", "score")


def line_changes(history: DataFrame) -> DataFrame:
    """(run_id, iteration, added, removed): lines of each accepted prompt that the accepted prompt before lacks, and the reverse. Repeated lines count each time."""
    steps = accepted_steps(history).select("run_id", "iteration", "previous", "prompt")
    lines = steps.select("run_id", "iteration", F.explode(F.split("prompt", "\n")).alias("line"))
    links = steps.where("previous is not null").select("run_id", "iteration", "previous")
    here = links.join(lines, ["run_id", "iteration"])
    there = links.join(lines.withColumnRenamed("iteration", "previous"), ["run_id", "previous"])
    keys = ["run_id", "iteration", "line"]
    added = here.join(there.select(*keys).distinct(), keys, "left_anti").groupBy("run_id", "iteration").agg(F.count("*").alias("added"))
    removed = there.join(here.select(*keys).distinct(), keys, "left_anti").groupBy("run_id", "iteration").agg(F.count("*").alias("removed"))
    zero = F.lit(0).cast("bigint")
    return links.join(added, ["run_id", "iteration"], "left").join(removed, ["run_id", "iteration"], "left").select("run_id", "iteration", F.coalesce("added", zero).alias("added"), F.coalesce("removed", zero).alias("removed"))


def overview(history: DataFrame) -> DataFrame:
    """(run_id, tried, accepted, best, last_test, trend) per run, the first record not counted as tried."""
    per = history.groupBy("run_id").agg((F.count("*") - 1).alias("tried"), F.count_if(F.col("accepted") & (F.col("iteration") > 0)).alias("accepted"), F.max("validation_score").alias("best"), F.min_by("test_score", F.when(F.col("test_score").isNotNull(), F.col("iteration"))).alias("first_test"), F.max_by("test_score", F.when(F.col("test_score").isNotNull(), F.col("iteration"))).alias("last_test"))
    delta = F.round(F.col("last_test") - F.col("first_test"), 9)
    return per.select("run_id", "tried", "accepted", "best", "last_test", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same").alias("trend"))


def subtree_lines(scores: DataFrame) -> DataFrame:
    """(run_id, lines): the mean score of each top member over a run, in the order of their names, a line each."""
    per = scores.groupBy("run_id", top_key(F.col("field_key")).alias("top")).agg((F.sum(F.col("score").cast("decimal(20,12)")).cast("double") / F.count("score")).alias("m"))
    line = F.struct("top", F.concat("top", F.lit(": "), F.round("m", 4).cast("decimal(10,4)").cast("string")).alias("line"))
    return per.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
