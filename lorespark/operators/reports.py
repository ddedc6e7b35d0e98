"""Reports of runs: totals, means, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_report(steps: DataFrame, by: list[str]) -> DataFrame:
    """Per run: its steps in order of name, their total time, and whether all succeeded. ``steps(..., step, ms, success)``."""
    told = F.array_sort(F.collect_list(F.struct("step", "success", F.col("ms").cast("long").alias("durationMs"))))
    return steps.groupBy(*by).agg(told.alias("steps"), F.sum("ms").cast("long").alias("total_ms"), F.bool_and("success").alias("success"))


def perf_report(reports: DataFrame) -> DataFrame:
    """(what, value): runs, sources, mean seconds of a run, and of each step.

    ``reports(totalDurationMs, sources, steps, broken)``. All files count as runs, corrupt ones
    (``broken`` not null) too, and the mean run divides by them; their other fields don't count.
    """
    good = F.col("broken").isNull()
    total = reports.agg(
        F.count("*").cast("double").alias("runs"),
        F.coalesce(F.sum(F.when(good, F.size("sources"))), F.lit(0)).cast("double").alias("sources"),
        F.round(F.try_divide(F.coalesce(F.sum(F.when(good, F.col("totalDurationMs"))), F.lit(0)), F.count("*")) / 1000, 1).alias("mean_run_s"),
    )
    one = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in total.columns])
    step = reports.where(good).select(F.explode("steps").alias("s")).groupBy("s.step").agg(F.round(F.avg("s.durationMs") / 1000, 1).alias("value"))
    return total.select(F.inline(one)).unionByName(step.select(F.concat(F.lit("step "), "step").alias("what"), "value"))


def source_failures(results: DataFrame) -> DataFrame:
    """One row of ``results(source, new_chunks, updated_chunks, failed)``: sources, chunks created and updated by those that didn't fail, sources failed."""
    went = lambda c: F.coalesce(F.sum(F.when(~F.col("failed"), F.col(c))), F.lit(0)).cast("long")
    return results.agg(F.count("*").alias("sources"), went("new_chunks").alias("created"), went("updated_chunks").alias("updated"), F.count_if("failed").alias("failed"))


def retrieval_report(hits: DataFrame, score: DataFrame) -> DataFrame:
    """What an evaluation run leaves: ``hits(qid, question, expected, got, hit, ...)`` as results, each with the run's ``score(score, hits, misses)``."""
    run = score.select(F.col("score"), F.col("hits").alias("passed"), F.col("misses").alias("failed"))  # one row
    return hits.select("question", "expected", F.col("got").alias("retrieved"), "hit").crossJoin(F.broadcast(run))
