"""The request log: sessions, history, limits, failures, latency. Columns: req_id, session_id, ts, mode, duration_ms, outcome."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.sinks import written

NO_ACCESS = ("invalid", "rate_limited")  # requests that are turned away before they touch a session


def _by_session():
    return Window.partitionBy("session_id").orderBy("ts", "req_id")


def sessionize(log: DataFrame, idle_s: int = 1800) -> DataFrame:
    """The accesses of ``log`` with ``session_no``: a new one after more than ``idle_s`` without an access.

    Invalid and rate-limited requests are no accesses and have no row; failed ones and timeouts are.
    """
    log = log.where(~F.col("outcome").isin(*NO_ACCESS))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_by_session())
    return log.withColumn("session_no", F.sum(F.when(gap > idle_s * 1_000_000, 1).otherwise(0)).over(_by_session()))


def valid_requests(requests: DataFrame, most_bytes: int = 64 * 1024) -> DataFrame:
    """``requests(message, session_id, mode, body_bytes)`` with ``status`` (413, then 400, else 200) and the mode's default."""
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    status = F.when(F.col("body_bytes") > most_bytes, 413).when(missing("message") | missing("session_id"), 400).otherwise(200)
    return requests.withColumn("status", status).withColumn("mode", F.coalesce(F.nullif("mode", F.lit("")), F.lit("answer")))


def session_stats(log: DataFrame, idle_s: int = 1800) -> DataFrame:
    """Per session: first and last request, count and mean duration."""
    x = sessionize(log, idle_s).groupBy("session_id", "session_no")
    return x.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))


def history_window(turns: DataFrame, n: int = 20) -> DataFrame:
    """(conv_id, turn, history): before each user turn, the last ``n`` messages."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    said = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    x = turns.withColumn("history", F.array_join(F.collect_list(said).over(w), "\n"))
    return x.where("role = 'user'").select("conv_id", "turn", "history")


def trailing_request_count(log: DataFrame, window_s: int = 60) -> DataFrame:
    """``log`` with the session's requests in the window that ends at each."""
    w = Window.partitionBy("session_id").orderBy(F.unix_micros("ts")).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return log.withColumn("in_window", F.count("*").over(w))


def rate_limit_decisions(log: DataFrame, limit: int = 20, window_s: int = 60) -> DataFrame:
    """(session_id, req_id, admitted). Only admitted requests count, so a session is read in order.

    Sessions are cut at gaps of a window or more, before which no request matters. A
    task reads its runs sorted and keeps the last ``limit`` admitted times of one run.
    """
    window = window_s * 1_000_000
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(_by_session())
    runs = log.withColumn("run", F.sum(F.when(gap >= window, 1).otherwise(0)).over(_by_session()))
    runs = runs.select("session_id", "run", "req_id", F.unix_micros("ts").alias("at"))

    def decide(batches):
        own, last = None, deque(maxlen=max(limit, 0))
        for batch in batches:
            out = []
            for *run, at in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if run != own:
                    own = run
                    last.clear()
                out.append(limit > 0 and (at is None or len(last) < limit or at - last[0] >= window))
                if out[-1] and at is not None:
                    last.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], names=["session_id", "req_id", "admitted"])

    runs = runs.repartition("session_id", "run").sortWithinPartitions("session_id", "run", "at", "req_id")
    runs = runs.select(F.col("session_id").cast("long"), "run", F.col("req_id").cast("long"), "at")
    return runs.mapInArrow(decide, "session_id long, req_id long, admitted boolean")


def stale_sessions(log: DataFrame, at: str, idle_s: int = 1800) -> DataFrame:
    """(session_id, last_ts): sessions idle for longer than ``idle_s`` at a time."""
    x = log.where(F.col("ts") <= F.lit(at).cast("timestamp")).groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    return x.where(F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros("last_ts") > idle_s * 1_000_000)


def failure_runs(log: DataFrame, threshold: int = 5, by: str = "session_id") -> DataFrame:
    """Runs of at least ``threshold`` failures in a row: start, end, length."""
    order = Window.partitionBy(by).orderBy("ts", "req_id")
    x = log.withColumn("island", F.sum(F.when(F.col("outcome") == "error", 0).otherwise(1)).over(order)).where("outcome = 'error'")
    x = x.groupBy(by, "island").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("failures"))
    return x.where(F.col("failures") >= threshold).drop("island")


def error_breakdown(errors: DataFrame) -> DataFrame:
    """(hour, class, n): failing calls of ``errors(ts, class)`` by hour."""
    return errors.groupBy(F.window("ts", "1 hour").alias("w"), "class").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "class", "n")


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n) of values that aren't null, written."""
    return written(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")), "value-counts")


def exact_quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``) of the written ``counts(by, value, n)``: exact quantiles, between two values by their distance.

    The histogram is sorted over partitions; how many values lie before a partition is a sum of counts
    of partitions, and only inside one are values counted on. Of each group the rows around the places looked for go on.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = written(counts.repartitionByRange(parts, *by, "value").withColumn("part", F.spark_partition_id()), "value-counts-sorted")
    blocks = x.groupBy(*by, "part").agg(F.sum("n").alias("own"))  # a row a partition, and one more a group
    order = Window.partitionBy(*by).orderBy("part")
    blocks = blocks.withColumns({"before": F.sum("own").over(order) - F.col("own"), "total": F.sum("own").over(Window.partitionBy(*by))}).drop("own")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "part"]]
    x = x.alias("x").join(written(blocks, "value-blocks").alias("b").hint("shuffle_merge"), same).select("x.*", "b.before", "b.total")
    upto = F.sum("n").over(Window.partitionBy(*by, "part").orderBy("value")) + F.col("before")
    x = x.withColumn("upto", upto)
    at = {name: (F.lit(p) * (F.col("total") - 1)) for name, p in shares.items()}
    holds = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    ends = [F.max(F.when(holds(f(a)), F.col("value"))).alias(f"{name}_{end}") for name, a in at.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    got = x.groupBy(*by).agg(F.max("total").alias("total"), *ends)
    part = {name: a - F.floor(a) for name, a in at.items()}
    return got.select(*by, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part[n]).alias(n) for n in shares])


def latency_report(log: DataFrame, limit_ms: int = 120_000) -> DataFrame:
    """Per mode: requests, mean, exact median and 95th percentile, share at or over the limit. Requests without a duration count, but have none."""
    counts = value_counts(log, ["mode"], "duration_ms")
    q = exact_quantiles(counts, ["mode"], {"p50_ms": 0.5, "p95_ms": 0.95})
    value = F.col("value")
    known = counts.groupBy("mode").agg(F.sum("n").alias("known"), F.sum(value * F.col("n")).alias("sum"), F.sum(F.when(value >= limit_ms, F.col("n")).otherwise(0)).alias("over"))
    x = log.groupBy("mode").agg(F.count("*").alias("requests")).alias("r")
    for name, other in (("k", known), ("q", q)):
        x = x.join(other.alias(name).hint("shuffle_merge"), F.col("r.mode").eqNullSafe(F.col(f"{name}.mode")), "left")
    return x.select(
        "r.mode", "requests", F.round(F.col("sum") / F.col("known"), 3).alias("mean_ms"), F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms"), F.round(F.col("over") / F.col("known"), 6).alias("over_limit")
    )
