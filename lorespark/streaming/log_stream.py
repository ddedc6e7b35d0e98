"""Structured Streaming over the request log and over arriving sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.scalars import base_name, chunk_id, root_title, strip
from lorespark.operators.requests import NO_ACCESS
from lorespark.operators.segment import drop_short, outline
from lorespark.streaming.keyed import CHANGES, last_run, source_changes, start_runs

LOG_SCHEMA = "req_id long, ts timestamp, session_id long, mode string, question string, duration_ms long, outcome string"


def read_log_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)


def outcome_windows(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Tumbling hours by outcome, closed by the watermark."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "outcome").agg(F.count("*").alias("requests"))
    return x.select(F.col("window.start").alias("hour"), "outcome", "requests")


def session_windows(stream: DataFrame, idle: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions by event time, closed by the watermark; requests that are turned away are no part of one."""
    x = stream.where(~F.col("outcome").isin(*NO_ACCESS)).withWatermark("ts", late).groupBy(F.session_window("ts", idle), "session_id").agg(F.count("*").alias("requests"))
    return x.select("session_id", F.col("session_window.start").alias("started"), "requests")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append-only NDJSON of requests, exactly once by the checkpoint."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    return stream.writeStream.format("json").option("timestampFormat", form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


SOURCE = "path string, text string"


def with_entries(sources: DataFrame, least: int = 300) -> DataFrame:
    """(path, hash, ids, topics, summaries) of ``sources(path, text)``: a version's index entries as arrays, one for each segment of ``least`` characters or more. Row by row."""
    x = sources.where("path is not null").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", F.sha2("text", 256)).withColumn("doc_id", F.col("path"))
    x = drop_short(outline(x, root_title(base_name(F.col("path"))), keep=("path", "hash")), least)
    each = lambda f: F.transform("segs", f)
    return x.select(
        "path", "hash", each(lambda s: chunk_id(F.col("path"), s["heading"])).alias("ids"), each(lambda s: s["heading"]).alias("topics"),
        each(lambda s: strip(F.split(s["content"], r"[.!?]\s+")[0])).alias("summaries"),
    )


def ingest_sources(spark: SparkSession, source: str, out: str, checkpoint: str, least: int = 300, per_trigger: int = 1000):
    """Source files (Parquet of path, text) that arrive to changes of the index, exactly once by the checkpoint; with another checkpoint all starts anew.

    A batch meets the state of its own paths only, whatever came before. An unchanged source gives
    nothing; a changed one replaces its entries, and those it has no more go. Of versions that come in one batch one counts.
    """
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", per_trigger).parquet(source)
    return start_runs(source_changes(with_entries(stream, least)), out, checkpoint)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """(path, number, hash): every content version of a source that came in."""
    return last_run(spark, out, CHANGES).where("change = 'version'").select("path", "number", "hash")


def ingested_index(spark: SparkSession, out: str) -> DataFrame:
    """(path, hash, chunk_id, topic, summary, number): the entries that stand after all changes, each of its source's latest version."""
    x = last_run(spark, out, CHANGES).where("change <> 'version'")
    last = x.groupBy("path", "chunk_id").agg(F.max_by(F.struct("change", "hash", "topic", "summary", "number"), "number").alias("c"))
    return last.where("c.change = 'upsert'").select("path", "c.hash", "chunk_id", "c.topic", "c.summary", "c.number")
