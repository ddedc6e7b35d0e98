"""Writing chunks, index text, manifest and reports; tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import kb


FILE_ROWS = 1_000  # rows of a text file that is read back whole: a file grows with its rows only, more rows are more files


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; where none is set, a temporary one on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, of known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_name(kind: str, at: Column) -> Column:
    """A report's file name: the time without colons and dots."""
    return F.concat(F.lit(kind + "-"), F.regexp_replace(at, "[:.]", "-"), F.lit(".json"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("chunk_id", kb.markdown().alias("markdown")).write.parquet(path)


def write_index(entries: DataFrame, path: str) -> None:
    """The index text: header and entry blocks, in order of the chunks' files over the text files."""
    spark = entries.sparkSession
    blocks = entries.select(F.concat("chunk_id", F.lit(".md")).alias("file"), kb.index_entry().alias("value"))
    head = spark.range(1).select(F.lit("").alias("file"), F.lit(kb.INDEX_HEADER).alias("value"))
    head.unionByName(blocks).repartitionByRange("file").sortWithinPartitions("file").select("value").write.text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON objects keyed by path, one a line, in the manifest's order."""
    value = F.struct("hash", "extracted_at", "chunk_ids", "size_bytes")
    manifest.repartitionByRange("position").sortWithinPartitions("position").select(F.to_json(F.create_map("path", value)).alias("value")).write.text(path)


def write_report(reports: DataFrame, kind: str, path: str) -> None:
    """One JSON object for each of ``reports(startedAt, ...)``, in a folder named for its kind and time."""
    x = reports.withColumn("report", report_name(kind, F.col("startedAt")))
    x.repartition("report").write.partitionBy("report").json(path)


def write_retrieval_report(report: DataFrame, at: str, folder: str) -> str:
    """A run's ``retrieval_report`` at ``eval-retrieval-<time>.json``, a JSON object for each result; the place. A report of that time isn't written twice."""
    name = "eval-retrieval-" + "".join("-" if c in ":." else c for c in at) + ".json"
    report.withColumn("runAt", F.lit(at)).write.json(f"{folder}/{name}")
    return f"{folder}/{name}"


def write_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """NDJSON of requests, times to the microsecond."""
    log.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
