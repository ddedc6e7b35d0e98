"""Reading source files, chunks, index text, manifest, gold queries, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.scalars import normalize_related, strip

MANIFEST = "map<string,struct<hash:string,extracted_at:string,chunk_ids:array<string>,size_bytes:bigint>>"


def read_sources(spark: SparkSession, folder: str, ending: str = "pdf") -> DataFrame:
    """(path, content, length) of the source files of a folder, in any case of the ending; others are skipped."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)
    x = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return x.select("path", "content", "length")


def read_chunks(spark: SparkSession, folder: str, ending: str = "md") -> DataFrame:
    """(file, raw) of chunk files, each whole; a file that can't be read is left out (``skipped_chunks`` counts them)."""
    x = spark.read.option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(folder, wholetext=True)
    return x.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


def skipped_chunks(spark: SparkSession, folder: str, ending: str = "md") -> DataFrame:
    """One row: how many chunk files there are, and how many of them ``read_chunks`` leaves out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "true").load(folder).agg(F.count("path").alias("files"))
    read = read_chunks(spark, folder, ending).agg(F.count("*").alias("read"))
    return listed.crossJoin(F.broadcast(read)).select("files", (F.col("files") - F.col("read")).alias("skipped"))


#: The fields of an entry of the index text, and the items of its lists.
ENTRY_FIELDS = {
    "chunk_id": r"^\s*([^\n]+)",
    "source": r"\n\s+source:\s*(.+)",
    "topic": r"\n\s+topic:\s*(.+)",
    "summary": r"summary:\s*>\s*\n\s+(.+)",
    "has_conditions": r"\n\s+has_conditions:\s*(true|false)",
    "status": r"\n\s+status:\s*(\w+)",
}
QUOTED, PLAIN = r'(?m)- "?(.+?)"?\s*$', r"(?m)- (.+?)\s*$"
ENTRY_LISTS = {"triggers": r"\n\s+triggers:\s*\n((?:\s+- .+\n?)*)", "related_chunks": r"\n\s+related_chunks:\s*\n((?:\s+- .+\n?)*)"}


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an index text: one row per block, read in parallel; those without id or topic are dropped."""
    # the first block of a file still has what the others are cut at
    b = F.regexp_replace("value", r"^\s*- chunk_id:", "")
    text = lambda name: F.regexp_extract("b", ENTRY_FIELDS[name], 1)
    field = lambda name, default="": F.coalesce(F.nullif(strip(text(name)), F.lit("")), F.lit(default)).alias(name)
    items = lambda name, form: F.regexp_extract_all(F.regexp_extract("b", ENTRY_LISTS[name], 1), F.lit(form), 1)
    x = spark.read.option("lineSep", "\n  - chunk_id:").text(path).select(b.alias("b")).where(~strip(F.col("b")).startswith("#") & (strip(F.col("b")) != ""))
    return x.select(
        field("chunk_id"),
        field("source", "unknown"),
        field("topic"),
        field("summary"),
        F.transform(items("triggers", QUOTED), strip).alias("triggers"),
        (text("has_conditions") == "true").alias("has_conditions"),
        normalize_related(items("related_chunks", PLAIN)).alias("related_chunks"),
        field("status", "active"),
    ).where("chunk_id <> '' and topic <> ''")


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, hash, extracted_at, chunk_ids, size_bytes, position) of a JSON object keyed by path, in its order.

    ``lines``: of many objects, one a line, in order of the files' names; ``position`` counts through all of them. The splits' rows are counted first, a row a split.
    """
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    x = spark.read.text(path, wholetext=not lines).select(F.from_json("value", MANIFEST).alias("m"), *at)
    x = x.select("file", "block", "line", F.posexplode(F.map_entries("m")).alias("k", "e"))
    position = F.col("k").cast("long")
    if lines:
        rows = x.groupBy("file", "block").agg(F.count("*").alias("n"))
        start = rows.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("start"))
        x = x.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("line", "k"))).join(F.broadcast(start), ["file", "block"])
        position = F.col("start") + F.col("place") - 1
    return x.select(F.col("e.key").alias("path"), "e.value.*", position.alias("position"))


def read_gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_chunk_ids, notes) of files that hold a JSON array each."""
    item = "array<struct<question:string,expected_chunk_ids:array<string>,notes:string>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", item)).alias("q")).select("q.*")


STEP = "struct<step:string,success:boolean,durationMs:bigint,output:string,error:string>"
REPORT = f"startedAt string, sources array<string>, steps array<{STEP}>, chunksInKB bigint, totalDurationMs bigint, success boolean"


def read_reports(spark: SparkSession, folder: str, kind: str = "ingest", corrupt: bool = False) -> DataFrame:
    """(file, startedAt, ...) of reports, files or folders named ``kind-*.json``; corrupt ones only where asked for, then with ``broken``."""
    x = spark.read.schema(f"{REPORT}, broken string").option("recursiveFileLookup", "true").json(folder, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"(?:^|/|=)({kind}-[^/]*\.json)(?:/[^/]*)?$", 1)
    x = x.withColumn("file", name).where("file <> ''")
    return x if corrupt else x.where("broken is null").drop("broken")


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("req_id long, ts timestamp, session_id long, mode string, question string, duration_ms long, outcome string").json(path)


RETRIEVAL_REPORT = "runAt string, score long, passed long, failed long, question string, expected array<string>, retrieved array<string>, hit boolean"


def read_retrieval_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, runAt, score, passed, failed, question, expected, retrieved, hit) of the evaluation reports of a folder."""
    x = spark.read.schema(RETRIEVAL_REPORT).option("recursiveFileLookup", "true").json(folder, mode="DROPMALFORMED")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(?:^|/)(eval-retrieval-[^/]*\.json)(?:/[^/]*)?$", 1)
    return x.withColumn("file", name).where("file <> ''")
