"""The manifest in versions: immutable folders, and a pointer that names the last one.

A version's rows are written to a folder of their own first. Then a pointer file of the next
number, which holds the folder's name, is moved to its place: whole or not at all, and only if no
other writer has that number. The last pointer counts. A write that fails, or comes second, leaves a folder that nobody reads.
The move without overwriting is atomic on HDFS and its like; an object store without it needs one writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = "path string, hash string, extracted_at string, chunk_ids array<string>, size_bytes long, position long"


class ConcurrentWrite(RuntimeError):
    """Another writer has written the version that follows the one this write builds on."""


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(conf), path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are there, in order."""
    fs, path, _ = _fs(spark, root)
    found = fs.globStatus(path(f"{root}/pointer-*"))
    return sorted(int(f.getPath().getName().removeprefix("pointer-")) for f in found or [])


def current_version(spark: SparkSession, root: str) -> int:
    """The last version's number, 0 before the first."""
    return max(_pointers(spark, root), default=0)


def write_manifest_version(manifest: DataFrame, root: str, base: int | None = None) -> int:
    """Write ``manifest`` (``ROWS``) as the version after ``base`` (by default the last); its number. Raises ``ConcurrentWrite`` where that is taken."""
    spark = manifest.sparkSession
    fs, path, files = _fs(spark, root)
    number = (current_version(spark, root) if base is None else base) + 1
    own = f"rows-{number:08d}-{uuid.uuid4().hex}"
    manifest.select(*[c.split()[0] for c in ROWS.split(", ")]).write.parquet(f"{root}/{own}")
    if current_version(spark, root) >= number:
        raise ConcurrentWrite(f"version {number} is there already")
    ready = f"{root}/.{own}"
    out = fs.create(path(ready), False)
    out.write(bytearray(own, "utf-8"))
    out.close()
    try:
        files.rename(path(ready), path(f"{root}/pointer-{number:08d}"), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(path(ready), False)
        if number in _pointers(spark, root):
            raise ConcurrentWrite(f"version {number} is there already") from e
        raise
    return number


def read_manifest_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version's rows, by default the last one's; none before the first."""
    number = current_version(spark, root) if number is None else number
    if not number:
        return spark.createDataFrame([], ROWS)
    fs, path, _ = _fs(spark, root)
    pointer = path(f"{root}/pointer-{number:08d}")
    opened = fs.open(pointer)
    own = bytes(opened.readAllBytes()).decode("utf-8")
    opened.close()
    return spark.read.schema(ROWS).parquet(f"{root}/{own}")
