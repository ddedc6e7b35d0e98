"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a temporary folder is set; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cut lineage, true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LOCAL_EDGES = 500_000


def _forest(label: bool):
    """Of a task's edges (u, v): a spanning forest, every node to its tree's smallest; with ``label`` the roots too."""

    def run(batches):
        up: dict[int, int] = {}

        def find(x):
            root = x
            while (p := up.setdefault(root, root)) != root:
                root = p
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def out():
            rows = [(x, find(x)) for x in list(up)]
            rows = rows if label else [r for r in rows if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if not label and len(up) >= LOCAL_EDGES:
                yield out()
                up.clear()
        if up:
            yield out()

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root = smallest node.

    Every task first replaces its edges by a spanning forest. Up to ``LOCAL_EDGES``
    of the edges then left are finished in one bounded task; more go through
    alternating large-star and small-star rounds, each written to the shared
    folder, until no edge changes. Isolated nodes aren't returned; empty edges
    give an empty table. A null end is dropped.
    """
    kind = edges.schema["a"].dataType
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = written(e.mapInArrow(_forest(False), "u long, v long").distinct(), "cc")
    if e.count() <= LOCAL_EDGES:
        named = e.repartition(1).mapInArrow(_forest(True), "u long, v long")
        return named.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root"))
    return _star_rounds(e, kind, max_rounds)


def _star_rounds(e: DataFrame, kind, max_rounds: int = 60) -> DataFrame:
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is joined to u's smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: the smaller neighbours of u and u itself join the smallest one
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(low2.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = written(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).select(
        F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("root")
    )


def text_of(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
