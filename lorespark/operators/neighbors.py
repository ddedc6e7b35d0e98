"""Exact nearest neighbours by cosine, over clustered vectors and the triangle inequality.

Vectors are scaled to length 1, where the order by cosine is that by distance. Centroids are fitted on a bounded
sample (``FIT_ROWS``); every vector goes to its nearest one, and each cluster's size and radius are counted.
A query first searches the clusters nearest to it until they hold k others. The k-th distance found, t,
bounds what can still be better: only clusters whose centroid is within t plus their radius, and of those
only members whose own distance from the centroid differs from the query's by t at most. Nothing closer is missed.

Clusters are cut into blocks of ``MEMBERS``; a task holds one block's vectors and lets its queries pass in batches, each
keeping its k best. Broadcast: the centroids, at most ``MOST_CENTROIDS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.sinks import written

FIT_ROWS, MOST_CENTROIDS, ROUNDS = 8192, 1024, 8
MEMBERS, PASSING = 2048, 256
SLACK = 1e-7  # of distances, for rounding
DIGITS = 9  # cosines that agree in so many are ties, which the smaller id wins


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None], 0))


def centroids(sample: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Up to k centres of a sample: random rows, moved to their rows' mean a few times."""
    x = np.unique(sample, axis=0)
    book = x[np.random.default_rng(seed).permutation(len(x))[: min(k, len(x))]]
    for _ in range(ROUNDS):
        own = _distances(x, book).argmin(1)
        held = np.unique(own)
        book = np.stack([x[own == c].mean(0) for c in held])
    return book


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_vectors(table: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """(id, v) of ``table(vec_id, embedding)`` at length 1, and their size: vectors of the commonest size (ties: the smallest) that are
    not null or zero and hold nothing null or non-finite; others have no neighbours and are nobody's."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            ids, vectors = [], []
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                x = _matrix(column.take(pa.array(at)))
                with np.errstate(over="ignore", invalid="ignore"):
                    x = x / np.abs(x).max(1, keepdims=True)  # large ones don't overflow
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                fit = np.isfinite(x).all(1)
                ids.append(batch.column(0).take(pa.array(at[fit])))
                vectors += list(x[fit])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "v"])

    kind = table.schema["vec_id"].dataType.simpleString()
    x = written(table.select("vec_id", "embedding").mapInArrow(run, f"id {kind}, v array<double>"), "unit-vectors")
    if size is None:
        usual = x.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
        size = usual["n"] if usual else 0
    return x.where(F.size("v") == size), size


class Clusters:
    """Centroids with sizes and radii: where a query has to look."""

    def __init__(self, book: np.ndarray, counts: np.ndarray, radii: np.ndarray):
        self.book, self.counts, self.radii = book, counts, radii

    def first(self, far: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query, by its distances from the centroids: the nearest clusters that hold k others beside itself."""
        for row in np.argsort(far, axis=1, kind="stable"):
            yield row[: int(np.searchsorted(np.cumsum(self.counts[row]), k + 1)) + 1]

    def rest(self, far: np.ndarray, k: int, reach: np.ndarray) -> Iterator[np.ndarray]:
        """The clusters further on that may hold something within ``reach``."""
        for d, first, t in zip(far, self.first(far, k), reach, strict=True):
            near = (d - self.radii <= t) & (self.counts > 0)
            near[first] = False
            yield np.flatnonzero(near)


def _assigned(book):
    """(id, v, cell, far) of unit vectors."""

    def run(batches):
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), book.value) if batch.num_rows else np.zeros((0, 1))
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], names=["id", "v", "cell", "far"])

    return run


def _visits(clusters, k: int):
    """(cell, id, v, far, reach) of queries (id, v, reach), a row a cluster that each visits: without a reach the first ones, else the rest."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                told, reach = clusters.value, batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                far = _distances(_matrix(batch.column(1)), told.book)
                search = told.first(far, k) if np.isnan(reach).all() else told.rest(far, k, reach)
                seen = list(search)
                row = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
                cell = np.concatenate([*seen, np.zeros(0, int)]).astype(np.int32)
                take = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), take.column(0), take.column(1), pa.array(far[row, cell]), pa.array(reach[row])], names=["cell", "id", "v", "far", "reach"])

    return run


def _searched(k: int, kind: pa.DataType):
    """(id, other, cosine): each query's k best of a block, of rows (cell, i, asks, id, v, far, reach) with a block's members first, by their distance from the centroid."""

    def found(members, queries):
        ids, x, far = members
        rows = sorted(queries, key=lambda r: r[2])
        for at in range(0, len(rows), PASSING):
            part = rows[at : at + PASSING]
            reach = np.array([np.inf if r[3] is None or r[3] != r[3] else r[3] for r in part])
            away = np.array([r[2] for r in part])
            low, high = np.searchsorted(far, (away - reach).min() - SLACK, "left"), np.searchsorted(far, (away + reach).max() + SLACK, "right")
            if low >= high:
                continue
            cosine = np.round(np.stack([r[1] for r in part]) @ x[low:high].T, DIGITS)
            least = np.maximum(1 - (reach + SLACK) ** 2 / 2, -2)
            for r, row, bound in zip(part, cosine, least, strict=True):
                near = np.flatnonzero(row >= bound)
                if len(near) > k + 1:
                    near = near[row[near] >= np.partition(row[near], len(near) - k - 1)[len(near) - k - 1]]
                best = sorted((-row[m], ids[low + m]) for m in near.tolist() if ids[low + m] != r[0])[:k]
                yield from ((r[0], other, -c) for c, other in best)

    def run(batches):
        key, ids, rows, far, queries = None, [], [], [], []

        def out():
            got = list(found((ids, np.stack(rows), np.array(far)), queries)) if rows and queries else []
            a, b, c = zip(*got, strict=True) if got else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(c, pa.float64())], names=["id", "other", "cosine"])

        for batch in batches:
            v = _matrix(batch.column(4)) if batch.num_rows else []
            for k_, (cell, i, asks, ident, d, reach) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)), strict=True)):
                if (cell, i) != key:
                    if queries:
                        yield out()
                    key, ids, rows, far, queries = (cell, i), [], [], [], []
                if asks:
                    queries.append((ident, v[k_], d, reach))
                    if len(queries) >= 16 * PASSING:
                        yield out()
                        queries = []
                else:
                    ids.append(ident)
                    rows.append(v[k_])
                    far.append(d)
        if queries:
            yield out()

    return run


def knn_retrieve(table: DataFrame, queries: DataFrame, k: int = 5, n_centroids: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, cosine): the k vectors of ``table(vec_id, embedding)`` nearest to each of ``queries`` (the same columns), itself left out. Exact.

    Ids are of one row each. Vectors that can't be compared (``unit_vectors``) are left out on both sides; where fewer than k others
    are there, all come. Cosines are rounded to ``DIGITS``; of equals the smaller id comes first.
    """
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    x, size = unit_vectors(table)
    if not size:
        return spark.createDataFrame([], f"vec_id {kind}, rank int, neighbor_id {kind}, cosine double")
    n = x.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, FIT_ROWS / n) * (1 << 30)
    sample = np.array([r["v"] for r in x.where(share).orderBy("id").select("v").collect()] or [x.first()["v"]])  # about FIT_ROWS vectors
    book = centroids(sample, n_centroids or int(min(MOST_CENTROIDS, max(8, n**0.5 / 2))))
    shared = spark.sparkContext.broadcast(book)
    members = written(x.mapInArrow(_assigned(shared), f"id {kind}, v array<double>, cell int, far double"), "vectors-of-clusters")
    counts, radii = np.zeros(len(book), np.int64), np.zeros(len(book))
    for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a centroid
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    clusters = spark.sparkContext.broadcast(Clusters(book, counts, radii + SLACK))
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in -(-np.maximum(counts, 1) // MEMBERS)]), F.col("cell") + 1)
    own = members.select("cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("i"), F.lit(False).alias("asks"), "id", "v", "far", F.lit(None).cast("double").alias("reach"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(asked: DataFrame, name: str) -> DataFrame:
        seen = asked.mapInArrow(_visits(clusters, k), f"cell int, id {kind}, v array<double>, far double, reach double")
        seen = seen.select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.lit(True).alias("asks"), "id", "v", "far", "reach")
        dealt = own.unionByName(seen).repartition(parts, "cell", "i").sortWithinPartitions("cell", "i", "asks", "far")
        told = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        return written(dealt.mapInArrow(_searched(k, told), f"id {kind}, other {kind}, cosine double"), name)

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    asked, _ = unit_vectors(queries, size)
    asked = written(asked.select("id", "v", F.lit(None).cast("double").alias("reach")), "queries")
    first = search(asked, "first-neighbours")
    last = first.withColumn("rank", rank).where(F.col("rank") == k).select("id", F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))).alias("t"))
    # a query that found fewer than k asks everywhere
    further = asked.drop("reach").join(last.hint("shuffle_merge"), "id", "left").select("id", "v", (F.coalesce("t", F.lit(2.0)) + SLACK).alias("reach"))
    both = first.unionByName(search(written(further, "queries-with-reach"), "further-neighbours"))
    x = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return x.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbor_id"), "cosine")
