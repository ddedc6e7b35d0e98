"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, trained on a bounded sample (``fit_rows``, or ``FIT_EACH`` for each centroid),
quantise the halves of the unit vectors; their product is the grid of cells, which grows with
the counted vectors: about one cell for ``PER_CELL`` of them, up to ``MOST_BOOKS`` centroids a
half. Every vector lies in its home cell. As a query it visits cells in order of the squared
distance its halves must move to reach them (a multi-sequence traversal over the two sorted
lists of half-distances): a half has to cross the bisectors between centroids.
The traversal ends at the distance within which the target share ``recall`` of
partners lies, measured on the sample with partners drawn at exactly the
threshold, whose difference is spread over the vector or lies in either half, whichever lies
farthest; ``recall = 1`` goes on to the link radius and misses nothing. Of a
pair the smaller id asks, so each pair is compared once, exactly and in double
precision, and counts for both.

Equal vectors are one class with a count. A cell's members and visiting queries
are cut into blocks; a block pair is one matrix product in one run, and yields
the queries' link counts and a spanning forest of its links, never all pairs.
Broadcast: the codebooks, a bit for each cell (``MOST_BOOKS ** 2`` at most), and the cells of
several blocks up to ``SENT_CELLS`` of them, beyond which they are joined.

Defined results. Vectors that are null, zero, or hold null or non-finite
components, or whose length differs from the commonest one's: 0 links, own
component, kept. Repeated vec_ids count as rows of their own. A cosine of exactly the
threshold links. Columns beside vec_id and embedding are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import components, partitions_for, written

COSINE = 0.95
PER_CELL, MOST_BOOKS = 48, 2048
RECALL = 0.97
FIT_ROWS, FIT_EACH = 8192, 16
CLOSE = 24  # centroids between which all bisectors are looked at
SENT_CELLS = 200_000
MEMBERS, QUERIES = 1024, 4096


def train_book(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means with spread-out first centroids."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    book = x[[rng.integers(len(x))]]
    near = ((x - book[0]) ** 2).sum(1)
    while len(book) < k:
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        book = np.vstack((book, x[pick]))
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    for _ in range(rounds):
        own = _distances(x, book).argmin(1)
        for c in range(k):
            if (own == c).any():
                book[c] = x[own == c].mean(0)
    return book


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None], 0)


def crossings(x: np.ndarray, book: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home centroid of each row, and the squared distance to get into each centroid's region, from below.

    ``apart``: the centroids' distances. All bisectors between the ``CLOSE`` nearest centroids
    are to be crossed; of the others, that with the home centroid.
    """
    d = _distances(x, book)
    rows, home = np.arange(len(x))[:, None], d.argmin(1)

    def crossed(more, between):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(between > 0, more / (2 * between), 0)

    far = np.maximum(crossed(d - d[rows, home[:, None]], apart[home]), 0)
    near = np.argpartition(d, min(CLOSE, len(book)) - 1, axis=1)[:, :CLOSE]
    own = d[rows, near]
    between = crossed(own[:, :, None] - own[:, None, :], apart[near[:, :, None], near[:, None, :]])
    far[rows, near] = np.maximum(far[rows, near], between.max(2))
    return home, far**2


def visits(a: np.ndarray, b: np.ndarray, most: float):
    """Multi-sequence traversal: (i, j) of the grid by increasing a[i] + b[j], up to ``most``."""
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[p[0]] + b[q[0]], 0, 0)], {(0, 0)}
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > most:
            return
        yield int(p[i]), int(q[j])
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < len(p) and n < len(q) and (m, n) not in seen:
                seen.add((m, n))
                heapq.heappush(heap, (a[p[m]] + b[q[n]], m, n))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second
        self.apart = [np.sqrt(_distances(b, b)) for b in self.books]

    def halves(self, x: np.ndarray):
        half = x.shape[1] // 2
        return x[:, :half], x[:, half:]

    def home(self, x: np.ndarray) -> np.ndarray:
        i, j = (_distances(h, b).argmin(1) for h, b in zip(self.halves(x), self.books, strict=True))
        return i * len(self.books[1]) + j

    def reach_for(self, x: np.ndarray, cosine: float, recall: float, seed: int = 9) -> float:
        """The traversal's squared distance that holds the share ``recall`` of partners at the threshold, of any kind."""
        if recall >= 1:
            return 2 - 2 * cosine + 1e-9
        rng, half, rows, most = np.random.default_rng(seed), x.shape[1] // 2, np.arange(len(x)), 0.0
        away = [crossings(h, b, a)[1] for h, b, a in zip(self.halves(x), self.books, self.apart, strict=True)]
        for part in (slice(None), slice(None, half), slice(half, None)):
            u = np.zeros_like(x)
            u[:, part] = rng.normal(size=x[:, part].shape)
            inner = np.zeros_like(x)
            inner[:, part] = x[:, part]
            size = np.maximum((inner * inner).sum(1), 1e-12)[:, None]
            u = _unit(u - (u * inner).sum(1)[:, None] / size * inner + 1e-12)
            y = _unit(cosine * x + np.sqrt(1 - cosine**2) * u)
            far = sum(f[rows, _distances(h, b).argmin(1)] for f, h, b in zip(away, self.halves(y), self.books, strict=True))
            most = max(most, float(np.quantile(far, recall)))
        return min(most, 2 - 2 * cosine) + 1e-9

    def places(self, x: np.ndarray, most: float, held: np.ndarray):
        """For each unit vector: the cells it visits, of those that hold any."""
        a, b = (crossings(h, k, s)[1] for h, k, s in zip(self.halves(x), self.books, self.apart, strict=True))
        n = len(self.books[1])
        for k in range(len(x)):
            yield [c for u, v in visits(a[k], b[k], most) if held[c := u * n + v]]


def _homes(grid):
    def run(batches):
        for batch in batches:
            own = grid.value.home(_unit(_matrix(batch.column(2)))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "copies", "v", "cell"])

    return run


def _visited(grid, most: float, held):
    """(id, copies, v, visited) of each class."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                seen = list(grid.value.places(_unit(_matrix(batch.column(2))), most, held.value))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))], names=["id", "copies", "v", "visited"])

    return run


def _linked(cosine: float):
    """Of rows sorted by (cell, i, j): (id, links, root) of the queries and members that link."""

    def block(rows):
        side = np.array([r[0] for r in rows])
        ids, copies = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        x = _unit(np.stack([r[3] for r in rows]).astype(np.float64))
        q, m = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(q) or not len(m):
            return [], [], []
        near = (x[q] @ x[m].T >= cosine) & (ids[q][:, None] < ids[m][None])
        links, other = near @ copies[m], near.T @ copies[q]
        lq, lm = ids[q].copy(), ids[m].copy()
        big = np.iinfo(np.int64).max
        rows_q, rows_m = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows_q, rows_m)]
        lq, lm, iq, im = lq[rows_q], lm[rows_m], ids[q][rows_q], ids[m][rows_m]
        while len(rows_q):  # the smallest id reachable inside the block
            new_m = np.minimum(lm, np.where(near, lq[:, None], big).min(0))
            new_q = np.minimum(lq, np.where(near, new_m[None], big).min(1))
            if (new_m == lm).all() and (new_q == lq).all():
                break
            lq, lm = new_q, new_m
        return np.concatenate((iq, im)), np.concatenate((links[rows_q], other[rows_m])), np.concatenate((lq, lm))

    def run(batches):
        key, rows = None, []

        def out():
            a, b, c = block(rows)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b, c)], names=["id", "links", "root"])

        for batch in batches:
            v = _matrix(batch.column(6))
            for k, r in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if r[:3] != key:
                    if rows:
                        yield out()
                    key, rows = r[:3], []
                rows.append((*r[3:], v[k]))
        if rows:
            yield out()

    return run


def near_duplicates(table: DataFrame, cosine: float = COSINE, books: int | None = None, fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every vector of ``table(vec_id, embedding)``.

    ``books``: centroids a half; by default they grow with the root of the vectors' number.
    """
    spark = table.sparkSession
    kind = table.schema["embedding"].dataType.simpleString()
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("v").isNotNull() & (F.size("v") > 1) & ~bad & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("embedding"))
    rows = rows.select("vec_id", "v", F.coalesce(good, F.lit(False)).alias("good"))
    usual = rows.where("good").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fit = F.col("good") & (F.size("v") == usual[0])
    rows = written(rows.select("vec_id", "v", fit.alias("good"), F.when(fit, F.sha2(F.col("v").cast("string"), 256)).alias("same")), "vectors")

    classes = rows.where("good").groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    n = classes.count()
    books = books or min(MOST_BOOKS, max(8, round((n / PER_CELL) ** 0.5)))
    share = max(fit_rows, FIT_EACH * books) / n
    sample = classes if share >= 1 else classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about that many
    sample = np.array([r[1] for r in sorted(sample.select("id", "v").collect())], np.float64)
    x = _unit(sample)
    half = x.shape[1] // 2
    grid = Grid(train_book(x[:, :half], books), train_book(x[:, half:], books))
    most = grid.reach_for(x, cosine, recall)
    cells = len(grid.books[0]) * len(grid.books[1])
    grid = spark.sparkContext.broadcast(grid)

    homes = written(classes.select("id", "copies", "v").mapInArrow(_homes(grid), f"id long, copies long, v {kind}, cell int"), "vector-homes")
    members = written(homes.groupBy("cell").agg(F.count("*").alias("m")), "cell-members")
    held = np.zeros(cells, bool)
    held[members.select("cell").toArrow().column(0).to_numpy()] = True  # a row for each cell at most
    held = spark.sparkContext.broadcast(held)
    asked = written(homes.select("id", "copies", "v").mapInArrow(_visited(grid, most, held), f"id long, copies long, v {kind}, visited array<int>"), "vector-visits")
    queries = asked.select(F.explode("visited").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    cuts = members.join(queries.hint("shuffle_merge"), "cell", "left").select("cell", F.expr(f"cast(ceil(m / {MEMBERS}) as int)").alias("mi"), F.expr(f"cast(ceil(coalesce(q, 1) / {QUERIES}) as int)").alias("qj"))
    cuts = written(cuts.where("mi > 1 or qj > 1"), "cells-of-blocks")
    cuts = F.broadcast(cuts) if cuts.count() <= SENT_CELLS else cuts.hint("shuffle_merge")
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    one = F.lit(1)
    own = homes.join(cuts, "cell", "left").select(
        "cell", F.pmod(spread, F.coalesce("mi", one)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.coalesce("qj", one) - 1)).alias("j"), F.lit(0).alias("side"), "id", "copies", "v"
    )
    asked = asked.select(F.explode("visited").alias("cell"), "id", "copies", "v").join(cuts, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0), F.coalesce("mi", one) - 1)).alias("i"), F.pmod(spread, F.coalesce("qj", one)).cast("int").alias("j"), F.lit(1).alias("side"), "id", "copies", "v"
    )
    dealt = own.unionByName(asked).repartition(partitions_for(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = written(dealt.mapInArrow(_linked(cosine), "id long, links long, root long").groupBy("id", "root").agg(F.sum("links").alias("links")), "vector-links")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("same", "id", "copies").join(links.hint("shuffle_merge"), "id", "left")
    named = named.join(comps.select(F.col("node").alias("id"), "root").hint("shuffle_merge"), "id", "left")
    named = written(named.select("same", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "id").alias("c")), "vector-classes-named")
    out = rows.join(named.hint("shuffle_merge"), "same", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
