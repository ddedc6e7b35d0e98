"""Benchmark decontamination: a broadcast hash set of normalised n-grams against every training window.

Words are runs of a-z, 0-9 and characters above 0x7F after lower-casing A-Z. A
window is ``width`` consecutive words of a benchmark item, or the whole item if
it is shorter. Each task maps document words to the benchmark vocabulary,
hashes only windows made of such words, and verifies each hit word by word.

The set is broadcast only up to ``most`` windows, counted first, held in arrays of about
``BYTES`` each; a larger benchmark is dealt into slices, counted to hold no more, by window and
item, so that a window of very many items goes to many; each is scanned in turn, and the hits of all slices are merged by row: the documents are numbered in a
written table before, so rows that repeat an id, or have none, stay rows. One slice or many,
the results are the same.

Defined results. Null text has no words. Items without words, text or id match
nothing; repeated items count once. Empty tables give no rows, or no hits. A very long text
is scanned whole. Rows that repeat an id are judged each. A word inside two windows is hit
once. Extra columns are ignored (``clean`` keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import written
from lorespark.llm.memo import let_go

WIDTH = 10
MOST = 400_000  # windows broadcast at a time
BYTES = 200  # a window's ids, hash, item and share of the vocabulary: 80 MB a slice
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words; byte-wise, since all separators are ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _item_windows(width: int):
    def run(batches):
        for batch in batches:
            ids, grams = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                span = min(width, len(words))
                for k in range(len(words) - span + 1 if span else 0):
                    ids.append(item)
                    grams.append(b" ".join(words[k : k + span]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.binary())], names=["item", "gram"])

    return run


class WindowSet:
    """Windows as rows of vocabulary ids, by length and sorted by hash, and each one's items: about ``BYTES`` a window."""

    def __init__(self, table: pa.Table):
        """``table(item, gram)``: distinct rows."""
        self.vocab: dict[bytes, int] = {}
        names, items = np.unique(table.column("item").to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if table.num_rows else ([], np.zeros(0, np.int64))
        self.names = [str(x) for x in names]
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, tuple[list, list]] = {}
        number = self.vocab.setdefault
        for item, gram in zip(items.tolist(), table.column("gram"), strict=True):
            words = gram.as_py().split(b" ")
            ids, own = rows.setdefault(len(words), ([], []))
            ids.append(np.array([number(w, len(self.vocab) + 1) for w in words], np.uint32))
            own.append(item)
        for n, (ids, own) in rows.items():
            x, of = np.stack(ids), np.array(own, np.int32)
            h = self.rolled(x.T.astype(np.uint64))
            order = np.argsort(h, kind="stable")
            self.by[n] = h[order], x[order], of[order]

    @staticmethod
    def rolled(columns) -> np.ndarray:
        """A hash of each window, given its columns (word 0 of all, word 1 of all, ...)."""
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c) * _MUL
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of the hit words, and the items that hit."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        mask, found = np.zeros(len(ids), bool), set()
        gap = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, (known, rows, of) in self.by.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(gap[n:] == gap[: len(gap) - n])
            if not len(at):
                continue
            h = self.rolled([ids[at + k] for k in range(n)])
            first, end = np.searchsorted(known, h), np.searchsorted(known, h, "right")
            for k in np.flatnonzero(first < end).tolist():
                p = int(at[k])
                same = (rows[first[k] : end[k]] == ids[p : p + n].astype(np.uint32)).all(1)  # word by word
                if same.any():
                    mask[p : p + n] = True
                    found.update(of[first[k] : end[k]][same].tolist())
        return np.flatnonzero(mask), {self.names[k] for k in found}


def _scan(windows):
    def run(batches):
        let_go()
        own = windows.value
        for batch in batches:
            ns, at, items = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hit, found = own.hits(words) if words else (np.zeros(0, np.int64), set())
                ns.append(len(words))
                at.append(hit.tolist())
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hit_at", "items"],
            )

    return run


def _sliced(benchmark: DataFrame, width: int, most: int):
    """The benchmark's distinct (window, item) rows in broadcast sets of ``most`` at the most; at least one set."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).where("item is not null")
    grams = written(items.mapInArrow(_item_windows(width), "item string, gram binary").distinct(), "benchmark-windows")
    slices = max(1, -(-grams.count() // most))
    part = lambda n: F.pmod(F.xxhash64("gram", "item"), F.lit(n))
    while slices > 1 and grams.groupBy(part(slices)).count().agg(F.max("count")).first()[0] > most:
        slices += -(-slices // 4)
    for k in range(slices):
        own = grams.where(part(slices) == k) if slices > 1 else grams
        yield slices, spark.sparkContext.broadcast(WindowSet(own.toArrow()))


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Rows (doc_id, n_words, hit_at, items): positions of hit words and sorted item ids as strings."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, n_words long, hit_at array<int>, items array<string>"
    out = []
    for slices, windows in _sliced(benchmark, width, most):
        if slices == 1:
            return docs.mapInArrow(_scan(windows), kind)
        if not out:
            numbered, row = _numbered(docs)
        out.append(numbered.select(F.col(row).alias("doc_id"), "text").mapInArrow(_scan(windows), kind))
    parts = reduce(DataFrame.unionByName, out)
    merged = parts.groupBy(F.col("doc_id").alias(row)).agg(F.max("n_words").alias("n_words"), _all("hit_at"), _all("items"))
    return numbered.select(row, "doc_id").join(merged.hint("shuffle_merge"), row).select("doc_id", "n_words", "hit_at", "items")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number, in a column that none of theirs clashes with."""
    row = "_" * max(map(len, docs.columns)) + "_row"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _all(column: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the item ids."""
    hits = window_hits(docs, benchmark, width, most)
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_at").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_at") > 0).alias("contaminated"),
        "items",
    )


def without_spans(text: str | None, hit: list[int]) -> str | None:
    """The text without its runs of hit words."""
    if not hit:
        return text
    hits, cut, out, last = set(hit), 0, [], False
    for k, m in enumerate(_WORD.finditer(text.translate(_LOWER))):
        if k in hits:
            if not last:
                out.append(text[cut : m.start()])
            cut = m.end()
        last = k in hits
    return "".join([*out, text[cut:]])


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, most: int = MOST) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the hit spans; all columns stay.

    A broadcast scan drops rows, or spans of a single slice, in place. With several
    slices, spans are removed when the hits of all slices on the whole text are known.
    """
    column, columns, schema = docs.columns.index("text"), docs.columns, docs.schema
    out: list[DataFrame] = []
    for slices, windows in _sliced(benchmark, width, most):
        if remove == "spans" and slices > 1:
            if not out:
                docs, row = _numbered(docs)
            hits = docs.select(F.col(row).alias("doc_id"), F.col("text").cast("string")).mapInArrow(_scan(windows), "doc_id long, n_words long, hit_at array<int>, items array<string>")
            out.append(hits.where(F.size("hit_at") > 0).select(F.col("doc_id").alias(row), "hit_at"))
            continue

        def run(batches, windows=windows):
            let_go()
            own = windows.value
            for batch in batches:
                texts = batch.column(column).to_pylist()
                hits = [own.hits(w)[0].tolist() if (w := words_of(t)) else [] for t in texts]
                if remove == "spans":
                    new = pa.array([without_spans(t, h) for t, h in zip(texts, hits, strict=True)], batch.schema.field(column).type)
                    yield batch.set_column(column, batch.schema.field(column), new)
                else:
                    yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    if not out:
        return docs
    hits = reduce(DataFrame.unionByName, out).groupBy(row).agg(_all("hit_at").alias(row + "_at"))

    def cut(batches):
        for batch in batches:
            texts, at = batch.column(column).to_pylist(), batch.column(len(columns)).to_pylist()
            new = pa.array([without_spans(t, h or []) for t, h in zip(texts, at, strict=True)], batch.schema.field(column).type)
            yield batch.set_column(column, batch.schema.field(column), new).select(list(range(len(columns))))

    return docs.join(hits.hint("shuffle_merge"), row, "left").select(*columns, row + "_at").mapInArrow(cut, schema)
