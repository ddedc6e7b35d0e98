"""Language identification of mixed text: script ranges, word scores, and Viterbi over the words.

Learning. From a bounded sample of labelled texts (about ``most``
for each language, drawn by hash) come, for each language, log probabilities of its commonest
``TRIGRAMS`` character trigrams and the share of its words in each script.

Prediction. The script of most of a word's letters leaves those languages as candidates that were seen
to use it (all, if none was). Its score in each is the sum of its trigrams'. A
Viterbi path over the words, with a penalty for switching, labels spans. The
documents of a block advance through the path together, so a step is one
vectorised operation. The text's language is that of most letters.

Defined results. Null text, or text without a letter: ``und``, score 0, no spans.
A language without usable training text is never predicted; without any, all is
``und``. Repeated rows are predicted each. Ties go to the alphabetically first
language. A very long text has one exact path, of which a few bytes a word and a bit for each
label are held. An empty table gives no rows. Columns beside doc_id, lang and text are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lorespark.llm.common import written
from lorespark.llm.memo import Memo, held

MOST = 1500
SWITCH = 9.0
CELLS = 600_000
TRIGRAMS = 50_000  # of each language
_SPANS_DDL = ArrayType(StructType().add("first", "integer").add("last", "integer").add("lang", "string"))
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

#: Starts of the Unicode ranges told apart, and the script of each.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letter: str) -> str:
    k = bisect.bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPTS[k][1] if k >= 0 else "other"


def script_in(word: str) -> str:
    """The script of most letters of a word; of equal ones the first."""
    own = [script_of(c) for c in word]
    return own[0] if own.count(own[0]) == len(own) else max(own, key=own.count)


def letters_of(chunk: str) -> str:
    return chunk.lower() if chunk.isalpha() else "".join(filter(str.isalpha, chunk)).lower()


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def _counts(batches):
    """(lang, kind, item, n): trigrams and scripts of a task's share of the sample."""
    counts: dict[tuple, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words: dict[str, int] = {}
            for c in (text or "").split():
                words[c] = words.get(c, 0) + 1
            for c, n in words.items():
                if w := letters_of(c):
                    for t in trigrams(w):
                        counts[lang, 0, t] = counts.get((lang, 0, t), 0) + n
                    k = (lang, 1, script_in(w))
                    counts[k] = counts.get(k, 0) + n
    rows = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))] + [pa.array([counts[r] for r in rows], pa.int64())],
        names=["lang", "kind", "item", "n"],
    )


class LanguageModel:
    """Trigram log probabilities and scripts of each language."""

    def __init__(self, rows: list[tuple[str, int, str, int]], least_share: float = 0.01):
        self.langs = sorted({r[0] for r in rows if r[1] == 0})
        at = {x: k for k, x in enumerate(self.langs)}
        total = np.zeros(len(at))
        self.grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, kind, item, n in rows:
            if lang in at:
                (scripts if kind else self.grams).setdefault(item, np.zeros(len(at)))[at[lang]] += n
                total[at[lang]] += n * (kind == 0)
        vocabulary = len(self.grams) + 1
        self.unseen = -np.log(total * 2 + vocabulary)
        for item, n in self.grams.items():
            self.grams[item] = np.log(n * 2 + 1) + self.unseen
        words = sum(scripts.values()) if scripts else 1
        self.barred = {s: np.where(n >= least_share * words, 0.0, -1e4) for s, n in scripts.items()}
        self.barred = {s: b for s, b in self.barred.items() if (b == 0).any()}

    def score(self, word: str) -> np.ndarray:
        out = self.barred.get(script_in(word))
        out = np.zeros(len(self.langs)) if out is None else out.copy()
        get, unseen = self.grams.get, self.unseen
        for t in trigrams(word):
            out += get(t, unseen)
        return out


class Labeller:
    """Word scores kept in one growing table, whose rows the memo's codes name; row 0 is for no letters."""

    def __init__(self, model: LanguageModel, most: int = 250_000):
        self.model, self.most = model, most
        self._fresh()

    def _fresh(self):
        self.memo = Memo(self._learn, self.most)
        self.table = np.zeros((1 << 16, len(self.model.langs)), np.float32)
        self.length = np.zeros(1 << 16, np.int32)
        self.used = 1

    def _learn(self, chunk: str) -> int:
        w = letters_of(chunk)
        if not w:
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        self.table[self.used] = self.model.score(w)
        self.length[self.used] = len(w)
        self.used += 1
        return self.used - 1

    def rows(self, chunks: list[str]) -> np.ndarray:
        return np.array(self.memo.codes(chunks), np.int64)

    def block(self, lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of chunks: the label of each chunk, and each chunk's letters."""
        if self.used > 4 * self.most:
            self._fresh()
        codes = [self.rows(x) for x in lists]
        paths = viterbi(codes, self.table, SWITCH)
        return [(p, self.length[c]) for p, c in zip(paths, codes, strict=True)]


def viterbi(codes: list[np.ndarray], table: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best label paths of several sequences of rows of ``table`` at once; ``penalty`` is what a switch costs.

    A step keeps for each sequence its best label so far and, in one bit for each label, whether
    that label stays: all that the way back needs, however many labels and words there are.
    """
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    lens = np.array([len(codes[k]) for k in order], np.int64)
    if not len(lens) or not lens[0]:
        return [np.zeros(0, np.int64) for _ in codes]
    flat = np.concatenate([codes[k] for k in order])
    start = np.concatenate(([0], np.cumsum(lens)[:-1]))
    active = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # how many are longer than t
    labels = table.shape[1]
    came = np.zeros(len(flat), np.int32)
    stays = np.zeros((len(flat), (labels + 7) // 8), np.uint8)
    last = np.zeros((len(lens), labels))
    v = table[flat[start[: active[0]]]].astype(np.float64)
    for t in range(1, lens[0]):
        k = active[t]
        last[k : len(v)] = v[k:]
        v = v[:k]
        at = start[:k] + t
        came[at] = v.argmax(1)
        switched = v.max(1)[:, None] - penalty
        stays[at] = np.packbits(v >= switched, axis=1)
        v = np.maximum(v, switched) + table[flat[at]]
    last[: len(v)] = v
    state = last.argmax(1)
    path = np.zeros(len(flat), np.int64)
    for t in range(lens[0] - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = own = state[:k]
        if t:
            stay = stays[at, own >> 3] >> (7 - (own & 7)) & 1
            state[:k] = np.where(stay, own, came[at])
    out: list = [None] * len(codes)
    for k, i, n in zip(order, start.tolist(), lens.tolist(), strict=True):
        out[k] = path[i : i + n]
    return out


def learn(docs: DataFrame, most: int = MOST) -> LanguageModel:
    """A model from about ``most`` texts of each language of ``docs(doc_id, lang, text)``; it has a row for each language."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where("lang is not null and text is not null")
    sizes = own.groupBy("lang").count().collect()  # the model's labels
    if not sizes:
        return LanguageModel([])
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(1.0, most / r[1])))])
    drawn = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    counts = drawn.select("lang", "text").mapInArrow(_counts, "lang string, kind int, item string, n long")
    counts = written(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "trigram-counts")
    # rare trigrams say little: the commonest of each language are the model
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = counts.withColumn("r", rank).where((F.col("kind") == 1) | (F.col("r") <= TRIGRAMS)).drop("r")
    return LanguageModel([tuple(r) for r in top.collect()])


def predicted(docs: DataFrame, model: LanguageModel, extra: list[str]) -> DataFrame:
    """The ``extra`` columns of ``docs``, lang_pred, score and spans (first and last chunk, language)."""
    key = "languages", hash((tuple(model.langs), len(model.grams), float(model.unseen.sum()) if model.langs else 0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(path, letters, langs):
        n = np.bincount(path, weights=letters, minlength=len(langs)) if len(path) else np.zeros(len(langs))
        if not n.sum():
            return "und", 0.0, []
        cut = np.flatnonzero(np.diff(path)) + 1
        first, end = np.concatenate(([0], cut)), np.append(cut, len(path))
        spans = [{"first": int(a), "last": int(b) - 1, "lang": langs[path[a]]} for a, b in zip(first, end, strict=True)]
        return langs[int(n.argmax())], float(n.max() / n.sum()), spans

    def run(batches):
        own = held(key, lambda: Labeller(sent.value))
        langs = own.model.langs
        for batch in batches:
            texts, lists, cells = batch.column(0), [], 0
            out = []
            for k in range(batch.num_rows):
                lists.append((texts[k].as_py() or "").split() if langs else [])
                cells += len(lists[-1])
                if cells >= CELLS or k == batch.num_rows - 1:
                    out += [judged(p, n, langs) for p, n in own.block(lists)]
                    lists, cells = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], _SPANS)],
                names=[*extra, "lang_pred", "score", "spans"],
            )

    schema = docs.select(*extra).schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("spans", _SPANS_DDL)
    return docs.select(F.col("text").cast("string").alias("own_text"), *extra).mapInArrow(run, schema)


def identified(docs: DataFrame, folds: int = 4, held: int = 2, most: int = MOST) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, n_spans; held-out languages aren't used."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = learn(docs.where(fold != held), most)
    x = predicted(docs, model, ["doc_id"])
    return x.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
