"""Toxicity: gradient-boosted trees over dense lexical features, with isotonic calibration.

Learning. A bounded sample of labelled rows (``most``, taken in hash order) is
split in three by hash. The first part gives the lexicon: word beginnings and whole
words that toxic rows hold far more often than others, found by counting
documents. The second trains the boosted trees, the third calibrates their
probability with isotonic regression. Labels only ever come in here.

Features of a whole text: lexicon hits, distinct hits and weight by words; hits
near a second-person word; hits under masked spelling (digits or signs for
letters); capital letters, all-capital words, exclamation and question marks,
masked words; number of words.

Scoring runs over all documents without a shuffle; the model and the lexicon (at
most ``TERMS`` entries) go out with the tasks. Only texts go to the Python workers
and only ten numbers come back.

Defined results. Null or word-less texts have features of 0 and the score the
model gives those. With labels of only one kind, or none, every score is the share of
toxic labels (0 without labels). Repeated labels of a document count as toxic if any does;
null labels don't count. Repeated documents are scored each; equal texts get equal scores.
A very long text is read whole, its words one array. Tables without rows give none. Columns
beside doc_id and text are ignored (``without_toxic`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import written
from lorespark.llm.memo import Memo, held

MOST = 9000
TERMS = 400
LEAST = 20  # labels of a kind in each of three parts, else the sample isn't split
FEATURES = ["hit_rate", "hit_kinds", "hit_weight", "near_you", "masked_hits", "capitals", "shouted", "marks", "masked", "log_words"]

#: Second-person words of the languages at hand, and letters that signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu tus te ti usted ustedes vos vosotros os "
    "toi ton ta tes vous votre vos lei voi você vocês ты тебя вы вас".split()
)
MASKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MASKED = re.compile(r"[a-zA-Z][0-9@$!|+*#]+[a-zA-Z]")


def terms_of(word: str) -> list[str]:
    """What a lower-cased word may be listed under: itself, and its beginnings with a trailing star."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


def _term_counts(batches):
    """(term, toxic documents, other documents) of a task's share of the sample."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in {t for w in {c.strip(_EDGE).lower() for c in (text or "").split()} if w for t in terms_of(w)}:
                counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
    terms = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([counts[t][0] for t in terms], pa.int64()), pa.array([counts[t][1] for t in terms], pa.int64())],
        names=["term", "toxic", "other"],
    )


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Terms with their log odds, from ``sample(text, toxic)``: at most ``terms``, by evidence."""
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    c = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, other long")
    c = c.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.1) / (bad + 0.2)) - F.log((F.col("other") + 0.1) / (good + 0.2))
    c = c.where(F.col("toxic") >= max(3, bad // 200)).withColumn("odds", odds).where(f"odds > {math.log(8)}")
    return {r[0]: r[1] for r in c.orderBy(F.desc(F.expr("odds * sqrt(toxic)")), "term").limit(terms).select("term", "odds").collect()}


WIDE = 255  # letters of a chunk up to which every count has room in its code


class Reader:
    """Features of a text, from codes that pack what each chunk holds."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.numbers = {t: k + 1 for k, t in enumerate(lexicon)}
        self.memo = Memo(self._code)

    def _look(self, word: str) -> tuple[float, int]:
        found = [t for t in terms_of(word) if t in self.lexicon]
        return max(((self.lexicon[t], self.numbers[t]) for t in found), default=(0.0, 0))

    def _code(self, chunk: str) -> int:
        """Bits: 0 hit, 1 second person, 2 shouted, 3 masked, 4 masked hit; 8-15 weight * 16, 16-31 term, 32-43 capitals, 44-51 marks, 52-62 letters."""
        core = chunk.strip(_EDGE)
        word = core.lower()
        weight, number = self._look(word) if word else (0.0, 0)
        masked = bool(_MASKED.search(core))
        code = (number > 0) | (word in SECOND_PERSON) << 1 | (len(core) > 2 and core.isupper()) << 2 | masked << 3
        if masked and not number:
            weight, number = self._look("".join(c for c in word.translate(MASKS) if c.isalpha()))
            code |= (number > 0) << 4 | (number > 0)
        marks = chunk.count("!") + chunk.count("?")
        capitals = sum(map(str.isupper, core)) if core != word else 0
        return code | min(255, int(weight * 16)) << 8 | number << 16 | min(4095, capitals) << 32 | min(255, marks) << 44 | min(2047, len(core)) << 52

    def features(self, text: str | None) -> list[float]:
        chunks = (text or "").split()
        if not chunks:
            return [0.0] * len(FEATURES)
        v = np.array(self.memo.codes(chunks), np.int64)
        n = len(v)
        hit = np.flatnonzero(v & 1)
        near = 0
        if len(hit):
            you = np.concatenate(([0], np.cumsum((v >> 1) & 1)))
            near = int((you[np.minimum(hit + 6, n)] > you[np.maximum(hit - 5, 0)]).sum())
        letters, capitals, marks = int((v >> 52).sum()), int(((v >> 32) & 0xFFF).sum()), int(((v >> 44) & 0xFF).sum())
        for c in chunks:
            if len(c) > WIDE:  # what its code has no room for
                core, signs = c.strip(_EDGE), c.count("!") + c.count("?")
                shown = sum(map(str.isupper, core)) if core != core.lower() else 0
                letters, capitals, marks = letters + max(0, len(core) - 2047), capitals + max(0, shown - 4095), marks + max(0, signs - 255)
        letters = max(1, letters)
        return [
            100.0 * len(hit) / n,
            float(len(np.unique((v[hit] >> 16) & 0xFFFF))),
            float(((v[hit] >> 8) & 0xFF).sum()) / 16 / math.sqrt(n),
            100.0 * near / n,
            100.0 * int(((v >> 4) & 1).sum()) / n,
            capitals / letters,
            int(((v >> 2) & 1).sum()) / n,
            marks / n,
            int(((v >> 3) & 1).sum()) / n,
            math.log1p(n),
        ]


def features_of(lexicon: dict[str, float]):
    """A column function: text to its features. Only the text goes to the Python worker; the row stays in the JVM."""
    key = "toxicity", hash(tuple(sorted(lexicon.items())))

    def run(texts):
        reader = held(key, lambda: Reader(lexicon))
        rows = np.array([reader.features(t.as_py()) for t in texts], np.float64).reshape(-1)
        return pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, len(FEATURES), dtype=np.int32), pa.array(rows))

    # evaluated once a row, however many columns are made of it
    return F.arrow_udf(run, "array<double>").asNondeterministic()


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text", into: str = "features") -> DataFrame:
    """``docs`` with the features of ``text`` as a vector."""
    return docs.withColumn(into, array_to_vector(features_of(lexicon)(F.col(text).cast("string"))))


class ToxicityModel:
    """A lexicon, boosted trees and their calibration; or one constant score."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, prefix: str = "") -> DataFrame:
        """``docs`` with ``score`` and ``predicted``, whose names begin with ``prefix``; other names stay as they are."""
        if self.trees is None:
            x = docs.withColumn(prefix + "score", F.lit(float(self.constant)))
        else:
            own = {c: f"{prefix}toxicity_{c}" for c in ("features", "raw", "both", "label", "p", "calibrated")}
            x = with_features(docs, self.lexicon, into=own["features"])
            trees = self.trees.copy().setFeaturesCol(own["features"]).setRawPredictionCol(own["raw"]).setProbabilityCol(own["both"]).setPredictionCol(own["label"])
            x = trees.transform(x).withColumn(own["p"], vector_to_array(own["both"])[1])
            x = self.calibration.copy().setFeaturesCol(own["p"]).setPredictionCol(own["calibrated"]).transform(x)
            # the trees' own probability orders what the calibration ties
            x = x.withColumn(prefix + "score", F.expr(f"least(1D, greatest(0D, 0.98D * {own['calibrated']} + 0.02D * {own['p']}))")).drop(*own.values())
        return x.withColumn(prefix + "predicted", (F.col(prefix + "score") >= 0.5).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> ToxicityModel:
    """A model from at most ``most`` rows of ``labels(doc_id, toxic)`` and their texts in ``docs``."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)  # the bounded sample
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = text.join(F.broadcast(own), "doc_id").select("doc_id", F.col("text").cast("string"), F.expr("if(toxic > 0, 1, 0)").alias("toxic"), F.pmod("h", F.lit(3)).alias("part"))
    sample = written(sample, "labelled-sample").repartition(4, "doc_id")
    kinds = {(r[0], r[1]): r[2] for r in sample.groupBy("part", "toxic").count().collect()}
    total = sum(kinds.values())
    toxic = sum(v for k, v in kinds.items() if k[1])
    if toxic in (0, total):
        return ToxicityModel(constant=toxic / total if total else 0.0)
    # with too few labels for three parts, all of them serve for each step
    apart = all(kinds.get((k, t), 0) >= LEAST for k in range(3) for t in (0, 1))
    words, fit, rest = (f"part = {k}" if apart else "true" for k in range(3))
    lexicon = learn_lexicon(sample.where(words))
    x = written(with_features(sample, lexicon).select("doc_id", "part", "features", F.col("toxic").cast("double").alias("label")), "labelled-features")
    trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, seed=7, maxMemoryInMB=64).fit(x.where(fit).coalesce(2))
    scored = trees.transform(x.where(rest)).select("label", vector_to_array("probability")[1].alias("p")).coalesce(1)
    calibration = IsotonicRegression(featuresCol="p", predictionCol="calibrated", labelCol="label").fit(scored)
    return ToxicityModel(lexicon, trees, calibration)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = MOST) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; labels of held-out rows aren't used."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = learn(docs, labels.where(fold != 0), most)
    x = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return x.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = MOST) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = learn(docs, labels.where(fold != 0), most)
    prefix = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins like this
    return model.score(docs, prefix).where(F.col(prefix + "predicted") == 0).select(*docs.columns)
