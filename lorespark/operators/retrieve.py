"""Ranking chunks for tables of questions, contexts around them, and how well the right ones are found."""

from __future__ import annotations

from bisect import insort

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.scalars import base_name, tokens
from lorespark.operators.requests import history_window
from lorespark.sources.sinks import written

SENT = 200_000  # rows of a counted table that are broadcast; more are shuffled


def sent(x: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small, else marked for a shuffled join."""
    return F.broadcast(x) if x.count() <= SENT else x.hint("shuffle_merge")


def weighted_tokens(index: DataFrame) -> DataFrame:
    """(chunk_id, tokens, weights): all postings of a chunk in its own row; a token counts 3 in the topic, 2 in triggers, 1 in the summary. No shuffle. What has been worked out so stays as it is."""
    if {"tokens", "weights"} <= set(index.columns):
        return index.select("chunk_id", "tokens", "weights")
    x = index.select("chunk_id", tokens(F.col("topic")).alias("a"), tokens(F.array_join("triggers", " ")).alias("b"), tokens(F.col("summary")).alias("c"))
    parts = [F.coalesce(c, F.array().cast("array<string>")) for c in ("a", "b", "c")]
    weight = lambda c, w: F.transform(c, lambda t: F.lit(w))
    return x.select("chunk_id", F.concat(*parts).alias("tokens"), F.concat(*(weight(c, w) for c, w in zip(parts, (3, 2, 1), strict=True))).alias("weights"))


ASKED = 1_000_000  # rows (question, token) that a task holds
CELLS = 2_000_000  # scores that it holds at once
FREQUENT = 512  # tokens at most whose scores come from a product of matrices
DENSE = 0.004  # the share of pairs of questions and chunks that have a token from which that is cheaper
NEAR = 1e-4  # more than single precision can be off, as a share


class Asked:
    """Questions' weighted tokens, by token: what a task scores chunks with.

    Scores are first worked out in single precision, for frequent tokens as a product of matrices, for the others token by token;
    pairs that may reach a question's places are then scored in double precision.
    """

    def __init__(self, rows: pa.Table):
        self.questions = pc.unique(rows.column("qid"))
        n = len(self.questions)
        tokens = rows.column("token").combine_chunks().dictionary_encode()
        self.words = tokens.dictionary
        key = tokens.indices.to_numpy().astype(np.int64) * n + pc.index_in(rows.column("qid"), self.questions).to_numpy()
        order = np.argsort(key, kind="stable")
        self.keys, self.idf = key[order], rows.column("idf").to_numpy()[order]
        word, self.question = self.keys // n, (self.keys % n).astype(np.int32)
        many = np.bincount(word, minlength=len(self.words))
        self.start = np.concatenate(([0], np.cumsum(many)))
        self.by_word = self.idf[self.start[:-1]]  # a token weighs the same for all that ask it
        pairs = many / n / np.maximum(np.expm1(self.by_word), 1e-300)  # idf is log(1 + chunks / df)
        often = np.argsort(-pairs, kind="stable")[:FREQUENT]
        often = often[pairs[often] > DENSE]
        self.column = np.full(len(self.words), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        dense = self.column[word] >= 0
        self.matrix[self.column[word[dense]], self.question[dense]] = self.idf[dense]

    def scored(self, tokens: pa.ListArray, weights: pa.ListArray) -> "Scored":
        return Scored(self, tokens, weights)

    def scores(self, tokens: pa.ListArray, weights: pa.ListArray) -> np.ndarray:
        """A row a chunk, a column a question, in double precision."""
        n = len(self.questions)
        row, question = (x.ravel() for x in np.indices((len(tokens), n)))
        return Scored(self, tokens, weights).exact(row, question).reshape(len(tokens), n)


class Scored:
    """A block of chunks against all questions; whole columns at once, since a Python step a token is most of the cost."""

    def __init__(self, asked: Asked, tokens: pa.ListArray, weights: pa.ListArray):
        self.asked, self.rows = asked, len(tokens)
        found = pc.index_in(tokens.flatten(), value_set=asked.words)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        self.row = np.repeat(np.arange(self.rows), pc.list_value_length(tokens).to_numpy())[at]
        self.word, self.weight = found.drop_null().to_numpy(), weights.flatten().to_numpy()[at]

    def about(self) -> np.ndarray:
        """A row a chunk, a column a question, to within ``NEAR``; 0 only where nothing is in common."""
        a, n = self.asked, len(self.asked.questions)
        column, wide = a.column[self.word], len(a.matrix)
        dense = column >= 0
        out = np.bincount(self.row[dense] * wide + column[dense], self.weight[dense], self.rows * wide).reshape(self.rows, wide).astype(np.float32) @ a.matrix
        row, word, weight = self.row[~dense], self.word[~dense], self.weight[~dense]
        many = a.start[word + 1] - a.start[word]
        ends = np.cumsum(many)
        entry = np.arange(many.sum()) + np.repeat(a.start[word] - (ends - many), many)
        out += np.bincount(np.repeat(row * n, many) + a.question[entry], np.repeat(weight, many) * a.idf[entry], self.rows * n).reshape(self.rows, n)
        return out

    def exact(self, row: np.ndarray, question: np.ndarray) -> np.ndarray:
        """The scores of these pairs in double precision."""
        a, out = self.asked, [np.zeros(0)]
        start = np.searchsorted(self.row, np.arange(self.rows + 1))
        for k in range(0, len(row), 10_000):
            r, q = row[k : k + 10_000], question[k : k + 10_000]
            many = start[r + 1] - start[r]
            ends = np.cumsum(many)
            entry = np.arange(many.sum()) + np.repeat(start[r] - (ends - many), many)
            word, asker = self.word[entry], np.repeat(q, many)
            column = a.column[word]
            has = column >= 0
            rare = np.flatnonzero(~has)
            has[has] = a.matrix[column[has], asker[has]] > 0
            key = word[rare].astype(np.int64) * len(a.questions) + asker[rare]
            has[rare] = a.keys[np.minimum(np.searchsorted(a.keys, key), len(a.keys) - 1)] == key
            out.append(np.bincount(np.repeat(np.arange(len(r)), many), self.weight[entry] * np.where(has, a.by_word[word], 0), len(r)))
        return np.concatenate(out)


def _best_of_task(asked, k: int):
    """(qid, chunk_id, score): for each question the task's k best chunks. What a task holds: scores of one block, k places a question."""

    def run(batches):
        told = asked.value
        n = len(told.questions)
        best: list[list[tuple[float, str]]] = [[] for _ in range(n)]  # (-score, chunk_id), sorted
        least = np.zeros(n)  # the score to reach
        for batch in batches:
            size = max(1, CELLS // n)
            for at in range(0, batch.num_rows, size):
                ids, tokens, weights = batch.slice(at, size).columns
                block = told.scored(tokens, weights)
                score = block.about()
                floor = lambda s: np.maximum(s * (1 - NEAR) - 1e-5, 1e-30).astype(np.float32)
                near = score >= floor(least)
                if len(ids) > k and np.count_nonzero(near) > 4 * k * n:
                    near = score >= floor(np.maximum(least, np.partition(score, len(ids) - k, axis=0)[len(ids) - k]))
                row, question = np.nonzero(near)
                exact = np.floor(block.exact(row, question) * 1e6 + 0.5) / 1e6
                may = exact >= least[question]
                row, question, exact = row[may], question[may], exact[may]
                for q, s, i in zip(question.tolist(), exact.tolist(), ids.take(pa.array(row)).to_pylist(), strict=True):
                    places, new = best[q], (-s, i)
                    if len(places) == k:
                        if new >= places[-1]:
                            continue
                        places.pop()
                    insort(places, new)
                    if len(places) == k:
                        least[q] = -places[-1][0]
        flat = [(q, i, -s) for q, places in enumerate(best) for s, i in places]
        if flat:
            q, i, s = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([told.questions.take(pa.array(q)), pa.array(i, pa.string()), pa.array(s)], names=["qid", "chunk_id", "score"])

    return run


def sliced(rows: DataFrame, key: str, most: int = SENT) -> list[DataFrame]:
    """``rows`` by whole keys in slices of at most ``most`` counted rows (or one key); the number doubles until that holds."""
    total, n = rows.count(), 1
    if total <= most:
        return [rows] if total else []
    n = 1 << (-(-total // most) - 1).bit_length()
    while True:
        part = F.pmod(F.xxhash64(key), F.lit(n))
        got = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(key) != F.max(key))
        if got.where((F.col("n") > most) & F.col(got.columns[2])).isEmpty():
            return [rows.where(part == r["part"]) for r in got.select("part").collect()]  # a row a slice
        n *= 2


def best_of_tasks(asked: DataFrame, index: DataFrame, k: int, most: int = ASKED) -> DataFrame:
    """(qid, chunk_id, score): of every task over ``index``, the k best chunks of each question of the written ``asked(qid, token, idf)``.

    A slice of the questions is broadcast at a time, and the index scanned for it; at most k rows a
    question and task come out.
    """
    spark, kind = index.sparkSession, asked.schema["qid"].dataType.simpleString()
    x, out = weighted_tokens(index), None
    for part in sliced(asked, "qid", most):
        told = spark.sparkContext.broadcast(Asked(part.toArrow()))
        found = x.mapInArrow(_best_of_task(told, k), f"qid {kind}, chunk_id string, score double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"qid {kind}, chunk_id string, score double")


def asked_weights(questions: DataFrame, active: DataFrame) -> DataFrame:
    """(qid, token, idf): the questions' tokens that occur in active chunks, weighted by how rare they are. Written."""
    asked = written(questions.select("qid", F.explode(tokens(F.col("question"))).alias("token")).distinct(), "asked-tokens")
    words = written(asked.select("token").distinct(), "asked-words")
    held = weighted_tokens(active).select(F.explode(F.array_distinct("tokens")).alias("token")).join(sent(words), "token", "left_semi")
    n = active.agg(F.count("*").alias("n_chunks"))  # one row
    df = held.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    weight = F.log(F.lit(1) + F.col("n_chunks") / F.col("df")).alias("idf")
    return written(asked.join(df.hint("shuffle_merge"), "token").select("qid", "token", weight), "asked-weights")


def retrieve(questions: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rank, chunk_id, score): up to k active chunks by inverse-frequency-weighted overlap; ties by id.

    Chunks have ids of their own (``assign_chunk_ids``); questions that repeat a qid are one with
    all their words. Postings are worked out once and written, for the words' weights and the scores. Every task scores its own chunks, each of which holds all its postings, and keeps k places a
    question; only those are shuffled, at most questions x k x tasks rows. A question without a match has no row.
    """
    postings = written(weighted_tokens(index.where("status = 'active'")), "postings")
    x = best_of_tasks(asked_weights(questions, postings), postings, k)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    return x.where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def with_history(turns: DataFrame, n: int = 20) -> DataFrame:
    """(qid, question): of ``turns(conv_id, turn, role, text)``, each conversation's last user turn with the ``n`` messages before it."""
    asked = turns.select("conv_id", "turn", "text").join(history_window(turns, n).hint("shuffle_merge"), ["conv_id", "turn"])
    return asked.groupBy(F.col("conv_id").alias("qid")).agg(F.max_by(F.concat_ws(" ", "text", "history"), "turn").alias("question"))


def retrieve_with_history(turns: DataFrame, index: DataFrame, k: int = 3, n: int = 20) -> DataFrame:
    """``retrieve`` for the last user turn of each conversation, asked together with what was said before."""
    return retrieve(with_history(turns, n), index, k)


def assemble_context(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context): bodies of retrieved chunks in index order, by file; unknown ids are dropped."""
    few = written(retrieved, "retrieved")
    x = chunks.select("chunk_id", "file", "body").join(sent(few), "chunk_id")
    block = F.concat(F.lit("=== Chunk: "), F.col("chunk_id"), F.lit(" ===\n"), F.col("body"))
    parts = F.array_sort(F.collect_list(F.struct("file", block.alias("b"))))
    return x.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("context"))


#: What stands around the chunks that a model gets.
CONTEXT_TITLE = "\n\nRELEVANT CHUNK DOCUMENTATION:\n"
NO_CONTEXT = "No matching chunks found for this query."
MODES = {"clarify": "The user needs clarification. Prefer choices or alert responses.", "answer": "Answer mode. Go directly to steps if documentation supports it."}


def context_block(asked: DataFrame) -> DataFrame:
    """``asked(qid, context, mode)`` with ``block``: the title, the chunks or that there are none, and the mode with what it means."""
    mode = F.coalesce("mode", F.lit("answer"))
    told = F.when(mode == "clarify", MODES["clarify"]).otherwise(MODES["answer"])
    body = F.coalesce(F.nullif("context", F.lit("")), F.lit(NO_CONTEXT))
    return asked.withColumn("block", F.concat(F.lit(CONTEXT_TITLE), body, F.lit("\n\nCURRENT MODE: "), F.upper(mode), F.lit("\n"), told))


def attach_source(retrieved: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """``retrieved`` with ``source``: the file name of ``sources(chunk_id, source)``, else of the chunk's own ``file``."""
    few = written(retrieved, "retrieved")
    own = chunks.select("chunk_id", "file").join(sent(few.select("chunk_id").distinct()), "chunk_id", "left_semi")
    x = few.join(written(own, "retrieved-files").hint("shuffle_merge"), "chunk_id").join(sources.select("chunk_id", "source").hint("shuffle_merge"), "chunk_id", "left")
    return x.withColumn("source", F.coalesce("source", base_name(F.col("file")))).drop("file")


# Evaluation


TEXT_BYTES = 8_000_000  # of items' texts in one automaton


def _holds(told):
    """(item, chunk_id): the items whose whole text a chunk's body holds, each once; one pass over a body for all items."""

    def run(batches):
        searched = ahocorasick.Automaton()
        for item, text in told.value:
            searched.add_word(text, item)
        searched.make_automaton()
        for batch in batches:
            items, ids = [], []
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {item for _, item in searched.iter(body)} if body else ()
                items.extend(found)
                ids.extend([chunk] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.string())], names=["item", "chunk_id"])

    return run


def text_slices(texts: DataFrame, most_bytes: int = TEXT_BYTES) -> list[DataFrame]:
    """The written ``texts(item, text)`` in slices whose counted size is at most ``most_bytes`` (or one text)."""
    size = F.octet_length("text").cast("long")
    total = texts.agg(F.sum(size).alias("n")).first()["n"] or 0
    n = 1
    while total:
        part = F.pmod(F.xxhash64("item"), F.lit(n))
        got = texts.groupBy(part.alias("part")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if got.where((F.col("bytes") > most_bytes) & (F.col("n") > 1)).isEmpty():
            return [texts.where(part == r["part"]) for r in got.select("part").collect()]  # a row a slice
        n *= 2
    return []


def expected_chunks(items: DataFrame, chunks: DataFrame, most_bytes: int = TEXT_BYTES) -> DataFrame:
    """(qid, chunk_id): the ``chunks(chunk_id, body)`` that hold the whole text of ``items(qid, text)``.

    The distinct texts go, in slices of a counted size, into an automaton that finds all of them in one pass over
    a body. Any number and length of items; a null or empty text is in no chunk, as nothing is in a null body.
    """
    spark = chunks.sparkSession
    x = written(items.where("text <> ''").select("qid", "text", F.sha2("text", 256).alias("name")), "items")
    texts = written(x.groupBy("name").agg(F.first("text").alias("text")).withColumn("item", F.monotonically_increasing_id()), "item-texts")
    out = None
    for part in text_slices(texts.select("item", "text"), most_bytes):
        told = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])
        found = chunks.select("chunk_id", "body").mapInArrow(_holds(told), "item long, chunk_id string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return x.select("qid", F.lit(None).cast("string").alias("chunk_id")).limit(0)
    found = written(out, "items-found")
    names = x.select("qid", "name").join(texts.select("item", "name").hint("shuffle_merge"), "name").select("qid", "item")
    return found.join(names.hint("shuffle_merge"), "item").select("qid", "chunk_id")


def retrieval_hits(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``gold(qid, expected)`` with ``got`` and ``hit``: whether any expected id was retrieved."""
    got = retrieved.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("got"))
    empty = F.array().cast("array<string>")
    x = gold.join(got.hint("shuffle_merge"), "qid", "left").withColumn("got", F.coalesce("got", empty)).withColumn("expected", F.coalesce("expected", empty))
    return x.withColumn("hit", F.arrays_overlap("expected", "got"))


def retrieval_score(hits: DataFrame) -> DataFrame:
    """One row: queries, hits, misses, and the share of hits in per cent, half up; null without queries."""
    x = hits.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))
    score = F.floor(F.try_divide(F.col("hits") * 100.0, F.col("queries")) + 0.5).cast("long")
    x = x.select("queries", "hits", (F.col("queries") - F.col("hits")).alias("misses"), score.alias("score"))
    return x.withColumn("band", F.when(F.col("score") == 100, "all").when(F.col("score") >= 80, "most").when(F.col("score").isNotNull(), "low"))


def missed_ids(hits: DataFrame) -> DataFrame:
    """(qid, missed): expected ids that weren't retrieved, of misses."""
    return hits.where("not hit").select("qid", F.array_sort(F.array_except("expected", "got")).alias("missed"))
