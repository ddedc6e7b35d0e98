"""Ranking, gold lookup and relating against brute force, and how many rows they move."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.operators import relate, retrieve

INDEX = "chunk_id string, status string, topic string, triggers array<string>, summary string"


def small_index(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{k:02d}" for k in range(40)]
    rows = [(f"c{k:03d}", rng.choice(["active"] * 5 + ["review"]), " ".join(rng.sample(words, 2)), [" ".join(rng.sample(words, 3)) for _ in range(2)], rng.choice([None, " ".join(rng.sample(words, 4))])) for k in range(n)]
    return rows, spark.createDataFrame(rows, INDEX).repartition(6)


def brute_retrieve(questions, rows, k):
    split = lambda t: list(dict.fromkeys(w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 2))
    post = {i: {} for i, s, *_ in rows if s == "active"}
    for i, s, topic, triggers, summary in rows:
        if s == "active":
            for text, w in ((topic, 3), (" ".join(triggers), 2), (summary, 1)):
                for t in split(text):
                    post[i][t] = post[i].get(t, 0) + w
    df = {}
    for p in post.values():
        for t in p:
            df[t] = df.get(t, 0) + 1
    out = set()
    for q, text in questions:
        scored = sorted(((-round(sum(p[t] * math.log(1 + len(post) / df[t]) for t in split(text) if t in p), 6), i) for i, p in post.items()))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate([x for x in scored if x[0] < 0][:k])}
    return out


def test_retrieve_equals_brute_force(spark):
    rows, index = small_index(spark)
    questions = [(1, "w01 w02 w03"), (2, "W01, nothing"), (3, "absent"), (4, None), (5, "w05 w05 w06 w39 w30 w31")]
    got = {(r.qid, r["rank"], r.chunk_id, r.score) for r in retrieve.retrieve(spark.createDataFrame(questions, "qid long, question string"), index).collect()}
    want = brute_retrieve([(q, t or "") for q, t in questions], rows, 3)
    assert {(q, n, i, round(s, 5)) for q, n, i, s in got} == {(q, n, i, round(s, 5)) for q, n, i, s in want}
    assert retrieve.retrieve(spark.createDataFrame([], "qid long, question string"), index).count() == 0


def test_only_the_best_of_each_task_are_shuffled(spark):
    """At most questions x k x tasks rows, with the questions in one slice or several."""
    _, index = small_index(spark, 400)
    q = spark.createDataFrame([(k, f"w{k:02d} w{k + 1:02d} w{k + 2:02d}") for k in range(30)], "qid long, question string")
    active = index.where("status = 'active'")
    asked = retrieve.asked_weights(q, active)
    tasks = index.rdd.getNumPartitions()
    one = retrieve.best_of_tasks(asked, active, 3)
    assert 30 * 3 <= one.count() <= 30 * 3 * tasks
    cut = retrieve.best_of_tasks(asked, active, 3, most=10)
    assert len(retrieve.sliced(asked, "qid", 10)) > 3 and sorted(map(tuple, cut.collect())) == sorted(map(tuple, one.collect()))


def test_tasks_score_in_blocks():
    """Blocks of one chunk at a time keep the same places as all at once."""
    import pyarrow as pa

    told = type("B", (), {"value": retrieve.Asked(pa.table({"qid": [7, 7, 8], "token": ["a", "b", "a"], "idf": [1.0, 2.0, 1.0]}))})
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{k}" for k in range(9)]), pa.array([["a"], ["b"], ["a", "b"], [], ["x"], ["a"], ["a"], ["b"], ["a"]]), pa.array([[1], [1], [1, 1], [], [5], [3], [1], [1], [1]])], names=["c", "t", "w"])
    whole = retrieve._best_of_task(told, 3)
    rows = sorted(tuple(r.values()) for b in whole([batch]) for r in b.to_pylist())
    single = sorted(tuple(r.values()) for b in whole([batch.slice(k, 1) for k in range(9)]) for r in b.to_pylist())
    assert rows == single == sorted([(7, "c2", 3.0), (7, "c5", 3.0), (7, "c1", 2.0), (8, "c5", 3.0), (8, "c0", 1.0), (8, "c2", 1.0)])


def test_postings_are_worked_out_once(spark, monkeypatch):
    """Word weights and scores read the written postings: no plan but theirs splits the index's texts."""
    plans, write = {}, retrieve.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(retrieve, "written", seen)
    _, index = small_index(spark)
    got = retrieve.retrieve(spark.createDataFrame([(1, "w01 w02")], "qid long, question string"), index)
    assert "split(lower(" in plans["postings"]
    assert "split(lower(" not in plans["asked-weights"] + got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_by_whole_columns():
    """2,000 chunks of 100 tokens: not a Python step for each of the 200,000."""
    import sys

    import pyarrow as pa

    told = retrieve.Asked(pa.table({"qid": [1, 2], "token": ["a", "b"], "idf": [1.0, 2.0]}))
    tokens, weights = pa.array([["a", "x"] * 50] * 1000 + [["b", "y"] * 50] * 1000), pa.array([[1] * 100] * 2000)
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event in ("line", "call")
        return count

    sys.settrace(count)
    try:
        score = told.scores(tokens, weights)
    finally:
        sys.settrace(None)
    assert score[:1000].tolist() == [[50.0, 0.0]] * 1000 and score[1000:].tolist() == [[0.0, 100.0]] * 1000
    assert steps < 2000
    assert told.scores(tokens.slice(5, 0), weights.slice(5, 0)).shape == (0, 2) and told.scores(pa.array([[], ["z"]], pa.list_(pa.string())), pa.array([[], [1]], pa.list_(pa.int32()))).tolist() == [[0.0, 0.0]] * 2


def _chunk_tables(spark, folder, docs, labels=()):
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("most", [200_000, 2])
def test_written_chunks_are_the_chunks(spark, tmp_path, monkeypatch, most):
    """Ids that repeat in a document, copies, a missing source and labels: the rows of ``chunks``, and no body in a shuffle after the cut."""
    from lorespark.plans import derived as D

    page = lambda head, n: f"{head} one two three " + f"word{n} " * 50 + ". more\nlast  \n\u000b\n\n"
    docs = [(k, None if k == 7 else "s", page("same", 1) + "\n" + page("same", k % 3) + "\n" + page("own", k) + "\n" + page("same", 1)) for k in range(1, 12)] + [(20, "s", None), (21, "s", "short")]
    d = _chunk_tables(spark, tmp_path, docs, [(1, 1, 1), (2, 0, 0), (2, 0, 1), (3, 0, 1)])
    plans, write = {}, D.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(D, "written", seen)
    monkeypatch.setattr(D, "SENT", most)
    monkeypatch.setattr("lorespark.operators.retrieve.SENT", most)
    columns = ["chunk_id", "status", "topic", "triggers", "summary", "response", "source", "doc_id"]
    key = lambda r: tuple(map(str, r))
    got = sorted(D.written_chunks(spark, d, *columns).collect(), key=key)
    assert got == sorted(D.chunks(spark, d).select(*columns).collect(), key=key)
    assert len(got) > 20 and {r.status for r in got} == {"active", "review", "deprecated"} and len({r.chunk_id for r in got}) == len(got)
    assert "Window" not in plans["chunks"] and "response" not in plans["chunks-gone"].split("Relation")[0] and ("chunks-kept" in plans) == (most == 2)


def test_pages_split_a_text_once(spark):
    """The text isn't split again for every page, which takes time by the square of its lines."""
    from lorespark.operators.segment import counted_pages

    texts = spark.createDataFrame([("a\nb\nc\nd\ne",), ("",), (None,), ("\n\n",)], "text string")
    x = texts.select(counted_pages(F.col("text"), 2).alias("p"))
    assert [r.p for r in x.collect()] == [["a\nb", "c\nd", "e"], [""], None, ["\n", ""]]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("most_bytes", [8_000_000, 25])
def test_gold_is_the_whole_item(spark, most_bytes):
    chunks = spark.createDataFrame([("a", "xx the quick brownish fox yy"), ("b", "the quick"), ("c", "see: the quick brownish fox"), ("d", "one two"), ("e", None), ("f", "")], "chunk_id string, body string")
    items = spark.createDataFrame([(1, "e quick brownish fo"), (2, "the quick"), (3, "absent words here now"), (4, "ne t"), (5, ""), (6, None), (7, "the quick")], "qid long, text string")
    got = sorted((r.qid, r.chunk_id) for r in retrieve.expected_chunks(items, chunks, most_bytes).collect())
    assert got == [(1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (4, "d"), (7, "a"), (7, "b"), (7, "c")]
    assert retrieve.expected_chunks(items.where("qid in (5, 6)"), chunks).count() == 0


def test_many_short_items(spark):
    """One-letter and two-letter items, far more than a broadcast of rows would take: no error, all found."""
    rng = random.Random(4)
    items = [(k, "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5])))) for k in range(3000)]
    chunks = [(f"c{k}", "".join(rng.choice("abcdefgh ") for _ in range(60))) for k in range(20)]
    x = retrieve.expected_chunks(spark.createDataFrame(items, "qid long, text string"), spark.createDataFrame(chunks, "chunk_id string, body string"), 2000)
    assert sorted((r.qid, r.chunk_id) for r in x.collect()) == sorted((q, c) for q, t in items for c, b in chunks if t in b)


@pytest.mark.parametrize(("least", "block"), [(0.0, 512), (0.0, 3), (0.3, 512)])
def test_nearest_equals_brute_force(spark, least, block):
    rng = random.Random(5)
    words = [f"w{k:03d}" for k in range(60)]
    index = [(f"c{k:03d}", "active", "topic", [" ".join(rng.sample(words, rng.choice([2, 5, 8, 20])))]) for k in range(90)]
    index += [(f"d{k}", "active", "topic", index[k // 3][3]) for k in range(9)] + [("e", "review", "topic", index[0][3]), ("f", "active", "topic", ["alone"]), ("g", "active", "topic", None), ("h", "active", "topic", ["word " * 50])]
    x = relate.nearest(spark.createDataFrame(index, "chunk_id string, status string, topic string, triggers array<string>"), least, stop=0.9, few=1, block=block)
    got = {r.a: (r.b, round(r.jaccard, 6)) for r in x.collect()}
    sets = {i: set((t or [""])[0].split()) for i, s, _, t in index if s == "active"}  # "topic" is in all: no word of any set
    want = {}
    for a, p in sets.items():
        near = sorted((-math.floor(1e6 * len(p & q) / len(p | q) + 0.5), b) for b, q in sets.items() if b != a and p & q)
        if near and -near[0][0] >= least * 1e6:
            want[a] = near[0][1], -near[0][0] / 1e6
    assert got == want and "c001" in got and "f" not in got


def test_a_word_of_many_chunks_sends_each_row_once(spark, monkeypatch):
    """4,000 chunks of one word: what goes to tasks are their rows, not rows times blocks; pieces and two-byte words give the same partners."""
    monkeypatch.setattr(relate, "OFTEN", 500)
    index = [(f"c{k:04d}", "active", "shared", [f"own{k:04d} pair{k // 2:04d}"]) for k in range(4000)]
    x = spark.createDataFrame(index, "chunk_id string, status string, topic string, triggers array<string>")
    seen = spark.sparkContext.accumulator(0)
    meet = relate._meet

    def counted(*args):
        def run(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return meet(*args)(each())

        return run

    monkeypatch.setattr(relate, "_meet", counted)
    got = {r.a: r.b for r in relate.nearest(x, stop=1.0, few=10_000).collect()}
    assert got == {f"c{k:04d}": f"c{k ^ 1:04d}" for k in range(4000)}
    assert seen.value <= 2 * 2 * 4000  # at most two words that others have, in two rounds


def test_a_frequent_word_is_cut_into_blocks(spark):
    """400 chunks share one word; no task gets it whole, and all find their best."""
    index = [(f"c{k:03d}", "active", "shared", [f"own{k:03d} pair{k // 2:03d}"]) for k in range(400)]
    x = spark.createDataFrame(index, "chunk_id string, status string, topic string, triggers array<string>")
    got = {r.a: r.b for r in relate.nearest(x, stop=1.0, few=1000, block=50).collect()}
    assert got == {f"c{k:03d}": f"c{k ^ 1:03d}" for k in range(400)}
    sets = relate.word_sets(x, 1.0, 1000)[0].select(F.size("words").alias("n")).distinct().collect()
    assert [r.n for r in sets] == [3]


@pytest.mark.parametrize("cell", [4096, 2])
def test_a_pair_is_counted_once(spark, monkeypatch, cell):
    """Chunks with many frequent words in common: each asker looks at a chunk of a block once, not once a word; partners and ties as by brute force."""
    rng = random.Random(11)
    words = [f"w{k:02d}" for k in range(30)]
    index = [(f"c{k:03d}", "active", "", [" ".join(rng.sample(words, rng.choice([1, 3, 12, 29])))]) for k in range(150)]
    index.append(("z", "active", "", [" ".join(words + [f"x{k}" for k in range(1200)])]))  # a large set: similarities that round to the same
    index += [(f"y{k}", "active", "", [" ".join([f"x{j}" for j in range(600 + k)])]) for k in range(3)]
    monkeypatch.setattr(relate, "CELL", cell)
    x = spark.createDataFrame(index, "chunk_id string, status string, topic string, triggers array<string>")
    got = {r.a: (r.b, round(r.jaccard, 6)) for r in relate.nearest(x, stop=1.0, few=1000, block=40).collect()}
    sets = {i: set(t[0].split()) for i, _, _, t in index}
    want = {}
    for a, p in sets.items():
        near = min(((-math.floor(1e6 * len(p & q) / len(p | q) + 0.5), b) for b, q in sets.items() if b != a and p & q), default=None)
        if near:
            want[a] = near[1], -near[0] / 1e6
    assert got == want

    block = relate.Block([(np.array([5, 7, 9]), np.array([3, 3, 4]), np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 5], np.int32), np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 2]))])
    starts, ends = (v.tolist() for v in block.lists(np.array([1, 2, 3, 6])))
    assert [j - i for i, j in zip(starts, ends, strict=True)] == [3, 3, 2, 0]
    assert block.place_of(np.array([5, 6, 9])).tolist() == [0, -1, 2]
    assert block.nearest(-1, 4, starts, ends) == (750_000, 5) and block.nearest(0, 4, starts, ends) == (600_000, 9) and not block.counts[1].any()


def test_scores_by_products_reach_the_same_places(monkeypatch):
    """Frequent tokens by a product of matrices in single precision, others one by one: scores are those in double precision, for blocks of any size."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    pick = lambda n: [w for k, w in enumerate(words) if rng.random() < n / (k + 2)]
    rows = [(q, t, math.log(1 + 60 / (words.index(t) + 1))) for q in range(9) for t in pick(4) or ["w0"]]
    asked = pa.table(dict(zip(("qid", "token", "idf"), zip(*rows, strict=True), strict=True)))
    chunks = [(f"c{k:03d}", pick(6) * rng.choice([1, 2])) for k in range(200)]
    told = retrieve.Asked(asked)
    assert 0 < len(told.matrix) <= len(told.words)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([t for _, t in chunks], pa.list_(pa.string())), pa.array([[k % 3 + 1 for k in range(len(t))] for _, t in chunks], pa.list_(pa.int32()))], names=["chunk_id", "tokens", "weights"])
    idf = {(q, t): w for q, t, w in zip(*(asked.column(c).to_pylist() for c in ("qid", "token", "idf")), strict=True)}
    want = set()
    for q in {q for q, _ in idf}:
        score = lambda t, q=q: math.floor(1e6 * sum((k % 3 + 1) * idf.get((q, x), 0) for k, x in enumerate(t)) + 0.5) / 1e6
        want |= {(q, i, -s) for s, i in sorted((-score(t), i) for i, t in chunks if score(t) > 0)[:3]}
    for cells, frequent in ((2_000_000, 512), (45, 512), (45, 0), (2_000_000, 5)):
        monkeypatch.setattr(retrieve, "CELLS", cells)
        monkeypatch.setattr(retrieve, "FREQUENT", frequent)
        told = retrieve.Asked(asked)
        assert len(told.matrix) <= frequent
        got = [r for b in retrieve._best_of_task(type("B", (), {"value": told}), 3)([batch]) for r in zip(*b.to_pydict().values(), strict=True)]
        assert {(q, i, round(s, 6)) for q, i, s in got} == {(q, i, round(s, 6)) for q, i, s in want} and len(got) == len(want)
        assert (abs(told.scored(*batch.columns[1:]).about() / np.maximum(told.scores(*batch.columns[1:]), 1e-9) - 1)[told.scores(*batch.columns[1:]) > 0] < retrieve.NEAR).all()
