"""Nearest neighbours, manifest versions, exact quantiles, model calls and headings, against brute force and by hand."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import kb, neighbors, outputs, requests, segment
from lorespark.sources import sinks, versions

VECTORS = "vec_id long, embedding array<float>"


def brute_neighbors(rows, asked, k):
    unit = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    out = set()
    for q in asked:
        if q in unit:
            near = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q)
            out |= {(q, n + 1, i, round(-c, 6)) for n, (c, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("members", "cells"), [(2048, None), (2048, 40)])
def test_nearest_vectors_equal_brute_force(spark, members, cells):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6))
    rows = [(k, (centres[k % 9] + 0.3 * rng.normal(size=6)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)]  # equal vectors: ties by id
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0]), (2005, []), (2006, [2e38] * 6)]
    t = spark.createDataFrame(rows, VECTORS).repartition(5)
    asked = [0, 7, 14, 1003, 2000, 2001, 2006, 599]
    got = neighbors.knn_retrieve(t, t.where(F.col("vec_id").isin(asked)), 7, cells).collect()
    assert {(r.vec_id, r["rank"], r.neighbor_id, round(r.cosine, 6)) for r in got} == brute_neighbors(rows, asked, 7)


def test_fewer_vectors_than_asked_for(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], VECTORS)
    assert sorted((r.vec_id, r["rank"], r.neighbor_id) for r in neighbors.knn_retrieve(t, t, 5).collect()) == [(1, 1, 3), (1, 2, 2), (2, 1, 3), (2, 2, 1), (3, 1, 1), (3, 2, 2)]
    assert neighbors.knn_retrieve(t.where("vec_id < 0"), t, 5).count() == 0


def test_far_clusters_are_not_visited():
    """A query deep in its cluster asks no cluster that can't hold anything nearer."""
    book = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    told = neighbors.Clusters(book, np.array([10, 10, 10]), np.array([0.1, 0.1, 0.1]))
    far = neighbors._distances(np.array([[1.0, 0.0]]), book)
    assert [s.tolist() for s in told.first(far, 5)] == [[0]] and [s.tolist() for s in told.first(far, 10)] == [[0, 1]]
    assert [s.tolist() for s in told.rest(far, 5, np.array([0.2]))] == [[]] and [s.tolist() for s in told.rest(far, 5, np.array([1.5]))] == [[1]]


def manifest_of(spark, paths):
    return spark.createDataFrame([(p, "h" + p, "t", [p + "1"], 3, k) for k, p in enumerate(paths)], versions.ROWS)


def test_manifest_versions_follow_each_other(spark):
    root = sinks.shared_folder(spark, "versions")
    assert versions.current_version(spark, root) == 0 and versions.read_manifest_version(spark, root).count() == 0
    assert versions.write_manifest_version(manifest_of(spark, ["a", "b"]), root) == 1
    assert versions.write_manifest_version(versions.read_manifest_version(spark, root).where("path <> 'a'"), root) == 2  # reads what it follows
    assert [r.path for r in versions.read_manifest_version(spark, root).collect()] == ["b"]
    assert versions.read_manifest_version(spark, root, 1).count() == 2


def test_of_two_writers_one_wins(spark):
    root = sinks.shared_folder(spark, "versions")
    versions.write_manifest_version(manifest_of(spark, ["a"]), root)
    base = versions.current_version(spark, root)
    assert versions.write_manifest_version(manifest_of(spark, ["first"]), root, base) == base + 1
    with pytest.raises(versions.ConcurrentWrite):
        versions.write_manifest_version(manifest_of(spark, ["second"]), root, base)
    assert [r.path for r in versions.read_manifest_version(spark, root).collect()] == ["first"]


def test_the_pointer_is_taken_between_check_and_move(spark, monkeypatch):
    root = sinks.shared_folder(spark, "versions")
    versions.write_manifest_version(manifest_of(spark, ["a"]), root)
    monkeypatch.setattr(versions, "current_version", lambda *_: 0)  # looks before the other writer's move, moves after it
    with pytest.raises(versions.ConcurrentWrite):
        versions.write_manifest_version(manifest_of(spark, ["late"]), root, 0)
    monkeypatch.undo()
    assert [r.path for r in versions.read_manifest_version(spark, root).collect()] == ["a"]


def test_a_failed_write_leaves_the_last_version(spark):
    root = sinks.shared_folder(spark, "versions")
    versions.write_manifest_version(manifest_of(spark, ["a"]), root)
    broken = manifest_of(spark, ["b"]).withColumn("hash", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.write_manifest_version(broken, root)
    assert versions.current_version(spark, root) == 1 and [r.path for r in versions.read_manifest_version(spark, root).collect()] == ["a"]
    assert versions.write_manifest_version(manifest_of(spark, ["c"]), root) == 2


def test_quantiles_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(50), rng.randrange(5000), 7, None])) for _ in range(900)] + [("one", 5), ("none", None)]
    x = spark.createDataFrame(rows, "mode string, duration_ms long").repartition(5)
    got = {r.mode: r for r in requests.latency_report(x, 3000).collect()}
    assert set(got) == {"a", "b", None, "one", "none"}
    for mode, r in got.items():
        own = [v for m, v in rows if m == mode and v is not None]
        assert r.requests == sum(m == mode for m, _ in rows)
        if not own:
            assert (r.mean_ms, r.p50_ms, r.p95_ms, r.over_limit) == (None,) * 4
            continue
        want = (np.mean(own), np.quantile(own, 0.5), np.quantile(own, 0.95), np.mean([v >= 3000 for v in own]))
        assert np.allclose((r.mean_ms, r.p50_ms, r.p95_ms, r.over_limit), want, atol=1e-3)


def test_a_model_is_loaded_once_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/load-{os.getpid()}-{time.time_ns()}", "w"):
            pass
        calls = {}

        def model(prompts):
            for p in prompts:
                calls[p] = calls.get(p, 0) + 1
            if any(p.startswith("flaky") and calls[p] < 3 for p in prompts):
                raise TimeoutError("again")  # fails in the batch and once alone
            return [p.upper() for p in prompts]

        return model

    rows = spark.createDataFrame([(k, "flaky" if k == 7 else None if k == 8 else f"p{k}") for k in range(40)], "k long, prompt string").repartition(3).persist()
    got = {r.k: (r.raw, r.failure) for r in outputs.extract_chunks(rows, load=load, batch=4).collect()}
    assert len(os.listdir(folder)) == 3
    assert got == {k: ("FLAKY" if k == 7 else None if k == 8 else f"P{k}", None) for k in range(40)}
    once = {r.k: r.failure for r in outputs.extract_chunks(rows, load=load, tries=1).collect()}
    assert once[7] == "TimeoutError: again" and once[1] is None
    with pytest.raises(ValueError, match="either"):
        outputs.extract_chunks(rows)


def test_answers_by_model_or_by_rule(spark):
    x = spark.createDataFrame([(1, "How?", "ctx", None), (2, "quota", None, "x")], "qid long, question string, block string, constraints string")

    def model(prompts):
        if any("quota" in p for p in prompts):
            raise RuntimeError("Quota exceeded")
        return [f'{{"type":"text","data":{{"body":"{p.count("ctx")}"}}}}' for p in prompts]

    parsed = outputs.parse_chat_response(outputs.answer_by_model(x, model))
    got = {r.qid: (r.type, r.text) for r in outputs.response_components(parsed, ["qid"]).collect()}
    assert got == {1: ("text", "1"), 2: ("alert", outputs.ALERTS["rate_limit"])}
    rules = outputs.answer(x.withColumn("context", F.col("block")).withColumn("conditions", F.lit(None).cast("string")))
    assert {r.qid: r.kind for r in rules.collect()} == {1: "steps", 2: "text"}


@pytest.mark.parametrize("few", [0, 1000])
def test_headings_by_hash_or_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(segment, "FEW", few)
    text = "Contents\nAlpha   3\n    Sub   4\nBeta   5\n-- 1 of 2 --\n\fintro\nAlpha\nbody of alpha\n\f--\n\fBeta\nbody of beta\n\fcontents"
    d = spark.createDataFrame([(1, text), (2, "plain\ntext"), (3, None), (4, "")], "doc_id long, text string")
    got = [tuple(r) for r in segment.heading_segments(d).orderBy("doc_id", "seg").collect()]
    assert got == [(1, 0, "document", "intro", 2, 2), (1, 1, "Alpha", "Alpha\nbody of alpha", 2, 4), (1, 2, "Beta", "Beta\nbody of beta", 4, 5), (2, 0, "document", "plain\ntext", 1, 1)]


def test_many_headings_take_linear_time(spark):
    """100,000 lines under 20,000 headings; line by line against the list they would be two thousand million comparisons."""
    heads = [f"Heading number {k}" for k in range(20_000)]
    text = "Contents\n" + "\n".join(f"{h}   {k}" for k, h in enumerate(heads)) + "\n-- 1 of 2 --\n\f" + "\n".join(f"{h}\nline a\nline b\nline c\nline d" for h in heads)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    assert segment.heading_segments(d).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("c")).first() == (20_000, sum(len(h) + 28 for h in heads))
    assert time.time() - started < 40


def test_manifest_of_a_run_is_kept(spark):
    run = manifest_of(spark, ["a"]).withColumn("chunk_ids", F.array().cast("array<string>"))
    assert kb.record_extraction(manifest_of(spark, ["a"]), run).first().chunk_ids == ["a1"]


def test_names_without_titles_are_redacted(spark):
    told = [
        ("Hello John Smith, my name is Mary-Ann Jones and order 12345 fails.", "Hello [name], my name is [name] and [reference] fails."),
        ("This is Paul from Sales. I'm Ann Lee speaking", "This is [name] from Sales. I'm [name] speaking"),
        ("Ich heiße Jürgen Müller", "Ich heiße [name]"),
        ("Best regards, Zoë Ångström", "Best regards, [name]"),
        ("Frau Müller-Lüdenscheid rief an", "[name] rief an"),
        ("This is Windows again. I am sure, hello world", "This is Windows again. I am sure, hello world"),
    ]
    x = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(told)], "k int, t string")
    assert [r.t for r in x.select("k", outputs.without_personal(F.col("t")).alias("t")).orderBy("k").collect()] == [w for _, w in told]


def test_a_manifest_is_ranked_as_a_whole(spark):
    from lorespark.plans import registry

    got = sorted(r["rank"] for r in registry.QUERIES["read_manifest"](spark, "/root/testdata/sf0.001").select("rank").collect())
    assert got == list(range(1, len(got) + 1))


def test_each_id_follows_the_one_before_it_across_ranges(spark):
    from lorespark.operators import relate

    ids = [f"c{k * 7919 % 1000:03d}" for k in range(1000)]
    got = {(r.chunk_id, r.before) for r in relate.ids_before(spark.createDataFrame([(i,) for i in ids], "chunk_id string").repartition(7)).collect()}
    assert got == {(b, a) for a, b in zip(sorted(ids), sorted(ids)[1:], strict=False)}


def test_related_chunks_cross_sources(spark):
    """The chunk before in order of all ids, whatever its source: not the first of each source alone has none."""
    from lorespark.plans import registry

    sql = registry.ORACLE_SQL["rewrite_related"]
    assert "lag(chunk_id) over (order by chunk_id)" in sql and "partition by source order by chunk_id" not in sql


def test_review_is_marked_without_a_join(spark):
    text = "---\nchunk_id: {}\nsource: s\ntopic: t\nsummary: >\n  u\ntriggers:\nhas_conditions: false\nrelated_chunks:\nstatus: {}\n---\n\n## Context\n\n## Response\n"
    rows = [("a.md", text.format("a", "active")), ("b.md", text.format("B", "active")), ("c.md", text.format("C", "review")), ("d.md", "none")]
    x = spark.createDataFrame(rows, "file string, raw string")
    one = kb.mark_review(x)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r.file: r.raw for r in one.collect()}
    assert got == {r.file: r.raw for r in kb.mark_review(x, kb.validate_chunks(x)).collect()}
    assert got == dict(rows) | {"b.md": rows[1][1].replace("status: active", "status: review")}


def test_files_read_whole_are_bounded(spark, monkeypatch):
    """Twice the files for half the rows a file: a file doesn't grow with the table."""
    from lorespark.plans import registry
    from lorespark.sources import files

    seen = []
    read = files.read_chunks
    monkeypatch.setattr(files, "read_chunks", lambda *a, **k: seen.append(read(*a, **k)) or seen[-1])
    for rows in (10, 20):
        monkeypatch.setattr(sinks, "FILE_ROWS", rows)
        registry.QUERIES["read_chunks"](spark, "/root/testdata/sf0.001")
    per_file = [max(r.n for r in x.select(F.regexp_count("raw", F.lit(r"(?m)^chunk_id: ")).alias("n")).collect()) for x in seen]
    assert 0 < per_file[0] <= 10 and 0 < per_file[1] <= 20 and seen[0].count() > seen[1].count() > 1


def test_every_fiftieth_conversation_asks(spark):
    from lorespark.plans import registry

    got = {r.qid for r in registry.QUERIES["retrieve_with_history"](spark, "/root/testdata/sf0.001").select("qid").collect()}
    assert got == {0}


def test_outputs_of_a_model_arent_held_for_a_whole_arrow_batch(spark):
    def load():
        def told(prompts):
            with open("/proc/self/statm") as f:
                mb = int(f.read().split()[1]) * 4096 // 1_000_000
            return ["x" * 40_000 + f"|{mb}" for _ in prompts]

        return told

    asked = spark.range(6000).coalesce(1).select("id", F.when(F.col("id") % 5 > 0, F.lit("p")).alias("prompt"))
    got = outputs.extract_chunks(asked, load=load, batch=64).select("id", F.substring_index("raw", "|", -1).cast("int").alias("mb")).collect()
    assert len(got) == 6000 and all((r.mb is None) == (r.id % 5 == 0) for r in got)
    used = [r.mb for r in got if r.mb is not None]
    assert max(used) - used[0] < 120  # of 192 MB of outputs


def test_every_conversation_asks(spark):
    """No conversation is left out: each with a user turn that shares a word with an active chunk has a row."""
    from lorespark.plans import registry

    d = "/root/testdata/sf0.001"
    got = {r.qid for r in registry.QUERIES["retrieve_with_history"](spark, d).select("qid").collect()}
    asked = {r.conv_id for r in spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select("conv_id").distinct().collect()}
    assert len(asked) > 10 and got == asked
    assert "% 50" not in registry.ORACLE_SQL["retrieve_with_history"]
