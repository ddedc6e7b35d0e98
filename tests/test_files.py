"""Readers, sinks and streams on small files."""

import json

from lorespark.operators import kb, requests
from lorespark.sources import files, sinks
from lorespark.streaming import log_stream
from pyspark.sql import functions as F


def test_sources_by_ending(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 3)
    got = files.read_sources(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.pdf", "b.PDF"] and all(r.length == 3 for r in got)


def test_chunks_whole(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\nchunk_id: one\n---\nbody\n")
    (tmp_path / "skip.txt").write_text("no")
    assert [(r.file, r.raw) for r in files.read_chunks(spark, str(tmp_path)).collect()] == [("one.md", "---\nchunk_id: one\n---\nbody\n")]


def test_reports_skip_corrupt_files(spark, tmp_path):
    good = {"startedAt": "t", "sources": ["a"], "steps": [{"step": "extract", "success": True, "durationMs": 5}], "totalDurationMs": 5, "success": True}
    (tmp_path / "ingest-1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "ingest-2.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps(good))
    got = files.read_reports(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].steps[0].step == "extract" and got[0].file == "ingest-1.json"
    assert sorted((r.file, r.broken is None) for r in files.read_reports(spark, str(tmp_path), corrupt=True).collect()) == [("ingest-1.json", True), ("ingest-2.json", False)]


def test_gold_and_manifest(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps([{"question": "q", "expected_chunk_ids": ["a", "b"]}, {"question": "r", "expected_chunk_ids": [], "notes": "n"}]))
    assert [(r.question, r.expected_chunk_ids, r.notes) for r in files.read_gold_queries(spark, str(tmp_path / "gold.json")).collect()] == [("q", ["a", "b"], None), ("r", [], "n")]
    (tmp_path / "m.json").write_text(json.dumps({"a.pdf": {"hash": "h", "extracted_at": "t", "chunk_ids": ["c"], "size_bytes": 9}}, indent=1))
    got = files.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.path, r.hash, r.extracted_at, r.chunk_ids, r.size_bytes, r.position) for r in got] == [("a.pdf", "h", "t", ["c"], 9, 0)]


def test_manifest_of_lines_in_order_of_its_files(spark, tmp_path):
    """Spark reads the largest file first; the places are those of the files' names and lines."""
    line = lambda k: json.dumps({f"{k}.pdf": {"hash": "h" * 9, "extracted_at": "t", "chunk_ids": ["c"], "size_bytes": k}})
    (tmp_path / "part-00000").write_text("\n".join(line(k) for k in range(2)))
    (tmp_path / "part-00001").write_text("\n".join(line(k) for k in range(2, 40)))
    got = files.read_manifest(spark, str(tmp_path), lines=True).collect()
    assert sorted((r.position, r.path) for r in got) == [(k, f"{k}.pdf") for k in range(40)]


def test_index_text_round_trip(spark, tmp_path):
    rows = [(i, "s", "T " + i, "sum", ['say "x"', "b"], False, ["r"], "active") for i in ("b", "a")]
    x = spark.createDataFrame(rows, "chunk_id string, source string, topic string, summary string, triggers array<string>, has_conditions boolean, related_chunks array<string>, status string")
    sinks.write_index(x.repartition(2), str(tmp_path / "i"))
    parts = sorted((tmp_path / "i").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith(kb.INDEX_HEADER + "\n  - chunk_id: a\n") and text.index("chunk_id: a") < text.index("chunk_id: b")
    got = sorted(tuple(r) for r in files.read_index_text(spark, str(tmp_path / "i")).collect())
    assert got == [("a", "s", "T a", "sum", ["say 'x'", "b"], False, ["r"], "active"), ("b", "s", "T b", "sum", ["say 'x'", "b"], False, ["r"], "active")]


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    """The state is lost after the first run, so all files come again as batch 0; a new version and its segments come in once."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a.pdf", "old " * 100), ("b.pdf", "text " * 100)], "path string, text string").write.parquet(src)
    log_stream.ingest_sources(spark, src, out, str(tmp_path / "s1")).awaitTermination()
    log_stream.ingest_sources(spark, src, out, str(tmp_path / "s2")).awaitTermination()
    assert log_stream.ingested(spark, out).count() == 2 and log_stream.ingested_index(spark, out).count() == 2
    spark.createDataFrame([("a.pdf", "new " * 100)], "path string, text string").write.mode("append").parquet(src)
    log_stream.ingest_sources(spark, src, out, str(tmp_path / "s2")).awaitTermination()
    assert log_stream.ingested(spark, out).count() == 3
    assert {(r.path, r.topic, r.summary[:4].strip()) for r in log_stream.ingested_index(spark, out).collect()} == {("a.pdf", "a", "new"), ("b.pdf", "b", "text")}


def test_report_name(spark):
    assert spark.range(1).select(sinks.report_name("eval", F.lit("2024-01-02T03:04:05.6Z"))).first()[0] == "eval-2024-01-02T03-04-05-6Z.json"


def log_rows(spark):
    rows = [(k, s, t, "answer", "q", 5, "ok") for k, (s, t) in enumerate([(1, 0), (1, 600), (1, 4000), (2, 100), (2, 9000), (1, 20_000)])]
    x = spark.createDataFrame(rows, "req_id long, session_id long, s long, mode string, question string, duration_ms long, outcome string")
    return x.select("req_id", F.timestamp_seconds("s").alias("ts"), "session_id", "mode", "question", "duration_ms", "outcome")


def test_closed_stream_sessions_equal_batch(spark, tmp_path):
    log = log_rows(spark)
    log.write.json(str(tmp_path / "log"))
    stream = log_stream.session_windows(log_stream.read_log_stream(spark, str(tmp_path / "log")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session_id, r.started.timestamp(), r.requests) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.session_id, r.started.timestamp(), r.requests) for r in requests.session_stats(log).collect()}
    assert got and got < want and len(want - got) == 1  # the last session is still open


def test_log_is_appended_once(spark, tmp_path):
    log_rows(spark).write.json(str(tmp_path / "log"))
    for _ in range(2):
        log_stream.append_log(log_stream.read_log_stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert files.read_request_log(spark, str(tmp_path / "out")).count() == 6
