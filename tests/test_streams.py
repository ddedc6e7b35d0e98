"""Keyed streams: order, restarts, timers and versions, by hand and against the batch forms."""

import random

from lorespark.operators import requests
from lorespark.sources import sinks
from lorespark.streaming import keyed, log_stream
from pyspark.sql import functions as F

LOG = "req_id long, s double, session_id long, outcome string"


def log_of(spark, rows):
    x = spark.createDataFrame(rows, LOG)
    return x.select("req_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "session_id", F.lit("answer").alias("mode"), F.lit("q").alias("question"), F.lit(1).cast("long").alias("duration_ms"), "outcome")


def replay(spark, parts, stream):
    """Each part arrives and is read by a new run from the same checkpoint; one run more has nothing to read."""
    path, out, state = (sinks.shared_folder(spark, n) for n in ("log", "out", "state"))
    for part in [*parts, None]:
        if part is not None:
            sinks.write_log(log_of(spark, part), path, "append")
        keyed.start(stream(log_stream.read_log_stream(spark, path)), out, state).awaitTermination()
    return spark.read.parquet(out)


def test_rate_limit_over_restarts_equals_batch(spark):
    rng = random.Random(3)
    rows = [(k, round(1.7e9 + k * 2.5 + rng.random(), 3), rng.choice([1, 1, 1, 2, None]), "ok") for k in range(400)]
    rows += [(900, rows[-1][1] + 300, 1, "ok"), (901, None, 2, "ok")]
    parts = [rows[:150], rows[150:260], rows[260:]]
    for limit in (4, 0):
        got = sorted((r.session_id or 0, r.req_id, r.admitted) for r in replay(spark, parts, lambda s, n=limit: keyed.rate_limits(s, n, 60)).collect())
        want = sorted((r.session_id or 0, r.req_id, r.admitted) for r in requests.rate_limit_decisions(log_of(spark, rows), limit, 60).collect())
        assert got == want and (limit == 0 or 0 < sum(r[2] for r in got) < len(got))


def test_expired_sessions_come_out_once(spark):
    """Turned-away requests don't extend a session; accesses of one batch may come in any order, and a late one joins two sessions."""
    base = 1.7e9
    first = [(1, base + 900, 1, "ok"), (2, base, 1, "ok"), (3, base + 1800, 1, "invalid"), (4, base + 2600, 1, "rate_limited"), (5, base + 100, 2, "timeout"), (6, base, None, "ok")]
    second = [(7, base + 2800, 1, "ok"), (8, base + 3500, 2, "ok"), (9, base + 1800, 2, "error"), (10, None, 1, "ok")]
    third = [(11, base + 90_000, 9, "ok")]
    got = replay(spark, [first, second, third], lambda s: keyed.closed_sessions(s, 1800, "1 hour")).collect()
    us = lambda s: int((base + s) * 1_000_000)
    assert sorted((r.session_id or 0, r.started_us, r.ended_us, r.requests) for r in got) == [
        (0, us(0), us(0), 1), (1, us(0), us(900), 2), (1, us(2800), us(2800), 1), (2, us(100), us(3500), 3)]


def state_rows(query) -> int:
    return max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])


def test_sessions_share_keys(spark):
    """300 sessions have 3 state rows and their timers, not some a session; each ends as by itself."""
    base = 1.7e9
    rng = random.Random(7)
    at = {k: sorted(round(rng.uniform(0, 9000), 3) for _ in range(rng.choice([1, 3, 6]))) for k in range(300)}
    rows = [(k * 10 + n, base + s, k if k else None, "ok") for k, own in at.items() for n, s in enumerate(own)] + [(9000, base + 90_000, 999, "ok")]
    path, out, state = (sinks.shared_folder(spark, n) for n in ("log", "out", "state"))
    sinks.write_log(log_of(spark, rows), path, "append")
    query = keyed.start(keyed.closed_sessions(log_stream.read_log_stream(spark, path), 1800, "1 hour", buckets=3), out, state)
    query.awaitTermination()
    want = []
    for k, own in at.items():
        spans = []
        for s in own:
            if spans and s - spans[-1][1] <= 1800:
                spans[-1] = (spans[-1][0], s, spans[-1][2] + 1)
            else:
                spans.append((s, s, 1))
        want += [(k, int((base + a) * 1_000_000), int((base + b) * 1_000_000), n) for a, b, n in spans]
    assert sorted((r.session_id or 0, r.started_us, r.ended_us, r.requests) for r in spark.read.parquet(out).collect()) == sorted(want)
    assert state_rows(query) <= 30


def test_sources_arrive_change_and_shrink(spark):
    path, out, state = (sinks.shared_folder(spark, n) for n in ("sources", "changes", "state"))
    page = "Contents\nAlpha   3\nBeta   5\n-- 1 of 2 --\n\fAlpha\nfirst words. more\nBeta\nsecond words. more"
    waves = [
        [("a/x.pdf", page), ("a/y.pdf", "plain text"), ("a/z.pdf", None), (None, "no path")],
        [("a/x.pdf", page), ("a/y.pdf", "plain text"), ("b/x.pdf", page)],  # the same again; a copy elsewhere is new
        [("a/x.pdf", page.replace("first", "other").replace("Beta   5\n", "")), ("a/y.pdf", "")],
    ]
    told = []
    for wave in waves:
        spark.createDataFrame(wave, log_stream.SOURCE).write.mode("append").parquet(path)
        log_stream.ingest_sources(spark, path, out, state, least=1).awaitTermination()
        told.append((keyed.last_run(spark, out, keyed.CHANGES).count(), sorted((r.path, r.topic, r.summary, r.number) for r in log_stream.ingested_index(spark, out).collect())))
    one = [("a/x.pdf", "Alpha", "Alpha\nfirst words", 1), ("a/x.pdf", "Beta", "Beta\nsecond words", 1), ("a/y.pdf", "y", "plain text", 1)]
    assert told[0] == (6, one)
    assert told[1] == (9, one + [("b/x.pdf", "Alpha", "Alpha\nfirst words", 1), ("b/x.pdf", "Beta", "Beta\nsecond words", 1)])
    assert [r for r in told[2][1] if r[0][0] == "a"] == [("a/x.pdf", "Alpha", "Alpha\nother words", 2)]
    assert sorted((r.path, r.number) for r in log_stream.ingested(spark, out).collect()) == [("a/x.pdf", 1), ("a/x.pdf", 2), ("a/y.pdf", 1), ("a/y.pdf", 2), ("a/z.pdf", 1), ("b/x.pdf", 1)]


def test_sources_share_keys(spark):
    """200 sources have 3 state rows, not one each; a source that changes and one that shrinks do so alone."""
    path, out, state = (sinks.shared_folder(spark, n) for n in ("sources", "changes", "state"))
    waves = [[(f"s/{k}.pdf", f"text {k}") for k in range(200)], [(f"s/{k}.pdf", "other" if k == 7 else "" if k == 8 else f"text {k}") for k in range(200)]]
    for wave in waves:
        spark.createDataFrame(wave, log_stream.SOURCE).write.mode("append").parquet(path)
        stream = spark.readStream.schema(log_stream.SOURCE).parquet(path)
        query = keyed.start_runs(keyed.source_changes(log_stream.with_entries(stream, 1), buckets=3), out, state)
        query.awaitTermination()
        assert state_rows(query) <= 3
    got = {(r.path, r.summary, r.number) for r in log_stream.ingested_index(spark, out).collect()}
    assert got == {(f"s/{k}.pdf", f"text {k}", 1) for k in range(200) if k not in (7, 8)} | {("s/7.pdf", "other", 2)}
