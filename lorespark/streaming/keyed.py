"""Streams with state by key: the rate limit, sessions, and the versions of sources.

Each class is what a key's state does with new rows and with an event-time timer. State is on the
RocksDB store, which such operators need; it is set for one query as it starts. Sessions and sources
share a key, their hash's bucket of a fixed number, since calls and state have a cost a key.
"""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorespark.operators.requests import NO_ACCESS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"

# The driver too has a worker for such operators, which doesn't see files served to executors: the classes go with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _started(writer, session):
    """The writer's query, with its state on RocksDB, until all that is there is read."""
    before = session.conf.get(STORE, None)
    session.conf.set(STORE, ROCKSDB)
    try:
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        session.conf.set(STORE, before) if before else session.conf.unset(STORE)


def start(stream: DataFrame, out: str, checkpoint: str):
    """The stream's rows into Parquet at ``out``, each once by the checkpoint."""
    return _started(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), stream.sparkSession)


def start_runs(stream: DataFrame, out: str, checkpoint: str):
    """The stream's rows into a folder of the checkpoint's run under ``out``, a batch each.

    A batch that comes again overwrites its own folder. Where a checkpoint is lost, another one's first batch starts a new run, of
    which ``last_run`` reads alone: state and rows always belong together.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        runs = _runs(session, out)
        if number == 0 and (not runs or not runs[-1].endswith(own)):
            run = f"run-{len(runs):06d}-{own}"
        else:
            run = next(r for r in reversed(runs) if r.endswith(own))
        if number == 0:  # whatever an earlier state left
            batch.where("false").write.mode("overwrite").parquet(f"{out}/{run}")
        batch.write.mode("overwrite").parquet(f"{out}/{run}/batch={number}")

    return _started(stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint), stream.sparkSession)


def _runs(spark: SparkSession, out: str) -> list[str]:
    """Names of the runs under ``out``, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/run-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getName() for f in found or [])


def last_run(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of the last run under ``out``; none before the first."""
    runs = _runs(spark, out)
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/{runs[-1]}")


def _named(stream: DataFrame, *columns: str) -> DataFrame:
    """With sessions as (nobody, session_id), neither null (rows of a null key would come one by one)."""
    session = F.col("session_id").cast("long")
    at = F.unix_micros("ts").alias("at")
    return stream.select(session.isNull().alias("nobody"), F.coalesce(session, F.lit(0)).alias("session_id"), *columns, "ts", at)


def _by_session(stream: DataFrame, *columns: str) -> GroupedData:
    """By session; those without one go together."""
    return _named(stream, *columns).groupBy("nobody", "session_id")


def _session(key) -> int | None:
    return None if key[0] else key[1]


class RateLimit(StatefulProcessor):
    """Admits a request where fewer than ``limit`` were admitted in the window before it. State: the times of the last ``limit``, until a window after the last."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows, timerValues):
        # a key's rows of one batch by time, those without one first
        new = sorted(((r.at, r.req_id) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
        last = [t for (t,) in self.admitted.get()]
        before = last
        for at, request in new:
            told = self.limit > 0 and (at is None or len(last) < self.limit or at - last[0] >= self.window)
            if told and at is not None:
                last = [*last, at][-self.limit :]
            yield Row(session_id=_session(key), req_id=request, admitted=told)
        if last != before:
            self.admitted.put([(t,) for t in last])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last[-1] + self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limits(stream: DataFrame, limit: int = 20, window_s: int = 60, late: str = "0 seconds") -> DataFrame:
    """(session_id, req_id, admitted) of ``stream(req_id, session_id, ts)``: ``rate_limit_decisions`` as requests arrive.

    Requests of a batch are taken by time; one that comes in a later batch than others after it is
    judged by what was admitted by then. A session's times go when the watermark is a window past the last.
    """
    x = _by_session(stream.withWatermark("ts", late).withColumn("req_id", F.col("req_id").cast("long")), "req_id")
    return x.transformWithState(RateLimit(limit, window_s * 1_000_000), "session_id long, req_id long, admitted boolean", "Append", "EventTime")


SESSION_BUCKETS = 2_048


class Sessions(StatefulProcessor):
    """Joins accesses no more than ``idle`` apart to sessions. State of a bucket of them: the open ones' (nobody, session_id, start, last, requests), which a timer sends on when they end.

    Accesses may come in any order within the watermark: what lies within ``idle`` of several open sessions joins them.
    """

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans array<struct<nobody boolean, session_id long, started long, last long, requests long>>")

    def _spans(self) -> list[tuple]:
        had = self.open.get()
        return [tuple(s) for s in had[0]] if had else []

    def _keep(self, spans: list[tuple]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if spans:
            self.open.update((spans,))
            self.handle.registerTimer(min(s[3] for s in spans) // 1000 + self.idle // 1000 + 1)
        else:
            self.open.clear()

    def joined(self, spans: list[tuple]) -> list[tuple]:
        """The spans sorted, those of one session with a gap of at most ``idle`` as one."""
        out: list[tuple] = []
        for s in sorted(spans):
            if out and out[-1][:2] == s[:2] and s[2] - out[-1][3] <= self.idle:
                t = out[-1]
                out[-1] = (*t[:3], max(t[3], s[3]), t[4] + s[4])
            else:
                out.append(s)
        return out

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.nobody, r.session_id, r.at, r.at, 1) for r in rows if r.at is not None]
        self._keep(self.joined(self._spans() + new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._spans()
        ended = [s for s in spans if s[3] + self.idle < now]
        self._keep([s for s in spans if s[3] + self.idle >= now])
        for nobody, session, started, last, requests in ended:
            yield Row(session_id=None if nobody else session, started_us=started, ended_us=last, requests=requests)

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, idle_s: int = 1800, late: str = "30 minutes", buckets: int = SESSION_BUCKETS) -> DataFrame:
    """(session_id, started_us, ended_us, requests): each session once, when the watermark is more than ``idle_s`` past its last access.

    Requests that are turned away (invalid, rate-limited) neither open nor extend one.
    """
    x = _named(stream.where(~F.col("outcome").isin(*NO_ACCESS)).withWatermark("ts", late))
    x = x.withColumn("bucket", F.pmod(F.xxhash64("nobody", "session_id"), F.lit(buckets))).groupBy("bucket")
    return x.transformWithState(Sessions(idle_s * 1_000_000), "session_id long, started_us long, ended_us long, requests long", "Append", "EventTime")


CHANGES = "path string, number long, hash string, change string, chunk_id string, topic string, summary string"


SOURCE_BUCKETS = 4_096


class Versions(StatefulProcessor):
    """Sources' changes. State of a bucket of them: each one's path and last version's number, hash and chunk ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sources array<struct<path string, number long, hash string, chunk_ids array<string>>>")

    def handleInputRows(self, key, rows, timerValues):
        new: dict = {}
        for r in rows:  # of versions that come together the greatest hash counts
            if r.path not in new or r.hash > new[r.path].hash:
                new[r.path] = r
        had = self.last.get()
        last = {path: (number, hash, list(ids)) for path, number, hash, ids in had[0]} if had else {}
        changed = False
        for path, r in new.items():
            number, known, ids = last.get(path, (0, None, []))
            if known == r.hash:
                continue
            changed, number = True, number + 1
            change = lambda kind, i=None, topic=None, summary=None: Row(path=path, number=number, hash=r.hash, change=kind, chunk_id=i, topic=topic, summary=summary)  # noqa: B023, E731
            own = {i: (t, s) for i, t, s in zip(r.ids, r.topics, r.summaries, strict=True)}  # of equal ids the last counts
            yield change("version")
            for i, (topic, summary) in own.items():
                yield change("upsert", i, topic, summary)
            for i in ids:
                if i not in own:
                    yield change("delete", i)
            last[path] = number, r.hash, list(own)
        if changed:
            self.last.update(([(path, *v) for path, v in last.items()],))

    def close(self) -> None:
        pass


def source_changes(sources: DataFrame, buckets: int = SOURCE_BUCKETS) -> DataFrame:
    """Changes of the index (``CHANGES``) as versions of ``sources(path, hash, ids, topics, summaries)`` arrive: an equal hash gives none, another
    one a ``version``, an ``upsert`` for each of its chunks and a ``delete`` for each that it has no more."""
    x = sources.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    return x.groupBy("bucket").transformWithState(Versions(), CHANGES, "Append", "None")
