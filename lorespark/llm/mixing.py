"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Of all rates (copies expected) between 0 and ``MOST`` that give
it, those nearest to 1 by relative entropy are r = min(MOST, exp(t g)), tilted by the document's
size g in units of its source's mean word's document. The multiplier t of each source minimises
a convex dual, whose gradient is the words that t gives less the target. Newton steps for all sources
at once, kept between the bounds known so far, are aggregates over (source, size) counts, on which
alone a rate depends: documents are read once.

Rates become copies without drawing lots: within a source, sizes are taken from the largest to the smallest, each
gets the whole number of copies nearest to its expected words plus what is left over
so far, so that a source ends within half a small document of its target (or as near as
whole copies allow). Of the documents of one size, the first by checksum of the id get the odd copies.

Sources may be many: they are numbered over sorted partitions, and kept as a table. A (source, size) group of any
number of documents is numbered in parts of ``PART`` rows. Rows that are equal in id, source and
size are one row with a count until the end. Sums are of terms rounded to a millionth of a
word, as decimals, so reruns agree whatever the order.

Defined results. Null and empty texts have size 0 and take 0 words; documents without a source are one, the
last; equal rows may differ in ``taken`` by a copy; a null doc_id is an id like others. An empty table gives no rows; a
source without words has target 0. Columns beside doc_id, source and text are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import partitions_for, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
PART = 20_000
STEPS, CLOSE = 60, 1e-9
SENT_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
MANY = 100_000  # equal rows that are listed at once


def _exact(c):
    return F.round(c, 6).cast("decimal(38,6)")


def _sent(x: DataFrame) -> DataFrame:
    return F.broadcast(x) if x.count() <= SENT_SOURCES else x.hint("shuffle_merge")


FILE_ROWS = 50_000  # of the small tables of sources and sizes, that a task takes at least


def _compact(x: DataFrame) -> DataFrame:
    """A small table counted and written in as few files as its rows need, so that every step over it is a few tasks."""
    n = x.count()
    return written(x.coalesce(-(-max(n, 1) // FILE_ROWS)), "compact")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, c): ``docs(doc_id, source, text)`` by words, equal rows once with their count; ``key`` orders sources, null last."""
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", key.alias("key"), size.alias("size")).groupBy("doc_id", "key", "size").agg(F.count("*").alias("c"))


def weighed(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` with ``weight``: the weights repeat over the sources in order of ``key``, counted partition by partition."""
    x = sources.repartitionByRange(partitions_for(sources.sparkSession), "key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    x = written(x, "sources-sorted").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, start = 0, []
    for r in sorted(x.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        start.append((r["part"], before))
        before += r["n"]
    start = sources.sparkSession.createDataFrame(start, "part long, start long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("start") + F.col("row")) % len(weights) + 1).cast("int"))
    return x.join(F.broadcast(start), "part").withColumn("weight", weight).drop("part", "at", "row", "start")


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources(key, source_size, weight)`` with ``target``: ``share`` of all words by weight, at most ``most`` times a source's own, the excess by weight to the others.

    Each round is one aggregate; a level only rises, and each round that isn't the last stops a source more.
    """
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        got = sources.agg(F.count_if(full).alias("k"), F.sum(F.when(full, cap).cast("decimal(38,6)")).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if got["k"] == stopped or not got["w"]:
            break
        stopped, level = got["k"], (share * total - float(got["held"] or 0)) / got["w"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def tilts(sizes: DataFrame, sources: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """(key, tilt, unit): each source's multiplier, by Newton steps on the dual over ``sizes(key, size, m)``.

    ``unit`` is the mean size of a word's document. A tilt is null where every rate is ``most`` (or nothing is to be taken).
    """
    parts = -(-max(sources.count(), 1) // FILE_ROWS)
    squares = sizes.groupBy("key").agg(F.sum((F.col("size") * F.col("size") * F.col("m")).cast("decimal(38,0)")).cast("double").alias("sq"))
    state = sources.join(squares.hint("shuffle_merge"), "key").select("key", "target", F.col("source_size").cast("double").alias("own"), "sq")
    state = state.withColumn("open", (F.col("own") > 0) & (F.col("target") > 0) & (F.col("target") < F.col("own") * F.lit(most * (1 - CLOSE))))
    ratio = F.coalesce(F.try_divide("target", "own"), F.lit(0.0))
    state = state.select(
        "key", "target", "open", F.when(F.col("own") > 0, F.col("sq") / F.col("own")).alias("unit"), F.when(F.col("open"), F.round(F.log(ratio), 12)).alias("tilt"),
        F.when(ratio > 1, 0.0).otherwise(float("-inf")).alias("low"), F.when(ratio < 1, 0.0).otherwise(float("inf")).alias("high"),
    )
    state = written(state.coalesce(parts), "tilts")
    g = F.col("size") / F.col("unit")
    power = F.col("tilt") * g
    free = power < math.log(most)
    rate = F.when(free, F.exp(power)).otherwise(float(most))
    words = F.col("size") * F.col("m")
    for _ in range(steps):
        if state.where("open").isEmpty():
            break
        open_ = state.where("open").select("key", "tilt", "unit")
        got = sizes.join(_sent(open_), "key").groupBy("key").agg(
            F.sum(_exact(words * rate)).cast("double").alias("f"), F.sum(_exact(F.when(free, words * g * rate).otherwise(0.0))).cast("double").alias("slope")
        )
        x = state.join(got.hint("shuffle_merge"), "key", "left")
        off = F.col("f") - F.col("target")
        done = F.abs(off) <= F.col("target") * CLOSE + 1e-5
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        x = x.withColumns({"done": done, "low2": low, "high2": high, "newton": F.col("tilt") - F.try_divide(off, F.col("slope"))})
        inside = F.coalesce((F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2")), F.lit(False))
        inf = float("inf")
        other = F.when(F.col("low2") == -inf, F.col("high2") * 2 - 1).when(F.col("high2") == inf, F.col("low2") * 2 + 1).otherwise((F.col("low2") + F.col("high2")) / 2)
        moved = F.when(inside, F.round("newton", 12)).otherwise(F.round(other, 12))
        more = F.col("open") & ~F.coalesce("done", F.lit(True)) & (moved != F.col("tilt"))
        state = written(
            x.select("key", "target", more.alias("open"), "unit", F.when(more, moved).otherwise(F.col("tilt")).alias("tilt"),
                     F.when(F.col("open"), F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(F.col("open"), F.col("high2")).otherwise(F.col("high")).alias("high")).coalesce(parts), "tilts",
        )
    return state.select("key", "tilt", "unit")


def _copies(most: int):
    """(key, size, m, copies) of rows (key, size, m, want, target) sorted by key, then size from the largest: whole copies of each size, with what is left over carried on."""

    def run(batches):
        own, left = None, 0
        for batch in batches:
            out = []
            for key, size, m, want, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != own:
                    own, left = key, extra
                left += want
                k = min(max(math.floor(left / size + 0.5), 0), most * m) if size else m
                left -= k * size
                out.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["key", "size", "m", "copies"])

    return run


def copies_by_size(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(key, size, m, copies, rate): how many copies the documents of a source and size get together. Wanted words are millionths in whole numbers."""
    x = sizes.join(_sent(sources.select("key", "target", "tilt", "unit")), "key")
    power = F.col("tilt") * F.col("size") / F.col("unit")
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("target") > 0, float(most)).otherwise(1.0)).when(power < math.log(most), F.exp(power)).otherwise(float(most))
    x = x.withColumn("rate", F.round(rate, 12)).withColumn("want", _exact(F.col("size") * F.col("m") * F.col("rate")).cast("double"))
    x = written(x.select("key", "size", "m", "rate", "want"), "wanted")
    rest = x.groupBy("key").agg(F.sum(F.col("want").cast("decimal(38,6)")).cast("double").alias("sum"))
    rest = written(rest.join(sources.select("key", "target").hint("shuffle_merge"), "key").select("key", F.round(F.col("target") - F.col("sum"), 6).alias("extra")), "unmet")
    rows = x.join(_sent(rest), "key").select("key", "size", "m", "want", "extra")
    rows = rows.repartition(partitions_for(x.sparkSession), "key").sortWithinPartitions("key", F.desc("size"))
    return rows.mapInArrow(_copies(most), "key string, size long, m long, copies long").join(x.select("key", "size", "rate").hint("shuffle_merge"), ["key", "size"])


def numbered(rows: DataFrame, part: int = PART) -> DataFrame:
    """``rows(doc_id, key, size, c, m)`` with ``at``: how many of its (key, size) group come before it, by checksum; groups in parts of about ``part`` rows."""
    from pyspark.sql import Window

    sum_ = F.xxhash64("doc_id")
    x = rows.withColumns({"h": sum_, "part": F.pmod(sum_, F.ceil(F.col("m") / F.lit(part)).cast("long"))})
    starts = written(x.groupBy("key", "size", "part").agg(F.sum("c").alias("n")), "group-parts")
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("n")).drop("n")
    x = x.join(written(starts, "group-starts").hint("shuffle_merge"), ["key", "size", "part"])
    inner = F.sum("c").over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id")) - F.col("c")
    return x.withColumn("at", F.col("start") + inner).drop("h", "part", "start")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, part: int = PART) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source, rate, copies) of every document of ``docs(doc_id, source, text)``."""
    rows = written(sized(docs), "sized")
    sizes = _compact(written(rows.groupBy("key", "size").agg(F.sum("c").alias("m")), "sizes"))
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sources = written(with_targets(_compact(written(weighed(sources, weights), "weighed")), share, most), "targets")
    sources = _compact(written(sources.join(tilts(sizes, sources, most).hint("shuffle_merge"), "key"), "tilted"))
    groups = copies_by_size(sizes, sources, most).join(_sent(sources.select("key", "source_size", "target")), "key")
    groups = _compact(written(groups, "copies-by-size"))
    x = rows.join(groups.hint("shuffle_merge"), ["key", "size"])
    x = written(numbered(x, part), "numbered")
    # equal rows are listed again, in steps: no array is longer than MANY
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / MANY))))
    x = x.withColumn("k", F.explode(F.sequence(F.col("k") * MANY, F.least((F.col("k") + 1) * MANY, F.col("c")) - 1)))
    copies = F.expr("copies div m") + F.when(F.col("at") + F.col("k") < F.expr("copies % m"), 1).otherwise(0)
    source = F.when(F.col("key") != "b", F.substr("key", F.lit(2)))
    return x.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), source.alias("source"), "rate", copies.cast("long").alias("copies"))
