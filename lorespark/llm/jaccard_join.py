"""Exact n-gram Jaccard join: prefix keys deal the work out, signature trees search it.

Method. Each text becomes a set of hashed five-word shingles; texts with equal
sets form one class. Under one global token order two sets of Jaccard >= t share
l tokens among the first n - ceil(t n) + l of each. Those tokens are the keys (one shuffle
of 16-byte rows), with l a ``PEEL``-th of that length: a class needs l keys in common with
others, counted class by class and not pair by pair, or it can't link and goes. Texts that
only share lines or passages go here, before any text or bitmap moves. Tokens found very
frequent come last in the order, so that they hardly ever become keys.

The rest are groups of likely copies, searched with signature trees: binary
trees over a key's members, by size and component, whose nodes hold OR-ed token bitmaps, size
ranges and components; a dual traversal drops node pairs whose greatest
possible overlap is too small or that lie in one component. All pairs of a group would be
quadratic in its size, so it collapses into components first: each class is compared with the
few first ones of its keys, then for ``ROUNDS`` rounds with the partner that the trees of a few
of its keys bound highest. The trees of all keys that still join different components give the
pairs that are left; all are compared exactly.

Bounds. The frequent-token set holds at most ``2/share`` tokens (16 MB), whatever
the input (each has half that share of all tokens); the only other broadcasts are
8 MB bit filters of fixed size and ids up to a counted number. A key with more than
``block`` members is cut into blocks and pairs of blocks become the tasks. Joins whose one
side a key may dominate have written tables on both sides, so that a skew join splits it.

Defined results. Null or word-less text: ``n_shingles`` 0, own component. Exact
copies are linked. Rows that repeat a doc_id are compared each and stay or go together. A
Jaccard of exactly t links. A very long text is one set of its shingles, however many.
Empty table: no rows. Extra columns are ignored. Sets are compared through 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import components, partitions_for, written
from lorespark.llm.memo import let_go
from lorespark.llm.shingles import bitmap, overlap, set_id, shingle_hashes, width_for
from lorespark.llm.sigtree import best_partners, build, dual_traversal

FILTER_WORDS = 1 << 20  # of 64 bits: the 8 MB filter
CHUNK = 1 << 22  # tokens counted at once for the frequent ones
REMEMBERED = 1_000_000  # classes a task keeps in mind to send each once
SENT_IDS = 500_000  # class ids broadcast at most (8 bytes each)
WAVES = (6, 0)  # pairs of two components compared at a time; 0: all that are left
HUBS = 2  # what they leave unlinked is found by the trees
ROUNDS, TREES = 2, 3  # rounds of one partner a class, from trees of so many of its keys
PEEL = 4  # keys beyond the least prefix, as a part of it
_INT = pa.int64()


def _scan(share: float):
    """(doc_id, n, cls) of each document and, in rows with n = -1, (token, count) of frequent tokens."""

    def run(batches):
        let_go()
        held, size, done = [], 0, set()

        def frequent():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            most = c >= max(3, share / 2 * c.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(u[most].view(np.int64)), pa.array(np.full(most.sum(), -1)), pa.array(c[most])], names=["doc_id", "n", "cls"]
            )

        for batch in batches:
            ids, ns, cs = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_hashes(text.as_py())
                ids.append(doc)
                ns.append(len(s))
                cs.append(set_id(s) if len(s) else -1)
                if len(s) and cs[-1] not in done:
                    if len(done) < REMEMBERED:
                        done.add(cs[-1])
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, _INT), pa.array(ns, _INT), pa.array(cs, _INT)], names=["doc_id", "n", "cls"])
        if size:
            yield frequent()

    return run


def _first_of_each(batches, done: set):
    """Non-empty sets of the batches, each class once in a task: (cls, set, text)."""
    for batch in batches:
        for text in batch.column(0):
            s = shingle_hashes(text.as_py())
            if len(s) and (c := set_id(s)) not in done:
                if len(done) < REMEMBERED:  # beyond it copies are sent again, which changes no result
                    done.add(c)
                yield c, s, text


def _extra(n: int, num: int, den: int) -> int:
    """l of a set of n tokens: how many keys it has in common with any set of its size that links with it."""
    return max(1, (n - (num * n + den - 1) // den + 1) // PEEL)


def _needed(num: int, den: int) -> str:
    """The keys that a class of ``n`` tokens has in common with the smallest set that can link with it (SQL)."""
    m = f"((n * {num} + {den - 1}) div {den})"
    return f"greatest(1, ({m} - ({m} * {num} + {den - 1}) div {den} + 1) div {PEEL})"


def _prefixes(frequent, num: int, den: int):
    """(key, n, cls): the prefix tokens of each class, frequent tokens last."""

    def run(batches):
        let_go()
        late, keys, cls, ns, size = frequent.value, [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(np.array(ns, np.int32), each := [len(k) for k in keys])),
                    pa.array(np.repeat(np.array(cls, np.int64), each)),
                ],
                names=["key", "n", "cls"],
            )

        for c, s, _ in _first_of_each(batches, set()):
            n = len(s)
            p = n - (num * n + den - 1) // den + _extra(n, num, den)
            if len(late):
                at = np.searchsorted(late, s)
                at[at == len(late)] = 0
                hot = late[at] == s
                if hot[:p].any():
                    s = np.concatenate((s[~hot], s[hot]))
            keys.append(s[:p])
            cls.append(c)
            ns.append(n)
            size += p
            if size >= 100_000:
                yield out()
                keys, cls, ns, size = [], [], [], 0
        if keys:
            yield out()

    return run


def _shared(num: int, den: int):
    """Of rows sorted by (key, n, cls): those with a neighbour of the key that sizes allow a link with.

    Each row also gets a hub: the first class of the run whose size can link with its own.
    """

    def run(batches):
        let_go()
        last = None  # the last row, its hub and whether it is out already
        for batch in batches:
            k, n, c = (batch.column(i).to_numpy() for i in range(3))
            if not len(k):
                continue
            if last is not None:
                k, n, c = (np.concatenate(([h], x)).astype(x.dtype) for h, x in zip(last[:3], (k, n, c), strict=True))
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            k, n, c = k[fresh], n[fresh], c[fresh]
            near = np.concatenate(([False], (k[1:] == k[:-1]) & (den * n[:-1].astype(np.int64) >= num * n[1:].astype(np.int64))))
            hub, hub_n = c.copy(), n.copy()
            if last is not None:
                hub[0], hub_n[0] = last[3], last[4]
            starts = np.flatnonzero(~near)
            ends = np.append(starts[1:], len(k))
            for i, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                while i < end:  # a hub serves the sizes that can link with it; the next row is the next hub
                    to = i + max(1, int(np.searchsorted(n[i:end], hub_n[i] * den // num, "right")))
                    hub[i:to], hub_n[i:to] = hub[i], hub_n[i]
                    i = to
            keep = near | np.concatenate((near[1:], [False]))
            if last is not None and last[5]:
                keep[0] = False
            out = bool(near[-1]) or (len(k) == 1 and last is not None and last[5])
            last = (k[-1], n[-1], c[-1], hub[-1], hub_n[-1], out)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (k, c, n, hub, hub_n.astype(np.int32))], names=["key", "cls", "n", "hub", "hub_n"]
                )

    return run


def _class_rows(needed, per: int):
    """(cls, text, bits) of the classes that the filter lets through."""

    def run(batches):
        let_go()
        wanted, cls, texts, maps, size = needed.value, [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(cls, _INT), pa.array(texts, pa.string()), pa.array(maps, pa.binary())], names=["cls", "text", "bits"])

        for c, s, text in _first_of_each(batches, set()):
            if not int(wanted[(c >> 6) % FILTER_WORDS]) >> (c & 63) & 1:
                continue
            cls.append(c)
            texts.append(text.as_py())
            maps.append(bitmap(s, width_for(len(s), per)).tobytes())
            size += len(s)
            if size >= 500_000:
                yield out()
                cls, texts, maps, size = [], [], [], 0
        if cls:
            yield out()

    return run


def _filter_of(classes: DataFrame):
    """A broadcast bit filter of fixed size that lets all of ``classes(cls)`` through, and few others."""
    words = classes.groupBy(F.expr(f"shiftright(cls, 6) % {FILTER_WORDS}").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cls & 63 as int))")).alias("v"))
    bits = np.zeros(FILTER_WORDS, np.int64)
    got = words.toArrow()  # at most FILTER_WORDS rows
    bits[got.column("w").to_numpy().astype(np.int64)] = got.column("v").to_numpy()
    return classes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def _verify(num: int, den: int):
    def run(batches):
        let_go()
        seen = None, None  # rows come sorted by b: its set is made once
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if seen[0] != b:
                    seen = b, shingle_hashes(y.as_py())
                own, other = shingle_hashes(x.as_py()), seen[1]
                o = overlap(own, other)
                keep.append(den * o >= num * (len(own) + len(other) - o))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    t = sets.select("cls", "text")

    def side(name: str) -> DataFrame:
        """The texts of one side's classes; a counted, small set of ids keeps the others out of the shuffle."""
        ids = written(pairs.select(F.col(name).alias("cls")).distinct(), "compared-ids")
        own = t.join(F.broadcast(ids), "cls", "left_semi") if ids.count() <= SENT_IDS else t
        return own.select(F.col("cls").alias(name), F.col("text").alias("t" + name)).hint("shuffle_merge")

    # many pairs may share one b: that join is left to a skew join
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    return x.select("a", "b", "ta", "tb").mapInArrow(_verify(num, den), "a long, b long")


def _search(num: int, den: int, traversal):
    """Candidate pairs, their components and bounds, of rows sorted by (key, i, j): signature trees over each run."""

    def pairs(rows):
        """rows: (side, n, cls, comp, bits). One block against itself, or block 0 against block 1."""
        trees = []
        for side in (0, 1):
            own, least = [r for r in rows if r[0] == side], {}
            for r in own:
                least[r[3]] = min(r[1], least.get(r[3], r[1]))
            own.sort(key=lambda r: (least[r[3]], r[3], r[1], r[2]))  # by size, each component together
            trees.append((build([r[1] for r in own], [np.frombuffer(r[4], np.uint64) for r in own], [r[3] for r in own]), own))
        (x, xs), (y, ys) = trees
        if y is None:
            y, ys = x, xs
        if x is not None:
            for i, j, most in traversal(x, y, num, den):
                a, b = xs[i], ys[j]
                yield (a[2], b[2], a[3], b[3], most) if a[2] < b[2] else (b[2], a[2], b[3], a[3], most)

    def run(batches):
        let_go()
        key, rows, done = None, [], set()

        def found():
            new = [p for p in pairs(rows) if p[:2] not in done]
            if len(done) < REMEMBERED:
                done.update(p[:2] for p in new)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], _INT) for k in range(5)], names=["a", "b", "ca", "cb", "most"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    if len(rows) > 1:
                        yield found()
                    key, rows = r[:3], []
                rows.append(r[3:])
        if len(rows) > 1:
            yield found()

    return run


def _best_hubs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each class of ``shared(key, cls, n, hub, hub_n)`` and its best few hubs.

    Links nearly always have most of the prefix in common: what has less is left to the trees.
    """
    near = f"{den} * least(n, hub_n) >= {num} * greatest(n, hub_n)"
    return (
        shared.where(near).groupBy("cls", "n", "hub").agg(F.count("*").alias("k"))
        .where(f"2 * k >= n - {num} * n / {den}")
        .groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("k", "hub")), asc=False).alias("h"))
        .select(F.col("cls").alias("a"), F.explode(F.slice("h", 1, HUBS)).alias("h"))
        .select("a", F.col("h.hub").alias("b"))
    )


def _peeled(rows: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The ``rows(key, cls, n, ...)`` of classes with as many keys as a link needs."""
    x = rows.withColumn("keys", F.count("*").over(Window.partitionBy("cls")))
    return written(x.where(f"keys >= {_needed(num, den)}").drop("keys"), name)


def _by_key(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Of ``rows(key, n, cls)``: those with a neighbour that sizes allow a link with, and their hubs."""
    x = rows.select("key", "n", "cls").repartition(parts, "key").sortWithinPartitions("key", "n", "cls")
    return x.mapInArrow(_shared(num, den), "key long, cls long, n int, hub long, hub_n int")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of keys that join different components."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(written(keys, "open-keys").hint("shuffle_merge"), "key")


def _unlike(rows: DataFrame, block: int) -> DataFrame:
    """Of keys with the same members the rows of one, and the blocks they need; identity is two 64-bit hashes."""
    keys = rows.groupBy("key").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(cls))").alias("x"), F.expr("bit_xor(xxhash64(cls, 1))").alias("y"), F.min("cls").alias("lead"))
    keys = keys.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.min("lead").alias("lead"))
    keys = written(keys.select("key", "lead", F.expr(f"cast(ceil(m / {block}) as int)").alias("blocks")), "tree-keys")
    return rows.join(keys.hint("shuffle_merge"), "key")


def _left(rows: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """The ``rows(key, cls, n, ...)``, with components, of keys that still join different ones and classes with enough of them."""
    x = rows.select("key", "cls", "n").join(comps.select(F.col("node").alias("cls"), "root").hint("shuffle_merge"), "cls", "left")
    x = written(x.select("key", "cls", "n", F.coalesce("root", "cls").alias("comp")), "keys-by-component")
    return _peeled(_open(x), num, den, "keys-to-search")


def _candidates(rows: DataFrame, sets: DataFrame, parts: int, block: int, search) -> DataFrame:
    """(a, b, ca, cb, most) that the signature trees of ``rows(key, cls, n, comp)`` find."""
    rows = _unlike(rows, block).join(sets.select("cls", "bits").hint("shuffle_merge"), "cls")
    # block pairs (i, j), i <= j: each member goes to those of its own block
    mine = F.expr("cast(pmod(cls, blocks) as int)")
    rows = rows.withColumn("own", mine).select(
        "key", "lead", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j, if(x < own, 1, 0) as side))")).alias("p"), "n", "cls", "comp", "bits"
    )
    # keys with the same first member mostly have the same ones: a task that gets several of them names a pair once
    rows = rows.select("key", "p.i", "p.j", "p.side", "n", "cls", "comp", "bits", "lead", F.expr("pmod(key, 32)").alias("salt"))
    rows = rows.repartition(parts, "lead", "salt", "i", "j").sortWithinPartitions("key", "i", "j").drop("lead", "salt")
    pairs = rows.mapInArrow(search, "a long, b long, ca long, cb long, most long").groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("ca", "cb", "most")])
    return written(pairs, "tree-pairs")


def jaccard_components(
    docs: DataFrame, threshold: tuple[int, int] = (80, 100), share: float = 2.0**-20, block: int = 1024, per: int = 8
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of every document of ``docs(doc_id, text)``.

    ``threshold``: num/den of the Jaccard similarity that links. ``share``: the
    part of all tokens that makes one frequent. ``block``: most members of a key
    in one tree. ``per``: bitmap bits for each shingle.
    """
    spark = docs.sparkSession
    num, den = threshold
    parts = partitions_for(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = docs.select("text").where("text is not null")

    scan = written(docs.mapInArrow(_scan(share), "doc_id long, n long, cls long"), "shingle-scan")
    meta = scan.where("n >= 0")
    total = meta.agg(F.sum("n")).first()[0] or 0
    frequent = (
        scan.where("n < 0").groupBy("doc_id").agg(F.sum("cls").alias("times")).where(F.col("times") >= max(3, int(share / 2 * total))).select("doc_id").toArrow()
    )  # at most 2 / share tokens
    late = spark.sparkContext.broadcast(np.sort(frequent.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    keys = texts.mapInArrow(_prefixes(late, num, den), "key long, n int, cls long")
    likely = _peeled(_by_key(keys, parts, num, den).select("key", "n", "cls"), num, den, "likely-keys")
    shared = written(_by_key(likely, parts, num, den), "shared-keys")
    sets = texts.mapInArrow(_class_rows(_filter_of(shared.select("cls")), per), "cls long, text string, bits binary")
    sets = written(sets.dropDuplicates(["cls"]), "class-rows")

    # a few hubs for each class: those with most keys in common, if sizes allow a link
    hubs = written(_best_hubs(shared.where("cls <> hub"), num, den), "hub-pairs")
    stars = written(_compared(hubs, sets, num, den), "star-links")
    comps = written(components(stars), "star-components")

    # one partner a class and round: keys and classes that are done don't come again
    rows = shared.select("key", "cls", "n")
    for k in range(ROUNDS):
        rows = _left(rows, comps, num, den)
        turn = Window.partitionBy("cls").orderBy(F.xxhash64("key", F.lit(k)), "key")
        some = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= TREES).drop("turn")
        pairs = _candidates(some, sets, parts, block, _search(num, den, best_partners))
        stars = stars.unionByName(written(_compared(pairs.select("a", "b"), sets, num, den), "partner-links"))
        comps = written(components(stars), "star-components")

    pairs = _candidates(_left(rows, comps, num, den), sets, parts, block, _search(num, den, dual_traversal))

    # the likeliest pairs of two components first; what they join needs no more comparing
    for take in WAVES:
        if pairs.isEmpty():
            break
        both = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("most"), "a", "b")
        ranked = pairs.withColumn("r", F.row_number().over(both)) if take else pairs.withColumn("r", F.lit(0))
        ranked = written(ranked, "ranked-pairs")
        now = written(ranked.where(F.col("r") <= take).select("a", "b"), "compared-pairs")
        stars = stars.unionByName(written(_compared(now, sets, num, den), "tree-links"))
        if not take:
            break
        comps = written(components(stars), "star-components").withColumnRenamed("node", "ca")
        left = ranked.where(F.col("r") > take).drop("r")
        for c in ("ca", "cb"):  # the component's name is one of its classes
            named = comps.withColumnRenamed("ca", c)
            left = left.join(named.hint("shuffle_merge"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        pairs = written(left.where("ca <> cb"), "open-pairs")

    joined = written(components(stars), "set-components")
    first = meta.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("d"))
    named = first.join(joined.select(F.col("node").alias("cls"), "root").hint("shuffle_merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = written(named, "classes-by-root")
    lowest = written(named.groupBy("root").agg(F.min("d").alias("component_id")), "component-ids")
    named = written(named.join(lowest.hint("shuffle_merge"), "root").select("cls", "component_id"), "class-components")
    out = meta.join(named.hint("shuffle_merge"), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **kinds) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns stay."""
    gone = written(jaccard_components(docs, **kinds).where("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    few = gone.count() <= SENT_IDS  # else the documents' rows move
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_merge"), "doc_id", "left_anti").select(docs.columns)
