"""Spelling variants through a bit-sliced position index.

Words are counted over all texts, and those of ``LEAST_LENGTH`` letters and ``LEAST_COUNT``
occurrences make the vocabulary. In the index a (position, letter) is a bitset over words. A
query of length m goes through its letters once: the set of words equal up to here is met with
the bitset of the next position and letter; beside it two sets with one error are carried along, of
a replaced letter (same position) and of an inserted one (position shifted by one), each fed from
the set without errors. What is left at the end, by length, is one edit away. All queries of
a block go at once, 64 words at a time. A pair of neighbouring lengths is asked for by the shorter
word only, so that one shift does for insertions and deletions.

The vocabulary is dealt out so that no index holds all of it: of two words one edit apart, the
shorter of length m, the first m // 2 letters are the same, or else the last m // 2. So each word
goes, for its own length and the one below, to the parts of its start and its end. Parts
of more than ``BLOCK`` words are cut into pairs of blocks. A task gives each word its number
of neighbours and the best one, never pairs.

Forms are followed by doubling: n at least doubles at each step, so six rounds reach any end.

Defined results. Null and empty texts have no words; a null doc_id counts as empty in the
checksum; repeated rows count each; a run of letters is one word however long; ``most_bytes``
of letters a block bound a task's index for very long ones. An empty table gives no rows. Columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import partitions_for, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
SLIP = 97  # a run loses a letter where this divides its checksum
BLOCK, BLOCK_BYTES = 2048, 2_000_000
ASKED = 1024  # queries that go through the index at once
SENT_PARTS = 200_000
ROUNDS = 6  # 2 ** 6 steps of doubling: n fits a long


def runs(docs: DataFrame) -> DataFrame:
    """(word): each run of letters of ``docs(doc_id, text)`` as it counts: A-Z in lower case, one letter less where ``SLIP`` divides the checksum."""
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("doc_id", F.lit(":"), "run")), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return x.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary_of(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``length`` letters or more that occur ``count`` times or more."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _letters(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _position(column: np.ndarray, words: int) -> np.ndarray:
    """The bitsets of one position: a row of ``words`` 64-bit words for each letter."""
    out = np.zeros((256, words * 8), np.uint8)
    for c in np.unique(column):
        bits = np.packbits(column == c, bitorder="little")
        out[c, : len(bits)] = bits
    return out.view(np.uint64)


def near_words(asked: np.ndarray, held: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (query, word) that are one edit apart.

    ``asked``: letters of queries of one length m, an m-column matrix; ``held``: letters of words of length m, and
    of m + 1 where ``longer`` says so, m + 1 columns.
    """
    m, words = asked.shape[1], -(-len(held) // 64)

    def bits(flags):
        full = np.zeros(words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        full[: len(packed)] = packed
        return full.view(np.uint64)

    out = []
    parts = [asked[k : k + ASKED] for k in range(0, len(asked), ASKED)]
    zero = [np.tile(bits(np.ones(len(held), bool)), (len(q), 1)) for q in parts]
    other, more = [np.zeros_like(z) for z in zero], [np.zeros_like(z) for z in zero]
    here = _position(held[:, 0], words)
    for p in range(m):
        after = _position(held[:, p + 1], words)
        for k, q in enumerate(parts):
            same = here[q[:, p]]
            other[k] = (other[k] & same) | (zero[k] & ~same)
            more[k] = (more[k] | zero[k]) & after[q[:, p]]
            zero[k] = zero[k] & same
        here = after
    equal, long = bits(~longer), bits(longer)
    for k in range(len(parts)):
        found = (other[k] & equal) | ((more[k] | zero[k]) & long)
        at, w = np.nonzero(found)
        row, bit = np.nonzero(np.unpackbits(found[at, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        out.append((at[row] + k * ASKED, w[row] * 64 + bit))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _asked(block: int, most_bytes: int):
    """(word, n_near, best_n, best) of rows sorted by (size, side, part, i, j): whole parts until a block is full, pairs of blocks of cut parts alone."""

    def out(size, side, asked, held):
        if not asked or not held:
            return None
        words, n = [w for w, _ in asked + held], np.array([n for _, n in asked + held], np.int64)
        a = _letters(words[: len(asked)], size)
        h = _letters(words[len(asked) :], size + 1)
        longer = h[:, size] != 0
        q, m = near_words(a, h, longer)
        half = size // 2
        start = (a[q][:, :half] == h[m][:, :half]).all(1)
        keep = start if side == 0 else ~start  # pairs with the same start and end count by the start
        q, m = q[keep], m[keep]
        if not len(q):
            return None
        back = longer[m]  # longer words don't ask
        m = m + len(asked)
        own, far = np.concatenate((q, m[back])), np.concatenate((m, q[back]))
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[far], -n[far], own))
        own, far = own[order], far[order]
        who, first, near = np.unique(own, return_index=True, return_counts=True)
        best = far[first]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in who]), pa.array(near.astype(np.int64)), pa.array(n[best]), pa.array([words[k] for k in best])], names=["word", "n_near", "best_n", "best"]
        )

    def run(batches):
        key, asked, held, letters, alone = None, [], [], 0, False
        for batch in batches:
            for size, side, part, i, j, cut, asks, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (size, side, part, i, j)
                if now != key:
                    full = letters >= most_bytes or len(held) >= block
                    if key is not None and (now[:2] != key[:2] or alone or cut or full):
                        if (done := out(*key[:2], asked, held)) is not None:
                            yield done
                        asked, held, letters = [], [], 0
                    key, alone = now, cut
                (asked if asks else held).append((word, n))
                letters += len(word)
        if key is not None and (done := out(*key[:2], asked, held)) is not None:
            yield done

    return run


def near_counts(words: DataFrame, block: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(word, n_near, best_n, best): of the written ``words(word, n)`` that have neighbours, how many and the most frequent one."""
    size = F.length("word")

    def places(tag: Column, asks: bool) -> Column:
        half = F.floor(tag / 2).cast("int")
        ends = (F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - half + 1))
        one = [F.struct(tag.cast("int").alias("size"), F.lit(s).alias("side"), F.xxhash64(e).alias("part"), F.lit(asks).alias("asks")) for s, e in enumerate(ends)]
        return F.array(*one)

    least = F.lit(LEAST_LENGTH)
    below = F.when(size > least, places(size - 1, False)).otherwise(F.filter(places(size, False), lambda x: F.lit(False)))
    rows = words.select("word", "n", F.explode(F.concat(places(size, True), places(size, False), below)).alias("p")).select("p.*", "word", "n")
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(most_bytes) / F.col("size"))))
    counts = rows.groupBy("size", "side", "part").agg(F.count_if(~F.col("asks")).alias("m"), F.count_if("asks").alias("q"))
    cuts = counts.select("size", "side", "part", F.ceil(F.col("m") / own).cast("int").alias("mi"), F.ceil(F.col("q") / own).cast("int").alias("qj")).where("qj > 0 and (mi > 1 or qj > 1)")
    cuts = written(cuts, "parts-of-blocks")
    cuts = F.broadcast(cuts) if cuts.count() <= SENT_PARTS else cuts.hint("shuffle_merge")
    one = F.lit(1)
    x = rows.join(cuts, ["size", "side", "part"], "left").withColumns({"cut": F.col("mi").isNotNull(), "mi": F.coalesce("mi", one), "qj": F.coalesce("qj", one)})
    spread, asks = F.pmod(F.xxhash64("word"), F.lit(1 << 30)), F.col("asks")
    copies = F.explode(F.sequence(F.lit(0), F.when(asks, F.col("mi")).otherwise(F.col("qj")) - 1))
    x = x.withColumn("at", F.pmod(spread, F.when(asks, F.col("qj")).otherwise(F.col("mi"))).cast("int")).withColumn("copy", copies)
    x = x.withColumns({"i": F.when(asks, F.col("copy")).otherwise(F.col("at")), "j": F.when(asks, F.col("at")).otherwise(F.col("copy"))})
    x = x.select("size", "side", "part", "i", "j", "cut", "asks", "word", "n")
    dealt = x.repartition(partitions_for(words.sparkSession), "size", "side", "part", "i", "j").sortWithinPartitions("size", "side", "part", "i", "j")
    found = dealt.mapInArrow(_asked(block, most_bytes), "word string, n_near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where ``forms(word, form)`` end, by doubling."""
    up = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    for _ in range(ROUNDS):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        up = up.select("word", "root").join(further.hint("shuffle_merge"), "root", "left")
        up = written(up.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "forms")
        if up.where("moved").isEmpty():
            break
    return up.select("word", "root")


def spelling_groups(docs: DataFrame, block: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``."""
    words = written(vocabulary_of(runs(docs)), "spelling-words")
    near = written(near_counts(words, block, most_bytes), "near-words")
    x = written(words.join(near.hint("shuffle_merge"), "word", "left").withColumn("ok", F.col("best_n") >= 2 * F.col("n")), "spelling-forms")
    ends = roots(x.where("ok").select("word", F.col("best").alias("form")))
    x = x.join(ends.hint("shuffle_merge"), "word", "left")
    form, form_n = F.when(F.col("ok"), F.col("best")), F.when(F.col("ok"), F.col("best_n"))
    return x.select("word", form.alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
