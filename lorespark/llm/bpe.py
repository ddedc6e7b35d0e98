"""Byte-pair encoding and decoding through a trie of distinct words.

Each task gathers the distinct words of a batch that it hasn't seen, inserts
them into a trie and walks it depth first. A node keeps one number: the last
token of its prefix's encoding, found from the states above it, so whatever
words share is encoded once. The whole encoding of a word is read back along
its path. A token can follow another iff no merge across their border would
have happened first, which a walk down both tokens' merge histories tells.

The results are those of the ``tokenizers`` library for a vocabulary file of
this form (NFC, white space, lower case; split pattern; byte level; word ends),
without truncation, padding or added special tokens. Texts may hold the special
tokens' strings, which become those tokens. The vocabulary's path is a
parameter; a task loads it once in its Python worker.

Defined results. Null counts as empty: no tokens, both digests of "". Repeated
rows give equal rows, an empty table no rows; other columns are ignored. A very long
text is encoded whole, and so is a word as long as its text. What a worker remembers is
bounded in bytes: chunks' encodings by ``most``, which pairs of tokens may stand together by ``PAIRS``
of about ``PAIR_BYTES``, two generations of each. It changes no result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.memo import held

CACHED = 120_000_000  # bytes that a generation of remembered encodings takes, about: two of them a worker
EACH = 250  # of which an entry's objects, beside its letters
BLOCK = 2_000_000  # letters of texts that are encoded at once
PAIRS, PAIR_BYTES = 60_000, 170  # remembered pairs of tokens in a generation, of two; bytes that one takes
#: White space as the normalizer has it; str.split also cuts at \x1c-\x1f.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class TrieBPE:
    """The vocabulary, its merges, and the trie encoder."""

    def __init__(self, path: str, pairs: int = PAIRS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[a, b] = r
            self.made[a, b] = c
            self.parts.setdefault(c, (a, b))
        self.born = {c: self.rank[p] for c, p in self.parts.items()}
        self.longest = max(len(s.removesuffix(_END)) for s in self.vocab)
        # the longest token that ends in three letters: longer tails with that end needn't be looked up
        self.reach: dict[str, int] = {}
        self.reach_end: dict[str, int] = {}
        for t in self.vocab:
            own, into = (t[: -len(_END)], self.reach_end) if t.endswith(_END) else (t, self.reach)
            into[own[-3:]] = max(len(own), into.get(own[-3:], 0))
        self.pairs = pairs
        self.fits: dict[tuple[int, int], bool] = {}  # the younger generation; when it is full the older one goes
        self.fitted: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}  # of tokens: no more than the vocabulary

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joined strings is [a, b]."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fitted.get((a, b))
            if known is None:
                known = self._follows(a, b)
            if len(self.fits) >= self.pairs:
                self.fitted, self.fits = self.fits, {}
            self.fits[a, b] = known
        return known

    def _follows(self, x: int, y: int) -> bool:
        rank, parts, born = self.rank, self.parts, self.born
        # x and y are the parts at the border; they stay apart until rank `until`.
        # The last merge of the two is undone first. Of equal ranks the left one
        # happens first: x's own merge precedes one across, y's own comes after it.
        until = float("inf")
        while True:
            r = rank.get((x, y))
            if r is not None and r < until:
                return False
            bx, by = born.get(x, -1), born.get(y, -1)
            if bx < 0 and by < 0:
                return True
            if bx > by:
                until, x = bx, parts[x][1]
            else:
                until, y = by + 0.5, parts[y][0]

    def is_whole(self, t: int) -> bool:
        """Whether the token is the encoding of its own string."""
        known = self.whole.get(t)
        if known is None:
            if t not in self.parts:
                known = True
            else:
                known = self._plain(self._symbols(self.strings[t])) == [t]
            self.whole[t] = known
        return known

    def _symbols(self, s: str) -> list[int]:
        if s.endswith(_END) and s != _END:
            s = s[: -len(_END)]
            return [*(self.vocab[c] for c in s[:-1]), self.vocab[s[-1] + _END]]
        return [self.vocab[c] for c in s]

    def _plain(self, ids: list[int]) -> list[int]:
        """Merge by merge, lowest rank and leftmost first."""
        while len(ids) > 1:
            r, k = min((self.rank.get((ids[k], ids[k + 1]), 1 << 60), k) for k in range(len(ids) - 1))
            if r == 1 << 60:
                break
            ids[k : k + 2] = [self.made[ids[k], ids[k + 1]]]
        return ids

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of byte-letter words, through one trie."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = {}
                node = nxt
            node.setdefault("", []).append(w)
        out: dict[str, tuple[int, ...]] = {}
        last, longest = [-1], self.longest  # last[d]: last token of the first d letters' encoding
        stack = [(iter(root.items()), "")]  # a node's branches, and the last letters on the way to it
        while stack:
            nodes, tail = stack[-1]
            for c, sub in nodes:
                if c == "":
                    for w in sub:
                        out[w] = self._read_back(w, last)
                    continue
                tail = tail + c if len(tail) < longest else tail[1:] + c
                last.append(self._last(tail, len(last), last, ""))
                stack.append((iter(sub.items()), tail))
                break
            else:
                stack.pop()
                last.pop()
        return out

    def _last(self, tail: str, depth: int, last: list[int], end: str) -> int:
        """The token that ends the encoding of the first ``depth`` letters, whose tail is given."""
        vocab, size = self.vocab, len(tail)
        most = max(2, (self.reach_end if end else self.reach).get(tail[-3:], 0))
        fits, whole = self.fits, self.whole
        for k in range(size - most if most < size else 0, size):
            t = vocab.get(tail[k:] + end if end else tail[k:])
            if t is None:
                continue
            before = depth - size + k
            if before:
                fit = fits.get((last[before], t))
                if not (self.follows(last[before], t) if fit is None else fit):
                    continue
            if whole.get(t) or self.is_whole(t):
                return t
        raise ValueError(f"no token ends {tail!r}")

    def _read_back(self, w: str, last: list[int]) -> tuple[int, ...]:
        t = self._last(w[-self.longest :], len(w), last, _END)
        ids, at = [t], len(w) - len(self.strings[t]) + len(_END)
        while at:
            ids.append(last[at])
            at -= len(self.strings[last[at]])
        return tuple(ids[::-1])

    def words_of(self, chunk: str) -> list[str | int]:
        """A white-space-free chunk's words in byte letters, and special tokens as ids."""
        pieces = self.special_at.split(chunk) if self.special_at and "<|" in chunk else [chunk]
        out: list[str | int] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(self.special[piece])
                continue
            if not piece.isascii():
                # letter by letter: no rule for a final sigma
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            for w in self.pattern.findall(piece.lower()):
                out.append(w if w.isascii() and w.isprintable() else "".join(self.letters[b] for b in w.encode()))
        return out


def encoder(path: str, most: int = CACHED) -> Cached:
    return held(("bpe", path, most), lambda: Cached(path, most))


class Cached:
    """Encodings of chunks: two generations of about ``CACHED`` bytes each."""

    def __init__(self, path: str, most: int = CACHED):
        self.bpe, self.most, self.size = TrieBPE(path), most, 0
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def learn(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        """(number of tokens, their ids, their strings) of every chunk. The cycle collector rests: there are no cycles, and it would go through all that is remembered."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._learn(chunks)
        finally:
            if on:
                gc.enable()

    def _learn(self, chunks: set[str]) -> dict[str, tuple[int, str, str]]:
        out, new, more = {}, {}, {}
        for c in chunks:
            got = self.young.get(c)
            if got is not None:
                out[c] = got
            elif (got := self.old.get(c)) is not None:
                more[c] = got
            else:
                new[c] = self.bpe.words_of(c)
        if new:
            ids = self.bpe.encode_words({w for ws in new.values() for w in ws if isinstance(w, str)})
            strings = self.bpe.strings
            for c, ws in new.items():
                t = [i for w in ws for i in (ids[w] if isinstance(w, str) else (w,))]
                more[c] = (len(t), " ".join(map(str, t)), " ".join([strings[i] for i in t]))
        if more:
            size = sum([EACH + len(c) + len(x[1]) + len(x[2]) for c, x in more.items()])
            if self.size + size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
            if size <= self.most:
                self.young.update(more)
                self.size += size
            out.update(more)
        return out


def chunks_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [c for c in _SPACES.split(text) if c] if _ODD.search(text) else text.split()


def _blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK):
    """(row range, chunk lists) of about ``most`` letters each."""
    texts, start, size, held = batch.column(column), 0, 0, []
    for k in range(batch.num_rows):
        t = texts[k].as_py()
        held.append(chunks_of(t))
        size += len(t or "")
        if size >= most or k == batch.num_rows - 1:
            yield slice(start, k + 1), held
            start, size, held = k + 1, 0, []


def _digest(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(p for p in parts if p).encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, most: int = CACHED, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle. ``most``: bytes of a generation of remembered encodings; ``block``: letters that are encoded at once, with their words' trie."""

    def run(batches):
        own = encoder(path, most)
        for batch in batches:
            for rows, lists in _blocks(batch, 1, block):
                known = own.learn({c for x in lists for c in x})
                ns, ids, decoded = [], [], []
                for x in lists:
                    got = [known[c] for c in x]
                    ns.append(sum([g[0] for g in got]))
                    ids.append(_digest([g[1] for g in got]))
                    decoded.append(_digest([g[2] for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(ns, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Per document the token ids and the decoded text themselves: doc_id, ids array<int>, decoded string."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for rows, lists in _blocks(batch, 1):
                known = own.learn({c for x in lists for c in x})
                ids = [[int(i) for c in x for i in known[c][1].split()] for x in lists]
                decoded = [" ".join([own.bpe.strings[i] for i in x]) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"]
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per document the encoded length alone: n_tokens."""

    def run(batches):
        own = encoder(path)
        for batch in batches:
            for _, lists in _blocks(batch, 0):
                known = own.learn({c for x in lists for c in x})
                yield pa.RecordBatch.from_arrays([pa.array([sum([known[c][0] for c in x]) for x in lists], pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long")
