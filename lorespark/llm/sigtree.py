"""Signature trees: nodes of OR-combined token bitmaps and size ranges, and their dual traversal.

Leaves hold up to ``LEAF`` members, whose bitmaps are compared as matrices.
All bounds are upper bounds of the overlap: common shingles set common bits,
and a member has ``excess`` shingles beyond its distinct bits.
"""

from __future__ import annotations

import numpy as np

from lorespark.llm.shingles import fold

LEAF = 16


class Node:
    """Members [lo, hi): OR-ed bitmap, size range, greatest excess, common component or None."""

    __slots__ = ("lo", "hi", "bits", "small", "large", "excess", "group", "kids", "leaf")

    def __init__(self, lo, hi, bits, small, large, excess, group, kids=(), leaf=None):
        self.lo, self.hi, self.bits, self.small, self.large = lo, hi, bits, small, large
        self.excess, self.group, self.kids, self.leaf = excess, group, kids, leaf


def _leaf(lo: int, sizes: list[int], bitmaps: list[np.ndarray], groups: list[int]) -> Node:
    words = min(map(len, bitmaps))
    rows = np.stack([fold(b, words) for b in bitmaps])
    n, g = np.array(sizes, np.int64), np.array(groups, np.int64)
    excess = n - np.bitwise_count(rows).sum(1).astype(np.int64)
    return Node(
        lo, lo + len(sizes), np.bitwise_or.reduce(rows), int(n.min()), int(n.max()), int(excess.max()),
        groups[0] if (g == g[0]).all() else None, leaf=(rows, n, excess, g),
    )


def _lost(bits: np.ndarray, folded: np.ndarray) -> int:
    """Bits that folding lost to collisions, which may hide as many common shingles."""
    return 0 if len(bits) == len(folded) else int(np.bitwise_count(bits).sum()) - int(np.bitwise_count(folded).sum())


def build(sizes: list[int], bitmaps: list[np.ndarray], groups: list[int]) -> Node | None:
    """A tree over the members in the given order, in which like ones should be neighbours."""
    level = [_leaf(k, sizes[k : k + LEAF], bitmaps[k : k + LEAF], groups[k : k + LEAF]) for k in range(0, len(sizes), LEAF)]
    while len(level) > 1:
        up = []
        for x, y in zip(level[::2], level[1::2], strict=False):
            words = min(len(x.bits), len(y.bits))
            a, b = fold(x.bits, words), fold(y.bits, words)
            excess = max(x.excess + _lost(x.bits, a), y.excess + _lost(y.bits, b))
            group = x.group if x.group == y.group else None
            up.append(Node(x.lo, y.hi, a | b, min(x.small, y.small), max(x.large, y.large), excess, group, (x, y)))
        level = up + level[len(up) * 2 :]
    return level[0] if level else None


def may_link(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether some member of x and some of y of another component can have Jaccard >= num/den."""
    if x.group is not None and x.group == y.group:
        return False
    if den * x.large < num * y.small or den * y.large < num * x.small:
        return False
    words = min(len(x.bits), len(y.bits))
    a, b = fold(x.bits, words), fold(y.bits, words)
    most = int(np.bitwise_count(a & b).sum()) + min(x.excess + _lost(x.bits, a), y.excess + _lost(y.bits, b))
    # an overlap o of sizes p and q links when den * o >= num * (p + q - o)
    return (den + num) * most >= num * (x.small + y.small)


def _leaf_bounds(x: Node, y: Node, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest overlap of each two members, and whether they may link."""
    (a, n, ea, ga), (b, m, eb, gb) = x.leaf, y.leaf
    words = min(a.shape[1], b.shape[1])
    fa, fb = (np.stack([fold(r, words) for r in s]) if s.shape[1] > words else s for s in (a, b))
    ea = ea + (np.bitwise_count(a).sum(1).astype(np.int64) - np.bitwise_count(fa).sum(1))
    eb = eb + (np.bitwise_count(b).sum(1).astype(np.int64) - np.bitwise_count(fb).sum(1))
    most = np.bitwise_count(fa[:, None, :] & fb[None, :, :]).sum(2).astype(np.int64) + np.minimum(ea[:, None], eb[None, :])
    most = np.minimum(most, np.minimum(n[:, None], m[None, :]))
    ok = ((den + num) * most >= num * (n[:, None] + m[None, :])) & (ga[:, None] != gb[None, :])
    return most, np.triu(ok, 1) if x is y else ok


def _leaf_pairs(x: Node, y: Node, num: int, den: int):
    most, ok = _leaf_bounds(x, y, num, den)
    for i, j in zip(*np.nonzero(ok), strict=True):
        yield x.lo + int(i), y.lo + int(j), int(most[i, j])


def _leaves(x: Node, y: Node, num: int, den: int):
    """The pairs of leaves that no bound rules out; of a tree with itself each pair once."""
    stack = [(x, y)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.group is not None:
                continue
            if a.leaf is not None:
                yield a, a
            else:
                p, q = a.kids
                stack += [(p, p), (p, q), (q, q)]
        elif may_link(a, b, num, den):
            if a.leaf is not None and b.leaf is not None:
                yield a, b
            elif b.leaf is not None or (a.leaf is None and a.hi - a.lo >= b.hi - b.lo):
                stack += [(k, b) for k in a.kids]
            else:
                stack += [(a, k) for k in b.kids]


def dual_traversal(x: Node, y: Node, num: int, den: int):
    """(i, j, bound) of members that no bound rules out; a tree against itself gives each pair once."""
    for a, b in _leaves(x, y, num, den):
        yield from _leaf_pairs(a, b, num, den)


def best_partners(x: Node, y: Node, num: int, den: int):
    """(i, j, bound): for each member of either tree the one of the other that it may have most in common with, if any."""
    best = [np.full(t.hi, -1, np.int64) for t in (x, y)]
    who = [np.zeros(t.hi, np.int64) for t in (x, y)]
    if x is y:
        best[1], who[1] = best[0], who[0]
    for a, b in _leaves(x, y, num, den):
        most, ok = _leaf_bounds(a, b, num, den)
        most = np.where(ok, most, -1)
        for side, node, other, m in ((0, a, b, most), (1, b, a, most.T)):
            top = m.max(1)
            own = slice(node.lo, node.lo + len(top))
            new = top > best[side][own]
            best[side][own] = np.where(new, top, best[side][own])
            who[side][own] = np.where(new, other.lo + m.argmax(1), who[side][own])
    for i in np.flatnonzero(best[0] >= 0).tolist():
        yield i, int(who[0][i]), int(best[0][i])
    if x is not y:
        for j in np.flatnonzero(best[1] >= 0).tolist():
            yield int(who[1][j]), j, int(best[1][j])
