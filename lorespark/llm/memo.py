"""Bounded memories that a Python worker keeps from task to task: one operator's at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gave for the key in this worker; another key's is let go first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For tasks that keep nothing themselves: what another operator left in this worker goes."""
    _held.clear()


class Memo:
    """Two generations of at most ``most`` chunks each; the older goes when the younger is full."""

    def __init__(self, learn: Callable[[str], int], most: int = 200_000):
        self.learn, self.most = learn, most
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def codes(self, chunks: list[str]) -> list[int]:
        """The code of each chunk."""
        young = self.young
        out = list(map(young.get, chunks))
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    c = chunks[k]
                    v = young.get(c)
                    if v is None:
                        v = self.old.get(c)
                        if v is None:
                            v = self.learn(c)
                        young[c] = v
                    out[k] = v
            if len(young) > self.most:
                self.old, self.young = young, {}
        return out
