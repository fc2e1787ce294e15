"""A bounded memo for what a worker finds out about short strings again and again."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Memo:
    """Two generations of at most about ``kept`` keys each. What is used moves to the young
    one; when that is full it becomes the old one, and what was not used since is forgotten.
    Keys of over ``longest`` characters are not kept."""

    def __init__(self, make: Callable[[list[str]], list[Any]], kept: int, longest: int = 48):
        self.make, self.kept, self.longest = make, kept, longest
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def __call__(self, keys: list[str]) -> list[Any]:
        """The value of each key; ``make`` gets every unknown key once."""
        young, old = self.young, self.old
        new = set(keys) - young.keys()
        again = new & old.keys()
        young.update((k, old[k]) for k in again)
        unknown = list(new - again)
        young.update(zip(unknown, self.make(unknown), strict=True))
        out = [young[k] for k in keys]
        for k in unknown:
            if len(k) > self.longest:
                del young[k]
        if len(young) > self.kept:
            self.old, self.young = young, {}
        return out
