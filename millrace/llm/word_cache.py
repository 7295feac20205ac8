"""A table of what was found for words, bounded in entries, that keeps the words in use."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache:
    """Two generations: when the young one is full it becomes the old one; words met again move to the young.

    ``compute(words)`` gives the values of words in neither. ``fetch`` returns a dict that holds every word asked
    for; words longer than ``longest`` are not kept. Memory: at most two generations and the words of one call.
    """

    def __init__(self, compute: Callable[[list], list], entries: int = 60_000, longest: int = 64):
        self.compute, self.entries, self.longest = compute, entries, longest
        self.young: dict = {}
        self.old: dict = {}

    def fetch(self, words: Iterable) -> dict:
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    missing.append(w)
        if not missing:
            return young
        found = dict(zip(missing, self.compute(missing), strict=True))
        long = [w for w in missing if len(w) > self.longest]
        if long:
            extra = {w: found.pop(w) for w in long}
            young.update(found)
            return young | extra
        young.update(found)
        return young
