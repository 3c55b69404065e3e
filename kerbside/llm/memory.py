"""What a worker process remembers between tasks: the working memory of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_kept: dict = {}


def keep_one(key: Hashable, make: Callable):
    """The object kept under the key; making it drops what other operators kept.

    Spark reuses worker processes, so their memory would otherwise add up over a job.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


class Memo:
    """A bounded map from words to values: when it is full it keeps the last generation beside the new one."""

    def __init__(self, compute: Callable, most: int):
        self.compute, self.most = compute, most
        self.known: dict = {}
        self.before: dict = {}

    def of(self, words: list) -> list:
        """The values of the words, computed for those not known."""
        if len(self.known) > self.most:
            self.before, self.known = self.known, {}
        known = self.known
        values = list(map(known.get, words))
        if None in values:
            before, compute = self.before, self.compute
            for w in {w for w, v in zip(words, values) if v is None}:
                value = before.get(w)
                known[w] = compute(w) if value is None else value
            values = list(map(known.__getitem__, words))
        return values
