"""Words of letters, in bounded steps, with what a model says of each distinct word kept by the worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from veilspark.llm.common import ENTRY_BYTES

#: Most characters whose words are listed at once.
SLICE_CHARS = 1 << 20
#: About the bytes of distinct words and their values that a worker keeps; beyond, it starts anew.
KEPT_BYTES = 64 << 20
#: Words times values that are looked up at once, about.
STEP_VALUES = 1 << 19

WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")


def slices(text: str) -> Iterator[tuple[int, str]]:
    """A text in slices that cut no word, each with its offset."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        found = _BREAK.search(text, at + SLICE_CHARS)
        end = found.start() if found else len(text)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def words_of(text: str) -> Iterator[list[str]]:
    """All words of a text, slice by slice."""
    for _, part in slices(text):
        yield WORD.findall(part)


class WordTable:
    """Row numbers of distinct words in a matrix of what `values` returns for a word."""

    def __init__(self, values: Callable[[list[str]], np.ndarray], width: int):
        self._values, self._width = values, width
        #: Words whose values are looked up at once.
        self.step = max(64, min(20_000, STEP_VALUES // width))
        self._start()

    def _start(self) -> None:
        self._rows: dict[str, int] = {}
        self._bytes = 0
        self._matrix = np.zeros((1024, self._width), np.float32)

    def _rows_of(self, words: list[str]) -> np.ndarray:
        if self._bytes > KEPT_BYTES:
            self._start()
        known = self._rows
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            self._bytes += sum(map(len, new)) + len(new) * (ENTRY_BYTES + 4 * self._width)
            n, m = len(known), len(known) + len(new)
            if m > len(self._matrix):
                grown = np.zeros((max(m, 2 * len(self._matrix)), self._width), np.float32)
                grown[:n] = self._matrix[:n]
                self._matrix = grown
            for k in range(0, len(new), self.step):
                part = new[k : k + self.step]
                self._matrix[n + k : n + k + len(part)] = self._values(part)
            known.update(zip(new, range(n, m), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of(self, words: list[str]) -> np.ndarray:
        """The values of each word, in order. What is kept is dropped first once it is too much, so a call holds its own words at most besides."""
        rows = self._rows_of(words)
        return self._matrix[rows]
