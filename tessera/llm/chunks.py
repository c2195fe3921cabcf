"""A worker's table of white-space chunks and what is computed of each once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class ChunkTable(dict):
    """chunk -> row of `values`; made(chunk) gives the row's numbers.

    Emptied between documents when it holds `limit` chunks or `chars` characters of them, so it is
    bounded by these and by the longest document.
    """

    def __init__(self, width: int, made: Callable[[str], object] | None = None, limit: int = 400_000, chars: int = 16_000_000, dtype="f4"):
        super().__init__()
        self.made, self.limit, self.chars, self.held = made, limit, chars, 0
        self.values = np.zeros((1024, width), dtype)

    def make_room(self) -> None:
        if len(self) > self.limit or self.held > self.chars:
            self.clear()
            self.held, self.values = 0, self.values[: max(1024, self.limit)].copy()

    def __missing__(self, chunk: str) -> int:
        row = len(self)
        if row == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[row] = self.made(chunk)
        self[chunk] = row
        self.held += len(chunk)
        return row

    def fill(self, new: list[str], rows: np.ndarray) -> None:
        """Add chunks that are not there yet."""
        lo, hi = len(self), len(self) + len(new)
        if hi > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(hi, 2 * len(self.values)) - len(self.values), self.values.shape[1]), self.values.dtype)])
        self.values[lo:hi] = rows
        self.update(zip(new, range(lo, hi), strict=True))
        self.held += sum(map(len, new))

    def rows(self, chunks: list[str]) -> np.ndarray:
        self.make_room()
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
