"""Words and lines of many texts at a time, straight from Arrow's UTF-8 buffer, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are looked at in one go; a longer text is one go.
AT_ONCE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def lowered(data: np.ndarray) -> np.ndarray:
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


@dataclass
class Texts:
    """``data``: the texts end to end, A-Z lower-cased; text d is data[starts[d]:starts[d + 1]]."""

    data: np.ndarray
    starts: np.ndarray

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each run of other bytes begins and ends, and a 64-bit hash of it (a polynomial in its bytes, mixed)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        apart = (self.data == 32) | (self.data - np.uint8(9) < 5) if separators is SPACE else separators[self.data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[self.starts] = True
        begins = ~apart
        begins[1:] &= apart[:-1] | edge[1:-1]
        ends = ~apart
        ends[:-1] &= apart[1:] | edge[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _power(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.add(self.data, np.uint64(1), out=total[1:])
        total[1:] *= up[:n]
        np.cumsum(total[1:], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return s, e, h

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[:-1], at, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each line its text, its number there, and where it begins and ends. An empty text has one, empty."""
        feeds = np.flatnonzero(self.data == 10)
        counts = np.searchsorted(feeds, self.starts[1:]) - np.searchsorted(feeds, self.starts[:-1]) + 1
        text = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.sort(np.concatenate([feeds + 1, self.starts[:-1]]))
        end = self.starts[1:][text]
        same = text[1:] == text[:-1]
        end[:-1][same] = begin[1:][same] - 1
        return text, number, begin, end


def texts_of(column: pa.Array) -> Iterator[tuple[slice, Texts]]:
    """The texts of a string column in goes; null is empty."""
    if not len(column):
        return
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    if column.null_count:  # their bytes, if any, don't count
        yield from texts_of(column.fill_null(""))
        return
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        yield slice(at, to), Texts(lowered(data[offsets[at] : offsets[to]]), offsets[at : to + 1] - offsets[at])
        at = to
