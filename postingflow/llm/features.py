"""Hashed text features over whole Arrow batches, in numpy.

The kernels work on one byte buffer per batch, not text by text: word limits, word hashes and byte n-gram hashes of all texts are
found together, and each feature knows the text it came from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 2 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Texts:
    """Texts laid end to end, a space after each: bytes and the start of each text (one more than texts)."""

    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def chunks(column: pa.Array, limit: int = CHUNK, rows: int = 1 << 20):
    """Cut a string column into runs of at most ``rows`` rows and about ``limit`` bytes (a longer text is a run of its own): (first row, Texts)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    # A null takes no bytes here whatever its slot holds.
    sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0) if column.null_count else np.diff(offsets)
    at = 0
    while at < len(column):
        end = at + max(1, min(rows, int(np.searchsorted(np.cumsum(sizes[at:at + rows]), limit, "right"))))
        starts = np.concatenate([[0], np.cumsum(sizes[at:end] + 1)])
        data = np.full(starts[-1], 0x20, np.uint8)
        if sizes[at:end].sum() == offsets[end] - offsets[at]:
            keep = np.ones(len(data), bool)
            keep[starts[1:] - 1] = False
            data[keep] = raw[offsets[at]:offsets[end]]
        else:
            for i in range(at, end):
                data[starts[i - at]:starts[i - at] + sizes[i]] = raw[offsets[i]:offsets[i] + sizes[i]]
        yield at, Texts(data, starts)
        at = end


def word_limits(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a text's closing space ends its last word."""
    space = SPACE[t.data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(t.data) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def text_of(t: Texts, at: np.ndarray) -> np.ndarray:
    """The text that holds each byte position."""
    return np.searchsorted(t.starts, at, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zero after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,))


def byte_grams(data: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash of the n bytes (up to 8) from each position on; with the texts' ``starts``, of fewer at the end of a text, so that none reads on into the next."""
    h = _eight(data) & np.uint64((1 << 8 * n) - 1) if n < 8 else _eight(data).copy()
    for left in range(1, n if starts is not None else 1):
        last = starts[1:] - left
        h[last[last >= starts[:-1]]] &= np.uint64((1 << 8 * left) - 1)
    return mix(h + np.uint64(n * 0x9E3779B9))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, eight at a time."""
    eight = _eight(data)
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64))
    at, live = starts.astype(np.int64).copy(), np.arange(len(starts))
    while len(live):
        n = np.minimum(left[live], 8)
        part = eight[at[live]]
        short = n < 8
        part[short] &= (np.uint64(1) << (np.uint64(8) * n[short].astype(np.uint64))) - np.uint64(1)
        h[live] = mix(h[live] * _M1 + part)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return h
