"""Words and shingles of a batch of texts as numpy arrays: small per-task helpers, 64-bit hashes stand for the strings.

The hash of a word is a sum of mixed (byte, place) numbers, so all words of a batch are hashed by a few array operations
over the bytes. Batches are worked through in pieces of ``PIECE`` bytes cut between words, which bounds the memory
of a task whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 16
_SPACES = [0x20, *range(0x09, 0x0E)]
#: Bytes between words, by kind: white space only, or everything that is no letter (bytes of non-ASCII letters count as letters).
WHITE = np.isin(np.arange(256), _SPACES)
NO_LETTER = ~np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8).tobytes()
_SAME = bytes(range(256))
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every input bit."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_TABLE = mix(np.arange(1, (_PLACES << 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Words(NamedTuple):
    hashes: np.ndarray      # uint64, in order of the texts
    starts: np.ndarray      # first byte in ``data``
    lengths: np.ndarray     # bytes
    bounds: np.ndarray      # of text i: bounds[i] to bounds[i + 1]
    data: np.ndarray        # the batch's bytes


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _cuts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(end, low + PIECE)
        if high < end:
            text_end = int(offsets[np.searchsorted(offsets, high)])
            at = high
            while at < text_end:
                found = np.flatnonzero(gap[data[at:min(at + 65536, text_end)]])
                if len(found):
                    text_end = at + int(found[0])
                    break
                at += 65536
            high = text_end
        yield low, high
        low = high


def words(texts: pa.Array, gap: np.ndarray = WHITE, lower: bool = True) -> Words:
    """All words of the texts."""
    data, offsets = text_bytes(texts)
    table = _LOWER if lower else _SAME
    solid_bytes = (~gap).tobytes()
    numbers = np.where(gap[np.arange(len(_TABLE)) & 255], np.uint64(0), _TABLE)       # bytes between words add nothing
    hashes, starts, lengths = [], [], []
    for low, high in _cuts(data, offsets, gap):
        raw = data[low:high].tobytes().translate(table)
        piece, solid = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(solid_bytes), bool)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inside = offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high)] - low
        first[inside] = solid[inside]       # a text starts a word of its own
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        place = np.arange(len(piece))
        place[:begin[0]] = 0
        place[begin[0]:] -= np.repeat(begin, np.diff(begin, append=len(piece)))
        key = (place << 8) | piece
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            beyond = np.where(solid[far], mix((key[far].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
            key[far] = 0
        value = numbers.take(key)
        if len(far):
            value[far] = beyond
        hashes.append(mix(np.add.reduceat(value, begin)))
        starts.append(begin + low)
        lengths.append(np.flatnonzero(last) + 1 - begin)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    starts = np.concatenate(starts)
    return Words(np.concatenate(hashes), starts, np.concatenate(lengths), np.searchsorted(starts, offsets), data)


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text, and the bounds by text. A text with fewer words has one: all of them."""
    counts = np.diff(bounds)
    n = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - bounds[owner]
    total = np.zeros(n, np.uint64)
    for j in range(k):
        have = place + j < counts[owner]
        value = np.zeros(n, np.uint64)
        value[:n - j] = hashes[j:]
        total += np.where(have, value * _ODD[j], _ODD[32 + j])
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    keep = place < made[owner]
    return mix(total[keep]), np.concatenate([[0], np.cumsum(made)])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text each, a longer text alone."""
    _, offsets = text_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
