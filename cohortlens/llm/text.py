"""Words and shingles of whole Arrow batches as 64-bit hashes, in NumPy.

Texts stay UTF-8 bytes.  A word is a run of bytes that are neither space nor
0x09-0x0D, with A-Z lower-cased; its hash is a polynomial over the bytes modulo
2**64, taken from prefix sums, so that a batch needs a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += _U(32)
    return mix((low + _U(1)) * _U(_BASE))


_LETTER = _letters()
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``limit`` bytes of text; a longer text is alone in its slice."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of a buffer that end at the end of a text or behind a separator."""
    start, size = 0, len(data)
    while start < size:
        end = min(size, start + PIECE)
        while end < size:
            gaps = np.flatnonzero(_SEP[data[start:end]])
            edge = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            cut = max(edge, start + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut > start:
                end = cut
                break
            end = min(size, end + PIECE)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first
    word (with the total at the end)."""
    hashes, starts_at = [], []
    for a, b in _cuts(data, offsets):
        part = data[a:b]
        word = ~_SEP[part]
        first = np.zeros(len(part) + 1, bool)
        inside = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b, "right")] - a
        first[inside] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:-1]
        begin, last = np.flatnonzero(begin), np.flatnonzero(last)
        up, down = _power(len(part) + 1)
        total = np.empty(len(part) + 1, _U)
        total[0] = 0
        np.cumsum(_LETTER[part] * up[:len(part)], out=total[1:])
        hashes.append(mix((total[last + 1] - total[begin]) * down[begin]))
        starts_at.append(begin + a)
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; a text
    with fewer words has the whole sequence as its one shingle, one without words none."""
    words, at = word_hashes(data, offsets)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    n = max(len(words) - k + 1, 0)
    rolled = np.zeros(n, _U)
    for j in range(k):
        rolled += words[j:j + n] * factors[j]
    rolled = mix(rolled)
    for i in range(len(offsets) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            own = np.sort(rolled[a:b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif b > a:
            yield mix(np.array([(words[a:b] * factors[:b - a]).sum(dtype=_U) + _U(b - a)], _U) ^ _U(0x5DEECE66D))
        else:
            yield np.zeros(0, _U)
