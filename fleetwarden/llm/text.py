"""Whole texts as numpy arrays inside a task: Arrow buffers, words, 64-bit hashes.

Words are found and hashed without a Python loop over them. A hash is a polynomial over
random byte values, finished with a mixing step; equal words have equal hashes, and two
different ones agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit values over all others; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix((np.arange(1, 257, dtype=U)) * U(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but those in the given ranges, both ends included."""
    kept = np.ones(256, bool)
    for first, last in excluded:
        kept[first : last + 1] = False
    return kept


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and their offsets. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(rows, column: str = "text", limit: int = CHUNK) -> Iterator[pa.Table]:
    """Consecutive slices of a record batch or table with about ``limit`` bytes of text each."""
    if isinstance(rows, pa.RecordBatch):
        rows = pa.Table.from_batches([rows])
    sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield rows.slice(start, end - start)
        start = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            values = np.full(size, U(base))
            values[0] = U(1)
            _POWERS[name] = np.cumprod(values)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums of which ``span_hashes`` takes differences; ``values`` are those of the bytes."""
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    up, _ = powers(len(data))
    np.cumsum(values.take(data) * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span; it depends on nothing but the span's bytes."""
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(BASE))


def words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (and the total)."""
    inside = is_word.take(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, A-Z lower-cased, and each text's first word index."""
    data, offsets = utf8(column)
    data = LOWER.take(data)
    starts, ends, first = words(data, offsets, is_word)
    return span_hashes(prefix_hashes(data), starts, ends), first


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` consecutive words from each word on; the last ones have none."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, U(size), U)
    for k in range(size):
        factor = U((BASE * (2 * k + 3) ** 7) % 2**64 | 1)
        total += hashes[k : k + n] * factor
    return mix(total)
