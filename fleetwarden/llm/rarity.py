"""How often keys occur in a corpus, told back to the blocks of texts that hold them.

Texts are dealt into blocks of bounded size. Each block sends its distinct keys to buckets of
the key space, sorted and as differences, a few bytes each; a bucket adds up the counts and
answers each block with one byte for each key it had sent, in the same order. No key travels
back, no table of keys is broadcast, and a key that all texts hold is sent once by a block.

Keys are shortened to a number of bits that follows the size of the corpus. Two keys that
become one count together, which makes them look more frequent, never rarer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block.
BLOCK = 6 << 20
#: There are fewer buckets than blocks by this power of two, as each block has a message for each:
#: the keys of up to so many blocks are added up in one task.
FEWER = 2


def in_blocks(docs: DataFrame, column: str = "text") -> tuple[DataFrame, int]:
    """The rows with a ``block`` number, dealt by their id and text, and the number of blocks."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0
    blocks = total // BLOCK + 1
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", column), F.lit(blocks))), blocks


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, as many planes as the largest needs."""
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + np.ascontiguousarray(raw[:, :planes].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    values = planes[0].astype(np.uint64)
    for i, plane in enumerate(planes[1:], 1):
        values |= plane.astype(np.uint64) << np.uint64(8 * i)
    return values


def code(counts: np.ndarray) -> np.ndarray:
    """One byte that grows with a count: the count itself to 128, then by eighths of a doubling."""
    codes = np.minimum(counts, 128).astype(np.uint8)
    large = np.flatnonzero(counts > 128)
    codes[large] = np.minimum(255, 128 + np.floor(8 * np.log2(counts[large] / 128)))
    return codes


def firsts(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


class Keys:
    """The shortened keys of a block and their counts."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        self.values, self.counts = np.unique(hashes >> self.shift, return_counts=True)

    def codes(self, answers: pa.Table) -> np.ndarray:
        """The byte of each key, from the buckets' answers."""
        return _told(answers, len(self.values))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.values, hashes >> self.shift)


def _told(answers: pa.Table, keys: int) -> np.ndarray:
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist()))
    found = np.frombuffer(b"".join([c for _, c in rows]), np.uint8)
    if len(found) != keys:
        raise ValueError("a block's texts changed between two reads")
    return found


def codes_of(hashes: np.ndarray, bits: int, answers: pa.Table) -> np.ndarray:
    """The byte of each hash of a block, as they stand, from the buckets' answers.

    The same as ``Keys.codes`` at ``Keys.find``, by one sort in place of a search for each hash.
    """
    values = hashes >> np.uint64(64 - bits)
    order = np.argsort(values)
    place = np.cumsum(firsts(values[order])) - 1
    codes = np.empty(len(values), np.uint8)
    codes[order] = _told(answers, int(place[-1]) + 1 if len(place) else 0)[place]
    return codes


def key_bits(blocks: int) -> int:
    return min(63, 36 + max(1, blocks).bit_length())


def count_codes(
    blocked: DataFrame, blocks: int, hashes: Callable[[pa.Table], Iterator[np.ndarray]]
) -> DataFrame:
    """block, bucket, codes: what each block is told about its keys (see ``Keys.codes``)."""
    bits = key_bits(blocks)
    bucket_bits = max(1, (blocks - 1).bit_length() - FEWER)
    width = np.uint64(bits - bucket_bits)

    def send(rows: pa.Table) -> pa.Table:
        keys = Keys(np.concatenate([np.empty(0, np.uint64), *hashes(rows)]), bits)
        edges = np.arange(1, 1 << bucket_bits, dtype=np.uint64) << width
        ends = [0, *np.searchsorted(keys.values, edges).tolist(), len(keys.values)]
        spans = [(b, s, e) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if s < e]
        block = rows.column("block")[0].as_py()
        first = [int(keys.values[s]) for _, s, _ in spans]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in spans], pa.int64()),
                "block": pa.array([block] * len(spans), pa.int64()),
                "first": pa.array(first, pa.int64()),
                "steps": pa.array([pack(np.diff(keys.values[s:e])) for _, s, e in spans], pa.binary()),
                "counts": pa.array([pack(keys.counts[s:e]) for _, s, e in spans], pa.binary()),
            }
        )

    def add(rows: pa.Table) -> pa.Table:
        steps = [unpack(x) for x in rows.column("steps").to_pylist()]
        starts = np.array(rows.column("first").to_pylist(), np.uint64)
        values = [np.cumsum(np.concatenate([starts[i : i + 1], s])) for i, s in enumerate(steps)]
        sizes = [len(v) for v in values]
        counts = np.concatenate([unpack(x) for x in rows.column("counts").to_pylist()])
        values = np.concatenate(values)
        order = np.argsort(values)
        new = firsts(values[order])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        codes = np.empty(len(values), np.uint8)
        codes[order] = code(sums)[np.cumsum(new) - 1]
        ends = np.cumsum(sizes).tolist()
        parts = [codes[e - n : e].tobytes() for e, n in zip(ends, sizes)]
        return pa.table(
            {
                "block": rows.column("block"),
                "bucket": rows.column("bucket"),
                "codes": pa.array(parts, pa.binary()),
            }
        )

    sent = blocked.groupBy("block").applyInArrow(
        send, "bucket bigint, block bigint, first bigint, steps binary, counts binary"
    )
    return sent.groupBy("bucket").applyInArrow(add, "block bigint, bucket bigint, codes binary")
