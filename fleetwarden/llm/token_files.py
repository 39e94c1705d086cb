"""Token ids of documents as compact binary files, and back.

Files hold patched frame-of-reference blocks. Each block of BLOCK ids is stored as its minimum
and the differences from it, packed in as many bits as a given share of them needs; the few
that need more are exceptions, kept beside with their places and put back after unpacking. An
index holds where each block and its exceptions begin, so any stretch of ids is read by
unpacking its blocks alone.

A file (little-endian, then a line feed that Spark's writer adds):

* ``HEADER``: magic, block size, numbers of documents, ids, blocks and exceptions, the
  partition and shard it is, and how many ids the partition's earlier shards hold;
* of each document its id (int64), whether that is null (uint8) and where its ids end (uint64);
* of each block its minimum (uint32) and width (uint8), and with one entry more where its bytes
  (uint64) and its exceptions (uint64) begin;
* of each exception its place in the block (uint16) and its difference (uint32);
* the packed bytes.

Documents are dealt into ranges of ids, encoded and written where they lie: partitions, and the
shards in each, follow one another in ascending order of ids. Spark's committer moves finished
files into the folder, so a lost task leaves none behind, and any file system that Spark knows
will do. A task holds one shard, which is closed at SHARD ids.

Defined results: a null text is an empty one and has the end id alone; null document ids come
first; rows of one id follow by the md5 of their texts, and equal rows stay; a very long text is
one document in one shard of its own size; an empty table gives files without documents; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import cut, kept, share
from fleetwarden.llm.units import UnitEncoder, spans

BLOCK = 256
#: The share of a block's differences that its width holds.
WITHIN = 0.9
#: Ids after which a shard is closed.
SHARD = 1 << 20
#: Different units of text whose ids a Python worker remembers.
UNITS_KEPT = 600_000

MAGIC = b"PFR1"
HEADER = "<4sIQQQQIIQ"


def bits_needed(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values in ``width`` bits each; every row begins at a byte."""
    rows, n = values.shape
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(rows * n, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(rows, n * width), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    rows = len(packed)
    bits = np.zeros((rows * n, 32), np.uint8)
    some = np.unpackbits(packed, axis=1, bitorder="little", count=n * width)
    bits[:, :width] = some.reshape(rows * n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(rows, n)


class Packed(NamedTuple):
    """Ids in blocks; the last block may be shorter."""

    n: int
    block: int
    minima: np.ndarray
    widths: np.ndarray
    starts: np.ndarray
    exception_starts: np.ndarray
    places: np.ndarray
    differences: np.ndarray
    data: np.ndarray

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from one place up to another, unpacking no other blocks."""
        end = self.n if end is None else min(end, self.n)
        if first >= end:
            return np.empty(0, np.uint32)
        low, high = first // self.block, -(-end // self.block)
        out = np.empty((high - low, self.block), np.uint32)
        whole = np.arange(low, min(high, self.n // self.block))
        for width in np.unique(self.widths[whole]) if len(whole) else ():
            chosen = whole[self.widths[whole] == width]
            size = -(-self.block * int(width) // 8)
            rows = self.data[self.starts[chosen].astype(np.int64)[:, None] + np.arange(size)]
            out[chosen - low] = unpack_bits(rows, self.block, int(width))
        if high > self.n // self.block:  # the shorter last block
            left = self.n % self.block
            row = self.data[int(self.starts[high - 1]) : int(self.starts[high])][None, :]
            out[-1, :left] = unpack_bits(row, left, int(self.widths[high - 1]))[0]
        a, b = int(self.exception_starts[low]), int(self.exception_starts[high])
        owners = np.repeat(np.arange(high - low), np.diff(self.exception_starts[low : high + 1].astype(np.int64)))
        out[owners, self.places[a:b]] = self.differences[a:b]
        out += self.minima[low:high, None]
        return out.reshape(-1)[first - low * self.block : end - low * self.block]


def pack(ids: np.ndarray, block: int = BLOCK, within: float = WITHIN) -> Packed:
    """Ids (up to 32 bits) as patched frame-of-reference blocks of at most 65,536."""
    ids = np.asarray(ids, np.uint32)
    n, whole = len(ids), len(ids) // block
    blocks = [ids[: whole * block].reshape(whole, block)]
    if n % block:
        blocks.append(ids[whole * block :][None, :])
    minima, widths, sizes, counts, places, differences, packed = [], [], [], [], [], [], []
    for rows in blocks:
        if not len(rows):
            continue
        lowest = rows.min(axis=1)
        left = rows - lowest[:, None]
        need = bits_needed(left)
        rank = min(rows.shape[1] - 1, int(np.ceil(within * rows.shape[1])) - 1)
        width = np.partition(need, max(0, rank), axis=1)[:, max(0, rank)]
        over = need > width[:, None]
        row, place = np.nonzero(over)
        minima.append(lowest)
        widths.append(width.astype(np.uint8))
        counts.append(over.sum(axis=1))
        places.append(place.astype(np.uint16))
        differences.append(left[row, place])
        sizes.append(-(-rows.shape[1] * width.astype(np.int64) // 8))
        packed.append(np.where(over, 0, left))
    join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
    starts = np.concatenate([[0], np.cumsum(join(sizes, np.int64))])
    data = np.empty(int(starts[-1]), np.uint8)
    at = 0
    for rows, width in zip(packed, widths):
        for w in np.unique(width):
            chosen = np.flatnonzero(width == w)
            bytes_ = pack_bits(rows[chosen], int(w))
            data[starts[at + chosen][:, None] + np.arange(bytes_.shape[1])] = bytes_
        at += len(rows)
    exceptions = np.concatenate([[0], np.cumsum(join(counts, np.int64))])
    return Packed(
        n, block, join(minima, np.uint32), join(widths, np.uint8), starts.astype(np.uint64),
        exceptions.astype(np.uint64), join(places, np.uint16), join(differences, np.uint32), data,
    )


class Shard(NamedTuple):
    """One file: documents (null ids are None), where their ids end, and the ids."""

    part: int
    number: int
    before: int
    doc_ids: list[int | None]
    ends: np.ndarray
    ids: Packed

    def to_bytes(self) -> bytes:
        p, n = self.ids, len(self.doc_ids)
        counts = p.block, n, p.n, len(p.minima), len(p.places)
        head = struct.pack(HEADER, MAGIC, *counts, self.part, self.number, self.before)
        null = np.array([i is None for i in self.doc_ids], np.uint8)
        own = np.array([i or 0 for i in self.doc_ids], "<i8")
        columns = [own, null, self.ends.astype("<u8"), p.minima, p.widths, p.starts, p.exception_starts]
        columns += [p.places, p.differences, p.data]
        return head + b"".join([c.astype(c.dtype.newbyteorder("<")).tobytes() for c in columns])

    @classmethod
    def from_bytes(cls, content: bytes) -> Shard:
        magic, block, n, total, blocks, exceptions, part, number, before = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, count, at)
            at += found.nbytes
            return found

        own, null, ends = take("<i8", n), take("u1", n), take("<u8", n)
        minima, widths = take("<u4", blocks), take("u1", blocks)
        starts, exception_starts = take("<u8", blocks + 1), take("<u8", blocks + 1)
        places, differences = take("<u2", exceptions), take("<u4", exceptions)
        data = take("u1", int(starts[-1]))
        ids = Packed(total, block, minima, widths, starts, exception_starts, places, differences, data)
        doc_ids = [None if x else i for i, x in zip(own.tolist(), null.tolist())]
        return cls(part, number, before, doc_ids, ends.astype(np.int64), ids)


def byte_signs() -> dict[int, int]:
    """The byte alphabet: each byte's code point. Printable Latin-1 stands for itself, the other
    bytes, in order, for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder(UnitEncoder):
    """Whole texts to ids with the tokenizers library's model, each different pre-token once.

    The pattern of pre-tokens is matched here, so that the library is asked about each character
    beyond ASCII, when it first comes, whether it takes it for a letter, a number, white space or
    none of these as well; a unit with one that it sees differently goes to the library whole.
    """

    def __init__(self, definition: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__(pattern, UNITS_KEPT)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.agreed = set(map(chr, range(128)))
        self.doubtful: set[str] = set()
        self.signs = str.maketrans(byte_signs())

    def _same_class(self, sign: str) -> bool:
        """Whether the library joins the sign to what this side's character classes say."""
        joins = lambda other: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(other + sign)) == 1
        here = [bool(regex.match(p, sign)) for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")]
        return [joins("a"), joins("1"), joins("!")] == here

    def whole(self, units: list[str]) -> dict[int, list[int]]:
        for sign in set("".join(units)) - self.agreed - self.doubtful:
            (self.agreed if self._same_class(sign) else self.doubtful).add(sign)
        if not self.doubtful:
            return {}
        odd = [k for k, u in enumerate(units) if not self.doubtful.isdisjoint(u)]
        return {k: self.tokenizer.encode(units[k], add_special_tokens=False).ids for k in odd}

    def of_pieces(self, data: bytes, n_bytes: list[int]) -> tuple[list[int], list[int]]:
        signs = data.decode("latin-1").translate(self.signs)
        ids: list[int] = []
        sizes, start, tokenize = [], 0, self.model.tokenize
        for n in n_bytes:
            found = [t.id for t in tokenize(signs[start : start + n])]
            ids += found
            sizes.append(len(found))
            start += n
        return ids, sizes

    def encode(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and where each one's end."""
        codes, first = self.code(column)
        # The end id follows each text's last unit as a unit of its own.
        last = first[1:]
        starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        starts = np.insert(starts, last, len(self.ids))
        sizes = np.insert(sizes, last, 1)
        ids = spans(np.append(self.ids, np.uint32(end_id)), starts, sizes)
        return ids, np.cumsum(sizes)[last + np.arange(len(last))]


def write(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    folder: str,
    end_id: int = 2,
    id_column: str = "doc_id",
    column: str = "text",
) -> None:
    """Write the ids of whole texts, ``end_id`` behind each, in ascending order of document ids.

    ``tokenizer_path`` is a byte-level BPE definition of the tokenizers library that adds no
    space in front, ``pattern`` that of its pre-tokens. Ids of documents are 64-bit integers. The folder must not exist.
    """
    with open(tokenizer_path, encoding="utf-8") as source:
        definition = source.read()
    steps = json.loads(definition)
    before = steps.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or steps.get("normalizer"):
        raise ValueError("texts are cut at spaces, which only suits plain byte-level tokenizers")
    sent = share(docs, definition)
    order = [F.asc_nulls_first("id"), F.asc_nulls_first(F.md5("text"))]
    ordered = (
        docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(sent, lambda definition: Encoder(definition, pattern))
        part, number, before, waiting = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            found = Shard(part, number, before, doc_ids, np.concatenate(ends), pack(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([found.to_bytes()], pa.binary())], ["shard"])

        for batch in batches:
            for rows in text.pieces(batch, "text", 4 * text.CHUNK):
                some, places = encoder.encode(rows.column("text"), end_id)
                doc_ids += rows.column("id").to_pylist()
                ids.append(some)
                ends.append(waiting + places)
                waiting += len(some)
                if waiting >= SHARD:
                    yield shard()
                    number, before, waiting = number + 1, before + waiting, 0
                    doc_ids, ids, ends = [], [], []
        if doc_ids:
            yield shard()

    shards = ordered.mapInArrow(run, "shard binary")
    # The text writer writes the bytes as they are.
    lines = shards.select(F.col("shard").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 1").select("content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and token_ids (with the end id) of every document, as stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard.from_bytes(content.as_py())
                ids = pa.array(shard.ids.ids().astype(np.int32))
                ends = pa.array(np.concatenate([[0], shard.ends]), pa.int32())
                arrays = [pa.array(shard.doc_ids, pa.int64()), pa.ListArray.from_arrays(ends, ids)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "token_ids"])

    return _files(spark, folder).mapInArrow(run, "doc_id bigint, token_ids array<int>")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is that of its ids as
    little-endian 32-bit integers. The rows without starts are written once, when the DataFrame
    is built; the totals that make starts global are a row for each partition that wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard.from_bytes(content.as_py())
                data = memoryview(shard.ids.ids().astype("<u4").tobytes())
                starts = np.concatenate([[0], shard.ends[:-1]])
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist())]
                arrays = [
                    pa.array([shard.part] * len(sums), pa.int32()),
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(shard.before + starts, pa.int64()),
                    pa.array(shard.ends - starts, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                names = ["part", "doc_id", "within", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "part int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    rows = cut(_files(spark, folder).mapInArrow(run, kinds))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
