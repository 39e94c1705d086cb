"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary finds a pre-token that is itself a
token in one probe and one comparison. A pre-token that isn't is merged: its bytes are a
linked list, and a heap of (rank, place) gives the pair to join next, so that a pre-token
of n bytes costs O(n log n) however long it is.

The vocabulary is a fixed public file, read on the driver and broadcast (its size does not
depend on the data). Texts are encoded in Arrow batches, without a shuffle. A task looks up
each different pre-token once, in numpy batches, and puts texts together from numbers of units.

Defined results: a null text counts as empty and has no tokens; each row is worked on by
itself, so repeated rows repeat; input columns named like the output's are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from fleetwarden.llm import text
from fleetwarden.llm.frames import ddl, share, shared, without
from fleetwarden.llm.units import UnitEncoder, spans

#: Keys for each displacement of the perfect hash.
LOAD = 4
#: Different units of text (``units``) whose ids a task remembers.
UNITS_KEPT = 600_000
STEP = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, one displacement for about four keys."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.groups = n, max(1, n // LOAD)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        group = (hashes % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        taken = np.zeros(n, bool)
        self.slot_of = np.full(n, -1, np.int64)
        self.shift = [0] * self.groups
        for g in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
            members = order[bounds[g] : bounds[g + 1]]
            if not len(members):
                continue
            start, tries = 0, np.arange(16, dtype=np.uint64)
            while True:
                at = self._slots(hashes[members][:, None], tries[None, :] + np.uint64(start))
                free = ~taken[at].any(axis=0)
                if len(members) > 1:
                    inner = np.sort(at, axis=0)
                    free &= (inner[1:] != inner[:-1]).all(axis=0)
                if free.any():
                    k = int(free.argmax())
                    break
                start += len(tries)
                tries = np.arange(min(4096, 4 * len(tries)), dtype=np.uint64)
            self.shift[g] = start + k
            taken[at[:, k]] = True
            self.slot_of[members] = at[:, k]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (text.mix(hashes ^ (shift * np.uint64(STEP))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slot where each key is, if it is one of the hash's keys."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        shift = np.array(self.shift, np.uint64)[(hashes % np.uint64(self.groups)).astype(np.int64)]
        return self._slots(hashes, shift).tolist()


def _end_to_end(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def _of_ids(data: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, list[int]]:
    sizes = at[ids + 1] - at[ids]
    places = np.concatenate([[0], np.cumsum(sizes)])[starts]
    return spans(data, at[ids], sizes).tobytes(), places.tolist()


class Vocabulary:
    """Tokens with their ranks: encodes single pre-tokens, decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slot_of.tolist()):
            self.keys[slot], self.ids[slot] = token, ranks[token]
        # The bytes of all tokens by rank, and the ranks as text with a comma, end to end.
        by_rank = [b""] * (1 + max(ranks.values(), default=-1))
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.bytes, self.bytes_at = _end_to_end(by_rank)
        self.names, self.names_at = _end_to_end([b"%d," % i for i in range(len(by_rank))])

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        (slot,) = self.hash.slots([piece])
        return [self.ids[slot]] if self.keys[slot] == piece else self.merge(piece)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of ids, and where those of the ids from each start on begin."""
        return _of_ids(self.bytes, self.bytes_at, ids, starts)

    def spell(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, list[int]]:
        """The same for ids as text, each with a comma behind it."""
        return _of_ids(self.names, self.names_at, ids, starts)

    def merge(self, piece: bytes) -> list[int]:
        """Join the pair of lowest rank, the leftmost of equals, until no pair is a token.

        ``after`` and ``before`` link the starts of the parts; ``pair`` holds the rank that a
        part makes with the next one, so that outdated entries of the heap are told apart.
        """
        rank, ranks, n = self.ranks.get, self.ranks, len(piece)
        bits = n.bit_length()
        place = (1 << bits) - 1
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [rank(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & place
            if pair[i] != entry >> bits:
                continue
            j = after[i]
            end = after[i] = after[j]
            pair[j] = pair[i] = -1
            if end < n:
                before[end] = i
                r = rank(piece[i : after[end]])
                if r is not None:
                    pair[i] = r
                    heappush(heap, r << bits | i)
            k = before[i]
            if k >= 0:
                r = rank(piece[k:end])
                if r is None:
                    pair[k] = -1
                else:
                    pair[k] = r
                    heappush(heap, r << bits | k)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids


class Encoder(UnitEncoder):
    """Encodes whole texts: new pre-tokens are looked up together, and those that are no token
    are merged."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(pattern, UNITS_KEPT)
        self.vocabulary = vocabulary

    def of_pieces(self, data: bytes, n_bytes: list[int]) -> tuple[list[int], list[int]]:
        ends = np.cumsum(n_bytes).tolist()
        pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
        keys, known, merge = self.vocabulary.keys, self.vocabulary.ids, self.vocabulary.merge
        ids: list[int] = []
        sizes = []
        for piece, slot in zip(pieces, self.vocabulary.hash.slots(pieces)):
            if keys[slot] == piece:
                ids.append(known[slot])
                sizes.append(1)
            else:
                found = merge(piece)
                ids += found
                sizes.append(len(found))
        return ids, sizes


def _share(df: DataFrame, ranks_path: str):
    return share(df, Vocabulary(read_ranks(ranks_path)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text") -> DataFrame:
    """The rows with ``token_ids``: the ids of the whole text. No special tokens are known."""
    sent, docs = _share(docs, ranks_path), without(docs, ["token_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared(sent), pattern)
        for batch in batches:
            for rows in text.pieces(batch, column):
                ids, starts = encoder.text_ids(rows.column(column))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield from rows.append_column("token_ids", lists).to_batches()

    return docs.mapInArrow(run, ddl(docs, "token_ids array<int>"))


def decode(tokens: DataFrame, ranks_path: str, column: str = "token_ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that the ids stand for; null ids give no bytes."""
    sent, tokens = _share(tokens, ranks_path), without(tokens, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared(sent)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(column).to_pylist()]
            starts = np.cumsum([0, *map(len, lists)])
            data, at = vocabulary.decode(np.concatenate([np.empty(0, np.int64), *lists]), starts)
            decoded = [data[a:b] for a, b in zip(at[:-1], at[1:])]
            rows = pa.Table.from_batches([batch])
            yield from rows.append_column("decoded", pa.array(decoded, pa.binary())).to_batches()

    return tokens.mapInArrow(run, ddl(tokens, "decoded binary"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text") -> DataFrame:
    """``encode``, then ``decode``, with digests in place of ids and bytes.

    Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, and
    leaves the text out, so that neither ids nor texts travel back from the tasks.
    """
    sent = _share(docs, ranks_path)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = without(docs, added)
    rest = without(docs, [column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared(sent), pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for rows in text.pieces(batch, column):
                ids, starts = encoder.text_ids(rows.column(column))
                spelt, at = encoder.vocabulary.spell(ids, starts)
                data, begin = encoder.vocabulary.decode(ids, starts)
                # The last id's comma is left out.
                names = [sha(spelt[a : max(a, b - 1)]) for a, b in zip(at[:-1], at[1:])]
                decoded = [sha(data[a:b]) for a, b in zip(begin[:-1], begin[1:])]
                counts = np.diff(starts)
                rows = rows.drop_columns([column])
                for name, values, kind in zip(
                    added, (counts, names, decoded), (pa.int64(), pa.string(), pa.string())
                ):
                    rows = rows.append_column(name, pa.array(values, kind))
                yield from rows.to_batches()

    schema = ddl(rest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(run, schema)
