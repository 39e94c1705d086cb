"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of consecutive words (a shorter item is one window). A
window holds every one of its shingles, so a document that holds the window holds its rarest
shingle: that one is the window's prefix. Rarity is counted over all documents first. The
second pass looks up only prefix shingles, drops candidates that would begin before the text
or end after it (positional and length bounds), and compares the words of what is left one
by one.

Items are broadcast in blocks of a bounded number of windows; a larger benchmark takes more
passes, and each pass adds to what the one before it found. Documents are never shuffled.

Defined results: a null or empty text has no words and no hits; a null or empty item has no
windows; a repeated item counts once; an item without an id is left out; repeated document
rows are each worked on by themselves; input columns named like the output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import ddl, share, shared, without

WINDOW = 10
#: Words of the shingles whose rarity orders a window.
SHINGLE = 3
#: Words of items that one pass may broadcast; about 100 bytes each.
ITEM_WORDS = 500_000
ADDED = "n_words bigint, hits array<struct<first:int,last:int>>, item_ids array<string>"


class Windows:
    """The windows of a block of items, as arrays; shingles are the sets' members."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.items = [i for i, _ in items]
        words, first = text.word_hashes(pa.array([t for _, t in items], pa.string()), text.ALNUM)
        lengths = np.diff(first)
        starts, sizes, owners = [], [], []
        for k, (begin, n) in enumerate(zip(first[:-1], lengths)):
            size = min(window, int(n))
            many = int(n) - size + 1 if n else 0
            starts.append(np.arange(begin, begin + many))
            sizes.append(np.full(many, size))
            owners.append(np.full(many, k))
        none = np.empty(0, np.int64)
        self.words = words
        self.start, self.size, self.owner = (
            np.concatenate([none, *x]).astype(np.int64) for x in (starts, sizes, owners)
        )
        self.lengths = sorted({min(shingle, s) for s in set(self.size.tolist())})
        self.shingle = np.minimum(self.size, shingle)
        # one row for each window and place in it
        self.row_window, self.row_place, self.row_hash = [], [], []
        for n in self.lengths:
            own = np.flatnonzero(self.shingle == n)
            hashes = text.shingle_hashes(words, n)
            for place in range(int((self.size[own] - n + 1).max())):
                has = own[place + n <= self.size[own]]
                self.row_window.append(has)
                self.row_place.append(np.full(len(has), place))
                self.row_hash.append(hashes[self.start[has] + place])
        cat = lambda x: np.concatenate([none, *x]).astype(np.int64)
        self.row_window, self.row_place = cat(self.row_window), cat(self.row_place)
        self.row_hash = np.concatenate([np.empty(0, np.uint64), *self.row_hash])
        self.members = np.unique(self.row_hash)

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle, given how often each member occurs in documents."""
        count = counts[np.searchsorted(self.members, self.row_hash)]
        order = np.lexsort((self.row_place, self.row_hash, count, self.row_window))
        _, rarest = np.unique(self.row_window[order], return_index=True)
        rarest = order[rarest]
        by_hash = rarest[np.argsort(self.row_hash[rarest], kind="stable")]
        self.prefix, many = np.unique(self.row_hash[by_hash], return_counts=True)
        self.prefix_ends = np.cumsum(many)
        self.prefix_window = self.row_window[by_hash]
        self.prefix_place = self.row_place[by_hash]
        del self.row_window, self.row_place, self.row_hash, self.members


class Members:
    """Finds which hashes belong to a small set: one bit of a table first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = max(16, int(len(values)).bit_length() + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(values >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are members, and which members they are."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        same = self.values[which] == hashes[at]
        return at[same], which[same]


def _count_members(docs: DataFrame, block: Windows, column: str) -> np.ndarray:
    """How often each member occurs in all documents."""
    sent = share(docs, (block.members, block.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, lengths = shared(sent)
        finder, counts = Members(members), np.zeros(len(members), np.int64)
        for batch in batches:
            for rows in text.pieces(batch, column):
                words, first = text.word_hashes(rows.column(column), text.ALNUM)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for n in lengths:
                    at, which = finder.find(text.shingle_hashes(words, n))
                    inside = owner[at] == owner[at + n - 1]
                    counts += np.bincount(which[inside], minlength=len(members))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["member", "n"])

    counted = docs.select(column).mapInArrow(run, "member bigint, n bigint")
    counts = np.zeros(len(block.members), np.int64)
    for row in counted.groupBy("member").agg(F.sum("n").alias("n")).collect():
        counts[row.member] = row.n
    return counts


def _search(words: np.ndarray, first: np.ndarray, block: Windows, finder: Members):
    """Occurrences of windows: (index of the document, its first word, window)."""
    docs, starts, found = [], [], []
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n in block.lengths:
        at, which = finder.find(text.shingle_hashes(words, n))
        begin = np.where(which > 0, block.prefix_ends[which - 1], 0)
        many = block.prefix_ends[which] - begin
        row = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(at, many)
        window, place = block.prefix_window[row], block.prefix_place[row]
        start, end = at - place, at - place + block.size[window]
        fits = (block.shingle[window] == n) & (start >= 0) & (end <= len(words))
        start, window, at = start[fits], window[fits], at[fits]
        doc = owner[at]
        fits = (start >= first[doc]) & (start + block.size[window] <= first[doc + 1])
        start, window, doc = start[fits], window[fits], doc[fits]
        for k in range(int(block.size[window].max()) if len(window) else 0):
            size = block.size[window]
            k_in = np.minimum(k, size - 1)
            same = words[start + k_in] == block.words[block.start[window] + k_in]
            start, window, doc = start[same], window[same], doc[same]
        docs.append(doc), starts.append(start), found.append(window)
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (docs, starts, found))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def _add_hits(docs: DataFrame, block: Windows, column: str, keep_text: bool) -> DataFrame:
    sent = share(docs, block)
    hit_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared(sent)
        finder = Members(block.prefix)
        for batch in batches:
            for rows in text.pieces(batch, column):
                words, first = text.word_hashes(rows.column(column), text.ALNUM)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for d, start, w in zip(*(x.tolist() for x in _search(words, first, block, finder))):
                    begin = start - int(first[d])
                    spans.setdefault(d, []).append((begin, begin + int(block.size[w]) - 1))
                    items.setdefault(d, set()).add(block.items[block.owner[w]])
                hits, ids = [None] * rows.num_rows, [None] * rows.num_rows
                older_hits, older_ids = rows.column("hits"), rows.column("item_ids")
                for d in range(rows.num_rows):
                    old_hits, old_ids = older_hits[d].as_py(), older_ids[d].as_py()
                    before = [(x["first"], x["last"]) for x in old_hits or []]
                    hits[d] = [
                        {"first": a, "last": b} for a, b in _merged(before + spans.get(d, []))
                    ]
                    ids[d] = sorted(set(old_ids or []) | items.get(d, set()))
                rows = rows.drop_columns(["n_words", "hits", "item_ids"])
                rows = rows if keep_text else rows.drop_columns([column])
                rows = rows.append_column("n_words", pa.array(np.diff(first)))
                rows = rows.append_column("hits", pa.array(hits, hit_type))
                rows = rows.append_column("item_ids", pa.array(ids, pa.list_(pa.string())))
                yield from rows.to_batches()

    kept = without(docs, ["n_words", "hits", "item_ids", *([] if keep_text else [column])])
    return docs.mapInArrow(run, ddl(kept, ADDED))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    item_words: int = ITEM_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """The documents with the benchmark windows that occur in them.

    Adds n_words, hits (runs of hit words, by index, both ends included) and item_ids (items
    with a window in the document, as text, sorted). ``item_words`` bounds a broadcast.
    """
    docs = without(docs, ["n_words", "hits", "item_ids"])
    found = docs.select(
        "*",
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<first:int,last:int>>").alias("hits"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    items = benchmark.select(
        F.col(item_id).cast("string").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")
    ).where("i IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = max(1, -(-total // (4 * item_words)))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).distinct().collect()
        block = Windows(sorted(map(tuple, rows)), window, shingle)
        block.choose_prefixes(_count_members(docs, block, column))
        found = _add_hits(found, block, column, keep_text or k + 1 < blocks)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    own = docs.columns
    inner = docs.toDF(*[f"c{i}_{c}" for i, c in enumerate(own)])
    column = inner.columns[own.index(options.pop("column", "text"))]
    found = find_benchmark(inner, benchmark, column=column, **options).where(F.size("hits") == 0)
    return found.select(inner.columns).toDF(*own)
