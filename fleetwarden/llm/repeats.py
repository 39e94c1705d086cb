"""Removal of long byte strings that occur earlier, by longest-previous-factor arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document
of a smaller id, or earlier in the same one. No string crosses documents.

1. Every window of LENGTH bytes is known by its least K-gram (by hash, leftmost of equals).
   Windows of equal bytes agree in it, and a run of neighbouring windows shares one. The
   corpus counts these K-grams (``rarity``); a run whose K-gram occurs once is not repeated,
   which settles most of the text with a few bytes for each run.
2. The other runs' bytes are dealt out by their K-gram, so that equal windows meet. A block of
   documents sends one of equal runs, the earliest: a passage that a third of all documents
   hold costs each block one run.
3. Where different runs meet, a suffix array of their windows is built by prefix doubling to
   the depth of LENGTH, in text order among equals. The previous and the next smaller position
   in suffix order give each window's longest previous factor; those of at least LENGTH bytes
   go back to the window's block as spans.
4. The blocks merge all spans and cut the texts.

Texts move once, in blocks of bounded size. Runs are compared by 64-bit hashes of their bytes.

Defined results: null texts count as empty; ids are integers, a null id comes after all others;
of rows with one id, the block and then the text decide which is earlier, and of equal rows one
is the first. Input columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetwarden.llm import text
from fleetwarden.llm.rarity import Keys, count_codes, in_blocks, key_bits

LENGTH = 100
#: Bytes of the strings by which windows are dealt out.
K = 24
#: Bytes of runs that are put into one suffix array; see ``shared_windows`` for one K-gram's.
BATCH = 1 << 19
LAST = 2**63 - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one least K-gram: first window, windows, K-gram's place and hash."""
    n, none = len(data), np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    sums = text.prefix_hashes(data)
    at = np.arange(n - K + 1)
    grams = text.span_hashes(sums, at, at + K)
    place = np.uint64((1 << n.bit_length()) - 1)
    least = sliding_min((grams & ~place) | at.astype(np.uint64), length - K + 1) & place
    begins, ends = offsets[:-1], offsets[1:]
    over = np.zeros(n + 1, np.int64)
    np.add.at(over, np.maximum(begins, ends - length + 1), 1)
    np.add.at(over, ends, -1)
    inside = np.cumsum(over)[: len(least)] == 0
    change = least[1:] != least[:-1]
    starts = inside.copy()
    starts[1:] &= change | ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= change | ~inside[1:]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    place = least[starts].astype(np.int64)
    return starts, stops - starts, place - starts, grams[place]


def block_runs(rows: pa.Table, length: int) -> Iterator[tuple]:
    """The runs of each slice of a block, places counted from the block's first byte."""
    base = 0
    for piece in text.pieces(rows):
        data, offsets = text.utf8(piece.column("text"))
        starts, many, spots, grams = runs(data, offsets, length)
        sums = text.prefix_hashes(data)
        content = text.span_hashes(sums, starts, starts + many + length - 1)
        yield starts + base, many, spots, grams, content
        base += len(data)


class Block:
    """A block's rows in their order, with the runs whose K-gram occurs more than once."""

    def __init__(self, rows: pa.Table, answers: pa.Table, length: int, bits: int):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        parts = list(zip(*block_runs(self.rows, length)))
        starts, many, spots, grams, content = (np.concatenate(p) for p in parts)
        codes = Keys(grams, bits).codes(answers)
        often = codes[Keys(grams, bits).find(grams)] > 1 if len(grams) else np.empty(0, bool)
        self.starts, self.grams, self.content = starts[often], grams[often], content[often]
        self.sizes, self.spots = many[often] + length - 1, spots[often]
        _, first = np.unique(self.content, return_index=True)
        self.first = np.zeros(len(self.content), bool)
        self.first[first] = True
        self.data, self.offsets = text.utf8(self.rows.column("text"))


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another, without an index of every byte."""
    spans = [data[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
    return np.concatenate([np.empty(0, np.uint8), *spans])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` bytes at each place, in order of the bytes; by doubling."""
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    n, have = len(data), 1
    rank = padded.astype(np.int64)
    while have < length:
        step = min(have, length - have)
        both = rank[: len(rank) - step] << np.int64(32) | rank[step:]
        _, rank = np.unique(both, return_inverse=True)
        have += step
    return rank[:n]


def previous_factors(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether the string that has a rank also starts at a smaller position.

    ``rank`` orders suffixes to the depth of LENGTH; position is their order in the texts.
    In suffix order a factor of that length reaches over neighbours of one rank only. The
    suffixes of a rank are taken by position, so the nearest smaller position before one is
    its neighbour, if that has its rank, and the nearest after it is none.
    """
    order = np.lexsort((position, rank))
    previous = np.zeros(len(rank), bool)
    previous[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return previous


def shared_windows(data, starts, sizes, spots, age, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the runs that an earlier run also holds: run and place in it, in order.

    Runs of several K-grams are put into one suffix array. Those of one K-gram that is too
    frequent for that are taken by the place of the K-gram in the window, in which equal
    windows agree: the windows of one such place are sorted as they are, which is their suffix
    order to the depth of LENGTH, and take little more memory than they have bytes.
    """
    windows = sizes - length + 1
    if sizes.sum() <= 2 * BATCH:
        joint = gather(data, starts, sizes)
        first = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(starts)), windows)
        step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = suffix_ranks(joint, length)[first[run] + step]
        covered = np.flatnonzero(previous_factors(rank, age[run] * (2 * length) + step))
        return run[covered], step[covered]
    runs_, steps = [], []
    for place in range(length - K + 1):
        step = spots - place
        own = np.flatnonzero((step >= 0) & (step < windows))
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[starts[own] + step[own]]
        _, rank = np.unique(rows.view(f"S{length}").ravel(), return_inverse=True)
        own = own[previous_factors(rank, age[own])]
        runs_.append(own), steps.append(step[own])
    run, step = np.concatenate(runs_), np.concatenate(steps)
    order = np.lexsort((step, run))
    return run[order], step[order]


def spans_of(starts: np.ndarray, owner: np.ndarray, length: int):
    """Runs of consecutive window starts of one owner as spans of bytes: owner, begin, end."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], starts[first], starts[last[: len(first)]] + length


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; ``kept`` bytes if asked."""
    if length < K:
        raise ValueError(f"length must be at least {K}")
    blocked, blocks = in_blocks(docs.select("doc_id", "text"))
    bits = key_bits(blocks)
    width = max(1, (blocks - 1).bit_length())
    answers = count_codes(blocked, blocks, lambda rows: (r[3] for r in block_runs(rows, length)))

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows, answers, length, bits)
        own = np.flatnonzero(block.first)
        bucket = (block.grams[own] >> np.uint64(64 - width)).astype(np.int64)
        own, bucket = own[np.argsort(bucket, kind="stable")], np.sort(bucket)
        row = np.searchsorted(block.offsets, block.starts[own], "right") - 1
        ids = block.rows.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)[row]
        at, sizes = block.starts[own] - block.offsets[row], block.sizes[own]
        number = rows.column("block")[0].as_py()
        out: list[tuple] = []
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(own)]
        for s, e in zip(edges[:-1], edges[1:]):
            content = gather(block.data, block.starts[own[s:e]], sizes[s:e])
            hashes = (block.grams[own[s:e]], block.content[own[s:e]])
            spots = block.spots[own[s:e]]
            arrays = (ids[s:e], row[s:e], at[s:e], sizes[s:e], spots, *hashes)
            parts = [np.ascontiguousarray(x).tobytes() for x in arrays]
            out.append((int(bucket[s]), number, *parts, content.tobytes()))
        columns = list(zip(*out)) or [[]] * 10
        names = ["bucket", "block", "ids", "rows", "places", "sizes"]
        names += ["spots", "grams", "hashes", "content"]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 8
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

    def compare(rows: pa.Table) -> pa.Table:
        # The column's own buffer, without a copy of each row's part.
        read = lambda name, kind: text.utf8(rows.column(name))[0].view(kind)
        names = ("ids", "rows", "places", "sizes", "spots")
        ids, row, at, sizes, spots = (read(n, np.int64) for n in names)
        grams, content = read("grams", np.uint64), read("hashes", np.uint64)
        data = read("content", np.uint8)
        numbers = rows.column("block").to_numpy()
        block = np.repeat(numbers, [len(x) // 8 for x in rows.column("ids").to_pylist()])
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((at, row, block, ids))
        age = np.empty(len(order), np.int64)
        age[order] = np.arange(len(order))
        # equal runs: all but the earliest go
        order = np.lexsort((age, content))
        same = np.zeros(len(order), bool)
        same[order[1:]] = content[order[1:]] == content[order[:-1]]
        gone = np.flatnonzero(same)
        owner, begin, end = gone, at[gone], at[gone] + sizes[gone]
        # different runs of one K-gram: windows in suffix order
        kept = np.flatnonzero(~same)
        kept = kept[np.argsort(grams[kept], kind="stable")]
        _, which, many = np.unique(grams[kept], return_inverse=True, return_counts=True)
        kept, which = kept[many[which] > 1], which[many[which] > 1]
        found = [(owner, begin, end)]
        ends = np.cumsum(sizes[kept])
        start = 0
        while start < len(kept):
            stop = int(np.searchsorted(ends, ends[start] + BATCH, "right"))
            last = which[min(stop, len(kept) - 1)]  # whole K-grams only
            stop = int(np.searchsorted(which, last)) if stop < len(kept) else stop
            stop = max(stop, int(np.searchsorted(which, which[start], "right")))
            some, start = kept[start:stop], stop
            run, step = shared_windows(data, starts[some], sizes[some], spots[some], age[some], length)
            o, b, e = spans_of(step, some[run], length)
            found.append((o, at[o] + b, at[o] + e))
        owner, begin, end = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(block[owner], kind="stable")
        owner, begin, end = owner[order], begin[order], end[order]
        to = block[owner]
        edges = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
        spans = list(zip(edges[:-1], edges[1:]))
        packed = lambda x: pa.array([x[s:e].tobytes() for s, e in spans], pa.binary())
        return pa.table(
            {
                "block": pa.array([int(to[s]) for s, _ in spans], pa.int64()),
                "bucket": pa.array([-1] * len(spans), pa.int64()),
                "codes": pa.array([None] * len(spans), pa.binary()),
                "rows": packed(row[owner]),
                "begins": packed(begin),
                "ends": packed(end),
            }
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        is_answer = [b >= 0 for b in told.column("bucket").to_pylist()]
        block = Block(rows, told.filter(pa.array(is_answer, pa.bool_())), length, bits)
        spans = told.filter(pa.array([not a for a in is_answer], pa.bool_()))
        read = lambda name: np.frombuffer(b"".join(spans.column(name).to_pylist()), np.int64)
        edges = np.zeros(len(block.data) + 1, np.int32)
        base = block.offsets[read("rows")]
        np.add.at(edges, base + read("begins"), 1)
        np.add.at(edges, base + read("ends"), -1)
        again = ~block.first
        np.add.at(edges, block.starts[again], 1)
        np.add.at(edges, block.starts[again] + block.sizes[again], -1)
        removed = np.cumsum(edges, out=edges)[:-1] > 0
        n_removed, n_spans, kept = [], [], []
        for s, e in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            own = removed[s:e]
            n_removed.append(int(own.sum()))
            n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            kept.append(block.data[s:e][~own].tobytes())
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = {
            "doc_id": block.rows.column("doc_id"),
            "n_bytes": pa.array(np.diff(block.offsets)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if keep_bytes:
            columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    grouped = blocked.groupBy("block")
    sent = grouped.cogroup(answers.groupBy("block")).applyInArrow(
        send,
        "bucket bigint, block bigint, ids binary, rows binary, places binary, sizes binary, "
        "spots binary, grams binary, hashes binary, content binary",
    )
    spans = sent.groupBy("bucket").applyInArrow(
        compare,
        "block bigint, bucket bigint, codes binary, rows binary, begins binary, ends binary",
    )
    told = spans.unionByName(answers, allowMissingColumns=True)
    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary" if keep_bytes else ""
    return grouped.cogroup(told.groupBy("block")).applyInArrow(finish, schema)
