"""Removal of lines that a document shares with an earlier one, by pairwise alignment.

Every line that several documents hold leads each of them to the first holder, and so does every
shortest run of lines with ``MIN_WORDS`` words, counted on from each line and back from it. Each
line of a block that can go is in such a run inside the block, so whoever shares it meets the
document that first holds that run, also if its single lines were seen elsewhere before. The
pairs to look at are at most three for each line of a document however common the line is: a
frequent line needs no cap. A pair
is aligned by patience diff: lines that are unique in both are matched along their longest
common order, the gaps between are treated the same way, and matches grow over equal
neighbours. A block of consecutive matched lines goes from the later document if it has at
least ``MIN_WORDS`` words. What is left of the later document is then held against the whole
earlier one again, so that moved blocks and each copy of a repeated one go as well. Since every such line stays in its first holder, no passage is lost.

Only line hashes, a few for each document, are shuffled for this; texts move once, to meet what
is to be cut.

Defined results: lines are compared without blanks at their ends; blank lines go with the block
they lie in. Documents are ordered by id; rows of one id are not compared with each other, and
rows without an id, null and empty texts stay as they are. Columns named n_lines or n_removed
are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import cut, ddl, without

MIN_WORDS = 10


def line_hashes(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hash of every line (0 if blank) and its number of words."""
    data, offsets = text.utf8(column)
    starts, ends, _ = text.words(data, offsets, text.NOT_BLANK)
    sums = text.prefix_hashes(data)
    breaks = np.flatnonzero(data == 10)
    for begin, end in zip(offsets[:-1], offsets[1:]):
        own = breaks[np.searchsorted(breaks, begin) : np.searchsorted(breaks, end)]
        first = np.searchsorted(starts, np.concatenate([[begin], own]))
        last = np.searchsorted(starts, np.concatenate([own, [end]]))
        words = last - first
        hashes = np.zeros(len(words), np.uint64)
        some = np.flatnonzero(words)
        hashes[some] = text.span_hashes(sums, starts[first[some]], ends[last[some] - 1])
        yield hashes, words


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def runs(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """First line, end and key of every shortest run of ``min_words`` words inside one document.

    Runs start or end at each line that is not blank; ``offsets`` are the documents' first lines
    and the total. The key of a run of one line is the line's hash.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    line = np.flatnonzero(words)
    least = max(1, min_words)
    owner = np.searchsorted(offsets, line, "right")
    ends = np.searchsorted(total, total[line] + least)
    starts = np.searchsorted(total, total[line + 1] - least, "right") - 1
    on, back = ends <= offsets[owner], starts >= offsets[owner - 1]
    starts, ends = np.concatenate([line[on], starts[back]]), np.concatenate([ends[on], line[back] + 1])
    up, _ = text.powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(text.mix(hashes + text.U(text.BASE)) * up[:-1], out=sums[1:])
    keys = text.span_hashes(sums, starts, ends)
    single = ends - starts == 1
    keys[single] = hashes[starts[single]]
    return starts, ends, keys


def _anchors(a: list[int], b: list[int], lo: int, hi: int, lo2: int, hi2: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, along their longest common order."""
    at: dict[int, int] = {}
    for j in range(lo2, hi2):
        at[b[j]] = -1 if b[j] in at else j
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        if a[i] in at:
            seen[a[i]] = -1 if a[i] in seen else i
    pairs = [(i, at[x]) for x, i in seen.items() if i >= 0 and at[x] >= 0]
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j), piles.append(k)
        else:
            tops[p], piles[p] = j, k
    chain, k = [], piles[-1] if piles else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two line lists, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, lo2, hi2 = todo.pop()
        while lo < hi and lo2 < hi2 and a[lo] == b[lo2]:
            matched.append((lo, lo2))
            lo, lo2 = lo + 1, lo2 + 1
        while lo < hi and lo2 < hi2 and a[hi - 1] == b[hi2 - 1]:
            hi, hi2 = hi - 1, hi2 - 1
            matched.append((hi, hi2))
        if lo == hi or lo2 == hi2:
            continue
        chain = _anchors(a, b, lo, hi, lo2, hi2)
        for i, j in chain:
            todo.append((lo, i, lo2, j))
            matched.append((i, j))
            lo, lo2 = i + 1, j + 1
        if chain:
            todo.append((lo, hi, lo2, hi2))
    return sorted(matched)


def longest_matches(a: list[int], b: list[int]) -> list[int]:
    """For each place of a, how many lines up to it b holds one after another, wherever it does.

    By the suffix automaton of b, in linear time however often lines repeat.
    """
    step, link, size, last = [{}], [-1], [0], 0
    for x in b:
        new, p = len(size), last
        step.append({}), link.append(0), size.append(size[last] + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[q] > size[p] + 1:
                copy = len(size)
                step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q], q = copy, copy
            link[new] = q
        last = new
    found, at, length = [], 0, 0
    for x in a:
        while at and x not in step[at]:
            at = link[at]
            length = size[at]
        if x in step[at]:
            at, length = step[at][x], length + 1
        found.append(length)
    return found


def common_lines(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, min_words: int) -> list[int]:
    """Lines of the later document in common blocks of at least ``min_words`` words.

    Blocks that the alignment leaves, since they are moved or repeated in one of the documents,
    are then looked for in the whole earlier document.
    """
    gone: set[int] = set()
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later.tolist(), earlier.tolist()), (-1, -1)]:
        if (i - 1, j - 1) != before:
            if sum(int(words[k]) for k in block) >= min_words:
                gone.update(block)
            block = []
        block.append(i)
        before = (i, j)
    shared = np.isin(later, earlier)
    left = shared & (words > 0)
    left[list(gone)] = False
    if left.any():
        total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], shared, [0]]).astype(np.int8))).tolist()
        stretches = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if left[s:e].any()]
        stretches = [(s, e) for s, e in stretches if total[e] - total[s] >= min_words]
        # A line between two stretches is in no match.
        places = [i for s, e in stretches for i in range(s, e + 1)]
        own = [int(later[i]) if i < len(later) and shared[i] else -1 for i in places]
        found = longest_matches(own, earlier.tolist()) if own else []
        reach = len(later)
        for i, n in zip(reversed(places), reversed(found)):
            if n and total[i + 1] - total[i + 1 - n] >= min_words:
                reach = min(reach, i + 1 - n)
            if n and i >= reach:
                gone.add(i)
    return sorted(gone)


def _line_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text.pieces(batch):
                found = list(line_hashes(rows.column("text")))
                columns = {
                    "doc_id": rows.column("doc_id"),
                    "digest": pa.array([digest(h) for h, _ in found], pa.binary()),
                    "lines": pa.array([h.tobytes() for h, _ in found], pa.binary()),
                    "words": pa.array([w.astype(np.int32).tobytes() for _, w in found], pa.binary()),
                }
                yield from pa.table(columns).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, lines binary, words binary"
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return known.select("doc_id", "text").mapInArrow(run, schema)


def _pairs(rows: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Distinct (doc_id, first): each document with the first holders of its lines and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lines = [np.frombuffer(x, np.uint64) for x in part.column("lines").to_pylist()]
                words = [np.frombuffer(x, np.int32) for x in part.column("words").to_pylist()]
                offsets = np.cumsum([0, *map(len, lines)])
                lines, words = np.concatenate(lines), np.concatenate(words)
                starts, _, keys = runs(lines, words, offsets, min_words)
                single = np.flatnonzero(lines)
                keys = np.concatenate([lines[single], keys]).view(np.int64)
                owner = np.searchsorted(offsets, np.concatenate([single, starts]), "right") - 1
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                ids = part.column("doc_id").take(pa.array(owner[new]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), ids], ["line", "doc_id"])

    held = rows.select("doc_id", "lines", "words").mapInArrow(run, f"line bigint, doc_id {kind}")
    first = held.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.where("first <> last").select("line", "first")
    return held.join(first, "line").where("doc_id <> first").select("doc_id", "first").distinct()


def remove_shared_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their text cut, the number of its lines and of those removed."""
    docs = without(docs, ["n_lines", "n_removed"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(_line_rows(docs))
    pairs = _pairs(rows, kind, min_words)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("lines", "words", "earlier")}
            gone = []
            for lines, words, earlier in zip(c["lines"], c["words"], c["earlier"]):
                found = common_lines(
                    np.frombuffer(lines, np.uint64),
                    np.frombuffer(words, np.int32),
                    np.frombuffer(earlier, np.uint64),
                    min_words,
                )
                gone.append(np.array(found, np.int32).tobytes() if found else None)
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(gone, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "gone"])

    earlier = rows.select(F.col("doc_id").alias("first"), F.col("lines").alias("earlier"))
    both = pairs.join(earlier, "first").join(rows, "doc_id")
    both = both.select("doc_id", "digest", "lines", "words", "earlier")
    gone = both.mapInArrow(align, f"doc_id {kind}, digest binary, gone binary").where("gone IS NOT NULL")
    gone = gone.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("digest", "gone")).alias("__gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch):
                texts, marks = part.column("text").to_pylist(), part.column("__gone").to_pylist()
                hashes = line_hashes(part.column("text"))
                n_lines, n_removed = [], []
                for k, (own, _) in enumerate(hashes):
                    lost = set()
                    if marks[k]:
                        name = digest(own)
                        for m in marks[k]:
                            if m["digest"] == name:
                                lost.update(np.frombuffer(m["gone"], np.int32).tolist())
                    n_lines.append(len(own) if texts[k] else 0)
                    n_removed.append(len(lost))
                    if lost:
                        parts = texts[k].split("\n")
                        texts[k] = "\n".join([x for i, x in enumerate(parts) if i not in lost])
                at = part.schema.get_field_index("text")
                part = part.set_column(at, "text", pa.array(texts, pa.string()))
                part = part.drop_columns(["__gone"])
                part = part.append_column("n_lines", pa.array(n_lines, pa.int64()))
                part = part.append_column("n_removed", pa.array(n_removed, pa.int64()))
                yield from part.to_batches()

    marked = docs.join(gone, "doc_id", "left").select(*docs.columns, "__gone")
    return marked.mapInArrow(apply, ddl(docs, "n_lines bigint, n_removed bigint"))


def without_shared_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their text cut, own columns only; those of which nothing is left go.

    n_chars, where there is one, follows the text.
    """
    found = remove_shared_lines(docs, min_words=min_words)
    found = found.where("n_removed = 0 OR trim(BOTH ' \t\r\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return found.select(docs.columns)
