"""Periodic runs: stretches of words that repeat with a fixed period, found in one pass.

An online sparse diagonal dynamic program. At each word its earlier occurrences say which
lags match there; a lag that matches on from word to word is an active diagonal whose match
length grows, and one that stops matching is a run if it got long enough, which is reported
at that moment.

What keeps it sparse: a run of period q has at least ``max(least - q, (times - 1) * q)``
matches in a row, so the occurrences that count are those of whole windows of the least such
number of words (16 for runs of 24 words and three periods). Most texts repeat no window and
have no run. A lag is looked for only where it begins, among the occurrences with another
window before them, and only if the text is long enough for it to end as a run. A multiple
of an active lag whose run begins at the same word would end with it as well and is no
smallest period, so it is passed over. The work grows with words times active lags.

Texts are handled whole, each in one task and without a shuffle. Defined results: a null,
empty or blank text has no words and no runs; each row is worked on by itself, so repeated
rows repeat; of runs with one start and end the smallest period stands; a very long text is
worked on alone, in memory in proportion to its words; an empty table gives an empty one;
input columns named like the output's are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import ddl, without

#: Words are ``[^\x20\x09-\x0D]+``; equal words are those of equal 64-bit hashes.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a window that its text holds only once.
ONCE = -1
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shared_words(least: int, times: int) -> int:
    """So many words in a row, at least, equal those one period before them in any run."""
    return max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))


def repeated_windows(hashes: np.ndarray, first: np.ndarray, size: int) -> dict[int, list[int]]:
    """For the texts that hold some window of ``size`` words twice, a number for each window."""
    if len(hashes) < size:
        return {}
    windows = text.shingle_hashes(hashes, size)
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    at = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    keys = text.mix(windows[at] + text.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, number, often = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.where(often[number] > 1, number, ONCE)
    ends = np.cumsum(counts)
    repeating = np.unique(owner[number != ONCE])
    return {int(d): number[ends[d] - counts[d] : ends[d]].tolist() for d in repeating}


def diagonal_runs(windows: list[int], size: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, given the numbers of its windows."""
    n_words = len(windows) + size - 1
    begun: dict[int, int] = {}  # active lag -> the place where it began to match
    run_starts: dict[int, list[int]] = {}  # first word of the run -> its active lags
    seen: dict[int, dict[int, list[int]]] = {}  # window -> window before it -> places
    period: dict[tuple[int, int], int] = {}  # (start, length) -> smallest period
    before = ONCE
    for place, window in enumerate([*windows, ONCE]):
        ended = [q for q in begun if window == ONCE or windows[place - q] != window]
        for q in sorted(ended):
            since = begun.pop(q)
            run_starts[since - q].remove(q)
            length = place - since + size - 1 + q
            if length >= max(least, times * q):
                period.setdefault((since - q, length), q)
        if window != ONCE:
            earlier = seen.setdefault(window, {})
            nearest = -((n_words - times * place) // (times - 1))
            for other, places in earlier.items():
                if other == before != ONCE:
                    continue
                for start in places[bisect_left(places, nearest) :]:
                    q = place - start
                    lags = run_starts.setdefault(start, [])
                    if not any(q % p == 0 for p in lags):
                        lags.append(q)
                        begun[q] = place
            earlier.setdefault(before, []).append(place)
        before = window
    return [(start, length, q) for (start, length), q in sorted(period.items(), key=lambda x: (x[0][0], x[1]))]


def _collapse(data, offsets, starts, ends, first, runs) -> pa.Array:
    """The texts with their words joined by one space, without the repeats inside runs."""
    dropped = np.zeros(len(starts) + 1, np.int32)
    for d, found in runs.items():
        for start, length, q in found:
            dropped[first[d] + start + q] += 1
            dropped[first[d] + start + length] -= 1
    kept = np.cumsum(dropped)[:-1] == 0
    last = np.zeros(len(starts), bool)
    at = np.flatnonzero(kept)
    owner = np.searchsorted(first, at, "right")
    last[at] = np.append(owner[1:] != owner[:-1], True)[: len(at)]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # The blank after a word that isn't its text's last one becomes the space.
    blank = ends[kept & ~last]
    out = data.copy()
    out[blank] = 0x20
    inside[blank] = True
    sizes = np.concatenate([[0], np.cumsum(inside)])[offsets].astype(np.int64)
    buffers = [None, pa.py_buffer(sizes), pa.py_buffer(out[inside])]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def periodic_runs(
    docs: DataFrame, column: str = "text", least: int = 24, times: int = 3, keep_text: bool = True
) -> DataFrame:
    """The rows with ``runs``, ``n_words`` and ``collapsed``.

    A run is a stretch of at least ``least`` words and ``times`` (2 or more) of its smallest
    period that no neighbouring word extends; ``runs`` holds (start, length, period) in words
    from 0, by start, then period. ``collapsed`` is the text's words joined by one space
    without those that a run holds after its first period.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least one word and two periods")
    added = ["n_words", "runs", "collapsed"]
    docs = without(docs, added)
    rest = docs if keep_text else without(docs, [column])
    size = shared_words(least, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text.pieces(batch, column):
                data, offsets = text.utf8(rows.column(column))
                starts, ends, first = text.words(data, offsets, text.NOT_BLANK)
                hashes = text.span_hashes(text.prefix_hashes(data), starts, ends)
                windows = repeated_windows(hashes, first, size)
                runs = {d: diagonal_runs(w, size, least, times) for d, w in windows.items()}
                found = [x for d in sorted(runs) for x in runs[d]]
                counts = [len(runs.get(d, ())) for d in range(len(rows))]
                fields = zip(*found) if found else ([], [], [])
                values = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in fields], fields=list(RUN)
                )
                places = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                collapsed = _collapse(data, offsets, starts, ends, first, runs)
                if not keep_text:
                    rows = rows.drop_columns([column])
                for name, values in (
                    ("n_words", pa.array(np.diff(first), pa.int64())),
                    ("runs", pa.ListArray.from_arrays(places, values)),
                    ("collapsed", collapsed),
                ):
                    rows = rows.append_column(name, values)
                yield from rows.to_batches()

    kinds = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.mapInArrow(run, ddl(rest, kinds))


def with_planted_runs(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Documents of which a tenth, by crc32 of the id, end in a repeated stretch of their words.

    With h the crc32 of the decimal id, g = floor(h / 10) and n words: where h % 10 is 0 and
    n > 0, each word i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10).cast("int")
    words = F.when(h % 10 == 0, F.regexp_extract_all(column, F.lit(WORD), F.lit(0)))
    n = F.size("__words")
    a = g % F.greatest(n, F.lit(1))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    cycle = F.slice("__words", a + 1, p)
    cycles = F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice("__words", F.lit(1), a), F.slice(cycles, F.lit(1), n - a))
    changed = F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col(column))
    others = [c for c in docs.columns if c != column]
    return docs.withColumn("__words", words).select(*others, changed.alias(column))


def longest_by_exponent(runs: Column) -> Column:
    """The run with the greatest length over period; ties by smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        by_exponent = y["length"] * x["period"] - x["length"] * y["period"]
        return (
            F.when(by_exponent != 0, F.signum(by_exponent))
            .when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
            .otherwise(F.signum(x["period"] - y["period"]))
            .cast("int")
        )

    return F.get(F.array_sort(runs, order), F.lit(0))
