"""Numbers for the different units of texts, so that each is tokenized once in a task.

A unit ends where a space stands before a sign that isn't white space: there, byte-level
pre-tokenizers of this kind begin a match whatever stands before, so units can be encoded
alone. Units are found and hashed with numpy, without a Python loop over them. Two 64-bit
hashes tell them apart: the first one finds a unit's number, the second one is compared.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import regex

from fleetwarden.llm import text

SPACE = 0x20
AT_ONCE = 1 << 21
#: Bytes that a unit's space may stand before: no ASCII white space, and no byte that some other
#: white space begins with (U+0085, U+00A0, U+1680, U+2000 and on, U+3000).
GOES_ON = text.byte_class((0x09, 0x0D), (0x1C, 0x20), (0xC2, 0xC2), (0xE1, 0xE3))
#: Values of the second hash.
OTHER_VALUES = text.mix(text.BYTE_VALUES + np.uint64(1))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of every unit; a unit never reaches over two texts."""
    cut = np.zeros(len(data) + 1, bool)
    cut[: len(data) - 1] = (data[:-1] == SPACE) & GOES_ON[data[1:]] if len(data) else False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    cut[edges - 1] = False  # the last byte of a text is followed by another text
    cut[offsets] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def begins_with_space(unit: bytes) -> bool:
    """Whether the unit is one that was cut at its space, so that it can stand behind any other."""
    return len(unit) > 1 and unit[0] == SPACE and bool(GOES_ON[unit[1]])


def spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of many spans, one after another; places are worked out for AT_ONCE at a time."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, values.dtype)
    cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, total, AT_ONCE)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(ends)]):
        if a < b:
            begin, end = int(ends[a] - sizes[a]), int(ends[b - 1])
            shift = np.repeat(starts[a:b] - (ends[a:b] - sizes[a:b]), sizes[a:b])
            out[begin:end] = values[shift + np.arange(begin, end)]
    return out


class Units:
    """Gives every different unit a number, up to a limit, from which on it begins anew."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.known: dict[int, int] = {}
        self.collided: dict[tuple[int, int], int] = {}
        self.second = np.empty(1 << 16, np.uint64)

    def _number(self, second: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.n, self.n + len(second))
        self.n += len(second)
        while self.n > len(self.second):
            self.second = np.concatenate([self.second, np.empty_like(self.second)])
        self.second[numbers] = second
        return numbers

    def code(self, column) -> tuple[np.ndarray, np.ndarray, list[bytes], bool]:
        """Of a text column: the units' numbers, the place of each text's first unit (and the
        total), the new units, which have the highest numbers, and whether all were forgotten."""
        forgotten = self.n > self.limit
        if forgotten:
            self.clear()
        data, offsets = text.utf8(column)
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = text.span_hashes(text.prefix_hashes(data), starts, ends)
        other = text.span_hashes(text.prefix_hashes(data, OTHER_VALUES), starts, ends)
        different, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = np.fromiter(map(self.known.get, different.tolist(), repeat(-1)), np.int64, len(different))
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = self._number(other[index[fresh]])
        self.known.update(zip(different[fresh].tolist(), numbers[fresh].tolist()))
        codes, new = numbers[inverse], index[fresh].tolist()
        for i in np.flatnonzero(self.second[codes] != other).tolist():
            key = (int(hashes[i]), int(other[i]))
            if key not in self.collided:
                self.collided[key] = int(self._number(other[i : i + 1])[0])
                new.append(i)
            codes[i] = self.collided[key]
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        return codes, np.searchsorted(starts, offsets), units, forgotten


class UnitEncoder:
    """Ids of whole texts by way of their units and pre-tokens, each different one once.

    Units are cut into pre-tokens by ``pattern``; a subclass gives the ids of pre-tokens. All is
    forgotten when more than ``limit`` units are known.
    """

    def __init__(self, pattern: str, limit: int):
        self.pre_tokens = regex.compile(pattern).findall
        self.units = Units(limit)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)  # of units
        self.pieces: dict[str, int] = {}
        self.piece_ids, self.piece_ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.piece_bytes = np.empty(0, np.int64)

    def of_pieces(self, data: bytes, n_bytes: list[int]) -> tuple[list[int], list[int]]:
        """Ids of the pre-tokens that lie in ``data`` one after another, and how many each has."""
        raise NotImplementedError

    def whole(self, units: list[str]) -> dict[int, list[int]]:
        """Ids of units that can't be cut by the pattern here, by their place in the list."""
        return {}

    def _learn_pieces(self, new: list[str]) -> None:
        data = "".join(new).encode()
        n_bytes = [len(p) if p.isascii() else len(p.encode()) for p in new]
        ids, sizes = self.of_pieces(data, n_bytes)
        self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new))))
        self.piece_bytes = np.concatenate([self.piece_bytes, n_bytes])
        self.piece_ids = np.concatenate([self.piece_ids, np.array(ids, np.uint32)])
        last = self.piece_ends[-1]
        self.piece_ends = np.concatenate([self.piece_ends, last + np.cumsum(sizes, dtype=np.int64)])

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new units, in their order."""
        if not new:
            return
        units = [u.decode() for u in new]
        whole = self.whole(units)
        # A unit that begins with its space can stand behind others, which is the rule.
        inner = np.array([begins_with_space(u) for u in new])
        inner[list(whole)] = False
        joined = np.flatnonzero(inner).tolist()
        pieces = self.pre_tokens("".join([units[k] for k in joined]))
        n_joined = len(pieces)
        counts = np.zeros(len(new), np.int64)
        for k in np.flatnonzero(~inner).tolist():
            if k not in whole:
                own = self.pre_tokens(units[k])
                pieces += own
                counts[k] = len(own)
        unknown = {p: None for p in pieces if p not in self.pieces}
        if unknown:
            self._learn_pieces(list(unknown))
        codes = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        # Where the joined units end tells how many pieces each has.
        at = np.cumsum(self.piece_bytes[codes[:n_joined]])
        ends = np.cumsum([len(new[k]) for k in joined])
        cuts = np.searchsorted(at, ends) + 1
        if len(ends) and not (at[cuts - 1] == ends).all():
            raise ValueError("the pattern joins signs on both sides of a unit's space")
        counts[inner] = np.diff(cuts, prepend=0)
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        first = np.empty(len(new), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        codes = spans(codes, first, counts)
        sizes = self.piece_ends[codes + 1] - self.piece_ends[codes]
        ids = spans(self.piece_ids, self.piece_ends[codes], sizes)
        totals = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])])
        for k, own in sorted(whole.items()):
            ids = np.insert(ids, int(totals[:k].sum()), np.array(own, np.uint32))
            totals[k] = len(own)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(totals)])

    def code(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The units' numbers in a text column and the place of each text's first one (and the
        total); unit k has the ids ``ids[ends[k]:ends[k + 1]]``."""
        codes, first, new, forgotten = self.units.code(column)
        if forgotten:
            self._forget()
        self._learn(new)
        return codes, first

    def text_ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the total)."""
        codes, first = self.code(column)
        sizes = self.ends[codes + 1] - self.ends[codes]
        ids = spans(self.ids, self.ends[codes], sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]
