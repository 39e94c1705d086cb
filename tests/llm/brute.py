"""Plain versions that the operators are held against."""

import hashlib
import itertools
import re

TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(TABLE))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(rows):
    """{(doc_id, n_shingles, component_id)} with repeats, for rows of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            up[max(root(i), root(j))] = min(root(i), root(j))
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root(i)] = min(names.get(root(i), doc_id), doc_id)
    found = [(d, len(s), names.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(found, key=str)


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), for rows of (doc_id, text)."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone, last = bytearray(len(data)), 0
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                start = max(i, last)
                gone[start : i + length] = b"\1" * (i + length - start)
                last = i + length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def without_blocks(rows, least=10):
    """Texts, blank lines aside, without the lines of blocks that a document of lower id holds."""
    split = {i: [x.strip() for x in t.split("\n")] for i, t in rows}
    out = {}
    for i, own in split.items():
        gone = set()
        for first, end in itertools.combinations(range(len(own) + 1), 2):
            block = own[first:end]
            if sum(len(x.split()) for x in block) >= least:
                others = [x for j, x in split.items() if j < i]
                n = end - first
                if any(block == x[k : k + n] for x in others for k in range(len(x) - n + 1)):
                    gone.update(range(first, end))
        out[i] = [x for k, x in enumerate(own) if x and k not in gone]
    return out
