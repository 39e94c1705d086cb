"""Periodic runs, token files and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import _canonical, duck
from fleetwarden.llm import periods, queries, repair, text, token_files, units
from tests.llm.conftest import SMALL

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    found = queries.queries()[name](spark, SMALL)
    result = duck(SMALL).execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert _canonical(found.columns, found.collect()) == _canonical(columns, result.fetchall())


# Periodic runs


def plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(least, times * q):
                found.setdefault((first - q, i - first + q), q)
            i += i == first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng, n):
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.5:
            words += rng.choices("abc", k=rng.randint(1, 9)) * rng.randint(1, 12)
        elif kind < 0.7 and words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 60)]
        else:
            words += rng.choices("abcdefgh", k=rng.randint(1, 20))
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_periodic_runs(make, edges, least, times):
    rng = random.Random(least)
    rows = edges + [(100 + i, "  ".join(odd_words(rng, rng.randint(0, 200))) + "\n") for i in range(200)]
    found = periods.periodic_runs(make(rows), least=least, times=times)
    assert found.columns[-3:] == ["n_words", "runs", "collapsed"] and "score" in found.columns
    seen = 0
    for r in found.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = plain_runs(words, least, times) if len(words) < 2000 else [(0, len(words), 1)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        seen += len(runs)
    assert seen > 100 and found.count() == len(rows)


def test_periodic_runs_work_grows_with_words():
    """One word, one long period, and a passage that comes back: no pair of all equal words."""
    for words in (["a"] * 30_000, [str(i % 7000) for i in range(30_000)]):
        hashes = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        (windows,) = periods.repeated_windows(hashes, np.array([0, len(words)]), 16).values()
        assert periods.diagonal_runs(windows, 16, 24, 3) == plain_runs_of_one(words)


def plain_runs_of_one(words):
    q = len(set(words))
    return [(0, len(words), q)]


def test_planted_runs(make, edges):
    rows = edges + [(i, f"w{i} " + " ".join(f"x{k % 50}" for k in range(i % 90))) for i in range(300, 700)]
    planted = 0
    for r, (i, t) in zip(periods.with_planted_runs(make(rows).coalesce(1)).collect(), rows):
        h = None if i is None else zlib.crc32(str(i).encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if h is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert r.text == " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
            planted += 1
        else:
            assert r.text == t
    assert planted > 20


# Token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([1, 7, 256]))
def test_blocks_round_trip(values, block):
    ids = np.array(values, np.uint32)
    ends = np.array([len(ids) // 2, len(ids)])
    shard = token_files.Shard(3, 1, 9, [None, -5], ends, token_files.pack(ids, block))
    back = token_files.Shard.from_bytes(shard.to_bytes() + b"\n")
    assert back[:4] == (3, 1, 9, [None, -5]) and back.ends.tolist() == ends.tolist()
    assert back.ids.ids().tolist() == values
    for first, end in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 4), (5, 5)):
        if first >= 0:
            assert back.ids.ids(first, end).tolist() == values[first:end]


def test_outliers_are_exceptions():
    ids = np.full(256, 1000, np.uint32)
    ids[::20] = 50_000
    ids[1::3] += 3
    packed = token_files.pack(ids)
    assert packed.widths.tolist() == [2] and len(packed.places) == 13 and len(packed.data) == 64
    assert (packed.ids() == ids).all()


def plain_index(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest())
    start, out = 0, []
    for doc_id, words in sorted(rows, key=key):
        ids = [*tokenizer.encode(words or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,kept", [(1 << 20, 500_000), (2000, 100)])
def test_token_files(spark, small, make, edges, tmp_path, monkeypatch, shard, kept):
    monkeypatch.setattr(token_files, "SHARD", shard)
    monkeypatch.setattr(token_files, "UNITS_KEPT", kept)
    rng = random.Random(1)
    signs = " \n\t\r\x1c\x85\xa0　'sStT0129½éß漢😀.,<|endoftext|>aàʰ"
    odd = [(i - 100, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for i in range(300)]
    documents = [(r.doc_id, r.text) for r in small("documents").collect()]
    for name, rows in (("edges", edges), ("odd", odd), ("documents", documents)):
        folder = str(tmp_path / name)
        token_files.write(make(rows), TOKENIZER, public_tokenizers.PATTERN, folder)
        found = token_files.index(spark, folder)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_index(rows)
        assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        sums = [(r.doc_id, zlib.crc32(np.array(r.token_ids, "<u4").tobytes())) for r in token_files.read(spark, folder).collect()]
        assert sorted(sums, key=str) == sorted(((r[0], r[3]) for r in plain_index(rows)), key=str)


def test_units_apart_by_their_second_hash(monkeypatch):
    """With a first hash of three bits nearly all units collide."""
    import pyarrow as pa

    plain = text.span_hashes
    calls = []

    def weak(sums, starts, ends):
        calls.append(1)
        return plain(sums, starts, ends) & np.uint64(7) if len(calls) % 2 else plain(sums, starts, ends)

    monkeypatch.setattr(text, "span_hashes", weak)
    known, seen = units.Units(1000), {}
    for texts in (["ab cd  ef", None, "", " ab\u2003x y", "cd ab "], ["ab cd", "gh", " ab"]):
        codes, first, new, _ = known.code(pa.array(texts))
        for k, word in zip(range(known.n - len(new), known.n), new):
            assert word not in seen.values()
            seen[k] = word
        for t, a, b in zip(texts, first[:-1], first[1:]):
            assert b"".join(seen[c] for c in codes[a:b]) == (t or "").encode()
    assert len(seen) == known.n > 7 and known.collided


def test_characters_that_the_library_sees_differently(monkeypatch):
    with open(TOKENIZER, encoding="utf-8") as source:
        definition = source.read()
    encoder = token_files.Encoder(definition, public_tokenizers.PATTERN.replace(r"\p{L}", r"[a-zA-Zß]"))
    monkeypatch.setattr(encoder, "_same_class", lambda sign: sign == "ß")
    import pyarrow as pa

    texts = ["naïve Straße 漢字 1", "plain words", "é"]
    ids, ends = encoder.encode(pa.array(texts), 2)
    plain = Tokenizer.from_file(TOKENIZER)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == want and encoder.doubtful


def test_token_files_of_no_documents(spark, make, tmp_path):
    none = make([(1, "x")]).where("doc_id > 1")
    token_files.write(none, TOKENIZER, public_tokenizers.PATTERN, str(tmp_path / "none"))
    assert token_files.index(spark, str(tmp_path / "none")).collect() == []


# Conversation repair

GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_edits(row, fault, state):
    """(letter, cost, line, next state) of the edits of a row."""
    _, role, words = row
    edits = [("D", 3, (), state)]
    if fault not in ("blank", "duplicate"):
        late = fault == "truncated"
        for letter, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
            if new[:1] in GRAMMAR[state]:
                edits.append((letter, price + late, (f"{new}:{words}",), new[:1]))
    return edits


def plain_search(rows, faults):
    """The first end that a search by (cost, letters) reaches, any number of inserts allowed."""
    queue = [(0, "", 0, "", ())]
    while True:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if role[0] in GRAMMAR[state] and cost + 2 <= 3 * len(rows):
                heapq.heappush(queue, (cost + 2, audit + "I", at, role[0], (*lines, f"{role}:")))
        if at < len(rows):
            for letter, price, line, then in plain_edits(rows[at], faults[at], state):
                heapq.heappush(queue, (cost + price, audit + letter, at + 1, then, lines + line))


def plain_walk(rows, faults):
    """The same from the end, a table of (cost, letters, lines) by state."""
    never = (10**9, "", ())
    after = {"": (0, "", ()), "s": never, "u": never, "a": (0, "", ())}
    for at in range(len(rows), -1, -1):
        if at < len(rows):
            before = {}
            for state in after:
                ways = []
                for letter, price, line, then in plain_edits(rows[at], faults[at], state):
                    cost, audit, lines = after[then]
                    ways.append((cost + price, letter + audit, line + lines))
                before[state] = min(ways)
            after = before
        for _ in range(3):
            for state in after:
                for role in ("user", "assistant"):
                    if role[0] in GRAMMAR[state]:
                        cost, audit, lines = after[role[0]]
                        after[state] = min(after[state], (cost + 2, "I" + audit, (f"{role}:", *lines)))
    return after[""]


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, sha256) of rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, words in rows:
        shown = words.rstrip(" \t\n\x0b\x0c\r")
        late = shown[-1:] not in (".", "!", "?")
        faults.append("blank" if not shown else "duplicate" if (role, words) in seen else "truncated" if late else "")
        seen.add((role, words))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    if len(rows) > 6:
        cost, audit, lines = plain_walk(rows, faults)
    else:
        cost, audit, lines = plain_search(rows, faults)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def plain_reports(rows):
    """Reports of rows (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, words in rows:
        talks[conv].append((turn, role or " " if role is None else role, " " if words is None else words))
    out = []
    for conv, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[0] for r in said if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *plain_repair(said)))
    return sorted(out, key=str)


MESSAGES = "conv_id bigint, turn bigint, role string, text string, cost string, copies string, part string"


def messages_of(spark, rows, partitions=8):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], MESSAGES).repartition(partitions)


def some_messages(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", None, "", "users"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "One.", "Two.", "more"]
    weights = [2, 6, 6, 1, 1, 1, 1]
    turns = [None, *range(n + 3)]
    return [
        (conv, rng.choice(turns), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.")
        for _ in range(n)
    ]


def test_repair_of_small_conversations(spark):
    rng = random.Random(5)
    rows = [r for conv in range(400) for r in some_messages(rng, conv, rng.randint(1, 6))]
    rows += [(None, 0, "user", "a."), (None, 1, "user", "b"), (None, 1, "user", "b")]
    found = repair.report(repair.repair(messages_of(spark, rows)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_reports(rows)


@pytest.mark.parametrize("chunk,piece", [(16, 1 << 20), (2, 10)])
def test_repair_of_a_conversation_in_many_partitions(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "PIECE", piece)
    repair.costs_before.cache_clear()
    repair.cheapest.cache_clear()
    rng = random.Random(chunk)
    rows = []
    for conv in (1, 2, 7):
        n = 40 if conv == 2 else 5
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", ""])) for t in range(n)]
    rows += [(2, 3, "user", "again.")] * 6 + [(2, 30, "user", "again.")]
    for partitions in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            edits = repair.repair(messages_of(spark, rows))
            found = [tuple(r) for r in repair.report(edits).collect()]
            parts = {r.part for r in edits.where("conv_id = 2").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(found, key=str) == plain_reports(rows)
        assert len(parts) > (3 if partitions == "16" else 0)


def test_repair_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "cut"), (1, 1, "user", "cut"), (1, 2, "assistant", "Yes.")]
    edits = repair.repair(messages_of(spark, rows)).orderBy("part", "step").collect()
    assert [(r.turn, r.fault, r.edit, r.new_role, r.cost) for r in edits] == [
        (0, None, "K", "user", 0),
        (1, "truncated", "D", None, 3),
        (1, "duplicate", "D", None, 3),
        (2, None, "K", "assistant", 0),
    ]
    assert [r.illegal for r in edits] == [False, True, True, False]


def test_repair_of_nothing(spark):
    none = messages_of(spark, [(1, 0, "user", "x")]).where("turn > 0")
    assert repair.report(repair.repair(none)).collect() == []
    gone = messages_of(spark, [(1, 0, "user", "x"), (1, 1, None, None)]).withColumn("copies", F.lit(0))
    (row,) = repair.report(repair.repair(gone, copies="copies")).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damaged(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (*range(20), None) for t in (None, 0, 1, 2)] + [(3, 9, None, None)]
    for r in repair.damaged(messages_of(spark, rows)).collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        case = zlib.crc32(key.encode()) % 20
        null = (r.conv_id, r.turn) == (3, 9)
        words = " " if null else "One. Two!"
        assert r.copies == {0: 0, 3: 2}.get(case, 1)
        assert r.role == ("user" if case == 4 else " " if null else "assistant")
        assert r.text == {1: "", 2: words.replace(".", "").replace("!", "")}.get(case, words)


def test_the_encoder_stays_in_its_worker(spark, monkeypatch, tmp_path):
    """Tasks of one Python worker learn on from each other, and the ids are the same."""
    made = spark.sparkContext.accumulator(0)
    plain = token_files.Encoder

    def counted(*given):
        made.add(1)
        return plain(*given)

    monkeypatch.setattr(token_files, "Encoder", counted)
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), "id").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings_ = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        token_files.write(docs, TOKENIZER, public_tokenizers.PATTERN, f"{tmp_path}/ids")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 <= made.value <= 32  # a worker for each core at once, not one for each of 64 tasks
    known = Tokenizer.from_file(TOKENIZER)
    rows = token_files.read(spark, f"{tmp_path}/ids").collect()
    assert len(rows) == 64
    for row in rows:
        assert row["token_ids"] == [*known.encode(f"one two {row['doc_id']}", add_special_tokens=False).ids, 2]
