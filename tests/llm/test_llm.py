"""Each operator against a plain version on small tables, and on nulls, ties and odd texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwarden.llm import (
    bpe,
    components,
    decontamination,
    language,
    lines,
    neighbours,
    ngram_join,
    quality,
    quotations,
    rarity,
    repeats,
    text,
    toxicity,
)
from fleetwarden.llm.frames import crc_mod
from tests.llm import brute
from tests.llm.conftest import SMALL

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,part", [(6 << 20, 1024), (60_000, 2)])
def test_ngram_join(small, make, edges, monkeypatch, block, part):
    monkeypatch.setattr(rarity, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PART", part)
    assert rows_of(ngram_join.similar_documents(small("documents"))) == brute.linked(
        pairs(small("documents"))
    )
    assert rows_of(ngram_join.similar_documents(make(edges))) == brute.linked(edges)


def test_blocks_send_fewer_messages_than_there_are_blocks(make, monkeypatch):
    monkeypatch.setattr(rarity, "BLOCK", 1000)
    rng = random.Random(5)
    docs = make([(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(300)])
    blocked, blocks = rarity.in_blocks(docs)
    assert blocks > 32
    bits, own = rarity.key_bits(blocks), lambda rows: ngram_join.gram_sets(rows, 1)
    answers = rarity.count_codes(blocked, blocks, own)
    sent = answers.groupBy("block").count().agg(F.max("count")).first()[0]
    assert sent <= blocks / 2

    def codes(rows, told):
        grams = np.concatenate(list(own(rows)))
        keys, found = rarity.Keys(grams, bits), rarity.codes_of(grams, bits, told)
        same = keys.codes(told)[keys.find(grams)] == found
        return pa.table({"gram": grams.view(np.int64), "code": found.astype(np.int32), "same": same})

    found = blocked.groupBy("block").cogroup(answers.groupBy("block"))
    found = found.applyInArrow(codes, "gram long, code int, same boolean").groupBy("gram")
    rows = found.agg(F.count("*").alias("n"), F.collect_set("code").alias("codes"), F.min("same").alias("same"))
    for r in rows.collect():
        assert r.same and r.codes == [rarity.code(np.array([r.n]))[0]]


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 255], [256, 3, 70_000], [2**63, 2**40 + 1, 0]):
        values = np.array(values, np.uint64)
        assert rarity.unpack(rarity.pack(values)).tolist() == values.tolist()


def test_ngram_join_chain_of_near_copies(make):
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        if i % 3 == 0:
            words = words[:]
            words[rng.randrange(120)] = f"new{i}"
        other = words[:]
        other[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(other)))
    assert rows_of(ngram_join.similar_documents(make(rows))) == brute.linked(rows)


def test_keep_one(make, edges):
    kept = sorted(r.doc_id for r in ngram_join.keep_one(make(edges).where("doc_id IS NOT NULL")).collect())
    assert kept == [1, 2, 3, 4, 6, 9, 10, 11]


def test_keep_one_of_repeated_ids(make):
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, one), (2, one), (2, other), (3, other), (4, "short"), (4, "short"), (4, "Short"), (5, one)]
    rows += [(6, None), (6, None), (6, ""), (None, one), (None, one)]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(make(rows)).collect()]
    want = [(1, one), (2, other), (4, "short"), (4, "Short"), (6, None), (6, ""), (None, one), (None, one)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert set(roots) == {*range(31), 100, 101}
    assert len({roots[i] for i in range(31)}) == 1 and roots[100] == roots[101] != roots[0]
    none = components.components(spark.createDataFrame([], "a long, b long"))
    assert none.collect() == []


@pytest.mark.parametrize("block,batch", [(60_000, 1 << 19), (60_000, 1000)])
def test_repeats(small, make, edges, monkeypatch, block, batch):
    monkeypatch.setattr(rarity, "BLOCK", block)
    monkeypatch.setattr(repeats, "BATCH", batch)
    docs = small("documents")
    assert rows_of(repeats.remove_repeats(docs)) == brute.repeats(pairs(docs))
    assert rows_of(repeats.remove_repeats(make(edges))) == brute.repeats(edges)


def test_suffix_ranks_order_strings():
    data = np.frombuffer(b"banana\0banana" * 3, np.uint8)
    rank = repeats.suffix_ranks(data, 7)
    strings = [(bytes(data[i : i + 7]) + b"\0" * 7)[:7] for i in range(len(data))]
    dense = np.unique(rank, return_inverse=True)[1]
    assert [sorted(set(strings)).index(s) for s in strings] == dense.tolist()


def test_bpe_is_tiktoken(small, make, edges):
    ranks = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    signs = " \n\t\r\x1c\x85\xa0　'sStT0129½Ⅷéß漢😀.,<|endoftext|>aàʰ"
    odd = [(i, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for i in range(500)]
    for docs in (small("documents"), make(edges), make(odd)):
        decoded = bpe.decode(bpe.encode(docs, PATH, PATTERN).select("text", "token_ids"), PATH)
        for r in decoded.collect():
            assert r.token_ids == own.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
        for r in bpe.round_trip(docs.select("doc_id", "text", F.col("text").alias("t")), PATH, PATTERN).collect():
            ids = own.encode_ordinary(r.t or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.t or "").encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    hashed = bpe.PerfectHash(keys)
    assert sorted(hashed.slots(keys)) == list(range(3000))


def test_decontamination(spark, make, edges):
    item = " ".join(f"word{i}" for i in range(100, 115))
    items = [(1, item), (2, "one two"), (3, None), (4, ""), (2, "one two"), (None, WORDS_ITEM)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (500_000, 5):
        found = decontamination.find_benchmark(make(edges), benchmark, item_words=limit)
        hits = {(r.doc_id, tuple(map(tuple, r.hits)), tuple(r.item_ids)) for r in found.collect()}
        assert hits >= {
            (1, (), ()),
            (4, ((0, 1),), ("2",)),
            (5, ((0, 1),), ("2",)),
            (6, ((100, 114),), ("1",)),
            (8, ((100, 114),), ("1",)),
        }
        assert len(found.collect()) == len(edges)
    clean = decontamination.remove_contaminated(make(edges), benchmark)
    assert clean.columns == make(edges).columns
    assert sorted(r.doc_id for r in clean.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 9, 10, 11]
    none = decontamination.find_benchmark(make(edges), benchmark.limit(0))
    assert all(r.hits == [] for r in none.collect())


WORDS_ITEM = "not an item"


def test_patience_deletes_common_blocks(make):
    block = "this line has more than ten words in it to be long\nand another one"
    docs = make(
        [
            (1, f"first own line\n{block}\nlast"),
            (2, f"other\n  {block}  \nelse"),
            (3, "and another one\nis short"),
            (4, None),
            (5, f"{block}\n{block}"),
        ]
    )
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.remove_shared_lines(docs).collect()}
    assert found[1] == (f"first own line\n{block}\nlast", 4, 0)
    assert found[2] == ("other\nelse", 4, 2)
    assert found[3] == ("and another one\nis short", 2, 0)
    assert found[4] == (None, 0, 0)
    assert found[5][1] == 4
    a, b = [1, 2, 3, 4, 5, 6], [2, 3, 9, 5, 6, 1]
    assert lines.patience(a, b) == [(1, 0), (2, 1), (4, 3), (5, 4)]


def test_block_of_short_lines_meets_its_first_holder(make):
    one, two, three = "a line of six words here", "and this one has six words", "three more words"
    rows = [
        (1, f"own 1\n{one}"),
        (2, f"own 2\n{two}"),
        (3, f"own 3\n{three}"),
        (4, f"own 4\n{one}\n{two}\nend 4"),
        (5, f"own 5\n{one}\n\n{two}\n{three}\nend 5"),
        (6, f"own 6\n{one}\n{two}\n{three}\nend 6"),
        (7, f"own 7\n{one}\n\n{two}\n{three}"),
        (8, f"own 8\n{two}\n{three}"),
        (9, f"{one}\n{two}\nown 9\n{three}"),
        (10, f"own 10\n{one}\n{two}\n{three}\nend 10"),
    ]
    found = {r.doc_id: r.text for r in lines.remove_shared_lines(make(rows)).collect()}
    want = {i: t for i, t in rows}
    want |= {6: f"own 6\n{three}\nend 6", 7: "own 7", 9: f"own 9\n{three}", 10: "own 10\nend 10"}
    assert found == want


def test_moved_and_repeated_blocks_go(make):
    one, two = "this line has more than ten words in it to be long", "so has this other line which is long as well now"
    pair = "twice these five words here\nand then five more words"
    rows = [
        (1, f"own 1\n{one}\nmiddle 1\n{two}"),
        (2, f"{two}\nown 2\n{one}"),
        (3, f"{one}\nown 3\n{one}\nend 3"),
        (4, f"{pair}\nx\n{pair}"),
        (5, f"own 5\n{pair}\nend 5"),
    ]
    found = {r.doc_id: r.text for r in lines.remove_shared_lines(make(rows)).collect()}
    assert found == {1: rows[0][1], 2: "own 2", 3: "own 3\nend 3", 4: rows[3][1], 5: "own 5\nend 5"}


def test_line_dedup_is_brute_force(make):
    random.seed(5)
    stock = ["", *(f"line {k}" + " w" * random.choice([0, 1, 3, 4, 7, 9]) for k in range(7))]
    texts = ["\n".join(random.choices(stock, k=random.randint(0, 14))) for _ in range(150)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r.text for r in lines.remove_shared_lines(make(rows)).collect()}
    assert {i: [x for x in t.split("\n") if x] for i, t in found.items()} == brute.without_blocks(rows)


def test_line_dedup_keeps_every_line_somewhere(small, make, edges):
    docs = small("documents")
    before = {x.strip() for _, t in pairs(docs) for x in t.split("\n")}
    kept = lines.remove_shared_lines(docs)
    after = {x.strip() for _, t in pairs(kept) for x in t.split("\n")}
    assert before - {""} == after - {""}
    assert kept.where("n_removed > 0").count() > 0
    assert lines.remove_shared_lines(make(edges)).count() == len(edges)


def accuracy(scored, labels, label):
    joined = scored.join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in joined) / len(joined)


def test_toxicity_and_quality(spark, small, make, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held = labels.where(crc_mod("doc_id", 5) == 0)
    assert accuracy(toxicity.score(docs, model), held, "toxic") > 0.93
    marks = quality.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    held = labels.where(crc_mod("doc_id", 3) == 1)
    assert accuracy(quality.score(docs, marks), held, "quality") > 0.88
    for module, fitted in ((toxicity, model), (quality, marks)):
        scored = module.score(make(edges), fitted)
        assert all(0 <= r.score <= 1 for r in scored.collect())
        empty = module.fit(docs, labels.limit(0))
        assert {r.score for r in module.score(make(edges), empty).collect()} == {0.5}
        assert module.score(docs.limit(0), fitted).collect() == []


def test_every_chosen_text_is_in_its_dictionary(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'}{i} " + "x" * random.randint(0, 3000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 AS quality")
    model = quality.fit(docs, labels, dictionary_bytes=2000, excerpt=1000)
    assert len(model.good) == len(model.bad) <= 2000
    assert model.good.count(b"\n") == model.bad.count(b"\n") == 9
    assert quality.fair_share([b"aaaaaa", b"b", b"cccc"], 10) == b"aaaa\nb\nccc"
    assert quality.fair_share([b"aa", b"", b"c"], 9) == b"aa\n\nc" and quality.fair_share([], 5) == b""


def test_language(spark, make, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = language.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    held = crc_mod("doc_id", 4) == 2
    model = language.fit(docs.where(~held), pieces, max_rows=60, rounds=2)
    rows = language.predict(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(make(edges), model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    nothing = language.fit(docs.limit(0), pieces)
    assert {r.lang_pred for r in language.predict(make(edges), nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    hashes, order = language._piece_index(["a", "b", "ab", "ba"])
    lattice = language.Lattice([b"aba"], hashes, order)
    p = np.array([0.4, 0.3, 0.2, 0.1])
    assert lattice.forward(p[:, None])[0, 3, 0] == pytest.approx(0.4 * 0.3 * 0.4 + 0.2 * 0.4 + 0.4 * 0.1, rel=1e-5)
    assert lattice.backward(p)[0, 0] == pytest.approx(lattice.forward(p[:, None])[0, 3, 0])


def test_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    model = neighbours.fit(vectors)
    found = neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), model).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.embedding}
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = neighbours.distances(data[q], x)
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        own = [r for r in found if r.query_id == q]
        assert [r.rank for r in sorted(own, key=lambda r: r.rank)] == list(range(1, 11))
        hits += len(best & {r.vec_id for r in own})
        total += 10
    assert hits / total >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None])]
    rows += [(5, [1.0, 2.5]), (6, [1.0, 2.5]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(vectors, vectors.where("vec_id = 0"), neighbours.fit(vectors))
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 5, 0.5), (0, 2, 6, 0.5)]
    none = vectors.limit(0)
    assert neighbours.nearest(none, none, neighbours.fit(none)).collect() == []


def test_within_finds_every_code_in_the_radius():
    codes = np.random.default_rng(0).integers(0, 256, (500, 8), dtype=np.uint8)
    index, whole = neighbours.Index(codes), codes.view(np.uint64).ravel()
    for r in (0, 7, 20, 31, 64):
        want = np.flatnonzero(np.bitwise_count(whole ^ whole[3]) <= r)
        assert index.within(codes[3], r).tolist() == want.tolist()


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I sort?\n\nPlease help."),
        (1, 1, "assistant", "Use the sort function."),
        (1, 2, "user", "On Monday, A wrote:\n> how do  I SORT?\n\nI meant this."),
        (1, 3, "assistant", "> > How do I sort?\n>\n> I meant this.\nSee the manual."),
        (1, 4, "user", None),
        (2, 0, "user", "> Use the sort function."),
        (None, 0, "user", "> a"),
        (2, None, "user", ""),
    ]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotations.order_conversations(messages).collect()}
    assert found[1, 2].own_text == "I meant this." and found[1, 2].reply_to == 0
    assert found[1, 3].own_text == "See the manual." and found[1, 3].reply_to == 2
    assert (found[1, 3].n_quotes, found[1, 3].n_linked) == (2, 2)
    assert found[1, 4].reply_to == 3 and found[1, 1].reply_to == 0
    assert found[2, 0].n_linked == 0 and found[2, 0].reply_to is None
    assert len(found) == len(rows)


def test_quotes_of_parts_of_a_paragraph(spark):
    rows = [
        (1, 0, "user", "First we measure. Then we\ncut the board twice. Last we glue it."),
        (1, 1, "assistant", "Glue it."),
        (1, 2, "user", "> then we cut  the board twice.\nWhy twice?"),
        (1, 3, "user", "> First we measure. Then we\nHow?\n> cut the board twice. Last we glue it.\nWith what?"),
        (1, 4, "user", "> glue it.\nThe whole message counts first."),
        (1, 5, "user", "> we cut board\nNot a run."),
        (1, 6, "user", "> cut the board twice. Last we glue it. And\nToo long."),
        (1, 7, "user", "> said later\nNothing before."),
        (1, 8, "user", "This was said later on."),
        (2, 0, "user", "Another."),
        (2, 1, "user", "> First we measure.\nElsewhere."),
    ]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {(r.conv_id, r.turn): r for r in quotations.order_conversations(messages).collect()}
    linked = {k: (r.n_quotes, r.n_linked, r.reply_to) for k, r in found.items()}
    assert linked[1, 2] == (1, 1, 0) and linked[1, 3] == (2, 2, 0) and linked[1, 4] == (1, 1, 1)
    assert linked[1, 5] == (1, 0, 4) and linked[1, 6] == (1, 0, 5) and linked[1, 7] == (1, 0, 6)
    assert linked[2, 1] == (1, 0, 0)
    assert [r.turn for k, r in sorted(found.items(), key=lambda x: x[1].position) if k[0] == 1][:2] == [0, 1]


def reply_order(replies):
    """Turns, each followed by those that reply to it."""
    found, todo = [], [0]
    while todo:
        found.append(todo.pop())
        todo += sorted((t for t, to in replies.items() if to == found[-1]), reverse=True)
    return found


def test_messages_follow_what_they_reply_to(spark):
    random.seed(3)
    answers = {0: {2: 0, 3: 1, 4: 2}, 1: {}, 2: {t: t - 2 for t in range(2, 40)}, 3: {t: 0 for t in range(1, 9)}}
    answers |= {c: {t: random.randrange(t) for t in range(1, 30) if random.random() < 0.6} for c in range(4, 12)}
    rows, want = [], []
    for conv, links in answers.items():
        n = max(links, default=4) + 1
        said = [f"words of message {t}" for t in range(n)]
        for t in range(n):
            text = f"> {said[links[t]]}\n{said[t]}" if t in links else said[t]
            rows.append((conv, t, "user", text))
        want += [(conv, t) for t in reply_order({t: links.get(t, t - 1) for t in range(1, n)})]
    rows.append((None, 0, "user", "alone"))
    random.shuffle(rows)
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = quotations.order_conversations(messages).where("conv_id IS NOT NULL")
    rows = found.orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.turn) for r in rows] == want
    assert [r.turn for r in rows if r.conv_id == 0] == [0, 1, 3, 2, 4]
    assert all(a.position + 1 == b.position for a, b in zip(rows, rows[1:]) if a.conv_id == b.conv_id)


def test_word_hashes_agree_with_bytes():
    import pyarrow as pa

    hashes, first = text.word_hashes(pa.array(["ab CD", None, "", "cd ab"]), text.NOT_BLANK)
    assert first.tolist() == [0, 2, 2, 2, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[0] != hashes[1]


def test_pipeline(spark, small):
    docs = small("documents")
    out = corpus_pipeline.run(spark, SMALL)
    kept = {r.doc_id for r in out.collect()}
    assert 0 < len(kept) < docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before.columns
    texts = dict(pairs(docs))
    assert set(texts) == kept
    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert len({c for _, _, c in brute.linked(list(texts.items()))}) == len(texts)


def test_held_out_rule_is_crc32(spark):
    row = spark.range(17, 18, 1, 1).select(crc_mod("id", 5).alias("r")).first()
    assert row.r == zlib.crc32(b"17") % 5
