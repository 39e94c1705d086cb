"""Conversations from messages that quote one another.

A message's lines are parsed into its own text and quoted passages with their level (the number
of leading ``>`` marks). A passage and a message's own paragraphs are normalised (lower case,
blanks joined) and hashed; equal hashes of one conversation link the passage to the earliest
message that holds it, if that is before the quoting one. A passage that equals no text or
paragraph is looked for as a run of consecutive words of the own texts, whatever lines they are in,
so that parts of a paragraph and quotes cut up by replies are linked as well. A message replies to the latest
message that its outermost quotes link to; without a link, to the message before it. The
conversation is then ordered along these replies: after each message come, in the order of their
turns, the messages that reply to it, each with all that follows from it, without quotes.

Runs are hashed in the lengths that the passages of their conversation have, and only where there
are any. Each (conversation, hash) is reduced to its earliest holder before the join, so that a passage
which all messages share makes one row for each quote, and a large conversation is sorted by
Spark, never gathered. Messages that each reply to the one before stay together as one thread;
the threads of a conversation are entered and left along a list, which is ranked by pointer
doubling, so that neither long nor deep conversations need paths or many rounds.

Defined results: a null text is empty; a null conversation or turn is never linked and replies
to nothing; rows of one conversation and turn are both kept, ordered by role and text; columns
named like the output's are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import cut, ddl, without

MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$", re.DOTALL)
#: The line that mail programs put before a quote.
INTRODUCTION = re.compile(r"^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)
ADDED = (
    "own_text string, own_hashes array<bigint>, quotes array<struct<level:int,hash:bigint,words:int,run:bigint>>"
)


def normal_hash(lines: list[str]) -> int | None:
    """The hash of a passage without regard to case and blanks; none if it is blank."""
    words = " ".join(lines).lower().split()
    if not words:
        return None
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) - 2**63


def run_hashes(message: str, lengths: list[int]) -> np.ndarray:
    """The distinct hashes of all runs of so many words, without regard to case and blanks."""
    data = np.frombuffer(" ".join(message.lower().split()).encode(), np.uint8)
    starts, ends, _ = text.words(data, np.array([0, len(data)]), text.NOT_BLANK)
    sums = text.prefix_hashes(data)
    runs = [text.span_hashes(sums, starts[: len(starts) - n + 1], ends[n - 1 :]) for n in lengths if n <= len(starts)]
    return np.unique(np.concatenate([np.empty(0, np.uint64), *runs])).view(np.int64)


def parse(message: str) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """Own text, hashes of it and of its paragraphs, and of each quoted passage the level, the
    hash, the number of words and their hash as a run."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in message.split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        if level == 0:
            own.append(line)
        elif level == level_before and found[2].strip():
            passages[-1][1].append(found[2])
        elif found[2].strip():
            if level_before == 0:
                while own and (not own[-1].strip() or INTRODUCTION.match(own[-1])):
                    own.pop()
            passages.append((level, [found[2]]))
        level_before = level if level == 0 or found[2].strip() else 0
    paragraphs: list[list[str]] = [[]]
    for line in own:
        paragraphs[-1].append(line) if line.strip() else paragraphs.append([])
    hashes = {normal_hash(own), *map(normal_hash, paragraphs)} - {None}
    quotes = []
    for level, lines in passages:
        n = len(" ".join(lines).lower().split())
        quotes.append((level, normal_hash(lines), n, int(run_hashes(" ".join(lines), [n])[0])))
    return "\n".join(own).strip("\n"), sorted(hashes), quotes


def parse_messages(messages: DataFrame) -> DataFrame:
    """The messages with own_text, own_hashes and quotes."""
    messages = without(messages, ["own_text", "own_hashes", "quotes"])
    names = ("level", "hash", "words", "run")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
    quote = pa.list_(pa.struct(list(zip(names, kinds))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x or "") for x in batch.column("text").to_pylist()]
            rows = pa.Table.from_batches([batch])
            rows = rows.append_column("own_text", pa.array([f[0] for f in found], pa.string()))
            rows = rows.append_column("own_hashes", pa.array([f[1] for f in found], pa.list_(pa.int64())))
            quotes = [[dict(zip(names, q)) for q in f[2]] for f in found]
            rows = rows.append_column("quotes", pa.array(quotes, quote))
            yield from rows.to_batches()

    return messages.mapInArrow(run, ddl(messages, ADDED))


def _first_runs(parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, run and the first message that holds it, for runs as long as quoted passages."""
    lengths = quoted.groupBy("conv_id").agg(F.collect_set("words").alias("lengths"))
    texts = parsed.where("turn IS NOT NULL").select("conv_id", "turn", "rank", "own_text").join(lengths, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column("own_text").to_pylist(), batch.column("lengths").to_pylist()
            for k, (own, sizes) in enumerate(zip(texts, lengths)):
                hashes = run_hashes(own, sizes)
                at = pa.array(np.full(len(hashes), k))
                columns = [batch.column(n).take(at) for n in ("conv_id", "turn", "rank")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes)], ["conv_id", "turn", "rank", "run"])

    runs = texts.mapInArrow(run, ddl(texts.select("conv_id", "turn", "rank"), "run bigint"))
    return runs.groupBy("conv_id", "run").agg(F.min(F.struct("turn", "rank")).alias("from"))


def thread_offsets(threads: DataFrame) -> DataFrame:
    """conv_id, head and how many messages of the conversation come before the thread.

    ``threads`` has conv_id, head (its first message), size, and the thread ``up`` with the message
    ``to`` in it that the head replies to. Threads come after the whole of the one they hang on,
    those that hang further down first.
    """
    siblings = Window.partitionBy("conv_id", "up").orderBy(F.desc("to"), "head")
    inside = threads.withColumn("beside", F.lead("head").over(siblings))
    inside = cut(inside.withColumn("n", F.row_number().over(siblings)))
    most = inside.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    below = inside.where("n = 1 AND up IS NOT NULL")
    below = below.select("conv_id", F.col("up").alias("head"), F.col("head").alias("below"))
    found = inside.join(below, ["conv_id", "head"], "left")
    entered = F.struct(
        (2 * F.col("head")).alias("node"),
        F.coalesce(2 * F.col("below"), 2 * F.col("head") + 1).alias("next"),
        F.col("size").alias("left"),
    )
    done = F.struct(
        (2 * F.col("head") + 1).alias("node"),
        F.coalesce(2 * F.col("beside"), 2 * F.col("up") + 1).alias("next"),
        F.lit(0).cast("bigint").alias("left"),
    )
    places = found.select("conv_id", F.explode(F.array(entered, done)).alias("p")).select("conv_id", "p.*")
    for _ in range((2 * most).bit_length()):
        places = cut(places)
        then = places.selectExpr("conv_id", "node AS next", "next AS after", "left AS more")
        places = places.join(then, ["conv_id", "next"], "left")
        places = places.selectExpr("conv_id", "node", "after AS next", "left + coalesce(more, 0) AS left")
    heads = places.where("node % 2 = 0").select("conv_id", (F.col("node") / 2).cast("bigint").alias("head"), "left")
    total = threads.groupBy("conv_id").agg(F.sum("size").alias("total"))
    return heads.join(total, "conv_id").select("conv_id", "head", (F.col("total") - F.col("left")).alias("offset"))


def _positions(messages: DataFrame, branches: DataFrame) -> DataFrame:
    """conv_id, rank and position of the messages in conversations with branches.

    ``messages`` has conv_id and rank (the order of turns); ``branches`` those that reply to another
    message (``to``, a rank) than the one before.
    """
    so_far = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    found = messages.join(branches.select("conv_id").distinct(), "conv_id", "left_semi")
    found = found.join(branches, ["conv_id", "rank"], "left")
    head = F.max(F.when(F.col("to").isNotNull(), F.col("rank"))).over(so_far)
    found = cut(found.withColumn("head", F.coalesce(head, F.lit(1).cast("bigint"))))
    sizes = found.groupBy("conv_id", "head").agg(F.count("*").alias("size"))
    holders = found.select("conv_id", F.col("rank").alias("to"), F.col("head").alias("up"))
    hung = branches.withColumnRenamed("rank", "head").join(holders, ["conv_id", "to"])
    offsets = thread_offsets(cut(sizes.join(hung, ["conv_id", "head"], "left")))
    position = F.col("offset") + F.col("rank") - F.col("head") + 1
    return found.join(offsets, ["conv_id", "head"]).select("conv_id", "rank", position.alias("position"))


def order_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, own_text, reply_to (a turn), n_quotes and n_linked."""
    parsed = parse_messages(messages.select("conv_id", "turn", "role", "text"))
    parsed = parsed.withColumn("row", F.monotonically_increasing_id())
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "row")
    parsed = parsed.withColumn("before", F.lag("turn").over(order))
    parsed = cut(parsed.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("text"))
    own = parsed.where("turn IS NOT NULL").select("conv_id", "turn", "rank", F.explode("own_hashes").alias("hash"))
    holder = own.groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "rank")).alias("from"))
    quoted = parsed.select("row", "conv_id", "turn", "rank", F.posexplode("quotes").alias("at", "quote"))
    quoted = quoted.select("row", "conv_id", "turn", "rank", "quote.*").join(holder, ["conv_id", "hash"], "left")
    quoted = cut(quoted.withColumn("from", F.when(F.col("from.turn") < F.col("turn"), F.col("from"))))
    parts = quoted.where("from IS NULL AND turn IS NOT NULL").drop("from")
    parts = parts.join(_first_runs(parsed, parts), ["conv_id", "run"]).where("from.turn < turn")
    linked = quoted.where("from IS NOT NULL").unionByName(parts.select(quoted.columns))
    replies = linked.groupBy("row", "conv_id", "rank").agg(
        F.count("*").alias("n_linked"), F.max_by("from", F.struct(-F.col("level"), "from")).alias("linked_to")
    )
    replies = cut(replies)
    found = parsed.join(replies.drop("conv_id", "rank"), "row", "left")
    branches = replies.select("conv_id", "rank", F.col("linked_to.rank").alias("to")).where("to <> rank - 1")
    if branches.isEmpty():
        found = found.withColumn("position", F.col("rank"))
    else:
        moved = _positions(parsed.select("conv_id", "rank"), branches)
        found = found.join(moved.withColumnRenamed("position", "moved"), ["conv_id", "rank"], "left")
        found = found.withColumn("position", F.coalesce("moved", "rank"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return found.select(
        "conv_id",
        "position",
        "turn",
        "role",
        "own_text",
        F.when(known, F.coalesce("linked_to.turn", "before")).alias("reply_to"),
        F.size("quotes").cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )
