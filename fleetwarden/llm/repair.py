"""Cheapest repair of damaged conversations, with one definite list of edits.

A repaired conversation has the roles ``(s?(ua)+)?``, by their first letters: an optional
system message, then user and assistant in turn. Each message is kept (K, 0), given the role
user or assistant (R, 2) or deleted (D, 3; blank and duplicate ones must be), and an empty user
or assistant message may be inserted anywhere (I, 2); a truncated message that stays adds 1.
Of the cheapest lists of edits the one whose letters are least in ASCII order is taken.

The choice is one minimum over integers. A path through messages and grammar states weighs its
cost in the high digits and its letters below them, each in the digit of its place in the list,
so that a list that ended has zeros there; the least integer is the cheapest list and the first
in ASCII order at once, and its low digits are the list. Two inserts in one gap can't be cheap
(the message before them could be left out, or both), so a gap has one at most.

Conversations of any size: messages are dealt into ranges of (conversation, turn, ...), so a
large one lies in many partitions. Within a partition the integers are those of CHUNK messages
at a time; what follows a chunk is known by its cost for each of the four states, found from
the end. Between chunks no list is the beginning of another one, as a list of a chunk ends with
its last message, so choosing chunk by chunk is exact. A partition tells the driver of the
conversations at its two ends only: sixteen costs and their order. That is two rows a partition,
whatever the rows are.

Defined results: messages are taken by turn (null first), then role, then the md5 of the text;
a null role or text is one space; a null conv_id is a conversation; equal rows are duplicates
but for the first; other columns are left out, whatever their names; an empty table gives an
empty one; texts of any length are passed through whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm.frames import cut

#: Messages whose edits one integer decides.
CHUNK = 16
#: Bytes of repaired text that a task hands on at once.
PIECE = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"

#: Digits of the letters; zero is "no more letters".
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
BITS = 3
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The one role that can come next in each state, besides system in the first.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
#: Cost of ending in each state; after a user message one more insert is needed.
END = (0, NEVER, 2, 0)
LEGAL = {"su", "ua", "au"}
#: A message is one sign: s, u, a or o for its role's first letter, a capital if it is
#: truncated, x if it must go.
GONE = "x"


def _edges(state: int, sign: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that a message allows."""
    edges = [("D", 3, state)]
    if sign != GONE:
        late = int(sign.isupper())
        sign = sign.lower()
        if sign == "s" and state == START:
            edges.append(("K", late, SYSTEM))
        elif sign == NEXT_ROLE[state][0]:
            edges.append(("K", late, NEXT_STATE[state]))
        edges.append(("R", 2 + late, NEXT_STATE[state]))
    return edges


EDGES = {(q, sign): _edges(q, sign) for q in STATES for sign in "suaoSUAO" + GONE}


@lru_cache(1 << 16)
def costs_before(signs: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost from each state through these messages, given that of what follows."""
    for sign in reversed(signs):
        straight = [min(c + after[to] for _, c, to in EDGES[q, sign]) for q in STATES]
        after = tuple(min(straight[q], 2 + straight[NEXT_STATE[q]], NEVER) for q in STATES)
    return after


@lru_cache(1 << 16)
def cheapest(signs: str, state: int, after: tuple[int, ...], last: bool) -> str:
    """The letters of the least integer over all lists of edits of at most CHUNK messages.

    ``after`` is the cost of what follows by state; only the last messages of a conversation
    may have an insert after them.
    """
    width = 2 * len(signs) + 1
    unit = 1 << BITS * width
    place = [1 << BITS * (width - 1 - p) for p in range(width)]
    least = {(0, state): 0}  # (letters so far, state) -> weight
    for sign in signs:
        then: dict[tuple[int, int], int] = {}
        for (p, q), weight in least.items():
            inserted = weight + 2 * unit + DIGIT["I"] * place[p]
            for at, here, so_far in ((p, q, weight), (p + 1, NEXT_STATE[q], inserted)):
                for letter, cost, to in EDGES[here, sign]:
                    total = so_far + cost * unit + DIGIT[letter] * place[at]
                    node = (at + 1, to)
                    if total < then.get(node, total + 1):
                        then[node] = total
        least = then
    ends = []
    for (p, q), weight in least.items():
        if last and q == USER:
            ends.append(weight + 2 * unit + DIGIT["I"] * place[p])
        elif after[q] < NEVER:
            ends.append(weight + after[q] * unit)
    code = min(ends) % unit
    digits = [code // x % (1 << BITS) for x in place]
    return "".join(LETTER[d] for d in digits if d)


def follow(letters: str, signs: str, state: int) -> tuple[list[int], int]:
    """The states after each letter's edit, and the last one."""
    states, at = [], 0
    for letter in letters:
        if letter == "I":
            state = NEXT_STATE[state]
        else:
            state = next(to for x, _, to in EDGES[state, signs[at]] if x == letter)
            at += 1
        states.append(state)
    return states, state


def solve(signs: str, state: int, after: tuple[int, ...], last: bool) -> str:
    """``cheapest`` for any number of messages, chunk after chunk."""
    chunks = [signs[i : i + CHUNK] for i in range(0, len(signs), CHUNK)] or [""]
    behind = [after]
    for chunk in reversed(chunks[1:]):
        behind.append(costs_before(chunk, behind[-1]))
    letters = []
    for k, chunk in enumerate(chunks):
        letters.append(cheapest(chunk, state, behind[-1 - k], last and k + 1 == len(chunks)))
        _, state = follow(letters[-1], chunk, state)
    return "".join(letters)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if q == state else NEVER for q in STATES)


def _ways(signs: str) -> tuple[list[list[int]], list[list[int]]]:
    """From each state to each: the least cost, and the order of the lists' letters."""
    costs, ranks = [], []
    for entry in STATES:
        row, lists = [], []
        for end in STATES:
            cost = _through(signs, _only(end))[entry]
            row.append(cost)
            lists.append(solve(signs, entry, _only(end), False) if cost < NEVER else "Z")
        costs.append(row)
        ranks.append([sorted(lists).index(x) for x in lists])
    return costs, ranks


def _through(signs: str, after: tuple[int, ...]) -> tuple[int, ...]:
    for start in reversed(range(0, len(signs), CHUNK)):
        after = costs_before(signs[start : start + CHUNK], after)
    return after


def _segments(batches: Iterator[pa.RecordBatch], kinds: list | None = None) -> Iterator[list[dict]]:
    """The rows of one conversation after another, as far as this partition holds them.

    ``kinds`` is given the type of conv_id.
    """
    rows: list[dict] = []
    for batch in batches:
        if kinds is not None:
            kinds[:] = [batch.schema.field("conv_id").type]
        for row in batch.to_pylist():
            if rows and row["conv_id"] != rows[0]["conv_id"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _signs(rows: list[dict]) -> str:
    """The signs of rows, each with all its copies."""
    signs = []
    for row in rows:
        if row["copies"]:
            initial = row["role"][:1]
            sign = initial if initial in ("s", "u", "a") else "o"
            if row["fault"] == "truncated":
                sign = sign.upper()
            signs.append(GONE if row["fault"] in ("blank", "duplicate") else sign)
            signs.append(GONE * (row["copies"] - 1))
    return "".join(signs)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the conversations at the two ends of this partition: what ``_chains`` needs."""
    first = last = None
    kinds: list[pa.DataType] = []
    for rows in _segments(batches, kinds):
        if first is None:
            first = rows
        last = rows
    found = []
    for order, rows in enumerate([first, last] if first is not last else [first]):
        if rows is not None:
            costs, ranks = _ways(_signs(rows))
            initials = [r["role"][:1] for r in rows if r["copies"]]
            found.append(
                {
                    "part": TaskContext.get().partitionId(),
                    "order": order,
                    "conv_id": rows[0]["conv_id"],
                    "costs": costs,
                    "ranks": ranks,
                    "initial": initials[-1] if initials else None,
                }
            )
    if found:
        table = pa.list_(pa.list_(pa.int64()))
        types = [pa.int32(), pa.int32(), *kinds, table, table, pa.string()]
        yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip(found[0], types))))


def _chains(ends: list) -> dict[tuple[int, int], dict]:
    """For each end of a partition: the state its conversation enters it in, what follows it
    costs, whether more of it lies before or behind, and the first letter of the role before."""
    ends = sorted(ends, key=lambda e: (e["part"], e["order"]))
    found, start = {}, 0
    while start < len(ends):
        stop = start + 1
        while stop < len(ends) and ends[stop]["conv_id"] == ends[start]["conv_id"]:
            stop += 1
        chain, after = ends[start:stop], [END]
        for e in reversed(chain[1:]):
            after.append(tuple(min(min(c + a for c, a in zip(row, after[-1])), NEVER) for row in e["costs"]))
        state, initial = START, None
        for k, e in enumerate(chain):
            behind = after[-1 - k]
            found[e["part"], e["order"]] = {
                "state": state,
                "after": behind,
                "last": k + 1 == len(chain),
                "whole": len(chain) == 1,
                "initial": initial,
            }
            state = min(STATES, key=lambda q: (e["costs"][state][q] + behind[q], e["ranks"][state][q]))
            initial = e["initial"] if e["initial"] is not None else initial
        start = stop
    return found


ALONE = {"state": START, "after": END, "last": True, "whole": True, "initial": None}
EDIT_COLUMNS = (
    "whole boolean, part int, step bigint, turn bigint, role string, text string, fault string, "
    "illegal boolean, edit string, new_role string, cost int"
)


def _edit_rows(rows: list[dict], known: dict) -> Iterator[tuple]:
    """(turn, role, text, fault, illegal, edit, new role, cost) of each edit, in order."""
    signs = _signs(rows)
    letters = solve(signs, known["state"], known["after"], known["last"])
    states, _ = follow(letters, signs, known["state"])
    before, at = known["initial"], 0

    def inserts():
        nonlocal at
        while at < len(letters) and letters[at] == "I":
            yield None, None, None, None, False, "I", NEXT_ROLE[states[at - 1] if at else known["state"]], 2
            at += 1

    for row in rows:
        turn, role, words, fault = row["turn"], row["role"], row["text"], row["fault"]
        if not row["copies"]:
            yield None, None, None, None, False, None, None, 0
        for copy in range(row["copies"]):
            yield from inserts()
            if copy and fault != "blank":
                fault = "duplicate"
            initial = role[:1]
            illegal = before is not None and before + initial not in LEGAL
            letter, state = letters[at], states[at - 1] if at else known["state"]
            new_role = {"D": None, "K": role, "R": NEXT_ROLE[state]}[letter]
            cost = 3 if letter == "D" else 2 * (letter == "R") + (fault == "truncated")
            yield turn, role, words, fault, illegal, letter, new_role, cost
            before, at = initial, at + 1
    yield from inserts()


def in_order(messages: DataFrame, copies: str | None = None) -> DataFrame:
    """Distinct messages with ``fault`` and ``copies``, in sorted ranges, written once.

    A message is a duplicate where its role and text were said in an earlier turn; of the
    copies of one row all but the first are duplicates too.
    """
    say = lambda c: F.coalesce(F.col(c), F.lit(" "))
    n = F.lit(1) if copies is None else F.col(copies)
    rows = (
        messages.select(
            "conv_id",
            F.when(n > 0, F.col("turn")).cast("bigint").alias("turn"),
            F.when(n > 0, say("role")).otherwise("").alias("role"),
            F.when(n > 0, say("text")).otherwise("").alias("text"),
            n.cast("bigint").alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("digest", F.md5("text"))
        .withColumn("moment", F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0))))
    )
    said_again = (
        rows.where("copies > 0")
        .groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min("moment").alias("earliest"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(F.col("copies") == 0, None)
        .when(end == "", "blank")
        .when(F.col("moment") > F.col("earliest"), "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    marked = rows.join(said_again, same, "left").withColumn("fault", fault)
    kept = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(kept.select("conv_id", "turn", "role", "text", "fault", "copies"))


def repair(messages: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each edit of each conversation (conv_id, turn, role, text), in order.

    ``edit`` is K, R, D or I, ``new_role`` the role after it (null if deleted), ``cost`` what
    it costs, ``fault`` blank, duplicate, truncated or null, ``illegal`` whether the roles of
    the message and the one before it, as given, can't follow each other. ``part`` and ``step``
    order the rows; ``whole`` says that one partition holds the conversation. Inserted messages
    have neither turn nor text. ``copies`` names a column that says how often a row counts; a
    conversation of rows that count 0 times keeps a row with a null edit.

    Two jobs run here, while the DataFrame is built: one writes the messages in order, one
    reads the ends of their partitions.
    """
    ordered = in_order(messages, copies)
    kind = messages.schema["conv_id"].dataType.simpleString()
    ends = ordered.mapInArrow(
        _ends,
        f"part int, `order` int, conv_id {kind}, costs array<array<bigint>>, ranks array<array<bigint>>, initial string",
    )
    known = _chains([r.asDict() for r in ends.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step, waiting = TaskContext.get().partitionId(), 0, None
        types = _arrow_types(kind)

        def give(rows, info):
            nonlocal step
            columns = [list(x) for x in zip(*_edit_rows(rows, info))]
            n = len(columns[0])
            lead = [[rows[0]["conv_id"]] * n, [info["whole"]] * n, [part] * n, range(step, step + n)]
            step += n
            arrays = [pa.array(list(x), t.type) for x, t in zip([*lead, *columns], types)]
            return pa.RecordBatch.from_arrays(arrays, schema=types)

        for k, rows in enumerate(_segments(batches)):
            if waiting is not None:
                yield give(waiting, known[part, 0] if k == 1 else ALONE)
            waiting, count = rows, k
        if waiting is not None:
            yield give(waiting, known[part, 1 if count else 0])

    return ordered.mapInArrow(run, f"conv_id {kind}, {EDIT_COLUMNS}")


def _arrow_types(kind: str) -> pa.Schema:
    names = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "smallint": pa.int16(), "tinyint": pa.int8()}
    fields = [("conv_id", kind), *[x.split() for x in EDIT_COLUMNS.split(", ")]]
    return pa.schema([(n, names[k]) for n, k in fields])


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def report(edits: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, gaps, cost, edits and repaired text's digest.

    Takes the rows of ``repair`` as they are dealt there. ``gaps`` is the number of turns
    missing between the first and last; ``audit`` the letters of the edits; ``repaired_sha256``
    that of the repaired ``role:text`` lines. A conversation within one partition is done there.
    The others are small totals and pieces of text, which one task for each conversation takes
    in order, a piece at a time: a digest of one long text has no parallel form, but it takes no
    memory. The partial reports are written when the DataFrame is built.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    schema = (
        f"conv_id {kind}, whole boolean, part int, step bigint, low bigint, high bigint, turns bigint, "
        f"{counts}, audit string, repaired binary, repaired_sha256 string"
    )
    found = cut(edits.mapInArrow(_partial_reports, schema))
    joined = (
        found.where("NOT whole")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "step")
        .mapInArrow(_joined_reports, schema)
    )
    both = found.where("whole").unionByName(joined)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return both.select(
        "conv_id",
        gaps.cast("bigint").alias("gaps"),
        *COUNTS,
        "audit",
        "repaired_sha256",
    )


def _new_report(row: dict) -> dict:
    start = {"low": None, "high": None, "turns": 0, "audit": [], "lines": 0}
    return {"conv_id": row["conv_id"], "whole": row["whole"], "part": row["part"], **start, **dict.fromkeys(COUNTS, 0)}


def _partial_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations done; of the others the repaired text in pieces, then the totals."""
    state, text, digest = None, [], None

    def piece(step):
        return _row(state, step, repaired=b"".join(text))

    def close(step):
        if state["whole"]:
            digest.update(b"".join(text))
            yield _row(state, step, sha=digest.hexdigest(), totals=True)
        else:
            if text:
                yield piece(step)
            yield _row(state, step + 1, totals=True)

    size = 0
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != state["conv_id"]:
                if state is not None:
                    out += close(last)
                state, text, digest, size = _new_report(row), [], hashlib.sha256(), 0
            # Twice the step leaves a number for the totals behind the last piece.
            last = 2 * row["step"]
            if row["edit"] is None:
                continue
            state["audit"].append(row["edit"])
            state["cost"] += row["cost"]
            state["illegal"] += row["illegal"]
            if row["fault"]:
                state[row["fault"]] += 1
            if row["turn"] is not None and row["turn"] != state["high"]:
                state["high"] = row["turn"]
                state["turns"] += 1
                if state["low"] is None:
                    state["low"] = row["turn"]
            if row["new_role"] is not None:
                line = f"{row['new_role']}:{row['text'] or ''}".encode()
                text.append(b"\n" + line if state["lines"] else line)
                state["lines"] += 1
                size += len(line)
                if size > PIECE:
                    if state["whole"]:
                        digest.update(b"".join(text))
                    else:
                        out.append(piece(last))
                    text, size = [], 0
        if out:
            yield _batch(out, kind)
    if state is not None:
        yield _batch(list(close(last)), kind)


def _row(state: dict, step: int, sha=None, repaired=None, totals=False) -> dict:
    own = {k: state[k] for k in ("conv_id", "whole", "part", "low", "high", "turns", *COUNTS)}
    return {**own, "step": step, "audit": "".join(state["audit"]) if totals else None,
            "repaired": repaired, "repaired_sha256": sha}


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    ints = ["step", "low", "high", "turns", *COUNTS]
    columns = {
        "conv_id": pa.array([r["conv_id"] for r in rows], kind),
        "whole": pa.array([r["whole"] for r in rows], pa.bool_()),
        "part": pa.array([r["part"] for r in rows], pa.int32()),
        **{c: pa.array([r[c] for r in rows], pa.int64()) for c in ints},
        "audit": pa.array([r["audit"] for r in rows], pa.string()),
        "repaired": pa.array([r["repaired"] for r in rows], pa.binary()),
        "repaired_sha256": pa.array([r["repaired_sha256"] for r in rows], pa.string()),
    }
    names = ["conv_id", "whole", "part", "step", "low", "high", "turns", *COUNTS, "audit", "repaired", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _joined_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of conversations, in order, as one row for each conversation."""
    state, digest, empty, said = None, None, True, False
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != state["conv_id"]:
                if state is not None:
                    out.append(_row(state, 0, sha=digest.hexdigest(), totals=True))
                state, digest, empty, said = _new_report(row), hashlib.sha256(), True, False
            if row["repaired"] is not None:
                # The first piece of each part begins without a line break.
                if not empty and not said:
                    digest.update(b"\n")
                digest.update(row["repaired"])
                empty, said = False, True
                continue
            said = False
            state["audit"].append(row["audit"])
            for c in COUNTS:
                state[c] += row[c]
            if row["low"] is not None:
                state["turns"] += row["turns"] - (row["low"] == state["high"])
                state["high"] = row["high"]
                state["low"] = row["low"] if state["low"] is None else state["low"]
        if out:
            yield _batch(out, kind)
    if state is not None:
        yield _batch([_row(state, 0, sha=digest.hexdigest(), totals=True)], kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text, copies) with faults, dealt by a hash of the turn.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a message (its copies are 0), 1 empties its
    text, 2 takes ``[.!?]`` out of it, 3 doubles it, 4 gives it the role user. Nulls count as
    one space.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn"))) % 20
    words: Column = as_text("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(as_text("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )
