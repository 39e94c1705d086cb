"""DuckDB SQL of the queries that use crc32, which DuckDB has no function for."""

#: A row with the 256 remainders of the reflected polynomial 0xEDB88320, as a list.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
)"""


def crc32(key: str) -> str:
    """crc32 of a text of ASCII signs, in a query that also reads crc_table."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, b: xor(r >> 8, crc[1 + CAST(xor(r & 255, b) AS INTEGER)])))"""


OP11_SQL = rf"""
WITH {CRC_TABLE}, hashed AS (
  SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents, crc_table
), shaped AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AS planted, 3 + (h // 10) % 8 AS parts,
    (h // 10) % greatest(len(w), 1) AS a
  FROM hashed
), words AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN planted THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END) AS word
  FROM shaped WHERE n > 0
), matches AS (
  SELECT y.doc_id, y.i - x.i AS q, y.i AS i
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
  WHERE 3 * (y.i - x.i) <= y.n
), stretches AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_runs
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words
  WHERE NOT EXISTS (
    SELECT 1 FROM runs r
    WHERE r.doc_id = words.doc_id AND words.i >= r.start + r.period AND words.i < r.start + r.length)
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
  1000 * length // period AS exponent_milli, sha256(coalesce(all_runs, '')) AS runs_sha256,
  sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Walks each conversation from its end. In front of a message, m0 to m3 are the cheapest
#: (cost, letters, repaired lines) from each grammar state: nothing yet, after system, after
#: user, after assistant. 1000 stands for "can't be".
_NEXT = {0: ("u", "user", 2), 1: ("u", "user", 2), 2: ("a", "assistant", 3), 3: ("u", "user", 2)}


def _way(cost: str, letter: str, line: str, state: int) -> str:
    return (
        f"struct_pack(cost := {cost} + m{state}.cost, audit := '{letter}' || m{state}.audit, "
        f"lines := list_concat({line}, m{state}.lines))"
    )


def _straight(state: int) -> str:
    """The cheapest from a state where a message comes next: delete, change the role or keep."""
    initial, role, after = _NEXT[state]
    late = "truncated"
    changed = _way(f"2 + {late}", "R", f"['{role}:' || text]", after)
    kept = _way(late, "K", "[role || ':' || text]", after)
    ways = [
        _way("3", "D", "CAST([] AS VARCHAR[])", state),
        f"CASE WHEN NOT gone THEN {changed} END",
        f"CASE WHEN NOT gone AND initial = '{initial}' THEN {kept} END",
    ]
    if state == 0:
        system = _way(late, "K", "[role || ':' || text]", 1)
        ways.append(f"CASE WHEN NOT gone AND initial = 's' THEN {system} END")
    return f"list_min([{', '.join(ways)}])"


def _with_insert(state: int) -> str:
    _, role, after = _NEXT[state]
    inserted = (
        f"struct_pack(cost := 2 + s{after}.cost, audit := 'I' || s{after}.audit, "
        f"lines := list_prepend('{role}:', s{after}.lines))"
    )
    return f"least(s{state}, {inserted}) AS m{state}"


_EMPTY = "struct_pack(cost := {0}, audit := '{1}', lines := CAST([{2}] AS VARCHAR[]))"
_LATE = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc_table
), rows_after AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS copy(c) WHERE k <> 0 AND (c = 0 OR k = 3)
), placed AS (
  SELECT *, left(role, 1) AS initial, {_LATE} AS trimmed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place
  FROM rows_after
), faulty AS (
  SELECT *, trimmed = '' AS is_blank,
    trimmed <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS is_duplicate,
    right(trimmed, 1) NOT IN ('.', '!', '?') AS is_open,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS is_illegal
  FROM placed
), messages AS (
  SELECT conv_id, place, role, text, initial, is_blank OR is_duplicate AS gone,
    CAST(NOT is_blank AND NOT is_duplicate AND is_open AS BIGINT) AS truncated
  FROM faulty
), walked AS (
  SELECT conv_id, 1 + max(place) AS place, {_EMPTY.format("CAST(0 AS BIGINT)", "", "")} AS m0,
    {_EMPTY.format("CAST(1000000 AS BIGINT)", "", "")} AS m1,
    {_EMPTY.format("CAST(2 AS BIGINT)", "I", "'assistant:'")} AS m2,
    {_EMPTY.format("CAST(0 AS BIGINT)", "", "")} AS m3
  FROM messages GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, {", ".join(map(_with_insert, range(4)))} FROM (
    SELECT m.conv_id, m.place, {", ".join(f"{_straight(q)} AS s{q}" for q in range(4))}
    FROM walked w JOIN messages m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.place = w.place - 1)
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
    count(*) FILTER (NOT is_blank AND NOT is_duplicate AND is_open) AS truncated,
    count(*) FILTER (is_illegal) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(w.m0.cost, 0) AS cost, coalesce(w.m0.audit, '') AS audit,
  sha256(coalesce(array_to_string(w.m0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walked w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = 1
"""
