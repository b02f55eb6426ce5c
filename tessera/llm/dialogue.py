"""Operator 12, repair of the structure of conversations by a dynamic program that a trie shares.

A conversation's rows become a signature, one letter a row: its role's initial and its first fault.
Among Keep, Rerole, Delete and Insert the program seeks the cheapest edits after which the roles'
initials read (s?(ua)+)?. Its layers, the least cost of each state after so many rows, depend on
the signature's prefix only: distinct signatures are sorted, which walks a prefix trie from left to
right, and of the trie the branch that is open is held. A node's layer is computed when the branch reaches it and
dropped when the branch leaves it, so once for a prefix that a task's signatures share. At a terminal node the edits are read
off its layers: ties go to the least string, letter by letter among the steps that still lead to the least cost.

Rows meet in order by their conversation twice, once as letters and once with their texts, and
stream through both times: a conversation of any length costs a letter a row. A digest of a
whole text is sequential, so one conversation's rows do pass through one task, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, after s, after u, after a. The state that the role which may follow leads to, and that role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: For each initial, where it leads from each state; -1: it may not follow.
MOVES = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ENDS = (0, 3)
INFINITE = 1 << 60


def _steps(symbol: str | None, q: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits from state q in the order of their letters: letter, rows taken, next state, cost. symbol: the next row's, None after the last."""
    if symbol is not None:
        yield "D", 1, q, DELETE
    yield "I", 0, NEXT[q], INSERT
    if symbol is not None and symbol != "X":
        more = TRUNCATED if symbol.isupper() else 0
        to = MOVES.get(symbol.lower(), (-1,) * 4)[q]
        if to >= 0:
            yield "K", 1, to, KEEP + more
        yield "R", 1, NEXT[q], REROLE + more


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """A layer after any number of insertions."""
    for _ in range(3):
        for q in range(4):
            costs[NEXT[q]] = min(costs[NEXT[q]], costs[q] + INSERT)
    return tuple(costs)


def layer(before: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    costs = [INFINITE] * 4
    for q, cost in enumerate(before):
        for _, rows, to, more in _steps(symbol, q):
            if rows and cost + more < costs[to]:
                costs[to] = cost + more
    return _inserted(costs)


def answer(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Least cost and the least string of edits with it, from the layers along a signature."""
    n = len(signature)
    cost = min(layers[n][q] for q in ENDS)
    good = [[False] * 4 for _ in range(n + 1)]  # states from which steps that keep to the layers' costs lead to the end
    for q in ENDS:
        good[n][q] = layers[n][q] == cost
    for i in range(n, -1, -1):
        symbol = signature[i] if i < n else None
        for _ in range(3):  # insertions lead on within a layer
            for q in range(4):
                if not good[i][q] and layers[i][q] < INFINITE:
                    good[i][q] = any(good[i + rows][to] and layers[i + rows][to] == layers[i][q] + more for _, rows, to, more in _steps(symbol, q))
    i, q, out = 0, 0, []
    while not (i == n and q in ENDS and layers[n][q] == cost):
        symbol = signature[i] if i < n else None
        letter, rows, to, _ = next(s for s in _steps(symbol, q) if good[i + s[1]][s[2]] and layers[i + s[1]][s[2]] == layers[i][q] + s[3])
        out.append(letter)
        i, q = i + rows, to
    return cost, "".join(out)


def answers(signatures: Iterable[str], made: list | None = None) -> Iterator[tuple[str, int, str]]:
    """signature, cost, audit of sorted signatures. made: gets every prefix whose layer is computed."""
    before, layers = "", [_inserted([0, INFINITE, INFINITE, INFINITE])]
    for signature in signatures:
        shared = 0
        for a, b in zip(before, signature):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for i in range(shared, len(signature)):
            layers.append(layer(layers[-1], signature[i]))
            if made is not None:
                made.append(signature[: i + 1])
        before = signature
        yield signature, *answer(signature, layers)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits."""
    q = 0
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter in "IR":
            role, q = ROLE[q], NEXT[q]
        else:
            q = MOVES[role[0]][q]
        yield role, text


def _answered(batches):
    import pyarrow as pa

    def each():
        for x in batches:
            yield from x.column(0).to_pylist()

    out = []
    for row in answers(each()):
        out.append(row)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(("signature", "cost", "audit"), r)) for r in out])
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("signature", "cost", "audit"), r)) for r in out])


def _sorted_rows(batches, names: list[str]):
    for x in batches:
        yield from zip(*(x.column(n).to_pylist() for n in names))


_REPORT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
_LEGAL = {"su", "ua", "au"}


def _reported(batches):
    """Counts and signature of each conversation, from its rows in order."""
    import pyarrow as pa

    names, out = [f.split()[0] for f in _REPORT.split(", ")], []
    key = low = high = last = pair = None
    turns, counts, symbols = 0, [0, 0, 0, 0], []

    def ended():
        return key, (high - low + 1 - turns if turns else 0), *counts, "".join(symbols)

    for k, turn, symbol, initial, fault in _sorted_rows(batches, ["k", "turn", "symbol", "initial", "fault"]):
        if k != key:
            if key is not None:
                out.append(ended())
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
                    out = []
            key, low, high, last, pair, turns, counts, symbols = k, None, None, None, None, 0, [0, 0, 0, 0], []
        if turn is not None and turn != last:
            low, high, last, turns = turn if low is None else low, turn, turn, turns + 1
        if fault >= 0:
            counts[fault] += 1
        if pair is not None and pair + initial not in _LEGAL:
            counts[3] += 1
        pair = initial
        symbols.append(symbol)
    if key is not None:
        out.append(ended())
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])


def _repaired(batches):
    """k, place, role, text of the rows that the edits leave, and at the head of every conversation a row with place -1."""
    import pyarrow as pa

    out, held = [], 0
    rows = _sorted_rows(batches, ["k", "kind", "audit", "role", "text"])
    names = ("k", "place", "role", "text")
    head = next(rows, None)
    while head is not None:
        k, _, audit, _, _ = head
        out.append((k, -1, None, None))
        head = None

        def said():
            nonlocal head
            for row in rows:
                if row[1] == 0:
                    head = row
                    return
                yield row[3], row[4]

        mine = said()
        for place, (role, text) in enumerate(edited(audit, mine)):
            out.append((k, place, role, text))
            held += len(text) + 64
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _SAID())
                out, held = [], 0
        for _ in mine:  # moves on to the next head
            raise AssertionError("edits left a row over")
        if len(out) >= 8192:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _SAID())
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _SAID())


def _SAID():
    import pyarrow as pa

    return pa.schema([("k", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _digests(batches):
    """k and the SHA-256 of its rows as role:text lines."""
    import pyarrow as pa

    key, state, out = None, None, []
    for k, place, role, text in _sorted_rows(batches, ["k", "place", "role", "text"]):
        if place < 0:
            if state is not None:
                out.append({"k": key, "repaired_sha256": state.hexdigest()})
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out)
                    out = []
            key, state = k, hashlib.sha256()
        else:
            state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if state is not None:
        out.append({"k": key, "repaired_sha256": state.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _key(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _spoken(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def repairs(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text) a report and the repaired turns.

    Report, a row a conv_id: conv_id, k, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Turns, in order and a conversation in one piece: k, place, role, text; the head of every
    conversation, also of one without turns, is a row with place -1. k names a conv_id, null included.

    Rows come by turn, null first, and those of one turn by a SHA-256 of role and text, so rows that
    are equal are exchangeable. Null roles and texts count as one space. ids: a table of conv_id with
    those that have no rows; repeated ones count once. Other columns are not read; an empty table
    gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    base = rows.select(_key(F.col("conv_id")).alias("k"), "conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    base = base.withColumns({"said": _spoken(F.col("role"), F.col("text")), "row": F.monotonically_increasing_id(), "blank": ~F.col("text").rlike(BLANK), "short": ~F.col("text").rlike(ENDED)})
    base = cut(base)
    facts = base.select("k", "turn", "said", "row", "blank", "short", F.substring("role", 1, 1).alias("initial"))
    # of rows that say the same in a conversation the first; only where there are several
    first = cut(facts.where("NOT blank").groupBy("k", "said").agg(F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first")).where("n > 1").select("k", "said", "first"))
    facts = attach(facts, first, ["k", "said"], F.octet_length("k") + 96)
    again = F.col("first").isNotNull() & ~F.struct("turn", "row").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), 0).when(again, 1).when(F.col("short"), 2).otherwise(-1)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    facts = facts.withColumn("fault", fault).withColumn("symbol", F.when(F.col("fault").isin(0, 1), F.lit("X")).when(F.col("fault") == 2, F.upper(letter)).otherwise(letter))
    placed = facts.select("k", "turn", "said", "row", "symbol", "initial", "fault").repartition("k").sortWithinPartitions("k", F.col("turn").asc_nulls_first(), "said", "row")
    report = cut(placed.mapInArrow(_reported, _REPORT))
    signatures = report.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    solved = cut(signatures.mapInArrow(_answered, "signature string, cost long, audit string"))
    report = attach(report, solved, ["signature"], F.octet_length("signature") + F.octet_length("audit") + 32, "inner").drop("signature")
    every = rows.select("conv_id") if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    every = every.groupBy("conv_id").agg(F.lit(0).alias("_")).select("conv_id", _key(F.col("conv_id")).alias("k"))
    report = every.join(report.hint("merge"), "k", "left").fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])
    report = cut(report.select("conv_id", "k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    heads = report.select("k", F.lit(0).alias("kind"), "audit")
    lines = heads.unionByName(base.select("k", F.lit(1).alias("kind"), "turn", "said", "row", "role", "text"), allowMissingColumns=True)
    lines = lines.repartition("k").sortWithinPartitions("k", "kind", F.col("turn").asc_nulls_first(), "said", "row")
    turns = lines.select("k", "kind", "audit", "role", "text").mapInArrow(_repaired, "k string, place long, role string, text string")
    return report, turns


def repaired_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), role, text after the cheapest edits; see repairs()."""
    report, turns = repairs(rows, ids)
    return turns.where("place >= 0").join(report.select("k", "conv_id").hint("merge"), "k").select("conv_id", "place", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with rows dropped, emptied, cut, repeated or given to the user by a checksum of conv_id and turn; nulls count as one space there and in texts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    words = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), words.alias("text"), "hit")
    return rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hit", "copy")


def repair_digests(conversations: DataFrame) -> DataFrame:
    report, turns = repairs(damaged(conversations), conversations)
    digests = turns.mapInArrow(_digests, "k string, repaired_sha256 string")
    return report.join(digests.hint("merge"), "k").drop("k")


#: The query, with every state's least pair of cost and edits, row by row, as one string. CRC-32 by its table, which is made from the polynomial.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i::UBIGINT AS b, i::UBIGINT AS v, 0 AS n FROM range(256) t(i)
UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY b) AS c FROM bits WHERE n = 8),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
  lambda h: ('0x' || h)::UBIGINT)), lambda a, h: xor(a >> 8, c[((xor(a, h) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS hit FROM conversations, tab),
x AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text), copy) AS i FROM x),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
f AS (SELECT *, CASE WHEN blank THEN 0 WHEN again THEN 1 WHEN short THEN 2 ELSE 3 END AS fault FROM g),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(q, q2, letters) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
act(q, initial, letter, q2, cost) AS (SELECT q, '', 'D', q, 2 FROM range(4) t(q) UNION ALL VALUES (0, '', 'R', 2, 1), (1, '', 'R', 2, 1), (2, '', 'R', 3, 1), (3, '', 'R', 2, 1),
  (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0)),
r AS (SELECT conv_id, 0::BIGINT AS i, q2 AS q, printf('%09d', 5 * length(letters)) || letters AS best FROM c, ins WHERE q = 0
  UNION ALL SELECT r.conv_id, r.i + 1, ins.q2, min(printf('%09d', best[:9]::BIGINT + act.cost + CASE WHEN letter <> 'D' AND fault = 2 THEN 5 ELSE 0 END + 5 * length(letters)) || best[10:] || letter || letters)
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN act ON act.q = r.q AND (act.initial = '' OR act.initial = f.role[1]) AND (letter = 'D' OR fault > 1) JOIN ins ON ins.q = act.q2 GROUP BY r.conv_id, r.i, ins.q2),
a AS (SELECT r.conv_id, min(best)[:9]::BIGINT AS cost, min(best)[10:] AS audit FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.i WHERE q IN (0, 3) GROUP BY r.conv_id),
e AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM a),
l AS (SELECT conv_id, k, audit[k] AS letter, k - length(replace(audit[:k], 'I', '')) AS inserted FROM e),
m AS (SELECT l.conv_id, l.k, letter, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS place FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.k - l.inserted AND letter <> 'I' WHERE letter <> 'D'),
s AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS headed FROM m),
w AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS h FROM s GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM k.conv_id
"""
