"""Repair the turn structure of conversations: a run-length DP over min-plus transitions.

A repaired conversation has role initials ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and
Insert (an empty text) 3; blank and duplicate rows must go, truncated ones that stay cost 3 more. What has been emitted
so far is one of four states: nothing, ``s``, ``u`` or ``a``. A row is one of ten symbols (its initial and whether it is
truncated, or "must go"), and a symbol is a 4 x 4 min-plus matrix on the costs that lie ahead, inserts included.

1. Rows are narrowed to a key and a text digest; equal rows of a turn collapse to one with a count, map-side. The first
   row of each role and text is a grouped minimum, joined back; the rest are duplicates.
2. A task streams its conversations in order and keeps only runs of equal symbols. It goes back over the runs, each in
   one step by the binary powers of its matrix, which are cached, and notes the costs ahead of each run. Then it goes
   forward and unrolls the choices, halving a run until single rows are left; of equally cheap edits it takes the
   letter that comes first in ASCII, so the audit is the least of all cheapest ones.
3. Audits and whole rows meet in the order of turns, streamed again: texts are hashed or emitted as they pass.

Whole rows are shuffled once. A conversation is never held: a task keeps eleven bytes per run and the audit, one
character per edit, which its result row holds anyway. One conversation with very many rows is streamed by one task, as
its digest is one SHA-256 over all its text in order.

Defined cases: a null role or text is one space; null turns come first; equal turns go by role, then by the MD5 of the
text; rows without a conversation id are one conversation; a conversation of which no row is left has no edits and the
digest of the empty string; texts may have any length; turns are whole numbers, others count as null; repeated rows are
duplicates; columns besides the four named are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm.crc import CRC_TABLE, crc32_sql
from fairground.llm.registry import query
from fairground.llm.rows import named

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
FAR = 1 << 60
OUT = 1024  # rows handed on at a time
_NEXT = (U, U, A, U)  # what an insert or a new role emits in each state
_KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_ACCEPTED = (0, FAR, FAR, 0)
_GONE = ("", False)  # the symbol of a row that must go; others are (initial, truncated)

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _times(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


def _inserts() -> Matrix:
    """Cheapest inserts from each state to each other; two at most, as a third returns to a state passed before."""
    one = tuple(tuple(0 if i == j else INSERT if _NEXT[i] == j else FAR for j in range(4)) for i in range(4))
    return _product(one, one)


_BEFORE = _inserts()
AT_END = _times(_BEFORE, _ACCEPTED)


def _choices(symbol: tuple[str, bool], state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a row, in ASCII order."""
    yield "D", DELETE, state
    if symbol == _GONE:
        return
    initial, truncated = symbol
    extra = TRUNCATED if truncated else 0
    if (state, initial) in _KEPT:
        yield "K", KEEP + extra, _KEPT[state, initial]
    yield "R", REROLE + extra, _NEXT[state]


@lru_cache(maxsize=None)  # ten symbols, lengths of a power of two
def _power(symbol: tuple[str, bool], bit: int) -> Matrix:
    """The matrix of 2 ** bit rows with the same symbol."""
    if bit:
        half = _power(symbol, bit - 1)
        return _product(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, then in _choices(symbol, state):
            row[state][then] = min(row[state][then], cost)
    return _product(_BEFORE, tuple(map(tuple, row)))


@lru_cache(maxsize=1 << 16)
def _back(symbol: tuple[str, bool], length: int, ahead: Vector) -> tuple[int, Vector]:
    """Costs ahead before a run, from those after it: their least, and how far each state is above it."""
    bit = 0
    while length >> bit:
        if length >> bit & 1:
            ahead = _times(_power(symbol, bit), ahead)
        bit += 1
    least = min(ahead)
    return least, tuple(min(x - least, FAR) for x in ahead)


@lru_cache(maxsize=1 << 16)
def _choose(symbol: tuple[str, bool], state: int, after: Vector) -> tuple[str, int]:
    """The edits at one row, inserts before it included, and the state they lead to."""
    before, letters = _times(_power(symbol, 0), after), ""
    while True:
        cheapest = [(letter, then) for letter, cost, then in _choices(symbol, state) if cost + after[then] == before[state]]
        if INSERT + before[_NEXT[state]] == before[state]:
            cheapest.append(("I", _NEXT[state]))
        letter, state = min(cheapest)
        letters += letter
        if letter != "I":
            return letters, state


def _unroll(symbol: tuple[str, bool], length: int, state: int, after: Vector, out: list[str]) -> int:
    if length == 1:
        letters, state = _choose(symbol, state, after)
        out.append(letters)
        return state
    half = length // 2
    state = _unroll(symbol, half, state, _back(symbol, length - half, after)[1], out)
    return _unroll(symbol, length - half, state, after, out)


class _Runs:
    """The runs of one conversation, a few bytes each, and what is counted on the way."""

    symbols: list[tuple[str, bool]] = [_GONE, *((i, t) for i in ("s", "u", "a", "o") for t in (False, True))]
    numbers = {s: n for n, s in enumerate(symbols)}
    vectors: list[Vector] = []
    known: dict[Vector, int] = {}

    def __init__(self) -> None:
        self.kind, self.length = array("b"), array("q")
        self.first = self.last = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn: int | None, initial: str, fault: int, times: int) -> None:
        """``times`` equal rows; ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated (of the first, others repeat it)."""
        if not times:
            return
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += times - 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.blank += times if fault == 1 else 0
        self.duplicate += times if fault == 2 else 0 if fault == 1 else times - 1
        self.truncated += fault == 3
        if fault in (1, 2):
            self._run(0, times)
            return
        self._run(self.numbers[initial if initial in ("s", "u", "a") else "o", fault == 3], 1)
        if times > 1:
            self._run(0, times - 1)

    def _run(self, kind: int, times: int) -> None:
        if self.kind and self.kind[-1] == kind:
            self.length[-1] += times
        else:
            self.kind.append(kind), self.length.append(times)

    @classmethod
    def _number(cls, v: Vector) -> int:
        if v not in cls.known:
            cls.known[v] = len(cls.vectors)
            cls.vectors.append(v)
        return cls.known[v]

    def solve(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair."""
        n, cost, ahead = len(self.kind), 0, AT_END
        after = array("H", bytes(2 * n))  # the few distinct vectors of costs ahead, by number
        for r in range(n - 1, -1, -1):
            after[r] = self._number(ahead)
            least, ahead = _back(self.symbols[self.kind[r]], self.length[r], ahead)
            cost += least
        cost, state, out = cost + ahead[START], START, []
        for r in range(n):
            state = _unroll(self.symbols[self.kind[r]], self.length[r], state, self.vectors[after[r]], out)
        out.append("I" * (AT_END[state] // INSERT))
        return cost, "".join(out)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.solve())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its narrow rows, which come in order."""
    current, runs, out, schema = None, None, [], None
    for batch in batches:
        if schema is None:
            counts = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            schema = pa.schema([pa.field("conv", batch.schema.field(0).type), *counts, pa.field("audit", pa.string())])
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if runs is None or conv != current:
                if runs is not None:
                    out.append((current, *runs.row()))
                current, runs = conv, _Runs()
            runs.add(*row)
            if len(out) >= OUT:
                yield _batch(out, schema)
                out = []
    if runs is not None:
        out.append((current, *runs.row()))
        yield _batch(out, schema)


class _Replay:
    """Follow an audit over the rows it was made for."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, ""

    def _new(self) -> str:
        role = "assistant" if self.last == "u" else "user"
        self.last = role[0]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.last = role[:1]
            yield role, text
        elif letter == "R":
            yield self._new(), text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head of a conversation, None) and (head, (role, text)) for each of its repaired rows, in order."""
    head = replay = None
    for batch in batches:
        for conv, *counts, audit, role, text, times in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if head is not None:
                    yield from ((head, piece) for piece in replay.inserted())
                head, replay = (conv, *counts, audit), _Replay(audit)
                yield head, None
                continue
            for _ in range(times):
                yield from ((head, piece) for piece in replay.row(role, text))
    if head is not None:
        yield from ((head, piece) for piece in replay.inserted())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([*list(first.schema)[:8], pa.field("repaired_sha256", pa.string())])
    head, digest, pieces, out = None, None, 0, []
    for now, piece in _replayed(_chain(first, batches)):
        if piece is None:
            if head is not None:
                out.append((*head, digest.hexdigest()))
            if len(out) >= OUT:
                yield _batch(out, schema)
                out = []
            head, digest, pieces = now, sha256(), 0
            continue
        digest.update(("\n" * bool(pieces) + piece[0] + ":" + piece[1]).encode())
        pieces += 1
    if head is not None:
        out.append((*head, digest.hexdigest()))
        yield _batch(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([first.schema.field(0), pa.field("position", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])
    position, out, held = 0, [], 0
    for head, piece in _replayed(_chain(first, batches)):
        if piece is None:
            position = 0
            continue
        position += 1
        held += len(piece[1])
        out.append((head[0], position, *piece))
        if len(out) >= OUT or held > 1 << 22:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _faced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits per conversation, and the rows with their digests, from ``conv, turn, role, text, times``."""
    rows = rows.withColumn("h", F.unhex(F.md5("text")))
    shown = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "conv", "turn", "role", "h", "times", (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ).groupBy("conv", "turn", "role", "h").agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    again = narrow.where("times > 0 AND NOT blank").groupBy("conv", "role", "h").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    met = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv", "role", "h")]
    seen = narrow.alias("x").join(again.alias("y"), met[0] & met[1] & met[2], "left").select("x.*", "y.first")
    fault = (
        F.when(F.col("blank"), 1).when(F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first")), 2)
        .when(F.col("open"), 3).otherwise(0)
    )
    ordered = seen.withColumn("fault", fault).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "h")
    kind = dict(rows.dtypes)["conv"]
    audits = ordered.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "times").mapInArrow(
        _audits, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )
    return audits, rows


def _met(rows: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order."""
    audits, rows = _faced(rows)
    head = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    both = audits.select(*head).unionByName(
        rows.where("times > 0").select("conv", "turn", "role", "text", "h", "times"), allowMissingColumns=True
    )
    ordered = both.repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "h"
    )
    return ordered.select(*head, "role", "text", "times")


def _rows(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return convs.select(
        named(conv).alias("conv"), named(turn).cast("long").alias("turn"), F.coalesce(named(role), F.lit(" ")).alias("role"),
        F.coalesce(named(text), F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("times"),
    )


def audit_conversations(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: gaps, faults, cost and audit of its cheapest repair, and the digest of the repaired rows."""
    return _digested(_rows(convs, conv, turn, role, text), conv)


def repair_conversations(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: conversation, position (from 1), role, text."""
    rows = _rows(convs, conv, turn, role, text)
    out = _met(rows).mapInArrow(_turns, f"conv {dict(rows.dtypes)['conv']}, position long, role string, text string")
    return out.withColumnRenamed("conv", conv)


def _digested(rows: DataFrame, conv: str) -> DataFrame:
    schema = f"conv {dict(rows.dtypes)['conv']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _met(rows).mapInArrow(_digests, schema).withColumnRenamed("conv", conv)


def _damage(rows: DataFrame) -> DataFrame:
    """``rows`` with seeded faults; dropped ones stay with ``times`` 0, so that their conversation is still known."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(shown("conv"), F.lit(":"), shown("turn"))) % 20
    rows = rows.withColumn("k", k)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _add(value: str, cost: str, letters: str) -> str:
    """SQL: a cost of twelve digits and its audit as one string, so the least string is the cheapest, ASCII-least one."""
    return f"(lpad((left({value}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({value}, 13) || '{letters}')"


_FAR_SQL = "'900000000000'"
_ROW_SQL = f"""
SELECT conv_id, i,
  {_add('e0', '4', 'D')} AS e,
  CASE WHEN NOT gone AND x = 's' THEN least({_add('s0', '4', 'D')}, {_add('e0', 'p', 'K')}) ELSE {_add('s0', '4', 'D')} END AS s,
  CASE WHEN gone THEN {_add('u0', '4', 'D')}
       WHEN x = 'u' THEN least({_add('u0', '4', 'D')}, {_add('least(e0, s0, a0)', 'p', 'K')}, {_add('least(e0, s0, a0)', '3 + p', 'R')})
       ELSE least({_add('u0', '4', 'D')}, {_add('least(e0, s0, a0)', '3 + p', 'R')}) END AS u,
  CASE WHEN gone THEN {_add('a0', '4', 'D')}
       WHEN x = 'a' THEN least({_add('a0', '4', 'D')}, {_add('u0', 'p', 'K')}, {_add('u0', '3 + p', 'R')})
       ELSE least({_add('a0', '4', 'D')}, {_add('u0', '3 + p', 'R')}) END AS a"""  # fmt: skip
_INSERT_SQL = f"""e AS e0, s AS s0, least(u, {_add('e', '3', 'I')}, {_add('s', '3', 'I')}, {_add('a', '3', 'I')}) AS u0,
  least(a, {_add('u', '3', 'I')}, {_add('e', '6', 'II')}, {_add('s', '6', 'II')}) AS a0"""  # fmt: skip


@query("op11_conversation_repair", f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
c1 AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM c1),
c3 AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS x,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS f FROM c2),
r AS MATERIALIZED (SELECT conv_id, i, x, f IN ('b', 'd') AS gone, CASE f WHEN 't' THEN 3 ELSE 0 END AS p FROM c3),
d AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000000' AS e, {_FAR_SQL} AS s, {_FAR_SQL} AS u, {_FAR_SQL} AS a FROM conversations
  UNION ALL
  {_ROW_SQL} FROM (SELECT d.conv_id, r.i, x, gone, p, {_INSERT_SQL}
    FROM d JOIN r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = d.i + 1)),
best AS (SELECT conv_id, least(e0, a0) AS v FROM (
  SELECT conv_id, {_INSERT_SQL} FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
edits AS (SELECT conv_id, unnest(range(1, length(v) - 11)) AS pos, v FROM best),
letters AS (SELECT conv_id, pos, substr(v, (pos + 12)::INT, 1) AS l FROM edits),
placed AS (SELECT *, sum(CASE WHEN l = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i,
             sum(CASE WHEN l = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS z FROM letters),
given AS (SELECT p.*, c.role, c.text,
            max(CASE WHEN z = 1 AND l = 'K' AND c.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys
          FROM placed p LEFT JOIN c3 c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.i WHERE l <> 'D'),
said AS (SELECT conv_id, sha256(string_agg(
           CASE WHEN l = 'K' THEN role WHEN (z - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS sha FROM given GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
        count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM c3 GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(v, 12)::BIGINT AS cost,
       substr(v, 13) AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN said s ON b.conv_id IS NOT DISTINCT FROM s.conv_id""")  # fmt: skip
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged by a hash of their ids and turns, and repaired."""
    rows = _rows(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return _digested(_damage(rows), "conv_id")
