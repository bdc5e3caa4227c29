"""Conversation structure repair: the cheapest edits that bring a conversation's turns to the order system? (user assistant)+.

A turn is kept, given another role or deleted, and empty turns can be put in; a grammar of four states says what may follow.
Spark numbers the turns, cuts long conversations into pieces and deals the pieces out by a hash, so one conversation is not
one task's work. In a task, a recursive DuckDB query goes through all pieces of a batch at once: each recursion advances
every piece by one turn and keeps the least cost, with its audit, for each state; a piece that begins inside a conversation
is walked from every state. Pieces are then joined in order, by the states in which they meet.

A letter of the audit stands for an edit: K keep, R give the role that the grammar wants, D delete, I insert. Audits of equal
cost are ordered as text. Inserts belong to the turn that follows, so two audits of the same turns are never one the
beginning of the other, and the best whole is made of best parts.

A digest of a whole conversation needs its text in order: for that, the turns of one conversation stream through one task,
after a row that has the audit; they are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import park, table
from .duck import ask, connect, whole_runs

#: Turns of one piece, and of one statement.
PIECE = 64
MERGED = 20_000

RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn leads to, by its role's initial and the state before.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_INITIALS = "sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

_SPACE = r"\x20\x09-\x0D"
_VISIBLE, _ENDED = rf"[^{_SPACE}]", rf"[.!?][{_SPACE}]*\z"


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after some inserts; more than two lead back to a state at a higher cost."""
    out = [(state, 0, "")]
    for _ in range(2):
        now, cost, letters = out[-1]
        out.append((ASSISTANT if now == USER else USER, cost + INSERT, letters + "I"))
    return out


@cache
def moves() -> list[tuple[int, int, int, int, str]]:
    """(kind, state, next state, cost, letters) of one turn; kind is 4 * its initial's place in `sua` (3: another one) + its fault."""
    out = []
    for initial in range(4):
        for fault in range(4):
            for state in range(4):
                for now, cost, letters in _inserted(state):
                    edits = [(now, DELETE, "D")]
                    if fault in (FINE, TRUNCATED):
                        more = CUT_OFF if fault == TRUNCATED else 0
                        own = _NEXT[_INITIALS[initial]].get(now) if initial < 3 else None
                        edits += [(own, more, "K")] if own is not None else []
                        edits += [(_NEXT[x][now], more + RENAME, "R") for x in "ua" if now in _NEXT[x]]
                    out += [(4 * initial + fault, state, to, cost + c, letters + x) for to, c, x in edits]
    return out


@cache
def closing() -> dict[int, tuple[int, str]]:
    """Cost and letters of the inserts that end a conversation from each state."""
    return {state: min((cost, letters) for now, cost, letters in _inserted(state) if now in (START, ASSISTANT)) for state in range(4)}


def _moves_table() -> pa.Table:
    return pa.table(dict(zip(("kind", "state", "goes_to", "cost", "letters"), zip(*moves(), strict=True), strict=True)))


_WALK_SQL = """
with recursive walk as (
  select unit, start, 0 as k, start as state, {'cost': 0::bigint, 'audit': ''} as best
  from (select unit, min(piece) as piece from turns group by unit) cross join (select unnest([0, 1, 2, 3]) as start) where piece > 0 or start = 0
  union all
  select unit, start, k, state, min(best) as best from (
    select w.unit, w.start, w.k + 1 as k, m.goes_to::int as state, {'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters} as best
    from walk w join turns t on t.unit = w.unit and t.k = w.k join moves m on m.kind = t.kind and m.state = w.state)
  group by unit, start, k, state
), counted as (
  select unit, count(*) as n, any_value(conv_id) as conv_id, any_value(piece) as piece, count(*) filter (kind % 4 = 1) as blank, count(*) filter (kind % 4 = 2) as duplicate,
    count(*) filter (kind % 4 = 3) as truncated, count(*) filter (illegal) as illegal, count(*) filter (new_turn) as turns, min(turn) as first_turn, max(turn) as last_turn
  from turns group by unit
)
select c.conv_id, c.piece, c.blank, c.duplicate, c.truncated, c.illegal, c.turns, c.first_turn, c.last_turn,
  w.start, w.state, w.best.cost as cost, w.best.audit as audit
from counted c join walk w on w.unit = c.unit and w.k = c.n
order by c.unit, w.start, w.state
"""
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def turns_of(rows: DataFrame, live: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, live, turn, role, text, text_hash) of rows; a null role or text is one space. Where `live` is false a row only says that its conversation is there."""
    blank = F.lit(" ")
    out = rows.select(
        F.col(f"`{id_col}`").alias("conv_id"), (F.lit(True) if live is None else live).alias("live"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), blank).alias("text"),
    )
    return out.withColumn("text_hash", F.unhex(F.md5("text")))


def judged(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, pos, kind, illegal, new_turn, turn): the turns in order (nulls first; of one number by role, then a hash of the text), without their text.

    A conversation has piece -1 with one row if one of its rows is not live.
    """
    text = F.col("text")
    seen = F.when(~text.rlike(_VISIBLE), BLANK).when(text.rlike(_ENDED), FINE).otherwise(TRUNCATED)
    rows = turns.select("conv_id", "live", "turn", "role", "text_hash", seen.alias("seen")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text_hash").orderBy("turn")) > 1
    rows = rows.withColumn("fault", F.when((F.col("seen") != BLANK) & again, DUPLICATE).otherwise(F.col("seen")))
    order = Window.partitionBy("conv_id", "live").orderBy("turn", "role", "text_hash")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    rows = rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"))
    rows = rows.filter("live or pos = 0")
    place = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), initial) * (F.length("role") > 0).cast("int"), F.lit(0)), F.lit(4)) - 1
    return rows.select("conv_id", F.when(F.col("live"), F.expr(f"pos div {PIECE}")).otherwise(F.lit(-1)).cast("long").alias("piece"), "pos", (place * 4 + F.col("fault")).cast("int").alias("kind"), "illegal", "new_turn", "turn")


def _counts_type(kind: str) -> str:
    return f"conv_id {kind}, piece long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long"


def walked(rows: DataFrame) -> DataFrame:
    """Counts of each piece, with a row for each start and state: the least cost between them and its audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        con.register("moves", _moves_table())
        for many in whole_runs(batches, ["conv_id", "piece"], MERGED):
            n = many.num_rows
            ids, piece = many.column("conv_id").to_pylist(), many.column("piece").to_pylist()
            unit, k, u, at = [0] * n, [0] * n, 0, 0
            for i in range(n):
                if i and (ids[i], piece[i]) != (ids[i - 1], piece[i - 1]):
                    u, at = u + 1, i
                unit[i], k[i] = u, i - at
            turns = many.append_column("unit", pa.array(unit, pa.int32())).append_column("k", pa.array(k, pa.int32()))
            live = turns.filter(pa.array([p >= 0 for p in piece]))
            gone = turns.filter(pa.array([p < 0 for p in piece]))
            if live.num_rows:
                yield from ask(con, _WALK_SQL, turns=live).cast(schema_of(live)).to_batches()
            if gone.num_rows:
                m = gone.num_rows
                zero, none = pa.array([0] * m, pa.int64()), pa.array([None] * m, pa.int64())
                at_start = pa.array([0] * m, pa.int32())
                yield from pa.Table.from_arrays([gone.column("conv_id"), gone.column("piece"), *[zero] * 5, none, none, at_start, at_start, zero, pa.array([""] * m)], schema=schema_of(gone)).to_batches()

    def schema_of(rows: pa.Table) -> pa.Schema:
        longs = ("piece", *_COUNTS, "first_turn", "last_turn")
        return pa.schema([("conv_id", rows.schema.field("conv_id").type), *((x, pa.int64()) for x in longs), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    dealt = rows.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos")
    return dealt.mapInArrow(walk, f"{_counts_type(kind)}, start int, state int, cost long, audit string")


class Joined:
    """The pieces of one conversation, joined in order: for each state the least cost, and where it came from.

    Equal costs are settled by the audits before, which are known by their rank, and then by the piece's own letters.
    """

    def __init__(self) -> None:
        self.now: dict[int, tuple[int, int]] = {START: (0, 0)}  # cost, rank
        self.back: list[dict[int, tuple[int, str]]] = []

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        """The next piece's (start, state, cost, audit)."""
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, state, cost, audit in paths:
            if start in self.now:
                before, rank = self.now[start]
                found = (before + cost, rank, audit, start)
                if state not in best or found < best[state]:
                    best[state] = found
        order = sorted({x[1:3] for x in best.values()})
        self.now = {s: (x[0], order.index(x[1:3])) for s, x in best.items()}
        self.back.append({s: (x[3], x[2]) for s, x in best.items()})

    def end(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        cost, _, last, state = min((cost + closing()[s][0], rank, closing()[s][1], s) for s, (cost, rank) in self.now.items())
        parts = [last]
        for back in reversed(self.back):
            state, letters = back[state]
            parts.append(letters)
        return cost, "".join(reversed(parts))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, from `walked`."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(x.split()[0] for x in _REPORT.split(", "))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, piece, paths, joined, sums, first, last = None, -1, [], None, [], None, None
        id_type = None

        def end() -> None:
            joined.add(paths) if paths else None
            gaps = 0 if first is None else min(last - first + 1 - sums[4], 2**63 - 1)
            out.append((now, gaps, *sums[:4], *joined.end()))

        def batch_of() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for r in batch.to_pylist():
                if joined is None or r["conv_id"] != now:
                    if joined is not None:
                        end()
                    now, piece, paths, joined, sums, first, last = r["conv_id"], -1, [], Joined(), [0] * 5, None, None
                if r["piece"] < 0:
                    continue
                if r["piece"] != piece:
                    if paths:
                        joined.add(paths)
                    piece, paths = r["piece"], []
                    sums = [a + r[x] for a, x in zip(sums, _COUNTS, strict=True)]
                    first = r["first_turn"] if first is None else first
                    last = r["last_turn"] if r["last_turn"] is not None else last
                paths.append((r["start"], r["state"], r["cost"], r["audit"]))
            if out:
                yield batch_of()
                out.clear()
        if joined is not None:
            end()
            yield batch_of()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(fold, f"conv_id {kind}, {_REPORT}")


def _composed(turns: DataFrame, report: DataFrame, digests: bool) -> DataFrame:
    """The repaired turns, or the report with a digest of them: the turns stream by, each conversation after its report."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in _REPORT.split(", ")]
    head = report.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("text_hash"), F.lit(None).cast("string").alias("text"), *names)
    types = dict(x.split() for x in _REPORT.split(", "))
    body = turns.filter("live").select("conv_id", F.lit(1).alias("step"), "turn", "role", "text_hash", "text", *(F.lit(None).cast(types[x]).alias(x) for x in names))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, at, seq, state = None, None, 0, 0, START
        out: list[tuple] = []
        id_type = None

        def emit(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal seq, state
            if digests:
                sha.update((b"\n" if seq else b"") + f"{role}:{text}".encode())
            else:
                out.append((head["conv_id"], seq, edit, turn, role, text))
            seq, state = seq + 1, _NEXT[role[0]][state]

        def inserts() -> None:
            nonlocal at
            while head["audit"][at : at + 1] == "I":
                emit("I", None, "assistant" if state == USER else "user", "")
                at += 1

        def end() -> None:
            inserts()
            if digests:
                out.append((head["conv_id"], *(head[x] for x in names), sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            kinds = [id_type, *([pa.int64()] * 6 + [pa.string()] * 2 if digests else [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])]
            labels = ["conv_id", *names, "repaired_sha256"] if digests else ["conv_id", "seq", "edit", "turn", "role", "text"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], labels)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for r in batch.to_pylist():
                if r["step"] == 0:
                    if head is not None:
                        end()
                    head, sha, at, seq, state = r, hashlib.sha256(), 0, 0, START
                    continue
                inserts()
                edit = head["audit"][at]
                at += 1
                if edit == "K":
                    emit(edit, r["turn"], r["role"], r["text"])
                elif edit == "R":
                    emit(edit, r["turn"], "assistant" if state == USER else "user", r["text"])
            if out:
                yield batch_of()
                out.clear()
        if head is not None:
            end()
        if out:
            yield batch_of()

    rows = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "text_hash")
    return rows.mapInArrow(compose, f"conv_id {kind}, {_REPORT}, repaired_sha256 string" if digests else f"conv_id {kind}, seq long, edit string, turn long, role string, text string")


def repair(rows: DataFrame, live: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, edit, turn, role, text): the repaired conversations; seq counts from 0, an inserted turn has no number.

    A null role or text is one space, a null conv_id a conversation, a null turn comes first. Turns of one number are ordered
    by role and a hash of the text; equal ones are duplicates. A role without an initial is never kept. Very long texts pass
    by one at a time. Other columns are not used; an empty table stays empty.
    """
    turns = turns_of(rows, live, id_col, turn_col, role_col, text_col)
    return _composed(turns, park(audits(walked(judged(turns)))), digests=False)


def report(rows: DataFrame, live: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows.

    Rows that are not `live` count for nothing, but their conversation is reported; one without live rows has zeros, an
    empty audit and the digest of nothing. Else as `repair`.
    """
    turns = turns_of(rows, live, id_col, turn_col, role_col, text_col)
    return _composed(turns, park(audits(walked(judged(turns)))), digests=True)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): rows with the faults of the query, by a crc32 of `conv_id:turn`."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20)).alias("fault"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    what = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), what.alias("text"), (F.col("fault") != 0).alias("live"), copies.alias("_")).drop("_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: what repairs the damaged `conversations`."""
    return report(damaged(table(spark, sf_dir, "conversations")), F.col("live"))


_VALUES = ", ".join(f"({k}, {s}, {t}, {c}, '{x}')" for k, s, t, c, x in moves())
_CLOSING = ", ".join(f"({s}, {c}, '{x}')" for s, (c, x) in closing().items())
SQL = f"""
with recursive crc_table as (
  select list(v order by i) as crcs from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(i))
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), faulty as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: unicode(substr(key, i, 1))::bigint)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault
  from keyed, crc_table
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fault = 3 then [1, 2] else [1] end) as copy
  from faulty where fault <> 0
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) - 1 as pos,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again from damaged
), judged as (
  select *, case when not regexp_matches(text, '{_VISIBLE}') then 1 when again then 2 when not regexp_matches(text, '{_ENDED}') then 3 else 0 end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by pos) || substr(role, 1, 1) not in ('su', 'ua', 'au') as illegal,
    case substr(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end as place from ordered
), moves(kind, state, goes_to, cost, letters) as (
  values {_VALUES}
), closing(state, cost, letters) as (
  values {_CLOSING}
), known as (
  select distinct conv_id from conversations
), walk as (
  select conv_id, 0::bigint as k, 0 as state, {{'cost': 0::bigint, 'audit': ''}} as best from known
  union all
  select conv_id, k, state, min(best) as best from (
    select w.conv_id, w.k + 1 as k, m.goes_to as state, {{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters}} as best
    from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.pos = w.k join moves m on m.kind = 4 * j.place + j.fault and m.state = w.state)
  group by conv_id, k, state
), counted as (
  select n.conv_id, count(j.pos) as n, coalesce(max(j.turn) - min(j.turn) + 1 - count(distinct j.turn), 0) as gaps, count(*) filter (j.fault = 1) as blank,
    count(*) filter (j.fault = 2) as duplicate, count(*) filter (j.fault = 3) as truncated, count(*) filter (j.illegal) as illegal
  from known n left join judged j on j.conv_id is not distinct from n.conv_id group by n.conv_id
), solved as (
  select c.conv_id, min({{'cost': w.best.cost + x.cost, 'audit': w.best.audit || x.letters}}) as best
  from counted c join walk w on w.conv_id is not distinct from c.conv_id and w.k = c.n join closing x on x.state = w.state group by c.conv_id
), letters as (
  select conv_id, i, best.audit[i] as letter, length(replace(best.audit[:i], 'I', '')) - 1 as pos, length(replace(best.audit[:i], 'D', '')) - 1 as seat
  from (select conv_id, best, unnest(range(1, length(best.audit) + 1)) as i from solved)
), placed as (
  select l.*, j.role, j.text, max(case when seat = 0 and letter = 'K' and j.role like 's%' then 1 else 0 end) over (partition by l.conv_id) as led
  from letters l left join judged j on l.letter <> 'I' and j.conv_id is not distinct from l.conv_id and j.pos = l.pos where l.letter <> 'D'
), composed as (
  select conv_id, string_agg((case when letter = 'K' then role when (seat - led) % 2 = 0 then 'user' else 'assistant' end) || ':' || coalesce(text, ''), chr(10) order by i) as whole
  from placed group by conv_id
)
select c.conv_id, c.gaps::bigint as gaps, c.blank, c.duplicate, c.truncated, c.illegal, s.best.cost as cost, s.best.audit as audit, sha256(coalesce(p.whole, '')) as repaired_sha256
from counted c join solved s on s.conv_id is not distinct from c.conv_id left join composed p on p.conv_id is not distinct from c.conv_id
"""

QUERIES = {"op12_conversation_repair": query}
ORACLES = {"op12_conversation_repair": SQL}
