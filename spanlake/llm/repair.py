"""Conversation structure repair: the cheapest edits that make the roles of a conversation a legal sequence.

A conversation's rows and the states of the pattern ``(s?(ua)+)?`` span a lattice: keeping, changing the role of or
deleting a row goes one row on, inserting a message stays. Two Dijkstra searches, one from the start and one from the
legal ends, settle nodes with their least audits until no undiscovered crossing can be as cheap as the best; of all
crossings of that cost the least concatenated audit wins. An audit leads through the pattern deterministically, so that
among the cheapest audits of a node none begins another one, and least parts make the least whole.

1. Equal rows of a turn are added up, and an aggregate finds the first turn of each role and text (by SHA-256); both go
   to ranges of (conversation, turn, role, text), so that a conversation of a third of all rows is many ranges.
2. A task walks through its range. A conversation that lies inside, of at most ``PIECE`` rows, is solved there. Others
   are cut into pieces, which know the cheapest audit from each state to each.
3. The pieces of a conversation are chained by their costs (a few numbers a piece); each piece then makes its part
   of the audit and of the repaired text, and these are joined and hashed piece by piece in order.

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come
first; rows of one turn follow by role and then by the SHA-256 of the text, equal rows are duplicates; a role's initial is
its first character, an empty role has none; very long texts are read whole; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from .common import materialize

CHANGE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
PIECE = 512
ROLES = {"u": "user", "a": "assistant"}
# states of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; both 0 and 3 may be the end
NEEDS = ("u", "u", "a", "u")
AFTER = {"u": 2, "a": 3}
BEFORE = {2: (0, 1, 3), 3: (2,)}
FINAL = (0, 3)
BLANK = re.compile(r"[^\x20\x09-\x0D]")
TAIL = " \t\n\x0b\x0c\r"

Row = tuple[str, bool, int]  # initial of the role, whether it must go, what keeping a truncated text costs
Found = tuple[int, str] | None


def _steps(rows: list[Row], i: int, q: int, tail: bool) -> Iterator[tuple[int, str, int, int]]:
    """``(cost, letter, i, q)`` of the edges out of a node; inserts after the last row only if ``tail``."""
    to = AFTER[NEEDS[q]]
    if i < len(rows) or tail:
        yield INSERT, "I", i, to
    if i < len(rows):
        initial, must_go, cut_off = rows[i]
        yield DELETE, "D", i + 1, q
        if not must_go:
            yield CHANGE + cut_off, "R", i + 1, to
            if initial == NEEDS[q]:
                yield cut_off, "K", i + 1, to
            elif initial == "s" and q == 0:
                yield cut_off, "K", i + 1, 1


def _steps_back(rows: list[Row], i: int, q: int, tail: bool) -> Iterator[tuple[int, str, int, int]]:
    """``(cost, letter, i, q)`` of the edges into a node."""
    if i < len(rows) or tail:
        for p in BEFORE.get(q, ()):
            yield INSERT, "I", i, p
    if i > 0:
        initial, must_go, cut_off = rows[i - 1]
        yield DELETE, "D", i - 1, q
        if not must_go:
            for p in BEFORE.get(q, ()):
                yield CHANGE + cut_off, "R", i - 1, p
                if initial == NEEDS[p]:
                    yield cut_off, "K", i - 1, p
            if q == 1 and initial == "s":
                yield cut_off, "K", i - 1, 0


def cheapest(rows: list[Row], start: int = 0, ends: tuple[int, ...] = FINAL, tail: bool = True) -> Found:
    """The least cost from ``start`` over all rows to one of ``ends``, and of the audits of that cost the least."""
    n = len(rows)
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    # edges without cost lead from a row to the next one: nodes of one cost settle in that order, each by its least audit
    forth = [(0, 0, "", start)]
    back = [(0, -n, "", q) for q in ends]
    heapq.heapify(back)
    best: Found = None

    while forth or back:
        if best and forth and back and forth[0][0] + back[0][0] > best[0]:
            break
        if not back or (forth and forth[0][0] <= back[0][0]):
            cost, i, audit, q = heapq.heappop(forth)
            if (i, q) in ahead:
                continue
            ahead[i, q] = cost, audit
            if (i, q) in behind and i == n:
                best = _less(best, cost + behind[i, q][0], audit + behind[i, q][1])
            for more, letter, j, p in _steps(rows, i, q, tail):
                if (j, p) in behind:
                    best = _less(best, cost + more + behind[j, p][0], audit + letter + behind[j, p][1])
                if (j, p) not in ahead:
                    heapq.heappush(forth, (cost + more, j, audit + letter, p))
        else:
            cost, i, audit, q = heapq.heappop(back)
            i = -i
            if (i, q) in behind:
                continue
            behind[i, q] = cost, audit
            if (i, q) in ahead and i == n:
                best = _less(best, cost + ahead[i, q][0], ahead[i, q][1] + audit)
            for more, letter, j, p in _steps_back(rows, i, q, tail):
                if (j, p) in ahead:
                    best = _less(best, cost + more + ahead[j, p][0], ahead[j, p][1] + letter + audit)
                if (j, p) not in behind:
                    heapq.heappush(back, (cost + more, -j, letter + audit, p))
    return best


def _less(best: Found, cost: int, audit: str) -> tuple[int, str]:
    return min(best, (cost, audit)) if best else (cost, audit)


def apply(messages: list[tuple[str, str]], audit: str, q: int = 0) -> list[tuple[str, str]]:
    """Roles and texts after the edits of ``audit``, begun in state ``q``."""
    out, at = [], iter(messages)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s" and q == 0:
            q = 1
        else:
            need = NEEDS[q]
            q = AFTER[need]
            if letter != "K":
                role = ROLES[need]
        out.append((role, text))
    return out


class _Piece:
    """Rows of one conversation, in order, and what is told of them."""

    def __init__(self) -> None:
        self.messages: list[tuple[str, str]] = []
        self.rows: list[Row] = []
        self.turns: list[int] = []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str, fresh: bool) -> None:
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        blank = BLANK.search(text) is None
        cut_off = not blank and fresh and text.rstrip(TAIL)[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and not fresh
        self.truncated += cut_off
        self.messages.append((role, text))
        self.rows.append((role[:1], blank or not fresh, CUT_OFF * cut_off))

    def facts(self) -> dict:
        pairs = [a[0] + b[0] for a, b in zip(self.rows, self.rows[1:], strict=False)]
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return {
            "low": low, "high": high, "turns": len(self.turns), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "first": ends[0], "last": ends[1],
        }


_FACTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_SCHEMA = f"has_conv boolean, conv string, piece long, whole boolean, {_FACTS}, cost long, audit string, repaired_sha256 string, costs array<long>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>"


def _joined(messages: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in messages)


def _whole(p: _Piece) -> dict:
    cost, audit = cheapest(p.rows)
    return p.facts() | {"whole": True, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(_joined(apply(p.messages, audit)).encode()).hexdigest()}


def _part(p: _Piece) -> dict:
    """Costs, audits and the order of audits from state q to state r (at 4q + r), without inserts after the last row, and from
    q to a legal end, with them (at 16 + q)."""
    found = [cheapest(p.rows, q, (r,), False) for q in range(4) for r in range(4)] + [cheapest(p.rows, q) for q in range(4)]
    audits = [f[1] if f else None for f in found]
    ranks = [sum(y is not None and x is not None and y < x for y in audits[k // 4 * 4 : k // 4 * 4 + 4]) for k, x in enumerate(audits[:16])]
    roles, texts = [m[0] for m in p.messages], [m[1] for m in p.messages]
    return p.facts() | {"whole": False, "costs": [f[0] if f else None for f in found], "ranks": ranks, "audits": audits, "roles": roles, "texts": texts}


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held, order = _Piece(), TaskContext.get().partitionId() << 40
    key = known = None  # the conversation, and the last key that was said to be the first of its role and text
    split, out, weight = True, [], 0  # a conversation at a border of the range may go on beyond it

    def close(whole: bool) -> None:
        nonlocal order, held, weight
        order += 1
        weight += sum(len(t) for _, t in held.messages) * (not whole) + 200
        out.append({"has_conv": key[0], "conv": key[1], "piece": order} | (_whole(held) if whole else _part(held)))
        held = _Piece()

    def packed() -> pa.RecordBatch:
        nonlocal out, weight
        b = pa.RecordBatch.from_pylist(out, schema)
        out, weight = [], 0
        return b

    for batch in batches:
        names = batch.schema.names
        for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            has_conv, conv, has_turn, turn, role, digest, text, copies = r
            if (has_conv, conv) != key:
                if key is not None:
                    close(not split)
                    split = False
                key = has_conv, conv
            if copies is None:
                known = has_turn, turn, role, digest
                continue
            fresh = known == (has_turn, turn, role, digest)
            for k in range(copies):
                if len(held.rows) == size:
                    split = True
                    close(False)
                held.add(turn if has_turn else None, role, text, fresh and k == 0)
            if copies:
                known = None
            if weight > 1 << 22:
                yield packed()
    if key is not None:
        close(False)
    if out:
        yield packed()


def _spark_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (r for b in batches for i in range(0, b.num_rows, 64) for r in b.slice(i, 64).to_pylist())
    return groupby(rows, key=lambda r: (r["has_conv"], r["conv"]))


def _chained(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The states in which each piece begins and ends, and which end it takes: rows ``(piece, state, choice)``."""
    for _, rows in _by_conversation(batches):
        pieces = [(r["piece"], r["costs"], r["ranks"]) for r in rows]
        togo = [pieces[-1][1][16:]]
        for _, costs, _ in reversed(pieces[:-1]):
            nxt = togo[-1]
            togo.append([min((c + nxt[r] for r in range(4) if (c := costs[4 * q + r]) is not None and nxt[r] is not None), default=None) for q in range(4)])
        togo.reverse()
        q, out = 0, []
        for k, (piece, costs, ranks) in enumerate(pieces):
            if k + 1 == len(pieces):
                out.append({"piece": piece, "state": q, "choice": 16 + q})
                break
            ends = [r for r in range(4) if costs[4 * q + r] is not None and togo[k + 1][r] is not None and costs[4 * q + r] + togo[k + 1][r] == togo[k][q]]
            r = min(ends, key=lambda r: ranks[4 * q + r])
            out.append({"piece": piece, "state": q, "choice": 4 * q + r})
            q = r
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema)


def _repaired(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    out = []
    for i in range(batch.num_rows):
        r = batch.slice(i, 1).to_pylist()[0]
        audit = r["audits"][r["choice"]]
        done = apply(list(zip(r["roles"], r["texts"], strict=True)), audit, r["state"])
        out.append({c: r[c] for c in schema.names if c in r} | {"cost": r["costs"][r["choice"]], "audit": audit, "n": len(done), "repaired": _joined(done)})
    return pa.RecordBatch.from_pylist(out, schema)


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (has_conv, conv), rows in _by_conversation(batches):
        total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        low = high = last = None
        audit, sha, begun = [], hashlib.sha256(), False
        for r in rows:
            for c in total:
                total[c] += r[c]
            if r["low"] is not None:
                total["turns"] -= r["low"] == high
                low, high = r["low"] if low is None else low, r["high"]
            if r["first"] is not None:
                total["illegal"] += last is not None and last + r["first"] not in ("su", "ua", "au")
                last = r["last"]
            audit.append(r["audit"])
            if r["n"]:
                sha.update(("\n" if begun else "").encode() + r["repaired"].encode())
                begun = True
        yield pa.RecordBatch.from_pylist([total | {"has_conv": has_conv, "conv": conv, "low": low, "high": high, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)


_RESULT = "has_conv boolean, conv string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, piece: int = PIECE) -> DataFrame:
    """``(<conv_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``: a row a conversation.

    ``copies_col`` tells how often a row stands there; rows of 0 copies only name their conversation. ``piece`` sizes the
    pieces of long conversations and changes no result.
    """
    spark = rows.sparkSession
    on_workers(spark)
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    d = rows.select(
        conv.isNotNull().alias("has_conv"), F.coalesce(conv.cast("string"), F.lit("")).alias("conv"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), copies.cast("long").alias("copies"),
    )
    digest = F.sha2("text", 256).alias("digest")
    order = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]
    counted = d.groupBy("has_conv", "conv", "has_turn", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    first = d.where("copies > 0").select("has_conv", "conv", "role", digest, F.struct("has_turn", "turn").alias("at")).groupBy("has_conv", "conv", "role", "digest").agg(F.min("at").alias("at"))
    first = first.select("has_conv", "conv", "at.has_turn", "at.turn", "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"))
    both = counted.select("has_conv", "conv", "has_turn", "turn", "role", digest, "text", "copies").unionByName(first)
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("copies").asc_nulls_first())
    schema = _spark_schema(spark, _SCHEMA)
    parts = materialize(ranged.mapInArrow(lambda it: _pieces(it, schema, piece), _SCHEMA), "conversation-pieces")

    some = parts.where("not whole")
    chain = _spark_schema(spark, "piece long, state int, choice int")
    chained = some.select("has_conv", "conv", "piece", "costs", "ranks").repartition("has_conv", "conv").sortWithinPartitions("has_conv", "conv", "piece")
    chained = chained.mapInArrow(lambda it: _chained(it, chain), "piece long, state int, choice int")
    made_ddl = f"has_conv boolean, conv string, piece long, {_FACTS}, cost long, audit string, n long, repaired string"
    made_schema, result = _spark_schema(spark, made_ddl), _spark_schema(spark, _RESULT)
    made = some.join(chained, "piece").mapInArrow(lambda it: (_repaired(b.slice(i, 16), made_schema) for b in it for i in range(0, b.num_rows, 16)), made_ddl)
    made = made.repartition("has_conv", "conv").sortWithinPartitions("has_conv", "conv", "piece")
    names = result.names
    out = parts.where("whole").select(*names).unionByName(made.mapInArrow(lambda it: _summed(it, result), _RESULT))
    kind = rows.schema[conv_col].dataType.simpleString()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return out.select(F.when(F.col("has_conv"), F.col("conv").cast(kind)).alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: by a hash of conversation and turn, rows are lost, emptied, cut off, repeated or given to the user."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    k: Column = F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )


def _sql() -> str:
    def step(x: str, cost: str, letter: str) -> str:
        """A path is its cost in nine digits and its audit, so that the least text is the best path."""
        return f"(printf('%09d', left({x}, 9)::bigint + {cost}) || substr({x}, 10) || '{letter}')"

    def inserted(s: str) -> tuple[str, str]:
        two = f"least({s}2, {', '.join(step(f'{s}{q}', '3', 'I') for q in (0, 1, 3))})"
        return two, f"least({s}3, {step('y2', '3', 'I')})"

    two, three = inserted("s")
    may = "not must_go and initial"
    when = lambda test, x: f"case when {test} then {x} end"
    kept = lambda q, c: when(f"{may} = '{c}'", step(q, "t", "K"))
    changed = lambda q: when("not must_go", step(q, "3 + t", "R"))
    to_user = ", ".join(f"{kept(q, 'u')}, {changed(q)}" for q in ("s0", "s1", "y3"))
    return rf"""
with bits as (select list(v order by i) as tbl from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) as v from (select unnest(generate_series(0, 255))::bigint as i))),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as id from conversations),
h as (select o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 20 as k from o, bits),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(generate_series(1, case k when 0 then 0 when 3 then 2 else 1 end)) as c from h),
n as (select *, row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, c) > 1 as again, left(role, 1) as initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core
  from d window w as (partition by conv_id order by turn nulls first, role, sha256(text), c)),
r as (select *, core = '' as blank, core <> '' and again as dup, core <> '' and not again and right(core, 1) not in ('.', '!', '?') as cut_off, core = '' or again as must_go,
  case when core <> '' and not again and right(core, 1) not in ('.', '!', '?') then 3 else 0 end as t, lag(initial) over (partition by conv_id order by i) || initial as pair from n),
p as (with recursive w as (select distinct conv_id, 0::bigint as i, '000000000' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from conversations
  union all select conv_id, i, {step('s0', '4', 'D')}, least({step('s1', '4', 'D')}, {kept('s0', 's')}), least({step('y2', '4', 'D')}, {to_user}), least({step('y3', '4', 'D')}, {kept('y2', 'a')}, {changed('y2')})
  from (select *, {three} as y3 from (select w.conv_id, r.i, s0, s1, s2, s3, must_go, initial, t, {two} as y2 from w join r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1))) select * from w),
f as (select conv_id, least(s0, {three}) as path from (select *, {two} as y2 from p qualify row_number() over (partition by conv_id order by i desc) = 1)),
a as (select conv_id, left(path, 9)::bigint as cost, substr(path, 10) as audit from f),
e as (select *, substr(audit, j, 1) as letter, length(replace(left(audit, j), 'I', '')) as i, length(replace(left(audit, j), 'D', '')) as k from (select *, unnest(generate_series(1, length(audit))) as j from a)),
m as (select e.conv_id, e.k, letter, case when letter = 'I' then '' else text end as text, role, initial, bool_or(letter = 'K' and initial = 's' and e.k = 1) over (partition by e.conv_id) as headed
  from e left join r on r.conv_id is not distinct from e.conv_id and r.i = e.i where letter <> 'D'),
g as (select conv_id, string_agg(case when letter = 'K' then role when (k - headed::int) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as whole from m group by all),
s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut_off) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by all)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
from a left join s on s.conv_id is not distinct from a.conv_id left join g on g.conv_id is not distinct from a.conv_id
"""


OP13_SQL = _sql()
