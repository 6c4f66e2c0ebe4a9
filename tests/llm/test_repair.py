"""Conversation repair against a plain program that tries all audits by growing cost."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanlake.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def edits(rows):
    """Least cost and audit by a table over rows and the last legal initials."""
    # (row, state) -> (cost, audit) from there on; states as words: "", "s", "u", "a"
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}
    later = {q: (0, "") if q in ("", "a") else None for q in nxt}

    def with_inserts(at):
        for _ in range(4):
            for q in nxt:
                for c in nxt[q]:
                    if c != "s" and at[c]:
                        x = (at[c][0] + 3, "I" + at[c][1])
                        at[q] = min(at[q], x) if at[q] else x
        return at

    later = with_inserts(later)
    for initial, must_go, cut in reversed(rows):
        now = {}
        for q in nxt:
            ways = [(later[q][0] + 4, "D" + later[q][1])] if later[q] else []
            for c in nxt[q] if not must_go else "":
                if later[c]:
                    ways += [(later[c][0] + cut, "K" + later[c][1])] * (c == initial)
                    ways += [(later[c][0] + 3 + cut, "R" + later[c][1])] * (c != "s")
            now[q] = min(ways, default=None)
        later = with_inserts(now)
    return later[""]


def plain(rows, copies=False):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).extend([(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])] * (r[4] if copies else 1))
    out = []
    for conv, ms in convs.items():
        ms.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).hexdigest()))
        seen, facts, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in ms:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            facts.append((role[:1], fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        turns = [m[0] for m in ms if m[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:]))
        cost, audit = edits(facts)
        left, done, headed = list(ms), [], False
        for x in audit:
            m = left.pop(0) if x != "I" else (None, "", "")
            if x == "D":
                continue
            if x == "K":
                headed |= not done and m[1][:1] == "s"
                done.append(f"{m[1]}:{m[2]}")
            else:
                done.append(("user" if (len(done) - headed) % 2 == 0 else "assistant") + ":" + m[2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_against_a_table():
    rnd = random.Random(1)
    for _ in range(5000):
        rows = [(rnd.choice(["s", "u", "a", "t", ""]), rnd.random() < 0.25, rnd.choice([0, 0, 3])) for _ in range(rnd.randint(0, 10))]
        assert repair.cheapest(rows) == edits(rows)


def some_rows(rnd, conv, n):
    words = ["Yes.", "no", "Is it?", "", "  ", "Fine!", "and so", None, "Well. ", "text \x0b"]
    return [(conv, rnd.choice([None, *range(n)]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(words) if rnd.random() < 0.3 else f"{rnd.choice(words[:1])} {rnd.random()}{rnd.choice('.!?,')}") for _ in range(n)]


@pytest.mark.parametrize("piece", [repair.PIECE, 3])
def test_conversations_against_a_plain_program(spark, piece):
    rnd = random.Random(5)
    rows = [r for conv in range(60) for r in some_rows(rnd, conv, rnd.randint(1, 9))]
    rows += some_rows(rnd, None, 7) + some_rows(rnd, 1000, 300)  # one conversation has half of the rows
    rows += [(70, 1, "user", "Long. " * 200_000), (70, 2, "assistant", "ok."), (71, None, None, None), (72, 5, "user", "Same.")] + [(72, 5, "user", "Same.")] * 20
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = plain(rows)
    clash = d.withColumns({c: F.lit("own") for c in ("has_conv", "conv", "digest", "copies", "piece", "cost", "audit", "first", "known")})
    assert told(repair.repair_conversations(clash, piece=piece)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations go over several ranges
    try:
        assert told(repair.repair_conversations(d, piece=piece)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repair.repair_conversations(d.limit(0)).count() == 0


def test_damage_against_a_plain_program(spark):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["system", "user", None]), rnd.choice([f"A text. Of {t}! Or?", None])) for c in [None, *range(40)] for t in [None, *range(5)]]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        want.append((c, t, "user" if k == 4 else role, text, {0: 0, 3: 2}.get(k, 1)))
    d = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert told(d) == sorted(want, key=str)
    assert told(repair.repair_conversations(d, copies_col="copies")) == plain(want, copies=True)
    lost = d.where("copies = 0")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in repair.repair_conversations(lost, copies_col="copies").collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}
