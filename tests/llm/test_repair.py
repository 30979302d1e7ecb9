"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from daygrid.llm import edits, repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("n", "h", "kind", "codes", "segment", "matrix", "cost")]])
BLANKS = " \t\n\r\x0b\x0c"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}


def after(state, initial):
    if initial == "":
        return state
    if initial == "s":
        return 1 if state == 0 else None
    return {"u": 2, "a": 3}[initial] if NEXT[state] == initial else None


def cheapest(rows):
    """Least (cost, audit) and the turns it gives, by Dijkstra's search over (rows used, state)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, state, made = heapq.heappop(heap)
        if k == len(rows) and state in (0, 3):
            return cost, audit, list(made)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        name = "user" if NEXT[state] == "u" else "assistant"
        then = after(state, NEXT[state])
        heapq.heappush(heap, (cost + 5, audit + "I", k, then, (*made, (name, ""))))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, then, (*made, (name, text))))
                if role[:1] in ("", "s", "u", "a") and after(state, role[:1]) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, after(state, role[:1]), (*made, (role, text))))


def brute(table, damage):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text, here = " " if role is None else role, " " if text is None else text, convs[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        here += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out, turns = {}, {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            body = text.strip(BLANKS)
            judged.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "clean"))
            seen.add((role, text))
        numbers = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, made = cheapest(judged)
        count = lambda f: sum(j[2] == f for j in judged)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
        turns[conv] = made
    return out, turns


def run(spark, rows, damage=True):
    df = spark.createDataFrame([(*r, *"xxxxxxx") for r in rows], SCHEMA).repartition(3)
    plain = repair.plain(df)
    r = repair.Repair(repair.damaged(plain) if damage else plain)
    report = [tuple(x) for x in r.report().collect()]
    turns = defaultdict(list)
    for t in sorted(r.turns().collect(), key=lambda t: t.position):
        turns[t.conv_id].append((t.role, t.text))
    assert len({x[0] for x in report}) == len(report)
    return {x[0]: x[1:] for x in report}, turns


def conversations(seed, n, roles=("system", "user", "assistant", "tool", "", "u", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", " ", "", None, "a\nb. \t", "é漢.", "dots... and", "x" * 300 + "."]
    return [(None if c == 0 else c, r.choice([t, t, t, None, t // 2, t * 3]), r.choices(roles, [2, 6, 6, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.6 else f"turn {t}{r.choice('.!? ')}")
            for c in range(n) for t in range(r.randrange(0, 14))]


@pytest.mark.parametrize("damage", [True, False])
def test_reports_and_turns_match_a_plain_search(spark, damage):
    rows = conversations(1, 250)
    rows += rows[:40] + [(900, 1, "user", "Same.")] * 7 + [(901, t, "user", "Hi.") for t in range(9)]
    report, turns = run(spark, rows, damage)
    want, made = brute(rows, damage)
    assert report == want
    assert {c: t for c, t in made.items() if t} == turns


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant", "user", "tool"]), r.choice(["again.", f"t {t}.", f"t {t}"])) for t in range(5000)]
    rows += [(2, 5, "user", "equal.")] * 2500 + [(2, 6, "assistant", "end."), (3, 0, "user", "z" * 200_000 + "."), (3, 1, "assistant", "y" * 100_000)]
    report, turns = run(spark, rows)
    want, made = brute(rows, True)
    assert report == want
    assert turns == {c: t for c, t in made.items() if t}


def test_empty_table_and_dropped_conversations(spark):
    assert run(spark, []) == ({}, {})
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_block_tables_equal_single_steps():
    t = edits.tables()
    assert len(t.vectors) < 2000
    r = random.Random(2)
    for _ in range(200):
        at, word = r.randrange(len(t.vectors)), [r.randrange(edits.SYMBOLS) for _ in range(edits.BLOCK)]
        code, off, step = 0, 0, at
        for s in word:
            code, off, step = code * edits.SYMBOLS + s, off + t.add[step, s], t.next[step, s]
        assert (t.block_next[at, code], t.block_add[at, code]) == (step, off)
