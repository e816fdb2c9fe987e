from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelgrid.llm import conversation_repair as cr
from panelgrid.llm.queries import QUERIES, damaged

SCHEMA = "conv_id long, turn long, role string, text string, part string, place string, row_key string"
SPACE = " \t\n\v\f\r"


def damage(rows):
    for conv, turn, role, text in rows:
        named = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(named.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 0:
            continue
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        yield from [(conv, turn, role, text)] * (2 if fate == 3 else 1)


def repaired(rows):
    """Counts, least cost, letters and lines of one conversation, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", [])}
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def put(into, state, cost, letters, lines):
        if state not in into or (cost, letters) < into[state][:2]:
            into[state] = (cost, letters, lines)
            return True
        return False

    def with_inserts(states):
        todo = list(states)
        while todo:
            state = todo.pop()
            cost, letters, lines = states[state]
            for to, role in (("u", "user"), ("a", "assistant")):
                if to in steps[state] and put(states, to, cost + 3, letters + "I", [*lines, role + ":"]):
                    todo.append(to)
        return states

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, letters, lines) in with_inserts(best).items():
            put(after, state, cost + 4, letters + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            for to in steps[state]:
                if role[:1] == to:
                    put(after, to, cost + extra, letters + "K", [*lines, f"{role}:{text}"])
                if to != "s":
                    name = {"u": "user", "a": "assistant"}[to]
                    put(after, to, cost + 3 + extra, letters + "R", [*lines, f"{name}:{text}"])
        best = after
    cost, letters, lines = min((x for s, x in with_inserts(best).items() if s in ("", "a")), key=lambda x: x[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def brute_force(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        by_conv[row[0]].append(row)
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
               "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return {conv: repaired(own) if own else nothing for conv, own in by_conv.items()}


def found(spark, tmp_path, rows, schema=SCHEMA):
    wide = [(*r, "x", "y", "z") for r in rows]
    spark.createDataFrame(wide, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    out = [r.asDict() for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()]
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r.pop("conv_id"): r for r in out}


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2", "User"])
            text = rng.choice(["Yes.", "no", "", " \n", None, "Why? ", "Why?\v", "größe 😀", f"line {rng.randrange(5)}."])
            at = rng.choice([turn, turn, turn, turn + 2, None, turn // 2])
            rows.append((rng.choice([conv, conv, conv, conv + 1]), at, role, text))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    return rows


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"}
           for r in QUERIES["op11_conversation_repair"](spark, sf_dir).collect()}
    assert got == brute_force(rows)
    assert len({r["audit"] for r in got.values()}) > 15


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, rows repeated many times, long texts, clashing columns, any role."""
    rows = conversations(1, 120, 12) + [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b.")]
    rows += [(500, 3, "user", "again.")] * 40 + [(501, None, "user", "w. " * 60_000), (501, None, "assistant", "w" * 90_000)]
    assert found(spark, tmp_path, rows) == brute_force(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_long_conversations_in_segments(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", size)
    rows = conversations(2, 3, 300) + conversations(3, 30, 6)
    assert found(spark, tmp_path, rows) == brute_force(rows)


def test_no_rows(spark, tmp_path):
    assert found(spark, tmp_path, []) == {}
    summary, lines = cr.repair_conversations(damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
    assert summary.collect() == [] and lines.collect() == []


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "so what"),
            (2, 0, "assistant", "hm")]
    summary, lines = cr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {r["conv_id"]: (r["audit"], r["cost"]) for r in summary.collect()}
    assert by == {1: ("KIKDD", 11), 2: ("D", 4)}
    kept = lines.orderBy("conv_id", "part", "number", "place").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in kept] == [(1, "system", "Be kind."), (1, "user", ""), (1, "assistant", "Hello.")]


def test_runs_are_powers_of_their_symbol():
    for symbol in ("x", "u", "a!", "s", "-", "-!"):
        plain = cr.UNIT
        for count in range(1, 40):
            plain = cr.times(plain, cr.step(symbol))
            assert cr.run_matrix(symbol, count) == plain
    assert cr.runs_of([("u", 1), ("u", 2), ("x", 1), ("u", 1)]) == [("u", 3), ("x", 1), ("u", 1)]
    assert cr.run_matrix("x", 10**12)[0][0] == 4 * 10**12


def test_all_short_sequences_against_every_order_of_edits():
    for length in range(5):
        for symbols in itertools.product(("x", "u", "a", "s", "u!", "-"), repeat=length):
            runs = cr.runs_of((s, 1) for s in symbols)
            letters, state = cr.unroll(runs, 0, cr.ENDING)
            rest = cr.ENDING
            for symbol in reversed(symbols):
                rest = cr.before(cr.step(symbol), rest)
            text = letters + cr.closing(state)
            stays = [s for s, e in zip(symbols, text.replace("I", "")) if e in "KR"]
            assert 4 * text.count("D") + 3 * (text.count("R") + text.count("I") + sum("!" in s for s in stays)) == rest[0]


def test_plan_ships_no_text_before_the_last_join(spark, sf_dir):
    rows = cr._keyed(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conv_id", "turn", "role", "text")
    assert "text" not in cr.find_faults(rows).columns
    assert cr.find_faults(rows).where(F.col("copies") < 1).count() == 0
