"""Conversation repair against a plain search over whole audits, and the query against a plain replay of the contract."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from veritick.llm import repair

sys.setrecursionlimit(20_000)  # for the plain search
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_plan(turns):
    """(cost, audit, repaired) of turns (initial, must go, truncated), trying every edit at every place with at most three insertions together."""

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            c, a, r = best(i, AFTER[last], inserted + 1)
            found.append((c + 3, "I" + a, (("I", AFTER[last]), *r)))
        if i < len(turns):
            role, gone, short = turns[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, (("D", ""), *r)))
            if not gone:
                if role == AFTER[last] or role == "s" and last == "":
                    c, a, r = best(i + 1, role, 0)
                    found.append((c + 3 * short, "K" + a, (("K", role), *r)))
                c, a, r = best(i + 1, AFTER[last], 0)
                found.append((c + 3 + 3 * short, "R" + a, (("R", AFTER[last]), *r)))
        return min(found, default=(10**9, "", ()), key=lambda x: x[:2])

    return best(0, "", 0)


def symbols_of(turns):
    return "".join(repair.SYMBOLS[(8 if gone else 4 if short else 0) + "suao".index(role)] for role, gone, short in turns)


def same(turns):
    found, (cost, audit, edits) = repair.solve(symbols_of(turns)), plain_plan(tuple(turns))
    assert (found.cost, repair.audit_of(found.plan)) == (cost, audit), turns
    assert found.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    roles = {"<": "u", ">": "a", "U": "u", "A": "a"}
    assert [roles.get(x) for x in found.plan] == [r if e in "IR" else None for e, r in edits]


def test_all_short_conversations():
    kinds = [*itertools.product("suao", (False,), (False, True)), ("u", True, False)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            same(turns)


def test_longer_conversations_and_runs():
    rng = random.Random(5)
    for _ in range(300):
        turns = []
        for _ in range(rng.randint(1, 8)):
            turns += [(rng.choice("suuaao"), rng.random() < 0.2, rng.random() < 0.3)] * rng.choice((1, 1, 2, 5, 9))
        same(turns)


def test_a_very_long_run_and_many_runs():
    found = repair.solve("u" * 1_000_001)
    assert found.cost == 3 * 500_000 + 3 and len(found.plan) >= 1_000_001 and found.illegal == 1_000_000
    found = repair.solve("ua" * 300_000)
    assert found.cost == 0 and found.plan == "K" * 600_000


def plain(rows):
    """The contract, step by step, over (conv_id, turn, role, text)."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, t, r, x in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if t is None else t}"
            kind = zlib.crc32(key.encode()) % 20
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            own += [(t is not None, t or 0, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort()
        turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, r, x in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            turns.append((r[:1] if r[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, edits = plain_plan(tuple(turns))
        lines, i = [], 0
        for edit, role in edits:
            name = {"u": "user", "a": "assistant"}.get(role)
            if edit == "I":
                lines.append(f"{name}:")
            else:
                if edit != "D":
                    lines.append(f"{name if edit == 'R' else own[i][2]}:{own[i][3]}")
                i += 1
        at = [t for known, t, *_ in own if known]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.fixture
def stored(spark, tmp_path):
    def put(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string, nth int, fault string, cost string")
        df.write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return put


def test_query_on_odd_rows(spark, stored):
    rng = random.Random(9)
    texts = ["Yes.", "No!", "What", "", " \n\t", None, "Why? ", "a.b\nc.", "é…", "x" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in (*range(-3, 60), None, 10**15) for _ in range(rng.randint(1, 9))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400)]  # a third of the rows, over several ranges
    rows += [(78, None, "user", "same.")] * 40 + rows[:30]
    rng.shuffle(rows)
    sf = stored([(*r, "x", 1, "y", "z") for r in rows])
    got = repair.op12_repair(spark, sf)
    assert got.count() == len({r[0] for r in rows})
    assert rows_of(got) == plain(rows)


def test_stretches(spark, stored, monkeypatch):
    """Stretches of two turns: runs and repeats across their borders."""
    monkeypatch.setattr(repair, "STRETCH_BITS", 1)
    rows = [(c, t // 2, ("user", "assistant", "assistant")[(t * t + c) % 3], ("One.", "Two", "Three!")[t % 3]) for c in range(40) for t in range(c % 17)]
    assert rows_of(repair.op12_repair(spark, stored([(*r, "x", 1, "y", "z") for r in rows]))) == plain(rows)


def test_query_on_the_tables_and_empty(spark, stored):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(repair.op12_repair(spark, sf)) == plain(rows)
    assert repair.op12_repair(spark, stored([])).count() == 0


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Anyone?"), (1, 2, "assistant", "Here")], "conv_id long, turn long, role string, text string")
    fixed = repair.repair(turns)
    assert [(r["turn"], r["role"], r["text"], r["edit"]) for r in fixed.turns.orderBy("at", "nth").collect()] == [
        (0, "user", "Hello.", "keep"), (None, "assistant", "", "insert"), (1, "user", "Anyone?", "keep"), (2, "assistant", "Here", "keep"),
    ]
    assert fixed.report.collect()[0]["audit"] == "KIKK"
