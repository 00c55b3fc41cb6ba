"""Where chains of links lead: forks, cut-off tails and loops are told apart, however long a chain is."""

import random

from veritick.operators import ledger as L

SCHEMA = "ledger string, sha256 string, prev_sha string"


def walk(rows):
    """By following every pointer."""
    to = {(a, h): p for a, h, p in rows}
    out = {}
    for a, h in to:
        seen, at = 0, h
        while True:
            if to[a, at] is None:
                out[a, h] = (seen, "genesis")
                break
            at, seen = to[a, at], seen + 1
            if (a, at) not in to:
                out[a, h] = (seen - 1, "missing")
                break
            if seen > len(to):
                out[a, h] = (None, "loop")
                break
    return out


def test_reach_equals_a_walk(spark):
    rng = random.Random(2)
    rows = [("long", f"s{i}", f"s{i - 1}" if i else None) for i in range(300)]
    rows += [("cut", f"s{i}", f"s{i - 1}" if i % 40 else "lost" if i else None) for i in range(130)]
    rows += [("fork", f"s{i}", f"s{rng.randrange(i)}" if i else None) for i in range(120)]
    rows += [("loop", f"s{i}", f"s{(i + 1) % 7}") for i in range(7)] + [("loop", "t", "s3"), ("self", "a", "a"), ("one", "a", None), ("two", "a", None), ("two", "b", None)]
    df = spark.createDataFrame(rows + rows[:5] + [("long", None, "s1")], SCHEMA)
    got = {(r["ledger"], r["sha256"]): (r["before"], r["end"]) for r in L.chain_reach(df).collect()}
    assert got == walk(rows)
    assert L.chain_reach(df.limit(0)).count() == 0


def test_shape(spark):
    rows = [("good", f"s{i}", f"s{i - 1}" if i else None) for i in range(9)]
    rows += [("fork", f"s{i}", f"s{i - 1}" if i else None) for i in range(9)] + [("fork", "x5", "s4"), ("fork", "x6", "x5")]
    rows += [("tail", f"s{i}", f"s{i - 1}" if i else None) for i in range(9) if i != 4]
    rows += [("none", "b", "a"), ("ring", "a", "b"), ("ring", "b", "a"), ("roots", "a", None), ("roots", "b", None)]
    got = {r["ledger"]: tuple(r)[1:] for r in L.chain_shape(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"good": (9, 9, 0, 0, 0), "fork": (11, 5, 6, 0, 0), "tail": (8, 4, 0, 4, 0), "none": (1, 0, 0, 1, 0), "ring": (2, 0, 0, 0, 2), "roots": (2, 0, 2, 0, 0)}
