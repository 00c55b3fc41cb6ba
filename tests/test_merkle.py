"""Roots and proofs from tiles against the definitions over lists of leaves, and against the replay of proofs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veritick.operators import merkle as M
from veritick.operators import proofs as P


def mth(d):
    if len(d) == 1:
        return d[0]
    k = 1 << (len(d) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + mth(d[:k]) + mth(d[k:])).digest()


def path(m, d):
    if len(d) == 1:
        return []
    k = 1 << (len(d) - 1).bit_length() - 1
    return [*path(m, d[:k]), mth(d[k:])] if m < k else [*path(m - k, d[k:]), mth(d[:k])]


def subproof(m, d, whole):
    if m == len(d):
        return [] if whole else [mth(d)]
    k = 1 << (len(d) - 1).bit_length() - 1
    return [*subproof(m, d[:k], whole), mth(d[k:])] if m <= k else [*subproof(m - k, d[k:], False), mth(d[:k])]


SIZES = {"a": 43, "b": 1, "c": 16, "d": 7}
LEAVES = {log: [hashlib.sha256(b"\x00" + f"{log}-{i}".encode()).digest() for i in range(n)] for log, n in SIZES.items()}
hexes = lambda xs: [x.hex() for x in xs]


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(log, i, h.hex(), "x") for log, hs in LEAVES.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(rows[::-1], "log string, idx int, leaf_hash string, hash string").repartition(3)


@pytest.mark.parametrize("height", [2, 8])
def test_roots_of_every_size(spark, leaves, height):
    table = M.tile_table(leaves, height)
    assert table.count() == sum(sum(n >> k for k in range(n.bit_length())) for n in SIZES.values())
    asked = spark.createDataFrame([(log, m) for log, n in SIZES.items() for m in range(-1, n + 3)] + [("none", 1)], "log string, tree_size int")
    got = {(r["log"], r["tree_size"]): r["root_hex"] for r in M.roots(table, asked.union(asked)).collect()}
    assert got == {(log, m): mth(LEAVES[log][:m]).hex() for log, n in SIZES.items() for m in range(1, n + 1)}


@pytest.mark.parametrize("top", [0, 20, 50_000])
def test_inclusion_proofs_of_every_entry_and_size(spark, leaves, top, monkeypatch):
    monkeypatch.setattr(M, "TOP_NODES", top)
    table = M.tile_table(leaves, 3)
    asked = spark.createDataFrame([(log, i, m) for log, n in SIZES.items() for m in range(n + 2) for i in range(-1, m + 1) if top == 20 or m % 6 == 1], "log string, leaf_index int, tree_size int")
    got = M.inclusion_proofs(table, asked)
    want = {(log, i, m): hexes(path(i, LEAVES[log][:m])) for log, n in SIZES.items() for m in range(1, n + 1) for i in range(m) if top == 20 or m % 6 == 1}
    assert {(r["log"], r["leaf_index"], r["tree_size"]): r["path"] for r in got.collect()} == want
    rooted = got.join(M.roots(table, asked.select("log", "tree_size")), ["log", "tree_size"])
    assert P.audit_inclusion(rooted).where("problem is not null").count() == 0 and rooted.count() == len(want)
    forged = rooted.withColumn("leaf_hash", F.sha2("leaf_hash", 256))
    assert P.audit_inclusion(forged).where("problem = 'root'").count() == len(want)


def test_consistency_proofs_of_every_pair(spark, leaves):
    table = M.tile_table(leaves, 3)
    pairs = [(log, m, n) for log, top in SIZES.items() for n in range(top + 2) for m in range(n + 2)]
    asked = spark.createDataFrame(pairs, "log string, first_size int, second_size int")
    got = M.consistency_proofs(table, asked)
    want = {(log, m, n): hexes(subproof(m, LEAVES[log][:n], True)) for log, m, n in pairs if 1 <= m <= n <= SIZES[log]}
    assert {(r["log"], r["first_size"], r["second_size"]): r["proof"] for r in got.collect()} == want
    size = lambda name: M.roots(table, asked.select("log", F.col(f"{name}_size").alias("tree_size"))).select("log", F.col("tree_size").alias(f"{name}_size"), F.col("root_hex").alias(f"{name}_root"))
    both = got.join(size("first"), ["log", "first_size"]).join(size("second"), ["log", "second_size"])
    assert both.count() == len(want) and P.audit_consistency(both).where("problem is not null").count() == 0
    wrong = both.where("first_size < second_size").withColumn("second_root", F.sha2("second_root", 256))
    assert P.audit_consistency(wrong).where("problem is null").count() == 0


def test_gaps_and_empty(spark, leaves):
    for bad in (leaves.where("idx <> 3"), leaves.union(leaves.where("idx = 5")), leaves.withColumn("idx", F.when(F.col("idx") != 2, F.col("idx")))):
        with pytest.raises(ValueError):
            M.tile_table(bad)
    none = M.tile_table(leaves.where("false"))
    assert none.count() == 0 and M.roots(none, leaves.select("log", F.lit(1).alias("tree_size"))).count() == 0
    asked = leaves.select("log", F.lit(0).alias("leaf_index"), F.lit(1).alias("tree_size"))
    assert M.inclusion_proofs(none, asked).count() == 0


def test_paths_are_joined_by_tile(spark):
    """Entries of over two tiles' levels: a row a tile meets the entries, no row an entry and level."""
    import hashlib

    n = 600
    hashes = [hashlib.sha256(b"\0" + str(i).encode()).hexdigest() for i in range(n)]
    table = M.tile_table(spark.createDataFrame([("a", i, h) for i, h in enumerate(hashes)], "log string, idx long, leaf_hash string"))
    asked = spark.createDataFrame([("a", i, size) for size in (n, 513, 512, 257, 3) for i in range(size)], "log string, leaf_index long, tree_size long")
    proofs = M.inclusion_proofs(table, asked)
    assert "nth" not in proofs._jdf.queryExecution().executedPlan().toString()
    rooted = proofs.join(M.roots(table, asked.select("log", "tree_size").distinct()), ["log", "tree_size"])
    assert rooted.count() == n + 513 + 512 + 257 + 3 and P.audit_inclusion(rooted).where("problem is not null").isEmpty()
    assert all(r["leaf_hash"] == hashes[r["leaf_index"]] for r in proofs.collect())
