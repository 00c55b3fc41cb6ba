"""The prefix trie against a plain one, for many numbers of shards, and the query against a plain rebuild."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veritick.llm import trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(convs):
    """Nodes of {conversation: tuple of (role, text)}, by collecting every prefix."""
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=lambda x: -len(x)):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
        listed = ",".join(map(str, sorted(ends[node])))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    return out


def nodes_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def as_table(spark, convs):
    rows = [(c, [hashlib.sha256(f"{r}:{x}".encode()).hexdigest()[:32] for r, x in turns], [len(x.split()) for _, x in turns], 1) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, steps array<string>, words array<long>, depth int")


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_trie_over_shards(spark, shards):
    rng = random.Random(shards)
    convs = {c: tuple((rng.choice(("user", "assistant")), "w " * rng.randint(0, 2)) for _ in range(rng.randint(0, 5))) for c in rng.sample(range(-500, 500), 200)}
    convs |= {1000 + c: (("user", "the same"),) * 3 for c in range(150)}  # members of one node over several shards
    convs |= {2000: (("user", "long"),) * 300, 2001: (("user", "long"),) * 300 + (("assistant", "end"),), 2002: (("user", "long"),) * 170}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert nodes_of(trie.trie(as_table(spark, convs))) == plain_trie(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_pieces_of_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 3)
    skel = trie.Skeleton([0], [b""], [[0]])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 7), pa.array([b""] * 7, pa.binary()), pa.array([[]] * 7, pa.list_(pa.int64())), pa.array(range(7))], ["r", "path", "words", "conv_id"])
    got = [r for b in trie.shard_nodes(skel, iter([batch])) for r in b.to_pylist()]
    assert [(r["nth"], r["ends"]) for r in got if r["kind"] == trie.LIST] == [(0, "0,1,2"), (1, "3,4,5"), (2, "6")]
    assert [r["n_convs"] for r in got if r["kind"] == trie.PART] == [7]


def test_shared_turns():
    rng = random.Random(2)
    for _ in range(300):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)) for _ in range(1)).hex().encode()
        n = rng.randint(0, len(a))
        b = a[:n] + bytes(rng.choice(b"xy") for _ in range(rng.randint(0, 40)))
        want = 0
        while (want + 1) * 16 <= min(len(a), len(b)) and a[: (want + 1) * 16] == b[: (want + 1) * 16]:
            want += 1
        assert trie.shared_turns(a, b) == want


@pytest.fixture
def stored(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, words string, steps int").write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return put


def test_query_on_odd_rows(spark, stored):
    rng = random.Random(3)
    texts = ["Hello there.", "", None, " \n", "one  two\tthree", "ü ß", "x" * 70_000]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for c in (*range(-45, 130), 10**15, None) for _ in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 290) for t in range(6)]  # whole families of copies
    rows += [(399, t, "user", f"turn {t}") for t in range(700)] + rows[:20]
    rng.shuffle(rows)
    got = trie.op13_prefix_trie(spark, stored([(*r, 1, "w", 2) for r in rows]))
    assert tuple(got.columns) == NAMES and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert nodes_of(got) == plain_trie(plain_rebuilt(rows))


def test_query_on_the_tables_and_empty(spark, stored):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(trie.op13_prefix_trie(spark, sf)) == plain_trie(plain_rebuilt(rows))
    assert trie.op13_prefix_trie(spark, stored([])).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuilt(trie.paths(only_null))).count() == 0


def test_tokens_saved_are_the_shared_ones(spark):
    convs = {c: (("user", "a b c"), ("assistant", "d e"))[: 1 + c % 2] for c in range(10)}
    root = trie.trie(as_table(spark, convs)).where(F.col("depth") == 0).collect()[0]
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (10, 1, 1, 9 * 3 + 4 * 2)
