"""Conversation prefix trie over range-partitioned shards, joined by the skeleton of their splitter paths.

A conversation is a path: 16 bytes of a hash of role and text per turn, one behind the other, so that the order of paths
as bytes keeps the members of every node together.  Paths are range-partitioned by path and conversation (many equal
conversations go to several shards) and sorted.  A node can reach over the border of two shards only if it is a prefix
of both paths beside the splitter: those prefixes, root included, are the trie of the splitters, the skeleton.  It has at most
one path per shard and is broadcast.  Each shard builds all its other nodes by itself, with a stack of the nodes open
at the current path; of skeleton nodes it returns partial counts, which are summed by key before they meet and then
added up from the leaves of the skeleton to its root.

Per node: smallest member, depth, smallest member of its parent, members, children, leaves below, tokens saved by
computing the last turn once (summed over the subtree), and the hash of the members that end there.

Order within a conversation: by turn, nulls first, then role, then text. Edge cases: null role or text is empty; rows
without a conversation id belong to no conversation and are left out; repeated rows are turns like any other; without any
conversation there is no node, not even the root. Extra columns are left out. A conversation's path (16 bytes and one
number a turn) is one row, so that its turns, without their texts, must fit a task; members that end at one node are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritick.operators.ordered import ranges
from veritick.session import cut

STEP = 16  # bytes of a turn in a path
WORDS = r"[^\x20\x09-\x0D]+"
ENDS = 4096  # conversation ids in one piece of a list
NO_MEMBER = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, steps, words): hashes (hex) and word counts of the turns of each conversation, in order.

    Rows are put in order by ranges, so that texts are moved once and only hashes are gathered by conversation.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.left(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), F.lit(2 * STEP))
    slim = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("step"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    both = F.array_sort(F.collect_list(F.struct("at", "step", "words")))
    return slim.groupBy("conv_id").agg(both.alias("t")).select("conv_id", F.transform("t", lambda x: x["step"]).alias("steps"), F.transform("t", lambda x: x["words"]).alias("words"))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``paths`` whose first h turns are those of the first conversation of the family, h by a hash of the id, under ``most``.

    h turns of conversation c - c % family, then the own turns after the first h.
    """
    base = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__base"), F.slice("steps", 1, most - 1).alias("__steps"), F.slice("words", 1, most - 1).alias("__words"))
    c = F.col("conv_id")
    both = convs.join(base, c - c % family == F.col("__base"), "left").withColumn("__h", (F.crc32(c.cast("string")) % most).cast("int"))
    none = {"steps": "array<string>", "words": "array<bigint>"}
    parts = {x: F.concat(F.coalesce(F.slice(f"__{x}", F.lit(1), F.col("__h")), F.array().cast(kind)), F.slice(x, F.col("__h") + 1, F.size(x))) for x, kind in none.items()}
    return both.select("conv_id", *[e.alias(x) for x, e in parts.items()])


class Skeleton(NamedTuple):
    """Of each shard the turns that the paths on both sides of its lower border share, and which border stands for them first."""

    shards: list[int]
    shared: list[bytes]
    first: list[list[int]]  # by depth, from the root


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    lo, n, step = 0, min(len(a), len(b)) // STEP, 1
    while lo < n:  # steps double while they agree and start anew where they do not
        step = min(step, n - lo)
        if a[lo * STEP : (lo + step) * STEP] == b[lo * STEP : (lo + step) * STEP]:
            lo, step = lo + step, step * 2
        elif step == 1:
            break
        else:
            step = 1 if step <= 2 else step // 2
    return lo


def skeleton(ends: list[tuple[int, bytes, bytes]]) -> Skeleton:
    """From (shard, first path, last path) of the shards that hold rows, in order."""
    shared, first = [], []
    for i, (_, path, _) in enumerate(ends):
        own = path[: STEP * shared_turns(ends[i - 1][2], path)] if i else b""
        same = min(shared_turns(shared[i - 1], own), len(own) // STEP) if i else -1
        first.append([first[i - 1][d] if d <= same else i for d in range(len(own) // STEP + 1)])
        shared.append(own)
    return Skeleton([s for s, _, _ in ends], shared, first)


class Open:
    """A node of the current path."""

    __slots__ = ("children", "depth", "ends", "held", "key", "leaves", "least", "members", "saved", "words")

    def __init__(self, depth: int, words: int, key: int | None) -> None:
        self.depth, self.words, self.key = depth, words, key
        self.members, self.children, self.leaves, self.saved, self.least = 0, 0, 0, 0, None
        self.ends = [] if key is not None else None  # of skeleton nodes ids in pieces, of others a running hash
        self.held: list = []  # finished children, which wait for the smallest member

    def end(self, conv: int) -> None:
        if self.key is not None:
            self.ends.append(conv)
        elif self.ends is None:
            self.ends = hashlib.sha256(str(conv).encode())
        else:
            self.ends.update(f",{conv}".encode())


FIELDS = ("kind", "border", "depth", "conv_id", "parent_border", "parent_depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "nth", "ends")
OWN, PART, LIST = range(3)  # a finished node, a shard's share of a skeleton node, a piece of a skeleton node's ends
KINDS = [pa.int64()] * 13 + [pa.string()]


def shard_nodes(skel: Skeleton, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of one shard, whose rows (range, path, words, conv_id) come in order: finished nodes, shares and lists."""
    out: list = []
    stack: list[Open] = []
    here = b""
    low = high = b""
    keys: list[list[int]] = [[], []]
    nth = 0

    def key_of(path: bytes, depth: int, lows: int, highs: int) -> int | None:
        return keys[0][depth] if depth <= lows else keys[1][depth] if depth <= highs else None

    def pieces(node: Open) -> None:
        nonlocal nth
        if node.ends:
            out.append((LIST, node.key, node.depth, None, None, None, None, None, None, None, None, None, nth, ",".join(map(str, node.ends))))
            nth, node.ends = nth + 1, []

    def close(depth: int) -> None:
        """Finishes the nodes below ``depth``."""
        while stack and stack[-1].depth > depth:
            node, above = stack.pop(), stack[-1] if stack else None
            if above is not None:
                above.members += node.members
                above.least = node.least if above.least is None else min(above.least, node.least)
            if node.key is not None:
                pieces(node)
                out.append((PART, node.key, node.depth, node.least, None, None, None, node.members, node.children, node.leaves, node.saved, node.words, None, None))
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.words
            for c in node.held:
                out.append((*c[:6], node.least, *c[7:]))
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            done = (OWN, None, node.depth, node.least, above.key, above.depth if above.key is not None else None, None, node.members, node.children, leaves, saved, None, None, node.ends.hexdigest() if node.ends else NO_MEMBER)
            (out if above.key is not None else above.held).append(done)

    def taken() -> pa.RecordBatch:
        rows = out.copy()
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(KINDS)], list(FIELDS))

    for batch in batches:
        for shard, path, words, conv in zip(*batch.columns[:4], strict=True):
            path, conv = path.as_py(), conv.as_py()
            if not stack:
                i = skel.shards.index(shard.as_py())
                low, keys[0] = skel.shared[i], skel.first[i]
                if i + 1 < len(skel.shards):
                    high, keys[1] = skel.shared[i + 1], skel.first[i + 1]
                stack.append(Open(0, 0, 0))
            same = shared_turns(here, path)
            close(same)
            if len(path) // STEP > same:
                counts = words.as_py()
                lows, highs = shared_turns(low, path), shared_turns(high, path)
                stack.extend(Open(d, counts[d - 1], key_of(path, d, lows, highs)) for d in range(same + 1, len(path) // STEP + 1))
            here, top = path, stack[-1]
            top.members += 1
            top.least = conv if top.least is None else min(top.least, conv)
            top.end(conv)
            if top.key is not None and len(top.ends) >= ENDS:
                pieces(top)
            if len(out) >= 4096:
                yield taken()
    close(-1)
    if out:
        yield taken()


def reduced(skel: Skeleton, shares: list) -> list[tuple]:
    """Skeleton nodes as (border, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), from their summed shares.

    At most one path per shard: deepest nodes first, each adds itself to its parent.
    """
    found = {(r["border"], r["depth"]): dict(r.asDict(), below=0, inner=0, more=0) for r in shares}
    parent = {(skel.first[i][d], d): (skel.first[i][d - 1], d - 1) for i in range(len(skel.first)) for d in range(1, len(skel.first[i]))}
    out = []
    for key in sorted(found, key=lambda k: -k[1]):
        x = found[key]
        x["leaves"] = x["n_leaves"] + x["below"] or 1
        x["saved"] = x["saved_tokens"] + x["more"] + (x["n_convs"] - 1) * x["words"]
        if key[1]:
            up = found[parent[key]]
            up["below"], up["more"], up["inner"] = up["below"] + x["leaves"], up["more"] + x["saved"], up["inner"] + 1
    for key, x in found.items():
        above = found[parent[key]]["conv_id"] if key[1] else None
        out.append((*key, x["conv_id"], above, x["n_convs"], x["n_children"] + x["inner"], x["leaves"], x["saved"]))
    return out


def ends_hashes(lists: DataFrame) -> DataFrame:
    """(border, depth, ends_sha256) of skeleton nodes, from pieces of id lists in order of shard and nth; streamed, as a hash is a chain."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        now = None
        for batch in batches:
            for border, depth, ids in zip(*batch.columns[:3], strict=True):
                key = (border.as_py(), depth.as_py())
                if now is None or key != done[-1][0]:
                    now = hashlib.sha256(ids.as_py().encode())
                    done.append((key, now))
                else:
                    now.update(f",{ids.as_py()}".encode())
        rows = [(*k, h.hexdigest()) for k, h in done]  # as many as there are skeleton nodes at most
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["border", "depth", "ends_sha256"])

    rows = lists.select("border", "depth", "shard", "nth", "ends").repartition("border", "depth").sortWithinPartitions("border", "depth", "shard", "nth")
    return rows.select("border", "depth", "ends").mapInArrow(work, "border bigint, depth bigint, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes (``NODE``) of the trie of ``convs`` (conv_id, steps, words; one row a conversation)."""
    spark = convs.sparkSession
    rows = ranges(convs.select(F.unhex(F.array_join("steps", "")).alias("path"), "conv_id", "words"), "path", "conv_id")
    order = F.struct("path", "conv_id")
    borders = rows.groupBy("__range").agg(F.min_by("path", order).alias("a"), F.max_by("path", order).alias("b")).collect()
    skel = skeleton(sorted((r["__range"], bytes(r["a"]), bytes(r["b"])) for r in borders))  # two paths a shard
    shared = spark.sparkContext.broadcast(skel)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_nodes(shared.value, batches)

    kind = ", ".join(f"{x} {'string' if x == 'ends' else 'bigint'}" for x in FIELDS)
    made = cut(rows.select("__range", "path", "words", "conv_id").mapInArrow(work, kind).withColumn("shard", F.spark_partition_id()))
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shares = made.where(F.col("kind") == PART).groupBy("border", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *total).collect()
    top = "border bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    bones = spark.createDataFrame(reduced(skel, shares), top)  # at most one path a shard
    hashes = ends_hashes(made.where(F.col("kind") == LIST))
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    inner = bones.join(hashes, ["border", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBER)))
    above = F.broadcast(bones.select(F.col("border").alias("parent_border"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("__above")))
    own = made.where(F.col("kind") == OWN).withColumnRenamed("ends", "ends_sha256").join(above, ["parent_border", "parent_depth"], "left")
    own = own.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__above"))
    return own.select(*names).unionByName(inner.select(*names))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(paths(turns)))
