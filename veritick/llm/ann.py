"""Nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Inner products are turned into Euclidean distances by one extra coordinate, ``sqrt(R^2 - |x|^2)`` with ``R`` the
largest norm (0 for queries), so that Gaussian (2-stable) projections ``floor((a.x + b) / w)`` apply.  A query visits,
in every table, its own bucket and then perturbed buckets in the order of their estimated success (the sum of squared
distances to the bucket borders that a perturbation crosses).  The number of visited buckets is the smallest of
``ladder`` that reaches ``target`` recall on a bounded sample of queries compared with brute force over all rows; the
last rung visits every bucket, which is exact search, so no bound on probes can lose neighbours unnoticed.

Work is dealt by *cell*: a hash of (table, bucket, block), where a bucket of over ``block`` vectors is split in blocks
of that size and a probe goes to each block.  A vector travels once per table, a query once per cell that it visits; a
cell that over ``block`` queries visit meets them in blocks too.  In exact search a vector travels once, to a block of
its own, and every query visits every block.  Of equal vectors only the ``k + 1`` of smallest id are candidates: no
other can be among the k nearest.  Every cell keeps the ``k`` best of each query, and one window per query merges them.

Edge cases: null, empty and zero vectors, those with null or non-finite components and those whose length is not the
most common one take no part, as candidate or as query; rows with null ids neither. Repeated rows with one id and one
vector count once. Ties go to the smaller id. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritick.session import cut

RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Plan:
    """Fixed hash functions, the same in every task."""

    dim: int
    radius: float
    n_rows: int
    tables: int = 4
    width: float = 3.0
    block: int = 1024
    seed: int = 7
    n_hash: int = 6
    probes: int = 0

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.standard_normal((self.tables, self.dim + 1, self.n_hash))
        return a, rng.uniform(0, self.width, (self.tables, self.n_hash))

    @property
    def cells(self) -> int:
        return max(16, self.tables * self.n_rows // self.block)


def hash_count(n_rows: int, per_bucket: int = 4096) -> int:
    """Projections per table: buckets shrink as the corpus grows (about 2.5 occupied slots per projection)."""
    return int(max(6, np.ceil(np.log(max(n_rows, 1) / per_bucket) / np.log(2.5))))


def perturbations(n_hash: int) -> np.ndarray:
    """Every vector of -1, 0, 1 for few projections, else those of at most three moves."""
    if n_hash <= 6:
        return np.array(list(itertools.product((0, -1, 1), repeat=n_hash)), dtype=np.int64)
    rows = [np.zeros(n_hash, dtype=np.int64)]
    for moves in (1, 2, 3):
        for where in itertools.combinations(range(n_hash), moves):
            for signs in itertools.product((-1, 1), repeat=moves):
                rows.append(np.zeros(n_hash, dtype=np.int64))
                rows[-1][list(where)] = signs
    return np.array(rows)


def slots(plan: Plan, x: np.ndarray, query: bool) -> list[np.ndarray]:
    """Per table, the real-valued slot of each row; its floor is the bucket."""
    a, b = plan.functions()
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(plan.radius**2 - (x * x).sum(axis=1), 0))
    full = np.concatenate([x, extra[:, None]], axis=1)
    return [(full @ a[t] + b[t]) / plan.width for t in range(plan.tables)]


def key_of(bucket: np.ndarray, table: int) -> np.ndarray:
    """A 63-bit key of (table, bucket) by multiply and xor-shift."""
    h = np.full(bucket.shape[:-1], table + 1, dtype=np.uint64)
    for j in range(bucket.shape[-1]):
        h = (h ^ bucket[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def probe_order(slot: np.ndarray, moves: np.ndarray, width: float, n: int) -> np.ndarray:
    """The n best perturbations of each row, best first."""
    inside = slot - np.floor(slot)
    cost = (moves == -1).astype(float) @ (inside.T * width) ** 2 + (moves == 1).astype(float) @ ((1 - inside.T) * width) ** 2
    return np.argsort(cost.T, axis=1, kind="stable")[:, :n]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, float, int]:
    """Valid rows as (id, v), with their dimension, largest norm and number."""
    v = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square: Column = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(~bad).withColumn("sq", square).where("sq > 0")
    by_size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("sq").alias("sq")).orderBy(F.desc("n"), "d").take(1)
    if not by_size:
        return rows.select("id", "v"), 0, 0.0, 0
    d = by_size[0]
    return rows.where(F.size("v") == d["d"]).select("id", "v").dropDuplicates(["id", "v"]), d["d"], float(d["sq"]) ** 0.5, d["n"]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order: equal vectors get equal scores wherever they lie."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def best_of(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of x for each query, but its own: a matrix product selects, exact sums decide at the border."""
    out = []
    for lo in range(0, len(q), 512):
        s = q[lo : lo + 512] @ x.T
        s[q_ids[lo : lo + 512, None] == ids[None, :]] = -np.inf
        if x.shape[0] > k:
            border = np.partition(s, -k, axis=1)[:, -k]
            near = s >= (border - 1e-9 * (1 + np.abs(border)))[:, None]
            near &= np.isfinite(s)
        else:
            near = np.isfinite(s)
        a, b = np.nonzero(near)
        score = exact_scores(q[lo + a], x[b])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        out.append((q_ids[lo + a[keep]], ids[b[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def calibrate(rows: DataFrame, queries: DataFrame, plan: Plan, k: int, sample: int, ladder: tuple, target: float) -> int:
    """Probes per table that find ``target`` of the true neighbours of at most ``sample`` queries; 0: visit all buckets."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not chosen:
        return ladder[0]
    q_ids = np.array([r["id"] for r in chosen])
    q = np.array([r["v"] for r in chosen], dtype=float)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b, s = best_of(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float), q_ids, q, k)
                yield pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.mapInPandas(scan, FOUND).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    links = true.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v").collect()
    if not links:
        return ladder[0]
    at = {i: n for n, i in enumerate(q_ids.tolist())}
    who = np.array([at[r["query_id"]] for r in links])
    x = np.array([r["v"] for r in links], dtype=float)
    moves = perturbations(plan.n_hash)
    rank = np.full(len(links), len(moves) + 1)
    for sq, sx in zip(slots(plan, q, True), slots(plan, x, False), strict=True):
        order = probe_order(sq, moves, plan.width, len(moves))
        delta = np.floor(sx) - np.floor(sq)[who]
        same = (moves[None, :, :] == delta[:, None, :]).all(axis=2) if len(links) * len(moves) < 4e6 else np.array([(moves == d).all(axis=1) for d in delta])
        hit = same.any(axis=1)
        place = np.argsort(order, axis=1)[who, same.argmax(axis=1)]
        rank = np.minimum(rank, np.where(hit, place, len(moves) + 1))
    for n in ladder:
        if (rank < n).mean() >= target:
            return n
    return 0


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", *, tables: int = 4,
    width: float = 3.0, block: int = 1024, seed: int = 7, sample: int = 128, target: float = 0.95, ladder: tuple = (4, 8, 16, 32, 64, 128, 256),
) -> DataFrame:
    """Each query's k nearest other rows (``RESULT``). ``is_query`` is a condition on column ``id``; ``width`` is in units of the largest norm."""
    rows, dim, radius, n = usable(vectors, vec_id, vector)
    if not n:
        return vectors.sparkSession.createDataFrame([], RESULT)
    spark, kind = vectors.sparkSession, vectors.schema[vector].dataType.simpleString()
    rows = cut(rows)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = cut(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    queries, n = rows.where(is_query), candidates.count()
    step = width * radius  # the same buckets for the same vectors in another unit
    plan = Plan(dim, radius, n, tables, step, block, seed, hash_count(n))
    plan = Plan(dim, radius, n, tables, step, block, seed, plan.n_hash, calibrate(candidates, queries, plan, k, sample, ladder, target))
    data, asks = by_probes(candidates, queries, plan, kind) if plan.probes else by_blocks(candidates, queries, plan)

    if queries.count() > block:  # else no cell has more
        busy = asks.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
        busy = sized(cut(busy.select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))), 12)
        parts = F.coalesce("parts", F.lit(1))
        data = data.join(busy, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        asks = asks.join(busy, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    else:
        data, asks = data.withColumn("part", F.lit(0)), asks.withColumn("part", F.lit(0))

    def meet(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(data) or not len(asks):
            return none
        x, ids, key = np.stack(data["v"].to_numpy()).astype(float), data["id"].to_numpy(), data["key"].to_numpy()
        q, q_ids = np.stack(asks["v"].to_numpy()).astype(float), asks["id"].to_numpy()
        if not plan.probes:
            return pd.DataFrame(dict(zip(none.columns, best_of(ids, x, q_ids, q, k), strict=True)))
        order = np.argsort(key, kind="stable")
        x, ids, key = x[order], ids[order], key[order]
        n_keys = asks["keys"].str.len().to_numpy()
        asked, who = np.concatenate(asks["keys"].to_numpy()), np.repeat(np.arange(len(q)), n_keys)
        found = []
        for u in np.unique(asked[np.isin(asked, key)]):
            lo, hi = np.searchsorted(key, [u, u + 1])
            some = who[asked == u]
            found.append(pd.DataFrame(dict(zip(none.columns, best_of(ids[lo:hi], x[lo:hi], q_ids[some], q[some], k), strict=True))))
        if not found:
            return none
        all_found = pd.concat(found).drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return all_found[all_found.groupby("query_id").cumcount() < k]

    found = data.groupBy("cell", "part").cogroup(asks.groupBy("cell", "part")).applyInPandas(meet, FOUND)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sized(df: DataFrame, row_bytes: int, most: int = 8 << 20) -> DataFrame:
    """A stored table, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def by_blocks(candidates: DataFrame, queries: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Exact search: each vector lies in one block, each query visits all."""
    n = max(1, -(-plan.n_rows // plan.block))
    data = candidates.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long").alias("cell"), F.lit(0).cast("long").alias("key"), "id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("cell")
    return data, queries.select(every, "id", "v", F.array().cast("array<bigint>").alias("keys"))


def by_probes(candidates: DataFrame, queries: DataFrame, plan: Plan, kind: str) -> tuple[DataFrame, DataFrame]:
    """(cell, key, id, v) of the vectors in every table, and (cell, id, v, keys) of the queries in the cells they visit."""
    moves = perturbations(plan.n_hash)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                for t, s in enumerate(slots(plan, x, False)):
                    yield pd.DataFrame({"key": key_of(np.floor(s).astype(np.int64), t), "id": pdf["id"], "v": pdf["v"]})

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for t, s in enumerate(slots(plan, x, True)):
                order = probe_order(s, moves, plan.width, plan.probes)
                key = key_of(np.floor(s).astype(np.int64)[:, None, :] + moves[order], t)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "keys": list(key)})

    def cell(block: Column) -> Column:
        return F.pmod(F.xxhash64("key", block), F.lit(plan.cells))

    hashed = candidates.mapInPandas(keyed, f"key long, id long, v {kind}")
    hot = hashed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > plan.block)
    hot = sized(cut(hot.select("key", F.ceil(F.col("n") / plan.block).cast("long").alias("blocks"))), 16)
    blocks = F.coalesce("blocks", F.lit(1))
    data = hashed.join(hot, "key", "left").select(cell(F.pmod(F.xxhash64("id"), blocks)).alias("cell"), "key", "id", "v")
    probes = queries.mapInPandas(probing, f"id long, v {kind}, keys array<long>").select("id", "v", F.explode("keys").alias("key"))
    spread = probes.join(hot, "key", "left").select("id", "v", "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    asks = spread.select(cell(F.col("block")).alias("cell"), "id", "v", "key").groupBy("cell", "id").agg(F.first("v").alias("v"), F.collect_set("key").alias("keys"))
    return data, asks


def op1_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of ``embeddings`` for every row whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
