"""Merkle trees of transparency logs as a table of tiles: roots of any size, and proofs, by joins.

A tree over n entries (RFC 6962) is made of perfect subtrees; (level, i) is the one over entries i * 2^level up to
(i + 1) * 2^level.  ``tile_table`` stores all of them: 2^8 neighbours at a time become a tile, which gives eight levels in
one shuffle, so that a log of billions of entries takes four.  Every root, and every hash of a proof, is the hash of an
aligned range of entries, which is a fold over at most one perfect subtree a level.

``leaves`` has log, idx (0, 1, 2, ... without gaps) and leaf_hash (hex). Logs are independent; one log is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.functions import scalars as S
from veritick.session import cut

HEIGHT = 8
TOP_NODES = 50_000  # nodes of upper levels that are broadcast: what nearly every proof needs


def _left(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, by if isinstance(by, Column) else F.lit(by))


def _right(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", x, by if isinstance(by, Column) else F.lit(by))


def _paired(name: str) -> Column:
    """Hashes of the neighbours two by two; one without a neighbour is left out."""
    return F.array_compact(F.transform(name, lambda x, p: F.when(p % 2 == 0, S.node_hash(x, F.get(F.col(name), p + 1)))))


def _placed(name: str, level: int, start: Column) -> Column:
    """Rows of the hashes of one level of a tile whose first is number ``start``."""
    return F.transform(name, lambda x, p: F.struct(F.lit(level).alias("level"), (start + p).alias("i"), x.alias("hash")))


def tile_table(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(log, level, i, hash): every perfect subtree of every log. Raises where places are missing or taken twice."""
    now = cut(leaves.select("log", F.lit(0).alias("level"), F.col("idx").cast("long").alias("i"), F.col("leaf_hash").alias("hash")))
    gaps = now.groupBy("log").agg(F.count("*").alias("n"), F.count("i").alias("placed"), F.min("i").alias("a"), F.max("i").alias("b"))
    twice = now.groupBy("log", "i").count().where("count > 1")
    if not gaps.where("placed <> n or a <> 0 or b <> n - 1").isEmpty() or not twice.isEmpty():
        raise ValueError("the entries of a log must be numbered 0, 1, 2, ...")
    table, level = now, 0
    while not now.where("i > 0").isEmpty():
        tile = now.groupBy("log", _right(F.col("i"), height).alias("t")).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("x"))
        tile = tile.select("log", "t", F.transform("x", lambda x: x["hash"]).alias("h0"))
        for k in range(height):
            tile = tile.withColumn(f"h{k + 1}", _paired(f"h{k}"))
        made = [_placed(f"h{k}", level + k, _left(F.col("t"), height - k)) for k in range(1, height + 1)]
        rows = cut(tile.select("log", F.inline(F.flatten(F.array(*made)))))
        level += height
        table, now = table.unionByName(rows), rows.where(F.col("level") == level)
    return table


def _pieces(start: Column, width: Column) -> Column:
    """The perfect subtrees of entries [start, start + width), start being a multiple of a power of two not under width; upwards."""
    bits = F.sequence(F.lit(0), F.length(F.bin(width)) - 1)
    taken = F.filter(bits, lambda b: _right(width, b) % 2 == 1)
    return F.transform(taken, lambda b: F.struct(b.alias("level"), (_right(start, b) + _right(width, b) - 1).alias("i")))


def _hashes(wanted: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, nth and hash of the ranges ``wanted`` (keys, log, nth, pieces): joins by subtree, then a fold upwards.

    Subtrees of the upper levels, as many as may be broadcast, are joined so: nearly all proofs share them.
    """
    per = {r["level"]: r["count"] for r in table.groupBy("level").count().collect()}  # a row a level
    low = max(per, default=-1) + 1
    while low and sum(n for k, n in per.items() if k >= low - 1) <= TOP_NODES:
        low -= 1
    rows = wanted.select(*keys, "log", "nth", F.inline("pieces"))
    found = rows.where(F.col("level") >= low).join(F.broadcast(table.where(F.col("level") >= low)), ["log", "level", "i"])
    if low:
        found = found.unionByName(rows.where(F.col("level") < low).join(table.where(F.col("level") < low), ["log", "level", "i"]))
    parts = found.groupBy(*keys, "nth").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("p"))
    fold = F.aggregate(F.slice("p", 2, 64), F.get("p", F.lit(0))["hash"], lambda a, x: S.node_hash(x["hash"], a))
    return parts.select(*keys, "nth", fold.alias("hash"))


def roots(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """(log, tree_size, root_hex) of ``sizes`` (log, tree_size), of those from 1 to the entries there are."""
    there = table.where("level = 0").groupBy("log").agg(F.count("*").alias("__n"))
    asked = sizes.select("log", F.col("tree_size").cast("long").alias("tree_size")).distinct().join(there, "log").where("tree_size between 1 and __n")
    wanted = asked.select("log", "tree_size", F.lit(0).alias("nth"), _pieces(F.lit(0).cast("long"), F.col("tree_size")).alias("pieces"))
    return _hashes(wanted.select("log", "tree_size", "nth", "pieces").withColumn("__log", F.col("log")).select("tree_size", "__log", "log", "nth", "pieces"), table, ["__log", "tree_size"]).select(F.col("__log").alias("log"), "tree_size", F.col("hash").alias("root_hex"))


def _beside(level: Column, i: Column, size: Column) -> Column:
    """What a path from subtree (level, i) up to the root of ``size`` entries needs: per level the range beside, if it has entries."""
    steps = F.sequence(level, F.greatest(level, F.length(F.bin(size)) - 1))

    def one(b: Column) -> Column:
        beside = _right(i, b - level).bitwiseXOR(F.lit(1).cast("long"))
        start = _left(beside, b)
        return F.when(start < size, F.struct((b + 1).alias("nth"), _pieces(start, F.least(_left(F.lit(1).cast("long"), b), size - start)).alias("pieces")))

    return F.array_compact(F.transform(steps, one))


def _proofs(asked: DataFrame, table: DataFrame, keys: list[str], ranges: Column) -> DataFrame:
    wanted = asked.select(*keys, F.col("log").alias("__log"), F.inline(ranges)).withColumnRenamed("__log", "__of")
    wanted = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__of").alias("log"), "nth", "pieces")
    found = _hashes(wanted, table, [f"__{k}" for k in keys])
    path = F.transform(F.array_sort(F.collect_list(F.struct("nth", "hash"))), lambda x: x["hash"])
    return found.groupBy(*[F.col(f"__{k}").alias(k) for k in keys]).agg(path.alias("path"))


def _edges(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(log, tree_size, edges): by level b, the hash of the last size mod 2^b entries of each tree, where there are any."""
    sizes = asked.select("log", "tree_size").distinct()
    size, levels = F.col("tree_size"), F.sequence(F.lit(0), F.length(F.bin("tree_size")))

    def one(b: Column) -> Column:
        start = _left(_right(size, b), b)
        return F.when(start < size, F.struct(b.alias("nth"), _pieces(start, size - start).alias("pieces")))

    wanted = sizes.select(F.col("log").alias("__log"), "tree_size", "log", F.inline(F.array_compact(F.transform(levels, one))))
    found = _hashes(wanted, table, ["__log", "tree_size"])
    found = cut(found.groupBy(F.col("__log").alias("log"), "tree_size").agg(F.map_from_entries(F.collect_list(F.struct("nth", "hash"))).alias("edges")))
    return F.broadcast(found) if found.count() <= TOP_NODES else found


def _within(wanted: DataFrame, table: DataFrame, edges: DataFrame, low: int, above: DataFrame | None) -> DataFrame:
    """(log, tree_size, i, hash, path) of nodes ``wanted`` (log, tree_size, i) of level ``low``: their path in a tile, then that ``above`` it.

    A tile is one row, and so are the nodes of a tree that are asked for in it: a path is put together where they meet.
    """
    tile = table.where(F.col("level").between(low, low + HEIGHT - 1)).withColumn("t", _right(F.col("i"), (HEIGHT + low) - F.col("level")))
    at = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == low + k, F.struct("i", "hash")))), lambda x: x["hash"])
    tile = tile.groupBy("log", "t").agg(*[at(k).alias(f"h{k}") for k in range(HEIGHT)])
    rows = wanted.groupBy("log", "tree_size", _right(F.col("i"), HEIGHT).alias("t")).agg(F.collect_set("i").alias("all"))
    rows = rows.join(tile, ["log", "t"], "left").join(edges, ["log", "tree_size"], "left")
    rows = rows.withColumn("up", F.array().cast("array<string>")) if above is None else rows.join(above.select("log", "tree_size", F.col("i").alias("t"), F.col("path").alias("up")), ["log", "tree_size", "t"])
    size, t = F.col("tree_size"), F.col("t")

    def step(i: Column, k: int) -> Column:
        beside = _right(i, k).bitwiseXOR(F.lit(1).cast("long"))
        start = _left(beside, low + k)
        full = F.get(F.col(f"h{k}"), (beside - _left(t, HEIGHT - k)).cast("int"))
        return F.when(start + (1 << low + k) <= size, full).when(start < size, F.try_element_at("edges", F.lit(low + k)))

    one = lambda i: F.struct(i.alias("i"), F.get("h0", (i - _left(t, HEIGHT)).cast("int")).alias("hash"), F.concat(F.array_compact(F.array(*[step(i, k) for k in range(HEIGHT)])), "up").alias("path"))
    return rows.select("log", "tree_size", F.inline(F.transform("all", one)))


def inclusion_proofs(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(log, leaf_index, tree_size, leaf_hash, path) for ``asked`` (log, leaf_index, tree_size): PATH(m, D[n]) of RFC 6962, from the leaf upwards.

    Of entries that lie in the tree and trees that lie in the log; others have no row.  Entries of one tile share the path
    above it, so that hashes are joined by tile and not by entry and level.
    """
    there = cut(table.where("level = 0").groupBy("log").agg(F.count("*").alias("__n")))
    there = F.broadcast(there) if there.count() <= TOP_NODES else there
    asked = asked.select("log", *[F.col(k).cast("long").alias(k) for k in ("leaf_index", "tree_size")]).join(there, "log").where("leaf_index >= 0 and leaf_index < tree_size and tree_size <= __n")
    wanted = [asked.select("log", "tree_size", F.col("leaf_index").alias("i"))]
    top = table.agg(F.max("level")).first()[0] or 0
    for _ in range(top // HEIGHT):
        wanted.append(cut(wanted[-1].select("log", "tree_size", _right(F.col("i"), HEIGHT).alias("i")).distinct()))
    edges, paths = _edges(table, wanted[-1]), None
    for k in reversed(range(len(wanted))):
        paths = _within(wanted[k], table, edges, k * HEIGHT, paths)
        paths = cut(paths) if k else paths
    return paths.select("log", F.col("i").alias("leaf_index"), "tree_size", F.col("hash").alias("leaf_hash"), "path")


def consistency_proofs(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(log, first_size, second_size, proof) for ``asked`` (log, first_size, second_size): PROOF(m, D[n]) of RFC 6962.

    It is the last perfect subtree of the old tree (left out where it is the whole old tree) and that subtree's path in the
    new one. Of pairs with 1 <= first <= second <= entries; others have no row.
    """
    keys = ["log", "first_size", "second_size"]
    there = table.where("level = 0").groupBy("log").agg(F.count("*").alias("__n"))
    asked = asked.select("log", *[F.col(k).cast("long").alias(k) for k in keys[1:]]).distinct().join(there, "log").where("first_size between 1 and second_size and second_size <= __n")
    m = F.col("first_size")
    level = F.length(F.bin(m)) - F.length(F.rtrim(F.bin(m), F.lit("0")))
    asked = asked.withColumn("__level", level).withColumn("__i", _right(m, F.col("__level")) - 1)
    own = F.struct(F.lit(0).alias("nth"), F.array(F.struct(F.col("__level").alias("level"), F.col("__i").alias("i"))).alias("pieces"))
    ranges = F.concat(F.when(F.col("__i") > 0, F.array(own)).otherwise(F.filter(F.array(own), lambda _: F.lit(False))), _beside(F.col("__level"), F.col("__i"), F.col("second_size")))
    ranges = F.when(m == F.col("second_size"), F.filter(ranges, lambda _: F.lit(False))).otherwise(ranges)
    paths = _proofs(asked, table, keys, ranges)
    return asked.join(paths, keys, "left").select(*keys, F.coalesce("path", F.array().cast("array<string>")).alias("proof"))
