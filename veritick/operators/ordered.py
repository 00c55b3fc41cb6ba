"""Order-dependent steps without one task per key: ranges of the order are the unit of work, borders are carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritick.session import cut


def ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, stored, with the number of the range as ``__range``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("__range", F.spark_partition_id())


def with_previous(df: DataFrame, key: str, order: str, take: list[str], into: str, ahead: bool = False) -> DataFrame:
    """Adds ``into``: the columns ``take`` of the row before (or after) in ``order`` within ``key``, null at the border.

    A key of very many rows is spread over ranges; a range takes the border row of the one next to it, so that only one
    row per range and key meets in a window by key. Nulls are a key like any other. Rows of equal order are neighbours in
    no fixed order.
    """
    rows = ranges(df, key, order)
    way = F.desc_nulls_last(order) if ahead else F.asc_nulls_first(order)
    w = Window.partitionBy("__range", key).orderBy(way)
    inside = rows.withColumns({into: F.lag(F.struct(*take)).over(w), "__nth": F.row_number().over(w)})
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    border = (F.min_by if ahead else F.max_by)(F.struct(*take), place)
    ends = rows.groupBy("__range", key).agg(border.alias("__end"))
    by = Window.partitionBy(key).orderBy(F.desc("__range") if ahead else F.asc("__range"))
    carried = ends.select(F.col("__range").alias("__r"), F.col(key).alias("__k"), F.lag("__end").over(by).alias("__carried"))
    both = inside.join(carried, (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")))
    return both.withColumn(into, F.when(F.col("__nth") == 1, F.col("__carried")).otherwise(F.col(into))).drop("__range", "__nth", "__r", "__k", "__carried")


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``idx``, the place from 0 of a row within ``key`` (nulls first; a null key is a key), and ``n``, the rows of the key.

    Rows are counted by range and key; only these counts meet in a window by key, so that one key fills as many tasks as
    it needs. Rows of equal order stand in no fixed order, but one that stays.
    """
    rows = ranges(df.drop("idx", "n"), key, order).withColumn("__at", F.monotonically_increasing_id())
    starts = rows.groupBy("__range", key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("__range").alias("__r"), F.col(key).alias("__k"), (F.col("__first") - before).alias("__shift"), F.sum("__n").over(w).alias("n"))
    both = rows.join(starts, (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")))
    return both.withColumn("idx", F.col("__at") - F.col("__shift")).drop("__range", "__r", "__k", "__at", "__shift")


def with_halo(df: DataFrame, key: str, order: str, size: int, halo: int, after: int = 0) -> DataFrame:
    """Rows in blocks of ``size`` neighbours of a key, each with the ``halo`` rows before it and the ``after`` rows behind it.

    Adds idx, n, block and ``own`` (false for the copies from the blocks beside). A window by (key, block) ordered by idx
    that looks back no more than ``halo`` rows is right for all own rows, however long a key is.
    """
    if not 0 <= max(halo, after) <= size:
        raise ValueError("a halo comes from the next block alone")
    at, block = F.col("idx") % size, F.floor(F.col("idx") / size)
    place = lambda b, own: F.struct(b.cast("long").alias("block"), F.lit(own).alias("own"))
    spots = F.array_compact(F.array(place(block, True), F.when(at >= size - halo, place(block + 1, False)), F.when((at < after) & (block > 0), place(block - 1, False))))
    return positions(df, key, order).select("*", F.inline(spots))


JOINED = {"max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "last": lambda a, b: F.coalesce(b, a)}  # of what comes before and what is here


def running(df: DataFrame, key: str, order: str, size: int = 65_536, **scans: tuple) -> DataFrame:
    """Adds running aggregates within ``key`` in ``order``: name=(kind, value), or (kind, value, -1) for the rows before this one.

    kind is max, sum or last (of those not null). A segmented scan: blocks of ``size`` neighbours are scanned by themselves,
    and the totals of the blocks before (one row a block and key) are carried in. Adds idx and n as well.
    """
    kinds = {x: s[0] for x, s in scans.items()}
    rows = positions(df.withColumns({f"__v_{x}": s[1] for x, s in scans.items()}), key, order).withColumn("__block", F.floor(F.col("idx") / size))
    w = Window.partitionBy(key, "__block").orderBy("idx")
    here = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx")))}
    local = rows.withColumns({x: here[s[0]](f"__v_{x}").over(w.rowsBetween(Window.unboundedPreceding, s[2] if len(s) > 2 else 0)) for x, s in scans.items()})
    totals = rows.groupBy(key, "__block").agg(*[total[k](f"__v_{x}").alias(f"__v_{x}") for x, k in kinds.items()])
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), *[here[k](f"__v_{x}").over(earlier).alias(f"__c_{x}") for x, k in kinds.items()])
    both = local.join(carried, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")))
    out = both.withColumns({x: JOINED[k](F.col(f"__c_{x}"), F.col(x)) for x, k in kinds.items()})
    return out.drop("__block", "__k", "__b", *[f"{p}_{x}" for x in scans for p in ("__v", "__c")])


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): exact, of the non-null values of few keys, however many values each has.

    Values are sorted by ranges; counts per range and key (what comes to the driver) tell where the middle rows lie.
    """
    rows = ranges(df.where(F.col(value).isNotNull()).select(key, value), key, value)
    sizes: dict = {}
    for r in rows.groupBy(key, "__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        sizes.setdefault(r[key], []).append((r["__range"], r["n"]))
    wanted = []
    for k, parts in sizes.items():
        n = sum(c for _, c in parts)
        for place in {(n - 1) // 2, n // 2}:
            for part, c in parts:
                if place < c:
                    wanted.append((k, part, place + 1))
                    break
                place -= c
    kind = df.schema[key].dataType.simpleString()
    spots = F.broadcast(df.sparkSession.createDataFrame(wanted, f"`{key}` {kind}, __range int, __nth int"))
    some = rows.join(spots.select(key, "__range").distinct(), [key, "__range"], "left_semi")
    ranked = some.withColumn("__nth", F.row_number().over(Window.partitionBy("__range", key).orderBy(value)))
    return ranked.join(spots, [key, "__range", "__nth"]).groupBy(key).agg(F.avg(value).alias("median"))


