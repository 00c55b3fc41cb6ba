"""Rolling features and decisions: windows of rows per asset, all sharing one partitioning by asset.

``bars`` has asset, t_ms, close; one row per asset and time.  A window of N means N rows, never N days.

``rolling`` gives the features of any number of look-backs from exact running sums: each is a difference of two of them
(``look_backs``, over batches of rows in order), so that a further look-back costs no window.  Its partitions are whole histories, which
suits daily bars; with ``block`` they are stretches of that many rows with a halo of the longest look-back before them,
so that a single asset of many ticks fills all tasks.  ``z_score`` and ``annualized_vol`` are the same as window functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritick.functions import scalars as S
from veritick.operators.ordered import running, with_halo

YEAR = 365.0


@dataclass(frozen=True)
class Params:
    """Look-backs and thresholds of one strategy cell."""

    momentum: int = 28
    z_window: int = 20
    z_entry: float = 1.0
    vol_window: int = 30
    fraction: float = 0.2

    @property
    def warmup(self) -> int:
        return max(self.momentum, self.z_window, self.vol_window) + 2


# The declared grid, reported whole and in this order.
GRID = (Params(14), Params(28), Params(56), Params(28, 10, 1.5), Params(28, 30, 0.5))


def by_time() -> Window:
    return Window.partitionBy("asset").orderBy("t_ms")


def with_bar_index(bars: DataFrame) -> DataFrame:
    """Adds bar_idx, the 0-based position; the number of observations up to a bar is bar_idx (closes less one)."""
    return bars.withColumn("bar_idx", F.row_number().over(by_time()) - 1)


def period_return(lookback: int) -> Column:
    then = F.lag("close", lookback).over(by_time())
    return F.when((then > 0) & S.finite("close").isNotNull(), S.finite("close") / then - 1)


def mean_std(window: Window, value: Column | str = "close") -> tuple[Column, Column]:
    """Population mean and standard deviation; null for under two rows, exactly 0 where all values are equal."""
    v = S.col(value)
    enough = F.count(v).over(window) >= 2
    flat = F.max(v).over(window) == F.min(v).over(window)
    return F.when(enough, F.avg(v).over(window)), F.when(enough, F.when(flat, 0.0).otherwise(F.stddev_pop(v).over(window)))


def z_score(n: int) -> Column:
    """(close - mean) / std over the n bars before the current one."""
    mean, std = mean_std(by_time().rowsBetween(-n, -1))
    return F.when((F.row_number().over(by_time()) > n) & (std > 0), (F.col("close") - mean) / std)


def with_log_return(bars: DataFrame) -> DataFrame:
    """Adds log_return; null at the first bar and where one of the two closes is not positive."""
    before = F.lag("close").over(by_time())
    return bars.withColumn("log_return", F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before)))


def annualized_vol(n: int) -> Column:
    """Deviation of the last n log returns (what there is of them, two at least), today's included; needs log_return."""
    _, std = mean_std(by_time().rowsBetween(-(n - 1), 0), "log_return")
    sound = F.min("close").over(by_time().rowsBetween(-n, 0)) > 0
    return F.when(sound, std * F.sqrt(F.lit(YEAR)))


def exact_std(window: Window, value: str = "close") -> Column:
    """Two-pass standard deviation in row order, for bit-equal replays; collects the window's rows."""
    xs = F.collect_list(value).over(window)
    add = lambda f: lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    mean = add(lambda v: v)(xs) / F.size(xs)
    return F.when(F.size(xs) >= 2, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(xs)))


def by_asset(df: DataFrame) -> DataFrame:
    """Dealt by asset to the session's number of shuffle partitions.

    Replays cost far more per byte than adaptive coalescing assumes, which would put small bars into a single task; all
    windows and groups by asset downstream reuse this partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "asset")


DIGITS, LOG_UNIT = 14, 1e14  # closes are counted in units of 1e-14 of the greatest of a partition, log returns in 1e-14


def sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])


def spreads(x: np.ndarray, deep: int):
    """(lo, hi, n) -> n times the population deviation of the n integers among x[lo:hi] (others are 0), from exact sums; hi - lo is ``deep`` at most.

    An integer is taken as two of 24 bits, so that sums of products stay within 64 bits; where they would not, they are Python's.
    """
    if len(x) >= 1 << 14 or deep > 128 or (np.abs(x) >= 1 << 47).any():
        whole = x.astype(object)
        total, square = sums(whole), sums(whole * whole)

        def plain(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
            t = total[hi] - total[lo]
            return np.sqrt((n.astype(object) * (square[hi] - square[lo]) - t * t).astype(float))

        return plain
    high, low = x >> 24, x & (1 << 24) - 1
    running = [sums(y) for y in (high, low, high * high, high * low, low * low)]

    def spread(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        h, l, hh, hl, ll = (y[hi] - y[lo] for y in running)  # noqa: E741
        a, b, c = n * hh - h * h, n * hl - h * l, n * ll - l * l  # the square is a * 2^48 + b * 2^25 + c
        b += c >> 25
        a += b >> 23
        rest = ((b & (1 << 23) - 1) << 25) + (c & (1 << 25) - 1)
        square = a * 2.0**48 + rest
        for j in np.flatnonzero(a >= 1 << 53).tolist():  # rounded once, as all others
            square[j] = float((int(a[j]) << 48) + int(rest[j]))
        return np.sqrt(square)

    return spread


def look_backs(z: list[int], vol: list[int]):
    """z_N and vol_N of rows that come in order, as a struct, from (place in the partition from 1, close in units, whether there is one, log return in its units, whether there is one, close <= 0).

    A look-back is a difference of two exact running sums: integers, so that nothing cancels. What is carried from batch
    to batch is as many rows as the longest look-back has; rows that are not neighbours stop the job. It is not
    deterministic to Spark, so that no filter is moved below it.
    """
    deep = max([1, *(k + 1 for k in (*z, *vol))])


    def whole(x: np.ndarray) -> np.ndarray:
        """The nearest integers, half away from zero; 0 for what is missing."""
        x = np.where(np.isnan(x), 0.0, x)
        return np.copysign(np.floor(np.abs(x) + 0.5), x).astype(np.int64)

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            new = [x.to_numpy() for x in batch]
            new[1], new[3] = whole(new[1]), whole(new[3])
            at, units, there, logs, logged, bad = new if kept is None else [np.concatenate(p) for p in zip(kept, new, strict=True)]
            first = len(at) - len(new[0])
            if ((at[1:] != 1) & (at[1:] != at[:-1] + 1)).any() or (kept is None and len(at) and at[0] != 1):
                raise ValueError("look-backs need the rows of a partition in order")
            i = np.arange(first, len(at))
            start = i - at[first:] + 1
            n_units, n_logs, n_bad, s = (sums(x.astype(np.int64)) for x in (there, logged, bad, units))
            of_units, of_logs = (spreads(x.astype(np.int64), deep) for x in (units, logs))
            found = {}
            with np.errstate(invalid="ignore", divide="ignore"):
                for k in z:
                    lo = np.maximum(i - k, 0)
                    n, total = n_units[i] - n_units[lo], s[i] - s[lo]
                    wide = of_units(lo, i, n)
                    found[f"z_{k}"] = np.where((at[first:] > k) & (n >= 2) & (wide > 0) & there[first:], (units[first:] * n - total) / wide, np.nan)
                for k in vol:
                    lo = np.maximum(np.maximum(i - k + 1, start), 0)
                    n = n_logs[i + 1] - n_logs[lo]
                    wide = of_logs(lo, i + 1, n)
                    sound = n_bad[i + 1] == n_bad[np.maximum(np.maximum(i - k, start), 0)]
                    found[f"vol_{k}"] = np.where(sound & (n >= 2), wide / n / LOG_UNIT * math.sqrt(YEAR), np.nan)
            kept = [x[-deep:] for x in (at, units, there, logs, logged, bad)]
            yield pd.DataFrame(found)

    kinds = ", ".join([f"z_{k} double" for k in z] + [f"vol_{k} double" for k in vol])
    return F.pandas_udf(work, kinds).asNondeterministic()


def rolling(bars: DataFrame, ret: set[int] = frozenset(), z: set[int] = frozenset(), vol: set[int] = frozenset(), block: int | None = None, last: bool = False, dealt: bool = False) -> DataFrame:
    """``bars`` with bar_idx, n (bars of the asset), next_close, next_t_ms, log_return and ret_L, z_N, vol_N for the look-backs asked for.

    Closes that are not finite count as missing. With ``last`` only the last bar of each asset comes out, and look-backs see no
    more bars than they need. ``dealt``: the bars are dealt by asset already.
    """
    deep = max([1, *ret, *z, *(v + 1 for v in vol)])
    if block is None:
        part, df = ("asset",), bars if dealt else by_asset(bars)
        if last:
            df = df.withColumns({"bar_idx": F.row_number().over(by_time()) - 1, "__later": F.lead(F.lit(1), deep + 1).over(by_time())}).where("__later is null").drop("__later")
    else:
        part, df = ("asset", "block"), with_halo(bars, "asset", "t_ms", block, deep + 1, 1).withColumnRenamed("idx", "bar_idx")
    w = Window.partitionBy(*part).orderBy("t_ms")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close, at = S.finite("close"), F.row_number().over(w)
    steps = {"next_close": F.lead("close").over(w), "next_t_ms": F.lead("t_ms").over(w), "__at": at, "__before": F.lag("close").over(w)}
    steps |= {f"__close_{k}": F.lag("close", k).over(w) for k in ret}
    if z:
        steps["__top"] = F.max(F.abs(close)).over(every)
    if block is None:
        steps |= {"n": F.max("bar_idx").over(every) + F.lit(1).cast("long")} if last else {"bar_idx": at - 1, "n": F.count("*").over(every)}
    df = df.withColumns(steps)
    before = S.finite("__before")
    df = df.withColumn("log_return", F.when((before > 0) & (close > 0), F.ln(close / before)))
    found = {f"ret_{k}": F.when((F.col(f"__close_{k}") > 0) & close.isNotNull(), close / F.col(f"__close_{k}") - 1) for k in ret}
    if z or vol:
        digits = F.when(F.col("__top") > 0, DIGITS - F.ceil(F.log10("__top"))).otherwise(0).cast("double") if z else None
        units = close * F.pow(F.lit(10.0), digits) if z else F.lit(0.0)
        given = (F.col("__at").cast("long"), units, close.isNotNull(), F.col("log_return") * F.lit(LOG_UNIT), F.col("log_return").isNotNull(), F.coalesce(close <= 0, F.lit(False)))
        df = df.withColumn("__looks", look_backs(sorted(z), sorted(vol))(*given))
        found |= {c: F.col("__looks")[c] for c in (*(f"z_{k}" for k in z), *(f"vol_{k}" for k in vol))}
    df = df.withColumns(found)
    if block is not None:
        df = df.where("own").drop("own", "block")
    if last:
        df = df.where("bar_idx = n - 1")
    return df.drop("__at", "__before", "__top", "__looks", *[c for c in steps if c.startswith("__close_")])


def with_features(bars: DataFrame, cells: tuple[Params, ...] = (Params(),), block: int | None = None, last: bool = False, dealt: bool = False) -> DataFrame:
    """``rolling`` with one column per distinct look-back of the cells: ret_L, z_N, vol_N."""
    return rolling(bars, {c.momentum for c in cells}, {c.z_window for c in cells}, {c.vol_window for c in cells}, block, last, dealt)


def of_cell(c: Params) -> tuple[Column, Column, Column]:
    return F.col(f"ret_{c.momentum}"), F.col(f"z_{c.z_window}"), F.col(f"vol_{c.vol_window}")


def action(ret: Column, z: Column, vol: Column, z_entry: Column | float) -> Column:
    entry = z_entry if isinstance(z_entry, Column) else F.lit(z_entry)
    return (
        F.when(ret.isNull() | z.isNull() | vol.isNull(), "ABSTAIN")
        .when((ret > 0) & ((z <= -entry) | (F.abs(z) < entry)), "ENTER_LONG")
        .when((z >= 0) & (ret <= 0), "EXIT_LONG")
        .otherwise("HOLD")
    )


def with_scores(df: DataFrame, ret: Column, z: Column, vol: Column, n_obs: Column, momentum: Column, z_entry: Column) -> DataFrame:
    """Adds momentum, reversion and sample scores and their capped geometric mean, conviction; null where any feature is."""
    known = ret.isNotNull() & z.isNotNull() & vol.isNotNull()
    scale = F.greatest(vol / F.sqrt(F.lit(YEAR)) * F.sqrt(momentum.cast("double")), F.lit(1e-9))
    # what a rule names more than once is a column first, else it is worked out each time
    df = df.withColumns({"__trend": F.when(known, ret / scale), "__back": F.when(known, -z / F.greatest(z_entry, F.lit(1e-9)))})
    df = df.withColumn("sample", F.when(known, F.coalesce(S.hoeffding_confidence(n_obs, 0.01, -0.5, 0.5), F.lit(0.0))))
    df = df.withColumns({"momentum": S.squash01("__trend"), "reversion": S.squash01("__back")})
    third, zero = F.lit(1.0 / 3), F.least("momentum", "reversion", "sample") == 0
    mean = F.when(zero, 0.0).otherwise(F.exp(third * F.ln("momentum") + third * F.ln("reversion") + third * F.ln("sample")))
    df = df.withColumn("__mean", mean).withColumn("conviction", S.cap_trust("__mean"))
    return df.drop("__trend", "__back", "__mean")


def with_decision(bars: DataFrame, p: Params = Params(), block: int | None = None, last: bool = False) -> DataFrame:
    """Features, scores and action of every bar (with ``last``, of the last one of each asset) under one cell."""
    ret, z, vol = of_cell(p)
    df = with_scores(with_features(bars, (p,), block, last), ret, z, vol, F.col("bar_idx"), F.lit(p.momentum), F.lit(p.z_entry))
    return df.withColumn("action", action(ret, z, vol, p.z_entry))


def with_next_fill(df: DataFrame, *keys: str) -> DataFrame:
    """Adds next_close and next_t_ms: where a decision at this close is filled."""
    w = Window.partitionBy("asset", *keys).orderBy("t_ms")
    return df.withColumns({"next_close": F.lead("close").over(w), "next_t_ms": F.lead("t_ms").over(w)})


def with_position(df: DataFrame, *keys: str, block: int | None = None) -> DataFrame:
    """Adds position (LONG or FLAT after the bar's decision) and traded (BUY, SELL or null).

    With ``block``, the last decision to move is carried from block to block of that many bars (``ordered.running``), so
    that one asset need not fit a task.
    """
    move = F.when(F.col("action").isin("ENTER_LONG", "EXIT_LONG"), F.col("action"))
    if block is None:
        w = Window.partitionBy("asset", *keys).orderBy("t_ms")
        last = lambda upto: F.last(move, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto))
        df = df.withColumns({"__now": last(0), "__was": last(-1)})
    else:
        df = running(df.withColumn("__key", F.struct("asset", *keys)), "__key", "t_ms", block, __now=("last", move), __was=("last", move, -1)).drop("__key", "idx", "n")
    now, was = F.coalesce(F.col("__now") == "ENTER_LONG", F.lit(False)), F.coalesce(F.col("__was") == "ENTER_LONG", F.lit(False))
    return df.withColumns({"position": F.when(now, "LONG").otherwise("FLAT"), "traded": F.when(~was & now, "BUY").when(was & ~now, "SELL")}).drop("__now", "__was")


def max_drawdown(df: DataFrame, value: str, *keys: str, block: int | None = None) -> DataFrame:
    """Per asset and keys, the largest fall from a running peak, as a share of it; null without values.

    With ``block``, peaks are carried from block to block.
    """
    if block is None:
        w = Window.partitionBy("asset", *keys).orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0)
        peaks = df.withColumn("__peak", F.max(value).over(w))
    else:
        peaks = running(df.withColumn("__key", F.struct("asset", *keys)), "__key", "t_ms", block, __peak=("max", F.col(value)))
    fall = F.when(F.col("__peak") > 0, (F.col("__peak") - F.col(value)) / F.col("__peak"))
    return peaks.groupBy("asset", *keys).agg(F.when(F.count(value) > 0, F.greatest(F.max(fall), F.lit(0.0))).alias("max_drawdown"))


def hold_downsample(df: DataFrame, every: int, *keys: str) -> DataFrame:
    """Keeps every k-th HOLD of a stream (k-th, 2k-th, ...) and all other rows."""
    nth = F.row_number().over(Window.partitionBy("asset", *keys, "action").orderBy("t_ms"))
    return df.withColumn("__n", nth).where((F.col("action") != "HOLD") | (F.col("__n") % every == 0)).drop("__n")


def loop_tax(df: DataFrame, budget: float = 12, tax: float = 1.0, session: str = "session", pos: str = "pos") -> DataFrame:
    """Adds spent and remaining budget as each decision of a session sees them."""
    i = F.row_number().over(Window.partitionBy(session).orderBy(pos)) - 1
    return df.withColumn("spent", i * F.lit(float(tax))).withColumn("remaining", F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("spent")))
