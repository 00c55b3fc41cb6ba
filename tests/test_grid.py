"""Running sums, halos, segmented scans and the swept grid, each against the plain form of the same thing."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritick.operators import backtest as B
from veritick.operators import features as X
from veritick.operators import ordered as O
from veritick.session import cut


def series(spark, lengths, seed=1, step=0.03, scale=None):
    rng = random.Random(seed)
    rows = []
    for a, n in enumerate(lengths):
        price = (scale or {}).get(a, 100.0)
        for i in range(n):
            price *= 1 + (rng.random() - 0.5) * step
            rows.append((f"A{a}", 86_400_000 * i + rng.randint(0, 1000), price))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "asset string, t_ms long, close double")


def window_form(bars, ret, z, vol):
    df = X.with_log_return(bars)
    return df.select("asset", "t_ms", *[X.period_return(k).alias(f"ret_{k}") for k in ret], *[X.z_score(k).alias(f"z_{k}") for k in z], *[X.annualized_vol(k).alias(f"vol_{k}") for k in vol])


def close_to(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-10)


@pytest.mark.parametrize("block", [None, 64])
def test_look_backs_equal_windows(spark, block):
    bars = series(spark, (300, 1, 2, 31, 130), scale={3: 2.7e-6, 4: 3e7})
    flat = spark.createDataFrame([("F", i, 5.0 if i < 60 else 0.0 if i == 70 else -1.0 if i == 80 else None if i == 90 else 5.0 + i % 3) for i in range(140)], "asset string, t_ms long, close double")
    bars = bars.unionByName(flat)
    looks = ({1, 14, 28}, {2, 10, 30}, {2, 20, 45})
    got = {(r["asset"], r["t_ms"]): r for r in X.rolling(bars, *looks, block=block).collect()}
    want = window_form(bars, *looks).collect()
    assert len(got) == len(want) == bars.count()
    for r in want:
        for c in r.asDict():
            if c not in ("asset", "t_ms"):
                assert close_to(got[r["asset"], r["t_ms"]][c], r[c]), (r, c, got[r["asset"], r["t_ms"]])
    by = Window.partitionBy("asset").orderBy("t_ms")
    plain = bars.select("asset", "t_ms", (F.row_number().over(by) - 1).alias("i"), F.lead("close").over(by).alias("c"), F.lead("t_ms").over(by).alias("t"), F.count("*").over(Window.partitionBy("asset")).alias("n"))
    for r in plain.collect():
        g = got[r["asset"], r["t_ms"]]
        assert (g["bar_idx"], g["next_close"], g["next_t_ms"], g["n"]) == (r["i"], r["c"], r["t"], r["n"])


def test_one_long_asset_fills_many_tasks(spark):
    """Two hundred thousand bars of one asset: the same features as one window, from over a hundred partitions of work."""
    n = 200_000
    bars = spark.range(n).select(F.lit("X").alias("asset"), F.col("id").alias("t_ms"), (100 + 10 * F.sin(F.col("id") / 700) + (F.col("id") * 7919 % 1000) / 500).alias("close"))
    got = X.rolling(bars, {28}, {20}, {30}, block=2048)
    want = window_form(bars, {28}, {20}, {30})
    both = got.join(want.toDF("asset", "t_ms", "a", "b", "c"), ["asset", "t_ms"])
    off = lambda x, y: (F.col(x).isNull() != F.col(y).isNull()) | (F.abs(F.col(x) - F.col(y)) > 1e-7 * (1 + F.abs(F.col(y))))
    assert both.count() == n and both.where(off("ret_28", "a") | off("z_20", "b") | off("vol_30", "c")).count() == 0
    halos = O.with_halo(bars, "asset", "t_ms", 2048, 32)
    per = halos.groupBy("block").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    assert per.agg(F.max("n"), F.count("*")).first() == (2048 + 32, n // 2048 + 1) and per.agg(F.sum("own")).first()[0] == n


def test_running_over_blocks(spark):
    rng = random.Random(4)
    rows = [(k, i * 3, rng.choice([None, rng.randint(-9, 9)])) for k in ("a", None, "b") for i in range(rng.choice((1, 57, 200)))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, t long, v long")
    w = Window.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "t", F.max("v").over(upto), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.last("v", True).over(upto), F.last("v", True).over(before), F.max("v").over(before))
    got = O.running(df, "k", "t", 8, a=("max", F.col("v")), b=("sum", F.col("v")), c=("last", F.col("v")), d=("last", F.col("v"), -1), e=("max", F.col("v"), -1)).select("k", "t", "a", "b", "c", "d", "e")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_positions_and_drawdown_over_blocks(spark):
    bars = series(spark, (400, 90, 3))
    decided = X.with_decision(bars, X.Params(5, 10, 1.0, 10)).select("asset", "t_ms", "close", "action").transform(cut)
    cols = ("asset", "t_ms", "position", "traded")
    assert sorted(map(tuple, X.with_position(decided, block=16).select(*cols).collect()), key=str) == sorted(map(tuple, X.with_position(decided).select(*cols).collect()), key=str)
    assert sorted(X.max_drawdown(bars, "close", block=16).collect()) == sorted(X.max_drawdown(bars, "close").collect())


GRID = tuple(X.Params(m, z, e, v, f) for m in (5, 14, 28) for z in (10, 20) for e in (0.8, 1.5) for v in (10, 30) for f in (0.2, 0.9))


def rows_form(bars, cells):
    """The money of the rows of every cell, by the fold over exact decimals."""
    folded = B.cell_equity(B.decision_bars(B.grid_expand(bars, cells)))
    return {(r["asset"], r["cell_id"], r["window_name"]): r["s"] for r in folded.collect()}


@pytest.mark.parametrize("block", [None, 64])
def test_sweep_equals_the_fold_of_rows(spark, block, monkeypatch):
    monkeypatch.setattr(B, "CELLS_AT_ONCE", 50 * len(GRID))  # stretches of fifty bars
    bars = series(spark, (700, 200, 40, 1), step=0.08, scale={1: 3e-6, 2: 4e8})
    want, got = rows_form(bars, GRID), B.walk_forward(bars, GRID, block=block).collect()
    assert len(got) == 4 * len(GRID) * 2 and any(r["n_round_trips"] > 3 for r in got)
    for r in got:
        s = want.get((r["asset"], r["cell_id"], r["window_name"]))
        if s is None:
            assert (r["final_equity"], r["max_drawdown"], r["n_trades"], r["open_at_end"]) == (10_000, None, 0, False)
            continue
        assert (r["n_trades"], r["n_round_trips"], r["open_at_end"], r["error"]) == (s["trades"], s["trips"], s["held"], s["error"]), r
        if s["error"] is None:
            assert r["final_equity"] == s["equity"] and math.isclose(r["max_drawdown"], s["drawdown"], abs_tol=1e-15), (r, s)
        assert r["win_rate"] == (s["wins"] / s["trips"] if s["trips"] else None)


def test_price_below_quantum(spark):
    bars = series(spark, (200,), step=0.3, scale={0: 2e-7})
    cells = (X.Params(5, 10, 1.0, 10),)
    want, got = rows_form(bars, cells), B.walk_forward(bars, cells).collect()
    assert any(r["error"] for r in got)
    for r in got:
        s = want["A0", 0, r["window_name"]]
        assert (r["error"], r["n_trades"], r["n_round_trips"], r["open_at_end"]) == (s["error"], s["trades"], s["trips"], s["held"])


def test_integers_beyond_64_bits():
    """Quantities whose products leave 64 bits are taken apart or kept as Python integers."""
    import numpy as np

    rng = random.Random(6)
    for top in (10**9, 10**13, 10**18, 10**25):
        cash, qty, price = [rng.randrange(10**10) for _ in range(50)], [rng.randrange(top) for _ in range(50)], [rng.randrange(1, 10**11) for _ in range(50)]
        got = B.worth(B.integers(cash), B.integers(qty), B.integers(price))
        assert np.allclose(got, [(c + q * p // 10**9) / 10**6 for c, q, p in zip(cash, qty, price, strict=True)], rtol=4e-16, atol=0)


def test_many_cells_cost_little_more(spark):
    """A thousand cells: no more rows, one shuffle by asset, one row of result per asset, cell and window."""
    grid = tuple(X.Params(m, z, 0.5 + e / 10, v, 0.2) for m in (7, 14, 21, 28, 56) for z in (10, 15, 20, 25, 30) for e in range(10) for v in (10, 20, 30, 40))
    bars = series(spark, (300,) * 4)
    df = B.walk_forward(bars, grid)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    assert df.count() == 4 * 1000 * 2


def test_features_take_one_window_and_no_decimals(spark):
    """Look-backs come from batches of exact integers: no windows of decimals, whatever their number; rows of cells are not shuffled."""
    bars = series(spark, (300,) * 4).transform(cut)
    df = B.trade_list(B.decision_bars(B.grid_expand(bars)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")] and "decimal" not in plan


def test_look_backs_go_over_batches(spark):
    """Batches of ten rows, far less than a look-back, give the same as one."""
    bars = series(spark, (300, 1, 2, 70)).transform(cut)
    looks = ({5}, {20}, {30})
    whole = sorted(map(tuple, X.rolling(bars, *looks).drop("close").collect()), key=str)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert sorted(map(tuple, X.rolling(bars, *looks).drop("close").collect()), key=str) == whole
        late = X.rolling(bars, *looks).where("bar_idx >= 25").drop("close")  # a filter is not moved below the look-backs
        assert sorted(map(tuple, late.collect()), key=str) == [r for r in whole if r[late.columns.index("bar_idx")] >= 25]
        money = sorted(map(str, B.cell_equity(B.decision_bars(B.grid_expand(bars, GRID[:3]))).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert money == sorted(map(str, B.cell_equity(B.decision_bars(B.grid_expand(bars, GRID[:3]))).collect()))


def lanes(windows, rng, price=1e9):
    """Bars of some windows, one after the other, with random moves: (edges, rel, valid, enter, leave, money) of ``Sweep.feed``."""
    import numpy as np

    lengths = rng.integers(1, 90, windows)
    edges, n, c = np.concatenate([[0], np.cumsum(lengths)]), int(lengths.sum()), len(GRID)
    rel = np.arange(n) - np.repeat(edges[:-1], lengths)
    valid = rel[None, :] >= rng.integers(0, 40, c)[:, None]
    kind = rng.integers(0, 4, (c, n))
    close = rng.uniform(0.5, 2, n) * price
    return edges, rel, valid, valid & (kind == 0), valid & (kind == 1), [close / 1e6, *((close * x).astype(np.int64) for x in (1, 1.005, 0.995))]


@pytest.mark.parametrize("price", [1e9, 3e4, 4e14, 4e17])
def test_trades_of_many_windows_are_made_together(price, monkeypatch):
    """One sweep over forty windows, the trades of all lanes step by step, equals forty sweeps that trade one by one in Python's integers."""
    import numpy as np

    edges, rel, valid, enter, leave, money = lanes(40, np.random.default_rng(3), price)
    all_at_once, steps = B.Sweep(GRID, 40, 10_000), []
    plain = all_at_once.one_by_one
    monkeypatch.setattr(all_at_once, "one_by_one", lambda *a: steps.append(a) or plain(*a))
    all_at_once.feed(np.arange(40), edges, rel, valid, enter, leave, money)
    assert all_at_once.trades.sum() > 5_000 and bool(steps) == (price > 9e15)  # only prices beyond 64 bits go one by one
    for w, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        one = B.Sweep(GRID, 1, 10_000)
        monkeypatch.setattr(one, "together", lambda *a: None)
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid, hi)):  # in two stretches
            if a < b:
                one.feed(np.array([0]), np.array([0, b - a]), rel[a:b], valid[:, a:b], enter[:, a:b], leave[:, a:b], [m[a:b] for m in money])
        for name in B.Sweep.LANE:
            assert (getattr(one, name)[:, 0] == getattr(all_at_once, name)[:, w]).all(), (w, name)


def test_micro_equals_the_column(spark):
    """Millionths by floating point, or by text next to half-way, are those of the column."""
    import numpy as np

    from veritick.functions import scalars as S

    rng = random.Random(8)
    xs = [None, 0.0, -0.0, float("nan"), float("inf"), 0.0000015, 5e-7, 4.9999999999999999e-7, 1.0000005, -2.5e-6, 1e-300, 9.1e12, 2251799813.6852485, 123456789012.1234565]
    xs += [rng.randrange(10**9) / 10**6 + 5e-7 for _ in range(300)] + [rng.uniform(0, 3000) * r for r in (1, 1.005, 0.995) for _ in range(300)] + [10 ** rng.uniform(-9, 12) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", F.coalesce(S.to_micro_usd("x").cast("long"), F.lit(0)).alias("m"))
    want = [r["m"] for r in sorted(df.collect())]
    assert B.micro(np.array([math.nan if x is None else x for x in xs])).tolist() == want


def test_sweep_stops_at_rows_out_of_order(spark):
    bars = X.with_features(series(spark, (100, 100)), GRID)
    with pytest.raises(Exception, match="all bars of an asset in order"):
        B.sweep(bars.where("bar_idx <> 50"), GRID, 0.7, 0.005, 10_000).count()


@pytest.mark.parametrize("top, calls", [(10**14, False), (10**3, False), (2**46, False), (2**50, True)])
def test_deviations_in_64_bits_are_exact(top, calls):
    """n times the deviation of any stretch is that of Python's integers, to the last bit, and needs none of them for closes and daily returns."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-top, top + 1, 3_000)
    x[100:160], x[200:230], x[300:400:3] = top, 7, 0
    x[500:560:2], x[501:560:2] = top, -top
    hi = np.arange(1, 3_001)
    for deep in (2, 30, 128):
        lo = np.maximum(hi - deep, 0)
        n = hi - lo - (rng.random(3_000) < 0.1) * (x[hi - 1] == 0)
        got = X.spreads(x, 128)(lo, hi, n)
        want = [math.sqrt(float(int(k) * sum(v * v for v in own) - sum(own) ** 2)) for k, own in ((k, x[a:b].tolist()) for a, b, k in zip(lo, hi, n, strict=True))]
        assert got.tolist() == want
    assert (X.spreads(x, 128).__name__ == "plain") == calls
    assert X.spreads(x, 129).__name__ == "plain"
