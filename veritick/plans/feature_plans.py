"""Queries of rolling features, decisions and gates over bars, snapshots and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritick.operators import features as X
from veritick.operators import gates as G
from veritick.plans.base import Plans, r
from veritick.session import table
from veritick.sources import proxy

P = Plans()
W = "PARTITION BY asset ORDER BY t_ms"
DEFAULT = X.Params()
# Features of the default cell in SQL.
FEATURES = f"""{proxy.BARS},
lr AS (SELECT *, CASE WHEN lag(close) OVER ({W}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({W})) END AS log_return FROM bars),
feat AS (SELECT *,
  CASE WHEN lag(close, 28) OVER ({W}) > 0 THEN close / lag(close, 28) OVER ({W}) - 1 END AS ret,
  CASE WHEN bar_idx >= 20 AND max(close) OVER w20 > min(close) OVER w20 THEN (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 END AS z,
  CASE WHEN count(log_return) OVER w30 >= 2 AND min(close) OVER w31 > 0 THEN stddev_pop(log_return) OVER w30 * sqrt(365) END AS vol
  FROM lr WINDOW w20 AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w30 AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  w31 AS ({W} ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)),
scored AS (SELECT *, CASE WHEN ok THEN 1 / (1 + exp(-(ret / greatest(vol / sqrt(365) * sqrt(28), 1e-9)))) END AS momentum,
  CASE WHEN ok THEN 1 / (1 + exp(z)) END AS reversion,
  CASE WHEN ok THEN least(greatest(1 - exp(-2 * bar_idx * 0.01 * 0.01), 0), 0.97) END AS sample
  FROM (SELECT *, ret IS NOT NULL AND z IS NOT NULL AND vol IS NOT NULL AS ok FROM feat)),
decided AS (SELECT *, CASE WHEN ok THEN least(exp((ln(momentum) + ln(reversion) + ln(sample)) / 3), 0.97) END AS conviction,
  CASE WHEN NOT ok THEN 'ABSTAIN' WHEN ret > 0 AND (z <= -1 OR abs(z) < 1) THEN 'ENTER_LONG' WHEN z >= 0 AND ret <= 0 THEN 'EXIT_LONG' ELSE 'HOLD' END AS action FROM scored)"""
KEY = ("asset", "t_ms")


def sql(columns: str, source: str = "decided", rest: str = "") -> str:
    return f"WITH {FEATURES} SELECT asset, t_ms, {columns} FROM {source} {rest}"


def decided(spark, d):
    return X.with_decision(proxy.bars(spark, d), DEFAULT)


P.add("bar_index", lambda s, d: X.with_bar_index(proxy.bars(s, d)).select(*KEY, "bar_idx"), sql("bar_idx", "bars"))
P.add("period_return", lambda s, d: proxy.bars(s, d).select(*KEY, r(X.period_return(28)).alias("ret")), sql("round(ret, 6) AS ret", "feat"))


def mean_std(s, d):
    mean, std = X.mean_std(X.by_time().rowsBetween(-19, 0))
    return proxy.bars(s, d).select(*KEY, r(mean).alias("mean"), r(std).alias("std"))


P.add(
    "mean_std", mean_std,
    sql(f"CASE WHEN count(*) OVER w >= 2 THEN round(avg(close) OVER w, 6) END AS mean, CASE WHEN count(*) OVER w >= 2 THEN round(stddev_pop(close) OVER w, 6) END AS std", "bars", f"WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
)
P.add("z_score", lambda s, d: X.rolling(proxy.bars(s, d), z={20}).select(*KEY, r("z_20").alias("z")), sql("round(z, 6) AS z", "feat"))
P.add("log_returns", lambda s, d: X.with_log_return(proxy.bars(s, d)).select(*KEY, r("log_return").alias("log_return")), sql("round(log_return, 6) AS log_return", "lr"))
P.add("annualized_vol", lambda s, d: X.rolling(proxy.bars(s, d), vol={30}).select(*KEY, r("vol_30").alias("vol")), sql("round(vol, 6) AS vol", "feat"))

# A few series of very many rows: order totals by status in order of their key, in blocks of 512 rows with a halo.
BLOCK = 512
LONG = """raw_bars AS (SELECT o_orderstatus AS asset, o_orderkey::BIGINT AS t_ms, o_totalprice AS close FROM orders),
bars AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t_ms) - 1 AS bar_idx FROM raw_bars)"""


def long_series(s, d):
    return table(s, d, "orders").select(F.col("o_orderstatus").alias("asset"), F.col("o_orderkey").cast("long").alias("t_ms"), F.col("o_totalprice").alias("close"))


def rolling_in_blocks(s, d):
    got = X.rolling(long_series(s, d), {28}, {20}, {30}, BLOCK)
    return got.select(*KEY, F.col("bar_idx").cast("long").alias("bar_idx"), F.col("n").alias("n"), r("ret_28").alias("ret"), r("z_20").alias("z"), r("vol_30").alias("vol"), "next_close")


P.add(
    "rolling_in_blocks", rolling_in_blocks,
    f"""WITH {FEATURES.replace(proxy.BARS, LONG)} SELECT asset, t_ms, bar_idx, count(*) OVER (PARTITION BY asset) AS n, round(ret, 6) AS ret, round(z, 6) AS z, round(vol, 6) AS vol, lead(close) OVER ({W}) AS next_close FROM feat""",
)


def long_drawdown(s, d):
    decided = X.with_decision(long_series(s, d), DEFAULT, BLOCK)
    placed = X.with_position(decided, block=BLOCK).where("traded is not null").groupBy("asset").agg(F.count_if(F.col("traded") == "BUY").alias("buys"), F.count_if(F.col("traded") == "SELL").alias("sells"))
    return X.max_drawdown(long_series(s, d), "close", block=BLOCK).join(placed, "asset", "left").select("asset", r("max_drawdown").alias("max_drawdown"), "buys", "sells")


P.add(
    "scans_in_blocks", long_drawdown,
    f"""WITH {FEATURES.replace(proxy.BARS, LONG)},
    placed AS (SELECT *, CASE WHEN last_value(CASE WHEN action IN ('ENTER_LONG', 'EXIT_LONG') THEN action END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'ENTER_LONG' THEN 1 ELSE 0 END AS held,
      max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM decided),
    moved AS (SELECT *, held - coalesce(lag(held) OVER ({W}), 0) AS move FROM placed)
    SELECT asset, round(max((peak - close) / peak), 6) AS max_drawdown, nullif(count(*) FILTER (move = 1), 0) AS buys, CASE WHEN count(*) FILTER (move = 1) > 0 THEN count(*) FILTER (move = -1) END AS sells FROM moved GROUP BY asset""",
)
P.add(
    "signal_scores", lambda s, d: decided(s, d).select(*KEY, *[r(c).alias(c) for c in ("momentum", "reversion", "sample", "conviction")]),
    sql("round(momentum, 6) AS momentum, round(reversion, 6) AS reversion, round(sample, 6) AS sample, round(conviction, 6) AS conviction"),
)
P.add("signal_action", lambda s, d: decided(s, d).select(*KEY, "action"), sql("action"))
WARM = DEFAULT.warmup


def warm(s, d):
    n = F.count("*").over(Window.partitionBy("asset"))
    return decided(s, d).withColumn("n", n).where((F.col("bar_idx") >= WARM) & (F.col("bar_idx") < F.col("n") - 1))


P.add("warmup_filter", lambda s, d: warm(s, d).select(*KEY, "bar_idx"), sql("bar_idx", "(SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM decided)", f"WHERE bar_idx >= {WARM} AND bar_idx < n - 1"))
P.add("next_bar_fill", lambda s, d: X.with_next_fill(proxy.bars(s, d)).select(*KEY, "next_close", "next_t_ms"), sql(f"lead(close) OVER ({W}) AS next_close, lead(t_ms) OVER ({W}) AS next_t_ms", "bars"))
POSITION = f"""(SELECT *, CASE WHEN last_value(CASE WHEN action IN ('ENTER_LONG', 'EXIT_LONG') THEN action END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  = 'ENTER_LONG' THEN 'LONG' ELSE 'FLAT' END AS position FROM decided)"""
P.add(
    "position_state", lambda s, d: X.with_position(decided(s, d)).select(*KEY, "position", "traded"),
    sql(f"position, CASE WHEN coalesce(lag(position) OVER ({W}), 'FLAT') = 'FLAT' AND position = 'LONG' THEN 'BUY' WHEN lag(position) OVER ({W}) = 'LONG' AND position = 'FLAT' THEN 'SELL' END AS traded", POSITION),
)
P.add(
    "max_drawdown", lambda s, d: X.max_drawdown(proxy.bars(s, d), "close", block=4096).select("asset", r("max_drawdown").alias("max_drawdown")),
    f"WITH {proxy.BARS} SELECT asset, round(max((peak - close) / peak), 6) AS max_drawdown FROM (SELECT *, max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM bars) GROUP BY asset",
)
P.add(
    "hold_downsample", lambda s, d: X.hold_downsample(decided(s, d), 7).select(*KEY, "action"),
    sql("action", "(SELECT *, row_number() OVER (PARTITION BY asset, action ORDER BY t_ms) AS k FROM decided)", "WHERE action <> 'HOLD' OR k % 7 = 0"),
)
P.add(
    "loop_tax_budget", lambda s, d: X.loop_tax(proxy.snapshots(s, d), 4).select("session", "pos", "spent", "remaining"),
    f"""WITH {proxy.SNAPSHOTS} SELECT session, pos, (row_number() OVER (PARTITION BY session ORDER BY pos) - 1)::DOUBLE AS spent,
    greatest(0, 4 - (row_number() OVER (PARTITION BY session ORDER BY pos) - 1))::DOUBLE AS remaining FROM snapshots""",
)

# Gates over snapshots, with a clock two minutes after every other snapshot and two hours after the others.
NOW = "observed_at_ms + CASE WHEN pos % 2 = 0 THEN 120000 WHEN pos % 3 = 0 THEN -5 ELSE 7200000 END"


def clock():
    p = F.col("pos")
    return F.col("observed_at_ms") + F.when(p % 2 == 0, 120_000).when(p % 3 == 0, -5).otherwise(7_200_000)


def gate(name, column, reason_sql, source="snapshots", base=proxy.SNAPSHOTS, key="pos"):
    def query(s, d):
        rows = proxy.snapshots(s, d) if source == "snapshots" else proxy.decisions(s, d)
        return rows.select("pos", column().alias("g")).select("pos", "g.verdict", "g.reason")

    P.add(name, query, f"WITH {base} SELECT pos, CASE WHEN why IS NULL THEN 'ALLOWED' ELSE 'BLOCKED' END AS verdict, coalesce(why, 'within limits') AS reason FROM (SELECT pos, {reason_sql} AS why FROM {source})")


gate("gate_freshness", lambda: G.freshness(F.col("observed_at_ms"), clock()), f"CASE WHEN {NOW} - observed_at_ms < 0 THEN 'timestamp in the future' WHEN {NOW} - observed_at_ms > 300000 THEN 'stale' END")
gate("gate_sample_size", lambda: G.sample_size(F.col("pos") % 100), "CASE WHEN pos % 100 < 45 THEN 'insufficient history' END")
LIQ = "CASE WHEN liquidity_usd IS NULL THEN 'unknown' WHEN liquidity_usd < 250000 THEN 'liquidity under floor' WHEN volume24h_usd < 100000 THEN 'volume under floor' END"
gate("gate_liquidity", lambda: G.liquidity(F.col("liquidity_usd"), F.col("volume24h_usd")), LIQ)
gate("gate_volatility", lambda: G.volatility(F.when(F.col("pos") % 9 != 0, F.col("volume24h_usd") / 50_000)), "CASE WHEN pos % 9 = 0 THEN 'unknown' WHEN volume24h_usd / 50000 > 3.5 THEN 'over cap' END")
gate(
    "gate_conviction", lambda: G.conviction(F.when(F.col("pos") % 9 != 0, F.col("conviction") * 3)),
    "CASE WHEN pos % 9 = 0 OR conviction IS NULL THEN 'not computable' WHEN conviction * 3 > 0.97 THEN 'exceeds trust ceiling' WHEN conviction * 3 < 0.55 THEN 'under floor' END", "decisions", proxy.DECISIONS,
)
gate("gate_history", lambda: G.history(F.when(F.col("pos") % 4 != 0, F.col("pos") % 5)), "CASE WHEN pos % 4 = 0 OR pos % 5 = 0 THEN 'no series' END")


def run_gates(s, d):
    rows = proxy.snapshots(s, d)
    every = F.array(G.freshness(F.col("observed_at_ms"), clock()), G.liquidity(F.col("liquidity_usd"), F.col("volume24h_usd")), G.sample_size(F.col("pos") % 100))
    return rows.select("pos", G.run(every).alias("g")).select("pos", "g.verdict", F.array_join("g.blocked_by", ",").alias("blocked_by"))


P.add(
    "run_gates", run_gates,
    f"""WITH {proxy.SNAPSHOTS} SELECT pos, CASE WHEN gates = '' THEN 'ALLOWED' ELSE 'BLOCKED' END AS verdict, gates AS blocked_by FROM (SELECT pos, concat_ws(',',
    CASE WHEN {NOW} - observed_at_ms NOT BETWEEN 0 AND 300000 THEN 'freshness' END, CASE WHEN ({LIQ}) IS NOT NULL THEN 'liquidity' END, CASE WHEN pos % 100 < 45 THEN 'sample-size' END) AS gates FROM snapshots)""",
)


def decide_batch(s, d):
    got = G.decide(proxy.snapshots(s, d), proxy.bars(s, d).where("cast(asset as int) % 7 <> 0"), clock(), budget=4)
    return got.select("pos", "asset", "action", r("conviction").alias("conviction"), "verdict", F.array_join("blocked_by", ",").alias("blocked_by"))


P.add(
    "decide_batch", decide_batch,
    f"""WITH {FEATURES}, {proxy.SNAPSHOTS},
    latest AS (SELECT asset, bar_idx + 1 AS n_bars, vol, action, conviction FROM decided WHERE asset::INT % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY asset ORDER BY t_ms DESC) = 1),
    seen AS (SELECT s.*, n_bars, vol, conviction, coalesce(action, 'ABSTAIN') AS action, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS spent
             FROM snapshots s LEFT JOIN latest USING (asset)),
    judged AS (SELECT *, concat_ws(',', CASE WHEN 4 - spent <= 0 THEN 'loop-tax' END, CASE WHEN {NOW} - observed_at_ms NOT BETWEEN 0 AND 300000 THEN 'freshness' END,
       CASE WHEN ({LIQ}) IS NOT NULL THEN 'liquidity' END, CASE WHEN n_bars IS NULL THEN 'history' WHEN n_bars < 45 THEN 'sample-size' END,
       CASE WHEN n_bars IS NOT NULL AND (vol IS NULL OR vol > 3.5) THEN 'volatility' END,
       CASE WHEN n_bars IS NOT NULL AND action = 'ENTER_LONG' AND (conviction IS NULL OR conviction < 0.55) THEN 'conviction' END) AS gates FROM seen)
    SELECT pos, asset, action, round(conviction, 6) AS conviction, CASE WHEN gates = '' THEN 'ALLOWED' ELSE 'BLOCKED' END AS verdict, gates AS blocked_by FROM judged""",
)
QUERIES, ORACLE_SQL = P.queries, P.sql
