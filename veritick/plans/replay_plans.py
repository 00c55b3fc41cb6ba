"""Queries of the walk-forward replay, of scoring and census, and of the fine-tuning export."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from veritick.functions.helpers import json_rows
from veritick.operators import backtest as B
from veritick.operators import features as X
from veritick.operators import sft
from veritick.operators import track as T
from veritick.plans.base import Plans, r
from veritick.sources import proxy

P = Plans()
W = "PARTITION BY asset ORDER BY t_ms"
CELL = ("asset", "cell_id", "window_name")


def _features(grid=X.GRID, bars: str = proxy.BARS) -> str:
    looks = lambda name: sorted({getattr(c, name) for c in grid})
    ret = ",\n".join(f"CASE WHEN lag(close, {n}) OVER ({W}) > 0 THEN close / lag(close, {n}) OVER ({W}) - 1 END AS ret_{n}" for n in looks("momentum"))
    z = ",\n".join(f"CASE WHEN bar_idx >= {n} AND max(close) OVER z{n} > min(close) OVER z{n} THEN (close - avg(close) OVER z{n}) / stddev_pop(close) OVER z{n} END AS z_{n}" for n in looks("z_window"))
    vol = ",\n".join(f"CASE WHEN count(log_return) OVER v{n} >= 2 AND min(close) OVER u{n} > 0 THEN stddev_pop(log_return) OVER v{n} * sqrt(365) END AS vol_{n}" for n in looks("vol_window"))
    frames = [f"z{n} AS ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in looks("z_window")]
    frames += [f"v{n} AS ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), u{n} AS ({W} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)" for n in looks("vol_window")]
    return f"""{bars},
lr AS (SELECT *, CASE WHEN lag(close) OVER ({W}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({W})) END AS log_return FROM bars),
feat AS (SELECT *, {ret}, {z}, {vol} FROM lr WINDOW {", ".join(frames)})"""


def _cells(grid=X.GRID) -> str:
    """All bars of all cells, with the cell's features."""
    parts = [
        f"SELECT asset, t_ms, close, bar_idx, count(*) OVER (PARTITION BY asset) AS n, {i} AS cell_id, {c.warmup} AS warmup, {c.momentum} AS momentum, {c.z_entry}::DOUBLE AS z_entry, ret_{c.momentum} AS ret, z_{c.z_window} AS z, vol_{c.vol_window} AS vol FROM feat"
        for i, c in enumerate(grid)
    ]
    action = "CASE WHEN ret IS NULL OR z IS NULL OR vol IS NULL THEN 'ABSTAIN' WHEN ret > 0 AND (z <= -z_entry OR abs(z) < z_entry) THEN 'ENTER_LONG' WHEN z >= 0 AND ret <= 0 THEN 'EXIT_LONG' ELSE 'HOLD' END AS action"
    return f"cells AS (SELECT *, {action} FROM ({' UNION ALL '.join(parts)}))"


EXPANSION = """
expanded AS (SELECT asset, t_ms, close, bar_idx, cell_id, 'in' AS window_name, bar_idx AS rel, floor(n * 0.7)::INT AS n_window, warmup, action FROM cells WHERE bar_idx < floor(n * 0.7)
  UNION ALL SELECT asset, t_ms, close, bar_idx, cell_id, 'out', bar_idx - s, n - s, warmup, action FROM (SELECT *, greatest(floor(n * 0.7)::INT - 60, 0) AS s FROM cells) WHERE bar_idx >= s),
steps AS (SELECT * FROM (SELECT *, lead(close) OVER w AS next_close, lead(t_ms) OVER w AS next_t_ms FROM expanded WINDOW w AS (PARTITION BY asset, cell_id, window_name ORDER BY t_ms))
  WHERE rel >= warmup AND rel < n_window - 1),
placed AS (SELECT *, CASE WHEN last_value(CASE WHEN action IN ('ENTER_LONG', 'EXIT_LONG') THEN action END IGNORE NULLS) OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'ENTER_LONG' THEN 'LONG' ELSE 'FLAT' END AS position FROM steps),
moves AS (SELECT *, CASE WHEN was = 'FLAT' AND position = 'LONG' THEN 'BUY' WHEN was = 'LONG' AND position = 'FLAT' THEN 'SELL' END AS side FROM
  (SELECT *, coalesce(lag(position) OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms), 'FLAT') AS was FROM placed))"""
BASE = f"WITH RECURSIVE {_features()}, {_cells()}"
EXPANDED = f"{BASE},{EXPANSION}"
MICRO = "(round(({})::VARCHAR::DECIMAL(38, 15), 6) * 1000000)::HUGEINT"
REPLAY = f"""
trades AS (SELECT *, row_number() OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms) AS k FROM moves WHERE side IS NOT NULL),
fold AS (
  SELECT DISTINCT asset, cell_id, window_name, 0::BIGINT AS k, 10000000000::HUGEINT AS cash, 0::HUGEINT AS qty, 0::DOUBLE AS bought, 0 AS n_trades, 0 AS trips, 0 AS wins FROM steps
  UNION ALL
  SELECT f.asset, f.cell_id, f.window_name, t.k,
    CASE WHEN side = 'BUY' THEN f.cash - floor(f.cash::DOUBLE / 1000000 * 0.2 * 100)::HUGEINT * 10000 ELSE f.cash + f.qty * {MICRO.format("next_close * (1 - 0.005)")} // 1000000000 END,
    CASE WHEN side = 'BUY' THEN floor(f.cash::DOUBLE / 1000000 * 0.2 * 100)::HUGEINT * 10000 * 1000000000 // {MICRO.format("next_close * (1 + 0.005)")} ELSE 0 END,
    CASE WHEN side = 'BUY' THEN next_close ELSE f.bought END, f.n_trades + 1, f.trips + (side = 'SELL')::INT, f.wins + (side = 'SELL' AND next_close > f.bought)::INT
  FROM fold f JOIN trades t ON t.asset = f.asset AND t.cell_id = f.cell_id AND t.window_name = f.window_name AND t.k = f.k + 1),
marked AS (
  SELECT m.asset, m.cell_id, m.window_name, m.t_ms, (f.cash + f.qty * {MICRO.format("m.next_close")} // 1000000000)::DOUBLE / 1000000 AS equity
  FROM (SELECT *, count(side) OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms) AS k FROM moves) m JOIN fold f USING (asset, cell_id, window_name, k)),
drawn AS (SELECT asset, cell_id, window_name, max((peak - equity) / peak) AS max_drawdown, arg_max(equity, t_ms) AS equity FROM
  (SELECT *, max(equity) OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms) AS peak FROM marked) GROUP BY ALL),
ends AS (SELECT asset, cell_id, window_name, arg_max(n_trades, k) AS n_trades, arg_max(trips, k) AS trips, arg_max(wins, k) AS wins FROM fold GROUP BY ALL),
groups AS (SELECT DISTINCT asset, n, cell_id, unnest(['in', 'out']) AS window_name FROM cells)
SELECT asset, cell_id, window_name, floor(n * 0.7)::INT AS split_index, CASE WHEN window_name = 'in' THEN floor(n * 0.7) ELSE n - floor(n * 0.7) END::INT AS n_bars,
  coalesce(round(equity, 6), 10000) AS final_equity, coalesce(equity, 10000) / 10000 - 1 AS total_return, round(max_drawdown, 9) AS max_drawdown, coalesce(n_trades, 0) AS n_trades,
  coalesce(trips, 0) AS n_round_trips, CASE WHEN trips > 0 THEN round(wins / trips, 6) END AS win_rate, coalesce(trips, 0) < 10 AS weak_evidence, coalesce(n_trades, 0) % 2 = 1 AS open_at_end
FROM groups LEFT JOIN drawn USING (asset, cell_id, window_name) LEFT JOIN ends USING (asset, cell_id, window_name)"""
WALK = f"{EXPANDED},{REPLAY}"
# A hundred cells: five look-backs of momentum, five of the mean, two of the deviation, two thresholds.
WIDE = tuple(X.Params(m, z, e, v) for m in (7, 14, 28, 42, 56) for z in (10, 15, 20, 25, 30) for v in (20, 30) for e in (1.0, 1.5))


def walk_forward(s, d, cells=X.GRID):
    got = B.walk_forward(proxy.bars(s, d), cells).drop("error")
    return got.withColumns({"final_equity": r("final_equity"), "max_drawdown": r("max_drawdown", 9), "win_rate": r("win_rate")})


def steps(s, d):
    return B.decision_bars(B.grid_expand(proxy.bars(s, d)))


P.add("walk_forward", walk_forward, WALK)
P.add("walk_forward_grid", lambda s, d: walk_forward(s, d, WIDE), f"WITH RECURSIVE {_features(WIDE)}, {_cells(WIDE)},{EXPANSION},{REPLAY}")
P.add("grid_expand", lambda s, d: B.grid_expand(proxy.bars(s, d)).select(*CELL, "t_ms", "rel", "n_window", "action"), f"{EXPANDED} SELECT asset, cell_id, window_name, t_ms, rel, n_window, action FROM expanded")
P.add(
    "trade_list", lambda s, d: B.trade_list(steps(s, d)),
    f"{EXPANDED} SELECT asset, cell_id, window_name, next_t_ms AS t_ms, side, next_close AS price FROM moves WHERE side IS NOT NULL",
)
P.add(
    "round_trips", lambda s, d: B.round_trips(B.trade_list(steps(s, d))).withColumn("win_rate", r("win_rate")),
    f"""{EXPANDED} SELECT asset, cell_id, window_name, count(sold) AS n_round_trips, count(*) FILTER (sold > next_close) AS wins,
    CASE WHEN count(sold) > 0 THEN round(count(*) FILTER (sold > next_close) / count(sold), 6) END AS win_rate, count(sold) < 10 AS weak_evidence
    FROM (SELECT *, lead(next_close) OVER (PARTITION BY asset, cell_id, window_name ORDER BY t_ms) AS sold FROM moves WHERE side IS NOT NULL) WHERE side = 'BUY' GROUP BY ALL""",
)


def cell_equity(s, d):
    return B.cell_equity(steps(s, d)).select(*CELL, r("s.equity").alias("equity"), r("s.drawdown", 9).alias("drawdown"), F.col("s.marks").alias("marks"), F.col("s.trades").alias("trades"))


P.add(
    "cell_equity", cell_equity,
    WALK.partition("ends AS (")[0].rstrip().rstrip(",") + """ SELECT d.asset, d.cell_id, d.window_name, round(equity, 6) AS equity, round(max_drawdown, 9) AS drawdown, marks::INT AS marks, trades::INT AS trades
    FROM drawn d JOIN (SELECT asset, cell_id, window_name, count(*) AS marks FROM marked GROUP BY ALL) USING (asset, cell_id, window_name)
    JOIN (SELECT asset, cell_id, window_name, max(n_trades) AS trades FROM fold GROUP BY ALL) USING (asset, cell_id, window_name)""",
)

# Track record: decisions as signals on bars of suppliers; the clock is 1999-01-01.
NOW = 915_148_800_000


def signals(s, d):
    rows = proxy.snapshots(s, d)
    return rows.select(F.col("pos").alias("file"), F.when(F.col("pos") % 9 == 0, F.concat(F.lit("x"), "asset")).otherwise(F.col("asset")).alias("asset"), F.when(F.col("pos") % 7 != 0, F.col("observed_at_ms") + 3_600_000).alias("signal_ms"))


SIGNALS = f"""{proxy.BARS}, {proxy.SNAPSHOTS},
signals AS (SELECT pos AS file, CASE WHEN pos % 9 = 0 THEN 'x' || asset ELSE asset END AS asset, CASE WHEN pos % 7 <> 0 THEN observed_at_ms + 3600000 END AS signal_ms FROM snapshots)"""
SCORED = f"""WITH {SIGNALS},
due AS (SELECT *, signal_ms + horizon * 86400000 AS due_ms FROM signals, (SELECT unnest([1, 7]) AS horizon)),
based AS (SELECT d.*, b.t_ms AS b_ms, b.close AS b_close FROM due d ASOF LEFT JOIN bars b ON d.asset = b.asset AND d.signal_ms <= b.t_ms),
scored AS (SELECT d.*, o.close AS o_close, d.asset IN (SELECT asset FROM bars) AS known FROM based d ASOF LEFT JOIN bars o ON d.asset = o.asset AND d.due_ms <= o.t_ms),
noted AS (SELECT *, CASE WHEN b_close IS NOT NULL AND o_close IS NOT NULL THEN 'MEASURED' ELSE 'UNAVAILABLE' END AS label,
  CASE WHEN NOT known THEN 'no history' WHEN signal_ms IS NULL THEN 'unparseable time' WHEN b_close IS NULL AND {NOW} < signal_ms + 86400000 THEN 'pending' WHEN b_close IS NULL THEN 'gap'
  WHEN o_close IS NULL AND {NOW} < due_ms + 86400000 THEN 'pending' WHEN o_close IS NULL THEN 'gap' END AS note, o_close / b_close - 1 AS ret FROM scored)"""


def scored(s, d):
    return T.score_signals(signals(s, d), proxy.bars(s, d), F.lit(NOW))


P.add(
    "asof_forward", lambda s, d: T.asof_forward(signals(s, d), proxy.bars(s, d), "signal_ms", "b").select("file", "asset", F.col("b.t_ms").alias("t_ms"), F.col("b.close").alias("close")),
    f"WITH {SIGNALS} SELECT s.file, s.asset, b.t_ms, b.close AS close FROM signals s ASOF LEFT JOIN bars b ON s.asset = b.asset AND s.signal_ms <= b.t_ms",
)
P.add(
    "score_signals", lambda s, d: scored(s, d).select("file", "horizon", "label", "note", r("forward_return").alias("forward_return")),
    f"{SCORED} SELECT file, horizon, label, note, round(ret, 6) AS forward_return FROM noted",
)
P.add(
    "track_aggregates", lambda s, d: T.track_aggregates(scored(s, d)).withColumns({c: r(c) for c in ("hit_rate", "mean_return", "median_return")}),
    f"""{SCORED} SELECT horizon, count(*) FILTER (label = 'MEASURED') AS n_realized, count(*) FILTER (note = 'pending') AS n_pending,
    count(*) FILTER (label <> 'MEASURED' AND note <> 'pending') AS n_gaps, count(*) FILTER (ret > 0) AS wins,
    CASE WHEN count(ret) > 0 THEN round(count(*) FILTER (ret > 0) / count(ret), 6) END AS hit_rate, round(avg(ret), 6) AS mean_return, round(median(ret), 6) AS median_return,
    count(ret) < 10 AS weak_evidence FROM noted GROUP BY horizon""",
)
P.add(
    "track_population", lambda s, d: T.track_population(proxy.decisions(s, d)),
    f"WITH {proxy.DECISIONS} SELECT count(*) AS total, count(*) FILTER (verdict = 'ALLOWED' AND action = 'ENTER_LONG') AS scored, count(*) FILTER (verdict = 'BLOCKED') AS blocked FROM decisions",
)
P.add(
    "no_calls_by_gate", lambda s, d: T.no_calls_by_gate(proxy.decisions(s, d)),
    f"WITH {proxy.DECISIONS} SELECT gate, count(*) AS n FROM (SELECT unnest(blocked_by) AS gate FROM decisions WHERE verdict = 'BLOCKED') GROUP BY gate",
)


def verified(s, d):
    rows = proxy.decisions(s, d).withColumn("sig_ok", F.when(F.col("pos") % 19 != 0, F.col("pos") % 13 != 0)).withColumn("fails", F.when(F.col("pos") % 13 == 0, F.array(F.lit("bad signature"))))
    good, bad = T.split_verified(rows)
    return good.select("file", F.lit("verified").alias("kind"), F.lit("").alias("fails")).union(bad.select("file", F.lit("excluded"), F.array_join("fails", ",")))


P.add(
    "split_verified", verified,
    f"WITH {proxy.DECISIONS} SELECT file, CASE WHEN pos % 19 = 0 OR pos % 13 = 0 THEN 'excluded' ELSE 'verified' END AS kind, CASE WHEN pos % 13 = 0 THEN 'bad signature' WHEN pos % 19 = 0 THEN 'verification failed' ELSE '' END AS fails FROM decisions",
)


def census(s, d):
    totals, by_action, by_gate = T.refusal_census(proxy.decisions(s, d))
    one = totals.select("run_dir", F.explode(F.map_from_arrays(F.array(*[F.lit(f"total:{c}") for c in ("decisions", "allowed", "blocked")]), F.array("decisions", "allowed", "blocked"))).alias("what", "n"))
    two = by_action.select("run_dir", F.concat(F.lit("action:"), "action").alias("what"), "n")
    return one.union(two).union(by_gate.select("run_dir", F.concat(F.lit("gate:"), "gate").alias("what"), "n"))


P.add(
    "refusal_census", census,
    f"""WITH {proxy.DECISIONS}, lines AS (SELECT run_dir, unnest(list_concat(['total:decisions', CASE WHEN verdict = 'ALLOWED' THEN 'total:allowed' ELSE 'total:blocked' END, 'action:' || action],
    list_transform(blocked_by, lambda g: 'gate:' || g))) AS what FROM decisions),
    zero AS (SELECT DISTINCT run_dir, unnest(['total:allowed', 'total:blocked']) AS what FROM decisions)
    SELECT run_dir, what, sum(n)::BIGINT AS n FROM (SELECT run_dir, what, 1 AS n FROM lines UNION ALL SELECT run_dir, what, 0 FROM zero) GROUP BY ALL""",
)
P.add(
    "cross_run_refusals", lambda s, d: T.cross_run_refusals(proxy.decisions(s, d)).select(F.coalesce("run_dir", F.lit("*")).alias("run_dir"), F.coalesce("gate", F.lit("*")).alias("gate"), "n"),
    f"WITH {proxy.DECISIONS} SELECT coalesce(run_dir, '*') AS run_dir, coalesce(gate, '*') AS gate, count(*) AS n FROM (SELECT run_dir, unnest(blocked_by) AS gate FROM decisions) GROUP BY ROLLUP (run_dir, gate)",
)


def sessions(s, d):
    rows = X.loop_tax(proxy.decisions(s, d).withColumn("session", F.concat("run_dir", F.lit("/"), "asset")), 6)
    return T.session_summary(rows).select("session", "n", F.array_join("decisions", "|").alias("decisions"), "spent", "remaining")


P.add(
    "session_summary", sessions,
    f"""WITH {proxy.DECISIONS}, seen AS (SELECT *, run_dir || '/' || asset AS session, row_number() OVER (PARTITION BY run_dir, asset ORDER BY pos) - 1 AS spent FROM decisions)
    SELECT session, count(*) AS n, string_agg(asset || ':' || action || ':' || verdict || ':' || array_to_string(blocked_by, '+'), '|' ORDER BY pos) AS decisions,
    (max(spent) + 1)::DOUBLE AS spent, min(greatest(0, 6 - spent))::DOUBLE AS remaining FROM seen GROUP BY session""",
)

# Fine-tuning export.
SCORES = f"""{BASE}, facts AS (SELECT *, CASE WHEN ret IS NOT NULL AND z IS NOT NULL AND vol IS NOT NULL THEN least(exp((ln(1 / (1 + exp(-(ret / greatest(vol / sqrt(365) * sqrt(momentum), 1e-9))))) + ln(1 / (1 + exp(z / z_entry))) +
  ln(least(1 - exp(-2 * bar_idx * 0.0001), 0.97))) / 3), 0.97) END AS conviction FROM cells),
warm AS (SELECT *, row_number() OVER (PARTITION BY asset, cell_id, action ORDER BY t_ms) AS k FROM facts WHERE bar_idx >= warmup AND bar_idx < n - 1 AND action <> 'ABSTAIN'),
kept AS (SELECT * FROM warm WHERE action <> 'HOLD' OR k % 7 = 0),
probes AS (SELECT DISTINCT f.* FROM facts f, (SELECT unnest([0, 10]) AS o) WHERE bar_idx = greatest(2, warmup - 1 - o) - 1 AND action = 'ABSTAIN')"""
ROW = ("asset", "cell_id", "bar_idx", "action")
P.add("sft_decisions", lambda s, d: sft.decisions(proxy.bars(s, d)).select(*ROW, r("conviction").alias("conviction")), f"{SCORES} SELECT asset, cell_id, bar_idx, action, round(conviction, 6) AS conviction FROM kept")
P.add("sft_abstain_probes", lambda s, d: sft.abstain_probes(proxy.bars(s, d)).select(*ROW), f"{SCORES} SELECT asset, cell_id, bar_idx, action FROM probes")
def sft_sources(s, d):
    """Per asset the hash of its archived series, and a stand-in for the receipt that pins it."""
    from veritick.sources import sinks

    texts = sinks.series_texts(proxy.bars(s, d))
    receipt = F.concat(F.lit("receipts/backtest_"), "asset", F.lit(".receipt.json"))
    return texts.select("asset", receipt.alias("receipt"), F.sha2(F.concat(F.lit("receipt of "), "asset"), 256).alias("receipt_sha"), F.col("sha256").alias("dataset_sha"))


def sft_messages(s, d):
    """The exported rows, their texts read back field by field."""
    x = sft.export(proxy.bars(s, d), sources=sft_sources(s, d))
    whole, real, text = pa.int32(), pa.float64(), pa.string()
    params = pa.struct([("momentumLookback", whole), ("zWindow", whole), ("zEntry", real), ("volWindow", whole), ("positionFraction", real)])
    evidence = pa.struct([("trailingReturn", real), ("zScore", real), ("annualizedVol", real), ("nObservations", pa.int64())])
    asked = "asOfIso string, params struct<momentumLookback:int,zWindow:int,zEntry:double,volWindow:int,positionFraction:double>, evidence struct<trailingReturn:double,zScore:double,annualizedVol:double,nObservations:bigint>"
    told = "action string, conviction double, components struct<reversion:struct<value:double>>, lambda struct<advisory:boolean>, note string, caveats array<string>"
    components = pa.struct([("reversion", pa.struct([("value", real)]))])
    answer = [("action", text), ("conviction", real), ("components", components), ("lambda", pa.struct([("advisory", pa.bool_())])), ("note", text), ("caveats", pa.list_(pa.field("element", text)))]
    user, said = (F.element_at("messages", k)["content"] for k in (2, 3))
    read = json_rows(pa.schema([("asOfIso", text), ("params", params), ("evidence", evidence)]), asked)(user)
    heard = json_rows(pa.schema(answer), told)(said)
    x = x.select(*ROW, "messages", "provenance", read.alias("user"), heard.alias("said"))
    return x.select(
        *ROW, F.size("messages").alias("n_messages"), F.col("user.asOfIso").alias("as_of"), F.col("user.params.momentumLookback").alias("momentum"), F.col("user.params.zWindow").alias("z_window"),
        F.col("user.params.zEntry").alias("z_entry"), F.col("user.params.volWindow").alias("vol_window"), F.col("user.params.positionFraction").alias("fraction"),
        r("user.evidence.trailingReturn").alias("ret"), r("user.evidence.zScore").alias("z"), r("user.evidence.annualizedVol").alias("vol"), F.col("user.evidence.nObservations").alias("n_obs"),
        user.contains('"trailingReturn":').alias("names_all"), F.col("said.action").alias("said"), r("said.conviction").alias("conviction"), r("said.components.reversion.value").alias("reversion"),
        F.col("said.lambda.advisory").cast("string").alias("advisory"), F.col("said.note").isNotNull().alias("has_note"), F.size("said.caveats").alias("caveats"),
        F.col("provenance.derivation").alias("derivation"), F.col("provenance.sourceReceipt").alias("receipt"), F.col("provenance.receiptSha256").alias("receipt_sha"), F.length("provenance.datasetSha256").alias("sha_length"), F.col("provenance.barIndex").cast("bigint").alias("at"),
    )


GRID_SQL = "(VALUES " + ", ".join(f"({i}, {c.momentum}, {c.z_window}, {float(c.z_entry)}::DOUBLE, {c.vol_window}, {c.fraction}::DOUBLE)" for i, c in enumerate(X.GRID)) + ") g(g_cell, g_momentum, g_zw, g_entry, g_vw, g_fraction)"
P.add(
    "sft_messages", sft_messages,
    f"""{SCORES} SELECT asset, cell_id, bar_idx, action, 3 AS n_messages, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((t_ms % 1000)::VARCHAR, 3, '0') || 'Z' AS as_of, g_momentum AS momentum, g_zw AS z_window,
    g_entry AS z_entry, g_vw AS vol_window, g_fraction AS fraction, round(ret, 6) AS ret, round(z, 6) AS z, round(vol, 6) AS vol, bar_idx AS n_obs, true AS names_all, action AS said,
    CASE WHEN action <> 'ABSTAIN' THEN round(conviction, 6) END AS conviction, CASE WHEN action <> 'ABSTAIN' THEN round(1 / (1 + exp(z / g_entry)), 6) END AS reversion, CASE WHEN action <> 'ABSTAIN' THEN 'true' END AS advisory,
    action = 'ABSTAIN' AS has_note, 4 AS caveats, derivation, 'receipts/backtest_' || asset || '.receipt.json' AS receipt, sha256('receipt of ' || asset) AS receipt_sha, 64 AS sha_length, bar_idx AS at
    FROM (SELECT *, 'deterministic-replay' AS derivation FROM kept UNION ALL SELECT *, NULL AS k, 'deterministic-abstain-drill' FROM probes) JOIN {GRID_SQL} ON g_cell = cell_id""",
)


def sft_manifest(s, d):
    bars = proxy.bars(s, d)
    return sft.manifest(sft.derived(bars), bars)


P.add(
    "sft_manifest", sft_manifest,
    f"""{SCORES} SELECT asset, count(*) AS rows, count(*) FILTER (action = 'ENTER_LONG') AS enter_long, count(*) FILTER (action = 'EXIT_LONG') AS exit_long, count(*) FILTER (action = 'HOLD') AS hold,
    count(*) FILTER (action = 'ABSTAIN') AS abstain, 0::BIGINT AS over_ceiling, any_value(n) AS bars FROM (SELECT asset, action, n FROM kept UNION ALL SELECT asset, action, n FROM probes) GROUP BY asset""",
)
QUERIES, ORACLE_SQL = P.queries, P.sql
