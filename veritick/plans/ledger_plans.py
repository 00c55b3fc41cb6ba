"""Queries of ingest, ledger audits, proofs, books and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritick.operators import book as K
from veritick.operators import ledger as L
from veritick.operators import proofs as O
from veritick.plans.base import Plans, r
from veritick.session import cut, shared_dir, table
from veritick.sources import ingest as I
from veritick.sources import proxy, sinks
from veritick.streaming import jobs

P = Plans()
DAY = 86_400_000


def fresh(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- ingest -----------------------------------------------------------------------------------------------------------
CUT = "(SELECT max((epoch_us(ts) // 1000)) // 86400000 * 86400000 FROM events)"


def normalize_candles(s, d):
    now = table(s, d, "events").agg(F.floor(F.max(proxy.millis("ts")) / DAY) * DAY).first()[0]
    return I.normalize_candles(proxy.ticks(s, d), F.lit(now))


P.add(
    "normalize_candles", normalize_candles,
    f"""SELECT event_type AS product, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t_ms, arg_max(value, event_id) AS close FROM events
    WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND value > 0 AND (epoch_us(ts) // 1000) // {DAY} * {DAY} + {DAY} <= {CUT} GROUP BY ALL""",
)


def price_pairs(s, d):
    e = table(s, d, "events").withColumn("p", F.when(F.col("event_id") % 9 == 0, float("nan")).when(F.col("event_id") % 8 == 0, 0.0).otherwise(F.col("value")))
    pair = F.struct("event_id", F.array(proxy.millis("ts").cast("double"), "p").alias("p"))
    series = e.groupBy(F.col("user_id").alias("series")).agg(F.array_sort(F.collect_list(pair)).alias("prices"))
    return I.normalize_price_pairs(series.select("series", F.transform("prices", lambda x: x["p"]).alias("prices")))


P.add(
    "normalize_price_pairs", price_pairs,
    """SELECT user_id AS series, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, (epoch_us(ts) // 1000) AS t_ms, value AS close, event_id FROM events
    QUALIFY event_id % 9 <> 0 AND event_id % 8 <> 0 AND value > 0""".replace(", event_id FROM events", " FROM events"),
)


def pairs_json(s, d):
    """Snapshots as JSON texts: prices as text, one in nine null, one in ten empty; one in seven liquidities as text."""
    x = proxy.snapshots(s, d)
    p = F.col("pos")
    price = F.when(p % 9 == 0, "null").when(p % 10 == 0, '""').otherwise(F.format_string('"%s"', F.col("price_usd").cast("string")))
    liq = F.when(F.col("liquidity_usd").isNull(), "null").when(p % 7 == 0, F.format_string('"%s"', F.col("liquidity_usd").cast("string"))).otherwise(F.col("liquidity_usd").cast("string"))
    text = F.format_string('{"chainId":"c","dexId":"%s","baseToken":{"address":"%s","symbol":"%s"},"priceUsd":%s,"liquidity":{"usd":%s},"volume":{"h24":%s}}', "dex", "base_address", "base_symbol", price, liq, F.col("volume24h_usd").cast("string"))
    return I.normalize_pairs(x.select("pos", "observed_at_ms", text.alias("json")))


PAIRS = f"""{proxy.SNAPSHOTS}, pairs AS (SELECT pos, base_address, dex, CASE WHEN pos % 9 = 0 OR pos % 10 = 0 THEN 0 ELSE price_usd END AS price_usd,
  CASE WHEN pos % 7 <> 0 THEN liquidity_usd END AS liquidity_usd, volume24h_usd FROM snapshots)"""
PAIR_COLUMNS = ("pos", "base_address", "dex", "price_usd", "liquidity_usd", "volume24h_usd")
P.add("normalize_pairs", lambda s, d: pairs_json(s, d).select(*PAIR_COLUMNS), f"WITH {PAIRS} SELECT * FROM pairs")
P.add(
    "deepest_pair", lambda s, d: I.deepest_pair(pairs_json(s, d)).select(*PAIR_COLUMNS),
    f"WITH {PAIRS} SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY base_address ORDER BY coalesce(liquidity_usd, -1) DESC, pos) = 1",
)


def receipt_files(s, d):
    """Envelopes around decisions as files in memory: one in 23 is not JSON."""
    x = proxy.decisions(s, d)
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    decision = F.struct(
        F.struct(F.when(F.col("pos") % 29 != 0, F.col("symbol")).alias("symbol"), F.col("asset").alias("address")).alias("asset"), F.struct(F.col("price_usd").alias("priceUsd"), iso.alias("observedAtIso")).alias("snapshot"),
        F.col("action").alias("proposedAction"), "verdict", "conviction", F.col("blocked_by").alias("blockedBy"),
    )
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("signal/"), iso).alias("name"))).alias("subject"), F.struct(decision.alias("decision")).alias("predicate")))
    envelope = F.to_json(F.struct(F.regexp_replace(F.base64(F.encode(body, "utf-8")), "\r?\n", "").alias("payload"), F.lit("application/vnd.in-toto+json").alias("payloadType")))
    return x.select(F.concat_ws("/", "run_dir", "file").alias("path"), F.encode(F.when(F.col("pos") % 23 == 0, "{broken").otherwise(envelope), "utf-8").alias("content"))


P.add(
    "read_receipts", lambda s, d: I.read_receipts(receipt_files(s, d)).select("path", F.col("statement.predicate.decision.asset.symbol").alias("symbol"), F.col("statement.predicate.decision.verdict").alias("verdict")),
    f"WITH {proxy.DECISIONS} SELECT run_dir || '/' || file AS path, CASE WHEN pos % 23 <> 0 AND pos % 29 <> 0 THEN symbol END AS symbol, CASE WHEN pos % 23 <> 0 THEN verdict END AS verdict FROM decisions",
)
P.add(
    "extract_decision",
    lambda s, d: I.extract_decision(I.read_receipts(receipt_files(s, d))).select("path", "symbol", "action", "verdict", "price_usd", r("conviction").alias("conviction"), F.array_join("blocked_by", ",").alias("blocked_by"), "signal_ms"),
    f"""WITH {proxy.DECISIONS} SELECT run_dir || '/' || file AS path, symbol, action, verdict, price_usd, round(conviction, 6) AS conviction, array_to_string(list_sort(blocked_by), ',') AS blocked_by,
    ts_ms AS signal_ms FROM decisions WHERE pos % 23 <> 0 AND pos % 29 <> 0""",
)


def text_files(s, d):
    c = table(s, d, "conversations").where("text is not null and conv_id is not null and turn is not null")
    name = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("chain_000"), F.col("turn") % 10, F.lit(".receipt.json"))).otherwise(F.concat(F.lit("turn_"), F.col("turn"), F.lit(".json")))
    return c.select(F.concat(F.lit("led/run-"), F.col("conv_id"), F.lit("/"), name).alias("path"), F.encode("text", "utf-8").alias("content"))


P.add(
    "ledger_file_hashes", lambda s, d: I.ledger_file_hashes(text_files(s, d)),
    "SELECT 'run-' || conv_id AS run_dir, 'turn_' || turn || '.json' AS name, sha256(text) AS sha256 FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL AND turn % 5 <> 4",
)


def sources(s, d):
    """Bars under up to two sources: A (priority 0) lacks whole assets or is too short for some, B has the rest."""
    b = proxy.bars(s, d).withColumn("k", F.col("asset").cast("int"))
    a = b.where("k % 3 <> 0").withColumn("close", F.when(F.col("k") % 4 == 0, float("nan")).otherwise(F.col("close"))).select("asset", F.lit("A").alias("source"), F.lit(0).alias("priority"), "t_ms", "close")
    return a.union(b.where("k % 5 <> 0").select("asset", F.lit("B"), F.lit(1), "t_ms", F.col("close") * 2))


SOURCE = "CASE WHEN asset::INT % 3 <> 0 AND asset::INT % 4 <> 0 AND n >= 2 THEN 'A' WHEN asset::INT % 5 <> 0 AND n >= 2 THEN 'B' END"
P.add(
    "choose_source", lambda s, d: I.choose_source(sources(s, d))[0].select("asset", "source", "t_ms", "close"),
    f"WITH {proxy.BARS} SELECT asset, source, t_ms, CASE WHEN source = 'A' THEN close ELSE close * 2 END AS close FROM (SELECT *, {SOURCE} AS source FROM (SELECT *, count(*) OVER (PARTITION BY asset) AS n FROM bars)) WHERE source IS NOT NULL",
)


def source_report(s, d):
    """With the outcomes of the feeds: A has no mapping for one asset in three, B fails for one in seven."""
    k = F.col("asset").cast("int")
    every = proxy.bars(s, d).select("asset").distinct()
    a = every.select("asset", F.lit("A").alias("source"), F.lit(0).alias("priority"), (k % 3 != 0).alias("ok"), F.when(k % 3 == 0, "no mapping").alias("note"))
    b = every.select("asset", F.lit("B"), F.lit(1), k % 7 != 0, F.when(k % 7 == 0, "timed out"))
    report = I.choose_source(sources(s, d), outcomes=a.union(b))[1]
    attempts = F.array_join(F.transform("attempts", lambda x: F.concat_ws(":", x["source"], x["outcome"])), ",")
    return report.select("asset", "source", "label", attempts.alias("attempts"), "note")


P.add(
    "source_report", source_report,
    f"""WITH {proxy.BARS}, n AS (SELECT asset, asset::INT AS k, count(*) AS n FROM bars GROUP BY asset),
    why AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'no mapping' WHEN k % 4 = 0 THEN 'valid closes: 0 of at least 2' WHEN n < 2 THEN 'valid closes: ' || n || ' of at least 2' END AS a,
      CASE WHEN k % 7 = 0 THEN 'timed out' WHEN k % 5 = 0 THEN 'valid closes: 0 of at least 2' WHEN n < 2 THEN 'valid closes: ' || n || ' of at least 2' END AS b FROM n)
    SELECT asset, CASE WHEN a IS NULL THEN 'A' WHEN b IS NULL THEN 'B' END AS source, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'UNAVAILABLE' ELSE 'REPORTED' END AS label,
    CASE WHEN a IS NULL THEN 'A:ok' WHEN b IS NULL THEN 'A:unavailable,B:ok' ELSE 'A:unavailable,B:unavailable' END AS attempts, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'A: ' || a || ' | B: ' || b END AS note FROM why""",
)


def history(s, d):
    ids = table(s, d, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").cast("string").alias("address"), F.col("s_name").alias("series_id"))
    return I.attach_history(proxy.snapshots(s, d).select("pos", F.col("asset").alias("address")), ids)


P.add(
    "attach_history", history,
    f"WITH {proxy.SNAPSHOTS} SELECT pos, asset AS address, s_name AS series_id, CASE WHEN s_name IS NULL THEN 'no mapped history source' END AS note FROM snapshots LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 6 <> 0) ON s_suppkey::VARCHAR = asset",
)
P.add("series_summary", lambda s, d: I.series_summary(proxy.bars(s, d)), f"WITH {proxy.BARS} SELECT asset, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM bars GROUP BY asset")


def archive_round_trip(s, d):
    """Writes each series under its hash, reads the archive back, and checks names against content."""
    path = fresh(s, "archive")
    sinks.archive_series(proxy.bars(s, d), path)
    sinks.archive_series(proxy.bars(s, d), path)  # writing the same bytes again changes nothing
    files = sinks.read_archive(s, path)
    bars = I.read_series_archive(files.select(F.encode("text", "utf-8").alias("content")))
    named = files.select(F.col("sha256"))
    return bars.join(named, "sha256").groupBy("sha256").agg(F.count("*").alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), r(F.sum("close"), 3).alias("total")).drop("sha256")


ARCHIVE = f"WITH {proxy.BARS} SELECT count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms, round(sum(close), 3) AS total FROM bars GROUP BY asset"
P.add("archive_series", archive_round_trip, ARCHIVE)


def read_archive_rows(s, d):
    """Every bar as the archive gives it back."""
    path = fresh(s, "archive")
    sinks.archive_series(proxy.bars(s, d), path)
    bars = I.read_series_archive(sinks.read_archive(s, path).select(F.encode("text", "utf-8").alias("content")))
    return bars.groupBy("t_ms", "close").agg(F.count("*").alias("n"))


P.add("read_series_archive", read_archive_rows, f"WITH {proxy.BARS} SELECT t_ms, close, count(*) AS n FROM bars GROUP BY ALL")


def jsonl_round_trip(s, d):
    from veritick.operators import sft

    path = fresh(s, "sft")
    rows = sft.derived(proxy.bars(s, d), placed=True)
    sinks.write_jsonl(sft.jsonl(sft.messages(rows)), path, placed=True, compression="gzip")
    line = "messages array<struct<content:string>>, provenance struct<sourceReceipt:string,derivation:string,barIndex:bigint>"
    back = s.read.text(path).select("value", F.from_json("value", line).alias("line"))
    back = back.select("value", "line.provenance", F.get("line.messages.content", F.lit(1)).alias("user"), F.get("line.messages.content", F.lit(2)).alias("said"))
    user = F.from_json("user", "asset string, params struct<momentumLookback:int>, evidence struct<annualizedVol:double>")
    back = back.select("value", "provenance", user.alias("user"), F.from_json("said", "action string").alias("said"))
    return back.select(
        F.substring_index("provenance.sourceReceipt", "/", -1).alias("asset"), F.col("user.asset").alias("named"), "provenance.derivation", F.col("provenance.barIndex").alias("bar_idx"),
        F.col("user.params.momentumLookback").alias("momentum"), "said.action", r(F.col("user.evidence.annualizedVol")).alias("vol"), F.col("value").contains("volWindow").alias("whole"),
    ).groupBy("asset", "named", "derivation", "bar_idx", "momentum", "action", "vol", "whole").agg(F.count("*").alias("n"))


def _jsonl_sql() -> str:
    from veritick.plans.replay_plans import SCORES

    return f"""{SCORES} SELECT asset, asset AS named, derivation, bar_idx, momentum, action, round(vol, 6) AS vol, true AS whole, count(*) AS n
    FROM (SELECT asset, bar_idx, momentum, action, vol, 'deterministic-replay' AS derivation FROM kept UNION ALL SELECT asset, bar_idx, momentum, action, vol, 'deterministic-abstain-drill' FROM probes) GROUP BY ALL"""


P.add("write_sft_jsonl", jsonl_round_trip, _jsonl_sql())

# -- chains -----------------------------------------------------------------------------------------------------------


def both(s, d):
    return proxy.links(s, d), proxy.ledger_files(s, d)


OPEN = "SELECT ledger, run_dir FROM files f WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.ledger = f.ledger AND l.run_dir = f.run_dir)"
P.add("unsealed_dirs", lambda s, d: L.unsealed_dirs(proxy.ledger_files(s, d), proxy.links(s, d)), f"WITH {proxy.LINKS} {OPEN}")
P.add("latest_head", lambda s, d: L.latest_head(proxy.links(s, d)).select("ledger", "seq", "file", "readable"), f"WITH {proxy.LINKS} SELECT ledger, max(seq) AS seq, max(file) AS file, true AS readable FROM links GROUP BY ledger")
P.add(
    "file_set_diff", lambda s, d: L.file_set_diff(proxy.ledger_files(s, d), proxy.links(s, d)).select("ledger", "run_dir", "name", "difference"),
    f"WITH {proxy.LINKS} SELECT ledger, run_dir, name, 'rewritten' AS difference FROM links WHERE sealed_sha <> sha",
)
P.add(
    "audit_chain", lambda s, d: L.audit_chain(*both(s, d)),
    f"""WITH {proxy.LINKS} SELECT ledger, seq::VARCHAR AS at, 'previous sha differs' AS problem FROM (SELECT *, lag(sha) OVER (PARTITION BY ledger ORDER BY seq) AS real_sha FROM links) WHERE seq > 1 AND prev_sha <> real_sha
    UNION ALL SELECT ledger, run_dir, 'dir not sealed' FROM ({OPEN}) UNION ALL SELECT ledger, run_dir || '/' || name, 'file rewritten' FROM links WHERE sealed_sha <> sha""",
)
P.add(
    "build_chain_link", lambda s, d: L.build_chain_link(proxy.ledger_files(s, d), proxy.links(s, d)).select("ledger", "seq", F.col("prev.sha256").alias("prev_sha"), F.array_join(F.transform("covers", lambda c: c["dir"]), ",").alias("covers"), "error"),
    f"""WITH {proxy.LINKS}, open AS ({OPEN}), head AS (SELECT ledger, max(seq) AS seq, arg_max(sha, seq) AS sha FROM links GROUP BY ledger)
    SELECT ledger, coalesce(h.seq, 0) + 1 AS seq, h.sha AS prev_sha, covers, NULL::VARCHAR AS error FROM (SELECT ledger, string_agg(run_dir, ',' ORDER BY run_dir) AS covers FROM open GROUP BY ledger) LEFT JOIN head h USING (ledger)""",
)
P.add("chain_coverage", lambda s, d: L.chain_coverage(proxy.links(s, d)), f"WITH {proxy.LINKS} SELECT ledger, seq, 1::BIGINT AS dirs, 1::BIGINT AS files FROM links")


def receipts(s, d):
    """Witness receipts: for two links of three, with a proof for one of two of those."""
    x = proxy.links(s, d).where("seq % 3 <> 0")
    return x.select("ledger", "seq", (F.col("seq") % 2 == 0).alias("has_proof"), F.concat(F.lit("witness_"), F.lpad(F.col("seq").cast("string"), 4, "0"), F.lit("_1.receipt.json")).alias("file"))


def stamps(s, d):
    return receipts(s, d).where("seq % 5 = 1").select("ledger", "seq")


P.add("witness_targets", lambda s, d: L.witness_targets(proxy.links(s, d), receipts(s, d), True).select("ledger", "seq"), f"WITH {proxy.LINKS} SELECT ledger, seq FROM links WHERE NOT (seq % 3 <> 0 AND seq % 2 = 0)")
P.add(
    "witness_head_targets", lambda s, d: L.witness_targets(proxy.links(s, d), receipts(s, d)).select("ledger", "seq"),
    f"WITH {proxy.LINKS} SELECT ledger, seq FROM (SELECT ledger, max(seq) AS seq FROM links GROUP BY ledger) WHERE seq % 3 = 0",
)
P.add(
    "timestamp_targets", lambda s, d: L.timestamp_targets(receipts(s, d), stamps(s, d), True).select("ledger", "seq", "file"),
    f"WITH {proxy.LINKS} SELECT ledger, seq, 'witness_' || lpad(seq::VARCHAR, 4, '0') || '_1.receipt.json' AS file FROM links WHERE seq % 3 <> 0 AND seq % 5 <> 1",
)
P.add(
    "anchor_coverage", lambda s, d: L.anchor_coverage(proxy.links(s, d), receipts(s, d), stamps(s, d)),
    f"WITH {proxy.LINKS} SELECT ledger, count(*) AS links, count(*) FILTER (seq % 3 <> 0) AS anchored, count(*) FILTER (seq % 3 <> 0 AND seq % 2 = 0) AS proven, count(*) FILTER (seq % 3 <> 0 AND seq % 5 = 1) AS timestamped FROM links GROUP BY ledger",
)


def dirs_and_books(s, d):
    """Days of events as dirs of one ledger per event type; every fourth day has a book."""
    e = table(s, d, "events").select(F.col("event_type").alias("ledger"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("run_dir")).distinct()
    day = F.dayofmonth(F.to_date("run_dir"))
    return e.where(day % 4 == 0).withColumn("seq", day.cast("bigint")), e


P.add(
    "skipped_run_dirs", lambda s, d: L.skipped_run_dirs(*dirs_and_books(s, d)),
    """WITH dirs AS (SELECT DISTINCT event_type AS ledger, strftime(ts, '%Y-%m-%d') AS run_dir, CASE WHEN day(ts) % 4 = 0 THEN day(ts) END AS seq FROM events)
    SELECT ledger, run_dir, after_seq FROM (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY ledger ORDER BY run_dir ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_seq,
    first_value(seq IGNORE NULLS) OVER (PARTITION BY ledger ORDER BY run_dir ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM dirs) WHERE seq IS NULL AND later IS NOT NULL""",
)


def names(s, d, k):
    return table(s, d, "events").where(F.col("event_id") % k == 0).select(F.concat(F.lit("obs_"), F.floor(F.col("event_id") / 2), F.lit(".json")).alias("name"))


P.add(
    "new_observations", lambda s, d: L.new_observations(names(s, d, 1), names(s, d, 6)),
    "SELECT DISTINCT 'obs_' || (event_id // 2) || '.json' AS name FROM events WHERE event_id // 2 NOT IN (SELECT event_id // 2 FROM events WHERE event_id % 6 = 0)",
)


def diff(s, d):
    signed = proxy.decisions(s, d).select("file", "pos", "action", "verdict", "conviction")
    again = signed.where("pos % 17 <> 3").withColumn("verdict", F.when(F.col("pos") % 13 == 5, "FORGED").otherwise(F.col("verdict")))
    return L.recompute_diff(signed, again, ["file"], ["action", "verdict", "conviction"])


P.add(
    "recompute_diff", diff,
    f"""WITH {proxy.DECISIONS} SELECT file, CASE WHEN pos % 17 = 3 OR pos % 13 = 5 THEN 'FAIL' ELSE 'OK' END AS status,
    CASE WHEN pos % 17 = 3 THEN 'missing' WHEN pos % 13 = 5 THEN 'verdict' END AS first_difference FROM decisions""",
)


def stored_census(s, d):
    from veritick.operators.track import refusal_census

    x = proxy.decisions(s, d)
    stored = refusal_census(x)[0].withColumn("blocked", F.when(F.substring("run_dir", -1, 1) == "3", F.col("blocked") + 1).otherwise(F.col("blocked")))
    return L.audit_refusals(x, stored)


P.add(
    "audit_refusals", stored_census,
    f"""WITH {proxy.DECISIONS} SELECT run_dir, CASE WHEN run_dir LIKE '%3' THEN 'FAIL' ELSE 'OK' END AS status, CASE WHEN run_dir LIKE '%3' THEN 'blocked' END AS first_difference
    FROM decisions GROUP BY run_dir""",
)


def recompute(s, d):
    """A receipt per archived series; one in eight each forged, tampered with, without its archive, with another path, without any."""
    from veritick.operators import backtest as B

    bars = proxy.bars(s, d)
    again, texts = cut(B.walk_forward(bars)), cut(sinks.series_texts(bars))  # both are read twice
    k = F.col("asset").cast("int") % 8
    path = F.concat(F.lit("data/datasets/"), "sha256", F.lit(".json"))
    receipts = texts.join(bars.groupBy("asset").agg(F.count("*").cast("int").alias("n")), "asset").select(
        F.concat(F.lit("backtest_"), "asset").alias("path"), "asset", F.when(k == 4, F.concat(F.lit("../"), path)).when(k != 5, path).alias("archive_path"), F.col("sha256").alias("dataset_sha"),
        F.when(k == 6, F.col("n") + 1).otherwise(F.col("n")).alias("dataset_n"), F.lit(5).alias("n_cells"), F.lit(0.7).alias("share"), F.lit(10_000.0).alias("start_usd"), F.lit(30.0).alias("fee_bps"), F.when(k != 7, 20.0).alias("slippage_bps"),
    )
    archive = texts.where(k != 3).select(path.alias("path"), F.when(k == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("content"))
    signed = again.withColumn("n_trades", F.when(k == 1, F.col("n_trades") + 1).otherwise(F.col("n_trades"))).withColumn("path", F.concat(F.lit("backtest_"), "asset"))
    return L.audit_recompute(receipts, archive, signed, again)


P.add(
    "audit_recompute", recompute,
    f"""WITH {proxy.BARS} SELECT 'backtest_' || asset AS path, CASE WHEN k = 5 THEN 'SKIP' WHEN why IS NULL THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN k = 5 THEN 'no archive declared' ELSE why END AS reason
    FROM (SELECT *, CASE WHEN k = 1 AND n < 2 THEN 'archive rows invalid' WHEN k = 1 THEN 'recomputed result differs: n_trades' WHEN k = 2 THEN 'archive bytes differ' WHEN k = 3 THEN 'archive missing' WHEN k = 4 THEN 'archive path is not the canonical one'
      WHEN n < 2 THEN 'archive rows invalid' WHEN k = 6 THEN 'row count differs' WHEN k = 7 THEN 'no costs' END AS why FROM (SELECT asset, asset::INT % 8 AS k, count(*) AS n FROM bars GROUP BY asset))""",
)


def receipts_to_audit(s, d):
    from veritick.functions.helpers import canonical_digest

    x = proxy.decisions(s, d)
    gates = F.transform("blocked_by", lambda g: F.struct(g.alias("gate"), F.lit("BLOCKED").alias("verdict"), F.lit("over").alias("reason")))
    mode = F.struct(F.when(F.col("pos") % 59 == 0, "LIVE").otherwise(L.POSTURE).alias("mode"), (F.col("pos") % 61 == 0).alias("provenTrust"))
    ids = F.array(*map(F.lit, reversed(L.LOCKED)))
    locked = F.when(F.col("pos") % 67 == 0, F.slice(ids, 1, 7)).otherwise(ids)
    said = F.when(F.col("pos") % 71 == 0, "a theorem, once Conjecture 1").when(F.col("pos") % 73 == 0, "open").otherwise("Conjecture 1, advisory")
    block = F.to_json(F.struct(mode.alias("posture"), F.when(F.col("pos") % 79 == 0, 0.98).otherwise(0.97).alias("trustCeiling"), locked.alias("lockedProvenFormulaIds"), said.alias("lambdaStatus")))
    x = x.withColumn("doctrine", F.when(F.col("pos") % 83 != 0, block))
    gates = F.when(F.col("pos") % 41 == 2, F.concat(gates, F.array(F.struct(F.lit("late").alias("gate"), F.lit("BLOCKED").alias("verdict"), F.lit("").alias("reason"))))).otherwise(gates)
    x = x.select("file", "pos", "doctrine", F.to_json(F.struct("verdict", F.when(F.col("pos") % 31 == 0, 0.99).otherwise(0.5).alias("conviction"), F.when(F.col("pos") % 37 != 0, gates).alias("gates"))).alias("payload"))
    return x.select(
        F.col("file").alias("path"), F.lit("application/vnd.in-toto+json").alias("payload_type"), F.lit("k1").alias("key_id"), F.when(F.col("pos") % 43 == 0, "k2").otherwise("k1").alias("pinned_key_id"),
        (F.col("pos") % 47 != 0).alias("sig_ok"), F.lit("https://in-toto.io/Statement/v1").alias("statement_type"), "payload", "doctrine", F.when(F.col("pos") % 53 == 0, "00").otherwise(canonical_digest("payload")).alias("subject_sha"),
    )


P.add(
    "audit_receipts", lambda s, d: L.audit_receipts(receipts_to_audit(s, d)),
    f"""WITH {proxy.DECISIONS} SELECT file AS path, unnest(list_filter([CASE WHEN pos % 47 = 0 THEN 'signature invalid' END, CASE WHEN pos % 43 = 0 THEN 'key not pinned' END,
    CASE WHEN pos % 31 = 0 THEN 'trust above ceiling' END, CASE WHEN pos % 53 = 0 THEN 'subject digest' END, CASE WHEN pos % 37 = 0 AND verdict = 'BLOCKED' THEN 'blocked without a gate' END,
    CASE WHEN pos % 41 = 2 AND pos % 37 <> 0 AND verdict = 'BLOCKED' THEN 'blocking gate without a reason' END, CASE WHEN pos % 83 = 0 THEN 'no doctrine' END, CASE WHEN pos % 83 <> 0 AND pos % 59 = 0 THEN 'posture' END,
    CASE WHEN pos % 83 <> 0 AND pos % 61 = 0 THEN 'trust not locked' END, CASE WHEN pos % 83 <> 0 AND pos % 79 = 0 THEN 'ceiling' END, CASE WHEN pos % 83 <> 0 AND pos % 67 = 0 THEN 'locked set' END,
    CASE WHEN pos % 83 <> 0 AND pos % 73 = 0 AND pos % 71 <> 0 THEN 'status without its conjecture' END, CASE WHEN pos % 83 <> 0 AND pos % 71 = 0 THEN 'status claims a theorem' END], lambda x: x IS NOT NULL)) AS problem FROM decisions""",
)

# -- checkpoints --------------------------------------------------------------------------------------------------------
C = proxy.CHECKPOINTS
FIRST = "first AS (SELECT origin, tree_size, arg_min(root_hex, pos) AS root_hex, arg_min(source, pos) AS source FROM checkpoints GROUP BY ALL)"
EDGES = f"{FIRST}, edges AS (SELECT * FROM (SELECT origin, lag(tree_size) OVER w AS prev_size, tree_size AS next_size, lag(root_hex) OVER w AS prev_root, root_hex AS next_root FROM first WINDOW w AS (PARTITION BY origin ORDER BY tree_size)) WHERE prev_size IS NOT NULL)"


def proven(s, d):
    return O.edges(proxy.checkpoints(s, d)).where("next_size % 3 = 0").select("origin", "prev_size", "next_size")


P.add(
    "split_views", lambda s, d: O.split_views(proxy.checkpoints(s, d)),
    f"WITH {C}, {FIRST} SELECT c.origin, c.tree_size, f.root_hex AS first_root, c.root_hex, f.source AS first_source, c.source, c.pos FROM checkpoints c JOIN first f ON c.origin = f.origin AND c.tree_size = f.tree_size WHERE c.root_hex <> f.root_hex",
)
P.add(
    "consistency_targets", lambda s, d: O.consistency_targets(proxy.checkpoints(s, d), proven(s, d)),
    f"WITH {C}, {EDGES} SELECT * FROM edges WHERE next_size % 3 <> 0",
)
P.add(
    "audit_history", lambda s, d: O.audit_history(proxy.checkpoints(s, d), proven(s, d)),
    f"""WITH {C}, {EDGES} SELECT origin, prev_size || '-' || next_size AS at, 'step without a proof' AS problem FROM edges WHERE next_size % 3 <> 0
    UNION ALL SELECT origin, tree_size::VARCHAR, 'split view' FROM checkpoints GROUP BY origin, tree_size HAVING count(DISTINCT root_hex) > 1""",
)
P.add("edge_coverage", lambda s, d: O.edge_coverage(proxy.checkpoints(s, d), proven(s, d)), f"WITH {C}, {EDGES} SELECT origin, count(*) AS edges, count(*) FILTER (next_size % 3 = 0) AS proven FROM edges GROUP BY origin")


def observed(s, d):
    """An observation per adjacent pair of documents of one source: the engine saw the first, the observer the second."""
    from veritick.operators.ordered import with_previous

    x = with_previous(proxy.checkpoints(s, d), "origin", "pos", ["tree_size", "root_hex"], "after", ahead=True)
    pair = lambda o, z, h: F.struct(o.alias("origin"), z.alias("tree_size"), h.alias("root_hex"))
    x = x.select("pos", "origin", pair(F.col("origin"), F.col("tree_size"), F.col("root_hex")).alias("engine"), pair(F.when(F.col("pos") % 5 == 0, F.lit("other")).otherwise(F.col("origin")), F.col("after.tree_size"), F.col("after.root_hex")).alias("live"))
    x = x.where("live.tree_size is not null")
    stated = F.when(F.col("pos") % 7 == 0, "PREFIX_OK").when(F.col("live.origin") != F.col("engine.origin"), "SHARD_ROTATED").when(F.col("live.tree_size") < F.col("engine.tree_size"), "LOG_REGRESSED").otherwise("SPLIT_VIEW")
    return x.select(F.col("origin").alias("ledger"), "pos", "engine", "live", F.array().cast("array<string>").alias("proof"), stated.alias("verdict"), F.lit(True).alias("chain_binding_verified"), F.concat(F.lit("obs_"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("file"), F.col("pos").alias("observed_at"))


OBS = f"""{C}, obs AS (SELECT * FROM (SELECT pos, origin, tree_size AS e_size, root_hex AS e_root, lead(tree_size) OVER (PARTITION BY origin ORDER BY pos) AS l_size, lead(root_hex) OVER (PARTITION BY origin ORDER BY pos) AS l_root FROM checkpoints)
  WHERE l_size IS NOT NULL),
judged AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 'PREFIX_OK' WHEN pos % 5 = 0 THEN 'SHARD_ROTATED' WHEN l_size < e_size THEN 'LOG_REGRESSED' ELSE 'SPLIT_VIEW' END AS verdict,
  CASE WHEN pos % 5 = 0 THEN 'SHARD_ROTATED' WHEN l_size < e_size THEN 'LOG_REGRESSED' WHEN l_size = e_size AND l_root = e_root THEN 'ROOTS_EQUAL' ELSE 'SPLIT_VIEW' END AS expected FROM obs)"""
P.add("gossip_verdict", lambda s, d: O.gossip_verdict(observed(s, d)).select("pos", "verdict", "expected", "agrees"), f"WITH {OBS} SELECT pos, verdict, expected, verdict = expected AS agrees FROM judged")
P.add("verdict_census", lambda s, d: O.verdict_census(observed(s, d)), f"WITH {OBS} SELECT verdict, count(*) AS n, 'obs_' || lpad(max(pos)::VARCHAR, 9, '0') AS newest FROM judged GROUP BY verdict")
P.add(
    "union_checkpoints", lambda s, d: O.union_checkpoints(proxy.checkpoints(s, d), observed(s, d)).select("origin", "tree_size", "root_hex", "source", F.col("pos.set").alias("part"), F.col("pos.pos").alias("pos")),
    f"""WITH {OBS} SELECT origin, tree_size, root_hex, source, 0 AS part, pos FROM checkpoints UNION ALL SELECT origin, e_size, e_root, 'observer-engine', 1, pos FROM obs
    UNION ALL SELECT CASE WHEN pos % 5 = 0 THEN 'other' ELSE origin END, l_size, l_root, 'gossip-observation', 2, pos FROM obs""",
)
P.add(
    "divergence_report", lambda s, d: O.divergence_report(observed(s, d), proxy.checkpoints(s, d).withColumn("ledger", F.col("origin"))).select("ledger", "observations", "alarms", "status"),
    f"""WITH {OBS}, per AS (SELECT origin, count(*) AS observations, count(*) FILTER (verdict NOT IN ('PREFIX_OK', 'ROOTS_EQUAL', 'SHARD_ROTATED') OR verdict <> expected) AS alarms FROM judged GROUP BY origin)
    SELECT ledger, coalesce(observations, 0) AS observations, coalesce(alarms, 0) AS alarms, CASE WHEN observations IS NULL THEN 'NO_DATA' ELSE 'DIVERGENCE' END AS status
    FROM (SELECT DISTINCT origin AS ledger FROM checkpoints) LEFT JOIN per ON ledger = origin""",
)


def bound(s, d):
    x = proxy.decisions(s, d).select("pos", F.col("file").alias("witness_file"), F.concat(F.lit("c"), "file").alias("chain_file"), F.sha2("file", 256).alias("witness_sha"), F.sha2("symbol", 256).alias("chain_sha"), (F.col("pos") % 11 != 0).alias("chain_binding_verified"), F.lit("PREFIX_OK").alias("verdict"))
    w = x.where("pos % 3 <> 0").select(F.col("witness_file").alias("file"), F.when(F.col("pos") % 5 == 0, "x").otherwise(F.col("witness_sha")).alias("sha256"))
    c = x.where("pos % 7 <> 0").select(F.col("chain_file").alias("file"), F.when(F.col("pos") % 4 == 0, "x").otherwise(F.col("chain_sha")).alias("sha256"))
    return O.bind_observations(x, w, c).select("pos", "reason")


P.add(
    "bind_observations", bound,
    """SELECT event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'witness absent' WHEN event_id % 5 = 0 THEN 'witness differs' WHEN event_id % 7 = 0 THEN 'chain absent' WHEN event_id % 4 = 0 THEN 'chain differs'
    WHEN event_id % 11 = 0 THEN 'good verdict on a failed binding' END AS reason FROM events""",
)


def endpoints(s, d):
    w = proxy.checkpoints(s, d).select(F.concat(F.lit("w"), "pos").alias("file"), F.sha2("root_hex", 256).alias("sha256"), "origin", "tree_size", "root_hex", "pos")
    side = lambda n: w.select("pos", F.col("file").alias(f"{n}_file"), F.col("sha256").alias(f"{n}_sha"), F.col("tree_size").alias(f"{n}_size"), F.col("root_hex").alias(f"{n}_root"), F.col("origin").alias(f"{n}_origin"))
    rec = side("prev").join(side("next").withColumn("pos", F.col("pos") - 1), "pos").withColumn("origin", F.col("prev_origin"))
    return O.consistency_endpoints(rec, w.where("pos % 6 <> 0").drop("pos")).select("pos", "problem")


P.add(
    "consistency_endpoints", endpoints,
    f"""WITH {C} SELECT p.pos, CASE WHEN p.pos % 6 = 0 THEN 'prev receipt absent' WHEN n.pos % 6 = 0 THEN 'next receipt absent' WHEN n.origin <> p.origin THEN 'next checkpoint differs' END AS problem
    FROM checkpoints p JOIN checkpoints n ON n.pos = p.pos + 1""",
)


def gossip_counts(s, d):
    obs = proxy.decisions(s, d).select(F.col("run_dir").alias("ledger"))
    stated = obs.groupBy("ledger").agg(F.count("*").alias("archived_total")).where(F.substring("ledger", -1, 1).cast("int") % 3 != 0)
    stated = stated.select("ledger", F.lit(1).alias("seq"), F.lit(1).alias("ms"), (F.col("archived_total") + F.substring("ledger", -1, 1).cast("int") % 2).alias("archived_total"))
    return O.audit_gossip_counts(stated, obs)


P.add(
    "audit_gossip_counts", gossip_counts,
    f"""WITH {proxy.DECISIONS} SELECT ledger, present, stated, coalesce(stated = present, present = 0) AS ok FROM (SELECT run_dir AS ledger, count(*) AS present,
    CASE WHEN right(run_dir, 1)::INT % 3 <> 0 THEN count(*) + right(run_dir, 1)::INT % 2 END AS stated FROM decisions GROUP BY run_dir)""",
)


def small_trees(s, d):
    """Every turn of a conversation as a leaf of its own tree of three, at place turn % 3; one root in four is wrong."""
    from veritick.functions import scalars as S

    t = table(s, d, "conversations").where("text is not null and conv_id is not null and turn is not null").select("conv_id", "turn", S.leaf_hash(F.encode("text", "utf-8")).alias("leaf_hash"))
    one, two, at = F.sha2(F.col("turn").cast("string"), 256), F.sha2(F.col("conv_id").cast("string"), 256), F.col("turn") % 3
    first, second, third = (F.when(at == k, F.col("leaf_hash")).otherwise(x) for k, x in ((0, one), (1, F.when(at == 0, one).otherwise(two)), (2, two)))
    t = t.select("conv_id", "turn", at.cast("bigint").alias("leaf_index"), "leaf_hash", first.alias("l0"), second.alias("l1"), third.alias("l2"))
    t = t.withColumn("pair", S.node_hash("l0", "l1"))
    path = F.when(F.col("leaf_index") == 0, F.array("l1", "l2")).when(F.col("leaf_index") == 1, F.array("l0", "l2")).otherwise(F.array("pair"))
    root = F.when(F.col("turn") % 4 == 3, F.col("l2")).otherwise(S.node_hash("pair", "l2"))
    return t.select("conv_id", "turn", "leaf_index", F.lit(3).cast("bigint").alias("tree_size"), "leaf_hash", path.alias("path"), root.alias("root_hex"), "pair", "l2")


TURN = "FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL"
P.add("audit_inclusion", lambda s, d: O.audit_inclusion(small_trees(s, d)).select("conv_id", "turn", "problem"), f"SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'root' END AS problem {TURN}")


def small_proofs(s, d):
    """The tree of the first two leaves as a prefix of that of all three; one old root in five is wrong."""
    x = small_trees(s, d)
    old = F.when(F.col("turn") % 5 == 4, F.col("l2")).otherwise(F.col("pair"))
    return O.audit_consistency(x.select("conv_id", "turn", F.lit(2).cast("bigint").alias("first_size"), F.lit(3).cast("bigint").alias("second_size"), old.alias("first_root"), F.col("root_hex").alias("second_root"), F.array("l2").alias("proof")))


P.add("audit_consistency", lambda s, d: small_proofs(s, d).select("conv_id", "turn", "problem"), f"SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR turn % 5 = 4 THEN 'new-root' END AS problem {TURN}")


def witnessed(s, d):
    x = small_trees(s, d)
    proof = F.when(F.col("turn") % 3 != 0, F.struct("leaf_index", "tree_size", "leaf_hash", "path", "root_hex"))
    file = F.concat_ws("-", "conv_id", "turn")
    w = x.select(file.alias("file"), F.lit("r").alias("run_dir"), file.alias("chain_file"), F.col("leaf_hash").alias("chain_sha"), F.when(F.col("turn") % 5 == 1, "other").otherwise(F.col("leaf_hash")).alias("data_sha"), proof.alias("proof"), F.struct("tree_size", "root_hex").alias("checkpoint"))
    chains = w.select("run_dir", F.col("chain_file").alias("file"), F.col("chain_sha").alias("sha256"))
    return O.audit_witness(w, chains)


P.add(
    "audit_witness", witnessed,
    f"""SELECT file, unnest(list_filter([CASE WHEN turn % 5 = 1 THEN 'log entry is of other bytes' END, CASE WHEN turn % 3 <> 0 AND turn % 4 = 3 THEN 'inclusion' END], lambda x: x IS NOT NULL)) AS problem
    FROM (SELECT conv_id || '-' || turn AS file, turn {TURN})""",
)

# -- books ------------------------------------------------------------------------------------------------------------
BOOK = ("book_id", "run_dir", "seq", "symbol", "event", "why", "micro", "qty_e9", "cash_micro", "equity_micro")


def book_rows(s, d):
    """A book per five users; prices as they are, those below the money quantum too."""
    return proxy.decisions(s, d).withColumn("book_id", F.concat(F.lit("B"), F.floor(F.substring("symbol", 2, 18).cast("bigint") / 5)))


def _micro(x: str) -> str:
    return f"(round(({x})::VARCHAR::DECIMAL(38, 15), 6) * 1000000)::HUGEINT"


BOOKS = f"""{proxy.DECISIONS}, rows AS (SELECT *, 'B' || (substr(symbol, 2)::BIGINT // 5) AS book_id FROM decisions),
prices AS (SELECT book_id, run_dir, map_from_entries(list((symbol, price))) AS price FROM (SELECT book_id, run_dir, symbol, arg_max(price_usd, pos) AS price FROM rows WHERE price_usd > 0 GROUP BY ALL) GROUP BY ALL),
steps AS (SELECT r.*, coalesce(p.price, MAP {{}}) AS price, dense_rank() OVER (PARTITION BY r.book_id ORDER BY r.run_dir) AS seq, row_number() OVER (PARTITION BY r.book_id ORDER BY r.run_dir, symbol, pos) AS k
  FROM rows r LEFT JOIN prices p ON p.book_id = r.book_id AND p.run_dir = r.run_dir),
fold AS (
  SELECT DISTINCT book_id, 0::BIGINT AS k, 10000000000::HUGEINT AS cash, []::STRUCT(s VARCHAR, q HUGEINT)[] AS held, ''::VARCHAR AS symbol, ''::VARCHAR AS event, ''::VARCHAR AS why, 0::HUGEINT AS micro, 0::HUGEINT AS qty FROM rows
  UNION ALL
  SELECT book_id, k, CASE event WHEN 'BUY' THEN cash - want WHEN 'SELL' THEN cash + got ELSE cash END,
    CASE event WHEN 'BUY' THEN CASE WHEN bought > 0 THEN list_append(held, {{'s': symbol, 'q': bought}}) ELSE held END WHEN 'SELL' THEN list_filter(held, lambda h: h.s <> symbol) ELSE held END,
    symbol, event, why, CASE WHEN event IN ('BUY', 'SKIPPED_INSUFFICIENT_CASH') THEN want WHEN event = 'SELL' THEN got ELSE 0 END, CASE event WHEN 'BUY' THEN bought WHEN 'SELL' THEN own ELSE 0 END
  FROM (SELECT *, CASE WHEN why = 'entry' THEN 'BUY' WHEN why = 'exit' THEN 'SELL' WHEN why = 'insufficient cash' THEN 'SKIPPED_INSUFFICIENT_CASH' ELSE 'NONE' END AS event,
      CASE WHEN why = 'entry' THEN want * 1000000000 // dear END AS bought, own * cheap // 1000000000 AS got FROM (
    SELECT *, CASE WHEN verdict <> 'ALLOWED' THEN 'blocked' WHEN action = 'ENTER_LONG' AND own > 0 THEN 'already long' WHEN action = 'ENTER_LONG' AND NOT priced THEN 'no price' WHEN action = 'ENTER_LONG' AND now IS NULL THEN 'open position unpriced'
      WHEN action = 'ENTER_LONG' AND NOT (want > 0 AND want <= cash) THEN 'insufficient cash' WHEN action = 'ENTER_LONG' AND dear <= 0 THEN 'price below quantum' WHEN action = 'ENTER_LONG' THEN 'entry'
      WHEN action = 'EXIT_LONG' AND own = 0 THEN 'no position' WHEN action = 'EXIT_LONG' AND NOT priced THEN 'no price' WHEN action = 'EXIT_LONG' THEN 'exit' ELSE 'no book action' END AS why FROM (
      SELECT *, now * 1000 // 10000 AS want FROM (
        SELECT t.book_id, t.k, t.symbol, t.action, t.verdict, f.cash, f.held, coalesce(t.price_usd > 0, false) AS priced, coalesce(list_sum(list_transform(list_filter(f.held, lambda h: h.s = t.symbol), lambda h: h.q)), 0)::HUGEINT AS own,
          {_micro("t.price_usd * 1.005")} AS dear, {_micro("t.price_usd * 0.995")} AS cheap,
          CASE WHEN len(list_filter(f.held, lambda h: t.price[h.s] IS NULL)) = 0 THEN f.cash + coalesce(list_sum(list_transform(f.held, lambda h: h.q * {_micro("t.price[h.s]")} // 1000000000)), 0)::HUGEINT END AS now
        FROM fold f JOIN steps t ON t.book_id = f.book_id AND t.k = f.k + 1))))),
ends AS (SELECT s.book_id, s.seq, arg_max(f.cash, s.k) AS cash, arg_max(f.held, s.k) AS held, any_value(s.price) AS price FROM fold f JOIN steps s ON s.book_id = f.book_id AND s.k = f.k GROUP BY ALL),
marks AS (SELECT *, CASE WHEN len(list_filter(held, lambda h: price[h.s] IS NULL)) = 0 THEN cash + coalesce(list_sum(list_transform(held, lambda h: h.q * {_micro("price[h.s]")} // 1000000000)), 0)::HUGEINT END AS mark FROM ends)"""
REPLAYED = f"""WITH RECURSIVE {BOOKS} SELECT s.book_id, s.run_dir, s.seq::INT AS seq, s.symbol, f.event, f.why, f.micro::BIGINT AS micro, f.qty::VARCHAR AS qty_e9, m.cash::VARCHAR AS cash_micro, m.mark::VARCHAR AS equity_micro
FROM steps s JOIN fold f ON f.book_id = s.book_id AND f.k = s.k JOIN marks m ON m.book_id = s.book_id AND m.seq = s.seq"""
P.add("book_replay", lambda s, d: K.book_replay(book_rows(s, d)).select(*BOOK), REPLAYED)


def audited(s, d):
    """Signed links with every tenth run's cash or events forged: the link and, for cash, the one after it fail."""
    rows = book_rows(s, d)
    links = K.book_links(K.book_replay(rows))
    forged = links.withColumn("cash_micro", F.when(F.col("seq") % 10 == 7, F.concat("cash_micro", F.lit("0"))).otherwise(F.col("cash_micro")))
    return K.audit_book(forged.withColumn("events", F.when(F.col("seq") % 10 == 3, "[]").otherwise(F.col("events"))), rows).where("seq % 10 <> 8")


P.add(
    "audit_book", audited,
    """WITH rows AS (SELECT DISTINCT 'B' || (user_id // 5) AS book_id, strftime(ts, '%Y-%m-%d') AS run_dir FROM events)
    SELECT * FROM (SELECT book_id, seq::INT AS seq, run_dir, seq % 10 NOT IN (3, 7) AS ok, CASE seq % 10 WHEN 7 THEN 'cash' WHEN 3 THEN 'events' END AS difference
    FROM (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY run_dir) AS seq FROM rows)) WHERE seq % 10 <> 8""",
)


def chained(s, d):
    """Book links over the days of events: every run has a book but those of days 5, 15 and 25; some links lie."""
    rows = book_rows(s, d).select("book_id", "run_dir", "file")
    dirs = rows.select("book_id", "run_dir").distinct()
    kept = dirs.where(F.substring("run_dir", -1, 1) != "5")
    w = Window.partitionBy("book_id").orderBy("run_dir")
    sha, name = F.sha2(F.concat("book_id", "run_dir"), 256), F.concat(F.lit("book_"), "seq", F.lit(".receipt.json"))
    x = kept.withColumn("seq", F.row_number().over(w).cast("bigint")).select("book_id", "run_dir", "seq", name.alias("file"), sha.alias("sha256"))
    w = Window.partitionBy("book_id").orderBy("seq")
    before = F.struct(F.lag("run_dir").over(w).alias("run_dir"), F.lag("file").over(w).alias("file"), F.when(F.col("seq") % 7 == 0, "forged").otherwise(F.lag("sha256").over(w)).alias("sha256"))
    x = x.withColumns({"prev": F.when(F.col("seq") > 1, before), "from": F.coalesce(F.lag("run_dir").over(w), F.lit(""))})
    gaps = dirs.join(kept, ["book_id", "run_dir"], "left_anti").groupBy("book_id").agg(F.array_sort(F.collect_list("run_dir")).alias("gaps"))
    files = rows.groupBy("book_id", "run_dir").agg(F.array_sort(F.collect_list("file")).alias("signal_files"))
    config = F.when(F.col("seq") % 11 == 0, '{"costModel":{"feeBps":30,"slippageBps":20},"entryFractionBps":999,"startingCashUsd":10000}').otherwise('{"startingCashUsd":10000,"entryFractionBps":1000,"costModel":{"slippageBps":20,"feeBps":30}}')
    x = x.join(gaps, "book_id", "left").join(files, ["book_id", "run_dir"])
    skipped = F.filter(F.coalesce("gaps", F.array().cast("array<string>")), lambda g: (g > F.col("from")) & (g < F.col("run_dir")))
    x = x.select("book_id", "seq", "run_dir", "file", "sha256", "run_dir", "prev", config.alias("config"), F.when(F.col("seq") % 5 == 0, F.array(F.lit("none"))).otherwise(skipped).alias("skipped"), F.when(F.col("seq") % 3 == 0, F.slice("signal_files", 2, 1 << 30)).otherwise(F.col("signal_files")).alias("signal_files"))
    x = x.toDF("book_id", "seq", "run_dir", "file", "sha256", "stated_dir", "prev", "config", "skipped", "signal_files")
    return K.audit_book_chain(x, dirs, rows)


P.add(
    "audit_book_chain", chained,
    """WITH rows AS (SELECT DISTINCT 'B' || (user_id // 5) AS book_id, strftime(ts, '%Y-%m-%d') AS run_dir FROM events),
    books AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY run_dir) AS seq, count(*) OVER (PARTITION BY book_id) AS n FROM rows WHERE right(run_dir, 1) <> '5')
    SELECT book_id, seq, unnest(list_filter([CASE WHEN seq > 1 AND seq % 7 = 0 THEN 'previous pointer differs' END, CASE WHEN seq > 1 AND (seq % 11 = 0 OR seq % 11 = 1) THEN 'config drifted' END,
    CASE WHEN seq % 5 = 0 THEN 'gaps differ from the ledger' END, CASE WHEN seq % 3 = 0 THEN 'inputs differ from the ledger' END], lambda x: x IS NOT NULL)) AS problem FROM books""",
)


def marked(s, d):
    li = proxy.snapshots(s, d)
    pos = li.groupBy(F.col("session").alias("book_id"), F.col("base_symbol").alias("symbol")).agg((F.count("*") * 1_500_000_000).alias("qty_e9"))
    cash = pos.select("book_id").distinct().withColumn("cash_micro", F.lit(10_000_000_000))
    prices = table(s, d, "part").where("p_partkey % 9 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.col("p_retailprice").alias("price_usd"))
    return K.mark_to_market(pos, cash, prices).select("book_id", F.col("unpriced").cast("bigint").alias("unpriced"), F.col("equity_micro").cast("bigint").alias("equity_micro"))


P.add(
    "mark_to_market", marked,
    f"""WITH {proxy.SNAPSHOTS}, pos AS (SELECT session AS book_id, base_symbol AS symbol, count(*) * 1500000000 AS qty FROM snapshots GROUP BY ALL),
    priced AS (SELECT p.*, p_retailprice AS price FROM pos p LEFT JOIN (SELECT * FROM part WHERE p_partkey % 9 <> 0) ON symbol = 'P' || p_partkey)
    SELECT book_id, count(*) FILTER (price IS NULL OR price <= 0) AS unpriced, CASE WHEN count(*) FILTER (price IS NULL OR price <= 0) = 0
    THEN (10000000000 + sum(qty::HUGEINT * (round(price::VARCHAR::DECIMAL(38, 15), 6) * 1000000)::HUGEINT // 1000000000))::BIGINT END AS equity_micro FROM priced GROUP BY book_id""",
)


# -- streams ----------------------------------------------------------------------------------------------------------
def stream(s, d, transform, mode: str = "append"):
    """Runs a job over events as a stream of files until they are used up, and returns what it wrote."""
    path, name = fresh(s, "stream"), f"{d}/events.parquet"
    schema = s.read.parquet(name).schema
    feed = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(name if _is_dir(s, name) else d + "/events*.parquet")
    query = transform(feed).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{path}/out")


def _is_dir(s, name: str) -> bool:
    p = s._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def with_ts(feed):
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_closes(s, d):
    ticks = lambda f: with_ts(f).select(F.col("event_type").alias("product"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))
    return stream(s, d, lambda f: jobs.daily_closes(ticks(f)))


LAST = "(SELECT max((epoch_us(ts) // 1000)) FROM events)"
P.add(
    "stream_daily_closes", stream_closes,
    f"""SELECT event_type AS product, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS t_ms, arg_max(value, ROW(ts, event_id)) AS close FROM events WHERE value > 0
    GROUP BY ALL HAVING (epoch_us(any_value(ts)) // 1000) // {DAY} * {DAY} + {DAY} <= (SELECT max((epoch_us(ts) // 1000)) FROM events WHERE value > 0) - {DAY}""",
)
P.add("stream_dedup", lambda s, d: stream(s, d, lambda f: jobs.dedup(with_ts(f).select("event_id", "ts", "event_type"), ["event_id"])).select("event_id", "event_type"), "SELECT DISTINCT event_id, event_type FROM events")


def gate_feed(f):
    x = with_ts(f).select("event_id", F.unix_millis("ts").alias("observed_at_ms"), (F.col("value") * 5000).alias("liquidity_usd"), (F.col("value") * 2000).alias("volume24h_usd"))
    return jobs.gated(x, F.col("observed_at_ms") + F.when(F.col("event_id") % 3 == 0, 600_000).otherwise(1_000)).select("event_id", "verdict", F.array_join("blocked_by", ",").alias("blocked_by"))


P.add(
    "stream_gates", lambda s, d: stream(s, d, gate_feed),
    """SELECT event_id, CASE WHEN gates = '' THEN 'ALLOWED' ELSE 'BLOCKED' END AS verdict, gates AS blocked_by FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'freshness' END,
    CASE WHEN value IS NULL OR value * 5000 < 250000 OR value * 2000 < 100000 THEN 'liquidity' END) AS gates FROM events)""",
)


def census_feed(f):
    verdict = F.when(F.col("event_id") % 3 == 0, "BLOCKED").otherwise("ALLOWED")
    return jobs.refusal_census(with_ts(f).select("ts", verdict.alias("verdict")))


P.add(
    "stream_refusal_census", lambda s, d: stream(s, d, census_feed),
    f"""SELECT w AS start_ms, w + 21600000 AS end_ms, count(*) AS decisions, count(*) FILTER (event_id % 3 <> 0) AS allowed, count(*) FILTER (event_id % 3 = 0) AS blocked
    FROM (SELECT *, (epoch_us(ts) // 1000) // 21600000 * 21600000 AS w FROM events) GROUP BY w HAVING w + 21600000 <= {LAST} - 3600000""",
)


def stream_book(s, d):
    """The rows of ``book_replay`` from a stream that is stopped in the midst of a run and taken up again from its checkpoint.

    Every third decision of the day before is held back until then. A last row in a book of its own lets the watermark pass.
    """
    path, out = fresh(s, "decisions"), fresh(s, "book")
    rows = book_rows(s, d).select("book_id", "run_dir", "pos", "symbol", "action", "verdict", "price_usd", F.timestamp_millis("ts_ms").alias("ts"))
    span = rows.agg(F.unix_millis(F.min("ts")).alias("a"), F.unix_millis(F.max("ts")).alias("z")).first()
    middle, schema = ((span["a"] or 0) + (span["z"] or 0)) // 2, rows.schema
    at = F.unix_millis("ts")
    first = (at < middle) & ~((at >= middle - DAY) & (F.col("pos") % 3 == 0))
    flush = s.createDataFrame([("~", "~", 0, "~", "HOLD", "ALLOWED", 1.0)], "book_id string, run_dir string, pos bigint, symbol string, action string, verdict string, price_usd double").withColumn("ts", F.timestamp_millis(F.lit((span["z"] or 0) + 30 * DAY)))
    for part in (rows.where(first), rows.where(~first), flush):
        part.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)
        q = jobs.paper_book(s.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.parquet(f"{out}/out").select(*BOOK)


P.add("stream_book", stream_book, REPLAYED)
QUERIES, ORACLE_SQL = P.queries, P.sql
