"""Stand-ins for the reference's inputs, derived from the given tables, each as Spark rows and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritick.session import table

DAY_MS = 86_400_000


def millis(ts: str) -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """asset, t_ms, close: per supplier and ship day the unit price of the greatest order line (of equals, the highest price)."""
    rows = table(spark, d, "lineitem").where("l_quantity > 0")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    price = F.col("l_extendedprice") / F.col("l_quantity")
    last = F.max(F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("k"), price.alias("p")))["p"]
    found = rows.groupBy("l_suppkey", day.alias("t_ms")).agg(last.alias("close"))  # grouped, and so sorted, by numbers
    return found.select(F.col("l_suppkey").cast("string").alias("asset"), "t_ms", "close")


BARS = f"""raw_bars AS (
  SELECT l_suppkey::VARCHAR AS asset, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT * {DAY_MS} AS t_ms,
         (max({{'k': l_orderkey * 1000 + l_linenumber, 'p': l_extendedprice / l_quantity}})).p AS close
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t_ms) - 1 AS bar_idx FROM raw_bars)"""


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """product, t_s (day start), close text, pos, with some texts that are not prices."""
    e = table(spark, d, "events")
    close = F.when(F.col("event_id") % 97 == 0, "nan").when(F.col("event_id") % 89 == 0, "-1").otherwise(F.col("value").cast("string"))
    day = F.floor(millis("ts") / DAY_MS) * (DAY_MS // 1000)
    return e.select(F.col("event_type").alias("product"), day.cast("bigint").alias("t_s"), close.alias("close"), F.col("event_id").alias("pos"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """run_dir, file, pos, symbol, action, verdict, blocked_by, price_usd, conviction from events."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    action = F.when(i % 5 < 2, "ENTER_LONG").when(i % 5 == 2, "EXIT_LONG").when(i % 5 == 3, "HOLD").otherwise("ABSTAIN")
    verdict = F.when(i % 3 == 0, "BLOCKED").when(i % 41 == 0, "UNKNOWN").otherwise("ALLOWED")
    gate = lambda k, name: F.when((verdict == "BLOCKED") & (i % k == 0), F.lit(name))
    return e.select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("run_dir"), F.concat(F.lit("signal_"), i, F.lit(".receipt.json")).alias("file"), i.alias("pos"),
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.concat(F.lit("A"), F.col("user_id") % 7).alias("asset"), action.alias("action"), verdict.alias("verdict"),
        F.array_compact(F.array(gate(2, "liquidity"), gate(1, "freshness"), gate(7, "conviction"))).alias("blocked_by"), F.when(i % 53 != 0, F.col("value")).alias("price_usd"),
        (F.col("value") / 200).alias("conviction"), millis("ts").alias("ts_ms"),
    )


DECISIONS = """decisions AS (
  SELECT *, CASE WHEN verdict = 'BLOCKED' THEN list_filter([CASE WHEN pos % 2 = 0 THEN 'liquidity' END, 'freshness', CASE WHEN pos % 7 = 0 THEN 'conviction' END],
                 lambda x: x IS NOT NULL) ELSE [] END AS blocked_by
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS run_dir, 'signal_' || event_id || '.receipt.json' AS file, event_id AS pos, 'U' || user_id AS symbol,
               'A' || (user_id % 7) AS asset,
               CASE WHEN event_id % 5 < 2 THEN 'ENTER_LONG' WHEN event_id % 5 = 2 THEN 'EXIT_LONG' WHEN event_id % 5 = 3 THEN 'HOLD' ELSE 'ABSTAIN' END AS action,
               CASE WHEN event_id % 3 = 0 THEN 'BLOCKED' WHEN event_id % 41 = 0 THEN 'UNKNOWN' ELSE 'ALLOWED' END AS verdict,
               CASE WHEN event_id % 53 <> 0 THEN value END AS price_usd, value / 200 AS conviction, (epoch_us(ts) // 1000) AS ts_ms FROM events))"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """session, pos, asset, base_address, base_symbol, dex, price_usd, liquidity_usd, volume24h_usd, observed_at_ms from lineitem.

    Order lines with equal order and line number count once, by their greatest values.
    """
    values = ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*values)).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    pos = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("S"), F.col("l_orderkey")).alias("session"), pos.alias("pos"), F.col("l_suppkey").cast("string").alias("asset"), F.col("l_partkey").cast("string").alias("base_address"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("base_symbol"), F.concat(F.lit("D"), F.col("l_suppkey")).alias("dex"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
        F.when(F.col("l_linenumber") != 7, F.round(F.col("l_extendedprice") * 10)).alias("liquidity_usd"), (F.col("l_quantity") * 5000).alias("volume24h_usd"), millis("l_shipdate").alias("observed_at_ms"),
    )


SNAPSHOTS = """lines AS (
  SELECT l_orderkey, l_linenumber, m.* FROM (SELECT l_orderkey, l_linenumber, max({'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
    'l_extendedprice': l_extendedprice, 'l_quantity': l_quantity, 'l_shipdate': l_shipdate}) AS m FROM lineitem GROUP BY ALL)),
snapshots AS (
  SELECT 'S' || l_orderkey AS session, l_orderkey * 1000 + l_linenumber AS pos, l_suppkey::VARCHAR AS asset, l_partkey::VARCHAR AS base_address,
         'P' || l_partkey AS base_symbol, 'D' || l_suppkey AS dex, l_extendedprice / l_quantity AS price_usd,
         CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice * 10) END AS liquidity_usd, l_quantity * 5000 AS volume24h_usd,
         (epoch_us(l_shipdate) // 1000) AS observed_at_ms FROM lines)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """ledger, seq, run_dir, file, sha256, prev, covers from conversations: a turn is a link that seals its own dir.

    Every 11th conversation has a wrong back pointer, every 13th a rewritten file, every 17th leaves its last dir open.
    """
    from pyspark.sql import Window

    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    c = c.select("conv_id", "turn", (F.row_number().over(w)).cast("bigint").alias("seq"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), sha.alias("sha"))
    ledger, run = F.concat(F.lit("L"), F.col("conv_id")), F.concat(F.lit("run-"), F.lpad(F.col("seq").cast("string"), 4, "0"))
    c = c.select("conv_id", "seq", "n", "sha", ledger.alias("ledger"), run.alias("run_dir"), F.concat(F.lit("chain_"), F.lpad(F.col("seq").cast("string"), 4, "0"), F.lit(".receipt.json")).alias("file"))
    prev = Window.partitionBy("ledger").orderBy("seq")
    before = F.struct(F.lag("run_dir").over(prev).alias("run_dir"), F.lag("file").over(prev).alias("file"), F.when(F.col("conv_id") % 11 == 0, "forged").otherwise(F.lag("sha").over(prev)).alias("sha256"))
    sealed = F.when(F.col("conv_id") % 13 == 0, F.sha2(F.concat("sha", F.lit("x")), 256)).otherwise(F.col("sha"))
    cover = F.array(F.struct(F.col("run_dir").alias("dir"), F.array(F.struct(F.concat(F.lit("signal_"), F.col("seq"), F.lit(".json")).alias("name"), sealed.alias("sha256"))).alias("files")))
    out = c.select("ledger", "seq", "run_dir", "file", F.col("sha").alias("sha256"), F.when(F.col("seq") > 1, before).alias("prev"), cover.alias("covers"), "conv_id", "n")
    return out.where("not (conv_id % 17 = 0 and seq = n and n > 1)").drop("conv_id", "n")


def ledger_files(spark: SparkSession, d: str) -> DataFrame:
    """ledger, run_dir, name, sha256: the files on disk behind ``links``."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.select("conv_id", seq.alias("seq"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return c.select(F.concat(F.lit("L"), F.col("conv_id")).alias("ledger"), F.concat(F.lit("run-"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("run_dir"), F.concat(F.lit("signal_"), F.col("seq"), F.lit(".json")).alias("name"), "sha256")


LINKS = """turns AS (
  SELECT conv_id, 'L' || conv_id AS ledger, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
         sha256(coalesce(text, '')) AS sha FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
files AS (SELECT conv_id, ledger, seq, n, 'run-' || lpad(seq::VARCHAR, 4, '0') AS run_dir, 'signal_' || seq || '.json' AS name, sha FROM turns),
links AS (
  SELECT *, 'chain_' || lpad(seq::VARCHAR, 4, '0') || '.receipt.json' AS file,
         CASE WHEN conv_id % 11 = 0 THEN 'forged' ELSE lag(sha) OVER (PARTITION BY ledger ORDER BY seq) END AS prev_sha,
         CASE WHEN conv_id % 13 = 0 THEN sha256(sha || 'x') ELSE sha END AS sealed_sha
  FROM files QUALIFY NOT (conv_id % 17 = 0 AND seq = n AND n > 1))"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """origin, tree_size, root_hex, source, pos from documents: equal sizes of one source with other texts conflict."""
    return table(spark, d, "documents").select(
        F.col("source").alias("origin"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("tree_size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("root_hex"),
        F.coalesce("lang", F.lit("none")).alias("source"), F.col("doc_id").alias("pos"),
    )


CHECKPOINTS = """checkpoints AS (
  SELECT source AS origin, length(coalesce(text, '')) AS tree_size, sha256(coalesce(text, '')) AS root_hex, coalesce(lang, 'none') AS source, doc_id AS pos FROM documents)"""
