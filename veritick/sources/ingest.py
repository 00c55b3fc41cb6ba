"""Normalising price feeds, snapshots and ledger files into typed tables. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritick.functions import scalars as S

DAY_MS = 86_400_000
SERIES = "close double, tMs bigint"
PAIR = (
    "chainId string, dexId string, pairAddress string, url string, baseToken struct<address:string,symbol:string>, quoteToken struct<symbol:string>, priceUsd string, "
    "liquidity struct<usd:string>, volume struct<h24:string>, priceChange struct<h1:string,h6:string,h24:string>"
)
STATEMENT = (
    "subject array<struct<name:string,digest:struct<sha256:string>>>, predicate struct<decision:struct<asset:struct<symbol:string,address:string>,"
    "snapshot:struct<priceUsd:string,observedAtIso:string>,proposedAction:string,verdict:string,conviction:string,blockedBy:array<string>>>"
)


def binary_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, content) of the files below a folder; content is read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content")


def read_series_archive(files: DataFrame) -> DataFrame:
    """Series files (path, content: a JSON array of closes) -> sha256, bar_idx, t_ms, close."""
    bars = F.posexplode(F.from_json(F.col("content").cast("string"), f"array<struct<{SERIES.replace(' ', ':').replace(',:', ',')}>>")).alias("bar_idx", "b")
    return files.select(F.sha2("content", 256).alias("sha256"), bars).select("sha256", "bar_idx", F.col("b.tMs").alias("t_ms"), F.col("b.close").alias("close"))


def normalize_candles(candles: DataFrame, now_ms: Column) -> DataFrame:
    """(product, t_s, close text, pos) -> closed daily closes: numeric, positive, one per bucket (the last row wins)."""
    close = S.finite(F.col("close").try_cast("double"))
    rows = candles.select("product", (F.col("t_s") * 1000).cast("bigint").alias("t_ms"), close.alias("close"), "pos")
    rows = rows.where((F.col("close") > 0) & (F.col("t_ms") + DAY_MS <= now_ms))
    return rows.groupBy("product", "t_ms").agg(F.max_by("close", "pos").alias("close"))


def normalize_price_pairs(pairs: DataFrame) -> DataFrame:
    """(series, prices: array of [t, price]) -> positive finite closes in given order, neither sorted nor de-duplicated."""
    rows = pairs.select("series", F.posexplode("prices").alias("pos", "p"))
    rows = rows.select("series", "pos", F.get("p", F.lit(0)).cast("bigint").alias("t_ms"), S.finite(F.get("p", F.lit(1))).alias("close"))
    return rows.where("close > 0")


def normalize_pairs(snapshots: DataFrame) -> DataFrame:
    """(pos, observed_at_ms, json) -> flat snapshot; price may be text (a JSON null or empty text is 0), the rest not."""
    p = F.from_json("json", PAIR)
    flat = snapshots.select("pos", "observed_at_ms", "json", p.alias("p"))
    raw = lambda path: F.expr(f"variant_get(try_parse_json(json), '{path}')")

    def number(path: str) -> Column:
        kind = F.expr(f"schema_of_variant(variant_get(try_parse_json(json), '{path}'))")
        value = F.expr(f"try_variant_get(try_parse_json(json), '{path}', 'double')")
        return F.when(raw(path).isNotNull() & (kind != "STRING"), S.finite(value))

    kind = F.expr("schema_of_variant(variant_get(try_parse_json(json), '$.priceUsd'))")
    text = F.expr("try_variant_get(try_parse_json(json), '$.priceUsd', 'string')")
    price = F.when((kind == "VOID") | (F.trim(text) == ""), 0.0).otherwise(S.finite(F.trim(text).try_cast("double")))
    return flat.select(
        "pos", "observed_at_ms", F.col("p.chainId").alias("chain"), F.col("p.dexId").alias("dex"), F.col("p.baseToken.address").alias("base_address"),
        F.col("p.baseToken.symbol").alias("base_symbol"), price.alias("price_usd"), number("$.liquidity.usd").alias("liquidity_usd"), number("$.volume.h24").alias("volume24h_usd"),
        F.struct(*[number(f"$.priceChange.{h}").alias(h) for h in ("h1", "h6", "h24")]).alias("price_change"),
    )


def deepest_pair(pairs: DataFrame) -> DataFrame:
    """Per base token the pair of most liquidity (unknown counts as -1), the first seen of equals; no token, no row."""
    rank = F.struct(F.coalesce("liquidity_usd", F.lit(-1.0)).alias("liq"), (-F.col("pos")).alias("first"))
    best = pairs.where("base_address is not null").groupBy("base_address").agg(F.max_by(F.struct(*pairs.columns), rank).alias("p"))
    return best.select("p.*")


def read_receipts(files: DataFrame) -> DataFrame:
    """Signed envelopes (path, content) -> path, sha256, statement; an unreadable file keeps its row with a null statement."""
    envelope = F.from_json(F.col("content").cast("string"), "payload string, payloadType string")
    payload = F.try_to_binary(envelope["payload"], F.lit("base64")).cast("string")
    return files.select("path", F.sha2("content", 256).alias("sha256"), envelope["payloadType"].alias("payload_type"), payload.alias("payload"), F.from_json(payload, STATEMENT).alias("statement"))


def extract_decision(receipts: DataFrame) -> DataFrame:
    """The decision fields of statements; rows without symbol, action or verdict go. A conviction in quotes is null."""
    d = F.col("statement.predicate.decision")
    quoted = F.get_json_object("payload", "$.predicate.decision.conviction")
    number = F.expr("schema_of_variant(variant_get(try_parse_json(payload), '$.predicate.decision.conviction'))") != "STRING"
    rows = receipts.select(
        "path", d["asset"]["symbol"].alias("symbol"), d["asset"]["address"].alias("address"), d["proposedAction"].alias("action"), d["verdict"].alias("verdict"),
        S.finite(d["snapshot"]["priceUsd"].try_cast("double")).alias("price_usd"), d["snapshot"]["observedAtIso"].alias("observed_at"),
        F.when(number, S.finite(quoted.try_cast("double"))).alias("conviction"), F.sort_array(F.coalesce(d["blockedBy"], F.array().cast("array<string>"))).alias("blocked_by"),
        S.signal_time(F.get(F.col("statement.subject"), F.lit(0))["name"], d["snapshot"]["observedAtIso"]).alias("signal_ms"),
    )
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return rows.where(filled("symbol") & filled("action") & filled("verdict"))


def ledger_file_hashes(files: DataFrame) -> DataFrame:
    """(path, content) -> run_dir, name, sha256 of each .json file that is not a chain receipt."""
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("run_dir"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    chain = S.classify_file("name")["kind"]
    return rows.where(F.col("name").endswith(".json") & (F.coalesce(chain, F.lit("")) != "chain"))


def choose_source(series: DataFrame, least: int = 2, outcomes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(asset, source, priority, t_ms, close) -> rows of each asset's first healthy source, and a report per asset.

    A source is healthy if its feed did not fail (``outcomes``: asset, source, priority, ok, note; optional) and it gave
    ``least`` valid closes; sources are never mixed. The report lists every attempt in order, up to the first healthy one,
    with its outcome and the reason of a failure, and sums the reasons up where no source is left.
    """
    valid = F.count_if(S.finite("close") > 0)
    tried = series.groupBy("asset", "source", "priority").agg(valid.alias("n"))
    if outcomes is not None:
        tried = tried.join(outcomes.select("asset", "source", "priority", "ok", "note"), ["asset", "source", "priority"], "full")
    else:
        tried = tried.withColumns({"ok": F.lit(True), "note": F.lit(None).cast("string")})
    n = F.coalesce("n", F.lit(0))
    failed = ~F.coalesce("ok", F.lit(True))
    why = F.when(failed, F.coalesce("note", F.lit("unknown error"))).when(n < least, F.concat(F.lit("valid closes: "), n.cast("string"), F.lit(f" of at least {least}")))
    tried = tried.select("asset", "source", "priority", n.alias("n"), F.when(why.isNull(), "ok").otherwise("unavailable").alias("outcome"), why.alias("note"))
    best = F.min(F.when(F.col("outcome") == "ok", F.struct("priority", "source"))).alias("best")
    every = F.array_sort(F.collect_list(F.struct("priority", "source", "n", "outcome", "note"))).alias("every")
    report = tried.groupBy("asset").agg(best, every)
    attempts = F.filter("every", lambda a: F.col("best").isNull() | (F.struct(a["priority"], a["source"]) <= F.struct("best.priority", "best.source")))
    reasons = F.concat_ws(" | ", F.transform("every", lambda a: F.concat_ws(": ", a["source"], a["note"])))
    report = report.select("asset", F.col("best.source").alias("source"), attempts.alias("attempts"), F.when(F.col("best").isNull(), "UNAVAILABLE").otherwise("REPORTED").alias("label"), F.when(F.col("best").isNull(), reasons).alias("note"))
    return series.join(report.where("source is not null").select("asset", "source"), ["asset", "source"]).where(S.finite("close") > 0), report


def attach_history(rows: DataFrame, ids: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Adds series_id by address, and the reason where there is none. The lookup is broadcast if it is small."""
    few = ids.limit(most_rows + 1).count() <= most_rows
    out = rows.join(F.broadcast(ids) if few else ids, "address", "left")
    return out.withColumn("note", F.when(F.col("series_id").isNull(), "no mapped history source"))


def series_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("asset").agg(F.count("*").alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
