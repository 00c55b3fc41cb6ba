"""Sharding by extendible hashing, with built-in functions only.

A row's hash is 60 bits of the MD5 of its id and content.  The directory is the set of hash prefixes: starting from one
bucket, only a bucket over the byte limit is split on its next bit, until every bucket fits or holds a single row.
Splitting needs sizes, not rows: bytes are summed once per prefix of a depth a little beyond the one that even sizes
would need, sums of shorter prefixes come from those, and each prefix takes its shortest ancestor that fits.  Only the
rows of prefixes that still exceed the limit go through another round, on deeper bits.  Rows alike in id and content
have equal hashes; should they exceed the limit together, they are split on a second hash, of the row's position.

Edge cases: a null text counts 0 bytes, a null id hashes as the empty string. A single row over the limit is a shard of
its own. An empty table has no shards. Repeated rows are placed one by one. Extra columns are kept by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritick.session import cut

BITS = 60
LIMIT = 32 << 20
QUERY_LIMIT = 1 << 20  # of the registered query: small enough that the smallest tables are split too


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Row position, id, bytes and both hash words."""
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(t)))
    word = lambda m: F.conv(F.substring(m, 1, BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("bytes"), word(key).alias("h"))
    return rows.withColumn("h2", word(F.md5(F.col("row").cast("string"))))


def directory(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(group, fine, depth): for each prefix of ``high`` bits, its shortest ancestor from ``low`` bits that fits.

    ``sums`` has (group, fine, bytes, n). The rows number one per occupied prefix.
    """
    up = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    lines = sums.select("group", "fine", "bytes", "n", up).withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
    sizes = lines.groupBy("group", "depth", "prefix").agg(F.sum("bytes").alias("size"), F.sum("n").alias("rows"))
    fits = sizes.where((F.col("size") <= limit) | (F.col("rows") == 1)).select("group", "depth", "prefix", "size", "rows")
    found = lines.select("group", "fine", "depth", "prefix").join(fits, ["group", "depth", "prefix"])
    best = F.min_by(F.struct("size", "rows"), "depth")
    return found.groupBy("group", "fine").agg(F.min("depth").alias("depth"), best.alias("of")).select("group", "fine", "depth", F.col("of.size").alias("size"), F.col("of.rows").alias("rows"))


def shards(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, shard, depth, shard_bytes, shard_rows): shard is the prefix in binary, empty for the root."""
    rows = cut(hashed(docs, doc_id, text))
    total, n = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    ahead = 3
    low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + ahead)
    left, word, done = rows.withColumn("group", F.lit("")), "h", []
    while n:
        fine = F.shiftright(F.col(word), BITS - high)
        left = left.withColumn("fine", fine)
        sums = left.groupBy("group", "fine").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found = cut(directory(sums, low, high, limit))
        placed = left.join(found, ["group", "fine"], "left")
        name = F.lpad(F.conv(F.expr(f"shiftright(fine, {high} - depth)").cast("string"), 10, 2), F.col("depth"), "0")
        shard = F.concat("group", F.when(F.col("depth") > 0, name).otherwise(F.lit("")))
        done.append(placed.where("depth is not null").select("row", "doc_id", shard.alias("shard"), (F.col("depth") + (BITS if word == "h2" else 0)).alias("depth"), F.col("size").alias("shard_bytes"), F.col("rows").alias("shard_rows")))
        rest = placed.where("depth is null").select("row", "doc_id", "bytes", "h", "h2", "group")
        if high == BITS and word == "h":
            rest = rest.withColumn("group", F.concat(F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0"), F.lit("-")))
        left = cut(rest)
        n = left.count()
        if n and high == BITS and word == "h2":
            raise RuntimeError("rows of equal position hash exceed the limit")
        low, high, word = (high + 1, min(BITS, high + 8), word) if high < BITS else (0, 8, "h2")
    if not done:
        return rows.selectExpr("row", "doc_id", "'' shard", "0 depth", "bytes shard_bytes", "0L shard_rows")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder ``__shard=...`` per shard; a shard is written by one task and fits its limit.

    ``docs`` must read the same rows in the same order each time (a stored table).
    """
    placed = shards(docs, limit, doc_id, text).select(F.col("row").alias("__row"), F.col("shard").alias("__shard"))
    out = docs.withColumn("__row", F.monotonically_increasing_id()).join(placed, "__row").drop("__row")
    out.repartition("__shard").write.partitionBy("__shard").parquet(path)


def op5_extendible_shards(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, of at most ``QUERY_LIMIT`` bytes of text each."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_LIMIT).drop("row")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
lines AS (SELECT doc_id, bytes, h, depth, h >> ({BITS} - depth) AS prefix FROM d, (SELECT unnest(range(0, 41))::INT AS depth)),
sizes AS (SELECT depth, prefix, sum(bytes)::BIGINT AS size, count(*) AS n FROM lines GROUP BY ALL),
leaf AS (
  SELECT l.doc_id, l.h, min(l.depth) AS depth FROM lines l JOIN sizes s USING (depth, prefix)
  WHERE s.size <= {QUERY_LIMIT} OR s.n = 1 GROUP BY l.doc_id, l.h)
SELECT d.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(d.h), {BITS}, '0')[1:l.depth], l.depth) END AS shard, l.depth AS depth,
       s.size AS shard_bytes, s.n AS shard_rows
FROM d JOIN leaf l ON l.h = d.h AND l.doc_id IS NOT DISTINCT FROM d.doc_id
JOIN sizes s ON s.depth = l.depth AND s.prefix = d.h >> ({BITS} - l.depth)
"""
