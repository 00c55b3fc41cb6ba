"""Queries of the scalar rules over events, order lines, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritick.functions import helpers as H
from veritick.functions import scalars as S
from veritick.plans.base import Plans, r
from veritick.session import table

P = Plans()
X_SQL = "SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 <> 0 THEN value / 50 - 0.5 END AS x FROM events"


def numbers(spark, d):
    i = F.col("event_id")
    x = F.when(i % 10 == 0, float("nan")).when(i % 11 != 0, F.col("value") / 50 - 0.5)
    return table(spark, d, "events").select("event_id", "value", x.alias("x"))


def one(name, expr, sql):
    P.add(name, lambda spark, d: numbers(spark, d).select("event_id", expr().alias("y")), f"SELECT event_id, {sql} AS y FROM ({X_SQL})")


FIN = "CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE {} END"
one("cap_trust", lambda: r(S.cap_trust("x")), FIN.format("round(least(greatest(x, 0), 0.97), 6)"))
one("lambda_bounded", lambda: S.lambda_bounded("x"), "coalesce(NOT isnan(x) AND x BETWEEN 0 AND 1, false)")
one("squash01", lambda: r(S.squash01("x", 2.0)), FIN.format("round(1 / (1 + exp(-2.0 * x)), 6)"))
one(
    "hoeffding_confidence", lambda: r(S.hoeffding_confidence(F.col("event_id") % 500 - 5, 0.05, -0.5, 0.5)),
    "CASE WHEN event_id % 500 - 5 > 0 THEN round(least(greatest(1 - exp(-2 * (event_id % 500 - 5) * 0.05 * 0.05), 0), 0.97), 6) END",
)
one(
    "lambda_aggregate", lambda: r(S.lambda_aggregate(F.array(F.col("x"), F.col("value") / 100, F.lit(0.5)), F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)))),
    """CASE WHEN x IS NULL OR isnan(x) OR x < 0 OR x > 1 THEN NULL WHEN x = 0 THEN 0 WHEN value / 100 < 0 OR value / 100 > 1 THEN NULL WHEN value = 0 THEN 0
       ELSE round(exp(0.25 * ln(x) + 0.5 * ln(value / 100) + 0.25 * ln(0.5)), 6) END""",
)
one("to_micro_usd", lambda: S.to_micro_usd("x").cast("bigint"), FIN.format("(round(x::VARCHAR::DECIMAL(38, 15), 6) * 1000000)::BIGINT"))
one(
    "micro_to_usd", lambda: S.micro_to_usd(F.col("event_id") * 1234567),
    "((event_id * 1234567) // 1000000)::VARCHAR || '.' || lpad(((event_id * 1234567) % 1000000)::VARCHAR, 6, '0')",
)


def labeled(spark, d):
    i = F.col("event_id")
    label = F.when(i % 4 == 0, "UNAVAILABLE").when(i % 4 == 1, "MEASURED").when(i % 4 == 2, "HEURISTIC").otherwise("GUESS")
    return numbers(spark, d).select("event_id", S.labeled(F.col("x"), label).alias("l")).select("event_id", r("l.value").alias("value"), F.col("l.label").alias("label"), F.col("l.error").alias("error"))


P.add(
    "labeled", labeled,
    f"""SELECT event_id, CASE WHEN error IS NULL THEN round(v, 6) END AS value, label, error FROM (
    SELECT *, CASE WHEN label = 'GUESS' THEN 'unknown label' WHEN label = 'UNAVAILABLE' AND v IS NOT NULL THEN 'UNAVAILABLE must carry no value'
    WHEN label <> 'UNAVAILABLE' AND v IS NULL THEN 'value required' END AS error
    FROM (SELECT event_id, {FIN.format("x")} AS v, CASE event_id % 4 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'MEASURED' WHEN 2 THEN 'HEURISTIC' ELSE 'GUESS' END AS label
    FROM ({X_SQL})))""",
)


def signal_time(spark, d):
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    i = F.col("event_id")
    subject = F.when(i % 3 == 0, F.concat(F.lit("signal/X/"), t)).otherwise("signal/X/none")
    snap = F.when(i % 3 == 1, t).otherwise("never")
    return table(spark, d, "events").select("event_id", S.signal_time(subject, snap).alias("ms"))


P.add("signal_time", signal_time, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (epoch_us(date_trunc('second', ts)) // 1000) END AS ms FROM events")


def texts(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.encode("text", "utf-8").alias("b"))


P.add(
    "key_id", lambda spark, d: texts(spark, d).select("conv_id", "turn", S.key_id(F.regexp_replace(F.base64("b"), "\r?\n", "")).alias("key_id")),
    "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS key_id FROM conversations WHERE text IS NOT NULL",
)
P.add(
    "leaf_hash", lambda spark, d: texts(spark, d).select("conv_id", "turn", S.leaf_hash("b").alias("leaf")),
    "SELECT conv_id, turn, sha256('\\x00'::BLOB || encode(text)) AS leaf FROM conversations WHERE text IS NOT NULL",
)
P.add(
    "node_hash", lambda spark, d: texts(spark, d).select("conv_id", "turn", S.node_hash(S.leaf_hash("b"), F.sha2("b", 256)).alias("node")),
    "SELECT conv_id, turn, sha256('\\x01'::BLOB || unhex(sha256('\\x00'::BLOB || encode(text))) || unhex(sha256(text))) AS node FROM conversations WHERE text IS NOT NULL",
)


def parse_checkpoint(spark, d):
    """Notes built from documents; every 7th is malformed in one of several ways."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    root = F.when(i % 7 == 3, F.lit("short")).otherwise(F.base64(F.unhex(F.sha2(text, 256))))
    size = F.when(i % 7 == 1, "12x").otherwise((F.length(text) + 1).cast("string"))
    gap = F.when(i % 7 == 2, "\n").otherwise("\n\n")
    sig = F.when(i % 7 == 4, "- x y\n").otherwise(F.concat(F.lit("— log "), F.base64(F.encode(F.lit("signature"), "utf-8")), F.lit("\n")))
    origin = F.when(i % 7 == 5, "no origin at all").otherwise(F.concat("source", F.lit(" - "), i.cast("string")))
    note = F.concat(origin, F.lit("\n"), size, F.lit("\n"), root, gap, sig)
    return docs.select("doc_id", S.parse_checkpoint(note).alias("c")).select("doc_id", "c.*")


P.add(
    "parse_checkpoint", parse_checkpoint,
    """SELECT doc_id, CASE WHEN ok THEN source || ' - ' || doc_id END AS origin, CASE WHEN ok THEN length(coalesce(text, '')) + 1 END AS tree_size,
    CASE WHEN ok THEN sha256(coalesce(text, '')) END AS root_hex, CASE WHEN ok THEN 1 END AS n_signatures, reason
    FROM (SELECT *, reason IS NULL AS ok FROM (SELECT *, CASE doc_id % 7 WHEN 1 THEN 'size' WHEN 2 THEN 'gap'
    WHEN 3 THEN 'root' WHEN 4 THEN 'signature' WHEN 5 THEN 'origin' END AS reason FROM documents WHERE doc_id IS NOT NULL))""",
)


def anchor_fields(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("doc_id is not null")
    kind = F.when(i % 5 == 0, "other").otherwise("rekord")
    algorithm = F.when(i % 5 == 1, "sha512").otherwise("sha256")
    spec = F.struct(
        F.struct(F.struct(algorithm.alias("algorithm"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("value")).alias("hash")).alias("data"),
        F.struct(F.col("source").alias("content"), F.lit("x509").alias("format"), F.struct(F.when(i % 5 != 2, F.lit("key")).alias("content")).alias("publicKey")).alias("signature"),
    )
    body = F.base64(F.encode(F.to_json(F.struct(kind.alias("kind"), spec.alias("spec"))), "utf-8"))
    return docs.select("doc_id", S.anchor_fields(F.regexp_replace(body, "\r?\n", "")).alias("a")).select("doc_id", "a.*")


P.add(
    "anchor_fields", anchor_fields,
    """SELECT doc_id, CASE WHEN ok THEN sha256(coalesce(text, '')) END AS data_sha256, CASE WHEN ok THEN source END AS signature, CASE WHEN ok THEN 'key' END AS public_key,
    CASE WHEN ok THEN 'x509' END AS format FROM (SELECT *, doc_id % 5 > 2 AND source IS NOT NULL AND source <> '' AS ok FROM documents WHERE doc_id IS NOT NULL)""",
)


def file_names(spark, d):
    i = F.col("event_id")
    n4 = F.lpad((i % 10000).cast("string"), 4, "0")
    name = F.lit(None).cast("string")
    shapes = [
        F.concat(F.lit("book_"), i, F.lit(".receipt.json")), F.concat(F.lit("refusals_"), i, F.lit(".receipt.json")), F.concat(F.lit("chain_"), n4, F.lit(".receipt.json")),
        F.concat(F.lit("witness_"), n4, F.lit("_"), i, F.lit(".receipt.json")), F.concat(F.lit("consistency_1-2_"), i, F.lit(".receipt.json")), F.concat(F.lit("tsa_"), n4, F.lit("_"), i, F.lit(".receipt.json")),
        F.concat(F.lit("obs_"), n4, F.lit("_"), i, F.lit(".observation.json")), F.concat(F.lit("gossip_"), n4, F.lit("_"), i, F.lit(".receipt.json")), F.concat(F.lit("chain_"), i, F.lit("x.receipt.json")),
        F.concat(F.lit("xbook_"), i, F.lit(".receipt.json")),
    ]
    for k, s in enumerate(shapes):
        name = F.when(i % 10 == k, s).otherwise(name)
    return table(spark, d, "events").select("event_id", name.alias("name"))


P.add(
    "classify_receipt_files", lambda spark, d: file_names(spark, d).select("event_id", S.classify_file("name").alias("c")).select("event_id", "c.*"),
    """SELECT event_id, ['book', 'refusals', 'chain', 'witness', 'consistency', 'tsa', 'observation', 'gossip', NULL, NULL][event_id % 10 + 1] AS kind,
    CASE WHEN event_id % 10 IN (2, 3, 5, 6, 7) THEN event_id % 10000 END AS seq, CASE WHEN event_id % 10 IN (0, 1, 3, 4, 5, 6, 7) THEN event_id END AS ms FROM events""",
)


def canonical_digest(spark, d):
    """Digests of documents as JSON with keys out of order, a nested object, an array and nulls."""
    docs = table(spark, d, "documents")
    nested = F.struct(F.array("n_chars", F.lit(1.5)).alias("z"), F.lit(True).alias("a"))
    return docs.select("doc_id", H.canonical_digest(F.to_json(F.struct("text", nested.alias("nested"), "lang", "source", F.col("doc_id").alias("Aid")), {"ignoreNullFields": "false"})).alias("digest"))


def _json(c: str) -> str:
    return f"coalesce(to_json({c})::VARCHAR, 'null')"


P.add(
    "canonical_digest", canonical_digest,
    f"""SELECT doc_id, sha256('{{"Aid":' || coalesce(doc_id::VARCHAR, 'null') || ',"lang":' || {_json("lang")} || ',"nested":{{"a":true,"z":[' || coalesce(n_chars::VARCHAR, 'null') || ',1.5]}},"source":'
    || {_json("source")} || ',"text":' || {_json("text")} || '}}') AS digest FROM documents""",
)
QUERIES, ORACLE_SQL = P.queries, P.sql
