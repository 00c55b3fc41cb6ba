"""Secret scan: patterns, plus two character Markov models (random strings, ordinary identifiers) by likelihood ratio.

Base patterns give the spans that always stay.  Labelled samples for the models come from the corpus itself: the
values of base spans are random strings; long identifier-like tokens that overlap no base span are ordinary ones.
Character pairs of both are counted over all documents in one pass; the counts (at most 2 * 67 * 67 numbers) give smoothed
transition probabilities.  A token's score is its mean log-likelihood ratio per character.  The threshold lies midway
between the mean scores of the two samples, over all documents, and not under ``least``; the means follow from the same
pass, as every pair is also counted with the inverse length of its token.  Tokens over the threshold become ``markov``
spans unless they overlap a base span; a value that occurs again without its keyword is a token as any other.  A few
unlabelled secrets among the ordinary tokens hardly move it.

Edge cases: a null text counts as empty; empty texts have no spans. Rows with a null id are kept. Repeated rows are
scanned one by one. Without any base span the models are untrained and add nothing. Extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.llm import spans

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
UNIT = 10**9


def char_at(token: Column, i: Column) -> Column:
    """Place of the i-th character in the alphabet, from 1; 0 for any other."""
    return F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__text``, encoded base spans per kind, ``__secret`` (their values) and ``__tokens`` (located, apart from base spans)."""
    df = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    keys = F.lower(t).rlike("password|passwd|secret|token|api_?key")
    df = df.withColumns(
        {
            "__raw_assign": spans.gaps_and_hits(t, ASSIGN, keys & t.rlike("[:=]")),
            "__raw_access": spans.gaps_and_hits(t, ACCESS, t.contains("AKIA")),
            "__raw_hex": spans.gaps_and_hits(t, HEX, F.lit(True)),
            "__raw_token": spans.gaps_and_hits(t, TOKEN, F.lit(True)),
        }
    )
    df = df.withColumns({f"__hits_{k}": spans.located(F.col(f"__raw_{k}")) for k in ("assign", "access", "hex", "token")})
    value = lambda s: F.regexp_extract(s["hit"], ASSIGN, 2)
    df = df.withColumn("__hits_assign", F.filter("__hits_assign", lambda s: F.length(value(s)) >= 6))
    df = df.withColumns({f"__base_{k}": spans.encoded(F.col(f"__hits_{k}"), k, i) for i, k in enumerate(KINDS[:3])})
    texts = F.concat(F.transform("__hits_assign", value), F.transform("__hits_access", lambda s: s["hit"]), F.transform("__hits_hex", lambda s: s["hit"]))
    df = df.withColumns({"__secret": F.array_distinct(texts), "__taken": F.concat("__hits_assign", "__hits_access", "__hits_hex")})
    df = spans.with_free(df, "__hits_token", "__taken", "__tokens")
    return df.drop("__taken", *[f"__{x}_{k}" for k in ("assign", "access", "hex", "token") for x in ("raw", "hits")])


def pairs(token: Column) -> Column:
    """All (place, next place) pairs of a token, as one number each, after the place of its first character alone."""
    each = lambda i: F.when(i == 0, char_at(token, F.lit(1))).otherwise(char_at(token, i) * SIZE + char_at(token, i + 1))
    return F.transform(F.sequence(F.lit(0), F.length(token) - 1), each)


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per character."""
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.element_at(table, char_at(token, i) * SIZE + char_at(token, i + 1) + 1))
    return total / F.length(token)


def constant(values: list[float]) -> Column:
    """A long array constant, kept as one literal."""
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def train(docs: DataFrame, text: str = "text", least: float = 0.3, backoff: float = 500.0) -> tuple[list[float], float] | None:
    """The log-ratio of every character pair, and the threshold. None if the corpus has no base span."""
    df = with_base(docs.select(F.col(text).alias("text")))
    of = lambda random, c: F.transform(c, lambda t: F.struct(F.lit(random).alias("random"), t.alias("t")))
    # outer explodes: an inner one would have its input computed once more, as a filter on its size
    labelled = df.select(F.explode_outer(F.concat(of(1, F.col("__secret")), of(0, F.transform("__tokens", lambda s: s["hit"])))).alias("x")).where("x is not null and length(x.t) > 0")
    part = (F.lit(float(UNIT)) / F.length("x.t")).cast("long")  # whole numbers: their sum does not depend on its order
    every = labelled.select("x.random", part.alias("part"), F.explode_outer(pairs(F.col("x.t"))).alias("pair")).where("pair is not null")
    counts, parts, tokens = [[0.0] * (SIZE * SIZE) for _ in range(2)], [[0.0] * (SIZE * SIZE) for _ in range(2)], [0.0, 0.0]
    for r in every.groupBy("random", "pair").agg(F.count("*").alias("n"), F.sum("part").alias("parts")).collect():
        if r["pair"] >= SIZE:
            counts[r["random"]][r["pair"]] += r["n"]
            parts[r["random"]][r["pair"]] += r["parts"] / UNIT
        else:
            tokens[r["random"]] += r["n"]
    if not sum(counts[1]):
        return None
    logs = []
    for c in counts:
        row = [sum(c[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)]
        column = [sum(c[j::SIZE]) for j in range(SIZE)]
        alone = [(n + 0.5) / (sum(column) + 0.5 * SIZE) for n in column]  # pairs back off to single characters
        logs.append([math.log((c[i * SIZE + j] + backoff * alone[j]) / (row[i] + backoff)) for i in range(SIZE) for j in range(SIZE)])
    table = [a - b for a, b in zip(logs[1], logs[0], strict=True)]
    means = [sum(p * v for p, v in zip(parts[k], table, strict=True)) / tokens[k] if tokens[k] else None for k in range(2)]
    limit = max(least, (means[1] + (means[1] if means[0] is None else means[0])) / 2)
    return table, limit


def scan(docs: DataFrame, text: str = "text", model: tuple | None = None) -> DataFrame:
    """``docs`` with ``__found``: struct of n_assign, n_access, n_hex, ``base`` and ``all`` (encoded spans, see ``spans``)."""
    model = model or train(docs, text)
    df = with_base(docs, text).withColumn("__all_base", F.concat(*[F.col(f"__base_{k}") for k in KINDS[:3]]))
    if model is None:
        added = F.array().cast("array<string>")
    else:
        table = constant(model[0])
        found = F.filter("__tokens", lambda s: ratio(s["hit"], table) > model[1])
        added = spans.encoded(found, "markov", 3)
    counts = [F.size(f"__base_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select(*docs.columns, F.struct(*counts, F.col("__all_base").alias("base"), F.concat("__all_base", added).alias("all")).alias("__found"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Base counts, base digest and all spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [f"__found.n_{k}" for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("__found.base")), 256).alias("base_sha256"), spans.joined(F.col("__found.all")).alias("spans"))
