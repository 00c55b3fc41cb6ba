"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Features are plain counts of a whole text (shares of letter kinds, symbols and repeated words, word lengths, ...).
Each is binned at quantiles of the training rows.  Boosting goes round the features: each step fits a tree of at most
three leaves on one feature to the residual and adds it to that feature's lookup table; after the main effects, the
pairs that explain most of the residual get tables of their own on coarser bins.  A score is the sum of one table entry
per feature and pair, taken for whole batches at once.

Training rows are a bounded sample: at most ``sample_docs`` labelled documents (least hash of the id first), whole texts.

Edge cases: null and empty texts have the features of an empty text and get a score too. Ids null in ``docs`` are
scored and never trained on; null labels are left out; a repeated label counts once, and of documents of one id the one
of least features. With labels of one kind (or none) every score is their
share (or 0.5). Repeated rows are scored one by one. Extra columns pass through; one named ``score`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "symbol", "comma_stop", "bars", "high_bytes", "lines",
    "distinct_words", "distinct_lines", "top_word", "long_words", "short_words", "upper_words", "symbol_words", "marks", "entropy",
)
_KIND = np.zeros(256, dtype=np.uint8)  # 0 control, 1 upper, 2 lower, 3 digit, 4 stop or comma, 5 bar, 6 other symbol, 7 non-ASCII, 8 space
_KIND[33:127] = 6
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[44, 46]], _KIND[124], _KIND[128:], _KIND[32] = 4, 5, 7, 8


def features(text: str | None) -> list[float]:
    """The features of one text, in the order of ``NAMES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256)
    kinds = np.bincount(_KIND, weights=hist, minlength=9)
    n = len(raw)
    words = raw.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n_words = max(1, len(words))
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    shown = (kinds[1:8].sum() + 1e-9)
    p = hist[hist > 0] / n
    ends = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    heads = np.fromiter((w[0] for w in words), np.uint8, len(words))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0,
        kinds[1] / shown, kinds[2] / shown, kinds[3] / shown, kinds[6] / shown, kinds[4] / n_words, kinds[5] / n_words, kinds[7] / shown, len(lines) / n_words,
        len(counts) / n_words, len(set(lines)) / len(lines), max(counts.values(), default=0) / n_words,
        float((lengths >= 12).sum()) / n_words, float((lengths <= 2).sum()) / n_words, float((_KIND[heads] == 1).sum()) / n_words,
        float((_KIND[ends] == 6).sum()) / n_words, float(hist[[33, 63]].sum()) / n_words, float(-(p * np.log2(p)).sum()),
    ]


@dataclass(frozen=True)
class Model:
    base: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_cuts: tuple[np.ndarray, ...]
    pair_tables: tuple[np.ndarray, ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features, by table additions."""
        out = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, j])]
        coarse = [np.searchsorted(c, x[:, j]) for j, c in enumerate(self.pair_cuts)]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[i], coarse[j]]
        return out


def _step(bins: np.ndarray, n_bins: int, g: np.ndarray, h: np.ndarray, rate: float, least: float = 2.0) -> np.ndarray:
    """A tree of up to three leaves on one binned feature, as a table."""
    gs, hs = np.bincount(bins, g, n_bins), np.bincount(bins, h, n_bins)
    edges = [0, n_bins]
    for _ in range(2):
        best, at = 1e-9, None
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            cg, ch = np.cumsum(gs[lo:hi])[:-1], np.cumsum(hs[lo:hi])[:-1]
            tg, th = gs[lo:hi].sum(), hs[lo:hi].sum()
            gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
            gain[(ch < least) | (th - ch < least)] = -1
            if len(gain) and gain.max() > best:
                best, at = gain.max(), lo + 1 + int(gain.argmax())
        if at is None:
            break
        edges = sorted([*edges, at])
    table = np.zeros(n_bins)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        table[lo:hi] = rate * gs[lo:hi].sum() / (hs[lo:hi].sum() + 1)
    return table


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, rate: float = 0.1, n_bins: int = 32, n_pairs: int = 6, coarse: int = 6) -> Model:
    """The additive model of 0/1 labels."""
    d = len(NAMES)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cut = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0)
    cuts, pair_cuts = tuple(cut(j, n_bins) for j in range(d)), tuple(cut(j, coarse) for j in range(d))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    none = Model(base, cuts, tuple(tables), (), pair_cuts, ())
    if len(np.unique(y)) < 2:
        return none
    bins = [np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]
    f = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-f))
            t = _step(bins[j], len(tables[j]), y - p, p * (1 - p), rate)
            tables[j] += t
            f += t[bins[j]]
    small = [np.searchsorted(c, x[:, j]) for j, c in enumerate(pair_cuts)]
    width = coarse + 1
    p = 1 / (1 + np.exp(-f))
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = small[i] * width + small[j]
            g, h = np.bincount(cell, y - p, width * width), np.bincount(cell, p * (1 - p), width * width)
            gains.append(((g**2 / (h + 5)).sum(), (i, j)))
    pairs = tuple(ij for _, ij in sorted(gains, reverse=True)[:n_pairs])
    grids = [np.zeros((width, width)) for _ in pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(pairs):
            cell = small[i] * width + small[j]
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(cell, y - p, width * width), np.bincount(cell, p * (1 - p), width * width)
            t = (rate * g / (h + 5)).reshape(width, width)
            grids[k] += t
            f += t.ravel()[cell]
    return Model(base, cuts, tuple(tables), pairs, pair_cuts, tuple(grids))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``features`` (array<double>)."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([features(x) for x in t])

    return docs.withColumn("features", F.pandas_udf(work, "array<double>")(F.coalesce(F.col(text), F.lit(""))))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", text: str = "text", sample_docs: int = 8000) -> Model:
    """A model from at most ``sample_docs`` labelled documents whose crc32(id) mod 5 is not 0."""
    crc = F.crc32(F.col("id").cast("string")) % 5 != 0
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & crc)
    chosen = known.distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")  # bounded by sample_docs
    one = with_features(rows, "t").groupBy("id", "y").agg(F.min("features").alias("features"))  # of documents of one id the least: at most sample_docs rows
    got = sorted((r["id"], r["y"], r["features"]) for r in one.collect())
    x = np.array([r[2] for r in got], dtype=float).reshape(len(got), len(NAMES))
    return fit(x, np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            x = np.array([features(v) for v in t], dtype=float).reshape(len(t), len(NAMES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margins(x), -30, 30))))

    return docs.withColumn("score", F.pandas_udf(work, "double")(F.coalesce(F.col(text), F.lit(""))))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document; documents whose crc32(id) mod 5 is 0 are held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
