"""Language identification by prediction by partial matching over bytes.

Per language a context tree of order ``order`` counts which byte follows each context.  A symbol seen in a context n
times out of N, with q distinct symbols there, has probability n / (N + q); the escape to the next shorter context has
q / (N + q) (method C), with symbols of longer contexts not excluded; a context that the language has not seen costs
nothing to leave; order -1 is uniform over 257 symbols.  After training the statistics are frozen, so that the code
length of a byte depends on its last ``order`` bytes alone.  The trees of all languages are merged: each (context,
byte) that any language has seen has an entry with its code length in every language, each context one with the cost of
its escape.  A byte whose longest context has no entry pays that context's escapes and goes on with the next shorter
one.  The whole trees are kept, without a bound on contexts.

Training rows are a bounded sample: of each of the ``most_langs`` most frequent languages at most ``sample_docs``
documents, those of least hash of the id, and of each its whole text.  Tasks count the sample's contexts; the driver
sees the counts only, whose number the sample bounds.

The answer is the language of the least code length.  Its score is the posterior under equal priors of the mean code
lengths per byte taken over ``evidence`` bytes.  ``und`` answers a null text or one without a letter.

Edge cases: texts are coded as UTF-8 and begin after ``order`` padding symbols, as in training; a context with a byte
never seen in training is an unseen context. Empty texts, nulls and texts without a letter get ``und``
and score 0. Ties go to the language that sorts first. Rows with a null id are scored and never trained on. Without
any training row every answer is ``und``. Repeated rows are scored one by one. Extra columns pass through; those
named like a result are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
BASE = 257  # symbols: 0 is padding, a byte is its value plus 1
PIECE = 1 << 16
HASH_BITS = 30
ROWS = 512


class Table:
    """Places of sorted distinct numbers, by open addressing; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(8 * max(1, len(keys)))))))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        waiting = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]  # of several for one slot, the last stays
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it is absent."""
        at = self._home(wanted)
        got = self.slots[at]
        open_ = np.flatnonzero((got >= 0) & (self.keys[got] != wanted)) if len(self.keys) else np.zeros(0, np.int64)
        here = at[open_]
        while len(open_):
            here = (here + 1) & self.mask
            found = self.slots[here]
            got[open_] = found
            again = (found >= 0) & (self.keys[found] != wanted[open_])
            open_, here = open_[again], here[again]
        return got


@dataclass(frozen=True)
class Model:
    """Per length k of the context: sorted (context, byte) numbers with bits [entry, language], contexts with escapes."""

    langs: tuple[str, ...]
    order: int
    grams: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    def tables(self) -> tuple[list[Table], list[Table]]:
        """Look-up tables of this process."""
        key = id(self)
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = self, ([Table(g) for g in self.grams], [Table(c) for c in self.contexts])
        return _TABLES[key][1]


_TABLES: dict[int, tuple] = {}


def windows(symbols: np.ndarray, k: int) -> np.ndarray:
    """Every k consecutive symbols as one number."""
    n = len(symbols) - k + 1
    out = np.zeros(max(0, n), np.int64)
    for j in range(k):
        out *= BASE
        out += symbols[j : j + n]
    return out


def pieces_of(text: bytes, order: int) -> Iterator[np.ndarray]:
    """A text's symbols in pieces of bounded size, each with the ``order`` symbols before it."""
    raw = np.frombuffer(text, np.uint8)
    for lo in range(0, len(raw), PIECE):
        head = np.zeros(max(0, order - lo), np.uint16)
        yield np.concatenate([head, raw[max(0, lo - order) : lo + PIECE].astype(np.uint16) + 1])


def count_grams(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length k of the context, the distinct (context, byte) numbers and how often each occurs."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    waiting: list[np.ndarray] = []

    def flush() -> None:
        for k in range(order + 1):
            codes = [windows(s[order - k :], k + 1) for s in waiting]
            found[k].append(np.unique(np.concatenate(codes), return_counts=True))
        waiting.clear()

    for t in texts:
        for symbols in pieces_of(t, order):
            waiting.append(symbols)
            if sum(map(len, waiting)) >= PIECE:
                flush()
    if waiting:
        flush()
    out = []
    for parts in found:
        every = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int64)
        grams, at = np.unique(every, return_inverse=True)
        out.append((grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)) if parts else np.zeros(0)))
    return out


def freeze(counted: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int) -> Model | None:
    """The merged, frozen trees from each language's counts."""
    langs = tuple(sorted(k for k, v in counted.items() if len(v[0][0])))
    if not langs:
        return None
    grams, bits, contexts, escapes = [], [], [], []
    for k in range(order + 1):
        own = [counted[lang][k] for lang in langs]
        every = np.unique(np.concatenate([g for g, _ in own]))
        ctx = np.unique(every // BASE)
        if k:
            shorter = np.searchsorted(grams[-1], every % BASE**k)  # always there: it was counted at the same places
            lower = bits[-1][shorter].astype(np.float64)
        else:
            lower = np.full((len(every), len(langs)), np.log2(257.0))
        cost, leave = np.zeros((len(every), len(langs))), np.zeros((len(ctx), len(langs)))
        parent = np.searchsorted(ctx, every // BASE)
        for i, (g, n) in enumerate(own):
            at = np.searchsorted(ctx, g // BASE)
            total, q = np.bincount(at, weights=n, minlength=len(ctx)), np.bincount(at, minlength=len(ctx))
            known = q > 0
            leave[known, i] = -np.log2(q[known] / (total[known] + q[known]))
            cost[:, i] = lower[:, i] + leave[parent, i]
            cost[np.searchsorted(every, g), i] = -np.log2(n / (total[at] + q[at]))
        grams.append(every)
        bits.append(cost.astype(np.float32))
        contexts.append(ctx)
        escapes.append(leave.astype(np.float32))
    return Model(langs, order, tuple(grams), tuple(bits), tuple(contexts), tuple(escapes))


def build(samples: dict[str, list[bytes]], order: int = 3) -> Model | None:
    """The model of texts at hand."""
    return freeze({lang: count_grams(texts, order) for lang, texts in samples.items()}, order)


def costs(model: Model, codes: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each number of ``order + 1`` symbols, in each language."""
    entries, leaving = model.tables()
    out = np.zeros((len(codes), len(model.langs)), np.float32)
    todo = np.arange(len(codes))
    for k in range(model.order, -1, -1):
        at = entries[k].find(codes)
        hit = at >= 0
        out[todo[hit]] += model.bits[k][at[hit]]
        todo, codes = todo[~hit], codes[~hit]
        if not len(todo):
            return out
        left = leaving[k].find(codes // BASE)
        seen = left >= 0
        out[todo[seen]] += model.escapes[k][left[seen]]
        codes = codes % BASE**k
    out[todo] += np.float32(np.log2(257.0))
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language, whole texts, in pieces of bounded size."""
    out = np.zeros((len(texts), len(model.langs)))
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        codes = [windows(s, model.order + 1) for _, s in waiting]
        starts = np.cumsum([0] + [len(c) for c in codes])[:-1]
        sums = np.add.reduceat(costs(model, np.concatenate(codes)), starts, axis=0, dtype=np.float64)
        np.add.at(out, [i for i, _ in waiting], sums)
        waiting.clear()

    for i, t in enumerate(texts):
        for symbols in pieces_of(t, model.order):
            waiting.append((i, symbols))
            size += len(symbols)
            if size >= PIECE:
                flush()
                size = 0
    if waiting:
        flush()
    return out


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, sample_docs: int, most_langs: int) -> DataFrame | None:
    """(lang, text) of the sample; None without any labelled row."""
    name = F.col(doc_id).cast("string")
    h = F.pmod(F.xxhash64(name), F.lit(1 << HASH_BITS))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0) & (F.crc32(name) % 3 != 1))
    sizes = rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_langs).collect()
    if not sizes:
        return None
    # a first cut by the same hash, so that the ranking below handles about twice the sample of each language
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1 << HASH_BITS, int(2.0 * sample_docs / r["n"] * (1 << HASH_BITS)) + 1))])
    some = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"), name.alias("id")).where(F.col("h") < F.get(F.array(cut[F.col("lang")]), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    return some.withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "text")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, sample_docs: int = 1000, most_langs: int = 200, order: int = 3) -> Model | None:
    """A model from labelled documents whose crc32(id) mod 3 is not 1, at most ``sample_docs`` of each language."""
    some = training_rows(docs, doc_id, text, lang, sample_docs, most_langs)
    if some is None:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for which, group in pdf.groupby("lang"):
                for k, (grams, n) in enumerate(count_grams([t.encode("utf-8", "surrogatepass") for t in group["text"]], order)):
                    yield pd.DataFrame({"lang": which, "k": np.int32(k), "gram": grams, "n": n.astype(np.int64)})

    counts = some.mapInPandas(count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs, place = np.unique(got["lang"].to_numpy(), return_inverse=True)
    k, gram, n = (got[c].to_numpy() for c in ("k", "gram", "n"))
    counted = {}
    for i, which in enumerate(langs.tolist()):
        counted[which] = []
        for j in range(order + 1):
            mine = np.flatnonzero((place == i) & (k == j))
            mine = mine[np.argsort(gram[mine])]
            counted[which].append((gram[mine], n[mine].astype(np.float64)))
    return freeze(counted, order)


def has_letter(text: F.Column) -> F.Column:
    return text.rlike(r"\p{L}")


def identify(docs: DataFrame, model: Model | None, text: str = "text", evidence: float = 64.0) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (of the best language)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(known: list[bytes], ok: np.ndarray) -> pa.StructArray:
        m = shared.value
        bits = code_lengths(m, known)
        n = np.maximum(1, [len(x) for x in known])
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        post = 1 / np.exp2(-(bits - least[:, None]) / n[:, None] * np.minimum(evidence, n)[:, None]).sum(axis=1)
        parts = np.where(ok, np.array(m.langs, dtype=object)[best], UND), np.where(ok, post, 0.0), pa.array(least / n, mask=~ok)
        return pa.StructArray.from_arrays([pa.array(x) for x in parts], ["lang_pred", "score", "bits_per_byte"])

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, letter in batches:
            for lo in range(0, len(t), ROWS):  # few texts at a time are Python objects
                ok = np.array(letter.slice(lo, ROWS).to_pylist(), dtype=bool)
                raw = t.slice(lo, ROWS).cast(pa.binary()).to_pylist()
                yield score([x if o else b"" for x, o in zip(raw, ok.tolist(), strict=True)], ok)

    scored = F.arrow_udf(work, "lang_pred string, score double, bits_per_byte double")
    letter = F.coalesce(has_letter(F.col(text)), F.lit(False))
    df = docs.withColumn("__lang", scored(F.coalesce(F.col(text), F.lit("")), letter))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    return df.select(*kept, "__lang.lang_pred", "__lang.score", "__lang.bits_per_byte")


def crc_mod(doc_id: object, by: int) -> int:
    """crc32 of the id as text, modulo ``by``."""
    return zlib.crc32(str(doc_id).encode()) % by


def op4_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; documents whose crc32(id) mod 3 is 1 are held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
