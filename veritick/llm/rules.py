"""Quality rules as a short-circuit cascade: measured cost and selectivity decide the order of the rules.

A rule rejects or passes one whole text by a few measures of it.  Measures are computed when a rule first asks for them
and kept for the rules after it, and the first rule that rejects ends the work on a text.  On a bounded sample every rule
is timed and tried by itself; the cascade then takes, again and again, the rule that rejects most of what is still there
per second (so that rules which reject the same texts do not stand one behind the other).  The order changes the time
and which rule is named, never the verdict: a text is kept if no rule rejects it.

Edge cases: null and empty texts have no words, all counts 0, and fail ``few_words``. Words are separated by ASCII white
space alone. Null ids, repeated rows and ids are texts like any other; an empty table gives an
empty result (the rules stay in their given order). Extra columns pass through; those named like a result are replaced. A
text is held with its list of words, so that one of n bytes needs a small multiple of n in its task.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
BULLETS = (b"*", b"-", b"\xe2\x80\xa2")
DOTS = (b"...", b"\xe2\x80\xa6")
_LETTER_WORD = re.compile(rb"[^\x09-\x0D\x20A-Za-z\x80-\xFF]*[A-Za-z\x80-\xFF][^\x09-\x0D\x20]*")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ROWS = 256  # texts held as objects at a time


class Measures:
    """What rules ask of one text, each computed at most once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def without(self, chars: bytes) -> int:
        """Bytes of ``chars`` in the text."""
        return len(self.raw) - len(self.raw.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: at ASCII white space

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.without(SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return self.without(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> tuple[np.ndarray, int]:
        """The words as numbers in order of appearance, and how many there are."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words), len(seen)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that is found twice or more."""
        ids, v = self.ids
        if len(ids) < 4:
            return 0
        first = ids[:-2] * v + ids[1:-1]
        if v >= 1 << 20:  # the product of three would leave 64 bits
            first, v = np.unique(first, return_inverse=True)[1], len(ids)
        _, where, often = np.unique(first * v + ids[2:], return_inverse=True, return_counts=True)
        start = often[where] > 1
        hit = np.zeros(len(ids), bool)
        for k in range(3):
            hit[k : len(ids) - 2 + k] |= start
        return int(hit.sum())

    @cached_property
    def letter_words(self) -> int:
        return len(_LETTER_WORD.findall(self.raw))

    @cached_property
    def packed(self) -> int:
        return len(zlib.compress(self.raw, 1))


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells whether a text goes."""

    name: str
    rejects: Callable[[Measures], bool]


def few_words(m: Measures) -> bool:
    return m.n_words < 50


def repeated(m: Measures) -> bool:
    return 100 * m.n_repeat_words > 50 * m.n_words


def symbols(m: Measures) -> bool:
    """Over one symbol in ten words."""
    return 10 * m.n_symbols > m.n_words


def word_length(m: Measures) -> bool:
    """A mean word of under 2 or over 15 code points."""
    return not 2 * m.n_words <= m.word_chars <= 15 * m.n_words


def dup_lines(m: Measures) -> bool:
    """Over half of the lines are repeats."""
    return 100 * m.n_dup_lines > 50 * len(m.lines)


def shouting(m: Measures) -> bool:
    """More capitals than small letters, of the Latin letters of ASCII."""
    return m.without(UPPER) > m.without(LOWER)


def no_letters(m: Measures) -> bool:
    """Under six words in ten have a letter."""
    return 10 * m.letter_words < 6 * m.n_words


def bullets(m: Measures) -> bool:
    """Over nine lines in ten start with a bullet."""
    return 10 * sum(x.lstrip(SPACE).startswith(BULLETS) for x in m.lines) > 9 * len(m.lines)


def unfinished(m: Measures) -> bool:
    """Over three lines in ten end in an ellipsis."""
    return 10 * sum(x.rstrip(SPACE).endswith(DOTS) for x in m.lines) > 3 * len(m.lines)


def one_word(m: Measures) -> bool:
    """One word makes up over three tenths of the words."""
    ids, v = m.ids
    return bool(v) and 10 * int(np.bincount(ids).max()) > 3 * len(ids)


def monotone(m: Measures) -> bool:
    """Compresses to under a twelfth."""
    return 12 * m.packed < len(m.raw)


BASE = (Rule("few_words", few_words), Rule("repeated", repeated))
MORE = (
    Rule("symbols", symbols), Rule("word_length", word_length), Rule("dup_lines", dup_lines), Rule("shouting", shouting), Rule("no_letters", no_letters),
    Rule("bullets", bullets), Rule("unfinished", unfinished), Rule("one_word", one_word), Rule("monotone", monotone),
)
RULES = BASE + MORE


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(seconds a text of each rule by itself, which rule rejects which sampled text).

    The sample is ``sample_docs`` rows of least hash of the id, whole texts; they are tried where they are read, and only
    times and outcomes move.
    """

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                found = []
                for t in batch.column(0).slice(lo, ROWS).to_pylist():
                    took, gone = [], []
                    for r in rules:
                        own, start = Measures(t), time.perf_counter()
                        gone.append(r.rejects(own))
                        took.append(time.perf_counter() - start)
                    found.append((took, gone))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.list_(pa.bool_()))], ["took", "gone"])

    place = F.xxhash64(F.col(doc_id))
    last = docs.select(place.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    some = docs.where(place <= last).select(text)
    rows = some.mapInArrow(tried, "took array<double>, gone array<boolean>").limit(sample_docs).collect()
    n = len(rules)
    took = np.array([r["took"] for r in rows], dtype=float).reshape(len(rows), n)
    gone = np.array([r["gone"] for r in rows], dtype=bool).reshape(len(rows), n)
    return took.mean(axis=0) if len(rows) else np.ones(n), gone


def ordered(cost: np.ndarray, gone: np.ndarray) -> list[int]:
    """Places of the rules by rejection of what is left per cost; ties stay in their given order."""
    left, rest, out = np.ones(len(gone), bool), list(range(len(cost))), []
    while rest:
        best = max(rest, key=lambda j: (int((gone[:, j] & left).sum()) / max(cost[j], 1e-12), -j))
        out.append(best)
        rest.remove(best)
        left &= ~gone[:, best]
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...], *, text: str = "text", counts: bool = False, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (the first rule of ``rules``, in the order given, that rejects; else null).

    With ``counts``, also the columns ``COUNTS`` of every text and ``base_failed`` (a rule of ``base`` rejects it); without
    it nothing is measured beyond the first rejection.
    """
    kind = "kept boolean, rejected_by string" + "".join(f", {c} bigint" for c in COUNTS if counts) + ", base_failed boolean" * counts

    def one(t: str | None) -> dict:
        m = Measures(t)
        by = next((r.name for r in rules if r.rejects(m)), None)
        out = {"kept": by is None, "rejected_by": by}
        if counts:
            out |= {c: getattr(m, c) for c in COUNTS} | {"base_failed": any(r.rejects(m) for r in base)}
        return out

    names = [x.split(" ")[0] for x in kind.split(", ")]
    types = [pa.bool_(), pa.string(), *[pa.int64()] * len(COUNTS), pa.bool_()]

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                found = [one(t) for t in batch.slice(lo, ROWS).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, types, strict=False)], names)

    had = docs.withColumn("__rules", F.arrow_udf(work, f"struct<{kind.replace(' ', ':')}>".replace(",:", ","))(F.col(text)))
    return had.withColumns({c: F.col("__rules")[c] for c in names}).drop("__rules")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 1000, counts: bool = False) -> DataFrame:
    """``cascade`` in the order that a sample of ``docs`` suggests."""
    order = ordered(*estimates(docs, rules, doc_id=doc_id, text=text, sample_docs=sample_docs))
    return cascade(docs, tuple(rules[j] for j in order), text=text, counts=counts)


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs, counts=True).select("doc_id", *COUNTS, "base_failed", "kept")
