"""Spans of regular-expression matches with built-in functions only: code-point positions, sorting, digests, masking.

Positions come from the lengths of what lies between matches (``split``) and of the matches (``regexp_extract_all``).
A span is carried as a sortable text ``start|order|kind:start:end``, so that sorting and joining spans are operations on
strings.  Running sums go by blocks of 64 matches: linear cost up to some thousand matches of one text, and growing with
the square of its number of blocks beyond.  What surrounds a match comes from the pieces between matches, each of which
is looked at once, so that the length of a text does not multiply with its matches; ``masked`` does walk to each span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
HIT = "struct<hit:string,start:int,end:int>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once: within a lambda a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, largest: bool = False) -> Column:
    """Per element, the sum (or maximum) of those before it, 0 for the first; by blocks, so that cost stays near linear."""

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), (lambda a, v: F.greatest(a, v)) if largest else (lambda a, v: a + v))

    def join(a: Column, b: Column) -> Column:
        return F.greatest(a, b) if largest else a + b

    def parts(blocks: Column, totals: Column) -> Column:
        offsets = F.transform(totals, lambda _, b: fold(F.slice(totals, F.lit(1), b)))
        return F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.transform(x, lambda _, i: join(o, fold(F.slice(x, F.lit(1), i))))))

    def blocked(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        made = let(blocks, lambda x: let(F.transform(x, fold), lambda t: parts(x, t)))
        return F.when(F.size(v) > 0, made).otherwise(F.array().cast("array<int>"))

    return let(values, blocked)


def gaps_and_hits(text: Column, pattern: str, only_if: Column) -> Column:
    """struct(gaps, hits): lengths of the pieces before each match, and the matches; empty where ``only_if`` is false."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.struct(F.array().cast("array<int>").alias("gaps"), F.array().cast("array<string>").alias("hits"))
    return F.when(only_if, F.struct(gaps.alias("gaps"), hits.alias("hits"))).otherwise(none)


def sides(text: Column, pattern: str, only_if: Column, reach: int) -> Column:
    """Per match, struct(before, after): the last ``reach`` characters since the match before, and the next character."""
    pieces = F.split(text, pattern, -1)
    tails = F.transform(pieces, lambda p: F.right(p, F.lit(reach)))
    heads = F.transform(pieces, lambda p: F.left(p, F.lit(1)))
    n = F.size(pieces) - 1
    both = F.zip_with(F.slice(tails, F.lit(1), n), F.slice(heads, F.lit(2), n), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.when(only_if, both).otherwise(F.array().cast("array<struct<before:string,after:string>>"))


def located(found: Column) -> Column:
    """``array<struct<hit, start, end>>`` from ``gaps_and_hits``: 0-based code points, end exclusive."""
    hits = found["hits"]
    steps = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(hits)), hits, lambda g, h: g + F.length(h))
    ends = F.zip_with(running(steps), steps, lambda a, b: a + b)
    spans = F.zip_with(hits, ends, lambda h, e: F.struct(h.alias("hit"), (e - F.length(h)).alias("start"), e.alias("end")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(f"array<{HIT}>"))


def encoded(spans: Column, kind: str, order: int) -> Column:
    """Sortable texts of located spans."""
    return F.transform(
        spans,
        lambda s: F.concat(
            F.lpad(s["start"].cast("string"), 12, "0"), F.lit(f"|{order}|{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
        ),
    )


def member(codes: Column, among: Column) -> Column:
    """Per encoded span of ``codes`` (distinct, ascending), whether it is in ``among``: one sort of both."""
    tag = lambda own: lambda c: F.struct(c.alias("code"), F.lit(own).alias("own"))
    none = F.array(F.struct(F.lit("").alias("code"), F.lit(0).alias("own")))

    def told(u: Column) -> Column:
        before = F.concat(none, F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0))))
        both = F.zip_with(u, before, lambda x, p: F.struct(x["own"].alias("own"), (x["code"] == p["code"]).alias("found")))
        return F.transform(F.filter(both, lambda x: x["own"] == 1), lambda x: x["found"])

    return let(F.array_sort(F.concat(F.transform(among, tag(0)), F.transform(codes, tag(1)))), told)


KIND_STEP = 1 << 28  # longer than any text: spans of different kinds never meet where each kind has its own stretch


def by_kind(codes: Column) -> Column:
    """Encoded spans as ``HIT`` (the code as hit), each kind moved to a stretch of its own."""

    def one(c: Column) -> Column:
        place = F.split_part(c, F.lit("|"), F.lit(2)).cast("int") * KIND_STEP
        return F.struct(c.alias("hit"), *[(F.split_part(c, F.lit(":"), F.lit(k)).cast("int") + place).alias(n) for k, n in ((2, "start"), (3, "end"))])

    return F.transform(codes, one)


LATEST = 2**31 - 1


def with_free(df: DataFrame, found: str, taken: str, into: str) -> DataFrame:
    """Adds ``into``: the located spans of ``found`` that overlap none of ``taken``; both are arrays of ``HIT``.

    One sort of both by start, then the greatest end of a taken span before each span and the next start of one after it,
    as running values: no span is compared with every other.
    """
    tagged = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["hit"].alias("hit")))
    df = df.withColumn("__u", F.array_sort(F.concat(tagged(taken, 0), tagged(found, 1))))
    ends = F.transform("__u", lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0))
    starts = F.transform(F.reverse("__u"), lambda x: F.when(x["own"] == 0, F.lit(LATEST) - x["start"]).otherwise(0))
    df = df.withColumns({"__ends": ends, "__starts": starts})
    df = df.withColumns({"__before": running(F.col("__ends"), largest=True), "__after": F.reverse(running(F.col("__starts"), largest=True))})
    apart = lambda x: (x["u"]["own"] == 1) & (x["before"] <= x["u"]["start"]) & (F.lit(LATEST) - x["after"] >= x["u"]["end"])
    kept = F.filter(F.arrays_zip(F.col("__u").alias("u"), F.col("__before").alias("before"), F.col("__after").alias("after")), apart)
    plain = F.transform(kept, lambda x: F.struct(x["u"]["hit"].alias("hit"), x["u"]["start"].alias("start"), x["u"]["end"].alias("end")))
    return df.withColumn(into, plain).drop("__u", "__ends", "__starts", "__before", "__after")


def joined(codes: Column) -> Column:
    """``kind:start:end`` of encoded spans, by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(codes), lambda c: F.substring_index(c, "|", -1)), ",")


def masked(text: Column, codes: Column) -> Column:
    """The text with each span replaced by its kind in capitals and brackets; overlapping spans merge into the first.

    Pieces are cut out of the text in a code of four bytes a character, where no walk from its start is needed.
    """
    wide = "UTF-32"
    spans = F.transform(
        F.sort_array(codes),
        lambda c: F.struct(
            F.split_part(c, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.split_part(c, F.lit(":"), F.lit(3)).cast("int").alias("end"),
            F.upper(F.split_part(F.substring_index(c, "|", -1), F.lit(":"), F.lit(1))).alias("kind"),
        ),
    )

    def cut_out(raw: Column, s: Column, p: Column) -> Column:
        piece = F.decode(F.substring(raw, 4 * p + 1, 4 * (s["start"] - p)), wide)
        return F.when(s["start"] >= p, F.concat(piece, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))

    def made(spans: Column, raw: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        pieces = F.zip_with(spans, running(ends, largest=True), lambda s, p: cut_out(raw, s, p))
        return F.concat(F.array_join(pieces, ""), F.decode(F.substring(raw, 4 * F.array_max(ends) + 1, F.length(raw)), wide))

    return F.when(F.size(codes) > 0, let(spans, lambda s: let(F.encode(text, wide), lambda raw: made(s, raw)))).otherwise(text)
