"""Benchmark decontamination: a prefix-filtered join on each window's rarest word, verified by exact alignment.

A window is ``width`` consecutive words of an item (a shorter item, if not empty, is one window).  Every occurrence of a
window contains each of its words, so joining on one of them, the prefix of length 1 that containment 1.0 needs, loses
nothing; words are ordered by their number of occurrences over all documents, and the rarest of each window is used.
A document word that equals such a prefix word at item position p aligns the document with the item.  The length and
positional bounds keep the alignment inside both texts, and the longest run of equal words through p (at most
``width - 1`` words to either side decide it) is compared exactly; a run of a whole window or more is an occurrence.

One pass over the documents counts the items' words, one finds the hits; texts are never shuffled, only words that may be
prefix words (a bit table of their hashes, sized by their number, tells) with the words around them.  Prefix tables are
broadcast only if their measured size is under ``broadcast_bytes``; else both sides are salted.

Edge cases: null texts and texts without words have n_words 0 and no hits. Items that are null or have no words have
no window. Repeated items count once in ``n_items`` per id; an item with a null id hits words as any other, but is in
neither ``n_items`` nor the list of ids. Rows are told apart by position, so repeated documents are
judged one by one; null ids are kept. An empty benchmark or document table works. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SALT = 16


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone; ``lower`` is the same, and faster, where all characters are ASCII."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


@dataclass(frozen=True)
class Bits:
    """A bit table of word hashes; ``any`` is false if no bit is set."""

    slots: int
    words: tuple[int, ...]
    any: bool

    def __call__(self, word: Column) -> Column:
        """Whether the word may be in the table."""
        slot = F.pmod(F.xxhash64(word), F.lit(self.slots)).cast("int")
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # one literal, folded once
        return F.getbit(F.get(table, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1


def bits_of(words: DataFrame, least: int = 1 << 20, most: int = 1 << 24) -> Bits:
    """The table of a one-column table of words: 16 bits a word, between the bounds; full tables only let more words by."""
    n = words.count()
    slots = min(most, max(least, 1 << max(0, 16 * n - 1).bit_length()))
    slot = F.pmod(F.xxhash64("word"), F.lit(slots)).cast("int")
    set_ = words.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(word), {slots}) as int) & 63)").alias("bit"))
    table = [0] * (slots // 64)
    for r in set_.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most most / 64 rows
        table[r["at"]] = r["bits"]
    return Bits(slots, tuple(table), n > 0)


def at_words(words: Column, bits: Bits) -> Column:
    """0-based positions of the words that may be in the table."""
    marked = F.transform(words, lambda w, i: F.when(bits(w), i))
    return F.filter(marked, lambda i: i.isNotNull())


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(key, item, words), one row per distinct pair of id and words, without empty items."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    return cut(rows.where(F.size("words") > 0).distinct().withColumn("key", F.monotonically_increasing_id()))


def maybe_broadcast(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df


def prefixes(docs_words: DataFrame, items: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """(word, item, p, len, around): item positions of prefix words, with the item's words around them."""
    spots = items.select("key", "item", "words", F.posexplode("words").alias("p", "word"))
    vocabulary = cut(spots.select("word").distinct())
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0]
    seen = docs_words.select(F.explode(F.transform(at_words(F.col("words"), bits_of(vocabulary)), lambda i: F.get("words", i))).alias("word"))
    counts = seen.groupBy("word").agg(F.count("*").alias("n")).join(maybe_broadcast(vocabulary, size, broadcast_bytes), "word", "left_semi")
    ranked = cut(spots.select("key", "p", "word", F.size("words").alias("len")).join(counts, "word", "left").na.fill(0, ["n"]))
    # rarest word of each window start s, ties to the first position
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - width + 1), F.least(F.col("p"), F.greatest(F.lit(0), F.col("len") - width)))).alias("s")
    rarest = ranked.select("key", "p", "n", "len", start).groupBy("key", "s").agg(F.min_by("p", F.struct("n", "p")).alias("p"))
    used = rarest.select("key", "p").distinct()
    around = spots.join(used, ["key", "p"]).select("word", "item", "p", F.size("words").alias("len"), *sides(F.col("words"), F.col("p"), width, "i"))
    return cut(around)


def sides(words: Column, p: Column, width: int, name: str) -> list[Column]:
    """The words before p, nearest first, and those after it; at most ``width - 1`` of each."""
    k = F.least(p, F.lit(width - 1))
    before = F.when(k > 0, F.reverse(F.slice(words, p - k + 1, k))).otherwise(F.array().cast("array<string>"))
    return [before.alias(f"{name}_before"), F.slice(words, p + 2, F.lit(width - 1)).alias(f"{name}_after")]


def run(a: Column, b: Column) -> Column:
    """How many first elements are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def covered(intervals: Column) -> Column:
    """Number of positions in the union of [start, end) intervals."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to"))
    return F.aggregate(F.array_sort(intervals), none, step, lambda a: a["n"])


def hits(
    docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    *, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row of ``docs``: __row, doc_id, n_words, n_hit, n_items, item ids sorted as strings."""
    parts = item_words(items, item_id, item_text)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    prefix = prefixes(rows, parts, width, broadcast_bytes)
    size = prefix.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length(F.to_json(F.struct("i_before", "i_after"))) + 32), F.lit(0))).first()[0]
    bits = bits_of(prefix.select("word"))
    if not bits.any:
        none = F.lit(0).cast("long")
        return rows.select("__row", "doc_id", F.size("words").cast("long").alias("n_words"), none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"))
    places = F.transform(at_words(F.col("words"), bits), lambda i: F.struct(i.alias("p"), F.get("words", i).alias("word"), *sides(F.col("words"), i, width, "d")))
    near = rows.select("__row", "doc_id", F.size("words").alias("n_words"), F.explode_outer(places).alias("d")).select("__row", "doc_id", "n_words", "d.*").withColumnRenamed("p", "at")
    if size <= broadcast_bytes:
        met = near.join(F.broadcast(prefix), "word", "left")
    else:  # a word of very many places is spread over SALT tasks
        salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = near.withColumn("salt", F.pmod(F.xxhash64("__row", "at"), F.lit(SALT)).cast("int")).join(salted, ["word", "salt"], "left")
    left, right = run(F.col("d_before"), F.col("i_before")), run(F.col("d_after"), F.col("i_after"))
    ends = met.select("__row", "doc_id", "n_words", "item", (F.col("at") - left).alias("start"), (F.col("at") + 1 + right).alias("end"), "len")
    whole = F.col("len").isNotNull() & (F.col("end") - F.col("start") >= F.least(F.lit(width), F.col("len")))
    found = ends.groupBy("__row", "doc_id", "n_words").agg(
        F.collect_set(F.when(whole, F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set(F.when(whole, F.col("item")))).alias("items")
    )
    return found.select("__row", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns.

    ``docs`` must read the same rows in the same order each time (a stored table).
    """
    kept = docs.withColumn("__row", F.monotonically_increasing_id())
    bad = hits(docs, items, width).where("n_hit > 0").select("__row")
    return kept.join(bad, "__row", "left_anti").select(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of 10 benchmark words."""
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
