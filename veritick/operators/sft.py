"""Fine-tuning rows from replayed decisions, with evidence and provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veritick.functions import scalars as S
from veritick.functions.helpers import few_texts, number_or_name, number_texts, plain, quoted_texts, string_or_null
from veritick.operators import features as X

KEEP_EVERY = 7
PROBES = (0, 10)
GENERATOR = "veritick sft 1"
SYSTEM = "You are an advisory research analyst. Label every value, never invent numbers, abstain when evidence is missing, and keep conviction at or below 0.97."
CAVEATS = (
    "scores are heuristic transforms of a reported price feed", "the aggregate is advisory; its uniqueness is a conjecture", "conviction is capped at 0.97 and proves nothing", "paper research only, no financial advice",
)
NOTE = "history does not reach the look-backs; a value that was not measured is not stated"
STATUS = "Conjecture 1 (advisory)"


def _scored(rows: DataFrame, cells: tuple[X.Params, ...]) -> DataFrame:
    """Adds warmup, params and the scores to rows with cell_id, bar_idx, ret, z and vol."""
    named = lambda c: (("momentumLookback", c.momentum), ("zWindow", c.z_window), ("zEntry", float(c.z_entry)), ("volWindow", c.vol_window), ("positionFraction", float(c.fraction)))
    fixed = F.array(*[F.struct(F.lit(c.warmup).alias("warmup"), F.struct(*[F.lit(v).alias(k) for k, v in named(c)]).alias("params")) for c in cells])
    rows = rows.withColumn("__c", F.get(fixed, F.col("cell_id"))).withColumns({"warmup": F.col("__c.warmup"), "params": F.col("__c.params")}).drop("__c")
    return X.with_scores(rows, F.col("ret"), F.col("z"), F.col("vol"), F.col("bar_idx"), F.col("params.momentumLookback"), F.col("params.zEntry"))


KEPT = "asset string, t_ms long, bar_idx int, n long, cell_id int, ret double, z double, vol double, action string, derivation string"


def kept_rows(featured: DataFrame, cells: tuple[X.Params, ...], every: int, offsets: tuple[int, ...]) -> DataFrame:
    """``KEPT`` rows from ``X.with_features`` in partitions by asset, in order; what is carried from batch to batch is the number of HOLDs of each cell."""
    looks = sorted({k for c in cells for k in (f"ret_{c.momentum}", f"z_{c.z_window}", f"vol_{c.vol_window}")})
    bar = ["asset", "t_ms", "bar_idx", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(cells)
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bar_idx", "n"))
            look = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in looks}
            start = np.maximum.accumulate(np.where(idx == 0, np.arange(len(idx)), -1))
            for i, c in enumerate(cells):
                names = (f"ret_{c.momentum}", f"z_{c.z_window}", f"vol_{c.vol_window}")
                ret, z, vol = (look[x] for x in names)
                known = ~(np.isnan(ret) | np.isnan(z) | np.isnan(vol))
                with np.errstate(invalid="ignore"):
                    enter = known & (ret > 0) & ((z <= -c.z_entry) | (np.abs(z) < c.z_entry))
                    leave = known & ~enter & (z >= 0) & (ret <= 0)
                warm = (idx >= c.warmup) & (idx < n - 1)
                hold = warm & known & ~enter & ~leave
                seen = np.cumsum(hold)
                nth = seen - np.where(start >= 0, (seen - hold)[start], -carried[i])
                carried[i] = int(nth[-1])
                replay = warm & (enter | leave | (hold & (nth % every == 0)))
                kinds = [(replay, "deterministic-replay")] + [(~replay & ~known & (idx == max(2, c.warmup - 1 - o) - 1), "deterministic-abstain-drill") for o in offsets]
                for own, kind in kinds:
                    at = np.flatnonzero(own)
                    if len(at):
                        some = batch.take(pa.array(at))
                        action = np.where(enter, "ENTER_LONG", np.where(leave, "EXIT_LONG", np.where(known, "HOLD", "ABSTAIN")))[at]
                        made = [pa.array(np.full(len(at), i, np.int32)), *(some.column(x) for x in names), pa.array(action.tolist(), pa.string()), pa.array([kind] * len(at), pa.string())]
                        yield pa.RecordBatch.from_arrays([*(some.column(x) for x in bar), *made], [x.split(" ")[0] for x in KEPT.split(", ")])

    rows = featured.select(F.col("asset").cast("string"), F.col("t_ms").cast("long"), F.col("bar_idx").cast("int"), F.col("n").cast("long"), *looks)
    return rows.sortWithinPartitions("asset", "bar_idx").mapInArrow(work, KEPT)


def derived(bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, every: int = KEEP_EVERY, offsets: tuple[int, ...] = PROBES, placed: bool = False) -> DataFrame:
    """Rows to export with their ``derivation``, in one pass over all bars.

    Replayed decisions of the warm range, HOLD thinned to every k-th per asset and cell; and prefixes shorter than the
    warm-up that really abstain (a prefix's features are those of its last bar; one per offset). ``placed``: in ranges of
    assets, sorted by asset, cell and bar; the bars are dealt so, not the many rows made of them.
    """
    if placed:
        bars = bars.repartitionByRange(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "asset")
    rows = kept_rows(X.with_features(bars, cells, dealt=placed), cells, every, offsets)
    return _scored(rows.sortWithinPartitions("asset", "cell_id", "bar_idx") if placed else rows, cells)


def decisions(bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, every: int = KEEP_EVERY) -> DataFrame:
    """The replayed decisions among ``derived``."""
    return derived(bars, cells, every).where("derivation = 'deterministic-replay'")


def abstain_probes(bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, offsets: tuple[int, ...] = PROBES) -> DataFrame:
    """The abstentions among ``derived``."""
    return derived(bars, cells, offsets=offsets).where("derivation = 'deterministic-abstain-drill'")


def joined(*parts: str | pa.Array) -> pa.Array:
    """The texts one after the other, row by row."""
    return pc.binary_join_element_wise(*parts, "")


@F.arrow_udf(StructType([StructField("user", StringType()), StructField("said", StringType())]))
def texts(
    asset: pa.Array, iso: pa.Array, action: pa.Array, idx: pa.Array, look: pa.Array, z_window: pa.Array, z_entry: pa.Array, vol_window: pa.Array, fraction: pa.Array,
    ret: pa.Array, z: pa.Array, vol: pa.Array, momentum: pa.Array, reversion: pa.Array, sample: pa.Array, conviction: pa.Array,
) -> pa.Array:
    """What the user asks and the assistant answers, as JSON texts whose keys come in this order."""
    n, q = number_or_name, string_or_null
    caveats, standing, note = plain(list(CAVEATS)), plain({"status": STATUS, "advisory": True}), plain(NOTE)
    a, t, act = (few_texts(c, q) for c in (asset, iso, action))
    i, p1, p2, p3, p4, p5, s = (few_texts(c, n) for c in (idx, look, z_window, z_entry, vol_window, fraction, sample))
    r, zz, v, m, back, conv = (number_texts(c) for c in (ret, z, vol, momentum, reversion, conviction))
    params = joined('{"momentumLookback":', p1, ',"zWindow":', p2, ',"zEntry":', p3, ',"volWindow":', p4, ',"positionFraction":', p5, "}")
    evidence = joined('{"trailingReturn":', r, ',"zScore":', zz, ',"annualizedVol":', v, ',"nObservations":', i, "}")
    users = joined('{"task":"advisory-signal-decision","asset":', a, ',"asOfIso":', t, ',"params":', params, ',"evidence":', evidence, "}")
    parts = joined(*[x for k, y in (('{"momentum', m), ('"},"reversion', back), ('"},"sample', s)) for x in (k + '":{"value":', y, ',"label":"HEURISTIC')], '"}}')
    decided = joined('{"action":', act, ',"components":', parts, ',"conviction":', conv, f',"lambda":{standing},"caveats":{caveats}}}')
    abstained = joined('{"action":', act, f',"note":{note},"caveats":{caveats}}}')
    answers = pc.if_else(pc.equal(act, '"ABSTAIN"'), abstained, decided)
    return pa.StructArray.from_arrays([users, answers], ["user", "said"])


def messages(rows: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(asset, cell_id, bar_idx, action, conviction, messages, provenance): system, user and assistant turns.

    Evidence that is missing is written as null, so that an abstention shows what it lacks.  ``sources`` (asset, receipt,
    receipt_sha, dataset_sha) goes into the provenance; a row of an asset without a source stops the job, and so does a
    conviction above the ceiling.
    """
    ceiling = F.when(F.col("conviction") > S.TRUST_CEILING, F.raise_error(F.concat(F.lit("conviction above the ceiling: "), F.col("conviction").cast("string"))).cast("double")).otherwise(F.col("conviction"))
    rows = rows.withColumn("conviction", ceiling)
    if sources is None:
        none = F.lit(None).cast("string")
        rows = rows.withColumns({"receipt": F.concat(F.lit("series/"), F.col("asset")), "receipt_sha": none, "dataset_sha": none})
    else:
        rows = rows.join(sources.select("asset", "receipt", "receipt_sha", "dataset_sha"), "asset", "left")
        rows = rows.withColumn("receipt", F.when(F.col("dataset_sha").isNull() | F.col("receipt_sha").isNull(), F.raise_error(F.concat(F.lit("no source for "), "asset")).cast("string")).otherwise(F.col("receipt")))
    iso = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    given = [F.col(f"params.{c}") for c in ("momentumLookback", "zWindow", "zEntry", "volWindow", "positionFraction")]
    rows = rows.withColumn("__text", texts("asset", iso, "action", "bar_idx", *given, *[F.col(c).cast("double") for c in ("ret", "z", "vol", "momentum", "reversion", "sample", "conviction")]))
    turn = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    chat = F.array(turn("system", F.lit(SYSTEM)), turn("user", F.col("__text.user")), turn("assistant", F.col("__text.said")))
    source = F.struct("derivation", F.col("receipt").alias("sourceReceipt"), F.col("receipt_sha").alias("receiptSha256"), F.col("dataset_sha").alias("datasetSha256"), F.col("bar_idx").alias("barIndex"), F.lit(GENERATOR).alias("generator"))
    return rows.select("asset", "cell_id", "bar_idx", "action", "conviction", chat.alias("messages"), source.alias("provenance"))


def export(bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, sources: DataFrame | None = None) -> DataFrame:
    return messages(derived(bars, cells), sources)


@F.arrow_udf(StringType())
def line_texts(roles: pa.Array, contents: pa.Array, idx: pa.Array, dataset: pa.Array, derivation: pa.Array, generator: pa.Array, sha: pa.Array, receipt: pa.Array) -> pa.Array:
    """Canonical texts of rows: keys in order."""
    q = string_or_null
    d, kind, made, s, r = (few_texts(c, q) for c in (dataset, derivation, generator, sha, receipt))
    turns = joined('{"content":', quoted_texts(contents.flatten()), ',"role":', few_texts(roles.flatten(), q), "}")
    ends = np.concatenate([[0], np.cumsum(contents.value_lengths().to_numpy())]).astype(np.int32)
    chat = pc.binary_join(pa.ListArray.from_arrays(ends, turns), ",")
    source = joined('{"barIndex":', few_texts(idx, number_or_name), ',"datasetSha256":', d, ',"derivation":', kind, ',"generator":', made, ',"receiptSha256":', s, ',"sourceReceipt":', r, "}")
    return joined('{"messages":[', chat, '],"provenance":', source, "}")


def jsonl(rows: DataFrame) -> DataFrame:
    """Canonical text per row, with its place."""
    made = [F.col("provenance")[c] for c in ("barIndex", "datasetSha256", "derivation", "generator", "receiptSha256", "sourceReceipt")]
    return rows.select("asset", "cell_id", "bar_idx", line_texts(F.col("messages")["role"], F.col("messages")["content"], *made).alias("value"))


def manifest(rows: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Rows per asset and action with their source, and how many exceed the trust ceiling (must be none).

    ``rows`` are those of ``export``, or of ``derived`` where only counts are asked for.  With ``bars``, their number per asset.
    """
    over = F.count_if(F.col("conviction") > S.TRUST_CEILING)
    names = ("ENTER_LONG", "EXIT_LONG", "HOLD", "ABSTAIN")
    counts: list[Column] = [F.count_if(F.col("action") == a).alias(a.lower()) for a in names]
    source = [F.max("provenance.sourceReceipt").alias("receipt"), F.max("provenance.receiptSha256").alias("receipt_sha"), F.max("provenance.datasetSha256").alias("dataset_sha")] if "provenance" in rows.columns else []
    out = rows.groupBy("asset").agg(F.count("*").alias("rows"), *counts, over.alias("over_ceiling"), *source)
    return out if bars is None else out.join(bars.groupBy("asset").agg(F.count("*").alias("bars")), "asset", "left")
