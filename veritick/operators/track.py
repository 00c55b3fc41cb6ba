"""Scoring past decisions by what prices did next: forward as-of joins by union and window, never a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritick.operators.ordered import exact_median
from veritick.session import cut
from veritick.sources.ingest import DAY_MS

HORIZONS = (1, 7)
NOWHERE = -(1 << 40)  # the stretch of rows without a time


def split_verified(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose checks passed, and the others with their reasons."""
    ok = F.coalesce(F.col("sig_ok"), F.lit(False))
    return receipts.where(ok), receipts.where(~ok).withColumn("fails", F.coalesce("fails", F.array(F.lit("verification failed"))))


def asof_forward(left: DataFrame, bars: DataFrame, at: str, into: str, bucket_ms: int = 32 * DAY_MS, asks: DataFrame | None = None, known: str | None = None) -> DataFrame:
    """Adds ``into`` = struct(t_ms, close) of the first bar of the asset at or after the time in column ``at``.

    Both sides meet by asset and stretch of time, in one sort backwards in time (bars first on ties) and one scan that
    carries the last bar seen.  A row without a bar in its own stretch takes the first bar of the next stretch that has
    one; those are one per asset and stretch.  So the cost is linear and an asset with very many rows is spread.  A null
    time or asset finds nothing; bars without a time are not looked at. ``left`` is read twice; ``asks``, the asset and ``at`` of
    its rows from a shorter way, spares the second time. ``known`` names a further column: whether the asset has any bar, timed or not.
    """
    stretch = lambda t: F.coalesce(F.floor(t / bucket_ms), F.lit(NOWHERE))
    keep, bar = F.struct(*left.columns), F.struct(F.col("t_ms").cast("bigint").alias("t_ms"), F.col("close").cast("double").alias("close"))
    ticks = bars.where("t_ms is not null and asset is not null").select("asset", F.col("t_ms").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(keep).schema[0].dataType).alias("__row"), bar.alias("__bar"))
    rows = left.select("asset", F.col(at).alias("__t"), F.lit(1).alias("__side"), keep.alias("__row"), F.lit(None).cast("struct<t_ms:bigint,close:double>").alias("__bar"))
    ticks, rows = ticks.withColumn("__b", stretch(F.col("__t"))), rows.withColumn("__b", stretch(F.col("__t")))
    w = Window.partitionBy("asset", "__b").orderBy(F.col("__t").desc_nulls_last(), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(ticks).withColumn("__own", F.last("__bar", ignorenulls=True).over(w)).where("__side = 1")
    none = F.lit(None).cast("struct<t_ms:bigint,close:double>").alias("__first")
    firsts = ticks.groupBy("asset", "__b").agg(F.min_by("__bar", "__t").alias("__first"), F.lit(True).alias("__known"))
    asked = (left if asks is None else asks).select("asset", stretch(F.col(at)).alias("__b"), none, F.lit(False).alias("__known")).distinct()
    untimed = bars.where("t_ms is null and asset is not null").select("asset", F.lit(NOWHERE).alias("__b"), none, F.lit(True).alias("__known"))
    each = firsts.unionByName(asked).unionByName(untimed).groupBy("asset", "__b").agg(F.max("__first").alias("__first"), F.max("__known").alias("__known"))
    later = F.last("__first", ignorenulls=True).over(Window.partitionBy("asset").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("asset", "__b", later.alias("__later"), F.max("__known").over(Window.partitionBy("asset")).alias("__known"))
    found = met.join(each, ["asset", "__b"], "left")
    has = [] if known is None else [F.coalesce("__known", F.lit(False)).alias(known)]
    return found.select("__row.*", F.when(F.col("__t").isNotNull(), F.coalesce("__own", "__later")).alias(into), *has)


def score_signals(signals: DataFrame, bars: DataFrame, now_ms: Column, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(file, asset, signal_ms, ...) -> one row per signal and horizon: MEASURED with its return, or UNAVAILABLE and why."""
    dues = lambda df: df.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("due_ms", F.col("signal_ms") + F.col("horizon") * DAY_MS)
    base = asof_forward(signals, bars, "signal_ms", "baseline")
    both = asof_forward(dues(base), bars, "due_ms", "outcome", asks=dues(signals), known="has_series")
    open_, due = F.col("baseline").isNull(), F.col("due_ms")
    label = F.when(F.col("baseline").isNotNull() & F.col("outcome").isNotNull(), "MEASURED").otherwise("UNAVAILABLE")
    note = (
        F.when(~F.col("has_series"), "no history")
        .when(F.col("signal_ms").isNull(), "unparseable time")
        .when(open_ & (now_ms < F.col("signal_ms") + DAY_MS), "pending")
        .when(open_, "gap")
        .when(F.col("outcome").isNull() & (now_ms < due + DAY_MS), "pending")
        .when(F.col("outcome").isNull(), "gap")
    )
    ret = F.when(label == "MEASURED", F.col("outcome.close") / F.col("baseline.close") - 1)
    return both.withColumns({"label": label, "note": note, "forward_return": ret}).drop("has_series")


def track_aggregates(scored: DataFrame, weak_n: int = 10, exact: bool = True) -> DataFrame:
    """Per horizon: realised, pending and missing outcomes, wins, hit rate, mean and median return.

    The exact median sorts the returns by ranges; ``exact=False`` takes a mergeable sketch.
    """
    ret, done = F.col("forward_return"), F.col("label") == "MEASURED"
    n, wins = F.count_if(done), F.count_if(ret > 0)
    scored = cut(scored.select("horizon", "label", "note", "forward_return")) if exact else scored  # read twice
    out = scored.groupBy("horizon").agg(
        n.alias("n_realized"), F.count_if(F.col("note") == "pending").alias("n_pending"), F.count_if(~done & (F.col("note") != "pending")).alias("n_gaps"), wins.alias("wins"),
        F.when(n > 0, wins / n).alias("hit_rate"), F.avg(ret).alias("mean_return"), (n < weak_n).alias("weak_evidence"), *([] if exact else [F.percentile_approx(ret, 0.5).alias("median_return")]),
    )
    return out.join(exact_median(scored, "horizon", "forward_return").withColumnRenamed("median", "median_return"), "horizon", "left") if exact else out


def track_population(decisions: DataFrame) -> DataFrame:
    """Totals of all decisions: scored are ALLOWED entries, blocked those of verdict BLOCKED."""
    scored = (F.col("verdict") == "ALLOWED") & (F.col("action") == "ENTER_LONG")
    return decisions.agg(F.count("*").alias("total"), F.count_if(scored).alias("scored"), F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"))


def no_calls_by_gate(decisions: DataFrame) -> DataFrame:
    return decisions.where("verdict = 'BLOCKED'").select(F.explode("blocked_by").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


def refusal_census(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per run: totals (any verdict but ALLOWED is blocked); counts by action; counts by gate."""
    totals = decisions.groupBy("run_dir").agg(F.count("*").alias("decisions"), F.count_if(F.col("verdict") == "ALLOWED").alias("allowed"), F.count_if(~F.col("verdict").eqNullSafe("ALLOWED")).alias("blocked"))
    by_action = decisions.groupBy("run_dir", "action").agg(F.count("*").alias("n"))
    by_gate = decisions.select("run_dir", F.explode("blocked_by").alias("gate")).groupBy("run_dir", "gate").agg(F.count("*").alias("n"))
    return totals, by_action, by_gate


def cross_run_refusals(decisions: DataFrame) -> DataFrame:
    """Refusals per run and gate with subtotals per run and in total."""
    rows = decisions.select("run_dir", F.explode("blocked_by").alias("gate"))
    return rows.rollup("run_dir", "gate").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def session_summary(decided: DataFrame, session: str = "session") -> DataFrame:
    """Per session: its decisions in order, and the budget spent and left."""
    line = F.concat_ws(":", "asset", "action", "verdict", F.array_join("blocked_by", "+"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return decided.groupBy(session).agg(F.count("*").alias("n"), ordered.alias("decisions"), (F.max("spent") + 1).alias("spent"), F.min("remaining").alias("remaining"))
