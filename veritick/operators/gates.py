"""Risk gates as row predicates: each gives struct(gate, verdict, reason); a missing input blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.functions import scalars as S
from veritick.operators import features as X


@dataclass(frozen=True)
class Limits:
    """The declared limits."""

    max_age_ms: int = 300_000
    min_obs: int = 45
    min_liquidity: float = 250_000
    min_volume: float = 100_000
    max_vol: float = 3.5
    floor: float = 0.55


def _gate(name: str, *blocks: tuple[Column, str]) -> Column:
    reason = F.lit(None).cast("string")
    for condition, why in reversed(blocks):
        reason = F.when(F.coalesce(condition, F.lit(True)), F.lit(why)).otherwise(reason)
    return F.struct(F.lit(name).alias("gate"), F.when(reason.isNull(), "ALLOWED").otherwise("BLOCKED").alias("verdict"), F.coalesce(reason, F.lit("within limits")).alias("reason"))


def freshness(observed_ms: Column, now_ms: Column, max_age_ms: int = Limits.max_age_ms) -> Column:
    age = now_ms - observed_ms
    return _gate("freshness", (age.isNull(), "missing timestamp"), (age < 0, "timestamp in the future"), (age > max_age_ms, "stale"))


def sample_size(n: Column, least: int = Limits.min_obs) -> Column:
    return _gate("sample-size", (n.isNull(), "count unknown"), (n < least, "insufficient history"))


def liquidity(liquidity_usd: Column, volume: Column, l: Limits = Limits()) -> Column:
    liq, vol = S.finite(liquidity_usd), S.finite(volume)
    return _gate("liquidity", (liq.isNull() | vol.isNull(), "unknown"), (liq < l.min_liquidity, "liquidity under floor"), (vol < l.min_volume, "volume under floor"))


def volatility(vol: Column, cap: float = Limits.max_vol) -> Column:
    v = S.finite(vol)
    return _gate("volatility", (v.isNull(), "unknown"), (v > cap, "over cap"))


def conviction(c: Column, floor: float = Limits.floor) -> Column:
    v = S.finite(c)
    return _gate("conviction", (v.isNull(), "not computable"), (v > S.TRUST_CEILING, "exceeds trust ceiling"), (v < floor, "under floor"))


def loop_budget(remaining: Column) -> Column:
    r = S.finite(remaining)
    return _gate("loop-tax", (r.isNull(), "ledger missing"), (r <= 0, "budget exhausted"))


def posture() -> Column:
    return _gate("posture")


def history(n_bars: Column) -> Column:
    return _gate("history", (n_bars.isNull() | (n_bars <= 0), "no series"))


def run(gates: Column) -> Column:
    """struct(verdict, blocked_by) of an array of gates, in evaluation order; null entries are absent gates."""
    shut = F.transform(F.filter(gates, lambda g: g.isNotNull() & (g["verdict"] == "BLOCKED")), lambda g: g["gate"])
    return F.struct(F.when(F.size(shut) > 0, "BLOCKED").otherwise("ALLOWED").alias("verdict"), shut.alias("blocked_by"))


def decide(snapshots: DataFrame, bars: DataFrame, now_ms: Column, p: X.Params = X.Params(), l: Limits = Limits(), budget: float = 12) -> DataFrame:
    """Decisions of a batch of snapshots (session, pos, asset, liquidity_usd, volume24h_usd, observed_at_ms).

    Features are taken at each asset's last bar; assets without bars block on history and abstain.
    """
    ret, z, vol = X.of_cell(p)
    latest = X.with_decision(bars, p, last=True).select("asset", (F.col("bar_idx") + 1).alias("n_bars"), vol.alias("ann_vol"), "action", "conviction")
    df = X.loop_tax(snapshots, budget).join(latest, "asset", "left")
    known = F.col("n_bars").isNotNull()
    gates = [
        posture(), loop_budget(F.col("remaining")), freshness(F.col("observed_at_ms"), now_ms, l.max_age_ms), liquidity(F.col("liquidity_usd"), F.col("volume24h_usd"), l),
        F.when(known, sample_size(F.col("n_bars"), l.min_obs)).otherwise(history(F.col("n_bars"))), F.when(known, volatility(F.col("ann_vol"), l.max_vol)),
        F.when(known & (F.col("action") == "ENTER_LONG"), conviction(F.col("conviction"), l.floor)),
    ]
    none = F.array().cast("array<string>")
    shut = F.concat(*[F.when(g["verdict"] == "BLOCKED", F.array(g["gate"])).otherwise(none) for g in gates])  # as ``run``, but of gates known one by one: no lambda a row
    df = df.withColumns({"gates": F.filter(F.array(*gates), lambda g: g.isNotNull()), "blocked_by": shut})
    return df.withColumns({"action": F.coalesce("action", F.lit("ABSTAIN")), "verdict": F.when(F.size("blocked_by") > 0, "BLOCKED").otherwise("ALLOWED")}).drop("n_bars")
