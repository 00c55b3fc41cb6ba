"""The registered queries of the library, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritick.plans import feature_plans, ledger_plans, merkle_plans, replay_plans, scalar_plans

FLAGSHIP = "walk_forward"
MODULES = (scalar_plans, feature_plans, replay_plans, ledger_plans, merkle_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLE_SQL
    return found
