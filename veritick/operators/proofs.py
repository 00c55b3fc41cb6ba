"""Transparency-log checks: proofs, split views, coverage and verdicts over tables of checkpoints and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritick.functions.helpers import check_consistency, check_inclusion
from veritick.operators.ordered import with_previous


def audit_inclusion(proofs: DataFrame) -> DataFrame:
    """Adds ``problem`` (null if the path leads to the root) to (leaf_index, tree_size, leaf_hash, path, root_hex)."""
    return proofs.withColumn("problem", check_inclusion("leaf_index", "tree_size", "leaf_hash", "path", "root_hex"))


def audit_consistency(proofs: DataFrame) -> DataFrame:
    """Adds ``problem`` to (first_size, second_size, first_root, second_root, proof)."""
    return proofs.withColumn("problem", check_consistency("first_size", "second_size", "first_root", "second_root", "proof"))


def union_checkpoints(engine: DataFrame, observed: DataFrame) -> DataFrame:
    """Checkpoints of the engine and both of every observation, in that order of ``pos``."""
    cols = ("origin", "tree_size", "root_hex")
    side = lambda name, source, k: observed.select(*[F.col(f"{name}.{c}").alias(c) for c in cols], F.lit(source).alias("source"), F.struct(F.lit(k).alias("set"), F.col("pos").alias("pos")).alias("pos"))
    own = engine.select(*cols, "source", F.struct(F.lit(0).alias("set"), F.col("pos").alias("pos")).alias("pos"))
    return own.unionByName(side("engine", "observer-engine", 1)).unionByName(side("live", "gossip-observation", 2))


def split_views(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints whose root conflicts with the first one seen of the same origin and size, with both sources.

    The first seen root of an (origin, size) comes from a partially aggregated minimum, not from a sorted window, so a
    size that is seen very often does not meet in one task.
    """
    first = checkpoints.groupBy("origin", "tree_size").agg(F.min_by(F.struct("root_hex", "source"), "pos").alias("seen"), F.min("root_hex").alias("lo"), F.max("root_hex").alias("hi"))
    torn = first.where("lo <> hi").select("origin", "tree_size", F.col("seen.root_hex").alias("first_root"), F.col("seen.source").alias("first_source"))
    return checkpoints.join(torn, ["origin", "tree_size"]).where("root_hex <> first_root").select("origin", "tree_size", "first_root", "root_hex", "first_source", "source", "pos")


def distinct_sizes(checkpoints: DataFrame) -> DataFrame:
    """The first observation of every (origin, size)."""
    return checkpoints.groupBy("origin", "tree_size").agg(F.min_by("root_hex", "pos").alias("root_hex"))


def edges(checkpoints: DataFrame) -> DataFrame:
    """Adjacent sizes per origin, ascending; the history of one log is spread over ranges of its sizes."""
    step = with_previous(distinct_sizes(checkpoints), "origin", "tree_size", ["tree_size", "root_hex"], "__prev").where("__prev is not null")
    return step.select("origin", F.col("__prev.tree_size").alias("prev_size"), F.col("tree_size").alias("next_size"), F.col("__prev.root_hex").alias("prev_root"), F.col("root_hex").alias("next_root"))


def consistency_targets(checkpoints: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges without a proof yet."""
    return edges(checkpoints).join(covered.select("origin", "prev_size", "next_size"), ["origin", "prev_size", "next_size"], "left_anti")


def edge_coverage(checkpoints: DataFrame, proven: DataFrame) -> DataFrame:
    """Per origin: edges, and how many are proven."""
    done = proven.select("origin", "prev_size", "next_size").distinct().withColumn("ok", F.lit(1))
    return edges(checkpoints).join(done, ["origin", "prev_size", "next_size"], "left").groupBy("origin").agg(F.count("*").alias("edges"), F.count("ok").alias("proven"))


def audit_history(checkpoints: DataFrame, proven: DataFrame) -> DataFrame:
    """(origin, at, problem) of what a log showed over time: sizes with several roots, and steps without a proof."""
    torn = split_views(checkpoints).select("origin", F.col("tree_size").cast("string").alias("at")).distinct().withColumn("problem", F.lit("split view"))
    bare = consistency_targets(checkpoints, proven).select("origin", F.concat_ws("-", "prev_size", "next_size").alias("at"), F.lit("step without a proof").alias("problem"))
    return torn.unionByName(bare)


def consistency_endpoints(receipts: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Adds ``problem``: both witness receipts of a consistency receipt exist and agree in sha, origin, size and root."""
    out = receipts
    for side in ("prev", "next"):
        w = witnesses.select(F.col("file").alias(f"{side}_file"), F.struct("sha256", "origin", "tree_size", "root_hex").alias(f"__{side}"))
        out = out.join(w, f"{side}_file", "left")
    reason = F.lit(None).cast("string")
    for side in ("next", "prev"):
        w = F.col(f"__{side}")
        reason = (
            F.when(w.isNull(), f"{side} receipt absent").when(w["sha256"] != F.col(f"{side}_sha"), f"{side} receipt bytes differ")
            .when((w["origin"] != F.col("origin")) | (w["tree_size"] != F.col(f"{side}_size")) | (w["root_hex"] != F.col(f"{side}_root")), f"{side} checkpoint differs").otherwise(reason)
        )
    return out.withColumn("problem", reason).drop("__prev", "__next")


def bind_observations(observations: DataFrame, witnesses: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds ``reason``: why an observation does not bind to the local witness and chain files; null if it does."""
    w = witnesses.select(F.col("file").alias("witness_file"), F.col("sha256").alias("__w"))
    c = chains.select(F.col("file").alias("chain_file"), F.col("sha256").alias("__c"))
    df = observations.join(w, "witness_file", "left").join(c, "chain_file", "left")
    reason = (
        F.when(F.col("__w").isNull(), "witness absent").when(F.col("__w") != F.col("witness_sha"), "witness differs").when(F.col("__c").isNull(), "chain absent")
        .when(F.col("__c") != F.col("chain_sha"), "chain differs").when(~F.coalesce("chain_binding_verified", F.lit(False)) & F.col("verdict").isin("PREFIX_OK", "ROOTS_EQUAL"), "good verdict on a failed binding")
    )
    return df.withColumn("reason", reason).drop("__w", "__c")


def gossip_verdict(observations: DataFrame) -> DataFrame:
    """Adds ``expected`` and ``agrees`` to (engine, live, proof, verdict, chain_binding_verified)."""
    e, v = F.col("engine"), F.col("live")
    replay = check_consistency(e["tree_size"], v["tree_size"], e["root_hex"], v["root_hex"], F.col("proof"))
    df = observations.withColumn("__problem", replay)
    expected = (
        F.when(e["origin"] != v["origin"], "SHARD_ROTATED").when(v["tree_size"] < e["tree_size"], "LOG_REGRESSED")
        .when(v["tree_size"] == e["tree_size"], F.when(v["root_hex"] == e["root_hex"], "ROOTS_EQUAL").otherwise("SPLIT_VIEW"))
        .when(F.col("__problem").isNull(), "PREFIX_OK").otherwise("SPLIT_VIEW")
    )
    excused = (F.col("verdict") == "LEDGER_BINDING_MISMATCH") & ~F.coalesce("chain_binding_verified", F.lit(True)) & expected.isin("PREFIX_OK", "ROOTS_EQUAL")
    return df.withColumns({"expected": expected, "agrees": F.coalesce((F.col("verdict") == expected) | excused, F.lit(False))}).drop("__problem")


def verdict_census(observations: DataFrame) -> DataFrame:
    """Observations per verdict, and the newest of each."""
    return observations.groupBy("verdict").agg(F.count("*").alias("n"), F.max_by("file", F.struct("observed_at", "file")).alias("newest"))


def audit_gossip_counts(gossip: DataFrame, observations: DataFrame) -> DataFrame:
    """Per ledger: the newest gossip receipt's total against the observations there; ``ok`` false without any receipt."""
    stated = gossip.groupBy("ledger").agg(F.max_by("archived_total", F.struct("seq", "ms")).alias("stated"))
    there = observations.groupBy("ledger").agg(F.count("*").alias("present"))
    both = there.join(stated, "ledger", "full").withColumn("present", F.coalesce("present", F.lit(0)))
    return both.withColumn("ok", F.coalesce(F.col("stated") == F.col("present"), F.col("present") == 0))


def audit_witness(witnesses: DataFrame, chains: DataFrame) -> DataFrame:
    """(file, problem) of witness receipts against chain files and their own proofs.

    Witnesses: file, run_dir, chain_file, chain_sha, data_sha, proof(leaf_index, tree_size, leaf_hash, path, root_hex),
    checkpoint(tree_size, root_hex). A receipt without proof is checked for its chain file and data hash alone.
    """
    c = chains.select("run_dir", F.col("file").alias("chain_file"), F.col("sha256").alias("__c"))
    p, k = F.col("proof"), F.col("checkpoint")
    df = witnesses.join(c, ["run_dir", "chain_file"], "left")
    df = df.withColumn("__path", F.when(p.isNotNull(), check_inclusion(p["leaf_index"], p["tree_size"], p["leaf_hash"], p["path"], p["root_hex"])))
    checks = {
        "chain file absent": F.col("__c").isNull(), "chain file changed": F.col("__c").isNotNull() & (F.col("__c") != F.col("chain_sha")), "log entry is of other bytes": F.col("data_sha") != F.col("chain_sha"),
        "checkpoint differs from proof": p.isNotNull() & ~(k["tree_size"].eqNullSafe(p["tree_size"]) & k["root_hex"].eqNullSafe(p["root_hex"])), "inclusion": p.isNotNull() & F.col("__path").isNotNull(),
    }
    from veritick.operators.ledger import problems

    return problems(df, ["file"], **checks)


def divergence_report(observations: DataFrame, engine: DataFrame) -> DataFrame:
    """Per ledger: CLEAN, DIVERGENCE or NO_DATA, with the numbers of observations, bad verdicts and conflicts.

    ``observations`` has ledger, pos, engine, live, proof, verdict, chain_binding_verified; ``engine`` has ledger, pos,
    origin, tree_size, root_hex, source.
    """
    judged = gossip_verdict(observations)
    bad = ~F.col("verdict").isin("PREFIX_OK", "ROOTS_EQUAL", "SHARD_ROTATED") | ~F.col("agrees")
    per = judged.groupBy("ledger").agg(F.count("*").alias("observations"), F.count_if(bad).alias("alarms"))
    key = lambda df: df.withColumn("origin", F.concat_ws("\u0001", "ledger", "origin"))
    sides = observations.withColumns({s: F.col(s).withField("origin", F.concat_ws("\u0001", F.col("ledger"), F.col(f"{s}.origin"))) for s in ("engine", "live")})
    torn = split_views(union_checkpoints(key(engine), sides)).groupBy(F.split_part("origin", F.lit("\u0001"), F.lit(1)).alias("ledger")).agg(F.count("*").alias("conflicts"))
    every = engine.select("ledger").union(observations.select("ledger")).distinct()
    out = every.join(per, "ledger", "left").join(torn, "ledger", "left").na.fill(0)
    status = F.when(F.col("observations") == 0, "NO_DATA").when((F.col("alarms") > 0) | (F.col("conflicts") > 0), "DIVERGENCE").otherwise("CLEAN")
    return out.withColumn("status", status)
