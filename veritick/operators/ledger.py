"""Audits of a ledger: chain of links, sealed files, coverage and what is still to be witnessed.

Chains are followed by equi-joins on ``seq = prev + 1``, never by one ordered pass over a ledger, so that a single long
ledger is spread over all tasks as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.operators.ordered import running
from veritick.session import cut


def problems(df: DataFrame, keys: list[str], **checks: Column) -> DataFrame:
    """One row per failed check: the keys and the problem's name. A null condition counts as failed."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
    return df.select(*keys, F.explode(found).alias("problem"))


def sealed_files(links: DataFrame) -> DataFrame:
    """(ledger, seq, dir, name, sha256) of all that links cover; a sealed dir without files has a null name."""
    dirs = links.select("ledger", "seq", F.explode("covers").alias("c"))
    return dirs.select("ledger", "seq", F.col("c.dir").alias("dir"), F.explode_outer("c.files").alias("f")).select("ledger", "seq", "dir", "f.name", "f.sha256")


def unsealed_dirs(files: DataFrame, links: DataFrame) -> DataFrame:
    """Run dirs that no link covers."""
    sealed = links.select("ledger", F.explode("covers").alias("c")).select("ledger", F.col("c.dir").alias("run_dir"))
    return files.select("ledger", "run_dir").distinct().join(sealed, ["ledger", "run_dir"], "left_anti")


def file_set_diff(files: DataFrame, links: DataFrame) -> DataFrame:
    """Per (ledger, dir, name) of sealed dirs: on disk only, sealed only, or rewritten. Equal files have no row."""
    sealed = sealed_files(links).where("name is not null").select("ledger", F.col("dir").alias("run_dir"), "name", F.col("sha256").alias("sealed_sha"))
    dirs = links.select("ledger", F.explode("covers").alias("c")).select("ledger", F.col("c.dir").alias("run_dir")).distinct()
    here = files.join(dirs, ["ledger", "run_dir"], "left_semi")
    both = here.join(sealed, ["ledger", "run_dir", "name"], "full")
    what = F.when(F.col("sealed_sha").isNull(), "not sealed").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("sealed_sha"), "rewritten")
    return both.withColumn("difference", what).where("difference is not null")


def latest_head(links: DataFrame) -> DataFrame:
    """The link of greatest seq per ledger (a null seq counts as 0), with ``readable`` false where it has none."""
    row = F.struct(*links.columns)
    best = links.groupBy("ledger").agg(F.max_by(row, F.coalesce("seq", F.lit(0))).alias("l"))
    return best.select("l.*").withColumn("readable", F.col("seq").isNotNull())


def audit_chain(links: DataFrame, files: DataFrame) -> DataFrame:
    """(ledger, at, problem): continuity, back pointers, seals and sealed content. A sound ledger has no row."""
    before = links.select("ledger", (F.col("seq") + 1).alias("seq"), F.col("run_dir").alias("p_dir"), F.col("file").alias("p_file"), F.col("sha256").alias("p_sha"))
    both = links.join(before, ["ledger", "seq"], "left")
    first, linked = F.col("seq") == 1, F.col("p_sha").isNotNull()
    prev = F.col("prev")
    differs = lambda a, b: ~F.col(f"prev.{a}").eqNullSafe(F.col(b))
    pointers = problems(
        both, ["ledger", F.col("seq").cast("string").alias("at")], **{
            "seq not contiguous from 1": F.col("seq").isNull() | ~(first | linked), "first link has a predecessor": first & prev.isNotNull(),
            "previous sha differs": ~first & linked & differs("sha256", "p_sha"), "previous file differs": ~first & linked & (differs("file", "p_file") | differs("run_dir", "p_dir")),
        },
    )
    again = links.groupBy("ledger", "seq").agg(F.count("*").alias("n")).where("n > 1").select("ledger", F.col("seq").cast("string").alias("at"), F.lit("seq repeated").alias("problem"))
    in_dir = links.groupBy("ledger", "run_dir").agg(F.count("*").alias("n")).where("n > 1").select("ledger", F.col("run_dir").alias("at"), F.lit("several links in a dir").alias("problem"))
    seals = links.select("ledger", F.explode("covers.dir").alias("at"))
    twice = seals.groupBy("ledger", "at").agg(F.count("*").alias("n")).where("n > 1").select("ledger", "at", F.lit("dir sealed more than once").alias("problem"))
    there = files.select("ledger", F.col("run_dir").alias("at")).distinct()
    gone = seals.distinct().join(there, ["ledger", "at"], "left_anti").select("ledger", "at", F.lit("sealed dir missing").alias("problem"))
    open_ = there.join(seals, ["ledger", "at"], "left_anti").select("ledger", "at", F.lit("dir not sealed").alias("problem"))
    content = file_set_diff(files, links).select("ledger", F.concat_ws("/", "run_dir", "name").alias("at"), F.concat(F.lit("file "), F.col("difference")).alias("problem"))
    out = pointers
    for more in (again, in_dir, twice, gone, open_, content):
        out = out.unionByName(more)
    return out


GENESIS, MISSING, LOOP = range(3)
ENDS = ("genesis", "missing", "loop")


def chain_reach(links: DataFrame) -> DataFrame:
    """(ledger, sha256, before, end) of every link, from (ledger, sha256, prev_sha): where the pointers back lead.

    end: ``genesis`` (a link without a pointer), ``missing`` (a pointer to what is not there) or ``loop``; before: the links
    passed on the way, null for a loop. Pointer doubling: each round, what a link points to is replaced by what that one points
    to, so that a chain of n links takes log n joins and is never walked; rows that have arrived leave the joins. Links go by
    number through these joins: hashes meet once, for the pointers, and are given back at the end.
    """
    steps = cut(links.groupBy("ledger", "sha256").agg(F.min("prev_sha").alias("to")).where("sha256 is not null")).withColumn("id", F.monotonically_increasing_id())
    longest = steps.groupBy("ledger").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    there = steps.select("ledger", F.col("sha256").alias("to"), F.col("id").alias("next"))
    end = F.when(F.col("to").isNull(), GENESIS).when(F.col("next").isNull(), MISSING).cast("byte")
    now = cut(steps.join(there, ["ledger", "to"], "left").select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), end.alias("end")))
    done, moving = now.where("end is not null"), now.where("end is null")
    for _ in range(longest.bit_length() + 1):
        if moving.isEmpty():
            break
        there = now.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("hops").alias("__hops"), F.col("end").alias("__end"))
        moved = cut(moving.drop("end").join(there, "next").select("id", F.col("__next").alias("next"), (F.col("hops") + F.col("__hops")).alias("hops"), F.col("__end").alias("end")))
        done, moving = done.unionByName(moved.where("end is not null")), moved.where("end is null")
        now = done.unionByName(moving)
    lost = moving.select("id", F.lit(None).cast("long").alias("hops"), F.lit(LOOP).cast("byte").alias("end"))
    found = done.select("id", "hops", "end").unionByName(lost)
    return steps.join(found, "id").select("ledger", "sha256", F.col("hops").alias("before"), F.element_at(F.array(*map(F.lit, ENDS)), F.col("end") + 1).alias("end"))


def chain_shape(links: DataFrame) -> DataFrame:
    """Per ledger: links, sound (links of the one chain from genesis before any fork), beyond (on it, from the first fork on), cut_off, looped.

    Links are sound up to the first place where several reach genesis over as many links: from there on it is open which
    of the branches is the ledger. ``cut_off`` links have lost what comes before them; they are no branch.
    """
    reach = chain_reach(links)
    per = reach.where("end = 'genesis'").groupBy("ledger", "before").agg(F.count("*").alias("n"))
    sound = per.groupBy("ledger").agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("before"))), F.max("before") + 1).alias("sound"))
    all_ = reach.groupBy("ledger").agg(F.count("*").alias("links"), *[F.count_if(F.col("end") == e).alias(c) for e, c in (("genesis", "reached"), ("missing", "cut_off"), ("loop", "looped"))])
    out = all_.join(sound, "ledger", "left").withColumn("sound", F.coalesce("sound", F.lit(0).cast("long")))
    return out.select("ledger", "links", "sound", (F.col("reached") - F.col("sound")).alias("beyond"), "cut_off", "looped")


def build_chain_link(files: DataFrame, links: DataFrame) -> DataFrame:
    """The next link of each ledger with unsealed dirs: seq, prev and covers; ``error`` where the head has no seq."""
    new = files.join(unsealed_dirs(files, links), ["ledger", "run_dir"], "left_semi")
    per_dir = new.groupBy("ledger", "run_dir").agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("files"))
    covers = per_dir.groupBy("ledger").agg(F.array_sort(F.collect_list(F.struct(F.col("run_dir").alias("dir"), "files"))).alias("covers"))
    head = latest_head(links).select("ledger", F.col("seq").alias("head_seq"), "readable", F.struct("run_dir", "file", "sha256").alias("prev"))
    out = covers.join(head, "ledger", "left")
    fork = F.col("readable").isNotNull() & ~F.col("readable")
    return out.select("ledger", F.when(~fork | fork.isNull(), F.coalesce(F.col("head_seq"), F.lit(0)) + 1).alias("seq"), "prev", "covers", F.when(fork, "previous seq unreadable").alias("error"))


def chain_coverage(links: DataFrame) -> DataFrame:
    """Sealed dirs and files per link."""
    f = sealed_files(links)
    return f.groupBy("ledger", "seq").agg(F.count_distinct("dir").alias("dirs"), F.count("name").alias("files"))


def skipped_run_dirs(books: DataFrame, dirs: DataFrame) -> DataFrame:
    """(ledger, run_dir, after_seq): dirs strictly between consecutive books; after_seq null: before the first one.

    Each dir takes the last book dir before it, by one segmented scan over both; no theta join, and no ledger in one task.
    Dirs after the last book are not skipped yet.
    """
    rows = dirs.select("ledger", "run_dir").distinct().join(books.select("ledger", "run_dir", "seq"), ["ledger", "run_dir"], "left")
    rows = running(rows, "ledger", "run_dir", after_seq=("last", F.col("seq")))
    newest = books.where("seq is not null").groupBy("ledger").agg(F.max("run_dir").alias("__newest"))
    return rows.join(newest, "ledger").where("seq is null and run_dir < __newest").select("ledger", "run_dir", "after_seq")


def witness_targets(links: DataFrame, receipts: DataFrame, every: bool = False) -> DataFrame:
    """Links to witness: all without a proof-bearing receipt, or only the head if it has no receipt at all."""
    if every:
        return links.join(receipts.where("has_proof").select("ledger", "seq"), ["ledger", "seq"], "left_anti")
    return latest_head(links).drop("readable").join(receipts.select("ledger", "seq"), ["ledger", "seq"], "left_anti")


def timestamp_targets(witnesses: DataFrame, stamps: DataFrame, every: bool = False) -> DataFrame:
    """The newest witness receipt per seq (head only by default) that has no timestamp receipt."""
    newest = witnesses.groupBy("ledger", "seq").agg(F.max("file").alias("file"))
    if not every:
        newest = newest.join(newest.groupBy("ledger").agg(F.max("seq").alias("seq")), ["ledger", "seq"], "left_semi")
    return newest.join(stamps.select("ledger", "seq"), ["ledger", "seq"], "left_anti")


def anchor_coverage(links: DataFrame, witnesses: DataFrame, stamps: DataFrame) -> DataFrame:
    """Per ledger: links, and how many of them are anchored, proven and timestamped."""
    flag = lambda df, name: df.select("ledger", "seq").distinct().withColumn(name, F.lit(1))
    rows = links.select("ledger", "seq").distinct()
    for df, name in ((witnesses, "anchored"), (witnesses.where("has_proof"), "proven"), (stamps, "timestamped")):
        rows = rows.join(flag(df, name), ["ledger", "seq"], "left")
    return rows.groupBy("ledger").agg(F.count("*").alias("links"), *[F.count(c).alias(c) for c in ("anchored", "proven", "timestamped")])


def new_observations(remote: DataFrame, archived: DataFrame) -> DataFrame:
    """Remote names not yet archived."""
    return remote.select("name").distinct().join(archived.select("name"), "name", "left_anti")


def recompute_diff(signed: DataFrame, again: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Every key with its status (nulls equal nulls): OK, UNSIGNED, or FAIL with the first differing field, or ``missing``.

    A signed result that was not computed again fails; whether one need not be is for the caller to say (``audit_recompute``).
    """
    a = signed.select(*keys, F.struct(*fields).alias("a"))
    b = again.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    gone = F.col("b").isNull()
    status = F.when(gone, "FAIL").when(F.col("a").isNull(), "UNSIGNED").when(F.size(unlike) > 0, "FAIL").otherwise("OK")
    return both.select(*keys, status.alias("status"), F.when(gone, "missing").when(status == "FAIL", F.get(unlike, F.lit(0))).alias("first_difference"))


RESULTS = ("final_equity", "total_return", "max_drawdown", "n_trades", "n_round_trips", "win_rate", "open_at_end")


def audit_recompute(receipts: DataFrame, archive: DataFrame, signed: DataFrame, again: DataFrame, folder: str = "data/datasets") -> DataFrame:
    """(path, status, reason) per backtest receipt; only one that declares no archive is skipped, all else fails closed.

    Receipts: path, asset, archive_path, dataset_sha, dataset_n, n_cells, share, start_usd, fee_bps, slippage_bps.  Archive:
    path, content (JSON rows of tMs and close).  ``signed`` has path, cell_id, window_name and ``RESULTS``; ``again`` has
    asset, cell_id, window_name and ``RESULTS``, computed from the archived series.
    """
    points = F.from_json(F.col("content").cast("string"), "array<struct<tMs:double,close:double>>")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    sound = (F.size(points) >= 2) & F.forall(points, lambda p: p.isNotNull() & number(p["tMs"]) & number(p["close"]) & (p["close"] > 0))
    there = archive.select(F.col("path").alias("archive_path"), F.sha2(F.col("content").cast("binary"), 256).alias("__sha"), F.coalesce(sound, F.lit(False)).alias("__sound"), F.size(points).alias("__n"))
    pairs = recompute_diff(signed.join(receipts.select("path", "asset"), "path").select("path", "cell_id", "window_name", *RESULTS), receipts.select("path", "asset").join(again, "asset").select("path", "cell_id", "window_name", *RESULTS), ["path", "cell_id", "window_name"], list(RESULTS))
    place = F.struct("cell_id", "window_name")
    unlike = pairs.where("status <> 'OK'").groupBy("path").agg(F.min_by(F.coalesce("first_difference", F.lit("not signed")), place).alias("__unlike"))
    compared = pairs.groupBy("path").agg(F.count("*").alias("__compared"))
    df = receipts.join(there, "archive_path", "left").join(unlike, "path", "left").join(compared, "path", "left")
    hex64 = F.coalesce(F.col("dataset_sha").rlike("^[0-9a-f]{64}$"), F.lit(False))
    rules = (
        ("dataset hash is not 64 hex digits", ~hex64), ("archive path is not the canonical one", F.col("archive_path") != F.concat(F.lit(f"{folder}/"), "dataset_sha", F.lit(".json"))), ("archive missing", F.col("__sha").isNull()),
        ("archive bytes differ", F.col("__sha") != F.col("dataset_sha")), ("archive rows invalid", ~F.col("__sound")), ("row count differs", ~F.col("dataset_n").eqNullSafe(F.col("__n"))),
        ("no grid", ~F.coalesce(F.col("n_cells") > 0, F.lit(False))), ("no split", ~F.coalesce((F.col("share") > 0) & (F.col("share") < 1), F.lit(False))), ("no starting cash", ~F.coalesce((F.col("start_usd") > 0) & number(F.col("start_usd")), F.lit(False))),
        ("no costs", ~(number(F.col("fee_bps")) & number(F.col("slippage_bps")))), ("results incomplete", ~F.coalesce(F.col("__compared") == 2 * F.col("n_cells"), F.lit(False))),
    )
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules], F.concat(F.lit("recomputed result differs: "), F.col("__unlike")))
    status = F.when(F.col("archive_path").isNull(), "SKIP").when(reason.isNull(), "OK").otherwise("FAIL")
    return df.select("path", status.alias("status"), F.when(F.col("archive_path").isNull(), F.lit("no archive declared")).otherwise(reason).alias("reason"))


def audit_refusals(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored census totals (run_dir, decisions, allowed, blocked) against those of the decisions."""
    from veritick.operators.track import refusal_census

    return recompute_diff(stored, refusal_census(decisions)[0], ["run_dir"], ["decisions", "allowed", "blocked"])


# What the doctrine block of a receipt must state.
POSTURE = "ADVISORY_PAPER_ONLY"
LOCKED = ("F1", "F11", "F12", "F18", "F19", "F22", "F4", "F7")
DOCTRINE = "struct<posture:struct<mode:string,provenTrust:boolean>,trustCeiling:double,lockedProvenFormulaIds:array<string>,lambdaStatus:string>"
GATES = "array<struct<gate:string,verdict:string,reason:string>>"


def audit_receipts(receipts: DataFrame) -> DataFrame:
    """(path, problem) of receipts (path, payload_type, key_id, pinned_key_id, sig_ok, statement_type, payload, doctrine, subject_sha).

    Payloads and doctrine blocks are JSON texts; the subject digest must be that of the canonical text, and no nested trust
    number may exceed the ceiling. Gate verdicts must be legal, and a BLOCKED decision must name a blocking gate, each
    blocking gate a reason. The doctrine block must be there and state posture, locked trust, ceiling, the locked set
    exactly, and a status that names the conjecture and claims no theorem. A null anywhere counts as a failed check.
    """
    from veritick.functions.helpers import canonical_digest, over_ceiling
    from veritick.functions.scalars import TRUST_CEILING

    gates = F.coalesce(F.from_json(F.get_json_object("payload", "$.gates"), GATES), F.array().cast(GATES))
    d = F.from_json("doctrine", DOCTRINE)
    df = receipts.withColumns({"__digest": canonical_digest("payload"), "__over": over_ceiling("payload"), "__gates": gates, "__verdict": F.get_json_object("payload", "$.verdict"), "__d": F.when(F.col("doctrine").isNotNull(), d)})
    d, blocked = F.col("__d"), F.coalesce(F.col("__verdict") == "BLOCKED", F.lit(False))
    stops = F.filter("__gates", lambda g: F.coalesce(g["verdict"] == "BLOCKED", F.lit(False)))
    there, status = d.isNotNull(), F.lower(F.coalesce(d["lambdaStatus"], F.lit("")))
    return problems(
        df, ["path"], **{
            "signature invalid": ~F.col("sig_ok"), "payload type": F.col("payload_type") != "application/vnd.in-toto+json", "key not pinned": F.col("key_id") != F.col("pinned_key_id"),
            "statement type": F.col("statement_type") != "https://in-toto.io/Statement/v1", "trust above ceiling": F.size("__over") > 0, "subject digest": F.col("subject_sha") != F.col("__digest"),
            "gate verdict": F.exists("__gates", lambda g: ~F.coalesce(g["verdict"].isin("ALLOWED", "BLOCKED"), F.lit(False))),
            "blocked without a gate": blocked & (F.size(stops) == 0), "blocking gate without a reason": blocked & F.exists(stops, lambda g: F.coalesce(g["reason"], F.lit("")) == ""),
            "no doctrine": ~there, "posture": there & ~d["posture"]["mode"].eqNullSafe(POSTURE), "trust not locked": there & ~d["posture"]["provenTrust"].eqNullSafe(False),
            "ceiling": there & ~d["trustCeiling"].eqNullSafe(TRUST_CEILING), "locked set": there & ~F.array_sort("__d.lockedProvenFormulaIds").eqNullSafe(F.array(*map(F.lit, LOCKED))),
            "status without its conjecture": there & ~status.contains("conjecture 1"), "status claims a theorem": there & status.contains("theorem"),
        },
    )
