"""Conversation structure repair: faults, and the cheapest edits that leave turns of roles ``(system? (user assistant)+)?``.

The edits of a conversation are a shortest path: the state is what came last (nothing, system, user, assistant), each
turn is a step between states, and the costs of a step form a min-plus matrix that depends only on the turn's role and
fault, its symbol.  Equal symbols in a row are one run; a run of n turns advances a vector of costs by the binary powers
of its matrix, which are computed once, as are their products with the few vectors that occur.  From the vectors behind
each run the choices are unrolled forwards, halving a power until single turns are left.

No step needs a conversation in one task but two that its result itself needs: a conversation's turns stand in order over
as many ranges as they fill, earlier equal turns are found by a hash of them, symbols are gathered in stretches of at most
65,536 turns and then joined to one character a turn, since the audit, a single value, has one letter a turn as well.  The
edits go back to the turns by their positions.  (``digests`` streams a conversation's repaired turns through one hash.)

Order within a conversation: by turn, nulls first, then role, then text; so the result does not depend on the order of the
table. Edge cases: nulls of role and text count as one space; a null conversation id is a conversation of its own. Blank:
a text without any character but ASCII white space. A role's symbol is its first character; a turn of another role, or
of an empty one, must get a new role or go. Equal turns: all but the first are duplicates. Conversations without turns
are not in the report; an empty table gives an empty one. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritick.operators.ordered import ranges
from veritick.session import cut

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "suaoSUAOwxyz"  # system, user, assistant, other: sound; truncated; to be deleted (blank or duplicate)
START, SYSTEM, USER, ASSISTANT = range(4)
RECAST, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # costs: another role, deletion, insertion, a truncated turn that stays
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the role that can be made next, by state
END = (0, 6, 3, 0)  # what is to be inserted behind the last turn, by state
ADDED, RECAST_TO = {USER: "<", ASSISTANT: ">"}, {USER: "U", ASSISTANT: "A"}
STRETCH_BITS, CACHED_POWER = 16, 12

Costs = tuple[int, ...]


def kept_as(symbol: str, state: int) -> int | None:
    """The state after keeping the turn with its role, or None where it cannot stand."""
    role = SYMBOLS.index(symbol) % 4 + 1
    if SYMBOLS.index(symbol) >= 8 or not (role == SYSTEM and state == START or role == FOLLOWS[state]):
        return None
    return role


@lru_cache(None)
def choices(symbol: str, state: int) -> tuple[tuple[str, int, int, bool], ...]:
    """(letter, cost, next state, whether the turn is done), in the order of the audit's letters."""
    made, cost = FOLLOWS[state], CUT_OFF * (4 <= SYMBOLS.index(symbol) < 8)
    found = [("D", DELETE, state, True), (ADDED[made], INSERT, made, False)]
    if (role := kept_as(symbol, state)) is not None:
        found.append(("K", cost, role, True))
    if SYMBOLS.index(symbol) < 8:
        found.append((RECAST_TO[made], RECAST + cost, made, True))
    return tuple(found)


@lru_cache(None)
def power(symbol: str, k: int) -> tuple[Costs, ...]:
    """The min-plus matrix of 2 ** k turns of one symbol, what is inserted before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[p][m] + half[m][q] for m in range(4)) for q in range(4)) for p in range(4))
    far = 1 << 40
    step = [[min([c for _, c, q, done in choices(symbol, p) if done and q == to], default=far) for to in range(4)] for p in range(4)]
    for _ in range(2):  # after two insertions the states come round again
        step = [[min(step[p][q], INSERT + step[FOLLOWS[p]][q]) for q in range(4)] for p in range(4)]
    return tuple(map(tuple, step))


@lru_cache(None)
def before(symbol: str, k: int, after: Costs) -> tuple[Costs, int]:
    """Costs in front of 2 ** k turns, less their least, and that least; few vectors of such differences can occur."""
    found = [min(m + v for m, v in zip(row, after, strict=True)) for row in power(symbol, k)]
    return tuple(x - min(found) for x in found), min(found)


def _unrolled(symbol: str, k: int, state: int, after: Costs) -> tuple[str, int]:
    if k:
        one, state = unrolled(symbol, k - 1, state, before(symbol, k - 1, after)[0])
        two, state = unrolled(symbol, k - 1, state, after)
        return one + two, state
    plan, done = "", False
    while not done:
        best = min(power(symbol, 0)[state][q] + after[q] for q in range(4))
        for letter, cost, to, done in choices(symbol, state):
            if cost + (after[to] if done else min(power(symbol, 0)[to][q] + after[q] for q in range(4))) == best:
                break
        plan, state = plan + letter, to
    return plan, state


_remembered = lru_cache(1 << 14)(_unrolled)


def unrolled(symbol: str, k: int, state: int, after: Costs) -> tuple[str, int]:
    """The letters of 2 ** k turns from ``state``, given the costs behind them, and the state they end in."""
    return (_remembered if k <= CACHED_POWER else _unrolled)(symbol, k, state, after)


class Solved(NamedTuple):
    cost: int
    plan: str  # D, K, < and > (a user or assistant turn inserted), U and A (made user or assistant); one of D, K, U, A a turn
    illegal: int


def solve(symbols: str) -> Solved:
    """The cheapest plan of one conversation; of equally cheap ones that of the least audit."""
    ends = array("q", (m.end() for m in re.finditer(r"(.)\1*", symbols)))  # of the runs
    behind, known, places = array("H"), [END], {END: 0}
    now, cost = END, 0
    for i in range(len(ends) - 1, -1, -1):
        a, b = ends[i - 1] if i else 0, ends[i]
        behind.append(places[now])
        for k in range((b - a).bit_length()):
            if (b - a) >> k & 1:
                now, more = before(symbols[a], k, now)
                cost += more
        if now not in places:
            places[now] = len(known)
            known.append(now)
    cost += now[START]
    plan, state, illegal, last = [], START, 0, ""
    for i in range(len(ends)):
        a, b = ends[i - 1] if i else 0, ends[i]
        afters, v = [], known[behind[len(ends) - 1 - i]]
        for k in range((b - a).bit_length()):
            if (b - a) >> k & 1:
                afters.append((k, v))
                v = before(symbols[a], k, v)[0]
        for k, v in reversed(afters):
            letters, state = unrolled(symbols[a], k, state, v)
            plan.append(letters)
        role = "suao"[SYMBOLS.index(symbols[a]) % 4]
        illegal += b - a - 1 + (bool(last) and last + role not in ("su", "ua", "au"))
        last = role
    while END[state]:
        plan.append(ADDED[FOLLOWS[state]])
        state = FOLLOWS[state]
    return Solved(cost, "".join(plan), illegal)


def audit_of(plan: str) -> str:
    """The initials of the edits: delete, insert, keep, rerole."""
    return plan.translate(str.maketrans("<>UA", "IIRR"))


ONE_TURN = "[<>]*[KUAD](?:[<>]+$)?"  # the letters of one turn: what is inserted before it, its own, and at the end what follows


def _solved(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["cost", "audit", "illegal", "gaps", "plans"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first_at", pa.int64()), ("plan", pa.string())]))]
    turn = re.compile(ONE_TURN)
    for batch in batches:
        out = []
        for parts in batch:
            parts = parts.as_py()
            found = solve("".join(p["symbols"] for p in parts))
            spans, at = [], 0
            if len(parts) == 1:
                spans = [{"first_at": parts[0]["first_at"], "plan": found.plan}]
            else:
                each = (m.group() for m in turn.finditer(found.plan))
                for p in parts:
                    spans.append({"first_at": p["first_at"], "plan": "".join(next(each) for _ in p["symbols"])})
            timed = [p for p in parts if p["low"] is not None]
            n = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - n if timed else 0
            out.append((found.cost, audit_of(found.plan), found.illegal, min(gaps, (1 << 63) - 1), spans))
        yield pa.StructArray.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names)


class Repair(NamedTuple):
    report: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv_id, at, nth, turn, role, text, edit: the repaired turns, in order of at and nth within conv_id


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) in stored ranges of the order, with at (position), fault and digest.

    fault: blank, truncated or null, of the text alone. The digest is of role and text.
    """
    last = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(last == "", "blank").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = ranges(rows.withColumns({"fault": fault, "digest": digest}), "conv_id", "turn", "role", "text")
    return rows.withColumn("at", F.monotonically_increasing_id()).drop("__range")


def with_duplicates(slim: DataFrame) -> DataFrame:
    """Turns equal to an earlier one of their conversation get the fault ``duplicate``, unless they are blank.

    First places are taken before rows meet, and only those of repeated turns go back.
    """
    blank = F.col("fault").eqNullSafe("blank")
    first = slim.where(~blank).groupBy("conv_id", "digest").agg(F.min("at").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    first = first.select(F.col("conv_id").alias("__conv"), F.col("digest").alias("__digest"), "__first")
    both = slim.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest")) & ~blank, "left")
    return both.withColumn("fault", F.when(F.col("at") > F.col("__first"), "duplicate").otherwise(F.col("fault"))).drop("__conv", "__digest", "__first", "digest")


def symbol() -> Column:
    """The symbol of a turn's role and fault."""
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    group = F.when(F.col("fault").isin("blank", "duplicate"), 8).when(F.col("fault") == "truncated", 4).otherwise(0)
    return F.substring(F.lit(SYMBOLS), role + group, F.lit(1))


def repair(turns: DataFrame) -> Repair:
    """Report and repaired turns of ``turns`` (conv_id, turn, role, text)."""
    rows = faults(turns)
    known = with_duplicates(rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("role"), "fault", "digest", "at"))
    several = F.array_sort(F.collect_list(F.struct("at", symbol().alias("symbol"))))
    counts = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    stretches = known.groupBy("conv_id", F.shiftright("at", STRETCH_BITS).alias("stretch")).agg(
        F.min("at").alias("first_at"), F.array_join(F.transform(several, lambda x: x["symbol"]), "").alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"), *counts.values(),
    )
    part = F.struct("first_at", "symbols", "low", "high", "turns")
    whole = stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), *[F.sum(c).alias(c) for c in counts])
    kind = "struct<cost:bigint,audit:string,illegal:bigint,gaps:bigint,plans:array<struct<first_at:bigint,plan:string>>>"
    solved = cut(whole.withColumn("s", F.arrow_udf(_solved, kind)("parts")).drop("parts"))
    report = solved.select("conv_id", "s.gaps", *counts, "s.illegal", "s.cost", "s.audit")
    plans = solved.select(F.explode("s.plans").alias("p")).select(F.col("p.first_at").alias("__at"), F.posexplode(F.regexp_extract_all("p.plan", F.lit(ONE_TURN), F.lit(0))).alias("__k", "__letters"))
    edits = plans.select((F.col("__at") + F.col("__k")).alias("at"), "__letters")
    each = rows.select("conv_id", "at", "turn", "role", "text").join(edits, "at").select("*", F.posexplode(F.split("__letters", "")).alias("nth", "__letter"))
    letter = F.col("__letter")
    role = F.when(letter.isin("<", "U"), "user").when(letter.isin(">", "A"), "assistant").otherwise(F.col("role"))
    new = letter.isin("<", ">")
    edit = F.when(new, "insert").when(letter == "K", "keep").otherwise("rerole")
    left = each.where("__letter not in ('', 'D')")
    return Repair(report, left.select("conv_id", "at", "nth", F.when(~new, F.col("turn")).alias("turn"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), edit.alias("edit")))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of ``role:text`` lines in order, of each conversation in repaired ``turns``.

    A hash is a chain over its bytes: a conversation is streamed, a few turns at a time, through one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

        now, ids, found = None, [], []
        for batch in batches:
            for conv, role, text in zip(*batch.columns[:3], strict=True):
                conv = conv.as_py()
                if now is None or conv != ids[-1]:
                    if now is not None:
                        found.append(now.hexdigest())
                    ids.append(conv)
                    now = hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role.as_py()}:".encode())
                now.update(text.as_py().encode("utf-8", "surrogatepass"))
            if found:
                yield out(ids[: len(found)], found)
                ids, found = ids[-1:], []
        if now is not None:
            yield out(ids, [now.hexdigest()])

    lines = turns.select("conv_id", "role", "text", "at", "nth").repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth")
    return lines.select("conv_id", "role", "text").mapInArrow(work, "conv_id bigint, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a hash of conversation and turn; nulls count as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and the hash of the repaired turns, of every conversation after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(turns))
    rest = fixed.report.withColumnRenamed("conv_id", "__a"), digests(fixed.turns).withColumnRenamed("conv_id", "__b")
    every = turns.select("conv_id").distinct().join(rest[0], F.col("conv_id").eqNullSafe(F.col("__a")), "left").join(rest[1], F.col("conv_id").eqNullSafe(F.col("__b")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
