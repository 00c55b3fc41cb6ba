"""Paper books: cash and positions advanced run by run, one book per key. Books are parallel, a book is sequential.

Runs of a book are folded in order of run dir, decisions of a run in order of symbol.  The fold is plain integer
arithmetic over one book's decisions; the audit instead checks every link on its own, from the signed state before it.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritick.functions.helpers import exact_micro
from veritick.functions.scalars import MICRO, QTY
from veritick.operators.ordered import running

CONFIG = {"start_micro": 10_000 * MICRO, "entry_bps": 1000, "fee_bps": 30.0, "slippage_bps": 20.0}  # fixed values
OUT = "book_id string, run_dir string, seq int, symbol string, event string, why string, price double, micro long, qty_e9 string, cash_micro string, positions string, equity_micro string"
LINK = "book_id string, seq int, run_dir string, ok boolean, difference string"


def equity(cash: int, held: dict, prices: dict) -> int | None:
    """Cash and marked positions; None where an open position has no price."""
    total = cash
    for symbol, qty in held.items():
        if not prices.get(symbol):
            return None
        total += qty * exact_micro(prices[symbol]) // QTY
    return total


def advance(cash: int, held: dict[str, int], decisions: list[dict], config: dict = CONFIG) -> tuple[int, dict[str, int], list[dict], int | None]:
    """One run: new cash, positions, events (fills and refusals to act), and the mark."""
    rate = (config["fee_bps"] + config["slippage_bps"]) / 10_000
    held = dict(held)
    ordered = sorted(decisions, key=lambda d: d["symbol"])
    prices = {d["symbol"]: d["price_usd"] for d in ordered if d["price_usd"] is not None and d["price_usd"] > 0}
    events = []

    def note(d: dict, event: str, why: str, micro: int = 0, qty: int = 0) -> None:
        events.append({"symbol": d["symbol"], "event": event, "why": why, "price": d["price_usd"], "micro": micro, "qty_e9": qty})

    for d in ordered:
        symbol, price, own = d["symbol"], d["price_usd"], held.get(d["symbol"], 0) > 0
        priced = price is not None and price > 0
        if d["verdict"] != "ALLOWED":
            note(d, "NONE", "blocked")
        elif d["action"] == "ENTER_LONG":
            if own:
                note(d, "NONE", "already long")
            elif not priced:
                note(d, "NONE", "no price")
            elif (now := equity(cash, held, prices)) is None:
                note(d, "NONE", "open position unpriced")
            elif not 0 < (want := now * config["entry_bps"] // 10_000) <= cash:
                note(d, "SKIPPED_INSUFFICIENT_CASH", "insufficient cash", want)
            elif (unit := exact_micro(price * (1 + rate))) <= 0:
                note(d, "NONE", "price below quantum")
            else:
                qty = want * QTY // unit
                cash -= want
                if qty:
                    held[symbol] = qty
                note(d, "BUY", "entry", want, qty)
        elif d["action"] == "EXIT_LONG":
            if not own:
                note(d, "NONE", "no position")
            elif not priced:
                note(d, "NONE", "no price")
            else:
                qty = held.pop(symbol)
                got = qty * exact_micro(price * (1 - rate)) // QTY
                cash += got
                note(d, "SELL", "exit", got, qty)
        else:
            note(d, "NONE", "no book action")
    return cash, held, events, equity(cash, held, prices)


def _state(held: dict[str, int]) -> str:
    return json.dumps({k: str(v) for k, v in sorted(held.items())}, separators=(",", ":"))


def replay_rows(rows: Iterator[dict], cash: int | None = None, held: dict | None = None, config: dict = CONFIG, seq: int = 0) -> Iterator[dict]:
    """Events of the runs in ``rows`` (ordered by run dir), each with the state after its run; ``seq`` runs came before."""
    cash, held = config["start_micro"] if cash is None else cash, held or {}
    run: list[dict] = []

    def close() -> Iterator[dict]:
        nonlocal cash, held, seq
        seq += 1
        cash, held, events, mark = advance(cash, held, run, config)
        for e in events:
            yield e | {"book_id": run[0]["book_id"], "run_dir": run[0]["run_dir"], "seq": seq, "cash_micro": str(cash), "positions": _state(held), "equity_micro": None if mark is None else str(mark), "qty_e9": str(e["qty_e9"])}

    for row in rows:
        if run and row["run_dir"] != run[0]["run_dir"]:
            yield from close()
            run = []
        run.append(row)
    if run:
        yield from close()


COLUMNS = [c.strip().split()[0] for c in OUT.split(",")]


def book_replay(decisions: DataFrame) -> DataFrame:
    """Every event of every book from (book_id, run_dir, pos, symbol, action, verdict, price_usd).

    Books are dealt to tasks and read in order, run by run: a task holds the state of one book and one run's decisions.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for pdf in batches:
                yield from pdf.astype(object).where(pdf.notna(), None).to_dict("records")

        out: list[dict] = []
        for _, own in itertools.groupby(rows(), key=lambda r: r["book_id"]):
            for event in replay_rows(own):
                out.append(event)
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
        yield pd.DataFrame(out, columns=COLUMNS)

    rows = decisions.select("book_id", "run_dir", "pos", "symbol", "action", "verdict", F.col("price_usd").cast("double").alias("price_usd"))
    rows = rows.where("symbol is not null and run_dir is not null and book_id is not null").withColumn("book_id", F.col("book_id").cast("string"))
    return rows.repartition("book_id").sortWithinPartitions("book_id", "run_dir", "symbol", "pos").mapInPandas(fold, OUT)


EVENT = ("symbol", "event", "why", "micro", "qty_e9")


def book_links(replayed: DataFrame) -> DataFrame:
    """(book_id, seq, run_dir, cash_micro, positions, equity_micro, events): one row per run of a book, events as JSON text."""
    events = F.to_json(F.array_sort(F.collect_list(F.struct(*EVENT))))
    return replayed.groupBy("book_id", "seq", "run_dir").agg(F.first("cash_micro").alias("cash_micro"), F.first("positions").alias("positions"), F.first("equity_micro").alias("equity_micro"), events.alias("events"))


def _events(events: list[dict]) -> str:
    rows = sorted((e["symbol"], e["event"], e["why"], int(e["micro"]), str(e["qty_e9"])) for e in events)
    return json.dumps([dict(zip(EVENT, r, strict=True)) for r in rows], separators=(",", ":"), ensure_ascii=False)


def audit_book(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each signed link against a replay of its run from the signed state before it; all links at once.

    ``difference`` names the first of cash, positions, equity, events (where links have them) that differs, or the link before
    that is missing.
    """
    stated = "events" in links.columns
    links = links if stated else links.withColumn("events", F.lit(None).cast("string"))
    before = links.select("book_id", (F.col("seq") + 1).alias("seq"), F.col("cash_micro").alias("c0"), F.col("positions").alias("p0"))
    joined = links.join(before, ["book_id", "seq"], "left").withColumn("gap", (F.col("seq") > 1) & F.col("c0").isNull())
    decision = F.struct("symbol", "pos", "action", "verdict", F.col("price_usd").cast("double").alias("price_usd"))
    runs = decisions.where("symbol is not null").groupBy("book_id", "run_dir").agg(F.collect_list(decision).alias("decisions"))
    rows = joined.join(runs, ["book_id", "run_dir"], "left").select("book_id", "seq", "run_dir", "gap", "c0", "p0", "cash_micro", "positions", "equity_micro", "events", "decisions")

    def check(r: dict) -> str | None:
        if r["gap"]:
            return "previous link missing"
        start = (CONFIG["start_micro"], {}) if r["c0"] is None else (int(r["c0"]), {k: int(v) for k, v in json.loads(r["p0"]).items()})
        ordered = sorted(r["decisions"] or [], key=lambda d: (d["symbol"], d["pos"] is None, d["pos"] or 0))
        cash, held, events, mark = advance(*start, ordered)
        got = (str(cash), _state(held), None if mark is None else str(mark), _events(events) if stated else None)
        return next((n for n, a, b in zip(("cash", "positions", "equity", "events"), got, (r["cash_micro"], r["positions"], r["equity_micro"], r["events"]), strict=True) if a != b), None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [check(r) for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()]  # few runs are Python objects at a time
            own = [batch.column(c).cast(kind) for c, kind in (("book_id", pa.string()), ("seq", pa.int32()), ("run_dir", pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([b is None for b in bad], pa.bool_()), pa.array(bad, pa.string())], ["book_id", "seq", "run_dir", "ok", "difference"])

    return rows.mapInArrow(work, LINK)


def audit_book_chain(links: DataFrame, dirs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(book_id, seq, problem) of what links state about each other, the ledger's dirs and their inputs; joins by seq and one scan by blocks.

    Links: book_id, seq, run_dir, file, sha256, stated_dir, prev(run_dir, file, sha256), config (JSON), skipped (dirs since
    the link before, or before the first), signal_files.  ``dirs``: book_id, run_dir.  ``inputs``: book_id, run_dir, file
    of the verified decisions.
    """
    from veritick.functions.helpers import canonical_text
    from veritick.operators.ledger import problems

    links = links.withColumn("config", canonical_text("config"))
    before = links.select("book_id", (F.col("seq") + 1).alias("seq"), F.struct("run_dir", "file", "sha256").alias("__prev"), F.col("config").alias("__config"))
    real = dirs.select("book_id", "run_dir").distinct()
    books = links.select("book_id", "run_dir", "seq")
    placed = running(real.join(books, ["book_id", "run_dir"], "left"), "book_id", "run_dir", __after=("max", F.col("seq"))).withColumn("__after", F.coalesce("__after", F.lit(0)))
    between = placed.where("seq is null").groupBy("book_id", (F.col("__after") + 1).alias("seq")).agg(F.array_sort(F.collect_list("run_dir")).alias("__skipped"))
    there = real.withColumn("__there", F.lit(True))
    files = inputs.groupBy("book_id", "run_dir").agg(F.array_sort(F.collect_list("file")).alias("__files"))
    n = links.groupBy("book_id", "seq").agg(F.count("*").alias("__n"))
    df = links.join(before, ["book_id", "seq"], "left").join(between, ["book_id", "seq"], "left").join(there, ["book_id", "run_dir"], "left").join(files, ["book_id", "run_dir"], "left").join(n, ["book_id", "seq"], "left")
    number = lambda path: F.get_json_object("config", path).try_cast("double")
    whole = number("$.costModel.feeBps").isNotNull() & number("$.costModel.slippageBps").isNotNull() & number("$.entryFractionBps").isNotNull() & (number("$.startingCashUsd") > 0)
    none = F.array().cast("array<string>")
    first, linked = F.col("seq") == 1, F.col("__prev").isNotNull()
    same = lambda a, b: F.array_sort(F.coalesce(a, F.array(F.lit("?")))).eqNullSafe(F.coalesce(b, none))
    return problems(
        df, ["book_id", "seq"], **{
            "seq not contiguous from 1": F.col("seq").isNull() | ~(first | linked), "seq repeated": F.coalesce(F.col("__n") > 1, F.lit(False)), "first book has a predecessor": first & F.col("prev").isNotNull(),
            "states another dir": F.col("stated_dir") != F.col("run_dir"), "run dir missing": F.col("__there").isNull(), "previous pointer differs": ~first & linked & ~F.col("prev").eqNullSafe(F.col("__prev")),
            "dir not after the one before": ~first & linked & ~(F.col("run_dir") > F.col("__prev.run_dir")), "config drifted": ~first & linked & ~F.col("config").eqNullSafe(F.col("__config")),
            "config incomplete": ~F.coalesce(whole, F.lit(False)), "gaps differ from the ledger": ~same(F.col("skipped"), F.col("__skipped")), "inputs differ from the ledger": ~same(F.col("signal_files"), F.col("__files")),
        },
    )


def mark_to_market(positions: DataFrame, cash: DataFrame, prices: DataFrame) -> DataFrame:
    """Per book: equity of cash plus quantity times price; null if any open position has no price, and how many."""
    from veritick.functions import scalars as S

    m = lambda c: F.col(c).cast(S.MONEY)
    open_ = positions.where("qty_e9 > 0").join(prices, "symbol", "left")
    value = S.div((m("qty_e9") * S.to_micro_usd("price_usd", exact=True)).cast(S.MONEY), F.lit(QTY).cast(S.MONEY))
    per = open_.groupBy("book_id").agg(F.sum(F.when(F.col("price_usd") > 0, value)).alias("value"), F.count_if(~F.coalesce(F.col("price_usd") > 0, F.lit(False))).alias("unpriced"))
    out = cash.join(per, "book_id", "left").withColumn("unpriced", F.coalesce("unpriced", F.lit(0)))
    return out.withColumn("equity_micro", F.when(F.col("unpriced") == 0, m("cash_micro") + F.coalesce("value", F.lit(0))).cast(S.MONEY)).drop("value")
