"""The batch rules as Structured Streaming jobs. Timestamps must be of type timestamp (not without zone), in UTC."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from veritick.operators import book, gates


def daily_closes(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """(product, ts, price, id) -> the last price of every closed day; days still open are not emitted, late rows dropped."""
    kept = ticks.where("price > 0").withWatermark("ts", late)
    best = F.max_by("price", F.struct("ts", "id"))
    return kept.groupBy(F.window("ts", "1 day").alias("w"), "product").agg(best.alias("close")).select("product", F.unix_millis("w.start").alias("t_ms"), "close")


def dedup(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def gated(events: DataFrame, now_ms: Column) -> DataFrame:
    """Adds verdict and blocked_by per event, from an explicit clock; stateless."""
    every = F.array(gates.freshness(F.col("observed_at_ms"), now_ms), gates.liquidity(F.col("liquidity_usd"), F.col("volume24h_usd")))
    return events.withColumn("__run", gates.run(every)).withColumns({"verdict": F.col("__run.verdict"), "blocked_by": F.col("__run.blocked_by")}).drop("__run")


def refusal_census(decisions: DataFrame, length: str = "6 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(ts, verdict) -> decisions and refusals per window, tumbling or sliding."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = decisions.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("decisions"), F.count_if(F.col("verdict") == "ALLOWED").alias("allowed"), F.count_if(~F.col("verdict").eqNullSafe("ALLOWED")).alias("blocked"))
    return out.select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "decisions", "allowed", "blocked")


LATE = "LATE"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "pos:bigint,symbol:string,action:string,verdict:string,price_usd:double"
COLUMNS = tuple(c.split(":")[0] for c in ROW.split(","))


def first_open(heard: dict[str, tuple[int, int]]) -> tuple[str, int] | None:
    """The first of the open runs and when it was last heard of."""
    return min(((run, at) for run, (at, _) in heard.items()), default=None)


class PaperBook(StatefulProcessor):
    """One book: the last closed run, and the rows of runs that are still open, each run with the time it was last heard of.

    A run closes when the watermark has passed its last row; runs close in order of run dir, so that one which is still open
    holds back those after it. The rows that a batch brings to a run are one value. Rows of a run at or before the last closed one come out as they are, with the event ``LATE``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "run string, cash string, held string, seq int")
        self.heard = handle.getMapState("heard", "run_dir string", "ms bigint, parts int")
        self.waiting = handle.getMapState("waiting", "run_dir string, part int", f"rows array<struct<{ROW}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.book.get()[0] if self.book.exists() else None
        late, new, ms = [], {}, {}
        for pdf in rows:
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                run = r["run_dir"]
                if last is not None and run <= last:
                    late.append(dict.fromkeys(book.COLUMNS) | {"book_id": key[0], "run_dir": run, "symbol": r["symbol"], "event": LATE, "why": "run is closed", "price": r["price_usd"]})
                    continue
                new.setdefault(run, []).append(tuple(r[c] for c in COLUMNS))
                ms[run] = max(ms.get(run, r["ms"]), r["ms"])
        heard = {k[0]: tuple(v) for k, v in self.heard.iterator()} if new else {}
        before = first_open(heard)
        for run, some in new.items():
            at, parts = heard.get(run, (ms[run], 0))
            heard[run] = (max(at, ms[run]), parts + 1)
            self.heard.updateValue((run,), heard[run])
            self.waiting.updateValue((run, parts), (some,))
        if first_open(heard) != before:
            self.wake(heard)
        if late:
            yield pd.DataFrame(late, columns=book.COLUMNS, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        heard = dict(sorted((k[0], tuple(v)) for k, v in self.heard.iterator()))
        ready = list(itertools.takewhile(lambda run: heard[run][0] < now, heard))
        open_ = {run: heard[run] for run in heard if run not in set(ready)}
        if open_:
            self.wake(open_)
        if not ready:
            return
        _, cash, held, seq = self.book.get() if self.book.exists() else (None, str(book.CONFIG["start_micro"]), "{}", 0)
        rows = []
        for run in ready:
            some = []
            for part in range(heard[run][1]):
                some += [{"book_id": key[0], "run_dir": run, **dict(zip(COLUMNS, v, strict=True))} for v in self.waiting.getValue((run, part))[0]]
                self.waiting.removeKey((run, part))
            self.heard.removeKey((run,))
            rows += sorted(some, key=lambda r: (r["symbol"], r["pos"]))
        events = list(book.replay_rows(iter(rows), int(cash), {k: int(v) for k, v in json.loads(held).items()}, seq=seq))
        self.book.update((events[-1]["run_dir"], events[-1]["cash_micro"], events[-1]["positions"], events[-1]["seq"]))
        yield pd.DataFrame(events, columns=book.COLUMNS, dtype=object)

    def wake(self, heard: dict[str, tuple[int, int]]) -> None:
        """A timer for the first open run: none can close before it, and those behind it that are ready close with it."""
        self.handle.registerTimer(first_open(heard)[1] + 1)

    def close(self) -> None:
        pass


def paper_book(decisions: DataFrame, ts: str = "ts", settle: str = "1 day") -> DataFrame:
    """Book events as runs close, from (book_id, run_dir, pos, symbol, action, verdict, price_usd, ts).

    A run may come in any number of batches: its rows wait as state until ``settle`` after its last row, by the watermark
    over all books. What comes after that is not lost, but comes out with the event ``LATE`` and no place in the book.
    Rows without symbol, run, book or time take no part. State is kept in RocksDB, which this sets for the session.
    """
    decisions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = decisions.withWatermark(ts, settle).where(f"symbol is not null and run_dir is not null and book_id is not null and {ts} is not null")
    # A plain number in place of the time: rows behind the watermark must reach the processor, which tells late runs by itself.
    rows = rows.select(F.col("book_id").cast("string").alias("book_id"), "run_dir", F.unix_millis(ts).alias("ms"), F.col("pos").cast("long").alias("pos"), "symbol", "action", "verdict", F.col("price_usd").cast("double").alias("price_usd"))
    return rows.groupBy("book_id").transformWithStateInPandas(PaperBook(), book.OUT, "append", "eventTime")
