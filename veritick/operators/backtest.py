"""Walk-forward replay of a parameter grid: assets x cells x two windows, with integer money.

Features are computed once per distinct look-back (differences of running sums).  Within a window the replay starts after
the cell's warm-up and ends at the bar before the last; look-backs lie inside the window by then, so whole-series features
are exact.

``walk_forward`` sweeps the bars of assets in order, once for all cells: a bar is no row per cell, but a column of a
matrix of cells x bars, a few thousand bars of several assets at a time, whose n-th trades are made together; what is carried
on is the state of each cell.  So 1,000 cells cost
no more rows or shuffles than five.  ``grid_expand``, ``decision_bars`` and ``cell_equity`` are the same replay as rows,
for questions about single decisions; there the trades of one (asset, cell, window) are folded in their order.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritick.functions import scalars as S
from veritick.operators import features as X

CONTEXT = 60  # bars before the split that the second window carries


def grid_expand(bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, share: float = 0.7) -> DataFrame:
    """Bars with features x cells x windows (``in``, ``out``): adds cell_id, window_name, rel, n_window, action, and the asset's next_close and next_t_ms.

    The grid is a constant array, so no join is needed; rows grow by at most twice the number of cells.
    """
    df = X.with_features(bars, cells)
    split = F.floor(F.col("n") * F.lit(share)).cast("int")
    start = F.greatest(split - CONTEXT, F.lit(0))
    windows = F.array(
        F.struct(F.lit("in").alias("name"), F.lit(0).alias("start"), split.alias("end")),
        F.struct(F.lit("out").alias("name"), start.alias("start"), F.col("n").cast("int").alias("end")),
    )
    own = F.filter(windows, lambda w: (F.col("bar_idx") >= w["start"]) & (F.col("bar_idx") < w["end"]))
    bar = ("asset", "t_ms", "close", "bar_idx", "next_close", "next_t_ms")
    actions = F.array(*[X.action(*X.of_cell(c), c.z_entry) for c in cells])
    df = X.by_asset(df.select(*bar, F.explode(own).alias("w"), actions.alias("__actions")))  # dealt anew before rows are multiplied, for windows by asset and cell
    options = [F.struct(F.lit(i).alias("cell_id"), F.lit(c.warmup).alias("warmup"), F.lit(c.fraction).alias("fraction"), F.get("__actions", F.lit(i)).alias("action")) for i, c in enumerate(cells)]
    df = df.select(*bar, "w", F.explode(F.array(*options)).alias("c"))
    return df.select(
        *bar, F.col("c.cell_id").alias("cell_id"), F.col("w.name").alias("window_name"), (F.col("bar_idx") - F.col("w.start")).alias("rel"),
        (F.col("w.end") - F.col("w.start")).alias("n_window"), F.col("c.warmup").alias("warmup"), F.col("c.fraction").alias("fraction"), F.col("c.action").alias("action"),
    )


def decision_bars(expanded: DataFrame) -> DataFrame:
    """Keeps the bars that a replay decides at. Their next bar lies in the window, so that the asset's next one is the fill."""
    return expanded.where((F.col("rel") >= F.col("warmup")) & (F.col("rel") < F.col("n_window") - 1))


MARKED = "asset string, cell_id int, window_name string, s struct<equity:double,drawdown:double,marks:int,held:boolean,trades:int,trips:int,wins:int,error:string>"


class Book:
    """The money of one (asset, cell, window), fed with stretches of its bars in order."""

    def __init__(self, start_usd: float) -> None:
        self.cash, self.qty, self.held, self.bought = round(start_usd * S.MICRO), 0, False, 0.0
        self.trades, self.trips, self.wins, self.error = 0, 0, 0, None
        self.marks, self.peak, self.fall, self.equity = 0, -math.inf, 0.0, None

    def trade(self, side: str, fraction: float, now: float, dear: int, cheap: int) -> None:
        """A purchase of a share of the cash, or the sale of all. Too small ones do not happen."""
        if side == "BUY" and not self.held:
            cents = math.floor(self.cash / S.MICRO * fraction * 100)
            if cents < 1000:
                return
            if dear <= 0:
                self.error = self.error or "price below quantum"
            else:
                self.cash -= cents * 10_000
                self.qty = cents * 10_000 * S.QTY // dear
            self.held, self.bought, self.trades = True, now, self.trades + 1
        elif side == "SELL" and self.held and self.qty > 0:
            self.cash += self.qty * cheap // S.QTY
            self.qty, self.held, self.trades, self.trips = 0, False, self.trades + 1, self.trips + 1
            self.wins += now > self.bought

    def feed(self, moves: list[tuple], price: np.ndarray, priced: np.ndarray) -> None:
        """Bars with their price in millionths, if ``priced``; moves: (place, ...) of the trades among them. What is held has no value without a price."""
        cash, qty, runs, at = [self.cash], [self.qty], [], 0
        for place, *t in moves:
            runs.append(place - at)
            at = place
            self.trade(*t)
            cash.append(self.cash)
            qty.append(self.qty)
        state = np.repeat(np.arange(len(cash)), [*runs, len(price) - at])
        held = integers(qty)[state]
        e = worth(integers(cash)[state], held, price)
        known = priced | (held == 0)
        peak = np.maximum(np.maximum.accumulate(np.where(known, e, -np.inf)), self.peak)
        with np.errstate(invalid="ignore", divide="ignore"):
            fall = np.where(known & (peak > 0), (peak - e) / peak, 0.0)
        self.peak, self.fall, self.equity = float(peak[-1]), max(self.fall, float(fall.max())), float(e[-1]) if known[-1] else None
        self.marks += len(price)

    def row(self) -> dict:
        names = ("equity", "marks", "held", "trades", "trips", "wins", "error")
        return {k: getattr(self, k) for k in names} | {"drawdown": self.fall}


def cell_equity(decisions: DataFrame, fee_bps: float = 30, slippage_bps: float = 20, start_usd: float = 10_000) -> DataFrame:
    """The money of ``decision_bars``: one row per (asset, cell, window) that has decisions.

    Only trades are folded in order; a bar is then marked with the cash and quantity after the trades up to it.  Rows
    come sorted by key, a batch at a time; what is carried on is the state of one key.
    """
    keys = ("asset", "cell_id", "window_name")
    rate = (fee_bps + slippage_bps) / 10_000
    micro = lambda c: F.coalesce(S.to_micro_usd(c).cast("long"), F.lit(0))
    traded = lambda c: F.when(F.col("traded").isNotNull(), c)
    nxt = F.col("next_close")
    df = X.with_position(decisions, "cell_id", "window_name")
    df = df.select(
        *keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("t_ms")) == 1).alias("first"), S.to_micro_usd(nxt).cast("long").alias("price"), F.col("traded").alias("side"), traded(F.col("fraction")).alias("fraction"),
        traded(F.col("next_close")).alias("next"), traded(micro(nxt * (1 + rate))).alias("dear"), traded(micro(nxt * (1 - rate))).alias("cheap"),
    )
    layout = pa.struct([("equity", pa.float64()), ("drawdown", pa.float64()), ("marks", pa.int32()), ("held", pa.bool_()), ("trades", pa.int32()), ("trips", pa.int32()), ("wins", pa.int32()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)).tolist()
            price = batch.column("price").fill_null(0).to_numpy(zero_copy_only=False)
            priced = batch.column("price").is_valid().to_numpy(zero_copy_only=False)
            places = np.flatnonzero(batch.column("side").is_valid().to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(places))
            moves = list(zip(places.tolist(), *(some.column(c).to_pylist() for c in ("side", "fraction", "next", "dear", "cheap")), strict=True))
            names = batch.select(list(keys)).take(pa.array(starts, pa.int64())).to_pylist()
            edges, m = [0, *starts, len(price)], 0
            for j, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                if j:
                    if book is not None:
                        done.append((key, book.row()))
                    key, book = names[j - 1], Book(start_usd)
                own = m
                while m < len(moves) and moves[m][0] < hi:
                    m += 1
                if hi > lo:
                    book.feed([(t[0] - lo, *t[1:]) for t in moves[own:m]], price[lo:hi], priced[lo:hi])
            yield table(done)
        if book is not None:
            yield table([(key, book.row())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([k[c] for k, _ in done], t) for c, t in zip(keys, (pa.string(), pa.int32(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r for _, r in done], layout)], [*keys, "s"])

    return df.mapInArrow(work, MARKED)


CELLS_AT_ONCE = 1 << 20  # entries of a matrix of cells x bars
CELLS_IN_CACHE = 1 << 17  # of those, entries whose money is worked out together
SWEPT = (
    "asset string, cell_id int, window_name string, split_index int, n_bars int, equity double, drawdown double, marks bigint, held boolean, trades int, trips int, wins int, error string"
)


def integers(x: list[int]) -> np.ndarray:
    return np.array(x, dtype=np.int64 if max(x) < 1 << 62 else object)


def worth(cash: np.ndarray, qty: np.ndarray, price: np.ndarray, spread=lambda x: x) -> np.ndarray:
    """Dollars of cash and quantity (of 1e-9) at prices, all integers; products of over 64 bits are taken apart, exactly.

    ``spread`` lays cash and quantity out to the shape of the prices.
    """
    unit = S.QTY
    most = float(qty.max(initial=0))
    top = most * float(np.abs(price).max(initial=0))
    if qty.dtype == object or cash.dtype == object or price.dtype == object or top / unit > 4e18:
        own = spread(qty).astype(object)
        total = spread(cash).astype(object) + np.where(own > 0, own * price.astype(object) // unit, 0)
        return total.astype(float) / S.MICRO
    if top < 9e18:
        total = spread(qty) * price
        total //= unit
    else:
        c, d = price // unit, price % unit
        if most < 9e9:
            own = spread(qty)
            total = own * d
            total //= unit
            total += own * c
        else:
            b = spread(qty % unit)
            total = spread(qty // unit) * price + b * c + b * d // unit
    total += spread(cash)
    return total / S.MICRO


HALF_UP, ATTO = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_UP), decimal.Decimal("1e-18")


def micro(x: np.ndarray) -> np.ndarray:
    """``S.to_micro_usd`` of an array, 0 where there is no finite number. Texts are taken only where the product lies next to half-way or is large."""
    x = np.where(np.isfinite(x), x, 0.0)
    y = np.abs(x) * S.MICRO
    floor = np.floor(y)
    found = np.where(y < 1 << 51, np.copysign(np.floor(y + 0.5), x), 0).astype(np.int64)
    for j in np.flatnonzero((np.abs(y - floor - 0.5) <= y * 2e-15) | (y >= 1 << 51)).tolist():
        text = decimal.Decimal(repr(float(x[j])))
        if y[j] < S.MICRO:  # of a longer fraction, 18 digits are taken first
            text = text.quantize(ATTO, context=HALF_UP)
        found[j] = int(text.scaleb(6, HALF_UP).to_integral_value(context=HALF_UP))
    return found


class Sweep:
    """The replay of windows under all cells, fed with stretches of their bars in order.

    A (cell, window) is a lane; its state is one entry of each array here. The n-th trades of all lanes are made together.
    """

    LANE = {
        "cash": np.int64, "qty": np.int64, "long": bool, "held": bool, "bought": float, "trades": np.int32, "trips": np.int32, "wins": np.int32, "broken": bool, "marks": np.int64,
        "peak": float, "fall": float, "equity": float,
    }

    def __init__(self, cells: tuple[X.Params, ...], windows: int, start_usd: float) -> None:
        self.cells, self.start_usd = cells, start_usd
        self.fraction = np.array([x.fraction for x in cells])
        for name, kind in self.LANE.items():
            setattr(self, name, np.zeros((len(cells), windows), kind))
        self.cash[:], self.peak[:], self.equity[:] = round(start_usd * S.MICRO), -np.inf, start_usd

    def carry(self, other: Sweep, at: int, windows: int) -> None:
        """Takes over the last windows of another as the first ones here."""
        for name in self.LANE:
            mine, theirs = getattr(self, name), getattr(other, name)[:, at : at + windows]
            if theirs.dtype == object:
                mine = mine.astype(object)
                setattr(self, name, mine)
            mine[:, :windows] = theirs

    def one_trade(self, lane: tuple[int, int], buy: bool, now: float, dear: int, cheap: int) -> None:
        """A purchase of a share of the cash, or the sale of all. Too small ones do not happen. Cash and quantities are Python integers."""
        if buy and not self.held[lane]:
            cents = int(self.cash[lane] / S.MICRO * self.cells[lane[0]].fraction * 100)
            if cents < 1000:
                return
            if dear <= 0:
                self.broken[lane] = True
            else:
                self.cash[lane] -= cents * 10_000
                self.qty[lane] = cents * 10_000 * S.QTY // dear
            self.held[lane], self.bought[lane] = True, now
            self.trades[lane] += 1
        elif not buy and self.held[lane] and self.qty[lane] > 0:
            self.cash[lane] += self.qty[lane] * cheap // S.QTY
            self.qty[lane], self.held[lane] = 0, False
            self.trades[lane] += 1
            self.trips[lane] += 1
            self.wins[lane] += now > self.bought[lane]

    def one_by_one(self, lane: np.ndarray, turn: np.ndarray, buy: np.ndarray, money: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``together`` with integers of any size."""
        shape = self.cash.shape
        self.cash, self.qty = ((np.array(x.reshape(-1).tolist() + [None], object)[:-1]).reshape(shape) for x in (self.cash, self.qty))
        cash, qty = [], []
        for x, t, *trade in zip(lane.tolist(), turn.tolist(), buy.tolist(), *(m.tolist() for m in money), strict=True):
            at = divmod(x, shape[1])
            if t:
                self.one_trade(at, *trade)
            cash.append(self.cash[at])
            qty.append(self.qty[at])
        self.cash, self.qty = (integers(x.reshape(-1).tolist()).reshape(shape) for x in (self.cash, self.qty))
        return integers(cash), integers(qty)

    def together(self, lane: np.ndarray, turn: np.ndarray, buy: np.ndarray, money: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """Cash and quantity from each given place on, where some lanes trade (``turn``); None, with nothing changed, where 64 bits do not suffice.

        Places come by lane, in order, all but a lane's first with a trade. money: next close, dear and cheap price of each.
        """
        unit = S.QTY
        if self.cash.dtype == object or self.qty.dtype == object:
            return None
        first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        many = np.diff(first, append=len(lane))
        busiest = np.argsort(-(many + buy[first]), kind="stable")  # lanes of most steps first, so that each step takes the first so many
        place = np.empty(len(first), np.int64)
        place[busiest] = np.arange(len(first))
        step = np.arange(len(lane)) - np.repeat(first - buy[first], many)  # odd where a lane is long from there on: buying and selling take turns
        own_place = np.repeat(place, many)
        order = np.lexsort((own_place, step))
        ends = np.cumsum(np.bincount(step)).tolist()
        turn, now, dear, cheap = (x[order] for x in (turn, *money))
        own_place, lanes = own_place[order], lane[first][busiest]
        names = ("cash", "qty", "held", "bought", "trades", "trips", "wins", "broken")
        cash, qty, held, bought, trades, trips, wins, broken = new = [getattr(self, x).reshape(-1)[lanes] for x in names]
        share = np.repeat(self.fraction, self.cash.shape[1])[lanes]
        then_cash, then_qty = np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
        lo = 0
        for j, hi in enumerate(ends):
            own = slice(0, hi - lo) if j > 1 else own_place[lo:hi]
            if j % 2:
                cents = np.trunc(cash[own] / S.MICRO * share[own] * 100)
                if hi > lo and (cash[own].max() > 1 << 53 or cents.max() > 9e11):
                    return None
                go = turn[lo:hi] & ~held[own] & (cents >= 1000)
                paid = go & (dear[lo:hi] > 0)
                spent, price = np.where(paid, cents, 0).astype(np.int64) * 10_000, np.where(paid, dear[lo:hi], 1)
                if spent.max(initial=0) < 9_000_000_000:
                    n = spent * unit // price
                else:
                    n, rest = np.divmod(spent, price)
                    if price.max() > 9e15 or n.max() > 9e9:
                        return None
                    for _ in range(3):  # by 1e9 in three steps, so that no product leaves 64 bits
                        more, rest = np.divmod(rest * 1000, price)
                        n = n * 1000 + more
                cash[own] -= spent
                qty[own] = np.where(paid, n, qty[own])
                broken[own] |= go & ~paid
                held[own] |= go
                bought[own] = np.where(go, now[lo:hi], bought[own])
            else:
                go = turn[lo:hi] & held[own] & (qty[own] > 0)
                n, price = np.where(go, qty[own], 0), np.where(go, cheap[lo:hi], 0)
                top = float(n.max(initial=0)) * float(np.abs(price).max(initial=0))
                if top / unit > 4e18:
                    return None
                part = n % unit
                cash[own] += n * price // unit if top < 9e18 else n // unit * price + part * (price // unit) + part * (price % unit) // unit
                if hi > lo and cash[own].max() > 1 << 62:
                    return None
                qty[own] -= n
                held[own] &= ~go
                trips[own] += go
                wins[own] += go & (now[lo:hi] > bought[own])
            trades[own] += go
            then_cash[lo:hi], then_qty[lo:hi] = cash[own], qty[own]
            lo = hi
        for name, x in zip(names, new, strict=True):
            getattr(self, name).reshape(-1)[lanes] = x
        by_place = np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
        by_place[0][order], by_place[1][order] = then_cash, then_qty
        return by_place

    def feed(self, window: np.ndarray, edges: np.ndarray, rel: np.ndarray, valid: np.ndarray, enter: np.ndarray, leave: np.ndarray, money: list[np.ndarray]) -> None:
        """Bars of some windows, one after the other, the j-th from ``edges[j]`` on, at ``rel`` in it.

        By cell and bar: whether it decides, and enters or leaves; money: next close, and its price, dear and cheap in millionths.
        """
        starts, last, n, price = edges[:-1], edges[1:] - 1, len(rel), money[1][None, :]
        some = max(1, CELLS_IN_CACHE // n)
        blocks = [slice(c, c + some) for c in range(0, len(self.cells), some)]
        place = np.arange(2, 2 * n + 2, 2, dtype=np.int32)
        carried = self.marks[:, window].any(axis=0).tolist()
        found = []
        for b in blocks:
            moved = np.where(enter[b] | leave[b], place, np.int32(0))  # twice the bar's number from 1, and 1 for an entry: the last move has the greatest
            moved |= enter[b]
            before = self.long[b, window]
            moved[:, starts] = np.where(moved[:, starts] > 0, moved[:, starts], place[starts] + before)
            long = (np.maximum.accumulate(moved, axis=1) & 1).astype(bool)
            turned = np.empty(long.shape, bool)
            np.not_equal(long[:, 1:], long[:, :-1], out=turned[:, 1:])
            turned[:, starts] = long[:, starts] != before
            self.long[b, window] = long[:, last]
            head = turned.copy()
            head[:, starts] = True
            states = np.flatnonzero(head)  # where a state of a lane begins, by cell and bar
            found.append((states + b.start * n, turned.reshape(-1)[states], long.reshape(-1)[states]))
        states, turned, long = (np.concatenate(x) for x in zip(*found, strict=True))
        cell, bar = np.divmod(states, n)
        lane = cell * self.long.shape[1] + np.repeat(window, np.diff(edges))[bar]
        trade = (lane, turned, long, [money[j][bar] for j in (0, 2, 3)])
        cash, qty = self.together(*trade) or self.one_by_one(*trade)
        runs = np.diff(states, append=len(self.cells) * n)
        parts = np.searchsorted(states, [b.start * n for b in blocks] + [len(self.cells) * n]).tolist()
        for b, lo, hi in zip(blocks, parts, parts[1:], strict=False):
            e = worth(cash[lo:hi], qty[lo:hi], price, lambda x: np.repeat(x, runs[lo:hi]).reshape(-1, n))  # noqa: B023
            np.copyto(e, -np.inf, where=~valid[b])
            before, peak = self.peak[b, window], np.empty(e.shape)
            for j, (first, past) in enumerate(zip(starts.tolist(), edges[1:].tolist(), strict=True)):
                np.maximum.accumulate(e[:, first:past], axis=1, out=peak[:, first:past])
                if carried[j]:
                    np.maximum(peak[:, first:past], before[:, j, None], out=peak[:, first:past])
            self.peak[b, window] = peak[:, last]
            peak[peak <= 0] = np.nan
            with np.errstate(invalid="ignore"):
                fall = peak - e
                fall /= peak
            self.fall[b, window] = np.fmax(self.fall[b, window], np.fmax.reduceat(fall, starts, axis=1))
            self.equity[b, window] = np.where(valid[b][:, last], e[:, last], self.equity[b, window])
        self.marks[:, window] += np.add.reduceat(valid, starts, axis=1, dtype=np.int64)


def sweep(featured: DataFrame, cells: tuple[X.Params, ...], share: float, rate: float, start_usd: float) -> DataFrame:
    """``SWEPT``: one row per asset, cell and window, from ``X.with_features`` in partitions by asset, sorted by asset and time.

    The features' own windows leave them so; rows out of order stop the job. Stretches of bars are taken as they come, with all assets in them. Comparisons are made once per look-back; the matrix of
    cells x bars is put together from their outcomes.
    """
    rets, zs, vols = (sorted({getattr(c, x) for c in cells}) for x in ("momentum", "z_window", "vol_window"))
    bounds = sorted({(c.z_window, c.z_entry) for c in cells})
    of_ret, of_z, of_vol = (np.array([known.index(getattr(c, x)) for c in cells]) for known, x in ((rets, "momentum"), (zs, "z_window"), (vols, "vol_window")))
    of_bound, bound_z, entry = np.array([bounds.index((c.z_window, c.z_entry)) for c in cells]), np.array([zs.index(z) for z, _ in bounds]), np.array([x for _, x in bounds])[:, None]
    warmup, least = np.array([c.warmup for c in cells])[:, None], min(c.warmup for c in cells)
    at_once = max(1, CELLS_AT_ONCE // len(cells))
    context = CONTEXT
    fixed = ["asset", "bar_idx", "n", "split", "next_close"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_before = None  # of an asset whose bars go on: its windows, and the bar that comes next

        def done(s: Sweep, assets: list, n: np.ndarray, split: np.ndarray) -> pa.RecordBatch:
            k, c = len(assets), len(cells)
            each = {x: getattr(s, x)[:, : 2 * k].T.reshape(-1) for x in ("equity", "fall", "marks", "held", "trades", "trips", "wins", "broken")}
            wide = lambda x: np.repeat(x, 2 * c)
            columns = [
                pa.array(assets, pa.string()).take(pa.array(wide(np.arange(k)))), pa.array(np.tile(np.arange(c, dtype=np.int32), 2 * k)), pa.array(["in", "out"]).take(pa.array(np.tile(np.repeat([0, 1], c), k))),
                pa.array(wide(split), pa.int32()), pa.array(np.repeat(np.stack([split, n - split], axis=1).reshape(-1), c), pa.int32()), *(pa.array(each[x]) for x in ("equity", "fall", "marks", "held", "trades", "trips", "wins")),
                pa.array(np.where(each["broken"], "price below quantum", None), pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in SWEPT.split(", ")])

        def stretch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal open_before
            cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(1, batch.num_columns)]
            idx = cols[0].astype(np.int64)
            begins = np.flatnonzero(idx == 0)
            if open_before is not None:
                begins = np.concatenate([[0], begins])
            ends = np.append(begins[1:], len(idx))
            awaited = 0 if open_before is None else open_before[2]
            n, split = (cols[j][begins].astype(np.int64) for j in (1, 2))
            if idx[0] != awaited or ((idx[1:] != 0) & (idx[1:] != idx[:-1] + 1)).any() or (idx[ends[:-1] - 1] != n[:-1] - 1).any() or idx[-1] >= n[-1]:
                raise ValueError("the sweep needs all bars of an asset in order")
            s = Sweep(cells, 2 * len(begins), start_usd)
            if open_before is not None:
                s.carry(*open_before[:2], 2)
            window, rows, rel = [], [], []
            for a, (lo, hi, size, cut) in enumerate(zip(begins.tolist(), ends.tolist(), n.tolist(), split.tolist(), strict=True)):
                zero = lo - int(idx[lo])
                late = max(cut - context, 0)
                for w, start, end in ((0, 0, cut), (1, late, size)):
                    first, past = max(lo, zero + start + least), min(hi, zero + end - 1)
                    if first < past:
                        window.append(2 * a + w)
                        rows.append(np.arange(first, past))
                        rel.append(rows[-1] - zero - start)
            if window:
                edges = np.cumsum([0, *map(len, rows)])
                rows, rel = np.concatenate(rows), np.concatenate(rel)
                seen = (x[rows].astype(float) for x in cols[3:])
                close = next(seen)
                money = [close, *(micro(close * x) for x in (1, 1 + rate, 1 - rate))]
                ret, z, vol = (np.stack([next(seen) for _ in known]) for known in (rets, zs, vols))
                with np.errstate(invalid="ignore"):
                    near = (z[bound_z] <= -entry) | (np.abs(z[bound_z]) < entry)
                    up, down, high = ret > 0, ret <= 0, z >= 0
                valid = rel[None, :] >= warmup
                known = valid & ~np.isnan(vol)[of_vol]
                s.feed(np.array(window), edges, rel, valid, up[of_ret] & near[of_bound] & known, down[of_ret] & high[of_z] & known, money)
            whole = len(begins) - int(idx[-1] < n[-1] - 1)
            if whole:
                yield done(s, batch.column(0).take(pa.array(begins[:whole])).to_pylist(), n[:whole], split[:whole])
            open_before = (s, 2 * whole, int(idx[-1]) + 1) if whole < len(begins) else None

        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                yield from stretch(batch.slice(lo, at_once))
        if open_before is not None:
            raise ValueError("the sweep needs all bars of an asset in order")

    looks = [f"{name}_{k}" for name, known in (("ret", rets), ("z", zs), ("vol", vols)) for k in known]
    rows = featured.withColumns({"split": F.floor(F.col("n") * F.lit(share)).cast("int"), "asset": F.col("asset").cast("string")}).select(*fixed, *looks)
    return rows.mapInArrow(work, SWEPT)


def walk_forward(
    bars: DataFrame, cells: tuple[X.Params, ...] = X.GRID, share: float = 0.7, fee_bps: float = 30, slippage_bps: float = 20, start_usd: float = 10_000, block: int | None = None
) -> DataFrame:
    """One row per asset, cell and window, those without a decision included; never sorted by result.

    ``block``: rows of an asset whose features are computed together (``X.rolling``), for assets with very many bars.
    """
    featured = X.with_features(bars, cells, block)
    if block is not None:
        featured = X.by_asset(featured).sortWithinPartitions("asset", "bar_idx")
    s = sweep(featured, cells, share, (fee_bps + slippage_bps) / 10_000, start_usd)
    bad = F.col("error").isNotNull()
    value = lambda c: F.when(~bad, c)
    trips = F.col("trips")
    return s.select(
        "asset", "cell_id", "window_name", "split_index", "n_bars", value(F.col("equity")).alias("final_equity"), value(F.col("equity") / start_usd - 1).alias("total_return"),
        value(F.when(F.col("marks") > 0, F.col("drawdown"))).alias("max_drawdown"), F.col("trades").alias("n_trades"), trips.alias("n_round_trips"), F.when(trips > 0, F.col("wins") / trips).alias("win_rate"),
        (trips < 10).alias("weak_evidence"), F.col("held").alias("open_at_end"), "error",
    )


def trade_list(decisions: DataFrame) -> DataFrame:
    """One row per entry or exit, by state change, filled at the next bar."""
    return X.with_position(decisions, "cell_id", "window_name").where("traded is not null").select("asset", "cell_id", "window_name", F.col("next_t_ms").alias("t_ms"), F.col("traded").alias("side"), F.col("next_close").alias("price"))


def round_trips(trades: DataFrame) -> DataFrame:
    """Trips (1st and 2nd trade, 3rd and 4th, ...) and the share won at raw prices; null without a trip."""
    w = Window.partitionBy("asset", "cell_id", "window_name").orderBy("t_ms")
    sold = trades.withColumns({"__next": F.lead("price").over(w), "__side": F.lead("side").over(w)}).where("side = 'BUY'")
    done = F.col("__side") == "SELL"
    trips = F.count_if(done)
    out = sold.groupBy("asset", "cell_id", "window_name").agg(trips.alias("n_round_trips"), F.count_if(done & (F.col("__next") > F.col("price"))).alias("wins"))
    return out.withColumn("win_rate", F.when(F.col("n_round_trips") > 0, F.col("wins") / F.col("n_round_trips"))).withColumn("weak_evidence", F.col("n_round_trips") < 10)
