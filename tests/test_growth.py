"""Steps that must not grow faster than their input."""

import io
import math
from contextlib import redirect_stdout

import pandas as pd
from pyspark.sql import functions as F


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_digests_are_made_where_texts_are_read(spark):
    """No canonical text goes back to the JVM; many rows a batch, nulls and texts that are no JSON among them."""
    from veritick.functions import helpers as H

    df = spark.range(1000, numPartitions=1).select("id", F.when(F.col("id") == 7, None).when(F.col("id") == 8, "{").otherwise(F.concat(F.lit('{"b":1.0,"a":'), "id", F.lit("}"))).alias("t"))
    got = df.select("id", H.canonical_digest("t").alias("d"), F.sha2(F.concat(F.lit('{"a":'), "id", F.lit(',"b":1}')), 256).alias("want"))
    assert "sha2" not in plan(df.select(H.canonical_digest("t")))
    assert all(r["d"] == (None if r["id"] in (7, 8) else r["want"]) for r in got.collect())


def test_chains_go_by_number(spark, monkeypatch):
    """Hashes are joined once, for the pointers; the rounds hold numbers alone."""
    from veritick.operators import ledger as L

    seen, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: seen.append({t for _, t in df.dtypes}) or cut(df))
    rows = [("a", f"h{i}", f"h{i - 1}" if i else None) for i in range(9)] + [("a", "x", "gone"), ("a", "y", "x"), ("a", "p", "q"), ("a", "q", "p"), (None, "n", "h1")]
    got = {r["sha256"]: (r["before"], r["end"]) for r in L.chain_reach(spark.createDataFrame(rows, "ledger string, sha256 string, prev_sha string")).collect()}
    assert got == {f"h{i}": (i, "genesis") for i in range(9)} | {"x": (0, "missing"), "y": (1, "missing"), "p": (None, "loop"), "q": (None, "loop"), "n": (0, "missing")}
    assert len(seen) > 3 and all("string" not in kinds for kinds in seen[1:])


def test_book_links_are_audited_by_the_batch(spark):
    """No frame and no call per link; of two links with one number each is audited."""
    from veritick.operators import book as K

    rows = spark.createDataFrame([("B", f"r{i}", i, "S", "ENTER_LONG" if i % 2 == 0 else "EXIT_LONG", "ALLOWED", 10.0 + i) for i in range(6)], "book_id string, run_dir string, pos long, symbol string, action string, verdict string, price_usd double")
    links = K.book_links(K.book_replay(rows)).localCheckpoint()
    twin = links.where("seq = 6").withColumn("cash_micro", F.lit("1"))
    found = K.audit_book(links.unionByName(twin), rows)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert sorted((r["seq"], r["ok"], r["difference"]) for r in found.collect()) == sorted([(i, True, None) for i in range(1, 7)] + [(6, False, "cash")])


class Held(dict):
    """A state variable of a stand-in store that counts what is written."""

    writes = 0

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return "value" in self

    def get(self):
        return self["value"]

    def update(self, v):
        self["value"] = v


class Store:
    def __init__(self):
        self.vars, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.vars.setdefault(name, Held())

    getMapState = lambda self, name, k, v: self.vars.setdefault(name, Held())

    def registerTimer(self, ms):
        self.timers.append(ms)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_batch_costs_a_book_few_state_writes():
    """100 decisions of four runs: a value a run, one timer; the runs close together and in order."""
    from veritick.streaming import jobs

    store, p = Store(), jobs.PaperBook()
    p.init(store)
    rows = [{"run_dir": f"r{i % 4}", "ms": i, "pos": i, "symbol": f"S{i % 9}", "action": "HOLD", "verdict": "ALLOWED", "price_usd": 1.0} for i in range(100)]
    list(p.handleInputRows(("B",), iter([pd.DataFrame(rows[:60]), pd.DataFrame(rows[60:])]), None))
    assert store.vars["waiting"].writes == 4 and store.timers == [97]
    list(p.handleInputRows(("B",), iter([pd.DataFrame([rows[0] | {"run_dir": "r9", "ms": 500}])]), None))
    assert len(store.timers) == 1  # a run behind the first open one needs no timer yet
    out = pd.concat(p.handleExpiredTimer(("B",), Now(101), None))
    assert list(dict.fromkeys(out["run_dir"])) == ["r0", "r1", "r2", "r3"] and len(out) == 100 and store.timers[1:] == [501]
    assert [k[0] for k in store.vars["waiting"]] == ["r9"]


def test_archives_have_a_bounded_number_of_folders(spark, tmp_path):
    """600 series: 256 folders at most; each comes back once under its hash, and so does one in a folder of its own."""
    from veritick.sources import sinks

    bars = spark.range(600).select(F.col("id").cast("string").alias("asset"), F.lit(1).cast("long").alias("t_ms"), F.col("id").cast("double").alias("close"))
    path = str(tmp_path / "a")
    for _ in range(2):
        assert sinks.archive_series(bars, path).count() == 0
    assert len([p for p in (tmp_path / "a").iterdir() if p.is_dir()]) <= 256
    alone = F.sha2(F.lit("[]"), 256)
    spark.range(1).select(F.lit("[]").alias("text"), alone.alias("sha256")).write.mode("append").partitionBy("sha256").text(path)
    back = sinks.read_archive(spark, path)
    assert back.count() == back.select("sha256").distinct().count() == 601
    assert back.where(F.sha2(F.encode("text", "utf-8"), 256) != F.col("sha256")).count() == 0


def test_recomputed_results_are_computed_once(spark):
    from veritick.plans import ledger_plans

    assert "MapInArrow" not in plan(ledger_plans.recompute(spark, "/root/testdata/sf0.001"))


def test_last_bars_alone_give_the_features_of_whole_series(spark):
    """Decisions at the last bars: as from whole series, but look-backs see no more bars than they need, and gates are no lambdas."""
    from veritick.operators import features as X
    from veritick.operators import gates as G

    rows = [(f"a{n}", 86_400_000 * i, 50 + 10 * math.sin(i * (n + 1) / 7) + (i * 7919 % 13) / 10 if i % 50 != 3 else -1.0) for n in (1, 20, 21, 29, 31, 32, 33, 34, 120) for i in range(n)]
    bars = spark.createDataFrame(rows, "asset string, t_ms long, close double")
    p = X.Params()
    every = {r["asset"]: r for r in X.with_decision(bars, p).where("bar_idx = n - 1").collect()}
    last = X.with_decision(bars, p, last=True)
    for r in last.collect():
        for c in ("bar_idx", "n", "action", "ret_28", "z_20", "vol_30", "conviction"):
            want = every[r["asset"]][c]
            assert r[c] == want or abs(r[c] - want) < 1e-9 * max(1, abs(want)), (r["asset"], c, r[c], want)
    assert last.count() == len(every) == 9
    shots = spark.createDataFrame([("s", i, f"a{n}", 3e5, 2e5, 1000) for i, n in enumerate((120, 33, 1, 7))], "session string, pos long, asset string, liquidity_usd double, volume24h_usd double, observed_at_ms long")
    got = G.decide(shots, bars, F.lit(2000), budget=3)
    for r in got.collect():
        assert r["blocked_by"] == [g["gate"] for g in r["gates"] if g["verdict"] == "BLOCKED"] and (r["verdict"] == "BLOCKED") == bool(r["blocked_by"])
    plan = got.select("verdict", "blocked_by")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.index("ArrowEvalPython") < plan.index("isnull(__later")


def test_scores_make_baselines_once(spark):
    """Baselines are looked up once, no wide join by asset alone; notes by brute force, with bars and signals without a time."""
    import random

    from veritick.operators import track as T

    rng, day = random.Random(4), 86_400_000
    ticks = [(a, rng.randrange(400) * day, float(rng.randrange(1, 99))) for a in "abc" for _ in range(25)] + [("d", None, 5.0), (None, 5, 1.0)]
    ticks = list({(a, t): (a, t, c) for a, t, c in ticks}.values())
    calls = [(i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([None, *[rng.randrange(-50, 420) * day + rng.randrange(day)] * 5])) for i in range(400)]
    bars = spark.createDataFrame(ticks, "asset string, t_ms long, close double")
    signals = spark.createDataFrame(calls, "file long, asset string, signal_ms long")
    now = 405 * day
    df = T.score_signals(signals, bars, F.lit(now))

    def first(a, t):
        return min(((u, c) for b, u, c in ticks if b == a and a is not None and u is not None and t is not None and u >= t), default=None)

    want = {}
    for i, a, t in calls:
        for h in (1, 7):
            due = None if t is None else t + h * day
            b, o = first(a, t), first(a, due)
            late = lambda x: "pending" if now < x + day else "gap"
            known = a is not None and any(x[0] == a for x in ticks)
            note = "no history" if not known else "unparseable time" if t is None else late(t) if b is None else late(due) if o is None else None
            want[i, h] = ("MEASURED" if b and o else "UNAVAILABLE", note, o[1] / b[1] - 1 if b and o else None)
    assert {(r["file"], r["horizon"]): (r["label"], r["note"], r["forward_return"]) for r in df.collect()} == want
    assert {n for _, n, _ in want.values()} == {"no history", "unparseable time", "pending", "gap", None}
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [last(__bar") == 2 and text.count("Join LeftOuter") == 2
