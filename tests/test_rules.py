"""Unit cases of the rules: scalars, gates, replay against a plain re-implementation, proofs, books, chains, ingest."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from veritick.functions import helpers as H
from veritick.functions import scalars as S
from veritick.operators import backtest as B
from veritick.operators import book as K
from veritick.operators import features as X
from veritick.operators import gates as G
from veritick.operators import ledger as L
from veritick.operators import proofs as O
from veritick.operators import track as T
from veritick.sources import ingest as I
from veritick.sources import sinks

DAY = 86_400_000


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lcg_bars(n=420):
    s, price, out = 42, 100.0, []
    for i in range(n):
        s = (s * 1664525 + 1013904223) % 2**32
        price *= 1 + (s / 2**32 - 0.5) * 0.06
        out.append(("LCG", 1577836800000 + i * DAY, price))
    return out


def test_scalars(spark):
    inf, nan = float("inf"), float("nan")
    r = one(
        spark, a=S.cap_trust(F.lit(1.5)), b=S.cap_trust(F.lit(-1.0)), c=S.cap_trust(F.lit(nan)), d=S.lambda_bounded(F.lit(inf)), e=S.squash01(F.lit(0.0)), f=S.hoeffding_confidence(F.lit(0), 0.1, 0.0, 1.0),
        g=S.lambda_aggregate(F.array(F.lit(0.25), F.lit(1.0))), h=S.lambda_aggregate(F.array(F.lit(0.0), F.lit(2.0))), i=S.lambda_aggregate(F.array(F.lit(2.0), F.lit(0.0))), j=S.lambda_aggregate(F.array().cast("array<double>")),
        k=S.to_micro_usd(F.lit(1.0000005)), m=S.micro_to_usd(F.lit(1234567)), n=S.iso_millis(F.lit("2026-07-15T04:00:00.5Z")), o=S.iso_millis(F.lit("x")), p=S.hoeffding_confidence(F.lit(100000), 1.0, 0.0, 1.0),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (0.97, 0.0, None, False, 0.5, None)
    assert r["g"] == pytest.approx(0.5) and r["h"] == 0.0 and r["i"] is None and r["j"] is None
    assert (r["k"], r["m"], r["n"], r["o"], r["p"]) == (1000001, "1.234567", 1784088000500, None, 0.97)


def test_exact_division(spark):
    m = lambda x: F.lit(str(x)).cast(S.MONEY)
    pairs = [(2 * 10**20, 7), (2000_000_000 * 10**9, 11), (10**30 + 7, 3), (5, 9)]
    r = one(spark, **{f"q{i}": S.div(m(a), m(b)) for i, (a, b) in enumerate(pairs)})
    assert [int(r[f"q{i}"]) for i in range(len(pairs))] == [a // b for a, b in pairs]


def test_number_text():
    for x, want in ((1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.00000318, "0.00000318"), (123456789012345680000.0, "123456789012345680000"), (-0.0, "0"), (1.5e300, "1.5e+300"), (-2.5, "-2.5"), (5e-324, "5e-324")):
        assert H.number_text(x) == want
    assert H.canonical({"b": [1, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,null,true]}'
    assert H.number_text(2**53) == "9007199254740992" and H.number_text(9007199254740993) == "9007199254740992" and H.number_text(10**20 + 1) == "100000000000000000000" and H.number_text(10**21) == "1e+21"
    assert H.canonical("\ud800x\U0001f600") == '"\\ud800x\U0001f600"' and H.plain({"b": 1.0, "a": [None]}) == '{"b":1,"a":[null]}'
    with pytest.raises(ValueError):
        H.number_text(10**400)


def test_odd_json_does_not_stop_a_job(spark):
    texts = ['{"a":"\\ud800"}', "[" * 100_000, "{", None, '{"n":9007199254740993}', '{"n":1e400}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", H.canonical_text("t").alias("c")).collect()}
    assert got == {0: '{"a":"\\ud800"}', 1: None, 2: None, 3: None, 4: '{"n":9007199254740992}', 5: None}
    assert rows.select(H.canonical_digest("t").alias("d"), H.over_ceiling("t").alias("o")).where("d is not null").count() == 2


def test_gates_fail_closed(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, a=G.freshness(n, F.lit(1)), b=G.sample_size(n), c=G.liquidity(n, F.lit(1e9)), d=G.volatility(F.lit(9.0)), e=G.conviction(F.lit(0.99)), f=G.volatility(F.lit(float("nan"))), g=G.conviction(F.lit(0.6)),
        h=G.freshness(F.lit(10), F.lit(5)), i=G.freshness(F.lit(0), F.lit(300_000)), j=G.run(F.array(G.volatility(F.lit(9.0)), G.sample_size(F.lit(50)), G.conviction(n))), k=G.liquidity(F.lit(1.0), F.lit(1.0)),
    )
    assert [r[k]["verdict"] for k in "abcdefghi"] == ["BLOCKED"] * 6 + ["ALLOWED", "BLOCKED", "ALLOWED"]
    assert r["j"]["verdict"] == "BLOCKED" and r["j"]["blocked_by"] == ["volatility", "conviction"] and r["k"]["reason"] == "liquidity under floor"


def replay(bars, p, start, end):
    """The replay of one window in plain Python."""
    closes = [c for _, _, c in bars]
    mean = lambda v: sum(v) / len(v)
    std = lambda v: math.sqrt(sum((x - mean(v)) ** 2 for x in v) / len(v))
    cash, qty, held, equity, trades, bought, wins, trips = 10**10, 0, False, [], 0, 0.0, 0, 0
    for i in range(start + p.warmup, end - 1):
        ret = closes[i] / closes[i - p.momentum] - 1
        past = closes[i - p.z_window : i]
        z = (closes[i] - mean(past)) / std(past)
        nxt = closes[i + 1]
        if ret > 0 and (z <= -p.z_entry or abs(z) < p.z_entry):
            cents = math.floor(cash / 1e6 * p.fraction * 100)
            if not held and cents >= 1000:
                qty, cash, held, trades, bought = cents * 10**4 * 10**9 // H.exact_micro(nxt * 1.005), cash - cents * 10**4, True, trades + 1, nxt
        elif z >= 0 and ret <= 0 and held and qty:
            cash, qty, held, trades, trips, wins = cash + qty * H.exact_micro(nxt * 0.995) // 10**9, 0, False, trades + 1, trips + 1, wins + (nxt > bought)
        equity.append((cash + qty * H.exact_micro(nxt) // 10**9) / 1e6)
    peak = fall = 0.0
    for e in equity:
        peak = max(peak, e)
        fall = max(fall, (peak - e) / peak)
    return (equity[-1] if equity else 10000.0, fall if equity else None, trades, trips, wins / trips if trips else None, held)


def test_walk_forward_equals_plain_replay(spark):
    bars = lcg_bars()
    short = [("SHORT", t, c) for _, t, c in bars[:20]]
    df = spark.createDataFrame(bars + short, "asset string, t_ms long, close double")
    got = {(r["asset"], r["cell_id"], r["window_name"]): r for r in B.walk_forward(df).collect()}
    assert len(got) == 20
    split = math.floor(len(bars) * 0.7)
    for i, p in enumerate(X.GRID):
        for w, (a, b) in {"in": (0, split), "out": (split - 60, len(bars))}.items():
            r = got["LCG", i, w]
            assert (r["final_equity"], r["max_drawdown"], r["n_trades"], r["n_round_trips"], r["win_rate"], r["open_at_end"]) == replay(bars, p, a, b)
            s = got["SHORT", i, w]
            assert (s["final_equity"], s["total_return"], s["max_drawdown"], s["n_trades"], s["win_rate"], s["open_at_end"]) == (10000.0, 0.0, None, 0, None, False)


def test_features_edges(spark):
    flat = spark.createDataFrame([("A", i * DAY, 5.0) for i in range(40)] + [("B", i * DAY, 1.0 if i != 35 else -1.0) for i in range(40)], "asset string, t_ms long, close double")
    rows = X.with_decision(flat).collect()
    assert all(r["z_20"] is None for r in rows if r["asset"] == "A") and all(r["action"] == "ABSTAIN" for r in rows if r["asset"] == "A")
    assert [r["vol_30"] for r in rows if r["asset"] == "B" and r["t_ms"] >= 35 * DAY] == [None] * 5
    exact = flat.where("asset = 'A'").select(X.exact_std(X.by_time().rowsBetween(-19, 0)).alias("s")).collect()
    assert exact[0]["s"] is None and exact[5]["s"] == 0.0
    kept = X.hold_downsample(spark.createDataFrame([("A", i, "HOLD") for i in range(20)] + [("A", 99, "ENTER_LONG")], "asset string, t_ms long, action string"), 7)
    assert sorted(r["t_ms"] for r in kept.collect()) == [6, 13, 99]


def test_scoring(spark):
    t0 = 1767225600000
    bars = spark.createDataFrame([("A", t0 + i * DAY, float(c)) for i, c in enumerate((100, 110, 105, 103, 102, 101, 99, 90, 95))], "asset string, t_ms long, close double")
    sig = spark.createDataFrame([("s1", "A", t0), ("s2", "A", t0 + 8 * DAY), ("s3", "A", None), ("s4", "Z", t0), ("s5", "A", t0 + 20 * DAY)], "file string, asset string, signal_ms long")
    now = t0 + 9 * DAY
    got = {(r["file"], r["horizon"]): r for r in T.score_signals(sig, bars, F.lit(now)).collect()}
    assert got["s1", 1]["forward_return"] == pytest.approx(0.10) and got["s1", 7]["forward_return"] == pytest.approx(-0.10)
    assert [got[k]["note"] for k in (("s2", 1), ("s2", 7), ("s3", 1), ("s4", 1), ("s5", 1))] == ["pending", "pending", "unparseable time", "no history", "pending"]
    late = {(r["file"], r["horizon"]): r["note"] for r in T.score_signals(sig, bars, F.lit(t0 + 60 * DAY)).collect()}
    assert late["s2", 1] == "gap" and late["s5", 7] == "gap"


# -- proofs: a naive tree -----------------------------------------------------------------------------------------------
def leaf(i):
    return hashlib.sha256(b"\x00" + f"consistency-leaf-{i}".encode()).digest()


def root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + root(leaves[:k]) + root(leaves[k:])).digest()


def path(i, leaves):
    if len(leaves) == 1:
        return []
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return path(i, leaves[:k]) + [root(leaves[k:])] if i < k else path(i - k, leaves[k:]) + [root(leaves[:k])]


def growth(m, leaves, whole=True):
    n = len(leaves)
    if m == n:
        return [] if whole else [root(leaves)]
    k = 1 << (n - 1).bit_length() - 1
    return growth(m, leaves[:k], whole) + [root(leaves[k:])] if m <= k else growth(m - k, leaves[k:], False) + [root(leaves[:k])]


def test_proofs_for_all_small_trees(spark):
    hexes = lambda hs: [h.hex() for h in hs]
    rows, incl = [], []
    for n in range(1, 18):
        ls = [leaf(i) for i in range(n)]
        incl += [(i, n, ls[i].hex(), hexes(path(i, ls)), root(ls).hex()) for i in range(n)]
        rows += [(m, n, root(ls[:m]).hex(), root(ls).hex(), hexes(growth(m, ls))) for m in range(1, n + 1)]
    a = O.audit_inclusion(spark.createDataFrame(incl, "leaf_index long, tree_size long, leaf_hash string, path array<string>, root_hex string"))
    b = O.audit_consistency(spark.createDataFrame(rows, "first_size long, second_size long, first_root string, second_root string, proof array<string>"))
    assert a.where("problem is not null").count() == 0 and b.where("problem is not null").count() == 0
    for m, n, x, y, p in rows:
        if m < n:
            assert H.consistency_problem(m, n, y, x, p) and H.consistency_problem(m, n, x, y, p + [x]) and H.consistency_problem(m, n, x, y, p[:-1])
    assert H.inclusion_problem(5, 5, incl[0][2], [], incl[0][4]) == "index"
    assert H.inclusion_problem(0, 1, "00", [], "00") == "hash-format" and H.consistency_problem(2, 1, "", "", []) == "sizes"
    big = 2**31 + 5
    assert H.consistency_problem(big, big, "ab" * 32, "ab" * 32, []) is None and H.consistency_problem(big, big, "ab" * 32, "cd" * 32, []) == "new-root"


def test_verdicts_and_split_views(spark):
    h = lambda i: f"{i:064x}"
    cp = "struct<origin:string,tree_size:bigint,root_hex:string>"
    rows = [
        (0, ("a", 5, h(1)), ("b", 9, h(2)), [], "SHARD_ROTATED", True), (1, ("a", 5, h(1)), ("a", 4, h(2)), [], "LOG_REGRESSED", True), (2, ("a", 5, h(1)), ("a", 5, h(1)), [], "ROOTS_EQUAL", True),
        (3, ("a", 5, h(1)), ("a", 5, h(3)), [], "SPLIT_VIEW", True), (4, ("a", 5, h(1)), ("a", 6, h(3)), [h(9)], "PREFIX_OK", True), (5, ("a", 5, h(1)), ("a", 5, h(1)), [], "LEDGER_BINDING_MISMATCH", False),
    ]
    df = spark.createDataFrame(rows, f"pos long, engine {cp}, live {cp}, proof array<string>, verdict string, chain_binding_verified boolean")
    got = {r["pos"]: (r["expected"], r["agrees"]) for r in O.gossip_verdict(df).collect()}
    assert got == {0: ("SHARD_ROTATED", True), 1: ("LOG_REGRESSED", True), 2: ("ROOTS_EQUAL", True), 3: ("SPLIT_VIEW", True), 4: ("SPLIT_VIEW", False), 5: ("ROOTS_EQUAL", True)}
    seen = spark.createDataFrame([("o", 7, h(1), "engine", 0), ("o", 7, h(2), "evil", 1), ("o", 8, h(2), "x", 2), ("p", 7, h(5), "y", 3)], "origin string, tree_size long, root_hex string, source string, pos long")
    torn = O.split_views(seen).collect()
    assert [(r["first_source"], r["source"], r["tree_size"]) for r in torn] == [("engine", "evil", 7)]


def test_book_cases():
    d = lambda s, action, price, verdict="ALLOWED": {"symbol": s, "action": action, "price_usd": price, "verdict": verdict}
    cash, held, events, mark = K.advance(10**10, {}, [d("AAA", "ENTER_LONG", 2.0)])
    assert cash == 9_000_000_000 and held["AAA"] == 10**9 * 10**9 // 2_010_000 and mark is not None
    assert K.advance(cash, held, [d("AAA", "ENTER_LONG", 2.0)])[2][0]["why"] == "already long"
    assert K.advance(cash, held, [d("BBB", "ENTER_LONG", 2.0)])[2][0]["why"] == "open position unpriced"
    assert K.advance(0, held, [d("AAA", "HOLD", 2.0), d("BBB", "ENTER_LONG", 1.0)])[2][1]["event"] == "SKIPPED_INSUFFICIENT_CASH"
    out, left, ev, _ = K.advance(cash, held, [d("AAA", "EXIT_LONG", 2.0)])
    assert left == {} and out == cash + held["AAA"] * 1_990_000 // 10**9 and ev[0]["event"] == "SELL"
    assert [K.advance(cash, {}, [x])[2][0]["why"] for x in (d("A", "EXIT_LONG", 1.0), d("A", "ENTER_LONG", None), d("A", "ENTER_LONG", 1.0, "BLOCKED"), d("A", "HOLD", 1.0))] == ["no position", "no price", "blocked", "no book action"]


def test_book_replay_and_audit(spark):
    rows = [("b1", f"r{k:02d}", k * 10 + j, s, a, "ALLOWED", p) for k in range(6) for j, (s, a, p) in enumerate([("AAA", "ENTER_LONG" if k % 3 else "EXIT_LONG", 2.0 + k), ("BBB", "ENTER_LONG", 3.0 + k), ("CCC", "EXIT_LONG", 1.0)])]
    df = spark.createDataFrame(rows, "book_id string, run_dir string, pos long, symbol string, action string, verdict string, price_usd double")
    links = K.book_links(K.book_replay(df))
    assert links.count() == 6 and K.audit_book(links, df).where("not ok").count() == 0
    forged = links.withColumn("cash_micro", F.when(F.col("seq") == 3, "5").otherwise(F.col("cash_micro")))
    assert sorted(r["seq"] for r in K.audit_book(forged, df).where("not ok").collect()) == [3, 4]
    assert [r["difference"] for r in K.audit_book(links.where("seq <> 2"), df).where("seq = 3").collect()] == ["previous link missing"]
    silent = links.withColumn("events", F.when(F.col("seq") == 2, "[]").otherwise(F.col("events")))
    assert [(r["seq"], r["difference"]) for r in K.audit_book(silent, df).where("not ok").collect()] == [(2, "events")]


def test_as_of_is_linear_in_one_asset(spark):
    import time

    n = 200_000
    bars = spark.range(n).select(F.lit("A").alias("asset"), (F.col("id") * 60_000).alias("t_ms"), F.col("id").cast("double").alias("close"))
    sig = spark.range(n).select(F.col("id").alias("file"), F.lit("A").alias("asset"), (F.col("id") * 60_000 + 60_000 * n - 1).alias("at"))
    start = time.time()
    got = T.asof_forward(sig, bars, "at", "b").agg(F.count("b").alias("n"), F.max("b.close").alias("m")).first()
    assert (got["n"], got["m"]) == (0, None)
    near = T.asof_forward(sig.withColumn("at", F.col("at") - 60_000 * n), bars, "at", "b")
    assert near.where("b.close <> file").count() == 0 and near.where("b is null").count() == 0
    assert time.time() - start < 60
    far = spark.createDataFrame([("A", 0, 1.0), ("A", 400 * DAY, 2.0)], "asset string, t_ms long, close double")
    rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate([("A", 0), ("A", 1), ("A", 400 * DAY), ("A", 400 * DAY + 1), ("A", None), ("Z", 5), (None, 5)])], "file int, asset string, at long")
    assert {r["file"]: r["b"] and r["b"]["close"] for r in T.asof_forward(rows, far, "at", "b").collect()} == {0: 1.0, 1: 2.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None}


def test_ordered_steps(spark):
    import random

    from veritick.operators import ordered

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i) for i in rnd.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, o long")
    for ahead in (False, True):
        want = {}
        for key in ("a", "b", None):
            own = sorted((o for k, o in rows if k == key), reverse=ahead)
            want |= {(key, o): p for p, o in zip([None, *own], own, strict=False)}
        got = ordered.with_previous(df, "k", "o", ["o"], "p", ahead).collect()
        assert {(r["k"], r["o"]): r["p"] and r["p"]["o"] for r in got} == want
    values = spark.createDataFrame([(h, float(v) if v % 7 else None) for h in (1, 2) for v in range(100 + h)], "h int, v double")
    got = {r["h"]: r["median"] for r in ordered.exact_median(values, "h", "v").collect()}
    import statistics

    assert got == {h: statistics.median(float(v) for v in range(100 + h) if v % 7) for h in (1, 2)}
    assert ordered.exact_median(values.limit(0), "h", "v").count() == 0


def test_export_rows_and_ceiling(spark):
    import json

    from veritick.operators import sft

    bars = spark.createDataFrame(lcg_bars(120), "asset string, t_ms long, close double")
    sources = spark.createDataFrame([("LCG", "receipts/x.json", "aa", "bb")], "asset string, receipt string, receipt_sha string, dataset_sha string")
    rows = sft.export(bars, sources=sources).collect()
    drill = [r for r in rows if r["action"] == "ABSTAIN"]
    assert len(drill) == 4  # prefixes of other cells reach their look-backs and decide
    user, said = (json.loads(drill[0]["messages"][k]["content"]) for k in (1, 2))
    assert set(user["evidence"]) == {"trailingReturn", "zScore", "annualizedVol", "nObservations"} and None in user["evidence"].values()
    assert said["action"] == "ABSTAIN" and said["note"] and len(said["caveats"]) == 4 and "conviction" not in said
    one = json.loads(next(r for r in rows if r["action"] != "ABSTAIN")["messages"][2]["content"])
    assert set(one) == {"action", "components", "conviction", "lambda", "caveats"} and one["conviction"] <= 0.97
    assert rows[0]["provenance"]["receiptSha256"] == "aa" and rows[0]["provenance"]["datasetSha256"] == "bb"
    with pytest.raises(Exception, match="no source for"):
        sft.export(bars, sources=sources.where("asset = 'none'")).collect()
    with pytest.raises(Exception, match="above the ceiling"):
        sft.messages(sft.derived(bars).withColumn("conviction", F.lit(0.98))).collect()


def test_export_texts_are_written_by_expressions(spark):
    """Texts need no reader of JSON: odd names and numbers come out as by one."""
    import json

    from veritick.functions.helpers import canonical, plain
    from veritick.operators import sft

    names = ['a"\\b', "tab\t\x0b\x1f", "\\u001F", "é\u2028😀", "x"]
    bars = spark.createDataFrame([(a, t, c) for a in names for _, t, c in lcg_bars(90)], "asset string, t_ms long, close double")
    rows = sft.derived(bars).where("bar_idx % 9 = 0 or action = 'ABSTAIN'").withColumn("ret", F.expr("case when bar_idx = 63 then 1e-7 when bar_idx = 72 then 1e21 when bar_idx = 81 then double('NaN') else ret end"))
    made = sft.messages(rows)
    assert "plain_text" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert {r["asset"] for r in got} == set(names)
    for r in got:
        for m in r["messages"][1:]:
            assert plain(json.loads(m["content"])) == m["content"]
        assert json.loads(r["messages"][1]["content"])["asset"] == r["asset"]
    said = {r["bar_idx"]: r["messages"][1]["content"] for r in got if r["action"] != "ABSTAIN"}
    assert '"trailingReturn":1e-7,' in said[63] and '"trailingReturn":1e+21,' in said[72] and '"trailingReturn":"NaN",' in said[81]
    lines = sft.jsonl(made).collect()
    assert len(lines) == len(got) and all(canonical(json.loads(r["value"])) == r["value"] for r in lines)


def test_export_columns_of_texts_are_those_of_single_values():
    """Texts made by Arrow, a column at a time, are those of single values to the last digit; only odd values are written one by one."""
    import random
    import struct

    import pyarrow as pa

    from veritick.functions import helpers as H

    rng = random.Random(4)
    some = [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(2000)] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)]
    some += [None, 0.0, -0.0, 1.0, -3.0, 1e5, 99999.0, 123456789.0, 1e-6, 9.999e-7, 1e21, 5e-324, float("nan"), float("inf"), -float("inf")]
    got = H.number_texts(pa.array([None, *some], pa.float64()).slice(1))
    assert got.to_pylist() == [H.number_or_name(x) for x in some]
    names = [None, "", "plain", 'a"\\b', "tab\t\x0b\x1f\x7f", "\\u001F", "\u00e9\u2028\U0001f600"]
    assert H.quoted_texts(pa.array(["x", *names]).slice(1)).to_pylist() == [H.string_or_null(x) for x in names]
    assert H.few_texts(pa.array([3, None, 3, 7]), H.number_or_name).to_pylist() == ["3", "null", "3", "7"]
    assert len(H.number_texts(pa.array([], pa.float64()))) == 0


def test_exported_texts_are_read_back_in_columns(spark):
    """As ``from_json`` reads them, with no parser a row; a text that is not an object stops the job."""
    import pyarrow as pa

    from veritick.functions.helpers import json_rows
    from veritick.plans import replay_plans

    kind = "a string, b struct<x:double>, c array<string>"
    schema = pa.schema([("a", pa.string()), ("b", pa.struct([("x", pa.float64())])), ("c", pa.list_(pa.field("element", pa.string())))])
    texts = ['{"a":"q\\"\\u001F\\u00e9","b":{"x":1},"c":["1","2"],"more":{"y":[1]}}', '{"b":{"x":null},"c":[]}', '{"a":null,"b":{"x":-2.5e-7}}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fields = ("r.a", "r.b.x", "r.c")
    assert df.select(json_rows(schema, kind)("t").alias("r")).select(*fields).collect() == df.select(F.from_json("t", kind).alias("r")).select(*fields).collect()
    with pytest.raises(Exception, match="JSON"):
        spark.createDataFrame([("no object",)], "t string").select(json_rows(schema, kind)("t")).collect()
    plan = replay_plans.sft_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan


def test_export_lines_are_small_on_disk_and_dealt_as_bars(spark, tmp_path):
    """Lines are packed, files hold ranges of assets in order, and no shuffle carries the many rows that bars are made into."""
    import gzip
    import json

    from veritick.operators import sft
    from veritick.sources import sinks

    bars = spark.createDataFrame([(f"A{a}", t, c * (a + 1)) for a in range(9) for _, t, c in lcg_bars(120)], "asset string, t_ms long, close double")
    rows = sft.derived(bars, placed=True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    sinks.write_jsonl(sft.jsonl(sft.messages(rows)), str(tmp_path / "x"), placed=True, compression="gzip")
    files = [gzip.open(f, "rt").read().splitlines() for f in sorted((tmp_path / "x").glob("part-*.gz"))]
    assert sum(f.stat().st_size for f in (tmp_path / "x").glob("part-*")) * 5 < sum(len(x) for f in files for x in f)
    place = {r["value"]: (r["asset"], r["cell_id"], r["bar_idx"]) for r in sft.jsonl(sft.export(bars)).collect()}
    places = [[(json.loads(x)["provenance"]["sourceReceipt"].split("/")[1], place[x][1], place[x][2]) for x in f] for f in files if f]
    assert len(places) > 1 and all(p == sorted(p) for p in places) and sorted(p for f in places for p in f) == sorted(place.values())
    assert all(a[-1][0] < b[0][0] for a, b in zip(sorted(places), sorted(places)[1:], strict=False))


def test_chain_cases(spark):
    f = "ledger string, run_dir string, name string, sha256 string"
    c = "array<struct<dir:string,files:array<struct<name:string,sha256:string>>>>"
    schema = f"ledger string, seq long, run_dir string, file string, sha256 string, prev struct<run_dir:string,file:string,sha256:string>, covers {c}"
    files = spark.createDataFrame([("l", "r1", "a.json", "1"), ("l", "r1", "b.json", "2"), ("l", "r2", "c.json", "3"), ("l", "r3", "d.json", "4")], f)
    none = spark.createDataFrame([], schema)
    genesis = L.build_chain_link(files.where("run_dir <> 'r3'"), none).first()
    assert genesis["seq"] == 1 and genesis["prev"] is None and [x["dir"] for x in genesis["covers"]] == ["r1", "r2"]
    cover = [("r1", [("a.json", "1"), ("b.json", "2")]), ("r2", [("c.json", "3")])]
    links = spark.createDataFrame([("l", 1, "r2", "chain_0001.receipt.json", "s1", None, cover)], schema)
    nxt = L.build_chain_link(files, links).first()
    assert nxt["seq"] == 2 and nxt["prev"]["sha256"] == "s1" and [x["dir"] for x in nxt["covers"]] == ["r3"]
    assert L.build_chain_link(files.where("run_dir <> 'r3'"), links).count() == 0
    unread = spark.createDataFrame([("l", None, "r2", "x", "s1", None, cover)], schema)
    assert L.build_chain_link(files, unread).first()["error"] == "previous seq unreadable"
    assert [r["problem"] for r in L.audit_chain(links, files).collect()] == ["dir not sealed"]
    two = links.union(spark.createDataFrame([("l", 3, "r3", "chain_0003.receipt.json", "s3", ("r2", "chain_0001.receipt.json", "zz"), [("r3", [("d.json", "X")]), ("r9", [])])], schema))
    assert sorted(r["problem"] for r in L.audit_chain(two, files).collect()) == ["file rewritten", "sealed dir missing", "seq not contiguous from 1"]


def test_file_names(spark):
    names = ["book_12.receipt.json", "book_12.receipt.jsonx", "chain_0001.receipt.json", "chain_001.receipt.json", "obs_0001_5.observation.json", "xtsa_0001_1.receipt.json", None]
    got = [r["k"] for r in spark.createDataFrame([(n,) for n in names], "name string").select(S.classify_file("name")["kind"].alias("k")).collect()]
    assert got == ["book", None, "chain", None, "observation", None, None]


def test_candles_and_sources(spark):
    now = 10 * DAY
    rows = [("P", 8 * 86400, "5", 0), ("P", 8 * 86400, "6", 1), ("P", 9 * 86400, "7", 2), ("P", 10 * 86400, "8", 3), ("P", 7 * 86400, "nan", 4), ("P", 6 * 86400, "x", 5), ("P", 5 * 86400, None, 6)]
    got = I.normalize_candles(spark.createDataFrame(rows, "product string, t_s long, close string, pos long"), F.lit(now)).collect()
    assert sorted((r["t_ms"], r["close"]) for r in got) == [(8 * DAY, 6.0), (9 * DAY, 7.0)]
    s = [("a", "x", 0, 1, None), ("a", "x", 0, 2, 1.0), ("a", "y", 1, 1, 2.0), ("a", "y", 1, 2, 3.0), ("b", "x", 0, 1, 1.0)]
    kept, report = I.choose_source(spark.createDataFrame(s, "asset string, source string, priority int, t_ms long, close double"))
    assert {(r["asset"], r["source"]) for r in kept.collect()} == {("a", "y")}
    assert {r["asset"]: (r["label"], len(r["attempts"])) for r in report.collect()} == {"a": ("REPORTED", 2), "b": ("UNAVAILABLE", 1)}


def test_archive(spark, tmp_path):
    bars = spark.createDataFrame(lcg_bars(5), "asset string, t_ms long, close double")
    path = str(tmp_path / "a")
    assert sinks.archive_series(bars, path).count() == 0
    sinks.archive_series(bars, path)
    files = sinks.read_archive(spark, path).collect()
    assert len(files) == 1 and hashlib.sha256(files[0]["text"].encode()).hexdigest() == files[0]["sha256"]
    pinned = spark.createDataFrame([("LCG", "00")], "asset string, pinned_sha string")
    assert [r["reason"] for r in sinks.archive_series(bars, str(tmp_path / "b"), pinned).collect()] == ["bytes differ from the pinned hash"]
    spark.createDataFrame([("other", files[0]["sha256"])], "text string, sha256 string").write.mode("append").partitionBy("sha256").text(path)
    assert [r["reason"] for r in sinks.archive_series(bars, path).collect()] == ["other bytes are archived under this hash"]
    (tmp_path / "led").mkdir()
    (tmp_path / "led" / "x.json").write_text("{}")
    assert [r["content"] for r in I.binary_files(spark, str(tmp_path / "led")).collect()] == [b"{}"]


def test_receipts_fail_closed(spark):
    gate = lambda *g: '{"verdict":"BLOCKED","gates":[' + ",".join(f'{{"gate":"g","verdict":"{v}","reason":{w}}}' for v, w in g) + "]}"
    block = '{"posture":{"mode":"ADVISORY_PAPER_ONLY","provenTrust":false},"trustCeiling":0.97,"lockedProvenFormulaIds":["F1","F11","F12","F18","F19","F22","F4","F7"],"lambdaStatus":"Conjecture 1"}'
    cases = [
        (gate(("BLOCKED", '"why"')), block, []), (gate(("BLOCKED", '"why"'), ("BLOCKED", "null")), block, ["blocking gate without a reason"]), (gate(("ALLOWED", '"x"')), block, ["blocked without a gate"]),
        (gate(("BLOCKED", '"why"')), None, ["no doctrine"]), (gate(("BLOCKED", '"why"')), block.replace("false", "true"), ["trust not locked"]), (gate(("BLOCKED", '"why"')), block.replace("F7", "F8"), ["locked set"]),
        (gate(("BLOCKED", '"why"')), block.replace("0.97", "0.98"), ["ceiling"]), (gate(("BLOCKED", '"why"')), block.replace("Conjecture 1", "Theorem"), ["status claims a theorem", "status without its conjecture"]),
    ]
    rows = [(str(i), "application/vnd.in-toto+json", "k", "k", True, "https://in-toto.io/Statement/v1", p, d) for i, (p, d, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "path string, payload_type string, key_id string, pinned_key_id string, sig_ok boolean, statement_type string, payload string, doctrine string")
    got = {}
    for r in L.audit_receipts(df.withColumn("subject_sha", H.canonical_digest("payload"))).collect():
        got.setdefault(int(r["path"]), []).append(r["problem"])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(w) for i, (_, _, w) in enumerate(cases) if w}


def test_empty_tables(spark):
    bars = spark.createDataFrame([], "asset string, t_ms long, close double")
    assert B.walk_forward(bars).count() == 0 and X.with_decision(bars).count() == 0
    sig = spark.createDataFrame([], "file string, asset string, signal_ms long")
    assert T.track_aggregates(T.score_signals(sig, bars, F.lit(0))).count() == 0
