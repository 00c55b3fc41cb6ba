"""The paper book as a stream: runs split over batches, late rows, and the number kept between starts."""

import datetime

import pytest
from pyspark.sql import functions as F

from veritick.operators import book
from veritick.streaming import jobs

SCHEMA = "book_id string, run_dir string, pos long, symbol string, action string, verdict string, price_usd double, ts timestamp"


def day(n, hour=0):
    return datetime.datetime(2026, 1, 1, hour) + datetime.timedelta(days=n)


@pytest.fixture
def feed(spark, tmp_path):
    """Runs the stream over one more batch of rows, from its checkpoint."""

    def take(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = jobs.paper_book(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)  # few stores of state, for speed
    yield take
    spark.conf.set("spark.sql.shuffle.partitions", before)


FLUSH = [("~", "~", 0, "~", "HOLD", "ALLOWED", 1.0, day(400))]


def test_keeps_its_number_between_batches(feed):
    for batch in (1, 2):
        got = feed([("b", f"r{batch}{k}", 1, "A", "HOLD", "ALLOWED", 1.0, day(batch * 5 + k)) for k in range(2)])
    got = feed(FLUSH)
    assert sorted((r["run_dir"], r["seq"]) for r in got) == [("r10", 1), ("r11", 2), ("r20", 3), ("r21", 4)]


def test_a_run_in_several_batches_gives_the_batch_result(spark, feed):
    rows = []
    for d in range(12):
        for b in ("x", "y", "z"):
            for k, symbol in enumerate("CAB"):
                action = ("ENTER_LONG", "EXIT_LONG", "HOLD", "ENTER_LONG")[(d + k) % 4]
                rows.append((b, f"run-{d:02d}", k, symbol, action, "ALLOWED" if (d + k) % 5 else "BLOCKED", 10.0 + d + k if (d * k) % 7 != 3 else None, day(d, 2 * k)))
    parts = [[], [], []]
    for i, r in enumerate(rows):
        parts[min(2, (rows.index(r) // 9 + (i % 3 == 2)) // 4)].append(r)  # every third row comes with the next days
    for part in parts:
        got = feed(part[::-1])
    got = feed(FLUSH)
    split = [{r[1] for r in part} for part in parts]
    assert split[0] & split[1] and split[1] & split[2]  # runs that are split
    cols = [c for c in book.COLUMNS if c != "book_id"]
    want = book.book_replay(spark.createDataFrame(rows, SCHEMA).drop("ts")).collect()
    assert sorted(map(str, ([r["book_id"], *[r[c] for c in cols]] for r in got))) == sorted(map(str, ([r["book_id"], *[r[c] for c in cols]] for r in want)))


def test_late_rows_come_out_and_change_nothing(feed):
    feed([("b", "r1", 1, "A", "ENTER_LONG", "ALLOWED", 10.0, day(1)), ("b", "r3", 1, "A", "EXIT_LONG", "ALLOWED", 11.0, day(30))])
    feed(FLUSH)
    got = feed([("b", "r1", 2, "B", "ENTER_LONG", "ALLOWED", 5.0, day(1, 1)), ("b", "r2", 1, "B", "ENTER_LONG", "ALLOWED", 5.0, day(2)), (None, "r9", 1, "B", "HOLD", "ALLOWED", 5.0, day(2)), ("b", "r4", 1, None, "HOLD", "ALLOWED", 5.0, day(401))])
    late = sorted((r["run_dir"], r["symbol"], r["seq"], r["why"]) for r in got if r["event"] == jobs.LATE)
    assert late == [("r1", "B", None, "run is closed"), ("r2", "B", None, "run is closed")]
    rest = sorted((r["run_dir"], r["event"], r["seq"]) for r in got if r["event"] != jobs.LATE)
    assert rest == [("r1", "BUY", 1), ("r3", "SELL", 2)]


def test_an_open_run_holds_back_those_after_it(feed):
    """A run heard of on the last day is open; a later one that is long over waits for it."""
    got = feed([("b", "r1", 1, "A", "ENTER_LONG", "ALLOWED", 10.0, day(20)), ("b", "r2", 1, "A", "EXIT_LONG", "ALLOWED", 12.0, day(3))])
    assert got == []
    got = feed([("c", "r0", 1, "A", "HOLD", "ALLOWED", 1.0, day(25))])
    assert sorted((r["book_id"], r["run_dir"], r["event"], r["seq"]) for r in got) == [("b", "r1", "BUY", 1), ("b", "r2", "SELL", 2)]
