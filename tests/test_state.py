"""Streams with state: opening baselines, heartbeats and tick cursors, over restarts."""

import time

from barlab.operators import account as ac
from barlab.streaming import jobs, state

READING = "account long, reading long, read_at long, positions array<struct<ticket: long, opened_at: long>>"
DAY = 86_400


def run(stream, tmp_path, name="o"):
    stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()


def rows_of(df):
    return sorted((tuple(r) for r in df.select("account", "reading", "read_at", "ticket", "opened_at", "first_seen", "moved", "refusal").collect()), key=str)


def in_batches(spark, tmp_path, batches):
    """What the stream gives for batches of readings, the query restarted before each."""
    for rows in batches:
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        run(state.openings_stream(spark.readStream.schema(READING).parquet(str(tmp_path / "r"))), tmp_path)
    return rows_of(spark.read.parquet(str(tmp_path / "o")))


def test_baseline_outlives_its_accounts_silence(spark, tmp_path):
    """Account 1 is silent for three days while account 2 goes on; its moved opening is still told."""
    batches = [
        [(1, 0, 1000, [(1, 100), (2, 5)]), (2, 0, 1000, [(9, 50)])],
        [(2, n, 1000 + n * DAY // 4, [(9, 50)]) for n in range(1, 13)],
        [(2, 13, 1000 + 4 * DAY, []), (1, 1, 1000 + 3 * DAY, [(1, 500), (2, 5)])],
        [(2, 14, 1000 + 5 * DAY, [(9, 70)]), (1, 2, 1000 + 4 * DAY, [(2, 6)])],
        [(1, 3, 1000 + 5 * DAY, [(1, 700), (2, 7)])],
    ]
    got = in_batches(spark, tmp_path, batches)
    at = {(r[0], r[1], r[3]): r[5:] for r in got}
    assert at[1, 1, 1] == (100, True, "POSITION_AGE_MOVED") and at[1, 1, 2] == (5, False, None)
    # 9 was closed by an empty reading and 1 by one without it: their numbers are new positions
    assert at[2, 14, 9] == (70, False, None) and at[1, 3, 1] == (700, False, None)
    assert at[1, 2, 2] == (5, False, None) and at[1, 3, 2] == (5, True, "POSITION_AGE_MOVED")
    assert got == rows_of(ac.check_readings(spark.createDataFrame([r for b in batches for r in b], READING)))


def test_reading_time_must_not_go_back(spark, tmp_path):
    """A reading timed before the last accepted one is refused whole and changes nothing, in one batch or over two."""
    rows = [(1, 0, 1000, [(1, 100), (3, 8)]), (1, 1, 900, [(1, 400), (2, 7)]), (1, 2, 950, []), (1, 3, 1001, [(1, 101), (2, 9), (3, 8)]), (1, 4, 1001, None), (1, 5, 1002, [(1, 102)])]
    want = [(1, 0, 1000, 1, 100, 100, False, None), (1, 0, 1000, 3, 8, 8, False, None), (1, 1, 900, 1, 400, None, None, "READING_CLOCK"),
        (1, 1, 900, 2, 7, None, None, "READING_CLOCK"), (1, 2, 950, None, None, None, None, "READING_CLOCK"), (1, 3, 1001, 1, 101, 100, False, None),
        (1, 3, 1001, 2, 9, 9, False, None), (1, 3, 1001, 3, 8, 8, False, None), (1, 5, 1002, 1, 102, 100, True, "POSITION_AGE_MOVED")]
    want = sorted(want, key=str)
    assert rows_of(ac.check_readings(spark.createDataFrame(rows, READING))) == want
    assert in_batches(spark, tmp_path / "a", [rows]) == want
    # a replayed reading is passed over, an old number refused
    again = in_batches(spark, tmp_path / "b", [rows[:2], rows[2:4], [rows[3]], rows[4:], [(1, 2, 5000, [(1, 100)])]])
    assert again == sorted([*want, (1, 2, 5000, 1, 100, None, None, "READING_ORDER")], key=str)


def test_silent_account_turns_stale_without_any_input(spark, tmp_path):
    schema = "account long, reading_at long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    write([(1, int(time.time())), (3, 5)])
    expected = spark.createDataFrame([(1,), (2,)], "account long")
    stream = state.heartbeat_stream(expected, spark.readStream.schema(schema).parquet(str(tmp_path / "r")), stale=12)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        told = lambda: [tuple(r) for r in spark.read.schema(state.BEATS).parquet(str(tmp_path / "o")).select("account", "last", "clear").collect()]
        until = time.time() + 90
        while time.time() < until and not {1, 2, 3} <= {r[0] for r in told()}:
            time.sleep(1)
        stale = {r[0]: r for r in told()}
        assert stale[2] == (2, None, False) and stale[1][2] is False and stale[3] == (3, 5, False)
        write([(1, int(time.time()) + 60)])
        until = time.time() + 60
        while time.time() < until and not any(r[0] == 1 and r[2] for r in told()):
            time.sleep(1)
        assert [r[2] for r in sorted(told(), key=lambda r: (r[0], r[1] or 0))] == [False, True, False, False]
    finally:
        query.stop()
    batch = ac.heartbeat(expected, spark.createDataFrame([(1, 100), (3, 5)], schema), now=113, stale=12)
    assert {r["account"]: r["clear"] for r in batch.collect()} == {1: False, 2: False}


def test_tick_cursor_survives_restarts_and_late_fetches(spark, tmp_path):
    head = ",".join(c.split()[0] for c in jobs.TICK_SCHEMA.split(", ")) + "\n"
    tick = lambda msc, bid: f"{msc // 1000},{msc},{bid},2,0,0,2,0\n"

    def fetch(symbol, name, *ticks):
        folder = tmp_path / f"in/symbol={symbol}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(head + "".join(tick(*t) for t in ticks))

    def restart():
        jobs.write_ticks(jobs.ingest_ticks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted((r["symbol"], r["time_msc"], r["bid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    fetch("a", "1.csv", (1000, 1), (1000, 1), (1000, 2), (500, 3))
    fetch("b", "1.csv", (7 * DAY * 1000, 1))
    assert restart() == [("a", 500, 3.0), ("a", 1000, 1.0), ("a", 1000, 2.0), ("b", 7 * DAY * 1000, 1.0)]
    # the same again days later, one more of the last millisecond, and new ones; b's time doesn't hold for a
    fetch("a", "2.csv", (500, 3), (1000, 2), (1000, 9), (1001, 4), (9 * DAY * 1000, 5))
    assert restart()[3:5] == [("a", 1000, 9.0), ("a", 1001, 4.0)]
    fetch("a", "3.csv", (500, 3), (1000, 1), (9 * DAY * 1000, 5), (9 * DAY * 1000, 6))
    got = restart()
    assert [r for r in got if r[0] == "a"] == [("a", 500, 3.0), ("a", 1000, 1.0), ("a", 1000, 2.0), ("a", 1000, 9.0), ("a", 1001, 4.0), ("a", 9 * DAY * 1000, 5.0), ("a", 9 * DAY * 1000, 6.0)]
    days = {str(r["server_day"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert days == {"1970-01-01", "1970-01-08", "1970-01-10"}
