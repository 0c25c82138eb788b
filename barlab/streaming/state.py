"""Streams with state by account or symbol: opening baselines, heartbeats, tick cursors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barlab.operators.account import fresh

OPENINGS = "account long, reading long, read_at long, ticket long, opened_at long, first_seen long, moved boolean, refusal string"
BEATS = "account long, last long, age long, clear boolean"


def _with_state_store(spark: SparkSession) -> None:
    """State with several variables and timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Openings(StatefulProcessor):
    """The first opening of each ticket that the account's last accepted reading showed, and that reading's number and time."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "ticket long", "opened_at long")
        self.last = handle.getValueState("last", "reading long, read_at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        readings = pd.concat([*rows]).sort_values("reading")
        number, at = self.last.get() if self.last.exists() else (None, None)
        held = {k[0]: v[0] for k, v in self.first.iterator()}
        before, out = dict(held), []
        for reading, read_at, positions in zip(readings["reading"], readings["read_at"], readings["positions"], strict=True):
            reading, read_at = int(reading), int(read_at)
            if number is not None and reading == number:
                continue
            shown = [] if positions is None else sorted((p["ticket"], p["opened_at"]) for p in positions)
            refusal = "READING_ORDER" if number is not None and reading < number else "READING_CLOCK" if at is not None and read_at < at else None
            if refusal:
                out.extend((key[0], reading, read_at, t, o, None, None, refusal) for t, o in shown or [(None, None)])
                continue
            number, at = reading, read_at
            if positions is None:
                continue
            was, held = held, {}
            for t, o in shown:
                first = held.setdefault(t, was.get(t, o))
                moved = abs(o - first) > self.tolerance
                out.append((key[0], reading, read_at, t, o, first, moved, "POSITION_AGE_MOVED" if moved else None))
        for t in before.keys() - held.keys():
            self.first.removeKey((t,))
        for t, o in held.items():
            if before.get(t) != o:
                self.first.updateValue((t,), (o,))
        if number is not None:
            self.last.update((number, at))
        names = [c.split()[0] for c in OPENINGS.split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        yield frame.astype({c: "Int64" for c in names[:6]} | {"moved": "boolean"})

    def close(self) -> None:
        pass


def openings_stream(readings: DataFrame, tolerance: int = 1) -> DataFrame:
    """A stream of readings (account, reading, read_at, positions array<struct<ticket, opened_at>>), one row each, compared with the openings first seen.

    A ticket's first opening counts until an accepted reading of its own account doesn't show it, however long
    the account is silent and whatever the others do; it never changes before that, so a wrong reading can't heal itself. A ticket that
    moved by more than the tolerance is POSITION_AGE_MOVED. A reading timed before the account's last accepted one is
    refused whole (READING_CLOCK), one numbered before it too (READING_ORDER), and neither changes anything; the last one again is passed over.
    Positions that could not be read (null) close nothing. account.check_readings does the same to a table."""
    _with_state_store(readings.sparkSession)
    own = readings.select("account", "reading", "read_at", "positions").where("account is not null and reading is not null and read_at is not null")
    return own.groupBy("account").transformWithStateInPandas(_Openings(tolerance), OPENINGS, "Append", "None")


class _Heartbeat(StatefulProcessor):
    """The time of the account's last reading, whether it was told stale, and a timer for when it will be."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, told boolean")

    def _wait(self, until_ms: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if until_ms is not None:
            self.handle.registerTimer(until_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.seen.update((None, False))
        self._wait(timerValues.getCurrentProcessingTimeInMs() + self.stale * 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, told = self.seen.get() if self.seen.exists() else (None, False)
        last = max(int(pd.concat([*rows])["reading_at"].max()), -(2**62) if last is None else last)
        now = timerValues.getCurrentProcessingTimeInMs() // 1000
        clear = fresh(now - last, self.stale)
        self._wait((last + self.stale + 1) * 1000 if clear else None)
        self.seen.update((last, not clear))
        if clear == told:
            yield self._row(key, last, now, clear)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, _ = self.seen.get()
        self.seen.update((last, True))
        yield self._row(key, last, timerValues.getCurrentProcessingTimeInMs() // 1000, False)

    def _row(self, key: Any, last: int | None, now: int, clear: bool) -> pd.DataFrame:
        whole = lambda x: pd.array([x], dtype="Int64")
        return pd.DataFrame({"account": whole(key[0]), "last": whole(last), "age": whole(None if last is None else now - last), "clear": [clear]})

    def close(self) -> None:
        pass


def heartbeat_stream(expected: DataFrame, readings: DataFrame, stale: int = 180) -> DataFrame:
    """(account, last, age, clear) whenever an account turns stale or clear again, from a stream of readings (account, reading_at in seconds).

    Each expected account (a table) has a timer on the cluster's clock from the start, so one that never sends a reading turns
    stale, too, with last and age null; accounts that aren't expected are watched from their first reading. The rule is that of account.heartbeat."""
    _with_state_store(readings.sparkSession)
    start = expected.select("account").where("account is not null").distinct().groupBy("account")
    own = readings.select("account", "reading_at").where("account is not null and reading_at is not null")
    return own.groupBy("account").transformWithStateInPandas(_Heartbeat(stale), BEATS, "Append", "ProcessingTime", initialState=start)


class _Cursor(StatefulProcessor):
    """The symbol's largest millisecond and the digests of its ticks there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "time_msc long")
        self.there = handle.getMapState("there", "digest string", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ticks = pd.concat([*rows]).sort_values("time_msc", kind="stable").drop_duplicates("digest")
        at = self.at.get()[0] if self.at.exists() else None
        known = {k[0] for k in self.there.keys()}
        if at is not None:
            ticks = ticks[(ticks["time_msc"] > at) | ((ticks["time_msc"] == at) & ~ticks["digest"].isin(known))]
        if len(ticks):
            new = int(ticks["time_msc"].max())
            if new != at:
                self.there.clear()
                self.at.update((new,))
            for digest in ticks.loc[ticks["time_msc"] == new, "digest"]:
                self.there.updateValue((digest,), (True,))
        yield ticks.drop(columns="digest")

    def close(self) -> None:
        pass


def after_cursor(ticks: DataFrame) -> DataFrame:
    """Ticks (symbol, time_msc, ...) that are new to their symbol: later than its cursor, or at the same millisecond and not there yet.

    The cursor is the largest millisecond accepted with the digests of all ticks at it, kept in the stream's checkpoint. What is fetched
    again is dropped whatever its age, and different ticks of one millisecond all stay, across batches and restarts.
    Within a batch ticks go by time. Ticks without a time are no ticks."""
    _with_state_store(ticks.sparkSession)
    columns = [f"`{c}`" for c in ticks.columns]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    timed = ticks.where("time_msc is not null").withColumns({"symbol": F.coalesce("symbol", F.lit("")), "digest": digest})
    return timed.groupBy("symbol").transformWithStateInPandas(_Cursor(), ticks.schema, "Append", "None")
