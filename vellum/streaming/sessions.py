"""Streams of events: once-only messages, inactivity sessions, the two files of a session and the wait for the second.

Keyed state lives in RocksDB on disk; timers follow the watermark, so a result depends on the events' own times and not on how they
are dealt over triggers. A key's events of one trigger are put in order in memory: bound a trigger by the source's options.
Events that come later than the watermark allows are left out, as by any windowed aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed values, in seconds: how long a message is remembered, a session lasts idle, and a request waits for a second file.
MESSAGE_TTL, SESSION_IDLE, SECOND_FILE_WAIT = 300, 1800, 10

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SECOND = 1_000_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, streams that start keep their state in RocksDB, as keyed values, lists and timers need."""
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Timed(StatefulProcessor):
    """A processor with one timer a key at most, at `due` microseconds; None: none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due long")

    def schedule(self, due: int | None) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        millis = None if due is None else -(-due // 1000)
        if millis == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if millis is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(millis)
            self.timer.update((millis,))

    def close(self) -> None:
        pass


class Once(_Timed):
    """Keeps an event if none of its key was kept in the `wait` microseconds before; state: when the last one was kept."""

    def __init__(self, wait: int, names: list[str]):
        self.wait, self.names = wait, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = before = self.kept.get()[0] if self.kept.exists() else None
        for at, order in sorted((r["at"], r["order"]) for r in rows):
            if last is None or at >= last + self.wait:
                last = at
                yield Row(*self.names)(*key, at, order)
        if last != before:
            self.kept.update((last,))
            self.schedule(last + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the watermark has passed the last one's time to live: the next event is kept whatever it is
        self.kept.clear()
        self.timer.clear()
        return iter(())


def once(events: DataFrame, key: list[str], ts: str, order: str, seconds: int = MESSAGE_TTL, late: str = "0 seconds") -> DataFrame:
    """A stream's events (key, ts, order) that are kept: none of their key was kept in the `seconds` before.

    Only kept events start the time anew, so a key that never rests is let through once every `seconds`. Of events at one time
    the least `order` counts as the first. Events without a time are left out. Start the query inside keyed_state().
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    stamp = F.col(ts).cast("timestamp")
    rows = events.where(F.col(ts).isNotNull()).select(*named, stamp.alias("stamp"), F.unix_micros(stamp).alias("at"), F.col(order).alias("order"))
    out = T.StructType([*[T.StructField(f"k{i}", types[k]) for i, k in enumerate(key)], T.StructField("at", T.LongType()), T.StructField("order", types[order])])
    grouped = rows.withWatermark("stamp", late).groupBy(*[f"k{i}" for i in range(len(key))])
    kept = grouped.transformWithState(Once(seconds * SECOND, out.names), out, "append", "EventTime")
    return kept.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.timestamp_micros("at").alias(ts), F.col("order").alias(order))


def once_batch(events: DataFrame, key: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """Batch form: an event is kept if none of its key was kept in the `seconds` before; only kept ones start the time anew.

    Each task steps through its keys in order of time, a batch of rows after the other, and carries over when the last
    one was kept; a key's events are never held together, however many there are.
    """
    cols = [*key, ts, order]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(F.col(ts).isNotNull()).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)], micros.alias("_at"), F.hash(*key).alias("_h"), F.struct("*").alias("_row"))
    names = [f"_{i}" for i in range(len(key))]
    same = [*names, "_at", f"_{len(cols) - 1}"]
    kept_schema = T.StructType([f for f in rows.schema.fields if f.name in (*names, "_at", f"_{len(cols) - 1}")])

    def step(batches):
        now, last = None, None
        for batch in batches:
            keep = []
            for k in zip(*[batch.column(n).to_pylist() for n in names], batch.column("_at").to_pylist(), strict=True):
                if k[:-1] != now or k[-1] - last >= seconds * 1_000_000:
                    now, last = k[:-1], k[-1]
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = rows.repartition(*names).sortWithinPartitions(*same).select(*[f.name for f in kept_schema.fields], "_row")
    return dealt.mapInArrow(step, dealt.schema).select("_row.*")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", seconds: int = SESSION_IDLE) -> DataFrame:
    """Sessions by inactivity; of a batch, or of a stream that has a watermark."""
    s = events.groupBy(user, F.session_window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


FILE = "role string, file_name string, file_key string, message_id long, at long"
CHANGES = f"user_id long, session long, status string, n_files int, at timestamp, files array<struct<{FILE.replace(' ', ':').replace(',:', ',')}>>"


class FileSessions(_Timed):
    """The sessions of one user. State: how many there were, the one that lasts, and its files as a list.

    The number stays for ever; the session and its files go once the watermark has passed its idle time.
    """

    def __init__(self, idle: int, wait: int):
        self.idle, self.wait = idle, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.number = handle.getValueState("number", "n long")
        self.session = handle.getValueState("session", "status string, last long, until long, asked boolean")
        self.files = handle.getListState("files", FILE)

    def _load(self) -> None:
        self.n = self.number.get()[0] if self.number.exists() else 0
        self.now = tuple(self.session.get()) if self.session.exists() else None
        self.held = [tuple(f) for f in self.files.get()] if self.files.exists() else []

    def _store(self) -> None:
        if self.now is None:
            self.session.clear()
            self.files.clear()
            self.schedule(None)
            return
        status, last, until, _ = self.now
        self.number.update((self.n,))
        self.session.update(self.now)
        self.files.put(self.held) if self.held else self.files.clear()
        self.schedule(last + self.idle if until is None else min(until, last + self.idle))

    def _row(self, user, at: int) -> Row:
        files = [Row(role=r, file_name=n, file_key=k, message_id=m, at=t) for r, n, k, m, t in self.held]
        stamp = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=at)
        return Row(user_id=user, session=self.n, status=self.now[0], n_files=len(self.held), at=stamp, files=files)

    def _until(self, user, at: int) -> Iterator[Row]:
        """What comes due until `at`: a request that has waited goes on, an idle session ends."""
        if self.now and self.now[2] is not None and self.now[2] <= at and self.now[2] < self.now[1] + self.idle:
            due = self.now[2]
            self.now = ("processing", due, None, True)
            yield self._row(user, due)
        if self.now and at >= self.now[1] + self.idle:
            self.now, self.held = None, []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        user = key[0]
        for at, message, kind, name, file_key in sorted((r["at"], r["message_id"], r["kind"], r["file_name"], r["file_key"]) for r in rows):
            yield from self._until(user, at)
            status, last, until, asked = self.now or ("none", 0, None, False)
            if kind == "file":
                if status in ("none", "done", "failed") or asked:
                    self.n, self.held = self.n + 1, [("first", name, file_key, message, at)]
                    self.now = ("waiting", at, None, False)
                else:
                    self.held = [*self.held, ("second", name, file_key, message, at)]
                    self.now = ("processing", at, None, False)
            elif kind == "ask" and status == "waiting" and until is None:
                self.now = (status, last, at + self.wait, False)
                continue
            elif kind in ("done", "failed") and status == "processing":
                self.now = (kind, at, None, False)
            else:
                continue
            yield self._row(user, at)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.timer.clear()
        yield from self._until(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._store()


def file_sessions(events: DataFrame, seconds: int = SESSION_IDLE, wait: int = SECOND_FILE_WAIT, late: str | None = None) -> DataFrame:
    """A stream of each change of a user's sessions. events: user_id, ts, kind, message_id, file_name, file_key.

    A `file` opens a session, numbered from 1 for each user, that waits for a second one; a second file starts processing, and
    the files of both come out with role, name, key and message id. An `ask` for a comparison with one file waits `wait`
    seconds for another and then goes on with what is there; a file that comes later opens the next session. `done` and `failed` end
    a session that is processing. After an end, or idle for `seconds`, the next file opens a new session.
    Of events at one time the least message_id comes first. Start the query inside keyed_state().
    """
    stamp = F.col("ts").cast("timestamp")
    rows = events.where(F.col("ts").isNotNull()).select("user_id", stamp.alias("stamp"), F.unix_micros(stamp).alias("at"), F.coalesce("message_id", F.lit(0)).cast("long").alias("message_id"),
                                                       *[F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "file_name", "file_key")])
    timed = rows.withWatermark("stamp", late or f"{seconds} seconds").groupBy("user_id")
    return timed.transformWithState(FileSessions(seconds * SECOND, wait * SECOND), CHANGES, "append", "EventTime")
