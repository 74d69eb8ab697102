import os
import pathlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vellum.operators import metrics
from vellum.streaming import sessions

START = datetime(2024, 1, 1)


def test_once_counts_from_the_last_one_kept(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", at(s), s) for s in (598, 299, 600, 301)] + [("b", at(0), 1), ("b", at(0), 0), (None, at(5), 7), (None, at(6), 8), ("c", None, 9)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, _at long")
    got = {(r.key, r._at) for r in sessions.once_batch(df, ["key"], "ts", "_at", 300).collect()}
    assert got == {("a", 299), ("a", 600), ("b", 0), (None, 7)}
    assert sessions.once_batch(df.limit(0), ["key"], "ts", "_at", 300).count() == 0


def test_once_over_many_batches(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), START + timedelta(seconds=r.randint(0, 90_000)), i) for i in range(5_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x.id for x in sessions.once_batch(spark.createDataFrame(rows, "key string, ts timestamp, id long"), ["key"], "ts", "id", 300).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if k not in last or (t - last[k]).total_seconds() >= 300:
            last[k] = t
            want.add(i)
    assert got == want


def streamed(spark, tmp_path, rows, schema, one_by_one, make):
    """What make(stream) gives for rows, one of them a trigger or all in one."""
    folder = f"{tmp_path}/{'one' if one_by_one else 'all'}"
    for i, part in enumerate([[r] for r in rows] if one_by_one else [rows]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{i:04d}")
        for f in pathlib.Path(f"{folder}/in/{i:04d}").glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes files by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = make(stream)
    with sessions.keyed_state(spark):
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


@pytest.mark.parametrize("one_by_one", [True, False])
def test_once_on_a_stream(spark, tmp_path, one_by_one):
    seconds = [("a", 0), ("b", 0), ("a", 299), ("a", 301), ("c", 400), ("b", 500), ("a", 600), ("a", 602), (None, 610), (None, 650), ("b", 799), ("b", 800)]
    rows = [(k, START + timedelta(seconds=s), i) for i, (k, s) in enumerate(seconds)]
    got = streamed(spark, tmp_path, rows, "key string, ts timestamp, id long", one_by_one, lambda e: sessions.once(e, ["key"], "ts", "id", late="10 seconds"))
    assert sorted((r.key or "-", (r.ts - START).total_seconds()) for r in got) == [("-", 610), ("a", 0), ("a", 301), ("a", 602), ("b", 0), ("b", 500), ("b", 800), ("c", 400)]
    assert sorted(r.id for r in got) == [0, 1, 3, 4, 5, 7, 8, 11]


@pytest.mark.parametrize("one_by_one", [True, False])
def test_user_sessions_on_a_stream(spark, tmp_path, one_by_one):
    seconds = [(1, 0), (2, 100), (1, 1_700), (1, 3_600), (2, 9_000), (3, 90_000)]
    rows = [(u, START + timedelta(seconds=s)) for u, s in seconds]
    got = streamed(spark, tmp_path, rows, "user_id long, ts timestamp", one_by_one, lambda e: sessions.sessions(e.withWatermark("ts", "10 seconds")))
    told = sorted((r.user_id, (r.session_start - START).total_seconds(), (r.session_end - START).total_seconds(), r.n_events) for r in got)
    # the last one may still go on
    assert told == [(1, 0, 3_500, 2), (1, 3_600, 5_400, 1), (2, 100, 1_900, 1), (2, 9_000, 10_800, 1)]


EVENTS = "user_id long, ts timestamp, kind string, message_id long, file_name string, file_key string"


def files_of(spark, tmp_path, events, one_by_one, **more):
    rows = [(u, START + timedelta(microseconds=int(s * 1e6)), kind, i, f"n{i}", f"k{i}") for i, (u, s, kind) in enumerate(events)]
    got = streamed(spark, tmp_path, rows, EVENTS, one_by_one, lambda e: sessions.file_sessions(e, 1800, 10, "2 seconds", **more))
    told = lambda r: (r.user_id, (r.at - START).total_seconds(), r.session, r.status, [(f.role, f.file_name, f.file_key, f.message_id) for f in r.files])
    assert all(r.n_files == len(r.files) for r in got)
    return sorted(map(told, got))


@pytest.mark.parametrize("one_by_one", [True, False])
def test_sessions_inside_one_second_are_told_apart(spark, tmp_path, one_by_one):
    events = [(1, t / 10, k) for t, k in enumerate(["file", "file", "done", "file", "file", "failed"])]
    file = lambda role, i: (role, f"n{i}", f"k{i}", i)
    got = files_of(spark, tmp_path, events, one_by_one)
    first, second = [file("first", 0), file("second", 1)], [file("first", 3), file("second", 4)]
    assert got == [(1, 0.0, 1, "waiting", first[:1]), (1, 0.1, 1, "processing", first), (1, 0.2, 1, "done", first), (1, 0.3, 2, "waiting", second[:1]), (1, 0.4, 2, "processing", second), (1, 0.5, 2, "failed", second)]


@pytest.mark.parametrize("one_by_one", [True, False])
def test_a_request_waits_for_a_second_file(spark, tmp_path, one_by_one):
    events = [(1, 0, "file"), (1, 1, "ask"), (1, 5, "file"), (2, 100, "file"), (2, 101, "ask"), (2, 103, "ask"), (3, 109, "file"), (2, 112, "file"), (2, 113, "done"), (2, 114, "file"), (4, 3_000, "ask"), (3, 3_000, "file"), (4, 5_000, "view")]
    got = files_of(spark, tmp_path, events, one_by_one)
    changes = [(u, at, n, status, len(f)) for u, at, n, status, f in got]
    assert changes == [
        (1, 0, 1, "waiting", 1), (1, 5, 1, "processing", 2),  # the second file came in time
        (2, 100, 1, "waiting", 1), (2, 111, 1, "processing", 1),  # it didn't: on with one file, ten seconds after the first request
        (2, 112, 2, "waiting", 1), (2, 114, 2, "processing", 2),  # a late file opens the next session; an end needs one that is processing
        (3, 109, 1, "waiting", 1), (3, 3_000, 2, "waiting", 1),  # idle too long
    ]


def test_places_in_order_of_any_group(spark):
    r = random.Random(2)
    rows = [(r.choice("aaaaab"), r.choice([None, *range(40)])) for _ in range(3_000)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v int")
    got = {x.key: (x.low, x.mid, x.n) for x in metrics.at_places(df, ["key"], "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2)}).collect()}
    for k in "ab":
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (v[0], v[len(v) // 2], len(v))
    assert got["one"] == (5, 5, 1) and "none" not in got
