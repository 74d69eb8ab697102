import glob
import os

import pytest
from pyspark.sql import functions as F
from vellum.operators import stored
from vellum.streaming import recovery

RISKS = "task_id int, risk string, weight double"


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_a_rerun_touches_its_own_task_only(spark, tmp_path):
    path = f"{tmp_path}/risks"
    rows = spark.createDataFrame([(t, f"r{i}", float(i)) for t in (1, 2, 3) for i in range(3)], RISKS)
    every = spark.createDataFrame([(1,), (2,), (3,)], "task_id int")
    stored.rerun(rows, every, path)
    read = lambda: sorted(map(tuple, stored.children(spark, path, rows.schema).collect()))
    before = files_of(path)
    for _ in range(2):
        stored.rerun(spark.createDataFrame([(2, "new", 9.0), (3, "not asked for", 1.0)], RISKS), spark.createDataFrame([(2,)], "task_id int"), path)
        assert read() == sorted([(t, f"r{i}", float(i)) for t in (1, 3) for i in range(3)] + [(2, "new", 9.0)])
        now = files_of(path)
        assert {f: t for f, t in before.items() if "task_id=2" not in f} == {f: t for f, t in now.items() if "task_id=2" not in f}
    stored.rerun(rows.limit(0), spark.createDataFrame([(1,)], "task_id int"), path)
    assert {r[0] for r in read()} == {2, 3}
    plan = stored.children(spark, path, rows.schema).where("task_id = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(task_id" in plan


def test_keyed_tables(spark, tmp_path):
    users = stored.Keyed(spark, f"{tmp_path}/users", spark.createDataFrame([], "id string, name string, seq int").schema, "id", buckets=4)
    posts = stored.Keyed(spark, f"{tmp_path}/posts", spark.createDataFrame([], "post int, id string").schema, "post", by="id", buckets=4)
    make = lambda *rows: spark.createDataFrame(rows, "id string, name string, seq int")
    read = lambda t: sorted(map(tuple, t.rows().collect()))
    users.create(make(("a", "Ann", 0), ("b", "Bo", 0), ("007", "Bond", 0)))
    posts.create(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "post int, id string"))
    users.insert(make(("a", "not taken", 1), ("c", "Cy", 1), ("c", "Cy", 1)))
    assert read(users) == [("007", "Bond", 0), ("a", "Ann", 0), ("b", "Bo", 0), ("c", "Cy", 1)]
    before = files_of(f"{tmp_path}/users")
    for _ in range(2):
        users.upsert(make(("b", "old", 1), ("b", "Bob", 2), ("d", "Di", 2)), "seq")
        assert read(users) == [("007", "Bond", 0), ("a", "Ann", 0), ("b", "Bob", 2), ("c", "Cy", 1), ("d", "Di", 2)]
    touched = {r[0] for r in make(("b", "", 0), ("d", "", 0)).select(users._bucket(F.col("id"))).collect()}
    same = lambda files: {f: t for f, t in files.items() if not any(f"_bucket={b}/" in f for b in touched)}
    assert same(before) == same(files_of(f"{tmp_path}/users"))
    stored.delete_cascade(users, make(("a", "", 0), ("zz", "", 0)).select("id"), (posts, "id"))
    assert [r[0] for r in read(users)] == ["007", "b", "c", "d"] and read(posts) == [(1, "b"), (3, "b"), (5, "b")]
    for i in ("007", "b", "c", "d"):
        users.delete(make((i, "", 0)).select("id"))
    assert read(users) == []
    users.insert(make(("e", "Eve", 0)))
    assert read(users) == [("e", "Eve", 0)]


def test_a_stream_that_stopped_between_write_and_commit(spark, tmp_path, monkeypatch):
    tasks = [(1, "pending", "/a"), (2, "processing", "/b"), (3, "completed", "/c"), (4, "pending", None), (5, "processing", " "), (6, "failed", "/f")]
    schema = "task_id long, status string, file_path string"
    spark.createDataFrame(tasks, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    worked = []

    def work(batch):
        worked.append(sorted(r.task_id for r in batch.collect()))
        return batch.select("task_id", F.upper("file_path").alias("result"))

    def start():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        recovery.take_up(stream, work, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        out = recovery.results_of(spark, f"{tmp_path}/out", "task_id long, result string, status string, message string")
        return sorted((r.task_id, r.status, r.result) for r in out.collect())

    write = recovery.write_batch

    def dies(results, path):
        write(results, path)
        raise OSError("power cut")

    monkeypatch.setattr(recovery, "write_batch", dies)
    with pytest.raises(Exception, match="power cut"):
        start()
    monkeypatch.setattr(recovery, "write_batch", write)
    want = [(1, "completed", "/A"), (2, "completed", "/B"), (4, "failed", None), (5, "failed", None)]
    assert start() == want and worked == [[1, 2], [1, 2]]
    # a task that comes again isn't worked off again; a new one is
    spark.createDataFrame([(2, "pending", "/b"), (7, "pending", "/g"), (7, "pending", "/g")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    assert start() == [*want, (7, "completed", "/G")] and worked[2:] == [[7]]
