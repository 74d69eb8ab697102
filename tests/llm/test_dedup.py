import os
import random
import time

import pytest
from pyspark.sql import functions as F
from vellum.llm import exact_dedup, jaccard_join, suffix_dedup
from vellum.llm.queries import ORACLES, QUERIES

from ..oracle import SMALL, rows_of_sql, same
from .brute import jaccard_components, sha, without_repeats

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def small_docs():
    return rows_of_sql("SELECT doc_id, text FROM documents", SMALL, ["doc_id", "text"])


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string")], ids=["sha256", "colliding"])
def test_exact_dedup_compares_bytes(spark, digest):
    rows = [(1, "a"), (2, "a"), (3, "b"), (None, "b"), (5, None), (6, ""), (7, "c"), (7, "c"), (8, "x" * 100_000), (9, "x" * 100_000), (10, "x" * 99_999 + "y")]
    df = spark.createDataFrame(rows, DOCS).withColumn("keep", F.lit(0)).withColumn("digest", F.lit(0))  # names that clash
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest=digest).collect())
    assert got == [(0, 3, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, False), (7, 7, 2, True), (8, 9, 2, False), (9, 9, 2, True), (10, 10, 1, True)]


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (2, "a", 2)], DOCS + ", file int")
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and [r.doc_id for r in left.collect()] == [2]
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def decided(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


COLLIDING = lambda t: F.length(t).cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, COLLIDING], ids=["sha256", "colliding"])
def test_exact_dedup_goes_on_from_its_state(spark, tmp_path, digest):
    parts = [[(1, "a"), (2, "b"), (3, "b")], [(4, "a"), (0, "b"), (5, "c")], [(6, "c"), (7, None)], []]
    want = [
        [(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True)],
        [(0, 3, 3, False), (4, 4, 2, True), (5, 5, 1, True)],
        [(6, 6, 2, True), (7, 7, 1, True)],
        [],
    ]
    calls = []
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, DOCS)
        if i != 2:  # the third is no plain scan: its texts are copied beside the state
            df.coalesce(1).write.parquet(f"{tmp_path}/part-{i}")
            df = spark.read.parquet(f"{tmp_path}/part-{i}")
        calls.append(lambda df=df: decided(exact_dedup.exact_dedup(df, digest=digest, state_dir=f"{tmp_path}/state")))
    assert [c() for c in calls] == want
    assert [c() for c in calls] == want  # each again: nothing changes


def test_exact_dedup_checks_bytes_of_earlier_calls_or_fails(spark, tmp_path):
    for name, rows in (("one", [(1, "aaa"), (2, "cc")]), ("two", [(9, "bbb"), (8, "d")])):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    go = lambda name: decided(exact_dedup.exact_dedup(read(name), digest=COLLIDING, state_dir=f"{tmp_path}/state"))
    go("one")
    assert go("two") == [(8, 8, 1, True), (9, 9, 1, True)]
    spark.createDataFrame([(5, "eee")], DOCS).coalesce(1).write.parquet(f"{tmp_path}/three")
    os.rename(f"{tmp_path}/one", f"{tmp_path}/gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|aren't where they were"):
        go("three")


def test_exact_dedup_takes_up_a_call_that_broke_off(spark, tmp_path, monkeypatch):
    for i, rows in enumerate([[(1, "a"), (2, "a")], [(3, "a"), (4, "b")]]):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    go = lambda i: decided(exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/{i}"), state_dir=f"{tmp_path}/state"))
    run = exact_dedup.keep_state

    def dies(*args):
        if steps.pop():
            run(*args)  # the stream has read the rows, but nobody has told what came of it
        raise OSError("lost")

    for steps in ([False], [True]):
        monkeypatch.setattr(exact_dedup, "keep_state", dies)
        with pytest.raises(OSError, match="lost"):
            go(0)
        monkeypatch.setattr(exact_dedup, "keep_state", run)
    assert go(0) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert go(1) == [(3, 3, 3, True), (4, 4, 1, True)]


def test_a_call_reads_the_updates_of_its_own_batches(spark, tmp_path, monkeypatch):
    read = []
    after = exact_dedup._state_after
    monkeypatch.setattr(exact_dedup, "_state_after", lambda s, f, low, high: read.append(high - low + 1) or after(s, f, low, high))
    for i in range(4):
        spark.createDataFrame([(i, "a"), (10 + i, f"x{i}")], DOCS).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        got = decided(exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/{i}"), state_dir=f"{tmp_path}/state"))
        assert got == [(i, i, i + 1, True), (10 + i, 10 + i, 1, True)]
    assert len(set(read[1:])) == 1


def near_copies(seed=2):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 400)}" for _ in range(120)] for _ in range(3)]
    docs = []
    for i in range(250):
        w = list(bases[i % 3])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
        docs.append((i, " ".join(w[: r.randint(108, 120)])))
    edge = [(1000, None), (1001, ""), (1002, "A b"), (1003, "a B"), (1004, "a"), (1005, " \n"), (1006, docs[0][1].upper()), (1007, "x " * 30_000), (1008, "x " * 20_000), (1009, "É a b c"), (1010, "é a b c")]
    return docs + edge


@pytest.mark.parametrize(("n", "t", "block", "hashes"), [(3, 90, 512, 1 << 20), (5, 80, 512, 1 << 20), (3, 90, 16, 1 << 20), (3, 90, 4, 1 << 20), (3, 90, 512, 900)])
def test_jaccard_join_equals_brute_force(spark, n, t, block, hashes):
    docs = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, DOCS), n, t, block=block, hashes=hashes).collect()}
    assert got == jaccard_components(docs, n, t)


@pytest.mark.parametrize("block", [4, 1024])
def test_exact_links_of_sets_that_only_seem_alike(spark, tmp_path, block):
    """Every set is put into one rough group; the ties don't help, so only the tree tells what is linked."""
    r = random.Random(6)
    docs = [(i, " ".join(f"w{r.randint(0, 30)}" for _ in range(r.choice([8, 9, 20, 60])))) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " w1") for i in range(0, 120, 3)]
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("doc_id", "id")
    members = df.select("id", F.pmod("id", F.lit(2)).alias("rough"))
    members = members.unionByName(members.select("id", (1 - F.col("rough")).alias("rough")))  # two large groups with the same sets
    for name, met in (("none", "0 AS u, 0 AS v WHERE false"), ("wrong", "id AS u, 5L AS v FROM ids WHERE id > 5")):
        df.createOrReplaceTempView("ids")
        links = jaccard_join.exact_links(df, members, spark.sql(f"SELECT {met}"), 2, 70, f"file://{tmp_path}/{block}-{name}", block=block)
        roots = {x.node: x.root for x in jaccard_join.components(links, f"file://{tmp_path}/{block}-{name}/roots").collect()}
        assert {i: roots.get(i, i) for i, _ in docs} == {i: root for i, (_, root) in jaccard_components(docs, 2, 70).items()}


def test_jaccard_stage_keeps_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (None, "a b c")], DOCS).withColumn("gone", F.lit(1)).withColumn("id", F.lit("x")).withColumn("row", F.lit(2))
    left = jaccard_join.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3]


def test_jaccard_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard_join"](spark, SMALL).collect()}
    assert got == jaccard_components(small_docs(), 3, 90)


def test_jaccard_join_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "A  B")], DOCS).withColumn("id", F.lit("x")).withColumn("other", F.lit(1))
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.jaccard_join(df).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_of_each(df).collect()) == [0, 1, 1]
    assert jaccard_join.jaccard_join(df.limit(0)).count() == 0


def lengths_first(raw, seed):
    """A digest by which different segments meet, until it is asked for another one."""
    return len(raw) if seed == 0 else suffix_dedup.segment_digest(raw, seed)


@pytest.mark.parametrize(("length", "group", "digest"), [(100, 1024, suffix_dedup.segment_digest), (70, 3, suffix_dedup.segment_digest), (70, 1, lengths_first)])
def test_suffix_dedup_equals_brute_force(spark, length, group, digest):
    r = random.Random(3)
    p = "".join(r.choice("abc ") for _ in range(400))
    docs = []
    for i in range(120):
        a = r.randint(0, 200)
        b = r.randint(a, 400)
        noise = lambda: "".join(r.choice("abcdü") for _ in range(r.randint(0, 80)))
        docs.append((i, noise() + p[a:b] + noise() + (p[b:] if i % 3 else "") + ("é" * r.randint(0, 150) if i % 5 == 0 else "")))
    docs += [(1000, None), (1001, ""), (1002, "xy" * 300), (1003, p + p), (1004, p), (1004, p), (None, p + "q"), (None, "w" * 500), (1005, "\0" * 300), (1006, "only short")]
    df = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit(1)).withColumn("bytes", F.lit(2))
    got = sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.suffix_dedup(df, length, group=group, digest=digest).collect()], key=lambda x: (x[0] is None, x[0] or 0, x[4]))
    assert got == without_repeats(docs, length)


def test_suffix_dedup_splits_long_texts(spark, monkeypatch):
    r = random.Random(4)
    p = "".join(r.choice("abcdefgh") for _ in range(900))
    docs = [(1, "".join(r.choice("abcdefgh") for _ in range(2_000_000)) + p), (2, p)]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: (900, 1), 2: (900, 1)}
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_dedup_of_many_repeated_rows(spark):
    """Rows of one text: as many with no id cost about what as many with ids of their own do."""
    text = "".join(random.Random(9).choice("abcdefgh") for _ in range(3_000))
    took = []
    for rows in ([(i, text) for i in range(2_000)], [(None, text)] * 2_000):
        at = time.time()
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(4)).groupBy("n_removed", "n_spans").count().collect()
        took.append(time.time() - at)
        assert [tuple(r) for r in got] == [(3_000, 1, 2_000)]
    assert took[1] < 3 * took[0] + 10, took


def test_suffix_query(spark):
    got = sorted(tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, SMALL).collect())
    assert got == sorted((i, n, k, s, sha(b)) for i, n, k, s, b in without_repeats(small_docs(), 400))


def test_all_that_is_removed_comes_from_the_transform(spark, tmp_path, monkeypatch):
    """Segments met twice, alone under their anchor, and runs of a large group: each goes through solve()."""
    p = "".join(random.Random(8).choice("abcdefgh") for _ in range(1500))
    docs = spark.createDataFrame([(1, p), (2, p), (3, "x" + p[300:900])], DOCS)
    assert suffix_dedup.suffix_dedup(docs).where("n_removed > 0").count() == 3
    for group in (1024, 1):
        monkeypatch.setattr(suffix_dedup, "solve", lambda pieces, length: pieces.sparkSession.createDataFrame([], suffix_dedup.FOUND))
        assert suffix_dedup.suffix_dedup(docs, group=group).where("n_removed > 0").count() == 0
