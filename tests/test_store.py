"""File trees, snapshot, stream state, stored tables, name index, order statistics, sketches."""
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from cohortbeam.operators import name_index as ni, registry as rg, registry_store as rs, selection as sel, sketches as sk
from cohortbeam.sources import readers as rd, tree


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------- file trees
def grow(root, names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(n.encode())


NAMES = ["top.png", "a/1.png", "a/b/2.png", "a/b/c/d/3.png", "a/b/x y%20.png", "a/no.txt", ".hidden/4.png", "_tmp/5.png", "a/_6.png",
         "k=1/7.png", "_k=1/8.png", "a/.9.png", "e/f/10.jpg"]


@pytest.mark.parametrize("levels", [0, 1, 3, 9])
def test_tree_lists_what_binary_file_lists(spark, tmp_path, levels):
    grow(tmp_path, NAMES)
    want = sorted(map(tuple, rd.image_files(spark, str(tmp_path)).select("path", "modificationTime", "length", "content").collect()))
    got = tree.tree_files(spark, str(tmp_path), levels=levels, tasks=3, content=True)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7
    assert sorted(r.path for r in tree.tree_files(spark, f"file://{tmp_path}", "*.png,*.jpg", levels=levels).collect()) == sorted(
        [r[0] for r in want] + [f"file:{tmp_path}/e/f/10.jpg"])


def test_the_driver_names_folders_only(tmp_path):
    grow(tmp_path, [f"a/{i}.png" for i in range(50)] + ["b/c/1.png", "t.png"])
    reader = tree.TreeReader({"path": str(tmp_path), "levels": "1"})
    named = [f for p in reader.partitions() for f in p.folders]
    assert sorted(named) == [(f"file:{tmp_path}", False), (f"file:{tmp_path}/a", True), (f"file:{tmp_path}/b", True)]
    assert len(tree.TreeReader({"path": str(tmp_path), "tasks": "2"}).partitions()) == 2


def test_stream_of_files_over_restarts(spark, tmp_path):
    root, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    grow(root, ["a/1.png", "a/2.png"])

    def run():
        s = tree.tree_stream(spark, str(root)).writeStream.format("parquet").option("checkpointLocation", ckpt)
        s.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(os.path.basename(r.path) for r in spark.read.schema("path string").parquet(out).collect())

    assert run() == ["1.png", "2.png"]
    assert run() == ["1.png", "2.png"]
    time.sleep(0.01)
    grow(root, ["a/3.png", "b/c/4.png"])
    assert run() == ["1.png", "2.png", "3.png", "4.png"]


# ------------------------------------------------------------------- snapshot
def log_rows(n=400, seed=4):
    rng = random.Random(seed)
    keys = [f"Name{'abcdef'[i % 6]}202601{i % 9 + 1:02d}" for i in range(40)] + ["odd_1", "odd_2"]
    keys = [k.replace("Namea", "Anna") for k in keys]
    return [(rng.choice(keys), rng.randint(1, 50), i, f"v{i}") for i in range(n)]


ORDER = ["ts", "idx"]
SCHEMA = "folder_name string, ts long, idx long, v string"


def test_snapshot_equals_the_log_after_any_order_and_replays(spark, tmp_path):
    rows, path = log_rows(), str(tmp_path / "s")
    log = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, rg.latest_per_key(log, "folder_name", ORDER).select("folder_name", *ORDER, "v").collect()))
    assert rs.read_snapshot(spark, path) is None
    for run in (3, 0, 2, 3, 1, 0):
        rs.merge_run(spark, path, log.where(F.col("idx") % 4 == run), "folder_name", ORDER)
    assert rs.merge_run(spark, path, log.where("false"), "folder_name", ORDER) == []
    got = rs.read_snapshot(spark, path)
    assert sorted(map(tuple, got.select("folder_name", *ORDER, "v").collect())) == want
    assert {r[0] for r in got.select(rs.DATE).distinct().collect()} >= {"00000000", "20260101"}


def test_a_merge_touches_its_own_dates_only_and_keeps_files_few(spark, tmp_path):
    rows, path = log_rows(), str(tmp_path / "s")
    log = spark.createDataFrame(rows, SCHEMA)
    rs.merge_run(spark, path, log, "folder_name", ORDER)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    before = files()
    one = spark.createDataFrame([("Anna20260101", 99, 1000, "new")], SCHEMA)
    assert rs.merge_run(spark, path, one, "folder_name", ORDER) == ["20260101"]
    after = files()
    assert {f for f in before if "20260101" not in f} == {f for f in after if "20260101" not in f}
    assert all(before[f] == after[f] for f in after if "20260101" not in f)
    assert len(after) == len({os.path.dirname(f) for f in after})
    assert rs.read_snapshot(spark, path).where("folder_name = 'Anna20260101'").first().v == "new"
    rs.rebuild_dates(spark, path, log, ["20260101"], "folder_name", ORDER)  # the run was taken back in the log
    want = sorted(map(tuple, rg.latest_per_key(log, "folder_name", ORDER).select("folder_name", *ORDER, "v").collect()))
    assert sorted(map(tuple, rs.read_snapshot(spark, path).select("folder_name", *ORDER, "v").collect())) == want


def test_stream_state_equals_latest_over_restarts_and_drops_late_rows(spark, tmp_path):
    from cohortbeam.streaming.registry_state import start_registry_state
    src, out, ckpt = str(tmp_path / "log"), str(tmp_path / "s"), str(tmp_path / "ckpt")
    schema = "folder_name string, at timestamp, idx long, v string"
    order = ["at", "idx"]

    def add(rows):
        spark.createDataFrame(rows, "folder_name string, at long, idx long, v string").withColumn(
            "at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        start_registry_state(events, "folder_name", order, "1 hour", lambda b, _: rs.merge_run(
            b.sparkSession, out, b, "folder_name", order) and None, ckpt).awaitTermination()
        return {r.folder_name: r.v for r in rs.read_snapshot(spark, out).collect()}

    add([("Ann20260101", 10_000, 1, "a"), ("Bob20260101", 10_000, 2, "b"), ("Ann20260101", 9_000, 3, "older"), ("Ann20260101", 10_000, 4, None)])
    assert run() == {"Ann20260101": None, "Bob20260101": "b"}
    add([("Ann20260101", 9_500, 5, "older"), ("Bob20260101", 20_000, 6, "b2")])  # out of order, but in time
    assert run() == {"Ann20260101": None, "Bob20260101": "b2"}
    add([("Cy20260102", 40_000, 7, "c")])  # the watermark moves to 36,400
    add([("Dan20260102", 1_000, 8, "late"), ("Ann20260101", 39_000, 9, "a3")])  # behind it, and in time for a key forgotten by now
    assert run() == {"Ann20260101": "a3", "Bob20260101": "b2", "Cy20260102": "c"}
    assert run() == {"Ann20260101": "a3", "Bob20260101": "b2", "Cy20260102": "c"}


# -------------------------------------------------------------- stored tables
def test_bucketed_tables_join_without_shuffle_and_lookups_read_one_bucket(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('Key', id) AS folder_name", "id AS idx")
    names = ["store_a", "store_b"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for n in names:
            rs.write_store(rows.withColumnRenamed("idx", n), n, buckets=8, path=str(tmp_path / n))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        j = spark.table(names[0]).join(spark.table(names[1]), "folder_name")
        assert j.count() == 2000 and "Exchange" not in plan(j) and "SortMergeJoin" in plan(j)
        one = spark.table(names[0]).where("folder_name = 'Key77'")
        assert [tuple(r) for r in one.collect()] == [("Key77", 77)]
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # for the plan to name the buckets
        assert "SelectedBucketsCount: 1 out of 8" in plan(spark.table(names[0]).where("folder_name = 'Key77'"))
        jvm = spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(spark.table(names[0]).inputFiles()[0])
        footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(spark.sparkContext._jsc.hadoopConfiguration(), file)
        offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in footer.getBlocks().get(0).getColumns()}
        assert offsets["folder_name"] > 0 > offsets["store_a"]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


# ----------------------------------------------------------------- name index
def test_index_equals_a_scan_for_any_query(spark, tmp_path):
    rng = random.Random(1)
    names = ["".join(rng.choice("abAB ÄäßéZ%_.") for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["banana", "BANANA", "", "x", "İi"]
    df = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(names)] + [("null", None)], "folder_name string, patient_name string")
    path = str(tmp_path / "i")
    for run in (0, 1, 0):
        ni.write_index(df.where(F.pmod(F.xxhash64("folder_name"), F.lit(2)) == run), path, run)
    for q in ["a", "B", "ab", "ana", "anan", "nanA", "ä", "ß", "zz", "%", "_a", ".", "banana", "bananas", "İ", "x", "aaaaaaaaaaaa"]:
        want = sorted(map(tuple, df.where(F.lower("patient_name").contains(F.lower(F.lit(q)))).collect()))
        assert sorted(map(tuple, ni.find(spark, path, q).collect())) == want, q
    p = plan(ni.find(spark, path, "anan"))
    assert "PartitionFilters: [isnotnull(bucket" in p or "bucket#" in p.split("PartitionFilters:")[1][:200]


# ----------------------------------------------------------- order statistics
@pytest.mark.parametrize("kind", ["distinct", "few", "skewed", "ends", "negative", "one"])
def test_order_statistics_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(sel, "SMALL", 50)
    rng = random.Random(7)
    v = {"distinct": [rng.random() for _ in range(20_001)], "few": [float(rng.randint(0, 3)) for _ in range(5000)],
         "skewed": [10.0 ** rng.uniform(-300, 300) for _ in range(6000)], "one": [4.5],
         "ends": [0.0] * 3000 + [1.0] * 2990 + [rng.random() for _ in range(9)], "negative": [-rng.expovariate(1) for _ in range(8000)]}[kind]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 5, "v double").repartition(5)
    assert sel.exact_median(df, "v") == statistics.median(v)
    held, s = df.where("v IS NOT NULL"), sorted(v)
    for rank in {0, len(v) // 3, len(v) - 1}:
        assert sel.order_statistic(held, "v", rank, len(v)) == s[rank]


def test_median_of_nothing(spark):
    assert sel.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
    with pytest.raises(ValueError):
        sel.order_statistic(spark.range(3), "id", 3, 3)


@pytest.mark.parametrize("groups", [0, 1, 2, 3, 9, 10, 103, 1000])
def test_split_sizes_are_exact(spark, groups):
    df = spark.range(groups * 3).selectExpr("id", f"IF(id % 1000 = 7, NULL, concat('g', id % {max(groups, 1)})) AS g")
    got = sel.exact_group_split(df, "g", seed=3)
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    n = len(by)
    sizes = {s: sum(x == {s} for x in by.values()) for s in ("train", "val", "test")}
    train = int(0.8 * n)
    assert sizes == {"train": train, "val": (n - train) // 2, "test": n - train - (n - train) // 2}
    again = sel.exact_group_split(df.repartition(7), "g", seed=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    assert "Exchange" not in plan(got)


def test_split_with_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(sel, "_group_hash", lambda key, seed: F.lit(5).cast("long"))
    got = sel.exact_group_split(spark.range(20).selectExpr("id AS g"), "g").groupBy("split").count().collect()
    assert dict(map(tuple, got)) == {"train": 16, "val": 2, "test": 2}


# ------------------------------------------------------------------- sketches
def test_sketches_unite_days_and_days_are_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "k")
    df = spark.range(60_000).selectExpr("date_add(DATE'2026-01-01', CAST(id % 10 AS INT)) AS day", "IF(id % 50 = 0, NULL, id % 20000) AS patient")
    sk.write_sketches(sk.daily_sketches(df, "day", "patient"), path)
    before = {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.startswith("day=")}
    more = spark.range(5000).selectExpr("DATE'2026-01-03' AS day", "id + 1000000 AS patient").unionByName(df.where("day = DATE'2026-01-03'"))
    sk.write_sketches(sk.daily_sketches(more, "day", "patient"), path)
    after = {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.startswith("day=")}
    assert {f for f in after if after[f] != before[f]} == {"day=2026-01-03"}
    both = df.where("day <> DATE'2026-01-03'").unionByName(more)
    for where in ("true", "day <= DATE'2026-01-03'", "day = DATE'2026-01-04'"):
        exact = both.where(where).agg(F.countDistinct("patient")).first()[0]
        got = sk.distinct_over(spark.read.parquet(path).where(where)).first()
        assert abs(got.n_distinct - exact) <= 4 * sk.standard_error() * exact
        assert got.rows == both.where(where).count()
