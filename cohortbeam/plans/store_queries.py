"""Queries over stored structures: file trees, the registry's snapshot, tables,
stream state and name index, order statistics, sketches by day."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import name_index as ni
from ..operators import registry as rg
from ..operators import registry_store as rs
from ..operators import selection as sel
from ..operators import sketches as sk
from ..sources import tree
from .catalog import query
from .io_queries import _scratch, write_images
from .oracle_views import sql
from .registry_queries import LIST_SQL, LOG, META, PRED, STATE, metadata_docs, prediction_docs, write_log

REL_PATH = "regexp_extract(path, '(images_[0-9]+/.*)$', 1) AS rel_path"
TREE_SQL = """SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS basename,
  'images_' || lpad(CAST(vec_id % 12 + 1 AS VARCHAR), 3, '0') || '/images/' || lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS rel_path"""


# ------------------------------------------------------------- file trees
@query("src_file_tree", sql([], TREE_SQL + " FROM embeddings"))
def q_src_file_tree(spark, d):
    """Image files listed folder by folder in tasks."""
    found = tree.tree_files(spark, write_images(spark, d))
    return found.selectExpr("regexp_extract(path, '([^/]+)$', 1) AS basename", REL_PATH)


@query("src_file_tree_stream", sql([], TREE_SQL + ", vec_id % 2 + 1 AS wave FROM embeddings"))
def q_src_file_tree_stream(spark, d):
    """The listing as a stream: files of a first wave, then, after a restart from
    the checkpoint, those that have come since; each file once."""
    from ..operators.images import write_image_files
    base = _scratch(spark, d, "tree_stream")
    root, out = f"{base}/images", f"{base}/listed"
    e = fx.table(spark, d, "embeddings")
    for wave in (1, 2):
        write_image_files(e.where(F.col("vec_id") % 2 + 1 == wave), root).write.format("noop").mode("overwrite").save()
        rows = tree.tree_stream(spark, root).select("path", F.lit(wave).alias("wave"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(
            out).awaitTermination()
    return spark.read.parquet(out).selectExpr("regexp_extract(path, '([^/]+)$', 1) AS basename", REL_PATH, "CAST(wave AS BIGINT) AS wave")


# ------------------------------------------------------------ registry store
@query("registry_snapshot", sql(["folders"], "SELECT folder_name, idx, write_ts FROM state", [LOG, STATE]))
def q_registry_snapshot(spark, d):
    """Three runs merged into the stored snapshot out of order, one of them twice."""
    path = _scratch(spark, d, "snapshot")
    log = write_log(spark, d).select("folder_name", "idx", "write_ts")
    for run in (2, 0, 1, 2):
        rs.merge_run(spark, path, log.where(F.col("idx") % 3 == run), "folder_name", ["write_ts", "idx"])
    return rs.read_snapshot(spark, path).select("folder_name", "idx", "write_ts")


@query("registry_stream_state", sql(["folders"], "SELECT folder_name, idx, write_ts FROM state", [LOG, STATE]))
def q_registry_stream_state(spark, d):
    """Registry writes as a stream of files: the latest row of a folder is the
    state of its key, changed keys are merged into the snapshot."""
    from ..streaming.registry_state import start_registry_state
    base = _scratch(spark, d, "stream_state")
    log = write_log(spark, d).selectExpr("timestamp_seconds(write_ts) AS written", "folder_name", "idx", "write_ts")
    for run in range(3):
        log.where(F.col("idx") % 3 == run).write.mode("append").parquet(f"{base}/log")
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/log")

    def sink(batch, _):
        rs.merge_run(batch.sparkSession, f"{base}/snapshot", batch, "folder_name", ["written", "idx"])

    start_registry_state(events, "folder_name", ["written", "idx"], "365 days", sink, f"{base}/checkpoint").awaitTermination()
    return rs.read_snapshot(spark, f"{base}/snapshot").select("folder_name", "idx", "write_ts")


def _stored(spark, d, rows, name: str) -> str:
    table = f"{name}_{uuid.uuid4().hex}"
    rs.write_store(rows, table, buckets=16, path=_scratch(spark, d, "store"))
    return table


@query("registry_store_lookup", sql(["folders"], """
SELECT s.folder_name, s.idx, f.patient_name FROM state s JOIN folders f ON f.idx = s.idx
WHERE s.folder_name IN ('Redwidget20260102', 'Run_62', 'run_62')""", [LOG, STATE]))
def q_registry_store_lookup(spark, d):
    """Point lookups in the bucketed table: one bucket each, row groups skipped
    by bloom filter."""
    log = write_log(spark, d).select("folder_name", "idx", "patient_name", "write_ts")
    store = spark.table(_stored(spark, d, rg.latest_per_key(log, "folder_name", ["write_ts", "idx"]), "registry_state"))
    return store.where(F.col("folder_name").isin("Redwidget20260102", "Run_62", "run_62")).select("folder_name", "idx", "patient_name")


@query("registry_store_assemble", sql(["folders", "files", "scores", "label_names"], """
SELECT s.folder_name, s.idx, m.idx IS NOT NULL AS has_metadata, p.idx IS NOT NULL AS has_predictions, coalesce(m.patient_name, '') AS patient_name
FROM state s LEFT JOIN meta m ON m.idx = s.idx LEFT JOIN (SELECT DISTINCT idx FROM pred) p ON p.idx = s.idx""", [LOG, STATE, META, PRED]))
def q_registry_store_assemble(spark, d):
    """State, metadata and predictions from tables of equal buckets: the joins
    need no shuffle."""
    log = write_log(spark, d).select("folder_name", "idx", "write_ts")
    state = rg.latest_per_key(log, "folder_name", ["write_ts", "idx"])
    tables = {"state": state}
    for name, docs in (("metadata", metadata_docs(spark, d)), ("predictions", prediction_docs(spark, d))):
        tables[name] = docs.join(state.select("idx", "folder_name"), "idx").drop("idx")
    state, metadata, predictions = (spark.table(_stored(spark, d, rows, f"registry_{name}")) for name, rows in tables.items())
    j = state.join(metadata, "folder_name", "left").join(predictions, "folder_name", "left")
    return j.select("folder_name", "idx", F.col("gender").isNotNull().alias("has_metadata"),
                    F.col("predictions").isNotNull().alias("has_predictions"), F.coalesce("patient_name", F.lit("")).alias("patient_name"))


# --------------------------------------------------------------- name index
SEARCHED = ["widget", "ReD", "e", "rE", "zzz", "", "run_6", "aaaa", "dgetr"]


@query("registry_name_index", sql(["folders"], f"""
SELECT q.q, l.folder_name, l.patient_name FROM lst l, (SELECT unnest({SEARCHED!r}) AS q) q
WHERE contains(lower(l.patient_name), lower(q.q))""", [("lst", LIST_SQL)]))
def q_registry_name_index(spark, d):
    """Substring searches of any length from the stored gram index, to which two
    runs were added and one of them again."""
    path = _scratch(spark, d, "name_index")
    names = rg.registry_list(fx.folders(spark, d)).select("folder_name", "patient_name")
    for run in (0, 1, 0):
        ni.write_index(names.where(F.pmod(F.xxhash64("folder_name"), F.lit(2)) == run), path, run)
    found = None
    for q in SEARCHED:
        one = ni.find(spark, path, q).select(F.lit(q).alias("q"), "folder_name", "patient_name")
        found = one if found is None else found.unionByName(one)
    return found


# ---------------------------------------------------------- order statistics
@query("exact_median", sql([], """
SELECT median(l_extendedprice) AS price, median(l_quantity) AS quantity, median(l_extendedprice * (1 + l_orderkey % 97)) AS spread,
  median(l_orderkey) AS orderkey FROM lineitem"""))
def q_exact_median(spark, d):
    """Medians by narrowing brackets, of few and of very many different values."""
    t = fx.table(spark, d, "lineitem")
    columns = {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "orderkey": F.col("l_orderkey"),
               "spread": F.col("l_extendedprice") * (1 + F.col("l_orderkey") % 97)}
    values = {n: sel.exact_median(t.select(c.alias("v")), "v") for n, c in columns.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values))


@query("exact_group_split", sql(["groups"], """
SELECT g.idx, g.group_key, CASE WHEN r.n < r.n_train THEN 'train' WHEN r.n < r.n_train + (r.total - r.n_train) // 2 THEN 'val' ELSE 'test' END AS split
FROM groups g JOIN (
  SELECT group_key, row_number() OVER (ORDER BY left(md5('42:=' || group_key), 15), group_key) - 1 AS n, count(*) OVER () AS total,
         (4 * count(*) OVER ()) // 5 AS n_train
  FROM (SELECT DISTINCT group_key FROM groups)) r USING (group_key)"""))
def q_exact_group_split(spark, d):
    """Exactly floor(0.8 n) groups to train and half of the rest to val."""
    return sel.exact_group_split(fx.groups(spark, d).select("idx", "group_key"), "group_key")


# ------------------------------------------------------------------ sketches
@query("distinct_over_time", sql([], """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS "rows", count(DISTINCT user_id) AS exact, true AS within
FROM events WHERE ts IS NOT NULL GROUP BY 1"""))
def q_distinct_over_time(spark, d):
    """Distinct patients by week from the days' stored sketches, one day
    rewritten alone; within four standard errors of the exact count."""
    path = _scratch(spark, d, "sketches")
    e = fx.table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    sk.write_sketches(sk.daily_sketches(e, "day", "user_id"), path)
    first = e.agg(F.min("day")).first()[0]
    sk.write_sketches(sk.daily_sketches(e.where(F.col("day") == F.lit(first)), "day", "user_id"), path)
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    found = sk.distinct_over(spark.read.parquet(path), week)
    exact = e.where("day IS NOT NULL").groupBy(week).agg(F.countDistinct("user_id").alias("exact"))
    error = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * sk.standard_error() * F.col("exact"))
    return found.join(exact, "week").select("week", "rows", "exact", error.alias("within"))
