"""The registry as a stored snapshot: incremental merges, and tables laid out for
lookups and joins.

The snapshot holds the latest row of every key, partitioned by the date in the
key. A merge reads and rewrites the partitions of its own dates only, so a run
costs what it touches and not the whole log. ``latest_per_key`` is a maximum over a
total order: merges in any order, repeated or overlapping, end in the same
snapshot. Each merge writes its partitions in few files, whatever the number of
runs before, so no separate compaction is due.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FOLDER_PATTERN, UNKNOWN_DATE_RAW
from ..session import ensure_checkpoint_dir
from .registry import latest_per_key

DATE = "snapshot_date"


def with_date(rows: DataFrame, key: str) -> DataFrame:
    """The eight digits at the end of a folder key; a key always has the same."""
    raw = F.regexp_extract(F.col(key), FOLDER_PATTERN, 2)
    return rows.withColumn(DATE, F.when(raw != "", raw).otherwise(F.lit(UNKNOWN_DATE_RAW)))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored snapshot, dates as text; None before the first merge."""
    try:
        kept = spark.read.parquet(path).schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    fields = [f for f in kept.fields if f.name != DATE]
    return spark.read.schema(T.StructType([*fields, T.StructField(DATE, T.StringType())])).parquet(path)


def _dates(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.select(DATE).distinct().collect()]  # days of the rows


def _write(rows: DataFrame, path: str) -> None:
    # checkpointed first: the partitions read are the ones replaced
    rows = rows.checkpoint()
    (rows.hint("rebalance", DATE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(DATE).parquet(path))


def merge_run(spark: SparkSession, path: str, run: DataFrame, key: str, order: list[str]) -> list[str]:
    """Merge one run's rows; returns the dates whose partitions were rewritten."""
    ensure_checkpoint_dir(spark)
    run = with_date(latest_per_key(run, key, order), key).checkpoint()
    dates = _dates(run)
    if not dates:
        return []
    old = read_snapshot(spark, path)
    both = run
    if old is not None:
        both = run.unionByName(old.where(F.col(DATE).isin(dates)).select(*run.columns))
    _write(latest_per_key(both, key, order), path)
    return sorted(dates)


def rebuild_dates(spark: SparkSession, path: str, log: DataFrame, dates: list[str], key: str, order: list[str]) -> None:
    """Take the partitions of some dates anew from the log: for runs that were
    replaced there by other rows."""
    ensure_checkpoint_dir(spark)
    _write(latest_per_key(with_date(log, key).where(F.col(DATE).isin(dates)), key, order), path)


def write_store(rows: DataFrame, table: str, key: str = "folder_name", buckets: int = 64, path: str | None = None) -> None:
    """A table bucketed and sorted by key with a bloom filter on it. Tables of
    equal buckets join on the key without a shuffle, and a lookup reads one
    bucket, of which the filters leave the row groups that may hold the key.
    With ``path`` the files lie there and not in the warehouse."""
    out = (rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
           .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true"))
    (out.option("path", path) if path else out).saveAsTable(table)
