"""Substring search over names by a stored index of their grams.

Every run of 1, 2 and 3 letters of a lower-cased name is a posting (gram, key,
name). Postings are stored by a hash bucket of the gram and by run: a new run
adds or replaces its own files only, and a query reads the buckets of its own
grams. A query of three or more letters takes the keys that hold all of its
3-grams and verifies the substring; shorter ones are grams themselves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3
BUCKETS = 64


def bucket_of(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(names: DataFrame, key: str = "folder_name", name: str = "patient_name") -> DataFrame:
    """(bucket, gram, key, name): each gram of a name once."""
    low = F.lower(F.col(name))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(N)), lambda n: F.transform(
        F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(low, i, n)))))
    rows = names.where(F.col(name).isNotNull()).select(F.explode(grams).alias("gram"), key, name)
    return rows.select(bucket_of("gram").alias("bucket"), "gram", key, name)


def write_index(names: DataFrame, path: str, run_id: int, key: str = "folder_name", name: str = "patient_name") -> None:
    """Add one run's names; the same run again replaces itself."""
    rows = postings(names, key, name).withColumn("run_id", F.lit(run_id))
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run_id").parquet(path))


def find(spark: SparkSession, path: str, q: str, key: str = "folder_name", name: str = "patient_name") -> DataFrame:
    """(key, name) of all names that contain ``q``, whatever its case; the same
    as a scan for it. An empty ``q`` matches every name that has a letter."""
    stored = spark.read.parquet(path)
    q = spark.range(1).select(F.lower(F.lit(q))).first()[0]  # the case rules of the index
    if not q:
        return stored.where(F.length("gram") == 1).select(key, name).distinct()
    grams = sorted({q[i:i + N] for i in range(max(1, len(q) - N + 1))})
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(bucket_of("g")).collect()]
    met = stored.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(grams)).select("gram", key, name).distinct()
    if len(grams) > 1:
        met = met.groupBy(key, name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return met.select(key, name).where(F.lower(F.col(name)).contains(q)).distinct()
