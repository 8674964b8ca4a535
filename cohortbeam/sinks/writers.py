"""Sinks. Every writer is idempotent for a given (data, run): a retried task
or a replayed micro-batch rewrites the same files/partitions."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_scored(df: DataFrame, path: str) -> None:
    """Scored table, Parquet, overwrite."""
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str,
                  partition_cols: tuple[str, ...] = ("run_date", "intake_id", "run_id")) -> None:
    """Append-only results log partitioned by date, intake and run. Dynamic
    partition overwrite (an option of this write, not of the session): a rerun
    of a run replaces only its own partitions. ``intake_id`` names where the
    runs come from, so equal run ids of two intakes never meet. Rows without a
    ``written_at`` get the time of the write."""
    if "written_at" not in df.columns:
        df = df.withColumn("written_at", F.current_timestamp())
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(path))


def write_json_docs(df: DataFrame, path: str, doc_cols: list[str], partition: str = "run_date") -> None:
    """JSON documents as lines of one file per task, partitioned by date: the
    key is a field of the document, so millions of keys need no folders."""
    (df.select(partition, F.to_json(F.struct(*doc_cols)).alias("value"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).text(path))


#: Characters that Spark writes as %XX in the name of a partition folder.
ESCAPED = re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def write_doc_folders(df: DataFrame, root: str, key: str = "folder_name", value: str = "value") -> None:
    """One folder and one text file per key, ``<root>/<key>=.../part-00000.txt``
    with a line per row, as ``partitionBy(key).text`` lays them out. A folder is
    made by the task that holds its rows, under its final name: the driver
    renames nothing, however many keys there are, and a retried task rewrites
    the same files. Lines of a key are held by one task."""
    from ..operators.images import qualified
    spark = df.sparkSession
    root = qualified(spark, root)
    named = df.withColumn(key, F.when(F.col(key) != "", F.col(key)))  # both go into the folder for nulls
    docs = named.groupBy(key).agg(F.concat(F.array_join(F.array_sort(F.collect_list(value)), "\n"), F.lit("\n")).alias("lines"))
    dealt = docs.repartition(4 * spark.sparkContext.defaultParallelism, key)

    def write(batches):
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", k) if k is not None else "__HIVE_DEFAULT_PARTITION__"
                folder = f"{base.rstrip('/')}/{key}={name}"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/part-00000.txt") as f:
                    f.write(lines.encode("utf-8", "surrogatepass"))
            yield batch.slice(0, 0).select([0])

    dealt.select(key, "lines").mapInArrow(write, T.StructType([df.schema[key]])).write.format("noop").mode("overwrite").save()


def write_text_json(df: DataFrame, path: str, cols: list[str]) -> None:
    """Rows as JSON lines (``to_json(struct)``)."""
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_training_set(df: DataFrame, path: str, features: list[str], labels: list[str], split: str = "split",
                        key: str = "idx", seed: int = 42, n_files: int | None = None) -> None:
    """(key, path, features array<float>, labels array<float>) per split;
    the train split is written in a seeded pseudo-random order, val/test in
    key order. Sorting is a range-partitioned distributed sort, over the
    session's shuffle partitions unless ``n_files`` is given."""
    out = df.select(key, split, F.col("file_path"),
                    F.array(*[F.col(c) for c in features]).cast("array<float>").alias("features"),
                    F.array(*[F.col(f"`{c}`") for c in labels]).cast("array<float>").alias("labels"))
    order = F.when(F.col(split) == "train", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))\
             .otherwise(F.lpad(F.col(key).cast("string"), 20, "0"))
    ordered = out.withColumn("_order", order)
    ranged = (ordered.repartitionByRange(n_files, split, "_order") if n_files
              else ordered.repartitionByRange(split, "_order"))
    (ranged.sortWithinPartitions(split, "_order").drop("_order")
        .write.mode("overwrite").partitionBy(split).parquet(path))
