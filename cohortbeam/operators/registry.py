"""Result registry: folder keys, listing, search, assembly, last-write-wins."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, image_role, parse_folder


def latest_per_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins: per ``key`` the row with the greatest ``order`` tuple.

    Done as ``max_by(row, order tuple)``, an aggregate: each task reduces its
    rows to one per key before the shuffle, so a hot key costs one row per
    task, not a sorted partition. The row may hold maps.
    """
    payload = [c for c in log.columns if c != key]
    best = F.max_by(F.struct(*payload), F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]))
    return log.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def listing_from_paths(files: DataFrame, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """(folder_name, file_name, path, and the ``keep`` columns) from file paths of a registry tree."""
    parent = F.regexp_extract(F.col(path), r"([^/]+)/[^/]+$", 1)
    parent = F.regexp_replace(parent, r"^[^=]+=", "")  # partitionBy layout: key=value
    return files.select(parent.alias("folder_name"), basename(path).alias("file_name"), F.col(path), *keep)


def registry_list(folders: DataFrame, folder: str = "folder_name") -> DataFrame:
    """One row per folder: patient_name, date, date_raw; newest first, ties
    by folder name."""
    f = folders.select(folder).distinct()
    parts = parse_folder(F.col(folder))
    return (f.select(F.col(folder).alias("folder_name"), *[v.alias(k) for k, v in parts.items()])
             .orderBy(F.desc("date_raw"), "folder_name"))


def search(listing: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring match on the patient name."""
    return listing.where(F.lower(F.col("patient_name")).contains(q.lower()))


def lookup(df: DataFrame, folder: str) -> DataFrame:
    return df.where(F.col("folder_name") == folder)


def lookup_log(log: DataFrame, folder: str, order: list[str], date_col: str = "run_date") -> DataFrame:
    """Latest row of one folder, straight from the results log: the date inside
    the folder key prunes the log's date partitions before anything is read."""
    found = lookup(log, folder)
    key = re.fullmatch(r"[A-Za-z]+(\d{4})(\d{2})(\d{2})", folder)
    if key:
        found = found.where(F.col(date_col) == F.lit("-".join(key.groups())).cast(log.schema[date_col].dataType))
    return latest_per_key(found, "folder_name", order)


def images_per_folder(files: DataFrame) -> DataFrame:
    """Images of each folder as array<struct<filename, type>> (few per folder)."""
    png = files.where(F.col("file_name").endswith(".png"))
    return png.groupBy("folder_name").agg(
        F.array_sort(F.collect_list(F.struct(F.col("file_name").alias("filename"),
                                             image_role("file_name").alias("type")))).alias("images"))


def assemble(folders: DataFrame, metadata: DataFrame, predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Per folder: metadata, predictions and images, any of them missing."""
    j = folders.select("folder_name").join(metadata, "folder_name", "full_outer")
    j = j.join(predictions, "folder_name", "full_outer")
    return j.join(images, "folder_name", "full_outer")
