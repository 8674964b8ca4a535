"""Cohort joins: path index, demographics, exclusion list, duplicate repair."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def attach_paths(labels: DataFrame, paths: DataFrame, on: str = "idx") -> DataFrame:
    """Label matrix LEFT JOIN path index on the image key."""
    return labels.join(paths, on, "left")


def exclude(catalog: DataFrame, bad: DataFrame, on: str = "idx") -> DataFrame:
    """Catalog rows whose key is not in the exclusion list (anti join, NULL-safe
    in the sense of ``isin``: a NULL key in ``bad`` excludes nothing).

    No hint: Spark broadcasts the list when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the real size
    at runtime; a larger list gets a sort-merge anti join instead."""
    return catalog.join(bad.select(on).where(F.col(on).isNotNull()), on, "left_anti")


def attach_demographics(left: DataFrame, catalog: DataFrame, cols: list[str], on: str = "idx") -> DataFrame:
    """Left join of selected catalog columns."""
    return left.join(catalog.select(on, *cols), on, "left")


def join_coalesce(left: DataFrame, right: DataFrame, on: str | list[str], cols: list[str],
                  how: str = "left") -> DataFrame:
    """Join and repair duplicate columns: a column present on both sides
    becomes the first non-null of (left, right); one present on one side only
    is kept as is."""
    keys = [on] if isinstance(on, str) else list(on)
    lcols = {c.lower() for c in left.columns}
    rcols = {c.lower() for c in right.columns}
    l, r = left.alias("_l"), right.alias("_r")
    cond = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys]
    joined = l.join(r, cond, how)
    out = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys]
    for c in left.columns:
        if c in keys:
            continue
        if c in cols and c.lower() in rcols:
            out.append(F.coalesce(F.col(f"_l.{c}"), F.col(f"_r.{c}")).alias(c))
        else:
            out.append(F.col(f"_l.{c}"))
    for c in right.columns:
        if c in keys or c.lower() in lcols:
            continue
        out.append(F.col(f"_r.{c}"))
    return joined.select(*out)


def scalar(agg: DataFrame):
    """Value of a one-row, one-column global aggregate (median, mean, total).

    The aggregate runs distributed (partial + final); only its single value
    reaches the driver and is then used as a literal, so no cross join or
    single-partition window is needed to attach it to every row.
    """
    row = agg.first()
    return None if row is None else row[0]
