"""Ranking of prediction maps/arrays (row-local: no shuffle) and batch stacking."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _desc_nulls_last(a: Column, b: Column) -> Column:
    return (F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
             .when(a > b, -1).when(a < b, 1).otherwise(0))


def sorted_entries(pred_map: Column) -> Column:
    """Map entries sorted by value, descending; equal values keep map order
    (the comparator sort is stable)."""
    return F.array_sort(F.map_entries(pred_map), lambda x, y: _desc_nulls_last(x["value"], y["value"]))


def top_k(pred_map: Column, k: int = 3) -> Column:
    """array<struct<key,value>> of the k highest entries."""
    return F.slice(sorted_entries(pred_map), 1, k)


def top_prediction(pred_map: Column) -> Column:
    """Label of the highest probability (first in map order on ties)."""
    return F.element_at(sorted_entries(pred_map), 1)["key"]


def top_indices(scores: Column, k: int = 3) -> Column:
    """Class indices of the k highest scores; equal scores in descending
    class order (the reverse of a stable ascending sort)."""
    pairs = F.transform(scores, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    srt = F.array_sort(pairs, lambda x, y: F.when(_desc_nulls_last(x["p"], y["p"]) != 0,
                                                   _desc_nulls_last(x["p"], y["p"]))
                       .otherwise(F.when(x["i"] > y["i"], -1).when(x["i"] < y["i"], 1).otherwise(0)))
    return F.transform(F.slice(srt, 1, k), lambda s: s["i"])


def ranked(df: DataFrame, pred_map: str, k: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Long form: one row per (row, rank) with rank starting at 1."""
    arr = sorted_entries(F.col(pred_map)) if k is None else top_k(F.col(pred_map), k)
    keep = keep or [c for c in df.columns if c != pred_map]
    x = df.select(*keep, F.posexplode(arr).alias("pos", "e"))
    return x.select(*keep, (F.col("pos") + 1).alias("rank"), F.col("e.key").alias("label"),
                    F.col("e.value").alias("prob"))


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Stack scored batches by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
