"""Class-activation heatmaps from activations and gradients.

weight[ch] = mean over cells of grad[cell, ch];
cam[cell]  = relu(sum over ch of act[cell, ch] * weight[ch]);
heat[cell] = cam[cell] / (max(cam) + 1e-8).

``heatmap_arrays`` works on one row per image holding flattened
``[cell][ch]`` arrays: pure row-local array expressions, no shuffle, so it
scales with the number of images and never moves tensors. ``heatmap_long``
takes the same data as a long table (image_key, cell, ch, act, grad) and
clusters it by image once; every later step reuses that partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda
    variable (keeps the optimizer from inlining it into element lambdas)."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def heatmap_arrays(act: Column, grad: Column, n_cells: int, n_ch: int, eps: float = EPS) -> Column:
    """array<double>[n_cells] heatmap from flattened [cell][ch] arrays."""
    cells = F.sequence(F.lit(0), F.lit(n_cells - 1))
    chans = F.sequence(F.lit(0), F.lit(n_ch - 1))

    def at(a: Column, cell: Column, ch: Column) -> Column:
        return F.element_at(a, cell * n_ch + ch + 1).cast("double")

    def weights(g: Column) -> Column:
        return F.transform(chans, lambda ch: F.aggregate(cells, F.lit(0.0), lambda s, c: s + at(g, c, ch)) / float(n_cells))

    def cam_from(a: Column, w: Column) -> Column:
        return F.transform(cells, lambda c: F.greatest(F.lit(0.0), F.aggregate(
            chans, F.lit(0.0), lambda s, ch: s + at(a, c, ch) * F.element_at(w, ch + 1))))

    # act/grad may be expressions (e.g. a computed gradient): bind each once
    return let(act.cast("array<double>"), lambda a: let(grad.cast("array<double>"), lambda g: let(
        weights(g), lambda w: let(cam_from(a, w), lambda cam: let(
            F.array_max(cam), lambda m: F.transform(cam, lambda x: x / (m + eps)))))))


def heatmap_long(t: DataFrame, key: str = "image_key", eps: float = EPS) -> DataFrame:
    """(key, cell, heat) from a long (key, cell, ch, act, grad) table."""
    x = t.repartition(key)  # one shuffle: all steps below are clustered by key
    x = x.withColumn("weight", F.avg("grad").over(Window.partitionBy(key, "ch")))
    cam = x.groupBy(key, "cell").agg(F.sum(F.col("act") * F.col("weight")).alias("cam"))
    cam = cam.withColumn("cam", F.greatest(F.lit(0.0), F.col("cam")))
    mx = F.max("cam").over(Window.partitionBy(key))
    return cam.select(key, "cell", (F.col("cam") / (mx + eps)).alias("heat"))


def class_gradients(n_features: int, k: Column, weight_fn) -> Column:
    """Gradient of a linear class score w.r.t. its inputs: the class weights."""
    return F.transform(F.sequence(F.lit(1), F.lit(n_features)), lambda i: weight_fn(i, k))
