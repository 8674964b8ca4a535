"""Array/map column functions: score maps, pixel scaling, normalisation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["scores_to_map", "pixel_scale", "samplewise_norm", "rescale_255"]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def scores_to_map(labels: list[str], scores: Column | str) -> Column:
    """Score array in class order + label list -> map<label, score>."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), _c(scores))


def pixel_scale(px: Column | str) -> Column:
    """x / 127.5 - 1 element-wise (maps 0..255 to -1..1)."""
    return F.transform(_c(px), lambda x: x.cast("double") / 127.5 - 1.0)


def samplewise_norm(px: Column | str, eps: float = 1e-6) -> Column:
    """Per-sample centring and scaling: (x - mean) / (std + eps), population std.

    Nested ``aggregate`` calls pass the row's sum/count and sum of squares
    to the inner lambdas as lambda variables, so each statistic is computed
    once per row (O(n)); a plain column reference to a mean would be inlined
    by the optimizer into the element lambda and recomputed per element.
    """
    a = _c(px)
    zero = F.lit(0.0).cast("double")
    init = F.struct(zero.alias("s"), F.lit(0).cast("long").alias("n"))

    def finish(acc):
        mean = acc["s"] / acc["n"]
        return F.aggregate(
            a, zero, lambda ss, x: ss + (x.cast("double") - mean) * (x.cast("double") - mean),
            lambda ss: F.transform(a, lambda x: (x.cast("double") - acc["s"] / acc["n"])
                                   / (F.sqrt(ss / acc["n"]) + eps)))

    return F.aggregate(a, init, lambda acc, x: F.struct((acc["s"] + x.cast("double")).alias("s"),
                                                        (acc["n"] + 1).alias("n")), finish)


def rescale_255(px: Column | str) -> Column:
    """Images stored as 0..1 are brought to 0..255; others unchanged."""
    a = _c(px)
    return F.when(F.array_max(a) <= 1.0, F.transform(a, lambda x: x.cast("double") * 255.0)
                  ).otherwise(F.transform(a, lambda x: x.cast("double")))
