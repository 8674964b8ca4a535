"""Group-level train/val/test split without leakage (row-local hash, no shuffle)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int) -> Column:
    """Deterministic number in [0, 1) from md5(seed ':' key): the first 32 bits / 2^32."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def group_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.8,
                val: float = 0.1, out: str = "split") -> DataFrame:
    """Assign whole groups to train / val / test.

    The split is a function of the group key alone, so a group can never be
    in two splits and no shuffle or group collection is needed (a hot group
    costs nothing extra). Shares hold over groups in expectation.
    """
    u = hash_unit(F.col(key), seed)
    return df.withColumn(out, F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def split_leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups found in more than one split (expected empty)."""
    return (df.groupBy(key).agg(F.countDistinct(split).alias("n_splits"))
              .where(F.col("n_splits") > 1))
