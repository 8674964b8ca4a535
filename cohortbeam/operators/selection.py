"""Order statistics of any size in bounded memory, and exact splits of groups.

A value of a given rank is found by narrowing: approximate percentiles (small,
mergeable summaries) bracket the rank, one scan counts what lies below the
bracket and inside it, and the rows inside are the next round's. A round keeps
about a thousandth of the rows, so two or three are enough for any table; what
is left is sorted in one small task. The answer is exact whatever the values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 50_000  # values that are sorted at once
ACCURACY = 10_000  # of the approximate percentiles: a rank is off by rows / ACCURACY at most


def order_statistic(values: DataFrame, col: str, rank: int, rows: int, rounds: int = 20):
    """The ``rank``-th smallest (from 0) of ``rows`` non-null values of a numeric
    column; NaN counts as greatest."""
    if not 0 <= rank < rows:
        raise ValueError(f"no rank {rank} among {rows} values")
    c = F.col(col)
    for _ in range(rounds):
        if rows <= SMALL:
            return values.select(col).orderBy(col).offset(rank).first()[0]
        slack = 2.0 / ACCURACY
        at = [max(0.0, rank / rows - slack), min(1.0, rank / rows + slack)]
        lo, hi = map(F.lit, values.select(F.percentile_approx(col, at, ACCURACY)).first()[0])
        # the bracket's ends may stand for very many equal values: they are counted apart
        parts = [(c < lo, None), (c == lo, lo), ((c > lo) & (c < hi), None), ((c == hi) & (c > lo), hi), (c > hi, None)]
        for (inside, value), n in zip(parts, values.select(*[F.count_if(p) for p, _ in parts]).first()):
            if rank < n:
                break
            rank -= n
        if value is not None:
            return values.where(inside).select(col).first()[0]
        values, rows = values.where(inside), n
    raise RuntimeError(f"rank not found in {rounds} rounds")


def exact_median(df: DataFrame, col: str) -> float | None:
    """The interpolated median, as ``median`` gives it, without a map of all
    different values in one task. Nulls take no part; None without values."""
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    rows = values.count()
    if not rows:
        return None
    low = order_statistic(values, "v", (rows - 1) // 2, rows)
    return low if rows % 2 else (low + order_statistic(values, "v", rows // 2, rows)) / 2


def _group_hash(key: Column, seed: int) -> Column:
    """60 bits of md5(seed ':' key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def exact_group_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.5, out: str = "split") -> DataFrame:
    """Whole groups to train / val / test, in exact numbers: floor(train * groups)
    go to train, floor(val * rest) of the rest to val, the others to test.

    Groups are ordered by a seeded hash. The hashes on the two borders are order
    statistics; with them the split is row-local, so the rows are not shuffled
    and no group can fall apart. A null key is a group of its own."""
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    h = _group_hash(text, seed)
    groups = df.select(text.alias("g"), h.alias("h")).distinct()
    n = groups.count()
    n_train = int(train * n)
    n_val = int(val * (n - n_train))
    below = F.lit("test")
    for name, end in (("val", n_train + n_val), ("train", n_train)):
        if end < n:
            border = order_statistic(groups, "h", end, n)
            before = groups.where(F.col("h") < border).count()
            # groups whose hash equals the border's (one, but for collisions) are taken in the order of their keys
            tied = [r.g for r in groups.where(F.col("h") == border).orderBy("g").limit(end - before).collect()]
            inside = (h < border) | ((h == border) & text.isin(tied)) if tied else h < border
        else:
            inside = F.lit(True)
        below = F.when(inside, name).otherwise(below)
    return df.withColumn(out, below)
