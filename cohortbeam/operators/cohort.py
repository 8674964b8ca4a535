"""Cohort assembly and exploratory aggregates (counts, prevalence, histograms)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.features import (group_key, parse_age, parse_view, train_age_norm,
                                  train_sex_bin)
from .joins import attach_demographics, attach_paths, exclude, join_coalesce, scalar

DEMOGRAPHICS = ["patient_id", "age_raw", "gender", "view_position"]


def build_cohort(labels: DataFrame, paths: DataFrame, catalog: DataFrame, bad: DataFrame,
                 own_paths: DataFrame | None = None, compat_exclusion: bool = False,
                 drop_missing_path: bool = True) -> DataFrame:
    """Label matrix + image paths + demographics, minus the exclusion list.

    By default the exclusion list removes images from both the label matrix
    and the catalog (``compat_exclusion=True`` applies it to the catalog only,
    so an excluded image keeps a row with NULL demographics). When the label
    table carries its own paths (``own_paths``), the two path columns are
    merged, first non-null winning. Rows without a path are dropped.
    """
    left = labels if compat_exclusion else exclude(labels, bad)
    if own_paths is not None:
        left = left.join(own_paths, "idx", "left")
        left = join_coalesce(left, paths, "idx", ["file_path"])
    else:
        left = attach_paths(left, paths)
    cohort = attach_demographics(left, exclude(catalog, bad), DEMOGRAPHICS)
    if drop_missing_path:
        cohort = cohort.dropna(subset=["file_path"])
    return cohort


def label_columns(df: DataFrame, start: int = 1, stop: int = -1) -> list[str]:
    """Label columns found by position (all but the key and the trailing column)."""
    return df.columns[start:stop]


def label_prevalence(df: DataFrame, labels: list[str] | None = None, with_share: bool = False) -> DataFrame:
    """Positives per label, ascending (optionally with the share of all
    positives in percent).

    One global aggregate with a sum per label (map-side partial sums, a
    single tiny final step), then the one-row result is unpivoted: the wide
    table is never exploded or shuffled, and the total comes from the same
    aggregate row.
    """
    labels = labels or LABELS
    sums = df.agg(*[F.expr(f"CAST(coalesce(sum(`{c}`), 0) AS BIGINT)").alias(c) for c in labels])
    sums = sums.withColumn("_total", F.expr(" + ".join(f"`{c}`" for c in labels)))
    long = sums.unpivot(["_total"], labels, "label", "positives")
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    out = long.withColumn("label_idx", (order - 1).cast("int"))
    cols = ["label", "positives", "label_idx"]
    if with_share:
        out = out.withColumn("share_pct", F.col("positives") * 100.0 / F.col("_total"))
        cols.append("share_pct")
    # one row per label: sort in a single partition (no range-sampling job)
    return out.select(*cols).repartition(1).sortWithinPartitions("positives", "label_idx")


def label_share(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Share of each label in percent of all positives."""
    return label_prevalence(df, labels, with_share=True)


def cohort_counts(joined: DataFrame) -> DataFrame:
    """Row counts of the cohort stages from one pass over the joined table."""
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("file_path").isNotNull()).alias("n_with_path"),
        F.count_if(F.col("age_raw").isNotNull()).alias("n_with_demographics"),
        F.count_if(F.col("file_path").isNotNull() & F.col("age_raw").isNotNull()).alias("n_complete"),
    )


def normal_vs_sick(df: DataFrame, flag: str = "no_finding") -> DataFrame:
    return df.agg(F.count_if(F.col(flag) == 1).alias("normal"), F.count_if(F.col(flag) != 1).alias("sick"))


def add_age_features(df: DataFrame, age_raw: str = "age_raw", materialize: bool = False) -> DataFrame:
    """Training features: parsed age, NULL -> exact median, age_norm = age/100,
    sex_bin (exact 'M'), view category and group key.

    The median needs a full pass before rows can be filled. With
    ``materialize=True`` the input is checkpointed once to the shared
    ``spark.checkpoint.dir`` (lineage cut, survives executor loss), so the
    joins that produced it run once instead of twice.
    """
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    parsed = df.withColumn("age_years", parse_age(age_raw))
    med = scalar(parsed.agg(F.median("age_years")))
    return parsed.withColumns({
        "age_years": F.coalesce(F.col("age_years").cast("double"), F.lit(med).cast("double")),
    }).withColumns({
        "age_norm": train_age_norm("age_years"),
        "sex_bin": train_sex_bin("gender"),
        "view_cat": parse_view("view_position"),
        "group_key": group_key("patient_id", "idx"),
    })


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values of ``col`` (e.g. patients). ``approx=True``
    uses HyperLogLog++ (``approx_count_distinct``): mergeable sketches, no
    shuffle of the values -- the choice for very large tables."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
    return df.agg(agg.alias("n_distinct"))


def age_median(df: DataFrame, age: str = "age") -> DataFrame:
    """Exact, interpolated median (Spark keeps a value->count map, so memory
    follows the number of distinct ages, not rows)."""
    return df.agg(F.median(age).alias("median_age"))


def age_mean_trunc(df: DataFrame, age: str = "age", limit: int = 100) -> DataFrame:
    """int(mean of ages below ``limit``)."""
    m = F.avg(F.when(F.col(age) < limit, F.col(age)))
    return df.agg(F.when(m >= 0, F.floor(m)).otherwise(F.ceil(m)).cast("int").alias("mean_age_trunc"))


def cap_age(df: DataFrame, age: str = "age", limit: int = 100) -> DataFrame:
    """Ages above ``limit`` replaced by int(mean of ages below ``limit``)."""
    fill = scalar(age_mean_trunc(df, age, limit))
    return df.withColumn(age, F.when(F.col(age) > limit, F.lit(fill)).otherwise(F.col(age)))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    med = scalar(df.agg(F.median(col)))
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(med).cast("double")))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None,
              log_count: bool = True) -> DataFrame:
    """Equal-width histogram over [min, max] (per ``by`` group when given).

    The last bin is closed. All ``bins`` bins are returned, empty ones with
    count 0; ``interval`` is '<left> to <right>' with edges truncated to
    integers; ``log_count`` is ln(count) (NULL for empty bins).

    When all values are equal the range is widened by 0.5 on both sides.

    Work: counts of distinct (group, value) pairs; ranges, bins and counts come
    from that small table. Without groups the range is found first and becomes
    two literals, so nothing is joined to the data, which is scanned twice.
    """
    key = by or "_g"
    vals = (df.where(f"`{value}` IS NOT NULL").selectExpr(f"{f'`{by}`' if by else '0'} AS `{key}`",
                                                          f"CAST(`{value}` AS DOUBLE) AS _x")
              .groupBy(key, "_x").agg(F.count(F.lit(1)).alias("_n")))
    span = ["IF(min(_x) = max(_x), min(_x) - 0.5D, min(_x)) AS lo", "IF(min(_x) = max(_x), max(_x) + 0.5D, max(_x)) AS hi"]
    if by:
        rng = vals.groupBy(key).agg(*[F.expr(x) for x in span])
        data = vals.join(rng, key)
    else:
        lo, hi = vals.agg(*[F.expr(x) for x in span]).first()
        if lo is None:
            rng = vals.selectExpr(f"`{key}`", "_x AS lo", "_x AS hi").limit(0)
            data = vals.withColumns({"lo": F.col("_x"), "hi": F.col("_x")})
        else:
            rng = df.sparkSession.range(1).select(F.lit(0).alias(key), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            data = vals.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
    rng = rng.selectExpr("*", f"(hi - lo) / {float(bins)}D AS width")
    # bin from the ratio (x-lo)*bins/(hi-lo); the maximum goes to the last bin
    bin_sql = f"CAST(least(floor((_x - lo) * {float(bins)}D / (hi - lo)), {bins - 1}) AS INT)"
    counts = data.selectExpr(f"`{key}`", f"{bin_sql} AS bin", "_n").groupBy(key, "bin").agg(F.sum("_n").alias("count"))
    frame = rng.selectExpr(f"`{key}`", "lo", "hi", "width", f"explode(sequence(0, {bins - 1})) AS bin")
    edges = frame.join(counts, [key, "bin"], "left").selectExpr(
        f"`{key}`", "bin", "lo + bin * width AS left",
        f"CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * width END AS right",
        "CAST(coalesce(count, 0) AS BIGINT) AS count")
    trunc = "CAST(CASE WHEN {0} >= 0 THEN floor({0}) ELSE ceil({0}) END AS BIGINT)"
    cols = ([f"`{key}`"] if by else []) + [
        "bin", "left", "right",
        f"concat(CAST({trunc.format('left')} AS STRING), ' to ', CAST({trunc.format('right')} AS STRING)) AS interval",
        "count"] + (["CASE WHEN count > 0 THEN ln(CAST(count AS DOUBLE)) END AS log_count"] if log_count else [])
    return edges.selectExpr(*cols)


def row_numbers(df: DataFrame, order: list[str], out: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in ``order`` -- distributed.

    Range partitioning (sampled boundaries, so balanced) plus a sort within
    each partition gives each row a local index (from
    ``monotonically_increasing_id``: partition id in the upper bits, index in
    the lower 33). Per-partition counts -- one row per partition -- are
    summed into offsets and added back through a broadcast join whose size is
    bounded by the partition count. No step moves all rows to one task
    (a global ``offset`` or ``row_number()`` window would).
    """
    from pyspark.sql import Window
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    srt = ranged.sortWithinPartitions(*order)
    srt = srt.withColumn("_mid", F.monotonically_increasing_id())
    srt = srt.withColumns({"_pid": F.shiftright(F.col("_mid"), 33), "_loc": F.col("_mid").bitwiseAND((1 << 33) - 1)})
    # materialize the numbered rows so the counts and the rows come from one evaluation
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    srt = srt.checkpoint(eager=True)
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (srt.join(F.broadcast(offsets), "_pid")
               .withColumn(out, F.col("_off") + F.col("_loc"))
               .drop("_mid", "_pid", "_loc", "_off"))


def row_at(df: DataFrame, order: list[str], position: int, near: int = 10_000) -> DataFrame:
    """The row at a 0-based position of an explicit order. A position under
    ``near`` is the last of an ordered limit (each task keeps that many rows);
    a deeper one is found by ``row_numbers``."""
    if position < near:
        return df.orderBy(*order).offset(position).limit(1)
    return row_numbers(df, order).where(F.col("row_no") == position).select(*df.columns)


def discover_categories(df: DataFrame, col: str, max_categories: int | None = None) -> list[str]:
    """Sorted distinct non-null values of a low-cardinality column. They become
    columns of the plan, so the caller vouches for their number, or gives
    ``max_categories``: then more is an error."""
    distinct = df.select(col).distinct()
    found = (distinct.limit(max_categories + 1) if max_categories else distinct).collect()
    if max_categories and len(found) > max_categories:
        raise ValueError(f"{col}: more than {max_categories} categories; not a categorical column")
    return sorted(r[0] for r in found if r[0] is not None)


def onehot_from_data(df: DataFrame, col: str, prefix: str, max_categories: int | None = None) -> DataFrame:
    """One 0/1 column per category found in the data (pandas-style dummies,
    sorted). Rows are never pivoted or shuffled; only the categories are
    collected."""
    cats = discover_categories(df, col, max_categories)
    return df.withColumns({f"{prefix}{c}": (F.col(col) == c).cast("int") for c in cats})


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
