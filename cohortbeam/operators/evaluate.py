"""Exact, parallel evaluation of scores against truth.

Input everywhere is the long table ``(image_key, label, score, truth)``.
Step 1 collapses it to distinct ``(label, score)`` groups with positive and
negative counts, which makes ties exact and bounds everything after it by
the number of distinct scores instead of rows.

ROC points need running sums of those counts in descending score order per
label. A window partitioned by label alone would put each label (a third of
the rows, say) into one task, so the running sum is done in two levels:

* the distinct groups are range-partitioned by (label, score) -- boundaries are
  sampled from the data, so partitions are balanced whatever the scores look
  like (a narrow range, ties, infinities) -- and checkpointed once;
* running sums inside each (partition, label), plus the totals of the label's
  earlier partitions (one row per partition and label).

Rows without score or truth, and NaN scores, are left out; infinite scores are
ordinary scores. The result equals the plain label-partitioned window
(``two_level=False``, kept for tests).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS

def align_scores(scores: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scores and truth matched by key (image, label) -- never by position."""
    return scores.join(truth, keys or ["image_key", "label"], "inner")


def score_groups(scored: DataFrame) -> DataFrame:
    """Distinct (label, score) with pos/neg counts (rows with NULL score or
    truth, and NaN scores, are left out)."""
    s = scored.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & F.col("truth").isNotNull())
    return s.groupBy("label", "score").agg(
        F.sum(F.col("truth").cast("long")).alias("pos"),
        F.sum(1 - F.col("truth").cast("long")).alias("neg"))


def roc_points(scored: DataFrame, two_level: bool = True) -> DataFrame:
    """Per label and distinct score (high -> low): pos, neg of the group and
    cumulative tp, fp including it, plus the label totals pos_all, neg_all.

    One scan of ``scored`` (partial aggregate first, so tied or hot scores
    collapse before the shuffle); everything after it works on the distinct
    groups, range-partitioned and checkpointed to the shared folder.
    """
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    g = score_groups(scored)
    if not two_level:
        return g.selectExpr(
            "label", "score", "pos", "neg",
            f"sum(pos) OVER (PARTITION BY label ORDER BY score DESC {running}) AS tp",
            f"sum(neg) OVER (PARTITION BY label ORDER BY score DESC {running}) AS fp",
            "sum(pos) OVER (PARTITION BY label) AS pos_all", "sum(neg) OVER (PARTITION BY label) AS neg_all")
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(scored.sparkSession)
    ranged = (g.repartitionByRange("label", F.desc("score")).withColumn("part", F.spark_partition_id())
              .checkpoint(eager=True))
    earlier = "ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = ranged.groupBy("label", "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).selectExpr(
        "label", "part",
        f"coalesce(sum(p) OVER (PARTITION BY label {earlier}), 0) AS pos_before",
        f"coalesce(sum(n) OVER (PARTITION BY label {earlier}), 0) AS neg_before",
        "sum(p) OVER (PARTITION BY label) AS pos_all", "sum(n) OVER (PARTITION BY label) AS neg_all")
    local = ranged.selectExpr(
        "label", "part", "score", "pos", "neg",
        f"sum(pos) OVER (PARTITION BY label, part ORDER BY score DESC {running}) AS tp_in",
        f"sum(neg) OVER (PARTITION BY label, part ORDER BY score DESC {running}) AS fp_in")
    return local.join(offsets, ["label", "part"], "inner").selectExpr(
        "label", "score", "pos", "neg", "pos_before + tp_in AS tp", "neg_before + fp_in AS fp", "pos_all", "neg_all")


def roc_curve(points: DataFrame, with_start: bool = True) -> DataFrame:
    """(label, threshold, fpr, tpr) for each distinct score, plus the start
    point (0, 0, +inf). Labels without both classes get NULL rates.

    The start point is emitted next to each label's highest-score group --
    the one group whose cumulative counts equal its own (tp = pos, fp = neg)
    -- so no second pass over the points is needed.
    """
    row = ("named_struct('threshold', score, 'fpr', IF(neg_all > 0, fp / neg_all, NULL), "
           "'tpr', IF(pos_all > 0, tp / pos_all, NULL))")
    if not with_start:
        return points.selectExpr("label", f"{row} AS r").selectExpr("label", "r.*")
    start = ("named_struct('threshold', CAST('inf' AS DOUBLE), 'fpr', IF(neg_all > 0, 0.0D, NULL), "
             "'tpr', IF(pos_all > 0, 0.0D, NULL))")
    rows = f"IF(tp = pos AND fp = neg, array({start}, {row}), array({row}))"
    return points.selectExpr("label", f"explode({rows}) AS r").selectExpr("label", "r.*")


def label_metrics(points: DataFrame, strict: bool = False) -> DataFrame:
    """One row per label: AUC (ties count 1/2), average precision, the
    Youden-optimal threshold (first, i.e. highest, threshold maximising
    tpr - fpr; +inf when no point beats the start) and its tp/fp -- counted
    with ``score >= threshold``, or ``score > threshold`` when ``strict``
    (the threshold's own score group is then left out).

    Youden's J is compared as the exact integer tp*N - fp*P (decimal(38,0)),
    so ties are exact and the highest threshold wins them.
    """
    j = ("CAST(tp AS DECIMAL(38,0)) * CAST(neg_all AS DECIMAL(38,0)) "
         "- CAST(fp AS DECIMAL(38,0)) * CAST(pos_all AS DECIMAL(38,0))")
    agg = points.groupBy("label").agg(
        F.expr("first(pos_all) AS pos_all"), F.expr("first(neg_all) AS neg_all"),
        F.expr("sum(CAST(neg AS DOUBLE) * CAST(tp - pos AS DOUBLE) + CAST(neg AS DOUBLE) * CAST(pos AS DOUBLE) / 2.0D) AS auc_num"),
        F.expr("sum(CAST(pos AS DOUBLE) * (tp / (tp + fp))) AS ap_num"),
        F.expr(f"max(named_struct('j', {j}, 'thr', score, 'tp', tp, 'fp', fp, 'pos', pos, 'neg', neg)) AS best"))
    tp_at, fp_at = ("best.tp - best.pos", "best.fp - best.neg") if strict else ("best.tp", "best.fp")
    ok = "(pos_all > 0 AND neg_all > 0)"
    return agg.selectExpr(
        "label", "pos_all", "neg_all", f"NOT {ok} AS skipped",
        f"CASE WHEN {ok} THEN auc_num / (CAST(pos_all AS DOUBLE) * CAST(neg_all AS DOUBLE)) END AS auc",
        f"CASE WHEN {ok} THEN ap_num / CAST(pos_all AS DOUBLE) END AS ap",
        f"CASE WHEN {ok} THEN IF(best.j > 0, best.thr, CAST('inf' AS DOUBLE)) END AS threshold",
        f"CAST(CASE WHEN {ok} THEN IF(best.j > 0, {tp_at}, 0) END AS BIGINT) AS tp",
        f"CAST(CASE WHEN {ok} THEN IF(best.j > 0, {fp_at}, 0) END AS BIGINT) AS fp")


def _ratio(num: str, den: str) -> str:
    """num / den as double, 0 when den is 0 (zero-division -> 0)."""
    return f"IF({den} <> 0, CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), 0.0D)"


def confusion_metrics(m: DataFrame) -> DataFrame:
    """Confusion counts at the chosen threshold (``score >= threshold``) and
    the derived rates; a zero denominator gives 0."""
    live = "CASE WHEN NOT skipped THEN {} END"
    c = m.selectExpr("*", "CAST(CASE WHEN NOT skipped THEN pos_all - tp END AS BIGINT) AS fn",
                     "CAST(CASE WHEN NOT skipped THEN neg_all - fp END AS BIGINT) AS tn")
    return c.selectExpr(
        "*",
        live.format(_ratio("tp", "pos_all")) + " AS sensitivity",
        live.format(_ratio("tn", "tn + fp")) + " AS specificity",
        live.format(_ratio("tp + tn", "pos_all + neg_all")) + " AS accuracy",
        live.format(_ratio("tp", "tp + fp")) + " AS precision",
        live.format(_ratio("tp", "tp + fn")) + " AS recall",
        live.format(_ratio("2 * tp", "2 * tp + fp + fn")) + " AS f1")


def eval_report(scored: DataFrame, labels: list[str] | None = None, two_level: bool = True,
                strict: bool = False) -> DataFrame:
    """Per-label report in label order: Pathology, AUC_ROC, AvgPrecision,
    Precision, Recall, F1, Specificity, TP, FP, FN, TN, OptimalThreshold and a
    ``skipped`` flag for labels that lack positives or negatives. ``scored``
    is read once, so it may come straight out of a model."""
    labels = labels or LABELS
    m = confusion_metrics(label_metrics(roc_points(scored, two_level), strict=strict))
    names = ", ".join("'" + x.replace("'", "\\'") + "'" for x in labels)
    return m.selectExpr(
        f"CAST(array_position(array({names}), label) - 1 AS INT) AS label_idx",
        "label AS Pathology", "auc AS AUC_ROC", "ap AS AvgPrecision", "precision AS Precision",
        "recall AS Recall", "f1 AS F1", "specificity AS Specificity", "tp AS TP", "fp AS FP", "fn AS FN",
        "tn AS TN", "threshold AS OptimalThreshold", "skipped",
    ).repartition(1).sortWithinPartitions("label_idx")  # one row per label


def macro_metrics(report: DataFrame) -> DataFrame:
    """Mean AUC and mean AP over the labels that have both classes."""
    return report.agg(F.avg("AUC_ROC").alias("mean_auc"), F.avg("AvgPrecision").alias("mean_ap"),
                      F.count_if(F.col("skipped")).alias("n_skipped"))
