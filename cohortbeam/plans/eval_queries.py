"""Evaluation queries: ROC curve, AUC, AP, Youden threshold, confusion, report."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import LABELS
from ..operators import evaluate as ev
from .catalog import query
from .oracle_views import sql

# Oracle: the same definitions stated as plain SQL windows over the distinct
# (label, score) groups (one window per label: fine for an oracle).
POINTS = [
    ("g", """SELECT label, score, CAST(sum(truth) AS BIGINT) AS pos, CAST(sum(1 - truth) AS BIGINT) AS neg
            FROM {src} WHERE score IS NOT NULL AND truth IS NOT NULL GROUP BY label, score"""),
    ("pts", """SELECT label, score, pos, neg,
              sum(pos) OVER (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
              sum(pos) OVER (PARTITION BY label) AS pos_all, sum(neg) OVER (PARTITION BY label) AS neg_all FROM g"""),
    ("best", """SELECT label, arg_max(score, (CAST(tp AS HUGEINT) * neg_all - CAST(fp AS HUGEINT) * pos_all, score)) AS thr,
              max(CAST(tp AS HUGEINT) * neg_all - CAST(fp AS HUGEINT) * pos_all) AS j,
              arg_max(tp, (CAST(tp AS HUGEINT) * neg_all - CAST(fp AS HUGEINT) * pos_all, score)) AS btp,
              arg_max(fp, (CAST(tp AS HUGEINT) * neg_all - CAST(fp AS HUGEINT) * pos_all, score)) AS bfp
            FROM pts GROUP BY label"""),
    ("m", """SELECT p.label, any_value(p.pos_all) AS pos_all, any_value(p.neg_all) AS neg_all,
              sum(CAST(p.neg AS DOUBLE) * CAST(p.tp - p.pos AS DOUBLE) + CAST(p.neg AS DOUBLE) * CAST(p.pos AS DOUBLE) / 2.0) AS auc_num,
              sum(CAST(p.pos AS DOUBLE) * (p.tp / (p.tp + p.fp))) AS ap_num
            FROM pts p GROUP BY p.label"""),
    ("lm", """SELECT m.label, m.pos_all, m.neg_all, NOT (m.pos_all > 0 AND m.neg_all > 0) AS skipped,
              CASE WHEN m.pos_all > 0 AND m.neg_all > 0 THEN m.auc_num / (CAST(m.pos_all AS DOUBLE) * CAST(m.neg_all AS DOUBLE)) END AS auc,
              CASE WHEN m.pos_all > 0 AND m.neg_all > 0 THEN m.ap_num / CAST(m.pos_all AS DOUBLE) END AS ap,
              CASE WHEN m.pos_all > 0 AND m.neg_all > 0 THEN CASE WHEN b.j > 0 THEN b.thr ELSE 'inf'::DOUBLE END END AS threshold,
              CASE WHEN m.pos_all > 0 AND m.neg_all > 0 THEN CAST(CASE WHEN b.j > 0 THEN b.btp ELSE 0 END AS BIGINT) END AS tp,
              CASE WHEN m.pos_all > 0 AND m.neg_all > 0 THEN CAST(CASE WHEN b.j > 0 THEN b.bfp ELSE 0 END AS BIGINT) END AS fp
            FROM m JOIN best b ON m.label = b.label"""),
    ("cm", """SELECT *, CAST(CASE WHEN NOT skipped THEN pos_all - tp END AS BIGINT) AS fn,
              CAST(CASE WHEN NOT skipped THEN neg_all - fp END AS BIGINT) AS tn FROM lm"""),
    ("rep", """SELECT label, auc, ap, threshold, tp, fp, fn, tn, skipped,
              CASE WHEN NOT skipped THEN CASE WHEN pos_all <> 0 THEN tp / pos_all ELSE 0.0 END END AS sensitivity,
              CASE WHEN NOT skipped THEN CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END END AS specificity,
              CASE WHEN NOT skipped THEN CASE WHEN pos_all + neg_all <> 0 THEN (tp + tn) / (pos_all + neg_all) ELSE 0.0 END END AS accuracy,
              CASE WHEN NOT skipped THEN CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END END AS precision,
              CASE WHEN NOT skipped THEN CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END END AS recall,
              CASE WHEN NOT skipped THEN CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END END AS f1
            FROM cm"""),
]


def eval_sql(body: str, tied: bool = False) -> str:
    src = "tied_scored" if tied else "scored"
    return sql([src], body, [(n, b.replace("{src}", src)) for n, b in POINTS])


def _r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def scored(spark, d, tied=False):
    return fx.scored_long(spark, d, tied=tied)


@query("roc_curve", eval_sql("""
SELECT label, round(score, 6) AS threshold, round(fp / neg_all, 6) AS fpr, round(tp / pos_all, 6) AS tpr FROM pts
WHERE pos_all > 0 AND neg_all > 0
UNION ALL SELECT label, 'inf'::DOUBLE, 0.0, 0.0 FROM m WHERE pos_all > 0 AND neg_all > 0"""))
def q_roc_curve(spark, d):
    c = ev.roc_curve(ev.roc_points(scored(spark, d)))
    return _r6(c.where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull()), ["threshold", "fpr", "tpr"])


@query("roc_auc", eval_sql("SELECT label, round(auc, 6) AS auc FROM lm"))
def q_roc_auc(spark, d):
    """AUC from a scores table and a truth table aligned by (image, label)."""
    names = F.array(*[F.lit(x) for x in LABELS])
    lab = F.element_at(names, F.col("k").cast("int") + 1)
    s = fx.scores(spark, d).select(F.col("vec_id").alias("image_key"), lab.alias("label"), "score")
    t = fx.truth(spark, d).select(F.col("vec_id").alias("image_key"), lab.alias("label"), "truth")
    pts = ev.roc_points(ev.align_scores(s, t))
    return _r6(ev.label_metrics(pts).select("label", "auc"), ["auc"])


@query("average_precision", eval_sql("SELECT label, round(ap, 6) AS ap FROM lm"))
def q_average_precision(spark, d):
    return _r6(ev.label_metrics(ev.roc_points(scored(spark, d))).select("label", "ap"), ["ap"])


@query("youden_threshold", eval_sql("SELECT label, round(threshold, 6) AS threshold, tp, fp FROM lm"))
def q_youden_threshold(spark, d):
    m = ev.label_metrics(ev.roc_points(scored(spark, d)))
    return _r6(m.select("label", "threshold", "tp", "fp"), ["threshold"])


@query("sens_spec", eval_sql("""SELECT r.label, round(r.sensitivity, 3) AS sensitivity,
  round(1.0 - CASE WHEN NOT r.skipped THEN r.fp / l.neg_all END, 3) AS specificity
FROM rep r JOIN lm l ON r.label = l.label"""))
def q_sens_spec(spark, d):
    m = ev.confusion_metrics(ev.label_metrics(ev.roc_points(scored(spark, d))))
    spec = F.when(~F.col("skipped"), 1.0 - F.col("fp") / F.col("neg_all"))
    return m.select("label", F.round("sensitivity", 3).alias("sensitivity"), F.round(spec, 3).alias("specificity"))


@query("confusion", eval_sql("SELECT label, tp, fp, fn, tn FROM cm"))
def q_confusion(spark, d):
    return ev.confusion_metrics(ev.label_metrics(ev.roc_points(scored(spark, d)))).select("label", "tp", "fp", "fn", "tn")


@query("class_metrics", eval_sql("""SELECT label, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity FROM rep"""))
def q_class_metrics(spark, d):
    m = ev.confusion_metrics(ev.label_metrics(ev.roc_points(scored(spark, d))))
    return _r6(m.select("label", "accuracy", "precision", "recall", "f1", "specificity"),
               ["accuracy", "precision", "recall", "f1", "specificity"])


REPORT_SQL_BODY = """
SELECT CAST(n.k AS INTEGER) AS label_idx, r.label AS "Pathology", round(r.auc, 6) AS "AUC_ROC", round(r.ap, 6) AS "AvgPrecision",
  round(r.precision, 6) AS "Precision", round(r.recall, 6) AS "Recall", round(r.f1, 6) AS "F1",
  round(r.specificity, 6) AS "Specificity", r.tp AS "TP", r.fp AS "FP", r.fn AS "FN", r.tn AS "TN",
  round(r.threshold, 6) AS "OptimalThreshold", r.skipped
FROM rep r JOIN label_names n ON n.name = r.label ORDER BY label_idx"""

REPORT_ROUND = ["AUC_ROC", "AvgPrecision", "Precision", "Recall", "F1", "Specificity", "OptimalThreshold"]


@query("eval_report", eval_sql(REPORT_SQL_BODY), bench=True)
def q_eval_report(spark, d):
    return _r6(ev.eval_report(scored(spark, d)), REPORT_ROUND)


@query("eval_report_ties", eval_sql(REPORT_SQL_BODY, tied=True))
def q_eval_report_ties(spark, d):
    """Scores rounded to one decimal: many exact ties per label."""
    return _r6(ev.eval_report(scored(spark, d, tied=True)), REPORT_ROUND)


@query("macro_metrics", eval_sql("""SELECT round(avg(auc), 6) AS mean_auc, round(avg(ap), 6) AS mean_ap,
  count(*) FILTER (WHERE skipped) AS n_skipped FROM lm"""))
def q_macro_metrics(spark, d):
    return _r6(ev.macro_metrics(ev.eval_report(scored(spark, d))), ["mean_auc", "mean_ap"])
