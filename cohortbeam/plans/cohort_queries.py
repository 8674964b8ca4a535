"""Cohort assembly, features, EDA aggregates, split (queries + oracle SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import LABELS
from ..functions import features as feat
from ..operators import cohort as co
from ..operators import joins as jn
from ..operators import split as sp
from .catalog import query
from .oracle_views import sql

_L = ", ".join(LABELS)


def cohort(spark, d, **kw):
    return co.build_cohort(fx.label_matrix(spark, d), fx.paths(spark, d), fx.studies(spark, d),
                           fx.bad_labels(spark, d), **kw)


# ---------------------------------------------------------------- cohort SQL
COHORT_BODY = """
  SELECT l.*, p.file_path, s.patient_id, s.age_raw, s.gender, s.view_position
  FROM (SELECT * FROM label_matrix WHERE idx NOT IN (SELECT idx FROM bad_labels)) l
  LEFT JOIN paths p ON l.idx = p.idx
  LEFT JOIN (SELECT * FROM studies WHERE idx NOT IN (SELECT idx FROM bad_labels)) s ON l.idx = s.idx
  WHERE p.file_path IS NOT NULL"""
COHORT_VIEWS = ["studies", "label_matrix", "bad_labels", "paths"]


def cohort_sql(body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    return sql(COHORT_VIEWS, body, [("cohort", COHORT_BODY)] + (ctes or []))


_prev_union = "\nUNION ALL ".join(
    f"SELECT '{n}' AS label, CAST(coalesce(sum({n}), 0) AS BIGINT) AS positives, {k} AS label_idx FROM cohort"
    for k, n in enumerate(LABELS))


@query("label_prevalence", cohort_sql(f"SELECT * FROM ({_prev_union}) ORDER BY positives, label_idx"), bench=True)
def q_label_prevalence(spark, d):
    """Flagship: studies minus exclusions, joined to labels and paths; positives per label."""
    return co.label_prevalence(cohort(spark, d))


@query("label_share", cohort_sql(f"""SELECT label, positives, label_idx,
  round(CAST(positives AS DOUBLE) * 100.0 / sum(positives) OVER (), 6) AS share_pct FROM ({_prev_union})"""))
def q_label_share(spark, d):
    return co.label_share(cohort(spark, d)).withColumn("share_pct", F.round("share_pct", 6))


# ------------------------------------------------------------------- joins
@query("join_paths", sql(["label_matrix", "paths"], """
SELECT l.idx, l.no_finding, p.file_path FROM label_matrix l LEFT JOIN paths p ON l.idx = p.idx"""))
def q_join_paths(spark, d):
    return jn.attach_paths(fx.label_matrix(spark, d), fx.paths(spark, d)).select("idx", "no_finding", "file_path")


@query("anti_bad_labels", sql(["studies", "bad_labels"], """
SELECT idx, patient_id FROM studies s WHERE NOT EXISTS (SELECT 1 FROM bad_labels b WHERE b.idx = s.idx)"""))
def q_anti_bad_labels(spark, d):
    return jn.exclude(fx.studies(spark, d), fx.bad_labels(spark, d)).select("idx", "patient_id")


@query("join_demographics", cohort_sql("""
SELECT idx, file_path, patient_id, age_raw, gender, view_position FROM cohort"""))
def q_join_demographics(spark, d):
    return cohort(spark, d).select("idx", "file_path", "patient_id", "age_raw", "gender", "view_position")


@query("join_coalesce", sql(["label_matrix", "paths", "paths_alt"], """
SELECT l.idx, coalesce(a.file_path, p.file_path) AS file_path
FROM label_matrix l LEFT JOIN paths_alt a ON l.idx = a.idx LEFT JOIN paths p ON l.idx = p.idx"""))
def q_join_coalesce(spark, d):
    left = fx.label_matrix(spark, d).select("idx").join(fx.paths_alt(spark, d), "idx", "left")
    return jn.join_coalesce(left, fx.paths(spark, d), "idx", ["file_path"])


@query("drop_null_path", sql(["label_matrix", "paths"], """
SELECT l.idx, p.file_path, l.no_finding FROM label_matrix l JOIN paths p ON l.idx = p.idx WHERE p.file_path IS NOT NULL"""))
def q_drop_null_path(spark, d):
    j = jn.attach_paths(fx.label_matrix(spark, d), fx.paths(spark, d)).dropna(subset=["file_path"])
    return j.select("idx", "file_path", "no_finding")


@query("cohort_counts", sql(COHORT_VIEWS, """
SELECT count(*) AS n_rows, count(file_path) AS n_with_path, count(age_raw) AS n_with_demographics,
       count(*) FILTER (WHERE file_path IS NOT NULL AND age_raw IS NOT NULL) AS n_complete FROM joined""",
    [("joined", """
  SELECT l.idx, p.file_path, s.age_raw
  FROM (SELECT * FROM label_matrix WHERE idx NOT IN (SELECT idx FROM bad_labels)) l
  LEFT JOIN paths p ON l.idx = p.idx
  LEFT JOIN (SELECT * FROM studies WHERE idx NOT IN (SELECT idx FROM bad_labels)) s ON l.idx = s.idx""")]))
def q_cohort_counts(spark, d):
    return co.cohort_counts(cohort(spark, d, drop_missing_path=False))


# ------------------------------------------------------------- projections
@query("rename", sql(["studies"], "SELECT idx AS \"Index\", age_raw AS \"PatientAge\" FROM studies"))
def q_rename(spark, d):
    return fx.studies(spark, d).withColumnsRenamed({"idx": "Index", "age_raw": "PatientAge"}).select("Index", "PatientAge")


@query("drop_if_exists", sql(["label_matrix"], f"SELECT idx, {_L} FROM label_matrix"))
def q_drop_if_exists(spark, d):
    # dropping a column that is absent is a no-op; no_finding is present and goes
    return fx.label_matrix(spark, d).drop("no_finding", "not_there")


@query("strip_columns", sql(["studies"], "SELECT idx AS idx, gender AS gender FROM studies"))
def q_strip_columns(spark, d):
    s = fx.studies(spark, d).select(F.col("idx").alias(" idx "), F.col("gender").alias("gender  "))
    return s.toDF(*[c.strip() for c in s.columns])


@query("label_columns", sql(["label_matrix"], "\nUNION ALL ".join(
    f"SELECT idx, {k} AS pos, '{n}' AS label FROM label_matrix WHERE {n} = 1" for k, n in enumerate(LABELS))))
def q_label_columns(spark, d):
    """Label columns found by position (between the key and the trailing
    no_finding column), then every set flag of every row in long form."""
    lm = fx.label_matrix(spark, d)
    names = co.label_columns(lm)
    long = lm.select("idx", F.posexplode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("flag"))
                                                    for n in names])).alias("pos", "e"))
    return long.where(F.col("e.flag") == 1).select("idx", "pos", F.col("e.label").alias("label"))


@query("age_outliers", sql(["studies"], """
SELECT idx, age FROM (SELECT idx, CASE WHEN regexp_matches(replace(age_raw, 'Y', ''), '^\\s*[+-]?[0-9]+\\s*$')
  THEN TRY_CAST(trim(replace(age_raw, 'Y', '')) AS INTEGER) END AS age FROM studies) WHERE age > 100"""))
def q_age_outliers(spark, d):
    s = fx.studies(spark, d).select("idx", feat.parse_age("age_raw").alias("age"))
    return s.where(F.col("age") > 100)


@query("row_offset", sql(["studies"], "SELECT idx, gender FROM studies ORDER BY idx OFFSET 89"))
def q_row_offset(spark, d):
    """Tail of the catalog from a row position, in an explicit key order."""
    r = co.row_numbers(fx.studies(spark, d).select("idx", "gender"), ["idx"])
    return r.where(F.col("row_no") >= 89).select("idx", "gender")


@query("row_at", sql(["studies"], "SELECT idx, gender FROM studies ORDER BY idx LIMIT 1 OFFSET 7"))
def q_row_at(spark, d):
    """One row by its position in an explicit key order."""
    return co.row_at(fx.studies(spark, d).select("idx", "gender"), ["idx"], 7)


# --------------------------------------------------------------- features
AGE_SQL = """CASE WHEN regexp_matches(replace(age_raw, 'Y', ''), '^\\s*[+-]?[0-9]+\\s*$')
  THEN TRY_CAST(trim(replace(age_raw, 'Y', '')) AS INTEGER) END"""


@query("parse_age", sql(["studies"], f"SELECT idx, age_raw, {AGE_SQL} AS age FROM studies"))
def q_parse_age(spark, d):
    return fx.studies(spark, d).select("idx", "age_raw", feat.parse_age("age_raw").alias("age"))


@query("age_median", sql(["studies"], f"SELECT median({AGE_SQL}) AS median_age FROM studies"))
def q_age_median(spark, d):
    return co.age_median(fx.studies(spark, d).select(feat.parse_age("age_raw").alias("age")))


@query("age_mean_trunc", sql(["studies"], f"""
SELECT CAST(trunc(avg(CASE WHEN a < 100 THEN a END)) AS INTEGER) AS mean_age_trunc
FROM (SELECT {AGE_SQL} AS a FROM studies)"""))
def q_age_mean_trunc(spark, d):
    return co.age_mean_trunc(fx.studies(spark, d).select(feat.parse_age("age_raw").alias("age")))


@query("impute_age", sql(["studies"], f"""
SELECT idx, round(coalesce(CAST(a AS DOUBLE), (SELECT median(a) FROM (SELECT {AGE_SQL} AS a FROM studies))), 6) AS age
FROM (SELECT idx, {AGE_SQL} AS a FROM studies)"""))
def q_impute_age(spark, d):
    s = fx.studies(spark, d).select("idx", feat.parse_age("age_raw").alias("age"))
    return co.impute_median(s, "age").withColumn("age", F.round("age", 6))


@query("cap_age_mean", sql(["studies"], f"""
SELECT idx, CASE WHEN a > 100 THEN (SELECT CAST(trunc(avg(CASE WHEN a < 100 THEN a END)) AS INTEGER)
                                    FROM (SELECT {AGE_SQL} AS a FROM studies)) ELSE a END AS age
FROM (SELECT idx, {AGE_SQL} AS a FROM studies)"""))
def q_cap_age_mean(spark, d):
    s = fx.studies(spark, d).select("idx", feat.parse_age("age_raw").alias("age"))
    return co.cap_age(s, "age")


@query("age_range", sql(["studies"], f"SELECT max(a) - min(a) AS age_range FROM (SELECT {AGE_SQL} AS a FROM studies)"))
def q_age_range(spark, d):
    s = fx.studies(spark, d).select(feat.parse_age("age_raw").alias("a"))
    return s.agg((F.max("a") - F.min("a")).alias("age_range"))


@query("distinct_patients", sql(["studies"], "SELECT count(DISTINCT patient_id) AS n_patients FROM studies"))
def q_distinct_patients(spark, d):
    return fx.studies(spark, d).agg(F.countDistinct("patient_id").alias("n_patients"))


@query("normal_vs_sick", sql(["label_matrix"], """
SELECT count(*) FILTER (WHERE no_finding = 1) AS normal, count(*) FILTER (WHERE no_finding <> 1) AS sick
FROM label_matrix"""))
def q_normal_vs_sick(spark, d):
    return co.normal_vs_sick(fx.label_matrix(spark, d))


def _hist_sql(bins: int, by: str | None) -> str:
    src = f"SELECT {by + ' AS g' if by else '0 AS g'}, CAST({AGE_SQL} AS DOUBLE) AS x FROM studies"
    where = f"WHERE {by} IN ('M', 'F')" if by else ""
    sel_key = "g AS gender, " if by else ""
    return sql(["studies"], f"""
SELECT {sel_key}bin, round("left", 6) AS "left", round("right", 6) AS "right",
  CAST(CAST(trunc("left") AS BIGINT) AS VARCHAR) || ' to ' || CAST(CAST(trunc("right") AS BIGINT) AS VARCHAR) AS interval,
  count, round(CASE WHEN count > 0 THEN ln(count) END, 6) AS log_count
FROM edges""", [
        ("data", f"SELECT * FROM ({src} {where}) WHERE x IS NOT NULL"),
        ("ends", """SELECT g, min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0.0 END AS lo,
          max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0.0 END AS hi FROM data GROUP BY g"""),
        ("rng", f"SELECT g, lo, hi, (hi - lo) / {float(bins)} AS width FROM ends"),
        ("cnt", f"""SELECT d.g, CAST(least(floor((d.x - r.lo) * {float(bins)} / (r.hi - r.lo)), {bins - 1}) AS INTEGER) AS bin,
        count(*) AS n FROM data d JOIN rng r ON d.g = r.g GROUP BY 1, 2"""),
        ("frame", f"SELECT r.*, CAST(b.bin AS INTEGER) AS bin FROM rng r, range(0, {bins}) AS b(bin)"),
        ("edges", f"""SELECT f.g, f.bin, f.lo + f.bin * f.width AS "left",
          CASE WHEN f.bin = {bins - 1} THEN f.hi ELSE f.lo + (f.bin + 1) * f.width END AS "right",
          CAST(coalesce(c.n, 0) AS BIGINT) AS count
          FROM frame f LEFT JOIN cnt c ON f.g = c.g AND f.bin = c.bin"""),
    ])


def _round_hist(df):
    return df.withColumns({c: F.round(c, 6) for c in ["left", "right", "log_count"]})


@query("age_histogram", _hist_sql(30, None))
def q_age_histogram(spark, d):
    s = fx.studies(spark, d).select(feat.parse_age("age_raw").alias("age"))
    return _round_hist(co.histogram(s, "age", 30))


@query("age_histogram_gender", _hist_sql(95, "gender"))
def q_age_histogram_gender(spark, d):
    s = fx.studies(spark, d).where(F.col("gender").isin("M", "F")).select("gender", feat.parse_age("age_raw").alias("age"))
    return _round_hist(co.histogram(s, "age", 95, by="gender"))


AGE_INPUTS = ["idx", "patient_id", "age_raw", "gender", "view_position"]  # all that the checkpoint has to hold

# training features ---------------------------------------------------------
PARSED = ("parsed", f"SELECT *, {AGE_SQL} AS age_i FROM cohort")
TRAIN_FEATURES_SQL = cohort_sql("""
SELECT idx,
  round(coalesce(CAST(age_i AS DOUBLE), (SELECT median(age_i) FROM parsed)) / 100.0, 6) AS age_norm,
  CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS sex_bin,
  CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS view_cat,
  coalesce(CAST(patient_id AS VARCHAR), CAST(idx AS VARCHAR)) AS group_key
FROM parsed""", [PARSED])


@query("train_features", TRAIN_FEATURES_SQL)
def q_train_features(spark, d):
    f = co.add_age_features(cohort(spark, d).select(*AGE_INPUTS), materialize=True)
    return f.select("idx", F.round("age_norm", 6).alias("age_norm"), "sex_bin", "view_cat", "group_key")


@query("parse_view", sql(["studies"], """
SELECT idx, CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS view_cat FROM studies"""))
def q_parse_view(spark, d):
    return fx.studies(spark, d).select("idx", feat.parse_view("view_position").alias("view_cat"))


@query("group_key", sql(["studies"], "SELECT idx, coalesce(CAST(patient_id AS VARCHAR), CAST(idx AS VARCHAR)) AS group_key FROM studies"))
def q_group_key(spark, d):
    return fx.studies(spark, d).select("idx", feat.group_key("patient_id", "idx").alias("group_key"))


@query("onehot_view", sql(["studies"], """
SELECT idx, CAST(c = 'AP' AS INTEGER) AS view_AP, CAST(c = 'PA' AS INTEGER) AS view_PA,
       CAST(c = 'UNK' AS INTEGER) AS view_UNK FROM v""", [("v", """SELECT idx,
  CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS c FROM studies""")]))
def q_onehot_view(spark, d):
    s = fx.studies(spark, d).select("idx", feat.parse_view("view_position").alias("view_cat"))
    return co.onehot_from_data(s, "view_cat", "view_").drop("view_cat")


@query("feature_vector", cohort_sql("""
SELECT idx, pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS value FROM (
  SELECT idx, 0 AS pos, age_norm AS v FROM f UNION ALL SELECT idx, 1, sex_bin FROM f
  UNION ALL SELECT idx, 2, CASE WHEN c = 'AP' THEN 1.0 ELSE 0.0 END FROM f
  UNION ALL SELECT idx, 3, CASE WHEN c = 'PA' THEN 1.0 ELSE 0.0 END FROM f)""", [PARSED, ("f", """
  SELECT idx, coalesce(CAST(age_i AS DOUBLE), (SELECT median(age_i) FROM parsed)) / 100.0 AS age_norm,
  CASE WHEN gender = 'M' THEN 1.0 ELSE 0.0 END AS sex_bin,
  CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS c FROM parsed""")]))
def q_feature_vector(spark, d):
    f = co.add_age_features(cohort(spark, d).select(*AGE_INPUTS), materialize=True)
    f = f.withColumns({"view_AP": (F.col("view_cat") == "AP").cast("double"),
                       "view_PA": (F.col("view_cat") == "PA").cast("double"),
                       "sex_bin": F.col("sex_bin").cast("double")})
    v = f.select("idx", feat.feature_vector().alias("features"))
    x = v.select("idx", F.posexplode("features").alias("pos", "value"))
    return x.select("idx", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


# ------------------------------------------------------------------- split
SPLIT_SQL = """CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END"""
U_SQL = "CAST(('0x' || substr(md5('42:' || group_key), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"


@query("group_split", sql(["groups"], f"SELECT idx, group_key, {SPLIT_SQL} AS split FROM (SELECT *, {U_SQL} AS u FROM groups)"), bench=True)
def q_group_split(spark, d):
    return sp.group_split(fx.groups(spark, d), "group_key", seed=42).select("idx", "group_key", "split")


@query("split_sizes", sql(["groups"], f"""
SELECT split, count(*) AS n FROM (SELECT {SPLIT_SQL} AS split FROM (SELECT *, {U_SQL} AS u FROM groups)) GROUP BY split"""))
def q_split_sizes(spark, d):
    return co.split_sizes(sp.group_split(fx.groups(spark, d), "group_key", seed=42))


@query("split_leakage", sql(["groups"], f"""
SELECT count(*) AS n_leaking FROM (SELECT group_key FROM (SELECT group_key, {SPLIT_SQL} AS split
  FROM (SELECT *, {U_SQL} AS u FROM groups)) GROUP BY group_key HAVING count(DISTINCT split) > 1)"""))
def q_split_leakage(spark, d):
    leaks = sp.split_leakage(sp.group_split(fx.groups(spark, d), "group_key", seed=42), "group_key")
    return leaks.agg(F.count(F.lit(1)).alias("n_leaking"))
