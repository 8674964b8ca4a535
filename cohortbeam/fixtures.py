"""Deterministic stand-in views over the driver tables.

Each view maps a driver table onto one of the reference's input shapes
(study catalog, label matrix, exclusion list, path index, uploads,
registry folders and files, scores, truth, activation tensors, groups).
All of them are plain projections of the source table, so they scale
with it and keep Parquet pushdown/pruning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import LABELS

N_CLASSES = len(LABELS)
EMBED_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study catalog: idx, patient_id, age_raw ('058Y' text), gender, view_position, ts."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS idx",
        "CASE WHEN event_id % 53 = 0 THEN CAST(NULL AS BIGINT) ELSE user_id END AS patient_id",
        "CASE WHEN event_id % 61 = 0 THEN 'abc' ELSE concat(lpad(CAST(floor(value) AS STRING), 3, '0'), 'Y') END AS age_raw",
        "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender",
        "CASE event_type WHEN 'view' THEN 'PA' WHEN 'click' THEN 'AP' WHEN 'purchase' THEN 'AP supine' "
        "WHEN 'signup' THEN 'LL' END AS view_position",
        "ts")


def _flag_sql(k: int) -> str:
    return f"CAST((event_id + {k}) % {k + 11} = 0 AS INT)"


def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide label matrix: idx, 14 label flags, no_finding."""
    flags = [f"{_flag_sql(k)} AS {LABELS[k]}" for k in range(N_CLASSES)]
    none = "CAST(" + " + ".join(_flag_sql(k) for k in range(N_CLASSES)) + " = 0 AS INT) AS no_finding"
    return table(spark, sf_dir, "events").selectExpr("event_id AS idx", *flags, none)


def bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 97 = 0").selectExpr("event_id AS idx")


def _image_path_sql(prefix: str) -> str:
    return (f"concat('{prefix}images_', lpad(CAST(event_id % 12 + 1 AS STRING), 3, '0'), '/images/', "
            f"lpad(CAST(event_id AS STRING), 8, '0'), '.png')")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path index: idx -> file_path; no row when event_id % 101 = 0."""
    return (table(spark, sf_dir, "events").where("event_id % 101 <> 0")
            .selectExpr("event_id AS idx", f"{_image_path_sql('')} AS file_path"))


def paths_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second path source (the label file's own path column); no row when % 103 = 0."""
    return (table(spark, sf_dir, "events").where("event_id % 103 <> 0")
            .selectExpr("event_id AS idx", f"{_image_path_sql('alt/')} AS file_path"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload records: idx, name, age, gender, view, content (bytes: PNG
    signature, JPEG signature or junk, by key)."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS idx",
        "CASE WHEN p_partkey % 29 = 0 THEN CAST(p_partkey AS STRING) ELSE p_name END AS name",
        "p_size * 4 - 20 AS age",
        "CASE p_size % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'm' WHEN 3 THEN 'f' WHEN 4 THEN 'X' END AS gender",
        "CASE p_type WHEN 'ECONOMY' THEN 'AP' WHEN 'LARGE' THEN 'PA' WHEN 'MEDIUM' THEN 'ap' WHEN 'PROMO' THEN 'pa' "
        "WHEN 'SMALL' THEN 'LL' WHEN 'STANDARD' THEN 'AP' END AS view",
        "CASE WHEN p_partkey % 17 = 0 THEN encode(p_name, 'UTF-8') "
        "WHEN p_partkey % 3 = 0 THEN concat(unhex('FFD8FFE0'), encode(p_name, 'UTF-8')) "
        "ELSE concat(unhex('89504E470D0A1A0A'), encode(p_name, 'UTF-8')) END AS content")


def upload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row patient JSON text plus image bytes (null for some rows)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS idx",
        "CASE WHEN event_id % 19 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 29 = 0 THEN '{\"name\": ' "
        "WHEN event_id % 31 = 0 THEN concat('{\"name\": \"P', user_id, '\"}') "
        "ELSE concat('{\"name\": \"P', user_id, '\", \"age\": \"', CAST(floor(value) AS BIGINT), "
        "'\", \"gender\": \"', IF(user_id % 2 = 0, 'm', 'F'), '\", \"view\": \"', IF(user_id % 3 = 0, '', 'pa'), '\"}') END AS patient_json",
        "CASE WHEN event_id % 23 = 0 THEN CAST(NULL AS BINARY) "
        "ELSE concat(unhex('89504E470D0A1A0A'), encode(event_type, 'UTF-8')) END AS content")


def folder_date(col: Column) -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), (col % 60).cast("int"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry folders: folder key from name + date, some malformed keys."""
    from .functions.text import folder_key
    p = table(spark, sf_dir, "part")
    d = folder_date(F.col("p_partkey"))
    key = F.when(F.col("p_partkey") % 31 == 0, F.concat(F.lit("run_"), F.col("p_partkey").cast("string"))
                 ).otherwise(folder_key(F.col("p_name"), d))
    return p.select(F.col("p_partkey").alias("idx"), key.alias("folder_name"), d.alias("run_date"),
                    F.col("p_name").alias("patient_name"), F.col("p_size"), F.col("p_type"))


FILE_NAMES = ["original.png", "gradcam_Mass.png", "metadata.json", "predictions.json"]
FILE_MISSING_MOD = {"original.png": 7, "gradcam_Mass.png": 5, "metadata.json": 11, "predictions.json": 13}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (folder, file); a file is missing when idx % its modulus = 0."""
    names = ", ".join(f"'{n}'" for n in FILE_NAMES)
    keep = " OR ".join(f"(file_name = '{n}' AND idx % {m} <> 0)" for n, m in FILE_MISSING_MOD.items())
    return (folders(spark, sf_dir).selectExpr("idx", "folder_name", f"explode(array({names})) AS file_name")
            .where(keep))


def weight(i: Column, k: Column | int) -> Column:
    """w(i,k) = ((i*7 + k*5) % 13 - 6) / 10 for feature i in 1..64, class k in 0..13."""
    return ((i * 7 + F.lit(k) * 5) % 13 - 6).cast("double") / 10.0


def _class_score_sql(k: int) -> str:
    """sigmoid(embedding . w(., k)) as one SQL expression (weights inline)."""
    ws = ", ".join(f"{((i * 7 + k * 5) % 13 - 6) / 10.0!r}D" for i in range(1, EMBED_DIM + 1))
    return (f"1.0D / (1.0D + exp(-aggregate(zip_with(embedding, array({ws}), (x, w) -> CAST(x AS DOUBLE) * w), "
            f"0.0D, (acc, v) -> acc + v)))")


def scores_wide(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, label, scores array<double>[14] from a fixed logistic model
    (plus ``keep`` columns of the same row)."""
    emb = table(spark, sf_dir, "embeddings")
    per_class = [F.expr(_class_score_sql(k)) for k in range(N_CLASSES)]
    return emb.select("vec_id", "label", *keep, F.array(*per_class).alias("scores"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores: vec_id, k, score."""
    w = scores_wide(spark, sf_dir)
    return w.select("vec_id", F.posexplode_outer("scores").alias("k", "score"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", f"explode(sequence(0, {N_CLASSES - 1})) AS k")
            .selectExpr("vec_id", "k", "CAST(label = k AS INT) AS truth"))


def scored_long(spark: SparkSession, sf_dir: str, tied: bool = False) -> DataFrame:
    """(image_key, label, score, truth) long table used by the evaluation ops.

    Built from one scan of ``embeddings``: scores and truth come from the
    same row, so no join is needed to align them.
    """
    names = ", ".join(f"'{n}'" for n in LABELS)
    x = scores_wide(spark, sf_dir).selectExpr("vec_id", "label", "posexplode_outer(scores) AS (k, s)")
    score = "round(s, 1)" if tied else "s"
    return x.selectExpr("vec_id AS image_key", f"element_at(array({names}), k + 1) AS label", f"{score} AS score",
                        "CAST(label = k AS INT) AS truth")


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation/gradient cells: image_key, cell (0..15), ch (0..3), act, grad."""
    x = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (pos, v)")
    return x.selectExpr("vec_id AS image_key", "CAST(pos DIV 4 AS INT) AS cell", "CAST(pos % 4 AS INT) AS ch",
                        "CAST(v AS DOUBLE) AS act", "CAST(v AS DOUBLE) * CAST(v AS DOUBLE) - 0.01D AS grad")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat_ws('-', CAST(conv_id AS STRING), CAST(turn AS STRING)) AS idx",
        "CAST(conv_id AS STRING) AS group_key", "role")
