"""Bulk patient job: validate -> features -> score -> top-3 -> result rows.

One pass without a split: every row goes through the same plan, and a mask
keeps rejected rows away from the model. Every input row yields exactly one
result row; a failure is a row with ``success = false`` and its message, never a
lost task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, META_COLS, MSG_NO_SCORES, MSG_SAVED, MSG_UNREADABLE, SOURCES, TOP_K_HEATMAPS
from ..functions import features as feat
from ..functions.text import folder_key
from . import ranking as rk
from . import scoring as sc
from .validate import validate

RESULT_COLS = ["idx", "patient_name", "age", "gender", "view", "folder_name", "success", "message", "top_prediction",
               "source"]


def serve_meta(df: DataFrame) -> DataFrame:
    ap, pa = feat.serve_view_onehot("view")
    return df.withColumns({"age_norm": feat.serve_age_norm("age"), "sex_bin": feat.serve_sex_bin("gender"),
                           "view_AP": ap, "view_PA": pa}).withColumn("meta", feat.feature_vector())


def bulk_patient_job(uploads: DataFrame, images: DataFrame, scorer, run_date: Column,
                     registry_root: str = "/registry", source: str = "spark_batch",
                     image_col: str = "image_vec", image_dim: int = 64,
                     gradient_fn=None, cam_shape: tuple[int, int] | None = None,
                     labels: list[str] | None = None) -> DataFrame:
    """``uploads``: idx, name, age, gender, view, content; ``images``: idx and
    the decoded image vector (activations, ``image_dim`` values). ``scorer``
    must be a masked batch scorer with inputs (image, metadata, mask). Returns one result row per upload
    plus the predictions map, the top-3 entries and -- when the caller gives
    ``gradient_fn(class_index) -> gradient array`` and ``cam_shape`` (cells,
    channels) -- a heatmap per top-3 label, computed row-locally."""
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    v = validate(uploads).join(images.select("idx", image_col), "idx", "left")
    no_img = F.col(image_col).isNull()
    v = v.withColumn("errors", F.when(F.col("valid") & no_img,
                                      F.array(F.lit(MSG_UNREADABLE.format("no decoded pixels"))))
                     .otherwise(F.col("errors")))
    v = v.withColumn("valid", F.size("errors") == 0)
    v = v.withColumn("folder_name", folder_key("name", run_date))
    # One pass, no union: every row goes through the same plan, but the
    # scorer's mask keeps rejected rows away from the model (they get
    # placeholder inputs of the right shape that are never evaluated).
    v = serve_meta(v)
    valid = F.col("valid")
    v = v.withColumns({
        "_img": F.when(valid, F.col(image_col).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), image_dim)),
        "_meta": F.when(valid, F.col("meta").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), 4)),
        "_mask": valid.cast("double"),
    })
    allrows = sc.score(v, scorer, ["_img", "_meta", "_mask"], capture_errors=True)
    pred = F.when(F.col("scores").isNotNull(), sc.predictions_map(F.col("scores")))
    out = allrows.withColumn("predictions", pred)
    ok = F.col("predictions").isNotNull()
    labels = labels or LABELS
    top3 = F.when(ok, rk.top_k(F.col("predictions"), TOP_K_HEATMAPS))
    heat = F.lit(None).cast("map<string,array<double>>")
    if gradient_fn is not None and cam_shape is not None:
        from .cam import heatmap_arrays
        names = F.array(*[F.lit(x) for x in labels])
        def one(e):
            k = F.array_position(names, e["key"]) - 1
            return heatmap_arrays(F.col(image_col), gradient_fn(k), cam_shape[0], cam_shape[1])
        heat = F.when(ok, F.map_from_entries(F.transform(top3, lambda e: F.struct(e["key"], one(e)))))
    saved_prefix = MSG_SAVED.format(registry_root.rstrip("/"), "")
    message = (F.when(ok, F.concat(F.lit(saved_prefix), F.col("folder_name")))
                .when(F.size("errors") > 0, F.array_join("errors", "; "))
                .otherwise(F.coalesce("error", F.lit(MSG_NO_SCORES))))
    return out.select(
        "idx", F.col("name").alias("patient_name"), "age", "gender", "view", "folder_name", ok.alias("success"), message.alias("message"),
        F.when(ok, rk.top_prediction(F.col("predictions"))).alias("top_prediction"),
        F.lit(source).alias("source"), "predictions", top3.alias("top3"), heat.alias("heatmaps"))


def bulk_image_job(uploads: DataFrame, make_predict_fn, run_date: Column, registry_root: str = "/registry",
                   source: str = "spark_batch", features: list[str] | None = None, labels: list[str] | None = None,
                   image_path: str = "image_path", content: str | None = None, **options) -> DataFrame:
    """Uploads with their images: validate -> decode -> model on image and
    metadata -> result rows. ``uploads``: idx, name, age, gender, view and either
    ``image_path``, the file of the row, or ``content``, its bytes. The image is
    decoded and scored in one task; a missing, undecodable or foreign file
    rejects its row, and rejected rows never reach the model. One result row per
    upload, with the predictions map."""
    from .file_scoring import score_content, score_paths
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    labels = labels or LABELS
    v = serve_meta(validate(uploads, content=None)).withColumn("folder_name", folder_key("name", run_date))
    options |= {"meta": features or META_COLS, "mask": "valid",
                "keep": ("idx", "name", "age", "gender", "view", "folder_name", "errors")}
    if content:
        s = score_content(v, make_predict_fn, len(labels), content=content, **options)
    else:
        s = score_paths(v, make_predict_fn, len(labels), path=image_path, **options)
    s = s.withColumn("errors", F.when(F.col("ok"), F.col("errors")).otherwise(F.concat("errors", F.array("error"))))
    s = s.withColumn("predictions", F.when(F.col("scores").isNotNull(), sc.predictions_map(F.col("scores"), labels)))
    ok = F.col("predictions").isNotNull()
    message = (F.when(ok, F.concat(F.lit(MSG_SAVED.format(registry_root.rstrip("/"), "")), F.col("folder_name")))
                .when(F.size("errors") > 0, F.array_join("errors", "; "))
                .otherwise(F.coalesce("error", F.lit(MSG_NO_SCORES))))
    return s.select("idx", F.col("name").alias("patient_name"), "age", "gender", "view", "folder_name",
                    ok.alias("success"), message.alias("message"),
                    F.when(ok, rk.top_prediction(F.col("predictions"))).alias("top_prediction"),
                    F.lit(source).alias("source"), "predictions")


def batch_score_images(inputs: DataFrame, make_predict_fn, n_out: int, features: list[str],
                       labels: list[str] | None = None, root: str | None = None, **options) -> DataFrame:
    """The bulk scoring job: (image_path, predictions map<string,float>, error),
    one row per input row.

    ``inputs``: image_path (under ``root`` unless absolute) and the metadata
    ``features``. Every row is scored on the file at its own path: equal names in
    other folders are other files, and a path that stands in several rows is
    scored with each row's features. An input without a file, an undecodable file
    and a failing row keep their row, with an error and no predictions."""
    from .file_scoring import score_paths
    s = score_paths(inputs, make_predict_fn, n_out, root=root, meta=features, keep=("image_path",), **options)
    return s.select("image_path", F.when(F.col("scores").isNotNull(), sc.predictions_map(F.col("scores"), labels))
                    .alias("predictions"), "error")


def single_patient(spark, image_vec: list[float], name: str, age, gender: str, view: str, content: bytes,
                   scorer, run_date: str, **kw) -> DataFrame:
    """One upload scored through the same pipeline (web form path)."""
    from pyspark.sql import types as T
    u = spark.createDataFrame([(0, name, age, gender, view, bytearray(content))],
                              "idx long, name string, age int, gender string, view string, content binary")
    im = spark.createDataFrame([(0, [float(x) for x in image_vec])],
                               T.StructType([T.StructField("idx", T.LongType()),
                                             T.StructField("image_vec", T.ArrayType(T.DoubleType()))]))
    return bulk_patient_job(u, im, scorer, F.lit(run_date).cast("date"), source="web_upload", **kw)


def single_image(spark, image: str | bytes, name: str, age, gender: str, view: str, make_predict_fn, run_date: str,
                 **options) -> DataFrame:
    """One uploaded image, its bytes or the path of its file, through the same
    job (web form path)."""
    from pyspark.sql import types as T
    held = not isinstance(image, str)
    fields = [("idx", T.LongType()), ("name", T.StringType()), ("age", T.IntegerType()), ("gender", T.StringType()),
              ("view", T.StringType()), ("image", T.BinaryType() if held else T.StringType())]
    row = spark.createDataFrame([(0, name, age, gender, view, bytearray(image) if held else image)],
                                T.StructType([T.StructField(n, t) for n, t in fields]))
    return bulk_image_job(row, make_predict_fn, F.lit(run_date).cast("date"), source="web_upload",
                          **({"content": "image"} if held else {"image_path": "image"}), **options)


def batch_tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("ok"), F.count(F.lit(1)).alias("total"))


__all__ = ["bulk_patient_job", "bulk_image_job", "batch_score_images", "batch_tally", "serve_meta", "RESULT_COLS", "LABELS"]
