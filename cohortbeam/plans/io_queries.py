"""Sources, sinks, bulk job, image table and streaming intake queries.

File-based queries first materialize their input from the driver tables
into the shared scratch folder (``spark.checkpoint.dir``), then read it
back through the source under test, so their work grows with the tables.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..constants import LABELS, META_COLS
from ..functions import features as feat
from ..operators import bulk
from ..operators import cam
from ..operators import evaluate as ev
from ..operators import file_scoring as fsc
from ..operators import images as im
from ..operators import registry as rg
from ..operators import scoring as sc
from ..operators import split as sp
from ..operators.cohort import add_age_features
from ..session import scratch_path
from ..sinks import writers as wr
from ..sources import readers as rd
from .catalog import query
from .cohort_queries import AGE_SQL, SPLIT_SQL, U_SQL, cohort, cohort_sql
from .eval_queries import eval_sql
from .oracle_views import linear_sql, sql
from .registry_queries import LOG, META, PRED, STATE, metadata_docs, prediction_docs, state
from .scoring_queries import META_SQL, UPLOAD_FORM, VALIDATE_CTE, _meta_cols, _upload_form


def _scratch(spark, d, *parts):
    """A new folder for every call: nothing of an earlier run is read or replaced."""
    return scratch_path(spark, *parts, uuid.uuid4().hex)


def write_images(spark, d, **layout) -> str:
    """PNG files from ``embeddings`` in a new scratch folder."""
    root = _scratch(spark, d, "images")
    im.write_image_files(fx.table(spark, d, "embeddings"), root, **layout).write.format("noop").mode("overwrite").save()
    return root


#: The same file names in all twelve folders: only the whole path tells images apart.
SAME_NAMES = {"layout": "images_{group:03d}/images/{name:08d}.png"}


def image_path(vec_id: str, prefix: str = "''", dialect: str = "spark") -> str:
    """Where ``write_images(**SAME_NAMES)`` puts an image, as SQL for Spark or DuckDB."""
    text, div = ("STRING", "div") if dialect == "spark" else ("VARCHAR", "//")
    return (f"concat('images_', lpad(CAST({vec_id} % 12 + 1 AS {text}), 3, '0'), '/images/', {prefix}, "
            f"lpad(CAST({vec_id} {div} 12 AS {text}), 8, '0'), '.png')")


# ------------------------------------------------------------------ sources
@query("src_csv", sql(["studies"], "SELECT idx, patient_id, age_raw, gender, view_position FROM studies"))
def q_src_csv(spark, d):
    """Catalog written as CSV with a header, read back with an explicit schema."""
    path = _scratch(spark, d, "csv_catalog")
    wr.write_csv(fx.studies(spark, d).drop("ts"), path)
    return rd.read_csv(spark, path, rd.CATALOG_SCHEMA)


@query("src_path_index", sql([], """
SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS basename,
       'images_' || lpad(CAST(vec_id % 12 + 1 AS VARCHAR), 3, '0') || '/images/' || lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS rel_path
FROM embeddings"""))
def q_src_path_index(spark, d):
    """Image file index (basename, path): a listing, file contents unread."""
    idx = rd.path_index(spark, write_images(spark, d))
    return idx.select("basename", F.regexp_extract("path", r"(images_[0-9]+/images/[^/]+)$", 1).alias("rel_path"))


@query("src_image_bytes", sql([], """
SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS basename, vec_id % 50 <> 0 AS is_png, true AS has_bytes
FROM embeddings"""))
def q_src_image_bytes(spark, d):
    """Image file contents: signature check on the bytes read by binaryFile."""
    b = rd.image_bytes(spark, write_images(spark, d))
    png = F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    return b.select("basename", png.alias("is_png"), (F.col("length") > 0).alias("has_bytes"))


SCORING_INPUT_SQL = sql(["uploads"], """
SELECT 'img_' || CAST(idx AS VARCHAR) || '.png' AS image_path,
  least(greatest(CAST(age AS DOUBLE), 0.0), 100.0) / 100.0 AS age_norm,
  CASE WHEN upper(gender) = 'M' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex_bin,
  CASE WHEN upper(view) = 'AP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS view_AP,
  CASE WHEN upper(view) = 'PA' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS view_PA FROM uploads""")


@query("src_cascade", SCORING_INPUT_SQL)
def q_src_cascade(spark, d):
    """Input folder holding only data.csv: the Parquet branch is skipped
    because the path does not exist, the CSV branch is read with its schema."""
    base = _scratch(spark, d, "cascade_input")
    u = bulk.serve_meta(fx.uploads(spark, d)).select(
        F.concat(F.lit("img_"), F.col("idx").cast("string"), F.lit(".png")).alias("image_path"),
        "age_norm", "sex_bin", "view_AP", "view_PA")
    wr.write_csv(u, f"{base}/data.csv")
    return rd.scoring_input(spark, base)


@query("src_cascade_listing", sql([], """
SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS basename, 0.5::DOUBLE AS age_norm, 0.0::DOUBLE AS sex_bin,
       0.0::DOUBLE AS view_AP, 1.0::DOUBLE AS view_PA FROM embeddings"""))
def q_src_cascade_listing(spark, d):
    """Input folder holding nothing but images: their listing with default features."""
    t = rd.scoring_input(spark, write_images(spark, d))
    return t.select(F.regexp_extract("image_path", r"([^/]+)$", 1).alias("basename"), *META_COLS)


def _model_schema_frame(spark, d):
    s = fx.studies(spark, d).select(feat.parse_view("view_position").alias("view_cat"))
    from ..operators.cohort import discover_categories
    meta = ["age_norm", "sex_bin"] + [f"view_{c}" for c in discover_categories(s, "view_cat")]
    return spark.createDataFrame([(LABELS, meta)], rd.MODEL_SCHEMA)


def _write_model_schema(spark, d) -> str:
    path = _scratch(spark, d, "model_schema")
    wr.write_text_json(_model_schema_frame(spark, d), path, ["labels", "meta_cols"])
    return path


@query("src_model_schema", sql(["studies", "label_names"], """
SELECT 'label' AS kind, CAST(k AS INTEGER) AS pos, name FROM label_names
UNION ALL SELECT 'meta', 0, 'age_norm' UNION ALL SELECT 'meta', 1, 'sex_bin'
UNION ALL SELECT 'meta', CAST(1 + row_number() OVER (ORDER BY c) AS INTEGER), 'view_' || c FROM (SELECT DISTINCT
  CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS c FROM studies)"""))
def q_src_model_schema(spark, d):
    """Model schema document (labels + feature columns found in the data)
    written as JSON, read back with its schema."""
    ms = rd.model_schema(spark, _write_model_schema(spark, d))
    lab = ms.select(F.lit("label").alias("kind"), F.posexplode("labels").alias("pos", "name"))
    met = ms.select(F.lit("meta").alias("kind"), F.posexplode("meta_cols").alias("pos", "name"))
    return lab.unionByName(met).select("kind", F.col("pos").cast("int").alias("pos"), "name")


@query("sink_model_schema", sql(["studies", "label_names"], """
SELECT to_json({'labels': (SELECT list(name ORDER BY k) FROM label_names),
                'meta_cols': ['age_norm', 'sex_bin'] || (SELECT list('view_' || c ORDER BY c) FROM (SELECT DISTINCT
  CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
       WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS c FROM studies))})::VARCHAR AS value"""))
def q_sink_model_schema(spark, d):
    """The model schema document as written (JSON text)."""
    return spark.read.text(_write_model_schema(spark, d))


@query("src_registry_json", sql(["folders", "files"], """
SELECT s.folder_name, m.patient_name, CAST(m.age AS BIGINT) AS age, m.gender, m.view
FROM state s JOIN meta m ON m.idx = s.idx""", [LOG, STATE, META]))
def q_src_registry_json(spark, d):
    """metadata.json documents, one per registry folder, read back with the
    folder taken from the file path."""
    r = rd.registry_docs(spark, _write_metadata_docs(spark, d), "*.txt", rd.METADATA_SCHEMA)
    return r.select("folder_name", "doc.patient_name", "doc.age", "doc.gender", "doc.view")


@query("src_registry_predictions", sql(["folders", "files", "scores", "label_names"], """
SELECT s.folder_name, p.label, round(p.p, 6) AS score FROM state s JOIN pred p ON p.idx = s.idx""", [LOG, STATE, PRED]))
def q_src_registry_predictions(spark, d):
    """predictions.json documents (label -> score), one per registry folder,
    read back as maps with the folder taken from the file path."""
    root = _scratch(spark, d, "registry_predictions")
    docs = prediction_docs(spark, d).join(state(spark, d).select("idx", "folder_name"), "idx")
    wr.write_doc_folders(docs.select("folder_name", F.to_json("predictions").alias("value")), root)
    r = rd.registry_docs(spark, root, "*.txt", rd.PREDICTIONS_SCHEMA)
    x = r.select("folder_name", F.explode("doc").alias("label", "score"))
    return x.withColumn("score", F.round(F.col("score").cast("double"), 6))


def _write_metadata_docs(spark, d) -> str:
    """Test input in the layout of the source: one folder and file per key."""
    root = _scratch(spark, d, "registry_docs")
    docs = metadata_docs(spark, d).join(state(spark, d).select("idx", "folder_name"), "idx")
    value = F.to_json(F.struct("patient_name", "age", "gender", "view", "timestamp"))
    wr.write_doc_folders(docs.select("folder_name", value.alias("value")), root)
    return root


@query("registry_files", sql(["folders", "files"], """
SELECT s.folder_name, CAST(count(*) AS BIGINT) AS n_files, true AS has_bytes
FROM state s JOIN meta m ON m.idx = s.idx GROUP BY s.folder_name""", [LOG, STATE, META]))
def q_registry_files(spark, d):
    """Listing of the registry tree: files per folder (contents not read)."""
    from ..operators.registry import listing_from_paths
    files = rd.image_files(spark, _write_metadata_docs(spark, d), "*.txt").select("path", "length")
    return listing_from_paths(files, keep=("length",)).groupBy("folder_name").agg(
        F.count(F.lit(1)).alias("n_files"), (F.min("length") > 0).alias("has_bytes"))


@query("sink_registry_docs", sql(["folders", "files"], """
SELECT s.folder_name, m.patient_name, CAST(m.age AS BIGINT) AS age, m.gender, m.view, m.timestamp, strftime(f.run_date, '%Y-%m-%d') AS run_date
FROM state s JOIN meta m ON m.idx = s.idx JOIN folders f ON f.idx = s.idx""", [LOG, STATE, META]))
def q_sink_registry_docs(spark, d):
    """Registry metadata documents written by date, read back with the key
    from the document and the date from the partition."""
    path = _scratch(spark, d, "registry_by_date")
    st = state(spark, d).select("idx", "folder_name")
    docs = metadata_docs(spark, d).join(st, "idx").join(
        fx.folders(spark, d).select("idx", F.col("run_date").cast("string").alias("run_date")), "idx")
    wr.write_json_docs(docs, path, ["folder_name", "patient_name", "age", "gender", "view", "timestamp"])
    back = spark.read.text(path).select(F.from_json("value", rd.METADATA_SCHEMA).alias("doc"),
                                        F.col("run_date").cast("string").alias("run_date"))
    return back.select("doc.folder_name", "doc.patient_name", "doc.age", "doc.gender", "doc.view", "doc.timestamp", "run_date")


# ------------------------------------------------------------- bulk job
BULK_CTES = [VALIDATE_CTE,
             ("j", """SELECT u.idx, u.name, u.age, u.gender, u.view, e.embedding,
    CASE WHEN len(v.errs) = 0 AND e.embedding IS NULL THEN ['Could not read image: no decoded pixels'] ELSE v.errs END AS errs,
    coalesce(nullif(upper(left(regexp_replace(u.name, '[^a-zA-Z]', '', 'g'), 1))
       || lower(substr(regexp_replace(u.name, '[^a-zA-Z]', '', 'g'), 2)), ''), 'Unknown') || '20260209' AS folder_name
  FROM uploads u JOIN v ON v.idx = u.idx LEFT JOIN embeddings e ON e.vec_id = u.idx"""),
             ("sc", f"""SELECT j.idx, n.k, n.name AS label, CAST({linear_sql('n.k', emb='j.embedding', meta=[
                 "least(greatest(CAST(j.age AS DOUBLE), 0.0), 100.0) / 100.0",
                 "CASE WHEN upper(j.gender) = 'M' THEN 1.0 ELSE 0.0 END",
                 "CASE WHEN upper(j.view) = 'AP' THEN 1.0 ELSE 0.0 END",
                 "CASE WHEN upper(j.view) = 'PA' THEN 1.0 ELSE 0.0 END"])} AS FLOAT) AS p
  FROM j, label_names n WHERE len(j.errs) = 0"""),
             ("top", "SELECT idx, arg_max(label, (p, -k)) AS top FROM sc GROUP BY idx"),
             ("res", """SELECT j.idx, j.name AS patient_name, j.age, j.gender, j.view, j.folder_name, len(j.errs) = 0 AS success,
    CASE WHEN len(j.errs) = 0 THEN 'Saved to /registry/' || j.folder_name ELSE array_to_string(j.errs, '; ') END AS message,
    t.top AS top_prediction, 'spark_batch' AS source FROM j LEFT JOIN top t ON t.idx = j.idx""")]
BULK_SQL = sql(["uploads", "label_names"], "SELECT * FROM res", BULK_CTES)


def run_bulk(spark, d):
    u = fx.uploads(spark, d)
    imgs = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("image_vec"))
    scorer = sc.batch_scorer(sc.linear_model_factory(68, n_inputs=2), [[64], [4]], masked=True)
    # gradient of the linear class score w.r.t. the image inputs: its weights
    grads = lambda k: cam.class_gradients(64, k, fx.weight)
    return bulk.bulk_patient_job(u, imgs, scorer, F.lit("2026-02-09").cast("date"),
                                 gradient_fn=grads, cam_shape=(16, 4))


@query("bulk_patient_job", BULK_SQL, bench=True)
def q_bulk_patient_job(spark, d):
    """Uploads -> validation -> serving features -> fused model -> top label."""
    return run_bulk(spark, d).select(*bulk.RESULT_COLS)


@query("batch_results", sql(["uploads", "label_names"], "SELECT idx, success, top_prediction FROM res ORDER BY idx", BULK_CTES))
def q_batch_results(spark, d):
    return run_bulk(spark, d).select("idx", "success", "top_prediction").orderBy("idx")


@query("batch_tally", sql(["uploads", "label_names"], "SELECT count(*) FILTER (WHERE success) AS ok, count(*) AS total FROM res",
                          BULK_CTES))
def q_batch_tally(spark, d):
    return bulk.batch_tally(run_bulk(spark, d))


@query("bulk_heatmaps", sql(["uploads", "label_names"], f"""
SELECT t.idx, t.label, CAST(c.cell AS INTEGER) AS cell,
       round(c.cam / (max(c.cam) OVER (PARTITION BY t.idx, t.label) + 1e-8), 6) AS heat
FROM t3 t JOIN (SELECT x.idx, x.k, x.cell, greatest(sum(x.act * w.w), 0.0) AS cam
                FROM cells x JOIN (SELECT idx, k, ch, avg(grad) AS w FROM cells GROUP BY 1, 2, 3) w
                  ON w.idx = x.idx AND w.k = x.k AND w.ch = x.ch GROUP BY 1, 2, 3) c ON c.idx = t.idx AND c.k = t.k""",
    BULK_CTES + [
        ("t3", "SELECT idx, k, label FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p DESC, k) AS r FROM sc) WHERE r <= 3"),
        ("el", "SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings"),
        ("cells", """SELECT t.idx, t.k, (el.i - 1) // 4 AS cell, (el.i - 1) % 4 AS ch, CAST(el.v AS DOUBLE) AS act,
                     (CAST(((el.i) * 7 + (t.k) * 5) % 13 - 6 AS DOUBLE) / 10.0) AS grad
                     FROM t3 t JOIN el ON el.vec_id = t.idx"""),
    ]))
def q_bulk_heatmaps(spark, d):
    """Heatmaps the bulk job stores for the top-3 labels of each scored upload."""
    r = run_bulk(spark, d).where("success")
    x = r.select("idx", F.explode("heatmaps").alias("label", "heat"))
    x = x.select("idx", "label", F.posexplode("heat").alias("cell", "heat"))
    return x.select("idx", "label", F.col("cell").cast("int").alias("cell"), F.round("heat", 6).alias("heat"))


FORM_FILE_SQL = """lpad(CAST(idx AS VARCHAR), 8, '0') || CASE WHEN idx % 9 = 0 THEN ''
  ELSE (['.png', '.JPG', '.jpeg', '.gif', '.tar.PNG'])[idx % 5 + 1] END"""


@query("form_errors", sql(["uploads"], """
SELECT f.idx, CASE WHEN NOT (contains(f.fname, '.') AND lower(split_part(f.fname, '.', -1)) IN ('png', 'jpg', 'jpeg'))
    THEN 'Invalid file type. Please upload PNG or JPEG.'
  WHEN coalesce(trim(f.name), '') = '' THEN 'Patient name is required'
  WHEN f.age IS NOT NULL AND NOT regexp_matches(f.age, '^\\s*[+-]?[0-9]+\\s*$') THEN 'Invalid age value' END AS error
FROM named f""",
    [UPLOAD_FORM, ("named", f"""SELECT u.idx, {FORM_FILE_SQL.replace('idx', 'u.idx')} AS fname, fm.age,
  CASE WHEN u.idx % 23 = 0 THEN '  ' ELSE u.name END AS name FROM uploads u JOIN form fm ON fm.idx = u.idx""")]))
def q_form_errors(spark, d):
    """Upload-form checks on file name, patient name and age text, all three
    fields of every upload."""
    from ..operators.validate import form_error
    ext = F.element_at(F.array(*[F.lit(x) for x in [".png", ".JPG", ".jpeg", ".gif", ".tar.PNG"]]),
                       (F.col("idx") % 5 + 1).cast("int"))
    fname = F.concat(F.lpad(F.col("idx").cast("string"), 8, "0"), F.when(F.col("idx") % 9 == 0, F.lit("")).otherwise(ext))
    name = F.when(F.col("idx") % 23 == 0, F.lit("  ")).otherwise(F.col("name"))
    form = _upload_form(spark, d, keep=("name",)).select("idx", fname.alias("fname"), name.alias("name"), "age")
    return form.select("idx", form_error(F.col("fname"), F.col("name"), F.col("age")).alias("error"))


@query("sink_results", BULK_SQL)
def q_sink_results(spark, d):
    """Bulk results appended to the results log (partitioned by run date and
    run id, dynamic overwrite), read back."""
    path = _scratch(spark, d, "results_log")
    res = run_bulk(spark, d).withColumns({"run_date": F.lit("2026-02-09"), "intake_id": F.lit("bulk"), "run_id": F.lit(1)})
    wr.write_results(res, path)
    back = spark.read.parquet(path).where("run_date = '2026-02-09' AND intake_id = 'bulk' AND run_id = 1")
    return back.select(*bulk.RESULT_COLS)


# ------------------------------------------------------------ other sinks
@query("patient_info_json", sql(["label_names"], f"""
SELECT e.vec_id AS patient_id, round(e.m0, 6) AS age_norm, e.m1 AS sex_bin, e.m2 AS view_AP, e.m3 AS view_PA, n.name AS label,
       round(CAST(CAST({linear_sql('n.k', meta=['e.m0', 'e.m1', 'e.m2', 'e.m3'])} AS FLOAT) AS DOUBLE), 6) AS prob
FROM (SELECT *, {', '.join(f'{m} AS m{j}' for j, m in enumerate(META_SQL))} FROM embeddings) e, label_names n"""))
def q_patient_info_json(spark, d):
    """Per-patient info documents {patient_id, metadata, probabilities} as
    JSON lines, read back and flattened."""
    e = fx.table(spark, d, "embeddings").withColumns(_meta_cols()).withColumn("meta", feat.feature_vector())
    scorer = sc.batch_scorer(sc.linear_model_factory(68, n_inputs=2), [[64], [4]])
    s = sc.score(e, scorer, ["embedding", "meta"]).select(
        F.col("vec_id").alias("patient_id"),
        F.struct("age_norm", "sex_bin", "view_AP", "view_PA").alias("metadata"),
        sc.predictions_map(F.col("scores")).alias("probabilities"))
    path = _scratch(spark, d, "patient_info")
    wr.write_text_json(s, path, ["patient_id", "metadata", "probabilities"])
    schema = ("patient_id long, metadata struct<age_norm double, sex_bin double, view_AP double, view_PA double>, "
              "probabilities map<string,float>")
    back = spark.read.text(path).select(F.from_json("value", schema).alias("doc"))
    x = back.select("doc.patient_id", "doc.metadata.*", F.explode("doc.probabilities").alias("label", "prob"))
    return x.select("patient_id", F.round("age_norm", 6).alias("age_norm"), "sex_bin", "view_AP", "view_PA", "label",
                    F.round(F.col("prob").cast("double"), 6).alias("prob"))


@query("train_export", cohort_sql(f"""
SELECT idx, split, 4 AS n_features, round(age_norm + sex_bin + view_AP + view_PA, 5) AS feature_sum,
       CAST({' + '.join(LABELS)} AS DOUBLE) AS label_sum
FROM (SELECT idx, {LABELS[0]}, {', '.join(LABELS[1:])},
        CAST(CAST(coalesce(CAST(age_i AS DOUBLE), (SELECT median(age_i) FROM parsed)) / 100.0 AS FLOAT) AS DOUBLE) AS age_norm,
        CASE WHEN gender = 'M' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex_bin,
        CASE WHEN c = 'AP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS view_AP, CASE WHEN c = 'PA' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS view_PA,
        {SPLIT_SQL.replace('u', 'u')} AS split
      FROM (SELECT *, {U_SQL.replace('group_key', 'coalesce(CAST(patient_id AS VARCHAR), CAST(idx AS VARCHAR))')} AS u,
              CASE WHEN view_position IS NULL THEN 'UNK' WHEN contains(view_position, 'AP') THEN 'AP'
                   WHEN contains(view_position, 'PA') THEN 'PA' ELSE 'UNK' END AS c FROM parsed))""",
    [("parsed", f"SELECT *, {AGE_SQL} AS age_i FROM cohort")]))
def q_train_export(spark, d):
    """Cohort features and labels exported per split (seeded order for
    train, key order for val/test), read back."""
    f = add_age_features(cohort(spark, d))  # the median reads the age column alone
    f = f.withColumns({"view_AP": (F.col("view_cat") == "AP").cast("double"),
                       "view_PA": (F.col("view_cat") == "PA").cast("double"),
                       "sex_bin": F.col("sex_bin").cast("double")})
    f = sp.group_split(f, "group_key", seed=42)
    path = _scratch(spark, d, "train_export")
    wr.export_training_set(f, path, ["age_norm", "sex_bin", "view_AP", "view_PA"], LABELS)
    back = spark.read.parquet(path)
    fsum = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    lsum = F.aggregate("labels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("idx", "split", F.size("features").alias("n_features"), F.round(fsum, 5).alias("feature_sum"),
                       lsum.alias("label_sum"))


@query("seeded_shuffle", cohort_sql("""
SELECT idx, split, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' THEN md5('42:' || CAST(idx AS VARCHAR)) END, idx) - 1 AS place
FROM (SELECT idx, CASE idx % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM cohort)"""))
def q_seeded_shuffle(spark, d):
    """Where each row lies in the exported files: the train split in its seeded
    order, the others by key, over all files of a split."""
    from ..operators.cohort import row_numbers
    path = _scratch(spark, d, "seeded_shuffle")
    rows = cohort(spark, d).select("idx", "file_path", F.expr(
        "CASE idx % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split"), F.col("idx").alias("f"))
    wr.export_training_set(rows, path, ["f"], ["f"], seed=42)
    back = spark.read.parquet(path).select("idx", "split", F.col("_metadata.file_name").alias("file"),
                                           F.col("_metadata.row_index").alias("row"))
    placed = row_numbers(back, ["split", "file", "row"])
    first = placed.groupBy("split").agg(F.min("row_no").alias("first"))
    return placed.join(F.broadcast(first), "split").select("idx", "split", (F.col("row_no") - F.col("first")).alias("place"))


@query("eval_summary", eval_sql("""SELECT round(avg(auc), 4) AS mean_auc, round(avg(ap), 4) AS mean_ap,
  CAST(count(*) AS BIGINT) AS n_labels FROM lm"""))
def q_eval_summary(spark, d):
    """Per-label report written as CSV (header), read back; the summary
    keeps mean AUC and mean AP to 4 decimals."""
    rep = ev.eval_report(fx.scored_long(spark, d))
    path = _scratch(spark, d, "eval_summary")
    wr.write_csv(rep, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rep.schema.fields])
    back = rd.read_csv(spark, path, schema)
    return back.agg(F.round(F.avg("AUC_ROC"), 4).alias("mean_auc"), F.round(F.avg("AvgPrecision"), 4).alias("mean_ap"),
                    F.count(F.lit(1)).alias("n_labels"))


# ---------------------------------------------------------------- images
# Oracle: the 8x8 test images restated from the embeddings. A bilinear resize by
# a whole factor weighs all pixels alike, so channel means equal those of the file.
PIXEL_CTES = [
    ("px", """SELECT vec_id, least(greatest(round_even((CAST(v AS DOUBLE) + 0.25) * 510.0, 0), 0.0), 255.0) AS p
              FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings)"""),
    ("chan", """SELECT vec_id, avg(p) / 127.5 - 1.0 AS c0,
              CASE WHEN vec_id % 3 = 0 THEN avg(p) ELSE avg(255.0 - p) END / 127.5 - 1.0 AS c1,
              CASE WHEN vec_id % 3 = 0 THEN avg(p) ELSE avg((p * 7.0) % 256.0) END / 127.5 - 1.0 AS c2
              FROM px WHERE vec_id % 50 <> 0 GROUP BY vec_id"""),
    ("img", """SELECT e.vec_id, lpad(CAST(e.vec_id AS VARCHAR), 8, '0') || '.png' AS basename, c.c0, c.c1, c.c2,
              c.vec_id IS NOT NULL AS ok FROM embeddings e LEFT JOIN chan c ON c.vec_id = e.vec_id""")]


def _image_score_sql(scale: float, meta: list[str] | None = None) -> str:
    z = " + ".join(f"{x} * ({scale} * CAST(({i} * 7 + n.k * 5) % 13 - 6 AS DOUBLE) / 10.0)"
                   for i, x in enumerate(["i.c0", "i.c1", "i.c2", *(meta or [])], 1))
    return f"(1.0 / (1.0 + exp(-({z}))))"


@query("image_table", sql([], """
SELECT basename, ok, 3 AS channels, CASE WHEN ok THEN 196608 END AS n_values,
       CASE WHEN ok THEN CAST(round((c0 + c1 + c2 + 3.0) * 127.5 * 64.0) AS BIGINT) END AS pixel_sum FROM img""", PIXEL_CTES))
def q_image_table(spark, d):
    """Decode -> RGB / gray to 3 channels -> bilinear 256x256 -> x/127.5-1.
    pixel_sum is the sum over the 8x8 source pixels that the mean stands for."""
    imgs = rd.image_table(spark, write_images(spark, d))
    t = im.prepare_images(imgs, (256, 256), "tanh", mean=True)
    return t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("basename"), "ok", "channels",
                    F.when(F.col("ok"), F.size("pixels")).alias("n_values"),
                    F.round((F.col("mean") + 1.0) * 127.5 * 192.0).cast("long").alias("pixel_sum"))


@query("score_images", sql(["label_names"], f"""
SELECT i.basename, any_value(i.ok) AS ok, CASE WHEN any_value(i.ok) THEN arg_max(n.name, (p, -n.k)) END AS top_prediction,
       CASE WHEN any_value(i.ok) THEN 14 END AS n_scores
FROM (SELECT i.basename, i.ok, n.k, n.name, CAST({_image_score_sql(4.0)} AS FLOAT) AS p FROM img i, label_names n) i
JOIN label_names n ON n.k = i.k GROUP BY i.basename""", PIXEL_CTES))
def q_score_images(spark, d):
    """Image files -> decode, RGB, 256x256 bilinear, x/127.5-1 -> model in
    Arrow batches -> top label (undecodable files kept, never scored)."""
    from ..operators import ranking as rk
    imgs = rd.image_table(spark, write_images(spark, d))
    # decode + resize + model in one Python step: tensors never return to the JVM
    s = im.score_images_fused(imgs, sc.channel_mean_factory(), n_out=len(LABELS))
    pred = F.when(F.col("scores").isNotNull(), sc.predictions_map(F.col("scores")))
    return s.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("basename"), "ok",
                    F.when(pred.isNotNull(), rk.top_prediction(pred)).alias("top_prediction"),
                    F.when(pred.isNotNull(), F.size("scores")).alias("n_scores"))


# Oracle of the windowed-sinc resize of the 8x8 test images: whole-number weights
# of 22 bits, columns first, every sum rounded and clipped to 8 bits.
PLANE_CTES = [
    ("px", """SELECT vec_id, i, CAST(least(greatest(round_even((CAST(v AS DOUBLE) + 0.25) * 510.0, 0), 0.0), 255.0) AS BIGINT) AS p
              FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
              WHERE vec_id % 50 <> 0"""),
    ("planes", """SELECT vec_id, c, i // 8 AS y, i % 8 AS x, CASE WHEN c = 0 THEN p WHEN c = 1 THEN 255 - p ELSE p * 7 % 256 END AS p
              FROM px, range(3) t(c) WHERE c = 0 OR vec_id % 3 <> 0"""),
    ("lines", f"""SELECT vec_id, c, y, {", ".join(f"max(p) FILTER (x = {i}) AS p{i}" for i in range(8))} FROM planes GROUP BY vec_id, c, y""")]


def _resized_ctes(n: int, name: str) -> list[tuple[str, str]]:
    """(vec_id, total0, total1, total2): sums over the n x n pixels of each channel."""
    scale, wide = 8 / n, max(8 / n, 1.0)

    def dot(values: str) -> str:
        return f"least(greatest(2097152 + {' + '.join(f'w{i} * {values}{i}' for i in range(8))}, 0) >> 22, 255)"

    return [
        (f"{name}_axis", f"""SELECT o, {", ".join(f"max(w) FILTER (x = {i}) AS w{i}" for i in range(8))} FROM (
            SELECT o, x, CAST(trunc(k * 4194304 + CASE WHEN k < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS w FROM (
              SELECT o, x, k / sum(k) OVER (PARTITION BY o) AS k FROM (
                SELECT o, x, CASE WHEN x < trunc(c - 3 * {wide} + 0.5) OR x >= trunc(c + 3 * {wide} + 0.5) OR abs(t) >= 3 THEN 0.0
                  WHEN t = 0 THEN 1.0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END AS k
                FROM (SELECT o, x, (o + 0.5) * {scale} AS c, (x - (o + 0.5) * {scale} + 0.5) / {wide} AS t
                      FROM range({n}) a(o), range(8) b(x))))) GROUP BY o"""),
        (f"{name}_wide", f"SELECT vec_id, c, y, o, {dot('p')} AS h FROM lines, {name}_axis"),
        (f"{name}_columns", f"""SELECT vec_id, c, o, {", ".join(f"max(h) FILTER (y = {i}) AS h{i}" for i in range(8))}
            FROM {name}_wide GROUP BY vec_id, c, o"""),
        (f"{name}_totals", f"""SELECT vec_id, c, sum({dot('h')}) AS total
            FROM {name}_columns k, (SELECT * EXCLUDE o FROM {name}_axis) GROUP BY vec_id, c"""),
        (name, f"""SELECT vec_id, max(total) FILTER (c = 0) AS total0, coalesce(max(total) FILTER (c = 1), total0) AS total1,
            coalesce(max(total) FILTER (c = 2), total0) AS total2 FROM {name}_totals GROUP BY vec_id""")]


FULL_CTES = [*PLANE_CTES, *_resized_ctes(256, "whole"),
    ("img", f"""SELECT e.vec_id, {image_path('e.vec_id', dialect='duckdb')} AS image_path, f.vec_id IS NOT NULL AS ok,
      {", ".join(f"f.total{c} / 65536.0 / 127.5 - 1.0 AS c{c}" for c in range(3))}
      FROM embeddings e LEFT JOIN whole f USING (vec_id)""")]



@query("image_resample", sql([], """
SELECT e.vec_id, u.vec_id IS NOT NULL AS ok, CAST(u.total0 AS BIGINT) AS up0, CAST(u.total1 AS BIGINT) AS up1, CAST(u.total2 AS BIGINT) AS up2,
  CAST(s.total0 AS BIGINT) AS down0, CAST(s.total1 AS BIGINT) AS down1, CAST(s.total2 AS BIGINT) AS down2,
  CASE WHEN u.vec_id IS NULL THEN 'Could not read image: cannot identify image file' END AS error
FROM embeddings e LEFT JOIN up u USING (vec_id) LEFT JOIN small s USING (vec_id)""",
    [*PLANE_CTES, *_resized_ctes(20, "up"), *_resized_ctes(3, "small")]))
def q_image_resample(spark, d):
    """Image bytes -> decode -> antialiased resize, larger and smaller; sums per
    channel of the whole-number pixels."""
    rows = rd.image_bytes(spark, write_images(spark, d)).select(
        F.regexp_extract("basename", r"(\d+)", 1).cast("long").alias("vec_id"), "content")

    def sums(size, name):
        t = fsc.prepare_content(rows, size=(size, size), mode="none", keep=("vec_id",))
        return t.select("vec_id", "ok", "error", *[F.expr(
            f"CAST(aggregate(filter(pixels, (x, i) -> i % 3 = {c}), 0D, (a, x) -> a + x) AS BIGINT)").alias(f"{name}{c}") for c in range(3)])

    return sums(20, "up").join(sums(3, "down").drop("ok", "error"), "vec_id").select(
        "vec_id", "ok", "up0", "up1", "up2", "down0", "down1", "down2", "error")


BATCH_META = ["i.age_norm", "i.sex_bin", "i.view_AP", "i.view_PA"]


@query("batch_score_images", sql(["label_names"], f"""
SELECT i.image_path, CASE WHEN i.ok THEN n.name END AS label,
       CASE WHEN i.ok THEN round(CAST(CAST({_image_score_sql(1.0, BATCH_META)} AS FLOAT) AS DOUBLE), 4) END AS score,
       CASE WHEN i.missing THEN 'Could not read image: no such file' WHEN NOT i.ok THEN 'Could not read image: cannot identify image file' END AS error
FROM inputs i JOIN label_names n ON i.ok OR n.k = 0""", FULL_CTES + [
    ("inputs", f"""SELECT CASE WHEN vec_id % 41 = 0 THEN {image_path('vec_id', "'gone_'", 'duckdb')} ELSE image_path END AS image_path,
       ok AND vec_id % 41 <> 0 AS ok, vec_id % 41 = 0 AS missing, c0, c1, c2, CAST((vec_id + 50 * again) % 101 AS DOUBLE) / 100.0 AS age_norm,
       CAST(vec_id % 2 AS DOUBLE) AS sex_bin, CAST(vec_id % 4 = 1 AS INTEGER)::DOUBLE AS view_AP,
       CAST(vec_id % 4 = 2 AS INTEGER)::DOUBLE AS view_PA FROM img, range(2) t(again) WHERE again = 0 OR vec_id % 37 = 0""")]))
def q_batch_score_images(spark, d):
    """The bulk job end to end: scoring input (Parquet branch of the cascade)
    -> each row's own image file -> 256x256 tensors -> model on image and four
    metadata features -> map<string,float> -> scored table, read back. The
    folders hold equal file names, some paths stand in two rows with other
    features; missing and undecodable files keep a row with their error."""
    base = _scratch(spark, d, "scoring_input")
    e = fx.table(spark, d, "embeddings").selectExpr("vec_id", "explode(IF(vec_id % 37 = 0, array(0, 1), array(0))) AS again")
    e.selectExpr(f"CASE WHEN vec_id % 41 = 0 THEN {image_path('vec_id', QUOTED_GONE)} ELSE {image_path('vec_id')} END AS image_path",
                 "((vec_id + 50 * again) % 101) / 100.0D AS age_norm", "CAST(vec_id % 2 AS DOUBLE) AS sex_bin",
                 "CAST(vec_id % 4 = 1 AS DOUBLE) AS view_AP", "CAST(vec_id % 4 = 2 AS DOUBLE) AS view_PA").write.parquet(f"{base}/data.parquet")
    scored = bulk.batch_score_images(rd.scoring_input(spark, base), sc.channel_meta_factory(), len(LABELS), META_COLS,
                                     root=write_images(spark, d, **SAME_NAMES))
    out = _scratch(spark, d, "batch_scored")
    wr.write_scored(scored, out)
    back = spark.read.parquet(out).select("image_path", "error", F.explode_outer("predictions").alias("label", "score"))
    return back.withColumn("score", F.round(F.col("score").cast("double"), 4))


QUOTED_GONE = "'gone_'"


def _job_ctes(rows: str, image_error: str) -> list[tuple[str, str]]:
    """``j``: the job's rows with features, folder and all errors, from ``rows``
    (idx, name, age, gender, view, c0, c1, c2 and what ``image_error`` names)."""
    return [("r", rows), ("j", f"""SELECT *,
      least(greatest(CAST(age AS DOUBLE), 0.0), 100.0) / 100.0 AS age_norm,
      CASE WHEN upper(gender) = 'M' THEN 1.0 ELSE 0.0 END AS sex_bin,
      CASE WHEN upper(view) = 'AP' THEN 1.0 ELSE 0.0 END AS view_AP,
      CASE WHEN upper(view) = 'PA' THEN 1.0 ELSE 0.0 END AS view_PA,
      coalesce(nullif(upper(left(regexp_replace(name, '[^a-zA-Z]', '', 'g'), 1))
        || lower(substr(regexp_replace(name, '[^a-zA-Z]', '', 'g'), 2)), ''), 'Unknown') || '20260209' AS folder_name,
      list_filter([
        CASE WHEN age < 0 OR age > 150 THEN 'Invalid age: ' || CAST(age AS VARCHAR) || '. Must be between 0 and 150.' END,
        CASE WHEN upper(gender) NOT IN ('M', 'F') THEN 'Invalid gender: ' || gender || '. Must be ''M'' or ''F''.' END,
        CASE WHEN upper(view) NOT IN ('AP', 'PA') THEN 'Invalid view: ' || view || '. Must be ''AP'' or ''PA''.' END,
        {image_error}], lambda x: x IS NOT NULL) AS errs FROM r""")]


JOB_SQL = f"""
SELECT j.idx, j.name AS patient_name, j.age, j.gender, j.view, j.folder_name, len(j.errs) = 0 AS success,
  CASE WHEN len(j.errs) = 0 THEN 'Saved to /registry/' || j.folder_name ELSE array_to_string(j.errs, '; ') END AS message,
  t.top AS top_prediction, 'spark_batch' AS source
FROM j LEFT JOIN (SELECT i.idx, arg_max(n.name, (CAST({_image_score_sql(1.0, BATCH_META)} AS FLOAT), -n.k)) AS top
                  FROM j i, label_names n WHERE len(i.errs) = 0 GROUP BY i.idx) t ON t.idx = j.idx"""

IMAGE_JOB_CTES = FULL_CTES + _job_ctes(
    """SELECT u.*, i.* FROM uploads u LEFT JOIN img i ON i.vec_id = u.idx % (SELECT count(*) FROM embeddings)""",
    "CASE WHEN NOT coalesce(ok, false) THEN 'Could not read image: cannot identify image file' END")


@query("bulk_image_job", sql(["uploads", "label_names"], JOB_SQL, IMAGE_JOB_CTES))
def q_bulk_image_job(spark, d):
    """Uploads whose image files are read by path, decoded and scored with their
    metadata in one task; many uploads may name one file, and folders hold equal
    names. Unreadable files are rejected by decoding, not by name."""
    return _image_job(spark, d).select(*bulk.RESULT_COLS)


def _image_job(spark, d):
    n = fx.table(spark, d, "embeddings").count()
    root = write_images(spark, d, **SAME_NAMES)
    u = fx.uploads(spark, d).drop("content").withColumn("image_path", F.concat(F.lit(f"{root}/"), F.expr(image_path(f"(idx % {n})"))))
    return bulk.bulk_image_job(u, sc.channel_meta_factory(), F.lit("2026-02-09").cast("date"))


#: Uploaded bytes: some cut short, some of formats that are not accepted.
DAMAGE = """CASE vec_id % 17 WHEN 3 THEN substring(content, 1, length(content) - 9)
            WHEN 5 THEN concat(unhex('474946383961'), content) WHEN 7 THEN concat(unhex('424D'), content) ELSE content END"""


@query("bulk_content_job", sql(["label_names"], JOB_SQL, FULL_CTES + _job_ctes(
    """SELECT vec_id AS idx, 'Patient ' || chr(CAST(65 + vec_id % 26 AS INTEGER)) AS name, CAST(vec_id % 170 - 10 AS INTEGER) AS age,
         CASE vec_id % 11 WHEN 0 THEN 'X' ELSE substr('MFmf', CAST(vec_id % 4 + 1 AS INTEGER), 1) END AS gender,
         CASE vec_id % 13 WHEN 0 THEN 'LL' WHEN 1 THEN 'ap' ELSE 'PA' END AS view, c0, c1, c2, ok, vec_id % 17 AS kind FROM img""",
    """CASE WHEN kind = 5 THEN 'Invalid image format: GIF. Must be PNG or JPEG.' WHEN kind = 7 THEN 'Invalid image format: BMP. Must be PNG or JPEG.'
            WHEN NOT ok THEN 'Could not read image: cannot identify image file' WHEN kind = 3 THEN 'Could not read image: image file is truncated' END""")))
def q_bulk_content_job(spark, d):
    """Uploads that hold the bytes of their image: the format and the whole
    structure are checked while decoding, in the scoring task; truncated, foreign
    and unreadable contents reject their row with its message."""
    u = rd.image_bytes(spark, write_images(spark, d)).select(
        F.regexp_extract("basename", r"(\d+)", 1).cast("long").alias("vec_id"), "content").selectExpr(
        "vec_id AS idx", "concat('Patient ', chr(65 + vec_id % 26)) AS name", "CAST(vec_id % 170 - 10 AS INT) AS age",
        "CASE vec_id % 11 WHEN 0 THEN 'X' ELSE substr('MFmf', CAST(vec_id % 4 + 1 AS INT), 1) END AS gender",
        "CASE vec_id % 13 WHEN 0 THEN 'LL' WHEN 1 THEN 'ap' ELSE 'PA' END AS view", f"{DAMAGE} AS content")
    job = bulk.bulk_image_job(u, sc.channel_meta_factory(), F.lit("2026-02-09").cast("date"), content="content")
    return job.select(*bulk.RESULT_COLS)


@query("registry_from_results", sql(["uploads", "label_names"], """
SELECT folder_name, arg_max(idx, (2 - idx % 2, idx)) AS idx, arg_max(name, (2 - idx % 2, idx)) AS patient_name,
  arg_max(age, (2 - idx % 2, idx)) AS age, arg_max(gender, (2 - idx % 2, idx)) AS gender,
  arg_max(view, (2 - idx % 2, idx)) AS view, max(2 - idx % 2) AS run_id
FROM j WHERE len(errs) = 0 GROUP BY folder_name""", IMAGE_JOB_CTES))
def q_registry_from_results(spark, d):
    """Registry state served from the results log alone: two runs of one day
    (the second re-scores every other upload), last write wins per folder."""
    path = _scratch(spark, d, "results_log")
    res = _image_job(spark, d).withColumns({"run_date": F.lit("2026-02-09"), "intake_id": F.lit("bulk")})
    wr.write_results(res.withColumn("run_id", F.lit(1)), path)
    first = spark.read.parquet(path)
    wr.write_results(first.where("idx % 2 = 0").drop("written_at").withColumn("run_id", F.lit(2)), path)
    log = spark.read.parquet(path).where("success")
    return rg.latest_per_key(log, "folder_name", ["run_id", "idx"]).select(
        "folder_name", "idx", "patient_name", "age", "gender", "view", F.col("run_id").cast("int").alias("run_id"))


# ------------------------------------------------------------- streaming
UPLOAD_SCHEMA = T.StructType([T.StructField("idx", T.LongType()), T.StructField("name", T.StringType()),
                              T.StructField("age", T.IntegerType()), T.StructField("gender", T.StringType()),
                              T.StructField("view", T.StringType()), T.StructField("content", T.StringType())])


@query("stream_intake", BULK_SQL)
def q_stream_intake(spark, d):
    """Upload records arriving as JSON files -> validate -> join decoded
    images -> masked batch scoring -> results log, one run id per
    micro-batch (a replayed batch overwrites its own partition)."""
    from ..streaming.intake import start_intake
    base = _scratch(spark, d, "stream")
    src, out, ckpt = f"{base}/in", f"{base}/results", f"{base}/checkpoint"
    u = fx.uploads(spark, d).withColumn("content", F.base64("content"))
    u.repartition(4).write.mode("overwrite").json(src)
    imgs = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("image_vec"))
    scorer = sc.batch_scorer(sc.linear_model_factory(68, n_inputs=2), [[64], [4]], masked=True)

    def process(batch):
        b = batch.withColumn("content", F.unbase64("content"))
        r = bulk.bulk_patient_job(b, imgs, scorer, F.lit("2026-02-09").cast("date"))
        return r.select(*bulk.RESULT_COLS).withColumn("run_date", F.lit("2026-02-09"))

    q = start_intake(spark, src, UPLOAD_SCHEMA, process, out, ckpt, max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(out).select(*bulk.RESULT_COLS)
