"""Registry (folder keys, list, search, detail, upsert) and heatmap queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import LABELS, METADATA_DOC, PREDICTIONS_DOC, TOP_K_DISPLAY, TOP_K_HEATMAPS
from ..functions import text as tx
from ..operators import cam
from ..operators import ranking as rk
from ..operators import registry as rg
from ..operators import scoring as sc
from .catalog import query
from .oracle_views import _w, sql


# ----------------------------------------------------------- registry log
def write_log(spark, d):
    """Registry writes: one per folders row; write time from its date."""
    return fx.folders(spark, d).selectExpr(
        "*", "CAST(datediff(run_date, DATE'1970-01-01') AS BIGINT) * 86400 + (idx % 24) * 3600 AS write_ts")


LOG = ("log", """SELECT *, CAST(date_diff('day', DATE '1970-01-01', run_date) AS BIGINT) * 86400 + (idx % 24) * 3600 AS write_ts
  FROM folders""")
STATE = ("state", """SELECT folder_name, arg_max(idx, (write_ts, idx)) AS idx, max(write_ts) AS write_ts FROM log GROUP BY folder_name""")


def state(spark, d):
    return rg.latest_per_key(write_log(spark, d).select("folder_name", "idx", "write_ts"),
                             "folder_name", ["write_ts", "idx"])


@query("registry_upsert", sql(["folders"], "SELECT folder_name, idx, write_ts FROM state", [LOG, STATE]))
def q_registry_upsert(spark, d):
    """Last write wins per folder key (same name on the same day)."""
    return state(spark, d)


def metadata_docs(spark, d):
    has = fx.files(spark, d).where(F.col("file_name") == METADATA_DOC).select("idx")
    return fx.folders(spark, d).join(has, "idx", "left_semi").selectExpr(
        "idx",
        "CASE WHEN idx % 23 = 0 THEN '' ELSE patient_name END AS patient_name",
        "p_size * 2 AS age",
        "IF(idx % 2 = 0, 'M', 'F') AS gender",
        "IF(p_type IN ('ECONOMY', 'MEDIUM', 'STANDARD'), 'AP', 'PA') AS view",
        "CASE WHEN idx % 41 = 0 THEN CAST(NULL AS STRING) "
        "ELSE concat(date_format(run_date, 'yyyy-MM-dd'), 'T10:00:00') END AS timestamp")


META = ("meta", """SELECT f.idx, CASE WHEN f.idx % 23 = 0 THEN '' ELSE f.patient_name END AS patient_name,
    f.p_size * 2 AS age, CASE WHEN f.idx % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CASE WHEN f.p_type IN ('ECONOMY', 'MEDIUM', 'STANDARD') THEN 'AP' ELSE 'PA' END AS view,
    CASE WHEN f.idx % 41 = 0 THEN NULL ELSE strftime(f.run_date, '%Y-%m-%d') || 'T10:00:00' END AS timestamp
  FROM folders f WHERE EXISTS (SELECT 1 FROM files x WHERE x.idx = f.idx AND x.file_name = 'metadata.json')""")


def prediction_docs(spark, d):
    has = fx.files(spark, d).where(F.col("file_name") == PREDICTIONS_DOC).select("idx")
    w = fx.scores_wide(spark, d).select(F.col("vec_id").alias("idx"), sc.predictions_map(F.col("scores")).alias("predictions"))
    return w.join(has, "idx", "left_semi")


PRED = ("pred", """SELECT s.vec_id AS idx, s.k, n.name AS label, CAST(CAST(s.score AS FLOAT) AS DOUBLE) AS p
  FROM scores s JOIN label_names n ON n.k = s.k
  WHERE EXISTS (SELECT 1 FROM files x WHERE x.idx = s.vec_id AND x.file_name = 'predictions.json')""")


@query("folder_parse", sql(["folders"], """
SELECT idx, folder_name,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN regexp_extract(folder_name, '^([A-Za-z]+)(\\d{8})$', 1) ELSE folder_name END AS patient_name,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN
    substr(regexp_extract(folder_name, '(\\d{8})$', 1), 1, 4) || '-' || substr(regexp_extract(folder_name, '(\\d{8})$', 1), 5, 2)
    || '-' || substr(regexp_extract(folder_name, '(\\d{8})$', 1), 7, 2) ELSE 'Unknown' END AS date,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN regexp_extract(folder_name, '(\\d{8})$', 1) ELSE '00000000' END AS date_raw
FROM folders"""))
def q_folder_parse(spark, d):
    f = fx.folders(spark, d)
    return f.select("idx", "folder_name", *[v.alias(k) for k, v in tx.parse_folder(F.col("folder_name")).items()])


LIST_SQL = """SELECT folder_name,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN regexp_extract(folder_name, '^([A-Za-z]+)(\\d{8})$', 1) ELSE folder_name END AS patient_name,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN
    substr(regexp_extract(folder_name, '(\\d{8})$', 1), 1, 4) || '-' || substr(regexp_extract(folder_name, '(\\d{8})$', 1), 5, 2)
    || '-' || substr(regexp_extract(folder_name, '(\\d{8})$', 1), 7, 2) ELSE 'Unknown' END AS date,
  CASE WHEN regexp_matches(folder_name, '^([A-Za-z]+)(\\d{8})$') THEN regexp_extract(folder_name, '(\\d{8})$', 1) ELSE '00000000' END AS date_raw
FROM (SELECT DISTINCT folder_name FROM folders)"""


@query("registry_list", sql(["folders"], "SELECT * FROM lst ORDER BY date_raw DESC, folder_name", [("lst", LIST_SQL)]))
def q_registry_list(spark, d):
    return rg.registry_list(fx.folders(spark, d))


@query("registry_search", sql(["folders"], "SELECT * FROM lst WHERE contains(lower(patient_name), 'widget')", [("lst", LIST_SQL)]))
def q_registry_search(spark, d):
    return rg.search(rg.registry_list(fx.folders(spark, d)), "Widget")


@query("registry_lookup", sql(["folders"], """
SELECT s.folder_name, s.idx, f.patient_name FROM state s JOIN folders f ON f.idx = s.idx
WHERE s.folder_name = 'Redwidget20260102'""", [LOG, STATE]))
def q_registry_lookup(spark, d):
    """Point lookup of one folder key in the write log, pruned by its date."""
    log = write_log(spark, d).select("folder_name", "run_date", "idx", "patient_name", "write_ts")
    return rg.lookup_log(log, "Redwidget20260102", ["write_ts", "idx"]).select("folder_name", "idx", "patient_name")


@query("image_role", sql(["files"], """
SELECT idx, folder_name, file_name, CASE WHEN file_name = 'original.png' THEN 'original'
  WHEN suffix(file_name, '.png') THEN 'gradcam' END AS role FROM files"""))
def q_image_role(spark, d):
    f = fx.files(spark, d)
    return f.select("idx", "folder_name", "file_name", tx.image_role("file_name").alias("role"))


@query("date_part", sql(["folders", "files"], """
SELECT idx, coalesce(nullif(split_part(timestamp, 'T', 1), ''), 'N/A') AS date FROM meta""", [META]))
def q_date_part(spark, d):
    return metadata_docs(spark, d).select("idx", tx.iso_date_part("timestamp").alias("date"))


@query("label_filename", sql(["scores", "label_names"], f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, 'gradcam_' || replace(replace(label, ' ', '_'), '/', '_') || '.png' AS filename,
  regexp_replace(regexp_replace('gradcam_' || replace(replace(label, ' ', '_'), '/', '_') || '.png', 'gradcam_', ''), '\\.png', '') AS label_back
FROM (SELECT s.vec_id, n.name AS label, row_number() OVER (PARTITION BY s.vec_id ORDER BY s.score DESC, s.k DESC) AS rank
      FROM scores s JOIN label_names n ON n.k = s.k) WHERE rank <= {TOP_K_HEATMAPS}"""))
def q_label_filename(spark, d):
    w = fx.scores_wide(spark, d)
    names = F.array(*[F.lit(x) for x in LABELS])
    t = w.select("vec_id", F.posexplode(rk.top_indices(F.col("scores"), TOP_K_HEATMAPS)).alias("pos", "k"))
    t = t.select("vec_id", (F.col("pos") + 1).alias("rank"), F.element_at(names, F.col("k") + 1).alias("label"))
    fn = tx.heatmap_filename("label")
    return t.select("vec_id", "rank", fn.alias("filename"), tx.label_from_filename(fn).alias("label_back"))


@query("registry_assemble", sql(["folders", "files", "scores", "label_names"], """
SELECT s.folder_name, m.idx IS NOT NULL AS has_metadata, pr.idx IS NOT NULL AS has_predictions,
  CAST(coalesce(im.n, 0) AS INTEGER) AS n_images, im.image_list
FROM state s
LEFT JOIN (SELECT DISTINCT idx FROM meta) m ON m.idx = s.idx
LEFT JOIN (SELECT DISTINCT idx FROM pred) pr ON pr.idx = s.idx
LEFT JOIN (SELECT idx, count(*) AS n, string_agg(file_name, ',' ORDER BY file_name) AS image_list
           FROM files WHERE suffix(file_name, '.png') GROUP BY idx) im ON im.idx = s.idx""",
                                   [LOG, STATE, META, PRED]))
def q_registry_assemble(spark, d):
    """Latest state per folder joined with its metadata, predictions and
    images; any part may be missing."""
    st = state(spark, d)
    files = fx.files(spark, d).join(st.select("idx"), "idx", "left_semi")
    meta = metadata_docs(spark, d).join(st.select("idx", "folder_name"), "idx").drop("idx")
    pred = prediction_docs(spark, d).join(st.select("idx", "folder_name"), "idx").drop("idx")
    imgs = rg.images_per_folder(files)
    a = rg.assemble(st, meta, pred, imgs)
    return a.select("folder_name", F.col("patient_name").isNotNull().alias("has_metadata"),
                    F.col("predictions").isNotNull().alias("has_predictions"),
                    F.coalesce(F.size("images"), F.lit(0)).cast("int").alias("n_images"),
                    F.array_join(F.transform("images", lambda x: x["filename"]), ",").alias("image_list"))


@query("registry_detail", sql(["folders", "files", "scores", "label_names"], f"""
SELECT s.folder_name, coalesce(nullif(m.patient_name, ''), s.folder_name) AS title,
  CASE WHEN m.idx IS NULL THEN NULL WHEN m.gender = 'M' THEN 'Male' ELSE 'Female' END AS gender_display,
  CASE WHEN m.idx IS NULL THEN NULL ELSE coalesce(nullif(split_part(m.timestamp, 'T', 1), ''), 'N/A') END AS date,
  CAST(r.rank AS INTEGER) AS rank, r.label, printf('%.1f', round(r.p * 100.0, 1)) AS pct,
  CASE WHEN r.rank IS NULL THEN NULL WHEN round(r.p * 100.0, 1) >= 50.0 THEN 'high'
       WHEN round(r.p * 100.0, 1) >= 25.0 THEN 'medium' ELSE 'low' END AS band, im.image_list
FROM state s LEFT JOIN meta m ON m.idx = s.idx
LEFT JOIN (SELECT idx, string_agg(CASE WHEN file_name = 'original.png' THEN 'original:' ELSE 'gradcam:' END || file_name, ',' ORDER BY file_name) AS image_list
           FROM files WHERE suffix(file_name, '.png') GROUP BY idx) im ON im.idx = s.idx
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY p DESC, k) AS rank FROM pred)
           WHERE rank <= {TOP_K_DISPLAY}) r ON r.idx = s.idx""", [LOG, STATE, META, PRED]))
def q_registry_detail(spark, d):
    """Detail page data: title, gender, date, images with their role, top-5
    predictions with bands."""
    st = state(spark, d)
    files = fx.files(spark, d).join(st.select("idx"), "idx", "left_semi")
    images = rg.images_per_folder(files).select("folder_name", F.array_join(F.transform(
        "images", lambda x: F.concat(x["type"], F.lit(":"), x["filename"])), ",").alias("image_list"))
    meta = metadata_docs(spark, d)
    pred = prediction_docs(spark, d)
    j = st.join(meta, "idx", "left").join(pred, "idx", "left").join(images, "folder_name", "left")
    has_meta = F.col("age").isNotNull()
    j = j.select("folder_name",
                 F.coalesce(F.nullif(F.col("patient_name"), F.lit("")), F.col("folder_name")).alias("title"),
                 F.when(has_meta, tx.gender_display("gender")).alias("gender_display"),
                 F.when(has_meta, tx.iso_date_part("timestamp")).alias("date"),
                 "image_list", rk.top_k(F.col("predictions"), TOP_K_DISPLAY).alias("top"))
    x = j.select("folder_name", "title", "gender_display", "date", "image_list",
                 F.posexplode_outer("top").alias("pos", "e"))
    p = F.col("e.value").cast("double")
    return x.select("folder_name", "title", "gender_display", "date", "image_list",
                    F.when(F.col("e").isNotNull(), F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("e.key").alias("label"),
                    F.when(F.col("e").isNotNull(), tx.percent_text(p)).alias("pct"),
                    F.when(F.col("e").isNotNull(), tx.risk_band(p)).alias("band"))


# ---------------------------------------------------------------- heatmaps
CAM_SQL_CTES = [
    ("wts", "SELECT image_key, ch, avg(grad) AS w FROM tensors GROUP BY image_key, ch"),
    ("cm", """SELECT t.image_key, t.cell, greatest(sum(t.act * w.w), 0.0) AS cam
              FROM tensors t JOIN wts w ON w.image_key = t.image_key AND w.ch = t.ch GROUP BY t.image_key, t.cell"""),
]
CAM_SQL = sql(["tensors"], """
SELECT image_key, cell, round(cam / (max(cam) OVER (PARTITION BY image_key) + 1e-8), 6) AS heat FROM cm""", CAM_SQL_CTES)


@query("cam_heatmap", CAM_SQL, bench=True)
def q_cam_heatmap(spark, d):
    """Row-local heatmaps from per-image activation/gradient arrays."""
    e = fx.table(spark, d, "embeddings")
    act = F.col("embedding")
    grad = F.transform("embedding", lambda v: v.cast("double") * v.cast("double") - 0.01)
    h = e.select(F.col("vec_id").alias("image_key"), cam.heatmap_arrays(act, grad, 16, 4).alias("heat"))
    x = h.select("image_key", F.posexplode_outer("heat").alias("cell", "heat"))
    return x.select("image_key", F.col("cell").cast("int").alias("cell"), F.round("heat", 6).alias("heat"))


@query("cam_heatmap_long", CAM_SQL)
def q_cam_heatmap_long(spark, d):
    """The same heatmaps from the long activation table."""
    h = cam.heatmap_long(fx.tensors(spark, d))
    return h.select("image_key", F.col("cell").cast("int").alias("cell"), F.round("heat", 6).alias("heat"))


@query("cam_topk", sql(["scores", "label_names"], f"""
SELECT vec_id, label, CAST(cell AS INTEGER) AS cell, round(cam / (max(cam) OVER (PARTITION BY vec_id, label) + 1e-8), 6) AS heat
FROM (SELECT c.vec_id, c.label, c.cell, greatest(sum(c.act * w.w), 0.0) AS cam
      FROM cells c JOIN (SELECT vec_id, label, ch, avg(grad) AS w FROM cells GROUP BY 1, 2, 3) w
        ON w.vec_id = c.vec_id AND w.label = c.label AND w.ch = c.ch GROUP BY 1, 2, 3)""", [
    ("top", f"""SELECT vec_id, k, label FROM (SELECT s.vec_id, s.k, n.name AS label,
                row_number() OVER (PARTITION BY s.vec_id ORDER BY s.score DESC, s.k DESC) AS rank
                FROM scores s JOIN label_names n ON n.k = s.k) WHERE rank <= {TOP_K_HEATMAPS}"""),
    ("el", "SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings"),
    ("cells", f"""SELECT t.vec_id, t.label, (el.i - 1) // 4 AS cell, (el.i - 1) % 4 AS ch, CAST(el.v AS DOUBLE) AS act,
                  {_w('el.i', 't.k')} AS grad FROM top t JOIN el ON el.vec_id = t.vec_id"""),
]))
def q_cam_topk(spark, d):
    """Heatmaps for the top-3 classes of each image; the gradient of a linear
    class score w.r.t. its inputs is that class's weight vector."""
    w = fx.scores_wide(spark, d, keep=("embedding",))
    names = F.array(*[F.lit(x) for x in LABELS])
    t = w.select("vec_id", "embedding", F.explode_outer(rk.top_indices(F.col("scores"), TOP_K_HEATMAPS)).alias("k"))
    grad = cam.class_gradients(64, F.col("k"), fx.weight)
    h = t.select("vec_id", F.element_at(names, F.col("k") + 1).alias("label"),
                 cam.heatmap_arrays(F.col("embedding"), grad, 16, 4).alias("heat"))
    x = h.select("vec_id", "label", F.posexplode_outer("heat").alias("cell", "heat"))
    return x.select("vec_id", "label", F.col("cell").cast("int").alias("cell"), F.round("heat", 6).alias("heat"))
