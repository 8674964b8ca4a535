"""Sources, sinks, images and streaming round trips."""
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortbeam.operators import images as im
from cohortbeam.sinks import writers as wr
from cohortbeam.sources import readers as rd
from cohortbeam.sources.pngwrite import encode_png


def test_png_decode_channels_and_scale(spark, tmp_path):
    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[..., 0] = 10
    rgb[..., 1] = 20
    rgb[..., 2] = 30
    (tmp_path / "rgb.png").write_bytes(encode_png(rgb))
    (tmp_path / "gray.png").write_bytes(encode_png(np.full((2, 2), 255, np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"nope")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in im.prepare_images(rd.image_table(spark, str(tmp_path)), (4, 4), "none").collect()}
    px = np.array(rows["rgb.png"].pixels).reshape(4, 4, 3)
    assert np.allclose(px[..., 0], 10) and np.allclose(px[..., 1], 20) and np.allclose(px[..., 2], 30)  # RGB, not BGR
    assert np.allclose(rows["gray.png"].pixels, 255.0) and rows["gray.png"].channels == 3
    assert rows["bad.png"].ok is False and rows["bad.png"].pixels is None


def test_bilinear_resize_identity_and_constant():
    a = np.arange(12, dtype=np.float32).reshape(2, 2, 3)
    assert np.allclose(im.resize_bilinear(a, 2, 2), a)
    c = np.full((3, 5, 3), 7.0)
    assert np.allclose(im.resize_bilinear(c, 8, 8), 7.0)


def test_scoring_input_cascade(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    (base / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    df = rd.scoring_input(spark, str(base))  # nothing but images: listing with defaults
    r = df.first()
    assert r.image_path.endswith("x.png") and (r.age_norm, r.sex_bin, r.view_AP, r.view_PA) == (0.5, 0.0, 0.0, 1.0)
    spark.createDataFrame([("a.png", 0.3, 1.0, 1.0, 0.0)], rd.SCORING_INPUT_SCHEMA).write.parquet(str(base / "data.parquet"))
    assert rd.scoring_input(spark, str(base)).first().image_path == "a.png"


def test_model_schema_default(spark, tmp_path):
    ms = rd.model_schema(spark, str(tmp_path / "missing.json")).first()
    assert len(ms.labels) == 14 and ms.meta_cols == ["age_norm", "sex_bin", "view_AP", "view_PA"]


def test_results_log_rerun_replaces_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "log")
    mk = lambda run, n: spark.range(n).select(F.col("id"), F.lit("2026-01-01").alias("run_date"), F.lit("a").alias("intake_id"), F.lit(run).alias("run_id"))
    wr.write_results(mk(1, 5), path)
    wr.write_results(mk(2, 3), path)
    wr.write_results(mk(1, 2), path)  # replay of run 1
    c = {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert c == {1: 2, 2: 3}


def test_registry_docs_from_paths(spark, tmp_path):
    for folder, name in [("Ann20260101", "Ann"), ("Bob20260102", "Bob")]:
        d = tmp_path / folder
        d.mkdir()
        (d / "metadata.json").write_text('{\n "patient_name": "%s",\n "age": 40\n}' % name)
    (tmp_path / "Bob20260102" / "predictions.json").write_text('{"Mass": 0.25, "Edema": 0.5}')
    m = rd.registry_docs(spark, str(tmp_path), "metadata.json", rd.METADATA_SCHEMA, multi_line=True)
    got = sorted((r.folder_name, r.doc.patient_name, r.doc.age) for r in m.collect())
    assert got == [("Ann20260101", "Ann", 40), ("Bob20260102", "Bob", 40)]
    p = rd.registry_docs(spark, str(tmp_path), "predictions.json", rd.PREDICTIONS_SCHEMA, multi_line=True).first()
    assert p.folder_name == "Bob20260102" and p.doc["Edema"] == 0.5


def test_stream_intake_replay_is_idempotent(spark, tmp_path):
    from cohortbeam.streaming.intake import start_intake
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("age", T.IntegerType())])
    src = tmp_path / "in"
    spark.range(10).select(F.col("id").alias("idx"), (F.col("id") * 10).cast("int").alias("age")) \
        .repartition(2).write.json(str(src))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    proc = lambda b: b.withColumn("run_date", F.lit("2026-01-01"))
    start_intake(spark, str(src), schema, proc, out, ck, max_files_per_trigger=1).awaitTermination()
    n1 = spark.read.parquet(out).count()
    start_intake(spark, str(src), schema, proc, out, ck).awaitTermination()  # restart: nothing new
    assert n1 == 10 and spark.read.parquet(out).count() == 10


def test_two_intakes_and_a_reset_checkpoint_share_one_log(spark, tmp_path):
    from cohortbeam.streaming.intake import start_intake
    proc = lambda b: b.withColumn("run_date", F.lit("2026-01-01"))
    out = str(tmp_path / "out")
    for n, src, ck in ((10, "a", "ck1"), (3, "b", "ck2"), (3, "b", "ck3")):  # ck3: the second intake starts afresh
        if not (tmp_path / src).exists():
            spark.range(n).select(F.col("id").alias("idx")).coalesce(1).write.json(str(tmp_path / src))
        start_intake(spark, str(tmp_path / src), "idx long", proc, out, str(tmp_path / ck)).awaitTermination()
    log = spark.read.parquet(out)
    assert log.count() == 16 and log.select("intake_id").distinct().count() == 3
    assert log.where("written_at IS NULL").count() == 0


def test_cascade_raises_on_other_errors(spark, tmp_path):
    bad = tmp_path / "in"
    bad.mkdir()
    (bad / "data.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        rd.scoring_input(spark, str(bad)).collect()


def test_score_images_matches_numpy(spark, tmp_path):
    from cohortbeam.constants import LABELS
    from cohortbeam.operators import scoring as sc
    rng = np.random.default_rng(3)
    expect = {}
    model = sc.ChannelMeanModel(sc.rule_weights(3) * 4.0)
    for i in range(6):
        px = rng.integers(0, 256, size=(5, 7, 3), dtype=np.uint8) if i % 2 else rng.integers(0, 256, size=(5, 7), dtype=np.uint8)
        (tmp_path / f"{i}.png").write_bytes(encode_png(px))
        rgb = px.astype(np.float32) if px.ndim == 3 else np.repeat(px[..., None], 3, axis=2).astype(np.float32)
        x = im.scale_pixels(im.resize_bilinear(rgb, 16, 16), "tanh").astype(np.float32).reshape(1, -1)
        expect[f"{i}.png"] = LABELS[int(np.argmax(model(x)[0]))]
    (tmp_path / "broken.png").write_bytes(b"junk")
    scorer = sc.batch_scorer(sc.channel_mean_factory(), [[16 * 16 * 3]], masked=True)
    rows = im.score_images(rd.image_table(spark, str(tmp_path)), scorer, size=(16, 16)).collect()
    got = {r.path.rsplit("/", 1)[-1]: r for r in rows}
    assert got["broken.png"].ok is False and got["broken.png"].scores is None
    for name, label in expect.items():
        s = got[name].scores
        assert LABELS[int(np.argmax(s))] == label


def test_fused_image_scoring_equals_two_step(spark, tmp_path):
    from cohortbeam.operators import scoring as sc
    rng = np.random.default_rng(5)
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(encode_png(rng.integers(0, 256, size=(6, 4, 3), dtype=np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"junk")
    imgs = rd.image_table(spark, str(tmp_path))
    scorer = sc.batch_scorer(sc.channel_mean_factory(), [[8 * 8 * 3]], masked=True)
    two = {r.path: r.scores for r in im.score_images(imgs, scorer, size=(8, 8)).collect()}
    one = {r.path: r.scores for r in im.score_images_fused(imgs, sc.channel_mean_factory(), 14, size=(8, 8)).collect()}
    assert two.keys() == one.keys()
    for k in two:
        assert (two[k] is None) == (one[k] is None)
        if two[k] is not None:
            assert np.allclose(two[k], one[k])


def test_scaling_modes():
    px = np.full((2, 2, 3), 255.0, dtype=np.float32)
    assert np.allclose(im.scale_pixels(px, "tanh"), 1.0)
    assert np.allclose(im.scale_pixels(px, "unit"), 1.0)
    out = im.scale_pixels(px, "imagenet")
    assert np.allclose(out[0, 0], [(1 - 0.485) / 0.229, (1 - 0.456) / 0.224, (1 - 0.406) / 0.225])
    with pytest.raises(ValueError):
        im.scale_pixels(px, "other")


def test_training_export_order(spark, tmp_path):
    import hashlib

    import pyarrow.parquet as pq
    n = 500
    df = spark.range(n).selectExpr("id AS idx", "IF(id % 5 = 0, 'val', 'train') AS split", "'p' AS file_path",
                                   "1.0D AS a", "0 AS b").repartition(6)
    out = tmp_path / "export"
    wr.export_training_set(df, str(out), ["a"], ["b"], seed=42)

    def order(split):  # files in name order, rows in file order
        files = sorted((out / f"split={split}").glob("part-*.parquet"))
        return [i for f in files for i in pq.ParquetFile(f).read(columns=["idx"])["idx"].to_pylist()]
    train = [i for i in range(n) if i % 5]
    assert order("train") == sorted(train, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert order("val") == [i for i in range(n) if i % 5 == 0]


def test_model_with_many_inputs(spark):
    from cohortbeam.operators import scoring as sc
    df = spark.range(5).selectExpr(*[f"array(CAST(id + {i} AS DOUBLE)) AS c{i}" for i in range(5)])

    def factory():
        return sc.with_arity(lambda *xs: sum(xs).repeat(14, axis=1), 5)
    scorer = sc.batch_scorer(factory, [[1]] * 5, capture_errors=True, masked=False)
    rows = sc.score(df, scorer, [f"c{i}" for i in range(5)], capture_errors=True).collect()
    assert [r.scores[0] for r in sorted(rows, key=lambda r: r.c0)] == [5.0 * i + 10 for i in range(5)]


def test_document_folders_are_those_of_partition_by(spark, tmp_path):
    rows = [("Ann20260101", '{"age": 1}'), ("run_31", '{"age": 2}'), ("run_31", '{"age": 3}'), (None, '{"age": 4}'),
            ("a b/c=d%e'[f]", '{"age": 5}'), ("", '{"age": 6}'), ("é", '{"age": 7}')]
    df = spark.createDataFrame(rows, "folder_name string, value string").repartition(3)
    df.write.partitionBy("folder_name").text(str(tmp_path / "want"))
    wr.write_doc_folders(df, str(tmp_path / "got"))

    def folders(name):
        return sorted(p.name for p in (tmp_path / name).iterdir() if p.is_dir())

    def docs(name):
        r = rd.registry_docs(spark, str(tmp_path / name), "*.txt", rd.METADATA_SCHEMA)
        return sorted((x.folder_name, x.age) for x in r.select("folder_name", "doc.age").collect())
    assert folders("got") == folders("want") and docs("got") == docs("want") and len(docs("got")) == len(rows)
    files = [p for p in (tmp_path / "got").rglob("*") if p.is_file()]
    assert len(files) == len(folders("got"))  # one file a folder, nothing for the driver to move


def test_mean_of_prepared_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    for i, shape in enumerate([(8, 8), (8, 8, 3), (5, 3, 3), (300, 40, 3)]):
        (tmp_path / f"{i}.png").write_bytes(encode_png(rng.integers(0, 256, shape).astype(np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"nope")
    t = im.prepare_images(rd.image_table(spark, str(tmp_path)), (32, 16), "tanh", mean=True)
    assert "aggregate" not in t._jdf.queryExecution().toString().lower()
    rows = t.collect()
    assert len(rows) == 5 and sum(r.ok for r in rows) == 4
    for r in rows:
        if r.ok:
            assert len(r.pixels) == 32 * 16 * 3 and r.mean == pytest.approx(np.mean(np.float64(r.pixels)), abs=1e-12)
        else:
            assert r.pixels is None and r.mean is None


def test_stretched_rows_are_those_of_the_plain_formula():
    rng = np.random.default_rng(5)
    for h, w, out_h, out_w in ((8, 8, 256, 256), (300, 20, 64, 32), (1, 1, 4, 4), (7, 9, 7, 3)):
        a = rng.integers(0, 256, (h, w, 3)).astype(np.float32)
        ys, xs = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((out_h, h), (out_w, w)))
        y0, x0 = ys.astype(int), xs.astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        wy, wx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
        top, bot = (a[y][:, x0] * (1 - wx) + a[y][:, x1] * wx for y in (y0, y1))
        assert (im.resize_bilinear(a, out_h, out_w) == top * (1 - wy) + bot * wy).all()


def test_few_table_files_are_written_by_many_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, [0.0] * 64) for i in range(40)], "vec_id long, embedding array<float>").coalesce(1)
    written = im.write_image_files(df, str(tmp_path / "images"))
    assert written.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert written.count() == 40 and len(list((tmp_path / "images").rglob("*.png"))) == 40


def test_channel_means_make_no_copy_in_double(spark):
    import tracemalloc

    from cohortbeam.operators import scoring as sc
    x = np.random.default_rng(6).random((16, 64 * 64 * 3), dtype=np.float32)
    model = sc.ChannelMeanModel(sc.rule_weights(3))
    want = 1 / (1 + np.exp(-(x.astype(np.float64).reshape(16, -1, 3).mean(axis=1) @ sc.rule_weights(3))))
    tracemalloc.start()
    got = model(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, atol=1e-12) and peak < x.nbytes
    x[3, 7] = np.inf
    with pytest.raises(ValueError):
        model(x)
