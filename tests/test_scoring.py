"""Scoring: batching, model cache per worker, masks, failure isolation."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortbeam.operators import bulk
from cohortbeam.operators import scoring as sc


def _factory(log_dir):
    def make():
        with open(os.path.join(log_dir, f"load-{os.getpid()}-{np.random.randint(1 << 30)}"), "w"):
            pass

        def predict(x):
            if (x[:, 0] == -999).any():
                raise ValueError("sentinel reached the model")
            return np.tile(x.sum(axis=1, keepdims=True), (1, 2))
        return predict
    return make


def test_model_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path)
    scorer = sc.batch_scorer(_factory(log), [[3]], n_out=2)
    df = spark.range(0, 400, 1, 4).select(F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(2.0)).alias("x"))
    out = sc.score(df, scorer, ["x"]).select(F.col("scores")[0].alias("s")).collect()
    assert len(out) == 400
    loads = os.listdir(log)
    pids = {f.split("-")[1] for f in loads}
    assert len(loads) == len(pids)  # one load per Python worker, not per batch (13 batches)


def test_masked_rows_never_reach_the_model(spark, tmp_path):
    scorer = sc.batch_scorer(_factory(str(tmp_path)), [[3]], n_out=2, masked=True)
    df = spark.range(100).select(
        "id", F.when(F.col("id") % 3 == 0, F.array(F.lit(-999.0), F.lit(0.0), F.lit(0.0)))
               .otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).alias("x"),
        (F.col("id") % 3 != 0).cast("double").alias("m"))
    r = sc.score(df, scorer, ["x", "m"], capture_errors=True).collect()
    assert all(x.error is None for x in r)
    assert all((x.scores is None) == (x.id % 3 == 0) for x in r)


def test_failure_isolated_to_its_row(spark, tmp_path):
    scorer = sc.batch_scorer(_factory(str(tmp_path)), [[3]], n_out=2, capture_errors=True)
    df = spark.range(64).select("id", F.array(F.when(F.col("id") == 5, -999.0).otherwise(1.0), F.lit(1.0), F.lit(1.0)).alias("x"))
    r = {x.id: x for x in sc.score(df, scorer, ["x"], capture_errors=True).collect()}
    assert r[5].scores is None and "sentinel" in r[5].error
    assert all(r[i].scores == [3.0, 3.0] and r[i].error is None for i in r if i != 5)


def test_single_patient_path(spark):
    scorer = sc.batch_scorer(sc.linear_model_factory(68, n_inputs=2), [[64], [4]], masked=True)
    png = b"\x89PNG\r\n\x1a\n" + b"x" * 10
    ok = bulk.single_patient(spark, [0.01] * 64, "Ann Lee", 40, "f", "pa", png, scorer, "2026-02-09").first()
    assert ok.success and ok.folder_name == "Annlee20260209" and ok.source == "web_upload" and len(ok.top3) == 3
    bad = bulk.single_patient(spark, [0.01] * 64, "Ann", 400, "f", "pa", png, scorer, "2026-02-09").first()
    assert not bad.success and bad.message.startswith("Invalid age: 400.") and bad.predictions is None


def test_model_shipped_as_file(spark, tmp_path):
    path = str(tmp_path / "weights_file_model.npz")
    np.savez(path, weights=sc.rule_weights(64))
    from_file = sc.batch_scorer(sc.file_model_factory(spark, path), [[64]])
    in_memory = sc.batch_scorer(sc.linear_model_factory(64), [[64]])
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a = {r.vec_id: r.s for r in sc.score(df, from_file, ["embedding"], out="s").select("vec_id", "s").collect()}
    b = {r.vec_id: r.s for r in sc.score(df, in_memory, ["embedding"], out="s").select("vec_id", "s").collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_failed_rows_as_zeros_compat(spark, tmp_path):
    scorer = sc.batch_scorer(_factory(str(tmp_path)), [[3]], n_out=2, capture_errors=True)
    df = spark.range(8).select("id", F.array(F.when(F.col("id") == 3, -999.0).otherwise(1.0), F.lit(1.0), F.lit(1.0)).alias("x"))
    r = {x.id: x for x in sc.score(df, scorer, ["x"], capture_errors=True, failed_as_zeros=True).collect()}
    assert r[3].scores == [0.0, 0.0] and r[3].error is not None
    assert r[0].scores == [3.0, 3.0] and r[0].error is None


@pytest.mark.parametrize("pixels", [1, 7, 64, 65536, 96 * 3])
def test_channel_meta_model_is_the_plain_formula(pixels):
    rng = np.random.default_rng(pixels)
    x, meta = rng.random((5, pixels * 3), dtype=np.float32), rng.random((5, 4))
    model = sc.channel_meta_factory()()
    both = np.concatenate([x.astype(np.float64).reshape(5, pixels, 3).mean(axis=1), meta], axis=1)
    assert np.allclose(model(x, meta), 1 / (1 + np.exp(-(both @ sc.rule_weights(7)))), atol=1e-12)
    for bad in (np.nan, np.inf, -np.inf):
        broken = x.copy()
        broken[2, -1] = bad
        with pytest.raises(ValueError):
            model(broken, meta)


def test_rows_of_one_file_reach_the_model_without_copies():
    from cohortbeam.operators.file_scoring import model_batches
    rng = np.random.default_rng(3)
    a, b, c, d = (rng.random(192).astype(np.float32) for _ in range(4))
    for tensors in ([a] * 20 + [b] * 3 + [c] * 2 + [d] * 9 + [a], [a, b, c, d] * 10, [a], [b] * 8, [a, b] + [c] * 40, []):
        parts = list(model_batches(tensors, 16))
        assert [i for s, e, _ in parts for i in range(s, e)] == list(range(len(tensors)))
        for s, e, x in parts:
            assert x.shape == (e - s, 192) and e - s <= 16 and all((x[i - s] == tensors[i]).all() for i in range(s, e))
    first = next(model_batches([a] * 20, 16))[2]
    assert np.shares_memory(first, a) and first.strides[0] == 0
    model, meta = sc.channel_meta_factory()(), rng.random((16, 4))
    assert (model(first, meta) == model(np.stack([a] * 16), meta)).all()


def test_resize_makes_no_more_than_its_sums_in_double_precision():
    import tracemalloc

    from cohortbeam.operators.resample import resize_lanczos
    img = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    resize_lanczos(img, 256, 256)
    tracemalloc.start()
    resize_lanczos(img, 256, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * 256 * 256 * 3 * 8  # the sums; before, two or three arrays of their size
