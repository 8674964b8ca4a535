"""Bulk scoring with a caller-supplied model through Arrow batches.

The model is given as a *factory* (``make_predict_fn``) that loads the model
and returns ``predict(batch) -> scores``. ``pyspark.ml.functions.
predict_batch_udf`` runs the factory once per Python worker (the model is
cached there) and feeds it real batches of ``batch_size`` rows as numpy
arrays, so the model call is vectorized and rows never leave Arrow format.

Failures are data, not exceptions: with ``capture_errors=True`` a batch that
raises is retried row by row inside the worker, failing rows come back with
an ``error`` text and NULL scores, and their 31 neighbours are still scored.
"""
from __future__ import annotations

import inspect
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BATCH_SIZE, LABELS

PredictFn = Callable[..., np.ndarray]


class LinearSigmoidModel:
    """Logistic model ``sigmoid(x @ W)`` (float64), the test model of this
    package. Raises on non-finite input, like a real model would choke on a
    corrupt image."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.asarray(weights, dtype=np.float64)

    def __call__(self, *inputs: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.asarray(a, dtype=np.float64).reshape(len(a), -1) for a in inputs], axis=1)
        if not np.isfinite(x).all():
            raise ValueError("non-finite input")
        return 1.0 / (1.0 + np.exp(-(x @ self.weights)))


class ChannelMeanModel:
    """Test model on image tensors: per-channel mean pixel -> logistic layer.
    Input (n, H*W*C) or (n, H, W, C) float32; C = 3."""

    def __init__(self, weights: np.ndarray, channels: int = 3):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.channels = channels

    def means(self, x: np.ndarray) -> np.ndarray:
        """Channel means in float64; a non-finite pixel makes its mean non-finite.
        A batch that is one image in every row (a view of it) is summed once."""
        x = np.asarray(x)
        if len(x) > 1 and x.strides[0] == 0:
            return np.repeat(self.means(x[:1]), len(x), axis=0)
        n = x.size // (len(x) * self.channels)
        wide = math.gcd(n, 64)  # pixels side by side: long rows add up faster than rows of three
        rows = x.reshape(len(x), n // wide, wide * self.channels).sum(axis=1, dtype=np.float64)
        return rows.reshape(len(x), wide, self.channels).sum(axis=1) / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self.means(x)
        if not np.isfinite(x).all():
            raise ValueError("non-finite input")
        return 1.0 / (1.0 + np.exp(-(x @ self.weights)))


class ChannelMetaModel(ChannelMeanModel):
    """Test model on two inputs: channel means of the image tensor followed by
    the metadata features -> logistic layer."""

    def __call__(self, x: np.ndarray, meta: np.ndarray) -> np.ndarray:
        x = self.means(x)
        both = np.concatenate([x, np.asarray(meta, dtype=np.float64)], axis=1)
        if not np.isfinite(both).all():
            raise ValueError("non-finite input")
        return 1.0 / (1.0 + np.exp(-(both @ self.weights)))


def channel_meta_factory(n_meta: int = 4, channels: int = 3) -> Callable[[], PredictFn]:
    def make_predict_fn() -> PredictFn:
        return with_arity(ChannelMetaModel(rule_weights(channels + n_meta), channels), 2)
    return make_predict_fn


def channel_mean_factory(channels: int = 3) -> Callable[[], PredictFn]:
    def make_predict_fn() -> PredictFn:
        return with_arity(ChannelMeanModel(rule_weights(channels) * 4.0, channels), 1)
    return make_predict_fn


def rule_weights(n_features: int, n_classes: int = len(LABELS)) -> np.ndarray:
    """w(i, k) = ((i*7 + k*5) % 13 - 6) / 10 for i = 1..n_features (test model)."""
    i = np.arange(1, n_features + 1)[:, None]
    k = np.arange(n_classes)[None, :]
    return ((i * 7 + k * 5) % 13 - 6) / 10.0


def with_arity(fn: Callable[..., object], n_inputs: int) -> Callable[..., object]:
    """Give a variadic predict function an explicit positional signature:
    ``predict_batch_udf`` maps input columns to parameters by count."""
    def call(*inputs):
        return fn(*inputs)
    call.__signature__ = inspect.Signature(
        [inspect.Parameter(f"x{i}", inspect.Parameter.POSITIONAL_OR_KEYWORD) for i in range(n_inputs)])
    return call


def linear_model_factory(n_features: int, n_inputs: int = 1) -> Callable[[], PredictFn]:
    def make_predict_fn() -> PredictFn:
        return with_arity(LinearSigmoidModel(rule_weights(n_features)), n_inputs)
    return make_predict_fn


def file_model_factory(spark, path: str, n_inputs: int = 1) -> Callable[[], PredictFn]:
    """Factory for a logistic model stored as an ``.npz`` file (array
    ``weights``). The file is shipped to every executor with
    ``SparkContext.addFile`` and loaded once per Python worker from its
    local copy (``SparkFiles.get``)."""
    import os
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make_predict_fn() -> PredictFn:
        from pyspark import SparkFiles
        with np.load(SparkFiles.get(name)) as z:
            weights = z["weights"]
        return with_arity(LinearSigmoidModel(weights), n_inputs)
    return make_predict_fn


def _with_error_capture(make_predict_fn: Callable[[], PredictFn], n_out: int,
                        n_inputs: int, masked: bool = False) -> Callable[[], PredictFn]:
    def make():
        model = make_predict_fn()

        def run(inputs, rows, scores, errors):
            try:
                scores[rows] = np.asarray(model(*[a[rows] for a in inputs]), dtype=np.float64)
            except Exception:  # noqa: BLE001 - retried row by row
                for r in rows:
                    try:
                        scores[r] = np.asarray(model(*[a[r:r + 1] for a in inputs]), dtype=np.float64)[0]
                    except Exception as e:  # noqa: BLE001
                        errors[r] = f"{type(e).__name__}: {e}"

        def predict(*inputs):
            if masked:  # last input: 1 = send to the model, 0 = never seen by it
                inputs, mask = inputs[:-1], np.asarray(inputs[-1])
                rows = np.flatnonzero(mask > 0)
            else:
                rows = np.arange(len(inputs[0]))
            n = len(inputs[0])
            scores = np.full((n, n_out), np.nan)
            errors = np.array([None] * n, dtype=object)
            if len(rows):
                run(inputs, rows, scores, errors)
            return {"scores": scores, "error": errors}
        return with_arity(predict, n_inputs + (1 if masked else 0))
    return make


def batch_scorer(make_predict_fn: Callable[[], PredictFn], input_shapes: list[list[int]],
                 n_out: int = len(LABELS), batch_size: int = BATCH_SIZE,
                 capture_errors: bool = False, masked: bool = False):
    """A Spark column function scoring its array inputs in batches.

    ``capture_errors``: returns struct<scores, error> and isolates failing
    rows. ``masked`` (implies capture): one extra trailing 0/1 column; rows
    with 0 are never passed to the model and come back without scores.
    """
    from pyspark.ml.functions import predict_batch_udf
    if capture_errors or masked:
        rt = T.StructType([T.StructField("scores", T.ArrayType(T.DoubleType())),
                           T.StructField("error", T.StringType())])
        shapes = list(input_shapes) + ([None] if masked else [])
        return predict_batch_udf(_with_error_capture(make_predict_fn, n_out, len(input_shapes), masked),
                                 return_type=rt, batch_size=batch_size, input_tensor_shapes=shapes)
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                             batch_size=batch_size, input_tensor_shapes=input_shapes)


def score(df: DataFrame, scorer, inputs: list[str], out: str = "scores",
          capture_errors: bool = False, failed_as_zeros: bool = False) -> DataFrame:
    """Add ``out`` (array<double>); with error capture also ``error`` and
    NULL scores for failed rows (NaN never leaks out). ``failed_as_zeros``
    gives failed rows all-zero scores instead (compatibility: a failure then
    looks like a healthy image, so keep ``error`` to tell them apart)."""
    res = scorer(*[F.col(c) for c in inputs])
    if not capture_errors:
        return df.withColumn(out, res)
    tmp = df.withColumn("_res", res)
    bad = (F.col("_res.error").isNotNull() | F.col("_res.scores").isNull()
           | F.exists(F.col("_res.scores"), lambda x: x.isNull() | F.isnan(x)))
    failed = (F.transform(F.col("_res.scores"), lambda _: F.lit(0.0)) if failed_as_zeros
              else F.lit(None).cast("array<double>"))
    return (tmp.withColumn(out, F.when(~bad, F.col("_res.scores")).otherwise(failed))
               .withColumn("error", F.col("_res.error")).drop("_res"))


def predictions_map(scores: Column, labels: list[str] | None = None) -> Column:
    """Scores in class order -> map<label, float> (the stored prediction type)."""
    labels = labels or LABELS
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(scores, lambda s: s.cast("float")))
