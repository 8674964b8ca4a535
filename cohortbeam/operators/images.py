"""Image table: decode (Spark ``image`` source), channel fix, resize, scale.
Files named by the rows themselves, or held in a column: ``file_scoring``.

Spark decodes in the JVM and hands rows as (height, width, nChannels, mode,
BGR bytes). One ``mapInArrow`` step, batch by batch, reorders channels,
replicates gray to three channels, resizes with bilinear interpolation and
scales pixels. Undecodable files keep their row with ``ok = false``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.pngwrite import encode_png

IMAGE_OUT_SCHEMA = ("path string, height int, width int, channels int, ok boolean, "
                    "pixels array<float>")
MEAN_SCHEMA = ", mean double"


def resize_bilinear(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Half-pixel-centre bilinear resize of an (h, w, c) float array."""
    h, w = img.shape[:2]
    ys = np.clip((np.arange(out_h) + 0.5) * h / out_h - 0.5, 0, h - 1)
    xs = np.clip((np.arange(out_w) + 0.5) * w / out_w - 0.5, 0, w - 1)
    y0 = np.floor(ys).astype(int)
    x0 = np.floor(xs).astype(int)
    y1 = np.minimum(y0 + 1, h - 1)
    x1 = np.minimum(x0 + 1, w - 1)
    wy = (ys - y0)[:, None, None]
    wx = (xs - x0)[None, :, None]

    def across(rows):
        return rows[:, x0] * (1 - wx) + rows[:, x1] * wx

    if h <= out_h:  # each row is stretched once, however many rows of the result it goes into
        rows = across(img)
        top, bot = rows[y0], rows[y1]
    else:
        top, bot = across(img[y0]), across(img[y1])
    return top * (1 - wy) + bot * wy


def scale_pixels(x: np.ndarray, mode: str) -> np.ndarray:
    if mode == "tanh":        # x / 127.5 - 1
        return x / 127.5 - 1.0
    if mode == "unit":        # x / 255
        return x / 255.0
    if mode == "imagenet":  # x / 255, then per-channel standardisation (last axis = RGB)
        from ..constants import IMAGENET_MEAN, IMAGENET_STD
        return (x / 255.0 - np.asarray(IMAGENET_MEAN, dtype=np.float32)) / np.asarray(IMAGENET_STD, dtype=np.float32)
    if mode == "none":
        return x
    raise ValueError(f"unknown scaling mode {mode}")


# Rows per output batch: a 256x256x3 float image is ~786 KB, so output
# batches stay around 50 MB whatever the Arrow input batch size is.
OUT_ROWS = 64


def _prep_slice(chunk: pa.RecordBatch, out_h: int, out_w: int, mode: str, mean: bool) -> pa.RecordBatch:
    paths, oks, pixels, means = [], [], [], []
    for img in chunk.column("image").to_pylist():
        rgb = _decode_rgb(img) if img is not None else None
        paths.append(img["origin"] if img is not None else None)
        oks.append(rgb is not None)
        if rgb is not None:
            r = scale_pixels(resize_bilinear(rgb.astype(np.float32), out_h, out_w), mode)
            pixels.append(r.astype(np.float32).reshape(-1))
        means.append(float(pixels[-1].mean(dtype=np.float64)) if mean and rgb is not None else None)
    n = len(paths)
    ok = np.array(oks, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(np.where(ok, out_h * out_w * 3, 0))]).astype(np.int32)
    values = np.concatenate(pixels) if pixels else np.zeros(0, dtype=np.float32)
    # one flat buffer: a list of arrays would be turned into Python numbers one by one
    offsets = pa.array(ends, mask=np.concatenate([~ok, [False]]))
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), *(pa.array(np.full(n, v, dtype=np.int32)) for v in (out_h, out_w, 3)),
         pa.array(ok), pa.ListArray.from_arrays(offsets, pa.array(values)), *([pa.array(means, pa.float64())] if mean else [])],
        names=["path", "height", "width", "channels", "ok", "pixels", *(["mean"] if mean else [])])


def _prep_fn(size: tuple[int, int], mode: str, mean: bool):
    out_h, out_w = size

    def prep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                yield _prep_slice(batch.slice(start, OUT_ROWS), out_h, out_w, mode, mean)
    return prep


def prepare_images(images: DataFrame, size: tuple[int, int] = (256, 256), mode: str = "tanh", mean: bool = False) -> DataFrame:
    """Decoded image rows -> (path, height, width, channels, ok, pixels) and, on
    request, the mean of each row's pixels, taken in the task that made them."""
    return images.select("image").mapInArrow(_prep_fn(size, mode, mean), IMAGE_OUT_SCHEMA + MEAN_SCHEMA * mean)


def score_images(images: DataFrame, scorer, size: tuple[int, int] = (256, 256), mode: str = "tanh") -> DataFrame:
    """Decoded images -> prepared tensors -> Arrow-batched model scores.

    Undecodable images are kept with ``ok = false`` and never reach the
    model (the scorer's mask); tensors stay inside the tasks that decoded
    them -- nothing is shuffled.
    """
    from pyspark.sql import functions as F

    from .scoring import score
    t = prepare_images(images, size, mode)
    n = size[0] * size[1] * 3
    t = t.withColumns({"_px": F.when(F.col("ok"), F.col("pixels")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), n)),
                       "_mask": F.col("ok").cast("double")})
    return score(t, scorer, ["_px", "_mask"], capture_errors=True).drop("_px", "_mask", "pixels")


def score_images_fused(images: DataFrame, make_predict_fn, n_out: int, resize: str = "bilinear", keep: tuple[str, ...] = (),
                       **options) -> DataFrame:
    """Spark's image table: decode, prepare and score in one Python step.

    Same result as ``prepare_images`` followed by the batch scorer, but the
    float tensors (786 KB per 256x256x3 image) never go back to the JVM. Columns:
    path, ok, scores, error and ``keep``; options: see ``score_rows``.
    """
    from pyspark.sql import functions as F

    from .file_scoring import score_rows

    def load(chunk):
        for img in chunk.column("image").to_pylist():
            rgb = _decode_rgb(img) if img is not None else None
            yield "Could not read image" if rgb is None else rgb

    rows = images.withColumn("path", F.col("image.origin"))
    return score_rows(rows, ["image"], load, make_predict_fn, n_out, resize=resize, keep=("path", *keep), **options)


def _decode_rgb(img) -> np.ndarray | None:
    h, w, c = img["height"], img["width"], img["nChannels"]
    if h is None or h < 0 or img["data"] is None or len(img["data"]) == 0:
        return None
    a = np.frombuffer(img["data"], dtype=np.uint8).reshape(h, w, c)
    return np.repeat(a, 3, axis=2) if c == 1 else a[:, :, 2::-1]


def qualified(spark, path: str) -> str:
    """``path`` as a URI of the file system that Spark's readers would use."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file:///" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


def _png_writer(root: str, key: str, value: str, layout: str):
    def write(batches):
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(root)
        made = set()
        for pdf in batches:
            paths = []
            for k, vec in zip(pdf[key], pdf[value]):
                rel = layout.format(key=int(k), group=int(k) % 12 + 1, name=int(k) // 12)
                full = f"{base.rstrip('/')}/{rel}"
                parent = full.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                v = np.asarray(vec, dtype=np.float64)
                p = np.clip(np.round((v + 0.25) * 510.0), 0, 255).astype(np.uint8)
                if int(k) % 50 == 0:
                    data = b"not an image " + str(int(k)).encode()
                elif int(k) % 3 == 0:
                    data = encode_png(p.reshape(8, 8))
                else:
                    rgb = np.stack([p, 255 - p, (p.astype(int) * 7 % 256).astype(np.uint8)], axis=-1)
                    data = encode_png(rgb.reshape(8, 8, 3))
                with fs.open_output_stream(full) as f:
                    f.write(data)
                paths.append(full)
            yield pd.DataFrame({key: pdf[key], "path": paths})
    return write


def write_image_files(df: DataFrame, root: str, key: str = "vec_id", value: str = "embedding",
                      layout: str = "images_{group:03d}/images/{key:08d}.png") -> DataFrame:
    """Test data: materialize one 8x8 PNG per row (gray for key % 3 == 0, RGB otherwise,
    an unreadable file for key % 50 == 0) under ``root``; runs in the tasks
    (any ``pyarrow.fs`` URI; a path without scheme belongs to the cluster's
    default file system, as for Spark's own readers). Deterministic, so a
    retried task rewrites identical files. Returns (key, path)."""
    root = qualified(df.sparkSession, root)
    # however few files the table has; rows of one key stay together
    dealt = df.select(key, value).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
    return dealt.mapInPandas(_png_writer(root, key, value, layout), f"{key} long, path string")
