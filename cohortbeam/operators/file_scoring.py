"""Scoring of image files: read, decode, resize and predict in one Python task.

Files come as bytes in a column (uploads) or by the path in their own row. Rows
are dealt to tasks by what they cost, with equal paths side by side, so a file
is read and decoded once per task whatever the number of rows that name it.
Neither bytes nor pixels are ever shuffled, and only scores leave the task.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MSG_NO_SCORES, MSG_UNREADABLE
from ..session import ensure_checkpoint_dir
from ..sources.imagefile import ImageError, decode_image
from .images import OUT_ROWS, resize_bilinear, scale_pixels
from .resample import resize_lanczos

NO_FILE = MSG_UNREADABLE.format("no such file")


def tensor(rgb: np.ndarray, size: tuple[int, int], mode: str, resize: str) -> np.ndarray:
    """(h, w, 3) uint8 -> flat float32 of ``size``, scaled by ``mode``."""
    if resize == "lanczos":
        out = np.ascontiguousarray(resize_lanczos(rgb, *size)).astype(np.float32)
    elif resize == "bilinear":
        out = resize_bilinear(rgb.astype(np.float32), *size)
    else:
        raise ValueError(f"unknown resize {resize}")
    return scale_pixels(out, mode).astype(np.float32, copy=False).reshape(-1)


def model_batches(tensors: list[np.ndarray], batch_size: int) -> Iterable[tuple[int, int, np.ndarray]]:
    """(first, end, batch) of at most ``batch_size`` tensors in order. A run of one
    tensor (rows of one file) that fills a quarter of that or more is a read-only
    view of it, not as many copies; shorter runs share a batch."""
    heads = [i for i, t in enumerate(tensors) if i == 0 or t is not tensors[i - 1]]
    start = 0
    for head, end in zip(heads + [len(tensors)], heads[1:] + [len(tensors)] * 2):
        run = end - head
        if 0 < run < max(batch_size / 4, 2):
            continue
        for b in range(start, head, batch_size):
            upto = min(b + batch_size, head)
            yield b, upto, np.stack(tensors[b:upto])
        for b in range(head, end, batch_size):
            upto = min(b + batch_size, end)
            yield b, upto, np.broadcast_to(tensors[head], (upto - b, *tensors[head].shape))
        start = end


def score_rows(df: DataFrame, inputs: list[str], load: Callable[[pa.RecordBatch], Iterable[np.ndarray | str]],
               make_predict_fn, n_out: int, size: tuple[int, int] = (256, 256), mode: str = "tanh",
               resize: str = "lanczos", batch_size: int = 32, meta: list[str] | None = None,
               keep: tuple[str, ...] = (), mask: str | None = None) -> DataFrame:
    """Columns ``keep``, ok, scores, error for every row of ``df``.

    ``load`` gives for the ``inputs`` of each row its RGB pixels, or the text of
    what is wrong with it (ok is then false). With ``meta`` the model gets a
    second input, the rows' metadata features. The model comes from
    ``make_predict_fn`` once per Python worker (PySpark's model cache); a failing
    batch is retried row by row, and a row whose scores are not finite is an error
    row. Rows whose ``mask`` column is not true are decoded, but never reach the
    model.
    """
    key = uuid.uuid4()
    meta = list(meta or [])

    def call(model, x, m):
        res = np.asarray(model(x, m) if meta else model(x), dtype=np.float64)
        if res.shape != (len(x), n_out):
            raise ValueError(f"model returned shape {res.shape}")
        return res

    def predicted(model, x, m) -> list:
        try:
            return list(call(model, x, m))
        except Exception:  # noqa: BLE001 - isolate the failing rows
            out = []
            for j in range(len(x)):
                try:
                    out.append(call(model, x[j:j + 1].copy(), m[j:j + 1])[0])
                except Exception as e:  # noqa: BLE001
                    out.append(f"{type(e).__name__}: {e}")
            return out

    def run(batches):
        from pyspark.ml.model_cache import ModelCache
        model = ModelCache.get(key)
        if model is None:
            model = make_predict_fn()
            ModelCache.add(key, model)
        last = (None, None)  # the same pixels again (one file, many rows) are not resized again
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                chunk = batch.slice(start, OUT_ROWS)
                n = chunk.num_rows
                features = np.zeros((n, 0))
                if meta:
                    features = np.column_stack([chunk.column(c).cast("double").to_numpy(zero_copy_only=False) for c in meta])
                wanted = [v is True or v == 1 for v in chunk.column(mask).to_pylist()] if mask else [True] * n
                oks, errors, rows, tensors = [], [], [], []
                for i, found in enumerate(load(chunk)):
                    oks.append(not isinstance(found, str))
                    errors.append(found if isinstance(found, str) else None)
                    if oks[i] and wanted[i]:
                        if last[0] is not found:
                            last = found, tensor(found, size, mode, resize)
                        rows.append(i)
                        tensors.append(last[1])
                scores: list = [None] * n
                for b, end, x in model_batches(tensors, batch_size):
                    at = rows[b:end]
                    for r, v in zip(at, predicted(model, x, features[at])):
                        if isinstance(v, str):
                            errors[r] = v
                        elif not np.isfinite(v).all():
                            errors[r] = MSG_NO_SCORES
                        else:
                            scores[r] = v.tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(chunk.column(c) for c in keep), pa.array(oks, pa.bool_()), pa.array(scores, pa.list_(pa.float64())),
                     pa.array(errors, pa.string())], names=[*keep, "ok", "scores", "error"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("ok", T.BooleanType()),
                           T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return df.select(*dict.fromkeys([*inputs, *meta, *keep, *([mask] if mask else [])])).mapInArrow(run, schema)


def _decoded_content(content: str):
    def load(chunk):
        for data in chunk.column(content).to_pylist():
            try:
                yield decode_image(data)
            except ImageError as e:
                yield str(e)
    return load


def prepare_content(rows: DataFrame, content: str = "content", size: tuple[int, int] = (256, 256), mode: str = "tanh",
                    resize: str = "lanczos", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, ok, pixels (flat float32 of ``size`` and three channels)
    and error for rows that hold the bytes of an image file. Row-local."""
    load = _decoded_content(content)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, OUT_ROWS):
                chunk = batch.slice(start, OUT_ROWS)
                found = list(load(chunk))
                bad = [f if isinstance(f, str) else None for f in found]
                pixels = [None if b else tensor(f, size, mode, resize) for f, b in zip(found, bad)]
                yield pa.RecordBatch.from_arrays(
                    [*(chunk.column(c) for c in keep), pa.array([b is None for b in bad], pa.bool_()),
                     pa.array(pixels, pa.list_(pa.float32())), pa.array(bad, pa.string())], names=[*keep, "ok", "pixels", "error"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("ok", T.BooleanType()),
                           T.StructField("pixels", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    return rows.select(*dict.fromkeys([content, *keep])).mapInArrow(run, schema)


def score_content(rows: DataFrame, make_predict_fn, n_out: int, content: str = "content", **options) -> DataFrame:
    """Rows that hold the bytes of an image file. No shuffle: a row is decoded
    and scored where it is read. Options: see ``score_rows``."""
    return score_rows(rows, [content], _decoded_content(content), make_predict_fn, n_out, **options)


# ------------------------------------------------------------ files by path
class FileReader:
    """Reads files of any file system pyarrow knows, by the paths Spark uses; a
    path without a scheme belongs to the cluster's default file system."""

    def __init__(self, default: str):
        self.default = default.rstrip("/")
        self.systems: dict = {}

    def __getstate__(self):
        return {"default": self.default, "systems": {}}

    def find(self, path: str):
        from pyarrow import fs as pafs
        m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?(/.*)$", path if ":" in path.split("/")[0] else self.default + path)
        if not m:
            raise FileNotFoundError(path)
        scheme = {"s3a": "s3", "s3n": "s3"}.get(m[1].lower(), m[1].lower())
        root = f"{scheme}:{m[2] or '//'}"
        if root not in self.systems:
            self.systems[root] = pafs.FileSystem.from_uri(root + "/") if scheme == "file" else pafs.FileSystem.from_uri(root)
        system, base = self.systems[root]
        return system, m[3] if scheme == "file" else f"{base.rstrip('/')}{m[3]}"

    def size(self, path: str | None) -> int | None:
        """Bytes of a file; None where there is none."""
        from pyarrow import fs as pafs
        try:
            system, name = self.find(path or "")
            info = system.get_file_info(name)
        except (FileNotFoundError, ValueError):
            return None
        return info.size if info.type == pafs.FileType.File else None

    def read(self, path: str) -> bytes:
        system, name = self.find(path)
        with system.open_input_stream(name) as f:
            return f.read()


def file_reader(spark: SparkSession) -> FileReader:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).toString()
    return FileReader("file:" if uri.startswith("file:") else uri)


def absolute(path: Column, root: str | None) -> Column:
    """A row's path, under ``root`` unless it is absolute itself."""
    if root is None:
        return path
    return F.when(path.rlike(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def dealt_by_size(rows: DataFrame, path: str, reader, task_bytes: int = 64 << 20, row_cost: int = 64 << 10) -> DataFrame:
    """rows, sorted by path and cut into tasks of about ``task_bytes``: each row
    costs ``row_cost`` (its resize and its share of the model) and each file its
    size once. A path that very many rows name spreads over several tasks.

    Sizes are asked for in tasks. The driver holds one number per task."""
    ensure_checkpoint_dir(rows.sparkSession)
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint().repartitionByRange(path, "_row")

    def weigh(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            upto = []
            for p in batch.column(path).to_pylist():
                total += row_cost + (0 if p == last else reader.size(p) or 0)
                upto.append(total)
                last = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64()), pa.array([part] * len(upto), pa.int32())],
                                             names=[*batch.schema.names, "_upto", "_part"])

    schema = T.StructType([*ranged.schema.fields, T.StructField("_upto", T.LongType()), T.StructField("_part", T.IntegerType())])
    sized = ranged.sortWithinPartitions(path, "_row").mapInArrow(weigh, schema).checkpoint()
    before, total = [], 0
    for r in sized.groupBy("_part").agg(F.max("_upto").alias("n")).orderBy("_part").collect():  # one row per task
        before.append((r._part, total))
        total += r.n
    if not before:
        return rows
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")  # one row per task
    task = F.floor((F.col("_before") + F.col("_upto") - 1) / task_bytes).cast("int")
    return (sized.join(F.broadcast(offsets), "_part").repartitionById(-(-total // task_bytes), task)
            .sortWithinPartitions(path, "_row").select(*rows.columns))


def score_paths(rows: DataFrame, make_predict_fn, n_out: int, path: str = "image_path", root: str | None = None,
                reader=None, task_bytes: int | None = None, **options) -> DataFrame:
    """Rows that name an image file: every row is scored on the file at its own
    path. A row without a file, or with an unreadable one, keeps its row and its
    message. ``reader`` (``size(path)``, ``read(path)``) may be given for file
    systems that pyarrow does not know."""
    spark = rows.sparkSession
    reader = reader or file_reader(spark)
    if task_bytes is None:  # no fewer tasks than cores, no more than 64 MB each
        task_bytes = 64 << 20
        cores = spark.sparkContext.defaultParallelism
        task_bytes = max(1 << 20, min(task_bytes, rows.count() * (64 << 10) // (2 * cores)))
    dealt = dealt_by_size(rows.withColumn("_path", absolute(F.col(path), root)), "_path", reader, task_bytes)

    def load(chunk):
        for p in chunk.column("_path").to_pylist():
            if p != state["path"] or p is None:
                state.update(path=p, found=_decoded(reader, p))
            yield state["found"]

    state = {"path": None, "found": NO_FILE}  # of the file before, in each worker's copy
    return score_rows(dealt, ["_path"], load, make_predict_fn, n_out, **options)


def _decoded(reader, path: str | None) -> np.ndarray | str:
    if not path:
        return NO_FILE
    try:
        return decode_image(reader.read(path))
    except FileNotFoundError:
        return NO_FILE
    except ImageError as e:
        return str(e)
    except OSError as e:  # a folder, or a file that can't be read
        return NO_FILE if reader.size(path) is None else MSG_UNREADABLE.format(type(e).__name__)
