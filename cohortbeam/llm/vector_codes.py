"""Vector compression by product codes, with exact integer distances.

Vectors of whole numbers are cut into equal consecutive parts; each part
position has a codebook, and a part is coded by its nearest entry. The distance
|x|^2 - 2 x.c + |c|^2 needs the inner products of all parts with all entries:
matrix products. They run in float64 BLAS and stay exact, because the integers
are broken into limbs so short that no sum of limb products reaches 2^53; the
partial products are shifted and added in int64. The first least distance wins.

Spark deals the rows; a round is one scan in which every task adds up its rows
per entry, and one grouped sum. What reaches the driver is a codebook: parts x
entries x (width + 1) numbers, whatever the table. Sums are decimal there and
whole numbers on the driver, so the floor of a mean is exact.

Rows without a vector, and vectors that hold a null, a NaN or an infinite
component, take no part; nor do vectors whose scaled components reach
2^((61 - log2(length)) / 2) (2^27 for 64), where a squared distance may leave 64
bits. All coded vectors have one length: that of the first kept row (by vec_id,
then vector) whose length the parts divide; others take no part. Rows without an
id are coded, but never start a codebook. Repeated rows count as often as they
stand. With fewer rows than entries the codebooks are shorter. An empty table
gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, stored

ROWS = 2048  # rows whose distances are held at once
HOT_SHARE = 1000  # labels with more than 1 / HOT_SHARE of the rows are broadcast: HOT_SHARE at most


def integer_vectors(df: DataFrame, scale: int, label: str = "label") -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component, valid rows only."""
    limit = "pow(2D, floor((61 - log2(greatest(size(embedding), 1))) / 2))"
    return df.where("embedding IS NOT NULL AND size(embedding) > 0").where(
        f"forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) * {scale} < {limit})").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.expr(f"transform(embedding, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS INT))").alias("v"))


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of ``bits`` bits, lowest first; the highest carries the sign."""
    out, rest = [], x
    while len(rest) and (rest.max(initial=0) >= 1 << bits or rest.min(initial=0) < -(1 << bits)):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 stacks (parts, rows, width) and (parts, width, entries)."""
    width = a.shape[-1]
    bits = (53 - math.ceil(math.log2(max(width, 1)))) // 2  # width products of two limbs stay below 2^53
    total = np.zeros((*a.shape[:-1], b.shape[-1]), dtype=np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += np.matmul(x, y).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and its squared distance; ``parts``:
    (parts, rows, width), ``books``: (parts, entries, width)."""
    size = (books * books).sum(axis=2)
    code = np.empty(parts.shape[:2], dtype=np.int64)
    error = np.empty(parts.shape[:2], dtype=np.int64)
    turned = np.ascontiguousarray(books.transpose(0, 2, 1))
    for lo in range(0, parts.shape[1], ROWS):
        x = parts[:, lo:lo + ROWS]
        d = size[:, None, :] - 2 * exact_products(x, turned)
        best = d.argmin(axis=2)
        code[:, lo:lo + ROWS] = best
        error[:, lo:lo + ROWS] = np.take_along_axis(d, best[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)
    return code, error


def _parts(column, n_parts: int) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.int64)
    return np.ascontiguousarray(x.reshape(len(x), n_parts, -1).transpose(1, 0, 2))


def first_books(vectors: DataFrame, n_parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width) from the ``entries`` smallest ids."""
    named = vectors.where("vec_id IS NOT NULL")
    first = named.where(f"size(v) % {n_parts} = 0").orderBy("vec_id", "v").limit(1).collect()
    if not first:
        return None
    dim = len(first[0].v)
    rows = named.where(f"size(v) = {dim}").orderBy("vec_id", "v").limit(entries).select("v").toPandas()
    return _parts(rows.v, n_parts)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; an entry
    without parts stays."""
    n_parts, entries, width = books.shape

    def add(batches):
        count = np.zeros(n_parts * entries, dtype=np.int64)
        total = np.zeros((n_parts * entries, width), dtype=np.int64)
        for b in batches:
            if len(b):
                x = _parts(b.v, n_parts)
                code, _ = nearest(x, books)
                slot = (code + np.arange(n_parts)[:, None] * entries).ravel()
                count += np.bincount(slot, minlength=len(count))
                for j in range(width):  # at most 10,000 rows a batch: far below 2^53
                    total[:, j] += np.bincount(slot, weights=x[:, :, j].ravel(), minlength=len(count)).astype(np.int64)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"slot": np.repeat(used, width + 1), "pos": np.tile(np.arange(width + 1), len(used)),
                            "n": np.hstack([total[used], count[used, None]]).ravel()})

    sums = vectors.select("v").mapInPandas(add, "slot int, pos int, n long").groupBy("slot", "pos").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    found: dict[int, list[int]] = {}
    for r in sums:
        found.setdefault(r.slot, [0] * (width + 1))[r.pos] = int(r.n)
    out = books.copy()
    for slot, (*total, count) in found.items():
        out[slot // entries, slot % entries] = [t // count for t in total]
    return out


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) with the codebooks given."""
    n_parts = len(books)

    def run(batches):
        for b in batches:
            if len(b):
                code, error = nearest(_parts(b.v, n_parts), books)
                rows = np.ascontiguousarray(code.T.astype(np.uint8))
                yield b.drop(columns="v").assign(vec_id=b.vec_id.astype("Int64"), code=[r.tobytes().hex() for r in rows],
                                                 error=error.sum(axis=0))

    kind = vectors.schema["label"].dataType.simpleString()
    # labels pass as text, so that no type loses its nulls or precision in pandas
    return vectors.withColumn("label", F.col("label").cast("string")).mapInPandas(
        run, "vec_id long, label string, code string, error long").withColumn("label", F.col("label").cast(kind))


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows plus the sum of ``error`` over the rows of an equal label (nulls
    together). Labels that hold a large share are few and are broadcast; no
    label of the shuffled rest is hot."""
    sums = stored(rows.groupBy("label").agg(F.count("*").alias("label_rows"), F.sum(F.col("error").cast(
        "decimal(38,0)")).cast("long").alias("label_error")), "codes-labels").withColumnRenamed("label", "same_label")
    total = rows.count()
    same = F.col("label").eqNullSafe(F.col("same_label"))
    hot = sums.where(F.col("label_rows") * HOT_SHARE >= total)
    near = rows.join(F.broadcast(hot), same, "left").drop("same_label")  # HOT_SHARE rows at most
    rest = near.where("label_rows IS NULL").drop("label_rows", "label_error").join(sums, same).drop("same_label")
    return near.where("label_rows IS NOT NULL").unionByName(rest).drop("label_rows")


def compress(df: DataFrame, n_parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all rows of ``df`` (vec_id, embedding, label), and the codebooks
    (parts, entries, width), which are None for an empty table. Columns: vec_id,
    label, code (two hex digits a part), error, label_error."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes one byte: 1 to 256 entries")
    vectors = stored(integer_vectors(df, scale, label), "codes-vectors")
    books = first_books(vectors, n_parts, entries)
    if books is None:
        return with_label_error(vectors.where("false").selectExpr("vec_id", "label", "'' AS code", "0L AS error")), None
    vectors = vectors.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = refined(vectors, books)
    rows = stored(coded(vectors, books), "codes-rows")
    drop_stored(vectors)
    return with_label_error(rows), books


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
