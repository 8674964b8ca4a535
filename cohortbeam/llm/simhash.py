"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Each text gets a 64-bit SimHash over its word shingles.
2. The 64 bits are grouped into four quarters of correlated bits (greedily, on
   the correlation matrix of all distinct fingerprints), and counts of every
   quarter value give the number of fingerprints within 0..3 bits of it.
3. A layout joins quarters into partitions. If thresholds T_i (-1 skips a
   partition) sum to max_bits - m + 1, two fingerprints within max_bits differ
   by at most T_i bits in some partition i. For every fingerprint a dynamic
   program picks the T that minimises the estimated candidates and probes; the
   layout with the least estimated total is used, so wide partitions replace
   narrow ones as the corpus grows.
4. Probes meet the index of partition values in a join, and every candidate is
   verified on all bits. Equal fingerprints were collapsed before that.
5. Connected components give each document its group.

Nothing is capped. Broadcast values have fixed sizes: a 64-entry permutation
and 4 x 4 x 65,536 counts.

Texts without a word, and null texts, have fingerprint zero, linked like any
other. Null ids take part, and get the smallest id of their group (null if it
has none). Repeated rows stay. An empty table gives an empty result.
"""
from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import component_labels, stored

QUARTER, VALUES = 16, 1 << 16
#: Partitions as groups of quarters, and the quarters' places in them.
LAYOUTS = {"4x16": ((0,), (1,), (2,), (3,)), "32+2x16": ((0, 1), (2,), (3,)), "2x32": ((0, 1), (2, 3))}
CHUNK = 1 << 17  # shingles whose bits are counted at once


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned integer (reference form, no batching)."""
    return int(_batch_fingerprints([text], shingle)[0])


def _hashes(text: str | None, shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest
    # bytes.lower() touches A-Z only, bytes.split() cuts at \x20 and \x09-\x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), 42)]
    return [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]


def _batch_fingerprints(texts, shingle: int) -> np.ndarray:
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    pend: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []
    held = 0

    def count():
        bits = np.unpackbits(np.concatenate(pend).astype(">u8").view(np.uint8)).reshape(-1, 64)
        at = 0
        for row, n in owner:
            ones[row] += bits[at:at + n].sum(axis=0, dtype=np.int64)
            at += n

    for row, text in enumerate(texts):
        hashes = np.array(_hashes(text, shingle), dtype=np.uint64)
        sizes[row] = len(hashes)
        for i in range(0, len(hashes), CHUNK):
            part = hashes[i:i + CHUNK]
            pend.append(part)
            owner.append((row, len(part)))
            held += len(part)
            if held >= CHUNK:
                count()
                pend, owner, held = [], [], 0
    if held:
        count()
    set_bits = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(key, doc_id, fp): one row per document; fp holds the 64 bits as a long,
    key is a hash of id and text."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b.key, "doc_id": b.doc_id.astype("Int64"),
                                "fp": _batch_fingerprints(b.text.tolist(), shingle).view(np.int64)})

    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"),
                       F.col("text").cast("string")).mapInPandas(run, "key long, doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) 0/1, most significant bit first."""
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)


def group_bits(fps: DataFrame) -> np.ndarray:
    """A permutation of the 64 bits: consecutive sixteens are correlated bits."""
    def moments(batches):
        total = np.zeros((65, 65), dtype=np.int64)
        for b in batches:
            for i in range(0, len(b), 1 << 16):
                x = _bits(b.fp.to_numpy()[i:i + (1 << 16)]).astype(np.float64)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += (x.T @ x).astype(np.int64)
        yield pd.DataFrame({"cell": np.arange(65 * 65), "v": total.ravel()})

    cells = (fps.select("fp").mapInPandas(moments, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v"))
             .collect())  # 65 x 65 numbers
    total = np.zeros(65 * 65)
    for r in cells:
        total[r.cell] = r.v
    total = total.reshape(65, 65)
    n = max(total[64, 64], 1)
    mean = total[:64, 64] / n
    cov = total[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, order = list(range(64)), []
    while free:
        sub = corr[np.ix_(free, free)]
        group = [free[int(sub.max(axis=1).argmax())]]
        free.remove(group[0])
        while len(group) < QUARTER:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        order += sorted(group)
    return np.array(order)


def _permute(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(_bits(values)[:, order]), axis=1).view(">u8").ravel().astype(np.uint64)


def _quarters(values: np.ndarray) -> np.ndarray:
    """(n, 4) quarter values, quarter 0 in the highest bits."""
    return np.stack([(values >> np.uint64(48 - 16 * j)) & np.uint64(0xFFFF) for j in range(4)], axis=1).astype(np.int64)


def shell_counts(quarter_values: DataFrame, max_bits: int) -> np.ndarray:
    """[quarter, r, v]: fingerprints whose quarter differs from v in r bits.
    At most 4 x 65,536 counts reach the driver, whatever the corpus."""
    shells = np.zeros((4, max_bits + 1, VALUES), dtype=np.float64)
    counts = quarter_values.groupBy("part", "key").agg(F.count("*").alias("n")).toPandas()
    for j in range(4):
        mine = counts[counts.part == j]
        shells[j, 0, mine.key.to_numpy()] = mine.n.to_numpy()
        v = np.arange(VALUES)
        for b in range(QUARTER):
            flipped = shells[j][:, v ^ (1 << b)]
            shells[j, 1:] += flipped[:-1]
    return shells.astype(np.float32)


def _balls(width: int, max_bits: int) -> list[np.ndarray]:
    """Masks of ``width`` bits with at most t set bits, t = 0..max_bits."""
    out = [np.zeros(1, dtype=np.uint64)]
    last = out[0]
    for _ in range(max_bits):
        grown = (last[:, None] ^ (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).ravel()
        last = np.setdiff1d(np.unique(grown), out[-1])
        out.append(np.concatenate([out[-1], last]))
    return out


def allocate(quarters: np.ndarray, shells: np.ndarray, layout, max_bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint the thresholds (rows, partitions) and their estimated
    cost: candidates within T_i plus probes, minimised by dynamic programming
    over partitions and spent units, where T_i + 1 units are spent on i."""
    units = max_bits + 1  # sum of (T_i + 1) = max_bits - m + 1 + m
    rows, m = len(quarters), len(layout)
    cost = np.zeros((rows, m, units + 1))
    for i, part in enumerate(layout):
        ball = np.cumsum([comb(QUARTER * len(part), r) for r in range(max_bits + 1)])
        near = np.zeros((rows, max_bits + 1))
        for t in range(max_bits + 1):
            if len(part) == 1:
                near[:, t] = shells[part[0], t, quarters[:, part[0]]]
            else:  # two quarters, taken as independent
                a, b = part
                near[:, t] = sum(shells[a, r, quarters[:, a]].astype(float) * shells[b, t - r, quarters[:, b]]
                                 for r in range(t + 1)) / max(n, 1)
        cost[:, i, 1:] = np.cumsum(near, axis=1) + 2.0 * ball
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, rows, units + 1), dtype=np.int64)
    for i in range(m):
        options = np.full((units + 1, rows, units + 1), np.inf)
        for u in range(units + 1):
            options[u, :, u:] = best[:, :units + 1 - u] + cost[:, i, u][:, None]
        took[i] = options.argmin(axis=0)
        best = options.min(axis=0)
    left, each = np.full(rows, units), np.zeros((rows, m), dtype=np.int64)
    for i in reversed(range(m)):
        each[:, i] = took[i][np.arange(rows), left] - 1
        left -= each[:, i] + 1
    return each, best[:, units]


def _part_key(quarters: np.ndarray, part) -> np.ndarray:
    key = np.zeros(len(quarters), dtype=np.int64)
    for q in part:
        key = (key << QUARTER) | quarters[:, q]
    return key


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v): every pair of different fingerprints of ``fps`` (column fp,
    distinct) that differ in at most ``max_bits`` bits, once or more."""
    order = group_bits(fps)

    def permuted(batches):
        for b in batches:
            yield pd.DataFrame({"fp": b.fp, "p": _permute(b.fp.to_numpy(), order).view(np.int64)})

    rows = stored(fps.select("fp").mapInPandas(permuted, "fp long, p long"), "simhash-rows")
    quarter = "(shiftrightunsigned(p, {0}) & 65535)"
    by_quarter = rows.selectExpr("stack(4, " + ", ".join(f"{j}, {quarter.format(48 - 16 * j)}" for j in range(4))
                                 + ") AS (part, key)")
    shells, n = shell_counts(by_quarter, max_bits), rows.count()
    spark = fps.sparkSession
    given = spark.sparkContext.broadcast(shells)  # 4 x 4 x 65,536 floats

    def estimate(batches):
        total = dict.fromkeys(LAYOUTS, 0.0)
        for b in batches:
            q = _quarters(b.p.to_numpy().view(np.uint64))
            for name, layout in LAYOUTS.items():
                total[name] += float(allocate(q, given.value, layout, max_bits, n)[1].sum())
        yield pd.DataFrame({"layout": list(total), "cost": list(total.values())})

    costs = rows.select("p").mapInPandas(estimate, "layout string, cost double").groupBy("layout").agg(
        F.sum("cost").alias("cost")).collect()
    layout = LAYOUTS[min(((r.cost, r.layout) for r in costs), default=(0, "4x16"))[1]]

    def probes(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                fp, q = b.fp.to_numpy()[i:i + 4096], _quarters(b.p.to_numpy()[i:i + 4096].view(np.uint64))
                each, _ = allocate(q, given.value, layout, max_bits, n)
                for k, part in enumerate(layout):
                    ball, key = _balls(QUARTER * len(part), max_bits), _part_key(q, part)
                    for t in range(max_bits + 1):
                        at = np.flatnonzero(each[:, k] == t)
                        if len(at):
                            masks = ball[t].astype(np.int64)
                            yield pd.DataFrame({"part": k, "key": (key[at][:, None] ^ masks[None, :]).ravel(),
                                                "q": np.repeat(fp[at], len(masks))})

    def index(batches):
        for b in batches:
            q = _quarters(b.p.to_numpy().view(np.uint64))
            for k, part in enumerate(layout):
                yield pd.DataFrame({"part": k, "key": _part_key(q, part), "x": b.fp})

    asked = rows.mapInPandas(probes, "part int, key long, q long")
    entries = rows.mapInPandas(index, "part int, key long, x long")
    # A pair is found from either side; one is enough.
    near = (F.col("x") > F.col("q")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= max_bits)
    found = asked.join(entries, ["part", "key"]).where(near)
    return stored(found.selectExpr("q AS u", "x AS v").distinct(), "simhash-links")


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(key, doc_id, fp, root, component_id): root is the fingerprint that names
    the group, component_id the smallest doc_id in it."""
    rows = stored(fingerprints(docs, shingle), "simhash-fps")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = component_labels(links(distinct, max_bits), "simhash-components")
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 lowercase hex
    digits, component_id the smallest doc_id reachable over links."""
    return grouped(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """docs without near-duplicates: the smallest id of each group stays (rows
    without an id come last, equal rows count as one). A row is known by its id
    and a hash of id and text."""
    best = grouped(docs, shingle, max_bits).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    kept = stored(best.select(F.col("best.key").alias(KEY), F.col("best.doc_id").alias(KEY_ID)), "simhash-kept")
    # one shuffle by the hash serves the join and the removal of equal rows
    found = docs.withColumn(KEY, F.xxhash64("doc_id", "text")).join(kept, KEY)
    found = found.where(F.col(KEY_ID).eqNullSafe(F.col("doc_id").cast("long")))
    return found.dropDuplicates([KEY, KEY_ID]).select(*[f"`{c}`" for c in docs.columns])


KEY, KEY_ID = "_simhash_key", "_simhash_id"  # no columns of a result
