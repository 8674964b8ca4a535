"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from cohortbeam.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: the lineage ends
    in files every executor can read again, so lost executors cost a reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``stored`` step that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs deleted: Spark does that once the driver
    has collected the garbage that stands for them, which may be after 30 minutes."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hot_join(rows: DataFrame, small: DataFrame, on: list[str], size: str, share: int = 1000, total: int | None = None) -> DataFrame:
    """Left join on keys that may be hot in ``rows`` (a stored table).

    ``small`` has one row per key, and in ``size`` how many of the rows have that
    key. Keys with a ``share``-th of all counted rows or more are ``share`` at
    most: they are broadcast. No key of the shuffled rest is hot. ``size`` is not
    part of the result; key columns hold no nulls. ``total``: the sum of all
    sizes, if it is known.
    """
    if total is None:
        total = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_hot = F.col(size) * share >= total
    near = rows.join(F.broadcast(small.where(is_hot).withColumn("_met", F.lit(True))), on, "left")
    found = [c for c in small.columns if c not in on]
    rest = near.where("_met IS NULL").drop("_met", *found).join(small.where(~is_hot), on, "left")
    return near.where("_met").drop("_met").unionByName(rest).drop(size)


def running(df: DataFrame, key: str, order: list, xors: tuple = (), sums: tuple = (), name: str = "running") -> DataFrame:
    """df plus ``run_n``, the row's 1-based place in its key by ``order``, and
    ``run_<c>``, the running xor or sum of a long column to that place included.

    Rows are sorted by ranges of (key, order), so a key of any size is dealt over
    tasks; a task scans its rows once, and the key on a border between ranges
    gets what the ranges before hold (one row per range on the driver). ``key``
    and the columns summed hold no nulls.
    """
    spark = df.sparkSession
    made = ["run_n", *(f"run_{c}" for c in (*xors, *sums))]
    steps = [np.add, *[np.bitwise_xor] * len(xors), *[np.add] * len(sums)]
    back = [np.subtract, *[np.bitwise_xor] * len(xors), *[np.subtract] * len(sums)]

    def run(batches):
        part, last, head, carry = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            head = k[0] if head is None else head
            new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            columns = [np.ones(len(k), dtype=np.int64), *(
                b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*xors, *sums))]
            goes_on = (start == 0) & (not new[0])
            totals = []
            for i, x in enumerate(columns):
                all_of = steps[i].accumulate(x)
                x = back[i](all_of, np.concatenate([[0], all_of[:-1]])[start])
                totals.append(np.where(goes_on, steps[i](x, carry[i]), x) if carry else x)
            last, carry = k[-1], [x[-1] for x in totals]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *map(pa.array, totals), pa.array(np.full(len(k), part, dtype=np.int32)), pa.array(k == head)],
                names=[*b.schema.names, *made, "_part", "_head"])

    kind = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in made],
                       StructField("_part", IntegerType()), StructField("_head", BooleanType())])
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = stored(ranged.mapInArrow(run, kind), name)
    borders = rows.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, *made)).alias("last")).orderBy("_part").collect()
    add, at, carry = [], None, None
    for r in borders:  # one row per range
        own, joins = list(r.last[1:]), at is not None and r.first == at
        if joins:
            add.append((r._part, True, *carry))
        if joins and r.last[0] == r.first:
            own = [int(steps[i](np.int64(a), np.int64(b))) for i, (a, b) in enumerate(zip(carry, own))]
        at, carry = r.last[0], own
    if add:
        more = spark.createDataFrame(add, "_part int, _head boolean, " + ", ".join(f"_{c} long" for c in made))
        rows = rows.join(F.broadcast(more), ["_part", "_head"], "left")  # one row per range at most
        for i, c in enumerate(made):
            added = F.coalesce(f"_{c}", F.lit(0))
            rows = rows.withColumn(c, F.col(c).bitwiseXOR(added) if 0 < i <= len(xors) else F.col(c) + added)
    return rows.select(*df.columns, *made)


def component_labels(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v; any order, repeats allowed).

    Alternating large-star / small-star rounds: each round points every node at
    the smallest id it knows, until nothing changes. Every round is written to
    the shared folder. A hub is only ever met by a map-side ``min`` and a
    ``hot_join``, never gathered into one task.

    Returns (node, root) for every node that has an edge; root is the smallest
    node id of its component.
    """
    cur = stored(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), name)
    before, n = None, cur.count()
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = (hot_join(both, low, ["u"], "n", total=2 * n).where("v > u")
                 .selectExpr("v AS u", "least(u, m) AS v").distinct())
        large = stored(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, ["u"], "n", total=large.count()).selectExpr("v AS u", "m AS v").where("u <> v")
        cur = stored(small.union(low.selectExpr("u", "m AS v")).distinct(), name)
        state = cur.selectExpr("count(*)", "bit_xor(xxhash64(u, v))").first()
        if tuple(state) == before:
            return cur.selectExpr("u AS node", "v AS root").union(cur.selectExpr("v", "v")).distinct()
        before, n = tuple(state), state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
