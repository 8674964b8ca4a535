"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

A turn has a 128-bit digest of its place and content, and a sequence the xor of
its turns' digests, so prefixes of any length come from running xors without a
chain through the conversation. Turns are dealt into blocks of ``block`` turns,
and conversations are grouped by successive block digests first: after equal
conversations have become one weighted sequence, sequences with the same prefix
before a block and the same block form one class. A class without a sibling (no
other block follows that prefix) is a plain path, its turns are nodes as they
stand. Only where siblings diverge are turn boundaries refined: the classes, not
the conversations, are grouped again turn by turn.

Sums over subtrees need no walk through the tree. A node belongs to its smallest
member; a conversation's nodes are then the tail of its path, so each
conversation adds its own tail's characters and its leaf once to every node it
passes, which is another sum over classes.

Every grouping is pre-aggregated, a sequence of any length is dealt over tasks,
and hot keys of joins are broadcast while the shuffled rest has none, so neither
a common first turn, a group of copies nor a very long conversation gathers in
one task.

Null roles and texts are empty, null turns come first, ties on a turn go by the
digest of role and text, repeated rows are turns of their own; rows without a
conv_id take no part. Without conversations there are no nodes. Extra columns
are ignored.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, hot_join, running, stored

PART = 4096  # places of one conversation that meet its own row in one task
CHUNK = 500  # ids of one list that are joined to text at once
NODE = ["depth", "p1", "p2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, d1, d2, chars): turns numbered from 1, with 120 digest bits
    of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("md5"),
        F.length(text).cast("long").alias("chars"))
    rows = rows.select("conv_id", "turn", "chars", *[
        F.conv(F.substring("md5", at, 15), 16, 10).cast("long").alias(d) for d, at in (("d1", 1), ("d2", 17))])
    return running(rows, "conv_id", ["turn", "d1", "d2"], name="trie-turns").select(
        "conv_id", F.col("run_n").alias("n"), "d1", "d2", "chars")


def _with_own(rows: DataFrame, place: str, own: DataFrame, length: str, how: str) -> DataFrame:
    """rows join their conversation's row in ``own``; ``length`` bounds
    ``place``, and long conversations meet in parts of PART places."""
    parts = own.withColumn("_part", F.explode(F.expr(f"sequence(0L, greatest({length}, 0L) div {PART})")))
    return rows.withColumn("_part", F.expr(f"{place} div {PART}")).join(parts, ["conv_id", "_part"], how).drop("_part")


def with_shared_heads(turns: DataFrame, family: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % family,
    then c's own turns after its first h, with h = crc32(c) % kinds.

    Returns the turns, and one row (conv_id) for every conversation, even if
    it has lost all turns."""
    own = stored(turns.groupBy("conv_id").agg(F.max("n").alias("n_own")), "trie-own").withColumns({
        "h": F.crc32(F.col("conv_id").cast("string")) % kinds, "base": F.expr(f"conv_id - conv_id % {family}")})
    bases = own.where(f"conv_id % {family} = 0").selectExpr("conv_id AS base", "n_own AS n_base")
    own = stored(own.join(bases, "base", "left").withColumn(
        "shift", F.expr("h - least(h, coalesce(n_base, 0L))")).drop("n_base"), "trie-heads")
    heads = turns.where(f"conv_id % {family} = 0 AND n < {kinds}").withColumnRenamed("conv_id", "base")
    # a base has kinds - 1 such turns and family conversations at most
    heads = own.where("h > 0").select("conv_id", "base", "h").join(heads, "base").where("n <= h").select(*turns.columns)
    tails = turns.where(F.col("n") > F.crc32(F.col("conv_id").cast("string")) % kinds)
    moved = own.where("shift > 0").select("conv_id", "shift", "n_own")
    tails = _with_own(tails, "n", moved, "n_own", "left").withColumn("n", F.expr("n - coalesce(shift, 0L)")).select(*turns.columns)
    return heads.unionByName(tails), own.select("conv_id")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Blocks (conv_id, blk, m, s1, s2, e1, e2, before, chars, turns): m turns,
    digests of the prefix before and after the block, characters before it."""
    rows = turns.selectExpr("conv_id", f"(n - 1) div {block} AS blk", "n", "chars", "xxhash64(n, d1, d2) AS t1",
                            "xxhash64(d2, n, d1) AS t2")
    rows = rows.groupBy("conv_id", "blk").agg(
        F.count("*").alias("m"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list(F.struct("n", "t1", "t2", "chars"))).alias("turns"))
    rows = running(rows, "conv_id", ["blk"], ("x1", "x2"), ("chars",), name="trie-blocks")
    return rows.selectExpr("conv_id", "blk", "m", "run_x1 ^ x1 AS s1", "run_x2 ^ x2 AS s2", "run_x1 AS e1", "run_x2 AS e2",
                           "run_chars - chars AS before", "chars", "x1", "x2", "turns")


def _by_turn(classes: DataFrame, carry: list[str]) -> DataFrame:
    """One row per turn of each class: depth, digests of the prefix with the
    turn (p1, p2) and without (q1, q2), its characters, and those before it."""
    upto = "slice(turns, 1, i + 1)"
    rows = classes.selectExpr(*carry, "s1", "s2", "before", "turns", "posexplode(turns) AS (i, t)")
    rows = rows.selectExpr(*carry, "t.n AS depth", "t.chars AS chars", "t.t1 AS t1", "t.t2 AS t2",
                           f"aggregate({upto}, s1, (a, x) -> a ^ x.t1) AS p1",
                           f"aggregate({upto}, s2, (a, x) -> a ^ x.t2) AS p2",
                           f"aggregate({upto}, before, (a, x) -> a + x.chars) - t.chars AS before")
    return rows.selectExpr(*carry, "depth", "p1", "p2", "p1 ^ t1 AS q1", "p2 ^ t2 AS q2", "chars", "before")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie over ``turns`` (conv_id, n, d1, d2, chars; n
    from 1 without gaps); ``conversations`` (conv_id) names those without turns
    too.

    nodes: depth, p1, p2 (the prefix's digest), conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, chars (of its last text),
    saved_tokens. ends: depth, p1, p2, conv_id for every conversation."""
    blocks = _blocks(turns, block)
    whole = blocks.groupBy("conv_id").agg(F.sum("m").alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"),
                                          F.sum("chars").alias("total"))
    ends = stored(conversations.join(whole, "conv_id", "left").na.fill(0), "trie-ends")
    sequences = stored(ends.groupBy(*NODE, "total").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")),
                       "trie-sequences")

    own = sequences.selectExpr("conv_id", "total", "weight", f"depth div {block} AS n_blocks")
    rows = _with_own(blocks.drop("chars", "x1", "x2"), "blk", own, "n_blocks", "inner")
    rows = stored(rows.drop("n_blocks"), "trie-rows")
    key = ["blk", "s1", "s2", "e1", "e2", "m"]
    classes = stored(rows.groupBy(*key).agg(
        F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("total")).alias("weighted"),
        F.min(F.struct("conv_id", "before", "turns")).alias("rep")).select(
        *key, "n_convs", "weighted", "rep.*"), "trie-classes")
    siblings = stored(classes.groupBy("blk", "s1", "s2").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
                      .withColumn("diverges", F.lit(True)), "trie-siblings")
    spent = [blocks, rows, classes, siblings]
    classes = stored(hot_join(classes, siblings, ["blk", "s1", "s2"], "n_classes"), "trie-diverging")

    # nodes: paths as they stand, diverging blocks turn by turn
    carry = ["conv_id", "n_convs", "weighted"]
    path = _by_turn(classes.where("diverges IS NULL"), carry)
    split = _by_turn(classes.where("diverges"), carry).groupBy(*NODE, "q1", "q2", "chars", "before").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("weighted").alias("weighted"))
    root = sequences.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
                         F.sum(F.col("weight") * F.col("total")).alias("weighted")).where("n_convs > 0")
    nothing = {c: F.lit(0).cast("long") for c in (*NODE, "q1", "q2", "chars", "before")}
    nodes = stored(path.unionByName(split).unionByName(root.withColumns(nothing)), "trie-nodes")
    spent += [classes, nodes]
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias(
        "p2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(below, NODE, "left").na.fill(0, ["n_children"]), "trie-children")

    # what each conversation owns: the tail of its path from the first node it is the smallest member of
    tails = nodes.groupBy("conv_id").agg(F.min("before").alias("owns_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    tails = sequences.join(tails, "conv_id", "left").selectExpr(
        "conv_id", "owns_from", "coalesce(total - owns_from, 0L) AS owned", "coalesce(leaf, 0L) AS leaf", f"depth div {block} AS n_blocks")
    tails = stored(tails, "trie-tails")
    passed = _with_own(rows.select("conv_id", *key), "blk", tails, "n_blocks", "inner").groupBy(*key).agg(
        F.sum("owned").alias("owned"), F.min("owns_from").alias("owns_from"), F.sum("leaf").alias("leaf"))
    met = stored(classes.drop("conv_id", "n_convs", "weighted").join(passed, key), "trie-passed")
    # of the class's owner, characters before the node are none of the node's
    given = F.expr("owned - coalesce(greatest(0L, before - owns_from), 0L)")
    carry = ["owned", "owns_from", "leaf"]
    path = _by_turn(met.where("diverges IS NULL"), carry).select(*NODE, given.alias("distinct_chars"), F.col("leaf").alias("n_leaves"))
    split = _by_turn(met.where("diverges"), carry).groupBy(*NODE).agg(
        F.sum(given).alias("distinct_chars"), F.sum("leaf").alias("n_leaves"))
    root = tails.agg(F.sum("owned").alias("distinct_chars"), F.sum("leaf").alias("n_leaves")).where("n_leaves > 0").withColumns(
        {c: F.lit(0).cast("long") for c in NODE})
    spent += [nodes, tails, met, sequences]
    nodes = stored(nodes.join(path.unionByName(split).unionByName(root), NODE), "trie-sums")
    for step in spent:
        drop_stored(step)
    nodes = nodes.withColumn("saved_tokens", F.expr("weighted - n_convs * before - distinct_chars"))

    parents = nodes.where("n_children > 0").selectExpr("depth + 1 AS depth", "p1 AS q1", "p2 AS q2", "conv_id AS parent_conv_id",
                                                       "n_children AS n_siblings")
    nodes = hot_join(nodes, parents, ["depth", "q1", "q2"], "n_siblings").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return nodes.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "chars", "saved_tokens"), ends


def list_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, sha256): of each node's ascending ids in decimal,
    comma-joined. A list of any length is sorted and joined to text in ranges
    and hashed as a stream of those texts."""
    ends = ends.select(*NODE, "conv_id")
    groups = stored(ends.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("one")), "trie-lists")
    alone = groups.where("n = 1").select(*NODE, F.sha2(F.col("one").cast("string"), 256).alias("sha256"))
    many = groups.where("n > 1").select(*NODE, "n").withColumn("long_list", F.lit(True))
    rows = hot_join(ends, many, NODE, "n").where("long_list").drop("long_list")

    def texts(batches):
        for b in batches:
            for (depth, p1, p2), ids in b.groupby(NODE, sort=False)["conv_id"]:
                ids = ids.tolist()
                for at in range(0, len(ids), CHUNK):
                    part = ids[at:at + CHUNK]
                    yield pd.DataFrame([(depth, p1, p2, part[0], ",".join(map(str, part)))], columns=[*NODE, "first", "ids"])

    def digests(batches):
        key, state = None, None
        for b in batches:
            out = []
            for depth, p1, p2, _, ids in b.itertuples(index=False):
                if (depth, p1, p2) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, p1, p2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*NODE, "sha256"])

    place = "depth long, p1 long, p2 long"
    sorted_ids = rows.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    parts = stored(sorted_ids.mapInPandas(texts, f"{place}, first long, ids string"), "trie-texts")
    joined = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(digests, f"{place}, sha256 string")
    return alone.unionByName(joined)
