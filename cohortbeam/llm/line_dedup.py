"""Line dedup: a suffix array over lines by prefix doubling, later copies deleted.

All documents, in the order of their ids, form one sequence of lines with a
different end mark after each document. The rank of a suffix at depth 1 is the
number of suffixes whose first line is smaller (lines are ordered by 128-bit
fingerprints, end marks come before them). Suffixes with one rank are a class. A
doubling round joins the ranks at ``pos + depth`` to the members of the classes
that still have two or more, and their ranks grow by the members of the class
with a smaller one; rounds go on until no class has two members. Each round sorts
by ranges of both ranks and the place, so a class of any size is dealt over tasks.

The classes at depth ``min_lines`` are the LCP intervals of that depth or more (a
step that overlaps gives a depth that is no power of two). A suffix that is not
the first of its class begins a later copy; those that follow each other on one
diagonal (place - place of the first) join into ``runs`` (start, length, source).

The longest repeat of a suffix is its LCP with any suffix before it in the
sequence. Of the members of a class at depth 2^k all but the first of each class
at depth 2^(k+1) have met theirs or will meet it in a deeper class; for these
firsts it is found by halving: the ranks at half the depth split a class, the
firsts of its parts go on with the smaller depths and the members of each part
with the larger ones. Repeats that no longer one of the document holds are
``repeats`` (start, length, source), maximal repeated runs; their lines are
deleted. A run of fewer than min_lines lines is short stock as a rule and stays,
but a single line of ``long_words`` words or more is a passage: its later copies,
by the ranks at depth 1, go too, as runs of one line (which may lie inside a
longer run).

DataFrame and SQL functions only. Null texts stay null, with no lines; an empty
text is one empty line. Null ids come last in the sequence. Repeated rows are
documents of their own (the second one is a later copy). An empty table gives
an empty result. Extra columns are kept; the operator's own columns replace
columns of the same name.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import drop_stored, stored

BLANK = " \\\\t\\\\r\\\\f"  # between the words of a line, escaped for SQL
N_LINES = "CASE WHEN text IS NULL THEN 0L ELSE CAST(size(split(text, '\\n', -1)) AS BIGINT) END"
MARKS = 1 << 61  # an end mark's rank is its place less this: below those of all lines


def _lines(text: str, long_words: int) -> str:
    """array<struct<a, b, long>>: fingerprints of all lines, and which are long."""
    words = f"^[{BLANK}]*+([^{BLANK}]++[{BLANK}]++){{{long_words - 1}}}[^{BLANK}]"
    return (f"transform(split({text}, '\\n', -1), x -> named_struct('a', xxhash64(x), 'b', xxhash64('line', x), 'long', "
            f"length(x) >= {2 * long_words - 1} AND x RLIKE '{words}'))")


def _sequence_places(rows: DataFrame) -> DataFrame:
    """(row_key, base): lines and end marks before the document, by two-level
    prefix sums over ranges of (doc_id, row_key)."""
    ranged = stored(rows.select("row_key", "doc_id", "n_lines")
                    .repartitionByRange(F.col("doc_id").asc_nulls_last(), "row_key")
                    .withColumn("part", F.spark_partition_id()), "lines-ranges")
    inside = (Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "row_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    parts = ranged.groupBy("part").agg(F.sum(F.col("n_lines") + 1).alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_at"))
    return ranged.withColumn("in_part", F.coalesce(F.sum(F.col("n_lines") + 1).over(inside), F.lit(0))).join(
        parts, "part").select("row_key", F.expr("part_at + in_part").alias("base"))


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (pos, x, y and others) plus, by the class (x, y) of a row: ``start``,
    the rows before it in the order of x and y, ``x_start``, the same by x alone,
    ``source``, its smallest pos, and ``alone``, if it has no other row. And the
    stored step below, to be dropped by the caller.

    Rows are sorted by ranges of (x, y, pos); what a range needs of the ones
    before and after it is one row, broadcast."""
    ranged = rows.repartitionByRange("x", "y", "pos").withColumn("part", F.spark_partition_id())
    ranged = ranged.repartition("part").sortWithinPartitions("part", "x", "y", "pos")  # the one sort of all windows
    inside, same = Window.partitionBy("part"), Window.partitionBy("part", "x", "y").orderBy("pos")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = stored(ranged.select("*", (F.rank().over(inside.orderBy("x", "y")) - 1).alias("at"),
                                 (F.rank().over(inside.orderBy("x")) - 1).alias("x_at"),
                                 F.first("pos").over(whole).alias("first"), F.count("*").over(whole).alias("n")), "lines-ranked")
    order = Window.orderBy("part")  # one row per range partition
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ends = local.groupBy("part").agg(
        F.count("*").alias("rows"), F.min(F.struct("x", "y")).alias("head"), F.max(F.struct("x", "y")).alias("tail"),
        F.max(F.struct("x", "y", "at", "x_at", "first")).alias("last"))
    ends = ends.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
                       F.coalesce(F.lag("tail").over(order) == F.col("head"), F.lit(False)).alias("goes_on"),
                       F.coalesce(F.lag("tail.x").over(order) == F.col("head.x"), F.lit(False)).alias("x_goes_on"),
                       F.coalesce(F.lead("head").over(order) == F.col("tail"), F.lit(False)).alias("open"))
    opened = "CASE WHEN NOT ({0} AND head{1} = tail{1}) THEN {2} END"  # where the class of the last row began, if in this range
    ends = ends.select("*", *[F.last(F.expr(opened.format(goes_on, of, what)), True).over(upto).alias(name) for goes_on, of, what, name in (
        ("goes_on", "", "offset + last.at", "tail_start"), ("goes_on", "", "last.first", "tail_first"),
        ("x_goes_on", ".x", "offset + last.x_at", "tail_x_start"))])
    ends = ends.select("part", "head", "tail", "offset", "goes_on", "x_goes_on", "open", *[
        F.lag(c).over(order).alias(c) for c in ("tail_start", "tail_first", "tail_x_start")])
    met = local.join(F.broadcast(ends), "part")
    return met.select(
        *rows.columns,
        F.expr("IF(goes_on AND at = 0, tail_start, offset + at)").alias("start"),
        F.expr("IF(x_goes_on AND x_at = 0, tail_x_start, offset + x_at)").alias("x_start"),
        F.expr("IF(goes_on AND at = 0, tail_first, first)").alias("source"),
        F.expr("n = 1 AND NOT (goes_on AND at = 0) AND NOT (open AND x = tail.x AND y = tail.y)").alias("alone")), local


def _ahead(rows: DataFrame, ranks: DataFrame, step: str) -> DataFrame:
    """rows (pos, left and others) plus y: the rank at ``pos + step``, of a line or an end mark."""
    there = ranks.select(F.col("pos").alias("there"), F.col("rank").alias("y"))
    return rows.withColumn("there", F.expr(f"pos + {step}")).join(there, "there", "left").withColumn(
        "y", F.expr(f"IF(left = {step}, there - {MARKS}, y)")).drop("there")


def suffix_ranks(lines: DataFrame, min_lines: int, made: list) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    """Prefix doubling over ``lines`` (pos; left: lines to the end of the document;
    a, b, long). Returns, by k, the ranks (pos, left, rank) at depth 2^k in the
    documents that take part in a class of two members or more there, and of these
    members the firsts (pos, left, x: rank at depth 2^k) of the classes at depth
    2^(k+1); then the members (pos, left, source) of the LCP intervals of
    min_lines or more, and later copies of long lines. ``made`` gets the stored
    steps that these are read from."""
    def keep(df, name):
        made.append(stored(df, name))
        return made[-1]

    found, done = _ranked(lines.withColumnsRenamed({"a": "x", "b": "y"}))
    moved = keep(found.selectExpr("pos", "left", "long", "start AS rank", "source", "alone"), "lines-first-ranks")
    drop_stored(done)
    long = moved.where("long AND pos > source").select("pos", "left", "source")
    known, ranks, firsts, depth = moved, [], [], 1
    intervals = moved.where("false").select("pos", "left", "source")
    while True:
        active = moved.where("NOT alone")
        if depth == min_lines:
            intervals = active.select("pos", "left", "source")
        marks = active.select(F.expr("pos + left").alias("mark")).distinct()
        known = keep(known.withColumn("mark", F.expr("pos + left")).join(marks, "mark", "left_semi").select(
            "pos", "left", "rank"), "lines-ranks")
        if known.isEmpty():
            return ranks, firsts, intervals, long
        ranks.append(known)
        members = active.select("pos", "left", F.col("rank").alias("x"))
        if depth < min_lines < 2 * depth:
            found, done = _ranked(_ahead(members, known, str(min_lines - depth)))
            intervals = found.where("NOT alone").select("pos", "left", "source")
            made.append(done)
        found, done = _ranked(_ahead(members, known, str(depth)))
        moved = keep(found.selectExpr("pos", "left", "x", "x + start - x_start AS rank", "source", "alone"), "lines-members")
        drop_stored(done)
        firsts.append(moved.where("alone OR source = pos").select("pos", "left", "x"))
        now = moved.select("pos", F.col("rank").alias("now"))
        known = known.join(now, "pos", "left").select("pos", "left", F.coalesce("now", "rank").alias("rank"))
        depth *= 2


def longest_repeats(ranks: list[DataFrame], firsts: list[DataFrame], made: list) -> DataFrame:
    """(pos, left, length, source): for suffixes with a line in common with one
    before them, the longest prefix that begins such a one, by halving from the
    deepest classes up. ``ranks``, ``firsts``: of one doubling round or more."""
    rows = None
    for k in reversed(range(len(ranks))):
        # groups (x): suffixes with ``low`` lines in common, no two of them with low + 2^k
        fresh = firsts[k].selectExpr("pos", "left", "3 * x + 2 AS x", f"{1 << k}L AS low")
        rows = fresh if rows is None else rows.unionByName(fresh)
        if k == 0:
            break
        found, done = _ranked(_ahead(rows, ranks[k - 1], "low"))
        parts = F.expr("filter(array(IF(alone OR pos = source, struct(3 * x_start AS x, low AS low), NULL), IF(alone, NULL, "
                       f"struct(3 * start + 1 AS x, low + {1 << k - 1} AS low))), g -> g IS NOT NULL)")
        rows = stored(found.select("pos", "left", F.explode(parts).alias("g")).select("pos", "left", "g.x", "g.low"), "lines-halves")
        drop_stored(done)
        made.append(rows)
    found, done = _ranked(rows.withColumn("y", F.lit(0).cast("long")))
    made.append(done)
    return found.where("pos > source").select("pos", "left", F.col("low").alias("length"), "source")


def maximal_repeats(longest: DataFrame) -> DataFrame:
    """Those of ``longest`` that no longer one of the document holds, plus ``own``:
    their lines up to the next one."""
    order = Window.partitionBy(F.expr("pos + left")).orderBy("pos")
    kept = longest.withColumn("held", F.lag(F.expr("pos + length")).over(order) >= F.expr("pos + length")).where(
        "held IS NULL OR NOT held").drop("held")
    return kept.withColumn("own", F.least("length", F.lead("pos").over(order) - F.col("pos")))


def repeated_runs(copies: DataFrame) -> DataFrame:
    """Runs (pos, left, length, source) of ``copies`` (pos, left, source, span): those
    that follow each other on one diagonal (pos - source) are one run; a long line
    is a run of one."""
    key = [F.expr("pos + left").alias("mark"), "span", (F.col("pos") - F.col("source")).alias("diagonal")]
    rows = copies.select("pos", "left", "source", *key)
    order = Window.partitionBy("mark", "span", "diagonal").orderBy("pos")
    return (rows.withColumn("island", F.col("pos") - F.row_number().over(order))
            .groupBy("mark", "span", "diagonal", "island")
            .agg(F.min("pos").alias("pos"), F.max("left").alias("left"), (F.count("*") + (F.first("span") - 1)).alias("length"),
                 F.min("source").alias("source"))
            .select("pos", "left", "length", "source"))


def _cuts(numbered: DataFrame, min_lines: int, long_words: int) -> DataFrame:
    """(row_key, runs, repeats, gone: numbers of the lines to delete), stored."""
    made = [stored(numbered.select("row_key", "doc_id", F.expr(N_LINES).alias("n_lines"),
                                   F.expr(_lines("text", long_words)).alias("names")), "lines-names")]
    named = made[0]
    places = stored(_sequence_places(named), "lines-places")
    lines = named.join(places, "row_key").select("n_lines", "base", F.posexplode("names").alias("i", "name")).select(
        F.expr("base + i").alias("pos"), F.expr("n_lines - i").alias("left"), "name.*")
    ranks, firsts, intervals, long = suffix_ranks(lines, min_lines, made)
    copies = intervals.where("pos > source").withColumn("span", F.lit(min_lines))
    if min_lines > 1:
        copies = copies.unionByName(long.withColumn("span", F.lit(1)))
    found = repeated_runs(copies).withColumns({"own": F.expr(f"IF(length < {min_lines}, length, 0L)"), "maximal": F.lit(False)})
    if ranks:
        repeats = maximal_repeats(longest_repeats(ranks, firsts, made).where(F.col("length") >= min_lines))
        found = found.unionByName(repeats.withColumn("maximal", F.lit(True)))
    starts = named.join(places, "row_key").select("row_key", "base", F.expr("base + n_lines").alias("mark"))
    found = found.withColumn("mark", F.expr("pos + left")).join(starts, "mark").withColumn("start", F.expr("pos - base"))
    run = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("start", "int"), ("length", "long"), ("source", "long"))])
    cuts = found.groupBy("row_key").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("maximal") == kind, run))).alias(name) for name, kind in (("runs", False), ("repeats", True))],
        F.collect_list(F.when(F.col("own") > 0, F.struct("start", "own"))).alias("own"))
    cuts = stored(cuts.select("row_key", "runs", "repeats", F.expr(
        "array_distinct(flatten(transform(own, r -> sequence(CAST(r.start AS INT), CAST(r.start + r.own - 1 AS INT)))))").alias("gone")),
        "lines-cuts")
    for step in (*made, places):
        drop_stored(step)
    return cuts


def line_dedup(docs: DataFrame, min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """docs with later copies of repeated runs of ``min_lines`` lines or more, and
    of single lines of ``long_words`` words or more, cut out of ``text``, plus
    n_lines and n_deleted (both of the input text), runs and repeats (start,
    length, source), see the head of this module."""
    own = ("row_key", "n_lines", "n_deleted", "runs", "repeats", "gone")
    numbered = stored(docs.drop(*own).withColumn("row_key", F.monotonically_increasing_id()), "lines-docs")
    cuts = _cuts(numbered, min_lines, long_words)
    cut = F.expr("transform(array(split(text, '\\n', -1)), ls -> array_join(transform("
                 "array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\\n'))[0]")
    kept = [F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in numbered.columns if c != "row_key"]
    return numbered.join(cuts, "row_key", "left").select(
        *kept, F.expr(N_LINES).alias("n_lines"), F.expr("CASE WHEN gone IS NULL THEN 0L ELSE CAST(size(gone) AS BIGINT) END").alias("n_deleted"),
        "runs", "repeats")
