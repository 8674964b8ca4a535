"""Mixture-controlled packing (deficit round-robin over source queues).

Every source is a queue of documents. Per window of ``window_tokens`` tokens a
queue earns credit in proportion to its target share; the credit it has not
spent (its deficit) is carried to the next window. Queue ``s`` with credit
``q_s`` per window has spent ``floor(j * G_s)`` tokens after its j-th visit,
where ``G_s = k_s * q_s`` and ``k_s`` is the number of windows it waits until
the deficit reaches ``min_slice`` tokens (1 for all but tiny sources). Because
the carried deficit after any window is this closed form, every partition
resumes the round-robin at its own place in the queue: it only needs the number
of tokens queued before it. No queue passes through one task.

The slices in (window, source, queue) order form one stream, cut into sequences
of ``seq_len``; the tail is cut into powers of two, so nothing is padded.

Null texts are empty documents (their separator only); a null source is a queue
of its own; repeated rows and ids are packed as often as they occur; an empty
table gives no pieces. Extra columns are ignored.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import stored

SLICE = 256  # rows that are Python objects at a time
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("window", pa.int64()), ("source", pa.string())])


def load_encoder(path: str):
    """(str -> list of token ids, number of ids), for a ``tokenizers`` .json or a
    ``.tiktoken`` rank file of the same vocabulary. Strings of special tokens in
    a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary, max(ranks.values()) + 1
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids, tok.get_vocab_size()


def tokenize(docs: DataFrame, encoder_path: str, separator: int = 0) -> DataFrame:
    """(row_key, doc_id, source, n, ids): ids little-endian, unsigned, 16 bits
    each if the vocabulary allows it, else 32; the separator id last. row_key
    numbers the rows (its high bits: the partition)."""
    def run(batches):
        encode, size = load_encoder(encoder_path)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):  # few rows at a time as Python objects
                b = batch.slice(i, SLICE)
                ids = [np.array(encode(t) + [separator], dtype=kind) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row_key"), b.column("doc_id"), b.column("source"),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["row_key", "doc_id", "source", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row_key long, doc_id long, source string, n long, ids binary")


def _weights(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.col("total").cast("double")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")].cast("double"),
                      F.lit(0.0))


def drr_slices(tokens: DataFrame, window_tokens: int, min_slice: int,
               weights: dict[str, float] | None = None) -> DataFrame:
    """(row_key, start, length, window, source, at): the slice of a document
    that its source sends in a window; ``at`` is its place in the queue. Sources
    without a weight, or with 0, follow after all others.

    A row's place in its queue is a two-level prefix sum: rows inside a (source,
    block), then block totals; a block is one partition of the token table. The
    rows meet their source's credit with their block, so a hot source is spread
    over as many tasks as it has blocks."""
    rows = tokens.select("row_key", "source", "n", F.shiftright("row_key", 33).alias("block"))
    blocks = rows.groupBy("source", "block").agg(F.sum("n").alias("bn"))
    totals = blocks.groupBy("source").agg(F.sum("bn").alias("total")).withColumn("w", _weights(weights))
    totals = (totals.crossJoin(F.broadcast(totals.agg(F.sum("w").alias("w_all"))))  # one row
              .withColumn("q", F.expr(f"CASE WHEN w > 0 THEN greatest({window_tokens} * w / w_all, 1e-6) "
                                      f"ELSE {window_tokens}D END"))
              .withColumn("k", F.expr(f"CAST(greatest(1, ceil({min_slice} / q)) AS BIGINT)"))
              .selectExpr("source", "k", "k * q AS g", "total", "w > 0 AS weighted"))
    last = totals.where("weighted").agg(F.coalesce(F.max(F.expr("k * (CAST(ceil(total / g) AS BIGINT) + 1)")), F.lit(0))
                                        .alias("late"))
    totals = totals.crossJoin(F.broadcast(last)).selectExpr(  # one row
        "source", "k", "g", "CASE WHEN weighted THEN 0 ELSE late END AS first")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_at", F.coalesce(F.sum("bn").over(before), F.lit(0))).join(totals, "source").select(
        "source", "block", "block_at", "k", "g", "first")
    inside = Window.partitionBy("source", "block").orderBy("row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["source", "block"])
            .withColumn("a", F.expr("block_at + in_block")))
    return (rows.withColumn("j", F.explode(F.expr(
                "sequence(greatest(1, CAST(ceil((a + 1) / g) AS BIGINT) - 1), CAST(ceil((a + n) / g) AS BIGINT) + 1)")))
            .withColumn("lo", F.expr("greatest(a, CAST(floor((j - 1) * g) AS BIGINT))"))
            .withColumn("hi", F.expr("least(a + n, CAST(floor(j * g) AS BIGINT))"))
            .where("hi > lo")
            .selectExpr("row_key", "lo - a AS start", "hi - lo AS length", "first + j * k AS window", "source",
                        "lo AS at"))


def _stream_positions(slices: DataFrame) -> DataFrame:
    """Adds pos, the slice's first token in the (window, source, at) order: a
    range sort, running sums inside each range, and one offset per range."""
    def running(batches):
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = b.length.cumsum() + at
            at = int(ends.iloc[-1]) if len(ends) else at
            yield b.assign(part=part, local=ends - b.length)

    ranged = slices.repartitionByRange("window", "source", "at").sortWithinPartitions("window", "source", "at")
    ranged = stored(ranged.mapInPandas(running, "row_key long, start long, length long, window long, source string, "
                                                "at long, part int, local long"), "pack-slices")
    parts = ranged.groupBy("part").agg(F.sum("length").alias("total"))  # one row per range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return ranged.join(parts, "part").selectExpr("row_key", "start", "length", "window", "base + local AS pos")


def sequence_cuts(total: int, seq_len: int) -> list[tuple[int, int]]:
    """(position, sequence id) where the sequences of the tail begin, the end
    last: the tail is cut into powers of two, longest first."""
    at, number, rest = total // seq_len * seq_len, total // seq_len, total % seq_len
    cuts = []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        cuts.append((at, number))
        at, number, rest = at + size, number + 1, rest - size
    return [*cuts, (at, number)]


def pack(docs: DataFrame, encoder_path: str, seq_len: int = 1024, window_tokens: int = 64 * 1024,
         min_slice: int = 64, weights: dict[str, float] | None = None, separator: int = 0) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, ids, doc_tokens,
    sequence_id, offset, window, source). ``weights`` are target token
    proportions by source; by default every source's own share of all tokens,
    so that all queues end together."""
    tokens = stored(tokenize(docs, encoder_path, separator), "pack-tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tail = sequence_cuts(total, seq_len)
    whole = total // seq_len * seq_len

    def cut(batches):
        tail_at = np.array([p for p, _ in tail])
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                out = []
                for r in batch.slice(i, SLICE).to_pylist():
                    ids = np.frombuffer(r["ids"], dtype="<u2" if len(r["ids"]) == 2 * r["n"] else "<u4").astype("<u4")
                    for s in sorted(r["slices"], key=lambda x: x["start"]):
                        start, pos, end = s["start"], s["pos"], s["pos"] + s["length"]
                        while pos < end:
                            if pos < whole:
                                number, offset = divmod(pos, seq_len)
                                stop = min(end, (number + 1) * seq_len)
                            else:
                                t = int(np.searchsorted(tail_at, pos, side="right")) - 1
                                number, offset = tail[t][1], pos - tail[t][0]
                                stop = min(end, tail[t + 1][0])
                            out.append({"doc_id": r["doc_id"], "start": start, "length": stop - pos,
                                        "ids": ids[start:start + stop - pos].tobytes(), "doc_tokens": r["n"],
                                        "sequence_id": number, "offset": offset, "window": s["window"],
                                        "source": r["source"]})
                            start, pos = start + stop - pos, stop
                yield pa.RecordBatch.from_pylist(out, schema=PIECES)

    placed = _stream_positions(drr_slices(tokens, window_tokens, min_slice, weights))
    per_row = placed.groupBy("row_key").agg(F.collect_list(F.struct("start", "length", "pos", "window")).alias("slices"))
    return tokens.join(per_row, "row_key").select("doc_id", "source", "n", "ids", "slices").mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
             "window long, source string")
