"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of ``window`` consecutive words (shorter items:
one window). Each task collects its documents into shards, indexes the words of
a shard that can be part of a hit (maximal runs of benchmark vocabulary, at
least as long as the shortest window; nothing else can match), finds all
windows at once by backward search through wavelet-tree ranks, locates their
occurrences from sampled suffix positions and merges them into removal spans.

The benchmark is met in blocks of about ``block_words`` words, each broadcast;
items are first cut into overlapping chunks, so a block's size does not depend
on one long item. With several blocks every block passes over all documents and
the spans are merged per document.

Null texts have no words. Items without words hit nothing. An item with a null
id marks words, but is not listed. Repeated items and ids count once, repeated
documents are documents of their own. An empty benchmark leaves everything
clean; an empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import running, stored
from .fm_index import BREAK, END, FIRST, FMIndex

#: A-Z lower-cased; 0-9, a-z and all bytes of other characters kept; the rest splits words.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
                   for b in range(256))
KEY, KEY_ID = "_decontaminate_key", "_decontaminate_id"  # no columns of a result
RESULT = "row_key long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def item_chunks(benchmark: DataFrame, window: int, chunk_words: int = 10_000) -> DataFrame:
    """(item_id, words, n): items cut into chunks that overlap by window - 1 words."""
    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.item_id, b.text):
                words = words_of(text)
                for i in range(0, max(len(words) - window, 0) + 1, chunk_words):
                    part = words[i:i + chunk_words + window - 1]
                    if part:
                        out.append((item, b" ".join(part), len(part)))
            yield pd.DataFrame(out, columns=["item_id", "words", "n"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInPandas(
        run, "item_id string, words binary, n long")


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int, **options) -> DataFrame:
    """The different chunks of all items and the ``block`` of each: blocks are cut
    by a running sum of words, so one holds ``block_words`` and a chunk at most,
    however often an item is repeated."""
    chunks = item_chunks(benchmark, window, **options).dropDuplicates(["item_id", "words"])
    chunks = chunks.select(F.lit(0).cast("long").alias("all"), F.xxhash64("item_id", "words").alias("place"), "item_id", "words",
                           F.col("n").alias("size"))
    ordered = running(chunks, "all", ["place"], sums=("size",), name="decontaminate-items")
    block = F.floor((F.col("run_size") - F.col("size")) / block_words).cast("int")
    return ordered.select("item_id", "words", F.col("size").alias("n"), block.alias("block"))


class Windows:
    """The distinct windows of a block of items, as word codes, and their items."""

    def __init__(self, chunks: list, window: int):
        self.codes: dict[bytes, int] = {}
        self.items: list[str] = []
        item_no: dict[str, int] = {}
        owners: dict[tuple, set[int]] = {}
        for item, words, _ in chunks:
            row = [self.codes.setdefault(w, len(self.codes) + FIRST) for w in bytes(words).split()]
            number = -1
            if item is not None:
                number = item_no.setdefault(item, len(item_no))
            for i in range(max(len(row) - window, 0) + 1):
                owners.setdefault(tuple(row[i:i + window]), set()).add(number)
        self.items = list(item_no)
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.patterns = np.zeros((len(owners), window), dtype=np.int64)
        for i, w in enumerate(owners):
            self.patterns[i, :len(w)] = w
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners.values()])]).astype(np.int64)
        self.owners = np.array([i for o in owners.values() for i in sorted(o)], dtype=np.int64)


class Shard:
    """Words of some documents that can be hit, gathered until they are searched."""

    def __init__(self, windows: dict):
        self.w = SimpleNamespace(**windows)
        windows = self.w
        self.shortest = int(windows.lengths.min()) if len(windows.lengths) else 0
        self.rows, self.texts, self.run_doc, self.run_at, self.run_len, self.seen = [], [], [], [], [], 0

    def add(self, row_key, doc_id, text):
        words = words_of(text)
        self.rows.append((row_key, doc_id, len(words)))
        self.seen += len(words) + 1
        if not self.shortest:
            return
        get = self.w.codes.get
        codes = np.fromiter((get(x, 0) for x in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2):
            if hi - lo >= self.shortest:
                self.texts += [codes[lo:hi], np.array([BREAK])]
                self.run_doc.append(len(self.rows) - 1)
                self.run_at.append(lo)
                self.run_len.append(hi - lo)

    def search(self) -> pd.DataFrame:
        spans: list[list] = [[] for _ in self.rows]
        items: list[list] = [[] for _ in self.rows]
        if self.run_doc:
            text = np.concatenate([*self.texts, [END]])
            starts = np.concatenate([[0], np.cumsum(np.array(self.run_len) + 1)[:-1]])
            index = FMIndex(text, len(self.w.codes) + FIRST)
            lo, hi = index.find(self.w.patterns, self.w.lengths)
            hits = np.repeat(np.arange(len(lo)), hi - lo)
            places = index.locate(np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if b > a])
                                  if len(hits) else np.zeros(0, np.int64))
            run = np.searchsorted(starts, places, side="right") - 1
            doc = np.array(self.run_doc)[run]
            first = np.array(self.run_at)[run] + places - starts[run]
            order = np.lexsort((first, doc))
            for d, a, p in zip(doc[order].tolist(), first[order].tolist(), hits[order].tolist()):
                b, mine = a + int(self.w.lengths[p]), spans[d]
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
            for d, p in set(zip(doc.tolist(), hits.tolist())):
                items[d] += self.w.owners[self.w.owner_at[p]:self.w.owner_at[p + 1]].tolist()
        out = pd.DataFrame(self.rows, columns=["row_key", "doc_id", "n_words"]).astype({"doc_id": "Int64"})
        return out.assign(
            spans=pd.Series([[{"start": a, "end": b} for a, b in s] for s in spans], dtype=object),
            items=pd.Series([[self.w.items[i] for i in sorted(set(x)) if i >= 0] for x in items], dtype=object))


def _search_block(rows: DataFrame, windows: Windows, shard_words: int) -> DataFrame:
    # block_words words and one chunk at most; a plain dict, so that workers need no class of this package to load it
    given = rows.sparkSession.sparkContext.broadcast(vars(windows))

    def run(batches):
        shard = Shard(given.value)
        for b in batches:
            for key, doc_id, text in zip(b.row_key, b.doc_id.astype("Int64"), b.text):
                shard.add(key, doc_id, text)
                if shard.seen >= shard_words:
                    yield shard.search()
                    shard = Shard(given.value)
        yield shard.search()

    return rows.mapInPandas(run, RESULT)


def _merge(batches):
    for b in batches:
        merged = []
        for spans in b.spans:
            out: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append({"start": s["start"], "end": s["end"]})
            merged.append(out)
        yield b.assign(doc_id=b.doc_id.astype("Int64"), spans=pd.Series(merged, index=b.index, dtype=object))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 500_000,
                  shard_words: int = 1_000_000, row_key: Column | None = None) -> DataFrame:
    """Per document (row_key, doc_id, n_words, spans, items): spans are merged
    word ranges [start, end) covered by windows, items the ids they come from.
    ``row_key`` (long) names the rows; by default they are numbered."""
    chunks = benchmark_blocks(benchmark, window, block_words)
    blocks = 1 + chunks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    key = F.monotonically_increasing_id() if row_key is None else row_key
    rows = docs.select(key.alias("row_key"), F.col("doc_id").cast("long"),
                       F.col("text").cast("string"))
    if blocks > 1:
        rows = stored(rows, "decontaminate-docs")
    found = None
    for block in range(blocks):
        mine = chunks.where(F.col("block") == block).select("item_id", "words", "n").collect()
        part = _search_block(rows, Windows(mine, window), shard_words)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row_key", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).mapInPandas(_merge, RESULT)
    return found


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (hits cover a twentieth of the words or more)."""
    return (found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
            .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, all columns. Rows with one id and
    text share their verdict; a row is known by its id and a hash of both."""
    key = F.xxhash64("doc_id", "text")
    bad = judged(contamination(docs, benchmark, window, row_key=key)).where("contaminated").select(
        F.col("row_key").alias(KEY), F.col("doc_id").alias(KEY_ID)).distinct()
    same = (F.col(f"`{KEY}`") == key) & F.col(f"`{KEY_ID}`").eqNullSafe(F.col("doc_id").cast("long"))
    return docs.join(stored(bad, "decontaminate-bad"), same, "left_anti")
