"""Decontamination against a brute-force version; FM-index properties."""
import hashlib
import os
import random
import re
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from cohortbeam.llm import decontaminate, fm_index, queries
from llm.conftest import make_docs

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, k=13):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - k, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i:i + n])
                if g in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def digest(df):
    return {r.doc_id: (r.n_words, r.n_hit, len(r["items"]),
                       hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.contaminated)
            for r in decontaminate.judged(df).collect()}


def test_query_equals_brute_force(spark, sf, real_docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    rows = queries.QUERIES["op10_decontaminate"](spark, sf).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert [got[i] for i in real_docs.doc_id] == brute(real_docs.text, items)
    assert any(r.contaminated for r in rows)


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_random_texts_and_several_blocks(spark, block_words):
    rng = random.Random(4)

    def make(n):
        return " ".join(rng.choice("ab Cd é1 xy zz".split()) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 5, 9]))) for i in range(25)] + [(None, make(4)), (3, "again xy zz")]
    texts = [make(rng.randrange(40)) + rng.choice(["", " none--of,these ", " again xy zz"]) for _ in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = digest(decontaminate.contamination(make_docs(spark, texts).repartition(3), bench, window=4,
                                             block_words=block_words, shard_words=200))
    assert [got[i] for i in range(len(texts))] == brute(texts, items, 4)


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 5, 500), np.tile([2, 3], 60), [0]])
    index = fm_index.FMIndex(text, 5, sample=8)
    pats = [rng.integers(1, 5, rng.integers(1, 6)) for _ in range(50)]
    mat = np.zeros((50, 6), dtype=np.int64)
    for i, p in enumerate(pats):
        mat[i, :len(p)] = p
    lo, hi = index.find(mat, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(len(text) - len(p)) if (text[i:i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_awkward_rows(spark, awkward, no_docs):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (3, "")], "item_id long, text string")
    got = digest(decontaminate.contamination(awkward, bench))
    assert got[0][:3] == (0, 0, 0) and got[5][:3] == (6, 6, 1) and got[5][4]
    assert decontaminate.contamination(awkward, bench).count() == 8
    assert not any(v[4] for v in digest(decontaminate.contamination(awkward, bench.where("false"))).values())
    assert decontaminate.contamination(no_docs, bench).count() == 0


def test_repeated_items_fill_no_block(spark):
    """A third of all benchmark rows are one item: it counts once, and blocks keep their bound."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(1000))
    items = [(1, long)] * 50 + [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(900))) for i in range(2, 40)] + [(None, long)] * 30
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    rows = decontaminate.benchmark_blocks(bench, 13, 5000, chunk_words=400).collect()
    total = {}
    for r in rows:
        total[r.block] = total.get(r.block, 0) + r.n
    assert max(total.values()) < 5000 + 412 and set(total) == set(range(len(total)))
    assert len(rows) == len({(r.item_id, bytes(r.words)) for r in rows})
    texts = [f"a {long[100:400]} b", "v1 v2 v3", None, items[60][1]] * 2
    got = digest(decontaminate.contamination(make_docs(spark, texts), bench, block_words=5000))
    assert [got[i] for i in range(len(texts))] == brute(texts, items)


def test_clean_documents_keeps_columns_and_repeated_rows(spark):
    item = " ".join(f"q{i}" for i in range(15))
    docs = make_docs(spark, ["fine text", item, None, "fine text"], extra=("row_key", "key", "gone", "n", "bad"))
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", docs.doc_id * 0 + 1).where("text = 'fine text'"))
    got = decontaminate.clean_documents(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.row_key, r.gone) for r in got.where("text IS NOT NULL").collect()) == [
        (0, "fine text", "x", "x")] * 2 + [(1, "fine text", "x", "x")] * 2 + [(3, "fine text", "x", "x")] * 2
    assert got.where("text IS NULL").count() == 2


def test_workers_need_no_copy_of_the_library(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from cohortbeam.session import get_spark
from cohortbeam.llm import decontaminate
spark = get_spark("local[2]", 2)
def importable(rows):
    try:
        import cohortbeam
        yield 1
    except ModuleNotFoundError:
        yield 0
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [0]
text = " ".join("q%d" % i for i in range(15))
docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
bench = spark.createDataFrame([(7, text)], "item_id long, text string")
assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [2]
print("clean")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "clean" in out.stdout, out.stderr[-2000:]
