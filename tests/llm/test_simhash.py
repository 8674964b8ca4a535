"""SimHash groups against a brute-force version."""
import random

import numpy as np
import xxhash

from cohortbeam.llm import queries, simhash


def brute_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark, sf, real_docs):
    got = queries.QUERIES["op2_simhash"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = real_docs.sort_values("doc_id").reset_index(drop=True)
    fps = [brute_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == [docs.doc_id[r] for r in brute_groups(fps)]


def test_links_find_every_close_pair(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        if rng.random() < 0.5:  # one hot low-entropy partition
            base &= ~0xFFFF
        for _ in range(rng.choice([1, 2, 8])):
            f = base
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(df, 3).collect()}
    want = {(min(signed[i], signed[j]), max(signed[i], signed[j])) for i in range(len(fps)) for j in range(i)
            if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_every_layout_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    quarters = rng.integers(0, 1 << 16, (50, 4))
    shells = rng.integers(0, 100, (4, 4, 1 << 16)).astype(np.float32)
    for layout in simhash.LAYOUTS.values():
        each, cost = simhash.allocate(quarters, shells, layout, 3, 1000)
        assert (each.sum(axis=1) == 3 - len(layout) + 1).all() and (each >= -1).all() and np.isfinite(cost).all()


def test_awkward_rows(spark, awkward, no_docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(awkward).collect()}
    zero = "0" * 16
    assert got[(0, zero)] == got[(1, zero)] == got[(2, zero)] == 0
    one = f"{brute_fingerprint('one'):016x}"
    assert got[(4, one)] == got[(None, one)] == 4
    assert simhash.near_duplicates(awkward).count() == 8
    assert simhash.near_duplicates(no_docs).count() == 0
