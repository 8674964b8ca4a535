"""Exact top-k against brute force."""
import numpy as np
import pytest

from cohortbeam.llm import mtree


def brute(rows, query_ids, k):
    out = []
    for i, q in rows:
        if i in query_ids:
            c = sorted((-int(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c[:k])]
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 700])
def test_equals_brute_force_with_ties_and_repeated_vectors(spark, hot):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-300, 300, 8).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(hot)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = mtree.top_k(df.where("vec_id % 50 = 0"), df, k=10, tree_rows=256, query_block=640)
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i % 50 == 0}, 10)


def test_bounds_avoid_distance_computations():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20000, 20000, (20, 4))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-50, 50, (4000, 4))).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = mtree.build_tree(np.arange(4000), x, top)
    tree["floats"] = tree["vecs"].astype(float)
    seen: list = []
    best: list = []
    mtree.search_tree(tree, -1, x[7], float((x[7].astype(float) ** 2).sum()) + top, best, 5, float("inf"), seen)
    scores = x @ x[7]
    want = sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:5]
    assert sorted(best, reverse=True) == want and sum(seen) < 2000


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"),
            (5, [0.5, -0.5], "x"), (5, [0.5, -0.5], "x"), (6, [], "x"), (7, [3.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").selectExpr(
        "*", "'x' AS v", "'x' AS node", "'x' AS dim")
    v = mtree.integer_vectors(df)
    got = sorted(map(tuple, mtree.top_k(v.where("vec_id % 100 = 0"), v).collect()))
    assert got == [(0, 1, 5, 512 * 1024 - 512 * 2048), (0, 2, 5, 512 * 1024 - 512 * 2048)]
    assert mtree.top_k(v.where("false"), v.where("false")).count() == 0


@pytest.mark.parametrize("dims, spread", [(4, 50), (16, 400), (2, 0)])
def test_searching_together_equals_one_by_one_and_avoids_distances(dims, spread):
    rng = np.random.default_rng(dims)
    centres = rng.integers(-20000, 20000, (20, dims))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-spread, spread + 1, (3000, dims))).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = mtree.build_tree(np.arange(3000), x, top)
    tree["floats"] = tree["vecs"].astype(float)
    asked = np.arange(0, 3000, 60)
    batch = mtree.Batch(asked, x[asked], 7, top, np.full(len(asked), np.inf))
    mtree.search_together(tree, batch)
    for n, i in enumerate(asked):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:7]
        assert [(-s, j) for s, j in zip(batch.scores[n].tolist(), batch.found[n].tolist())] == want
        best: list = []
        mtree.search_tree(tree, i, x[i], float((x[i].astype(float) ** 2).sum()) + top, best, 7, float("inf"))
        assert sorted((-s, -j) for s, j in best) == want
    if spread:
        assert batch.computed < 0.7 * len(asked) * 3000


def test_fewer_rows_than_k_and_own_rows(spark):
    v = spark.createDataFrame([(1, [1, 2]), (1, [5, 5]), (2, [0, 1]), (100, [3, 3])], "vec_id long, v array<long>")
    got = sorted(map(tuple, mtree.top_k(v.where("vec_id = 100 OR vec_id = 1"), v, k=10).collect()))
    assert [g for g in got if g[0] == 100] == [(100, 1, 1, 30), (100, 2, 1, 9), (100, 3, 2, 3)]
    assert len([g for g in got if g[0] == 1]) == 4
