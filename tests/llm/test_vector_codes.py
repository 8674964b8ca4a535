"""Product codes against plain integers."""
import hashlib
import math

import numpy as np
import pytest

from cohortbeam.llm import vector_codes as vc


def brute(rows, n_parts, entries, rounds, scale):
    """rows: (vec_id, vector, label). Plain Python integers throughout."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i, v) for i, v, _ in kept if i is not None)
    dim = next(len(v) for _, v in named if len(v) % n_parts == 0)
    w = dim // n_parts
    kept = [r for r in kept if len(r[1]) == dim]

    def cut(v):
        return [v[p * w:(p + 1) * w] for p in range(n_parts)]

    books = [list(b) for b in zip(*[cut(v) for _, v in named if len(v) == dim][:entries])]

    def assign(v):
        return [min((sum((a - c) ** 2 for a, c in zip(part, e)), n) for n, e in enumerate(books[p]))
                for p, part in enumerate(cut(v))]

    for _ in range(rounds):
        got = {}
        for _, v, _ in kept:
            for p, (_, e) in enumerate(assign(v)):
                got.setdefault((p, e), []).append(cut(v)[p])
        for (p, e), parts in got.items():
            books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    out, per = [], {}
    for i, v, lab in kept:
        best = assign(v)
        err = sum(d for d, _ in best)
        per[lab] = per.get(lab, 0) + err
        out.append((i, "".join(f"{e:02x}" for _, e in best), err, lab))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted([(i, c, e, per[lab]) for i, c, e, lab in out], key=str), hashlib.sha256(flat.encode()).hexdigest()


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", *[f"'x' AS {c}" for c in ("v", "code", "error", "label_rows", "same_label", "slot", "n")])
    got, books = vc.compress(df.repartition(3), **kw)
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got.collect()], key=str), vc.books_digest(books)


@pytest.mark.parametrize("reach", [0.6, 300_000.0])
def test_equals_plain_integers_with_ties_copies_and_a_hot_label(spark, reach):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.random(32) * 2 * reach - reach).tolist(), None if i % 7 == 0 else int(i % 3 == 0))
            for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1], 9) for i in range(150)] + [(5, rows[5][1], 4)] * 2
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 32)], i) for i in range(60)]
    kw = dict(n_parts=8, entries=16, rounds=2, scale=256)
    assert run(spark, rows, **kw) == brute(rows, **kw)


def test_limb_products_are_exact_where_float64_is_not():
    rng = np.random.default_rng(1)
    a = rng.integers(-2 ** 27, 2 ** 27, (2, 50, 4))
    b = rng.integers(-2 ** 27, 2 ** 27, (2, 4, 30))
    want = np.array([[[sum(int(x) * int(y) for x, y in zip(r, c)) for c in q.T] for r in p] for p, q in zip(a, b)])
    assert (vc.exact_products(a, b) == want).all()
    assert (np.matmul(a.astype(float), b.astype(float)).astype(np.int64) != want).any()
    assert len(vc.limbs(a, 25)) == 2 and len(vc.limbs(a // 2 ** 10, 25)) == 1


def test_first_of_equal_distances_wins():
    books = np.array([[[4], [0], [4], [2]]])
    code, error = vc.nearest(np.array([[[4], [1], [3], [-9]]]), books)
    assert code.tolist() == [[0, 1, 0, 1]] and error.tolist() == [[0, 1, 1, 81]]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    two = [0.5, -0.25]
    rows = [(3, two, None), (3, two, None), (None, [0.75, 0.75], 1), (1, None, 1), (2, [1.0, None], 1), (4, [nan, 0.0], 1),
            (5, [inf, 0.0], 1), (6, [], 1), (0, [1.0], 1), (7, [1.0, 2.0, 3.0, 4.0], 1), (8, [1e30, 0.0], 1)]
    kw = dict(n_parts=2, entries=4, rounds=2, scale=256)
    plain = [r for r in rows if r[0] != 8]
    got = run(spark, rows, **kw)
    assert got == brute(plain, **kw) and len(got[0]) == 3
    for none in (rows[3:4], []):
        assert run(spark, none, **kw) == ([], hashlib.sha256(b"").hexdigest())
