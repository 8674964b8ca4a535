"""Connected components against union-find; running sums and joins with hot keys."""
import random

import pytest

from cohortbeam.llm.common import component_labels, hot_join, running


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    if kind == "random":
        edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)]
    elif kind == "path":
        ids = rng.sample(range(10_000), 120)
        edges = [*zip(ids, ids[1:])]
    elif kind == "star":
        edges = [(500, i) for i in range(1000, 1400)] + [(500, 7), (1001, 1000), (2, 3)]
    else:
        edges = []
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in component_labels(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {x: find(x) for x in root}


def test_running_sums_of_a_hot_key_and_nulls_in_the_order(spark):
    rows = [(k, None if i % 5 == 0 else i, i, 3 * i + k) for k, n in ((1, 4), (2, 900), (3, 0), (4, 1), (5, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t long, u long, x long").repartition(4)
    got = running(df, "k", ["t", "u"], ("x",), ("u",)).collect()
    want = []
    for key in {r[0] for r in rows}:
        xor = total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            xor, total = xor ^ r[3], total + r[2]
            want.append((*r, n + 1, xor, total))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert running(df.where("false"), "k", ["t"]).count() == 0


def test_hot_join_is_a_left_join(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS a", "id % 2 AS b")
    small = rows.where("id % 5 <> 1").groupBy("a", "b").count().selectExpr("a", "b", "count", "a * 10 + b AS c")
    got = hot_join(rows, small, ["a", "b"], "count", share=100)
    assert sorted(map(tuple, got.select("id", "a", "b", "c").collect())) == sorted(
        map(tuple, rows.join(small, ["a", "b"], "left").select("id", "a", "b", "c").collect()))
