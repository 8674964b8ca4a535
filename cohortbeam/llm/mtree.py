"""Exact top-k inner-product search over M-trees.

Inner products become a metric by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x,
so the nearest x' in Euclidean distance has the highest score.

Build: a bounded sample of rows (``MAX_PIVOTS`` at most) routes every row to its
nearest pivot; the rows of a pivot are dealt by a hash of their id into trees of
about ``tree_rows`` rows, so equal vectors never meet in one task. Each tree is
one row of the index: pages of at most ``page_rows`` entries, routing entries
with their covering radius, and every entry with its distance to the page's own
routing object.

Search: queries go in blocks of ``query_block`` rows, a block meets every tree.
A best-first search opens the page with the least possible distance to any query
of the block, with the queries that may still gain from it. Entries whose stored
parent distance already shows, by the triangle inequality, that they are too far
from all of these are skipped before a distance is computed; the others are one
matrix product. The bound of each query starts at the k-th best of the routing
sample and tightens from page to page and tree to tree in a task. Per task only
k rows a query leave it.

Vectors that are null, or hold a null, NaN or infinite component, and rows
without an id take no part. Vectors are compared with vectors of their own
length only. Rows that share the query's id are its own rows; other repeated
rows are candidates each. An empty table gives an empty result. Extra columns
are ignored. Scores are exact while they fit into 53 bits.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import stored

MAX_PIVOTS = 1024
INDEX = ("dim int, ids binary, vecs binary, parent_d binary, page_lo binary, page_hi binary, page_leaf binary, "
         "route_point binary, route_child binary, route_radius binary, route_parent_d binary")


def integer_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, valid rows only."""
    return (df.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
            .where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < CAST('Infinity' AS DOUBLE))")
            .selectExpr("CAST(vec_id AS BIGINT) AS vec_id",
                        f"transform(embedding, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v"))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in column], dtype=np.int64).reshape(len(column), -1)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(top - (f * f).sum(axis=1), 0))[:, None]])


def build_tree(ids: np.ndarray, vecs: np.ndarray, top: float, page_rows: int = 64, fanout: int = 16) -> dict:
    """Bulk load: a page either holds objects, or routes to pages. Arrays only."""
    lifted = _lift(vecs, top)
    order, pages, routes = [], [], []
    parent_d = np.zeros(len(ids))

    def spread(members: np.ndarray) -> np.ndarray:
        """Routing objects, each far from those before it."""
        chosen = [members[0]]
        d = np.linalg.norm(lifted[members] - lifted[chosen[0]], axis=1)
        while len(chosen) < fanout and d.max() > 0:
            chosen.append(members[int(d.argmax())])
            d = np.minimum(d, np.linalg.norm(lifted[members] - lifted[chosen[-1]], axis=1))
        return np.array(chosen)

    todo = [(np.arange(len(ids)), -1, None)]  # members, routing object (-1: none), route entry that points here
    while todo:
        members, pivot, route = todo.pop()
        page = len(pages)
        if route is not None:
            routes[route][1] = page
        near = np.zeros(len(members)) if pivot < 0 else np.linalg.norm(lifted[members] - lifted[pivot], axis=1)
        if len(members) <= page_rows:
            parent_d[members] = near
            pages.append((len(order), len(order) + len(members), 1))
            order.extend(members)
            continue
        chosen = spread(members)
        if len(chosen) == 1:  # all equal: pages of any of them
            groups = [(chosen[0], part) for part in np.array_split(members, min(fanout, -(-len(members) // page_rows)))]
        else:
            d = np.stack([np.linalg.norm(lifted[members] - lifted[c], axis=1) for c in chosen])
            owner = d.argmin(axis=0)
            groups = [(c, members[owner == i]) for i, c in enumerate(chosen)]
        pages.append((len(routes), len(routes) + len(groups), 0))
        first = len(routes)
        for i, (c, part) in enumerate(groups):
            radius = float(np.linalg.norm(lifted[part] - lifted[c], axis=1).max())
            from_parent = 0.0 if pivot < 0 else float(np.linalg.norm(lifted[c] - lifted[pivot]))
            routes.append([c, -1, radius, from_parent])
            todo.append((part, c, first + i))
    order = np.array(order, dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    cols = np.array(routes, dtype=np.float64).reshape(-1, 4)
    lo, hi, leaf = np.array(pages, dtype=np.int64).T
    return {"ids": ids[order], "vecs": vecs[order], "parent_d": parent_d[order], "page_lo": lo, "page_hi": hi,
            "page_leaf": leaf, "route_point": place[cols[:, 0].astype(np.int64)] if len(cols) else np.zeros(0, np.int64),
            "route_child": cols[:, 1].astype(np.int64), "route_radius": cols[:, 2], "route_parent_d": cols[:, 3]}


def search_tree(tree: dict, query_id: int, query: np.ndarray, base: float, best: list, k: int, bound: float,
                seen: list | None = None) -> float:
    """Best-first search for one query. ``best`` is a heap of (score, -id) kept
    at k entries; ``base`` is |q|^2 + M^2; returns the tightened bound (the
    distance of the k-th best). ``seen`` counts computed distances."""
    slack = 1e-6 * (base ** 0.5 + 1)
    vecs, floats = tree["vecs"], tree["floats"]
    q = query.astype(np.float64)
    heap = [(0.0, 0, -1.0)]  # least possible distance, page, distance of its routing object (-1: none)
    while heap:
        low, page, d_parent = heapq.heappop(heap)
        if low > bound + slack:
            break
        lo, hi = tree["page_lo"][page], tree["page_hi"][page]
        if tree["page_leaf"][page]:
            at = np.arange(lo, hi)
            if d_parent >= 0:
                at = at[np.abs(d_parent - tree["parent_d"][lo:hi]) <= bound + slack]
            scores = vecs[at] @ query
            if seen is not None:
                seen.append(len(at))
            ids = tree["ids"][at]
            if len(best) >= k:
                keep = scores >= best[0][0]
                scores, ids = scores[keep], ids[keep]
            for s, i in zip(scores.tolist(), ids.tolist()):
                if i != query_id:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
            if len(best) >= k:
                bound = min(bound, max(base - 2.0 * best[0][0], 0.0) ** 0.5)
        else:
            r = np.arange(lo, hi)
            if d_parent >= 0:
                r = r[np.abs(d_parent - tree["route_parent_d"][lo:hi]) - tree["route_radius"][lo:hi] <= bound + slack]
            d = np.sqrt(np.maximum(base - 2.0 * (floats[tree["route_point"][r]] @ q), 0))
            if seen is not None:
                seen.append(len(r))
            least = np.maximum(d - tree["route_radius"][r], 0)
            for i in np.flatnonzero(least <= bound + slack):
                heapq.heappush(heap, (float(least[i]), int(tree["route_child"][r[i]]), float(d[i])))
    return bound


class Batch:
    """Queries of one block that are searched together, and their best rows so
    far: scores and ids of k rows each, best first (ids -1 where there is none)."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, top: float, bound: np.ndarray):
        self.ids, self.floats, self.k = ids, vecs.astype(np.float64), k
        self.base = (self.floats * self.floats).sum(axis=1) + top
        self.slack = 1e-6 * (np.sqrt(self.base) + 1)
        self.bound = bound
        self.scores = np.full((len(ids), k), NO_SCORE, dtype=np.int64)
        self.found = np.full((len(ids), k), -1, dtype=np.int64)
        self.computed = self.avoided = 0

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``ids`` with ``scores`` (queries x rows) for the queries ``q``."""
        better = scores >= self.scores[q, -1][:, None]
        hit = better.any(axis=1)
        q, scores = q[hit], np.where(better[hit], scores[hit], NO_SCORE)
        if not len(q):
            return
        scores = np.concatenate([self.scores[q], scores], axis=1)
        ids = np.concatenate([self.found[q], np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        full = self.scores[q, -1] > NO_SCORE
        kth = np.sqrt(np.maximum(self.base[q] - 2.0 * self.scores[q, -1], 0))
        self.bound[q] = np.where(full, np.minimum(self.bound[q], kth), self.bound[q])


NO_SCORE = np.iinfo(np.int64).min // 4


def search_together(tree: dict, batch: Batch) -> None:
    """Best-first search of one tree for all queries of a batch: the page that is
    nearest to any of them comes next, with the queries that may still gain from
    it. Entries that the stored parent distances show to be too far from every
    such query are skipped; the others are one matrix product."""
    everyone = np.arange(len(batch.ids))
    heap = [(0.0, 0, everyone, np.zeros(len(everyone)), None)]  # least distance, page, queries, least distances, parent distances
    while heap:
        _, page, q, low, d_parent = heapq.heappop(heap)
        alive = low <= batch.bound[q] + batch.slack[q]
        if not alive.any():
            continue
        q = q[alive]
        lo, hi = int(tree["page_lo"][page]), int(tree["page_hi"][page])
        leaf = tree["page_leaf"][page]
        reach = (batch.bound[q] + batch.slack[q])[:, None]
        if d_parent is None:
            near = np.ones((len(q), hi - lo), dtype=bool)
        else:
            d_parent = d_parent[alive]
            stored_d = tree["parent_d"][lo:hi] if leaf else tree["route_parent_d"][lo:hi]
            radius = 0.0 if leaf else tree["route_radius"][lo:hi]
            near = np.abs(d_parent[:, None] - stored_d) - radius <= reach
        at = lo + np.flatnonzero(near.any(axis=0))
        near = near[:, at - lo]
        batch.computed += int(near.sum())
        batch.avoided += len(everyone) * (hi - lo) - int(near.sum()) if leaf else 0
        if not len(at):
            continue
        if leaf:
            scores = np.rint(batch.floats[q] @ tree["floats"][at].T).astype(np.int64)
            own = batch.ids[q][:, None] == tree["ids"][at]
            batch.offer(q, np.where(near & ~own, scores, NO_SCORE - 1), tree["ids"][at])
            continue
        d = np.sqrt(np.maximum(batch.base[q][:, None] - 2.0 * (batch.floats[q] @ tree["floats"][tree["route_point"][at]].T), 0))
        least = np.maximum(d - tree["route_radius"][at], 0)
        go = near & (least <= reach)
        for i in np.flatnonzero(go.any(axis=0)):
            g = go[:, i]
            heapq.heappush(heap, (float(least[g, i].min()), int(tree["route_child"][at[i]]), q[g], least[g, i], d[g, i]))


def _routing_sample(vectors: DataFrame, rows: int, tree_rows: int) -> list:
    n = max(1, min(MAX_PIVOTS, -(-rows // tree_rows)))
    return vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()


def build_index(vectors: DataFrame, sample: list, top: float, tree_rows: int = 1024) -> DataFrame:
    """One row per tree. ``sample``: the routing rows; ``top``: largest squared norm."""
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r.v) for r in sample}:
        pivots[dim] = _matrix([r.v for r in sample if len(r.v) == dim])

    def route(batches):
        lifted = {d: _lift(p, top) for d, p in pivots.items()}
        for b in batches:
            dims = np.array([len(v) for v in b.v])
            node = np.full(len(b), -1, dtype=np.int64)
            for dim in set(dims.tolist()) & set(lifted):
                at = np.flatnonzero(dims == dim)
                x, p = _lift(_matrix(b.v.iloc[at]), top), lifted[dim]
                d = (p * p).sum(axis=1)[None, :] - 2.0 * (x @ p.T)
                node[at] = d.argmin(axis=1)
            yield b.assign(dim=dims, node=node)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = build_tree(pdf.vec_id.to_numpy(), _matrix(pdf.v), top)
        return pd.DataFrame([{"dim": int(pdf.dim.iloc[0])} | {k: v.tobytes() for k, v in tree.items()}])

    routed = stored(vectors.mapInPandas(route, "vec_id long, v array<long>, dim int, node long"), "mtree-routed")
    sizes = routed.groupBy("dim", "node").agg(F.expr(f"CAST(ceil(count(*) / {tree_rows}) AS BIGINT)").alias("trees"))
    dealt = routed.join(sizes, ["dim", "node"]).withColumn("deal", F.expr("pmod(xxhash64(vec_id, v), trees)"))
    return stored(dealt.groupBy("dim", "node", "deal").applyInPandas(grow, INDEX), "mtree-index")


def _open(row) -> dict:
    kinds = {"parent_d": np.float64, "route_radius": np.float64, "route_parent_d": np.float64}
    names = [c.split()[0] for c in INDEX.split(", ")][1:]
    tree = {n: np.frombuffer(getattr(row, n), dtype=kinds.get(n, np.int64)) for n in names}
    tree["vecs"] = tree["vecs"].reshape(len(tree["ids"]), row.dim)
    tree["floats"] = tree["vecs"].astype(np.float64)
    return tree


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, tree_rows: int = 1024,
          query_block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` its k best
    rows of ``vectors`` (both: vec_id, v) by inner product, ties to smaller ids."""
    spark = vectors.sparkSession
    vectors = stored(vectors, "mtree-vectors")
    queries = stored(queries.distinct().withColumn("block", F.floor(F.row_number().over(
        Window.partitionBy(F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id", "v")) / (query_block // 64))),
        "mtree-queries")
    rows, top = vectors.select(F.count("*"), F.coalesce(F.max(F.expr(
        "aggregate(v, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)")), F.lit(0.0))).first()
    sample = _routing_sample(vectors, rows, tree_rows)
    index = build_index(vectors, sample, top, tree_rows)
    found = None
    for block in [r.block for r in queries.select("block").distinct().orderBy("block").collect()]:
        asked = queries.where(F.col("block") == block).select("vec_id", "v").collect()  # query_block rows at most
        given = spark.sparkContext.broadcast([(r.vec_id, np.array(r.v, dtype=np.int64)) for r in asked])

        def search(batches, given=given):
            asked = given.value
            by_dim: dict[int, Batch] = {}
            place: dict[int, np.ndarray] = {}
            for dim in {len(q) for _, q in asked}:
                place[dim] = np.array([n for n, (_, q) in enumerate(asked) if len(q) == dim])
                ids = np.array([asked[n][0] for n in place[dim]], dtype=np.int64)
                vecs = _matrix([asked[n][1] for n in place[dim]])
                by_dim[dim] = Batch(ids, vecs, k, top, np.full(len(ids), np.inf))
                routes = [r for r in sample if len(r.v) == dim]
                if routes and dim:  # the k-th best of the routing sample bounds every query from the start
                    known = np.array([r.vec_id for r in routes], dtype=np.int64)
                    d = by_dim[dim].base[:, None] - 2.0 * (by_dim[dim].floats @ _matrix([r.v for r in routes]).astype(np.float64).T)
                    d = np.sort(np.where(ids[:, None] == known, np.inf, np.sqrt(np.maximum(d, 0))), axis=1)
                    if d.shape[1] >= k:
                        by_dim[dim].bound = d[:, k - 1].copy()
            for b in batches:
                for row in b.itertuples():
                    if row.dim in by_dim:
                        search_together(_open(row), by_dim[row.dim])
            for dim, batch in by_dim.items():
                at, col = np.nonzero(batch.scores > NO_SCORE)
                yield pd.DataFrame({"q": place[dim][at], "query_id": batch.ids[at], "vec_id": batch.found[at, col],
                                    "score": batch.scores[at, col]})

        part = index.repartition(F.xxhash64("ids")).mapInPandas(search, "q long, query_id long, vec_id long, score long")
        part = part.withColumn("block", F.lit(block))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best_first = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
