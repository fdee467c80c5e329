"""Nearest neighbours by collision counting over query-aware windows.

Vectors are dealt to blocks of bounded size. In a block every vector is projected on `projections` random lines, and each line's
values form one sorted array. A query looks at the window around its own value on every line; a vector that lies in the
windows of at least `threshold` of the lines is verified by its distance. Windows grow by virtual rehashing (the same arrays, a
wider radius), and only their new ends are read.

A query first searches one block to the end: until its k-th verified distance is within the radius, or every vector is verified. That distance bounds
its true k-th distance, so in all other blocks windows grow no further than to that radius. The best of all blocks are merged.

A vector at distance s shares the window of half width w * R / 2 with probability 2 * Phi(w * R / (2 * s)) - 1: 0.68 at s = R for w = 2, and 0.57
at s = 1.27 R. With 240 lines a threshold of 0.67 lies below the one and 3 standard deviations above the other: those well within the radius pass
almost surely, and hardly any of the bulk beyond. All vectors are indexed; none is capped.

The size of a block follows the number of vectors (a `BLOCKS`-th of them, within bounds); a vector is copied, and a block's index built, once per pass and
65,536 queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from learnlens.llm.common import cut
from learnlens.llm.vectors import element, matrix, packed, usable

BLOCKS = 16
SMALLEST, LARGEST = 512, 1 << 16  # vectors of a block
QUERIES = 1 << 16
PROJECTIONS = 240
WIDTH = 2.0
THRESHOLD = 0.67
GROWTH = 1.1


class Block:
    """The sorted projections of the vectors of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int, seed: int = 7):
        self.ids, self.x = ids, x
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1], projections))
        values = x @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).ravel()
        # All lines as one sorted array: each begins beyond the end of the one before.
        self.shift = np.arange(projections) * (4 * float(np.abs(values).max(initial=0)) + 1)
        self.values = (np.sort(values, axis=0).T + self.shift[:, None]).ravel()
        self.begin = np.arange(projections) * len(x)
        spread = x - x.mean(axis=0)
        self.first = max(float(np.sqrt(2 * (spread**2).sum(axis=1).mean())) / 4, 1e-9)
        self.verified = 0

    def nearest(self, own: int, q: np.ndarray, k: int, width: float, threshold: float, growth: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest verified vectors but those with the query's own id; ties to smaller ids. Windows end at radius `most`."""
        n, lines = len(self.ids), len(self.begin)
        at = q @ self.lines
        low = high = np.clip(np.searchsorted(self.values, at + self.shift), self.begin, self.begin + n)
        counts = np.zeros(n, dtype=np.int64)
        distance = np.full(n, np.inf)
        checked = self.ids == own
        others = n - int(checked.sum())
        need = int(np.ceil(threshold * lines))
        radius = self.first if np.isinf(most) else most / growth
        while not checked.all():
            half = min(width * radius / 2, self.shift[1] / 2 if lines > 1 else np.inf)  # up to there a window holds its whole line
            l = np.maximum(np.searchsorted(self.values, at - half + self.shift), self.begin)
            h = np.minimum(np.searchsorted(self.values, at + half + self.shift, side="right"), self.begin + n)
            l, h = np.minimum(l, low), np.maximum(h, high)
            new = [self.order[a:b] for a, b in zip(l.tolist(), low.tolist())] + [self.order[a:b] for a, b in zip(high.tolist(), h.tolist())]
            low, high = l, h
            counts += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((counts >= need) & ~checked)
            if len(fresh):
                distance[fresh] = np.sqrt(((self.x[fresh] - q) ** 2).sum(axis=1))
                checked[fresh] = True
                self.verified += len(fresh)
            if radius >= most or (others > k and np.partition(distance, k - 1)[k - 1] <= radius):
                break
            radius = min(radius * growth, most)
        found = np.flatnonzero((distance <= most) & np.isfinite(distance))
        if len(found) > k:
            found = found[distance[found] <= np.partition(distance[found], k - 1)[k - 1]]
        found = found[np.lexsort((self.ids[found], distance[found]))][:k]
        return self.ids[found], distance[found]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int = BLOCKS, smallest: int = SMALLEST, largest: int = LARGEST, query_block: int = QUERIES,
    projections: int = PROJECTIONS, width: float = WIDTH, threshold: float = THRESHOLD, growth: float = GROWTH,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of up to k nearest rows of `vectors` for each of `queries`.

    Both have vec_id and embedding; other columns are ignored. Vectors that are null, zero or hold null or non-finite components,
    and rows without an id, take no part; only vectors of one length are compared. A vector with the query's id is never its
    neighbour; a repeated row is a neighbour each time, a repeated query is asked once. No vectors: an empty result.
    """
    kind = element(vectors, "embedding")
    whole = lambda df: df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    data = cut(packed(whole(vectors).withColumn("row", F.monotonically_increasing_id()).select("vec_id", "row", "embedding")))
    asked = cut(packed(whole(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))))
    total = data.count()
    blocks = max(1, -(-total // min(max(smallest, -(-total // blocks)), largest)))
    groups = max(1, -(-asked.count() // query_block))
    # A stated set of queries against all rows, in blocks: each pair of a data block and a group of queries is one task.
    left = data.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b"), F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("q"))
    seed = F.pmod(F.xxhash64("vec_id", F.lit("seed")), F.lit(blocks))
    right = asked.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("q"), seed.alias("b"))

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            index = Block(own["vec_id"].to_numpy(), matrix(own["embedding"], kind), projections)
            for i, q, most in zip(ask["vec_id"].tolist(), matrix(ask["embedding"], kind), ask["most"].tolist()):
                ids, far = index.nearest(i, q, k, width, threshold, growth, most)
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ["dim", "b", "q"]

    def best(asked: DataFrame) -> DataFrame:
        return left.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")

    first = cut(best(right.withColumn("most", F.lit(float("inf")))))
    # The k-th distance of the first block; none where it holds fewer.
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "far")
    rest = right.join(bound, "vec_id", "left").withColumn("most", F.coalesce("far", F.lit(float("inf"))))
    elsewhere = F.explode(F.expr(f"filter(sequence(0L, {blocks - 1}L), x -> x <> b)"))
    found = first.union(best(rest.select("vec_id", "embedding", "dim", "q", "most", elsewhere.alias("b"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
