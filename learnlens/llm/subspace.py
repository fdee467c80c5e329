"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors with cosine c or more are at a squared distance of at most 2 - 2c. Vectors are rotated to their principal axes, the axes are dealt
to `blocks` low-dimensional blocks, and each block gets a share of the squared distance in proportion to its variance. If two
vectors are near, at least one block keeps to its share. Each block is joined by range: a grid over its leading axes, with
cells twice as wide as the block's radius, brings together a vector's home cell and the cells its radius reaches. Within a cell, the rows at home
meet each other and the visitors: both sides are halved again and again along the widest axis of the block, with the radius as margin, so that what is
left to compare comes near what keeps to the share. Such pairs are verified on the original vectors. A pair counts in the first block that
keeps to its share, so the union of all blocks holds it once.

Equal vectors are one class with a count; cells are cut into tiles, so that a hot cell is spread over many tasks; links are counted
where they are found, and only a spanning forest of each tile leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.common import cut
from learnlens.llm.components import connected_components
from learnlens.llm.vectors import element, matrix, packed, usable

BLOCKS = 4
AXES = 2
TILE = 49_152
LEAF = 1 << 18  # pairs that are compared without another split
_SLACK = 1e-9


class Rotation:
    """Principal axes dealt to blocks: each block's axes (columns of `axes`), and its radius."""

    def __init__(self, second: np.ndarray, reach: float, blocks: int):
        variance, axes = np.linalg.eigh(second)
        variance, axes = np.maximum(variance[::-1], 0), axes[:, ::-1]
        blocks = min(blocks, len(variance))
        deal = [i % (2 * blocks) for i in range(len(variance))]
        owner = np.array([d if d < blocks else 2 * blocks - 1 - d for d in deal])  # there and back, so that shares are alike
        self.parts = [np.flatnonzero(owner == b) for b in range(blocks)]
        weight = np.array([variance[p].sum() for p in self.parts])
        weight = np.maximum(weight / max(weight.sum(), 1e-300), 1e-6)
        self.axes = axes
        self.budget = reach * weight / weight.sum() * (1 + _SLACK) + 1e-12
        self.radius = np.sqrt(self.budget)

    def turn(self, x: np.ndarray) -> list[np.ndarray]:
        unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        y = unit @ self.axes
        return [y[:, p] for p in self.parts]


def _second_moments(vectors: DataFrame, kind: str, dim: int) -> np.ndarray:
    """Mean-free second moments of all unit vectors, summed in tasks: dim * (dim + 1) sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            x = matrix(batch.column("embedding").to_pylist(), kind) if batch.num_rows else np.zeros((0, dim))
            unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
            total += np.concatenate([unit.T @ unit, unit.sum(axis=0, keepdims=True)])
            rows += len(x)
        if rows:
            flat = np.append(total.ravel(), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])

    flat = np.zeros((dim + 1) * dim + 1)
    for cell, v in vectors.select("embedding").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        flat[cell] = v
    n, sums = max(flat[-1], 1), flat[:-1].reshape(dim + 1, dim)
    mean = sums[-1] / n
    return sums[:-1] / n - np.outer(mean, mean)


def _cells(y: np.ndarray, radius: float, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home): the home cell of every row, and for each other cell its radius reaches that comes after home, a visit."""
    y = y[:, :axes]
    home = np.floor(y / (2 * radius)).astype(np.int64)
    low, high = np.floor((y - radius) / (2 * radius)).astype(np.int64), np.floor((y + radius) / (2 * radius)).astype(np.int64)
    yield np.arange(len(y)), home, True
    for step in product((-1, 0, 1), repeat=y.shape[1]):
        step = np.array(step)
        if tuple(step) > (0,) * len(step):
            cell = home + step
            rows = np.flatnonzero(((cell >= low) & (cell <= high)).all(axis=1))
            yield rows, cell[rows], False


def _key(cells: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cells), dtype=np.int64)
    for column in cells.T:
        out = out * (1 << 16) + (column + (1 << 15))
    return out


class _Near:
    """The rows of a cell in one block, from which pairs within the block's budget are searched."""

    def __init__(self, y: np.ndarray, budget: float):
        self.y = np.ascontiguousarray(y, dtype=np.float32)
        norm = (self.y**2).sum(axis=1, keepdims=True)
        one = np.ones_like(norm)
        # One product of these gives all squared distances.
        self.left, self.right = np.concatenate([-2 * self.y, norm, one], axis=1), np.concatenate([self.y, one, norm], axis=1)
        self.budget, self.reach = np.float32(budget + 1e-5), float(np.sqrt(budget)) + 1e-5

    def pairs(self, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row of `left` and one of `right`, without common rows; or, without `right`, all pairs within `left`, once each."""
        todo = [(left, left if right is None else right, right is None)]
        while todo:
            a, b, same = todo.pop()
            axis = None
            if len(a) * len(b) > LEAF:
                some = np.concatenate([self.y[a], self.y[b]])
                low, high = some.min(axis=0), some.max(axis=0)
                axis = int((high - low).argmax())
            if axis is None or high[axis] - low[axis] < 3 * self.reach:  # no axis tells enough rows apart
                yield from self._compared(a, b, same)
                continue
            # Rows across the middle that can be near are no further apart than twice the reach, so this comes to an end.
            middle = np.median(some[:, axis])
            middle = middle if middle > low[axis] else (low[axis] + high[axis]) / 2
            x, z = self.y[a, axis], self.y[b, axis]
            low, high = (a[x < middle], b[z < middle]), (a[x >= middle], b[z >= middle])
            todo += [(*low, same), (*high, same), (a[(x < middle) & (x > middle - self.reach)], b[(z >= middle) & (z < middle + self.reach)], False)]
            if not same:
                todo.append((a[(x >= middle) & (x < middle + self.reach)], b[(z < middle) & (z > middle - self.reach)], False))

    def _compared(self, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(a), 512):
            for j in range(i if same else 0, len(b), 2048):
                some, others = a[i : i + 512], b[j : j + 2048]
                hit = np.flatnonzero((self.left[some] @ self.right[others].T).ravel() <= self.budget)
                if len(hit):
                    p, q = hit // len(others), hit % len(others)
                    if same:
                        keep = i + p < j + q
                        p, q = p[keep], q[keep]
                    yield some[p], others[q]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each row through the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def near_vectors(vectors: DataFrame, cosine: float = 0.95, blocks: int = BLOCKS, axes: int = AXES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding; all else is ignored).

    Vectors that are null, zero or hold null or non-finite components, and vectors without an id, link with nothing; only vectors of one
    length are compared. Rows of equal vectors link with each other, repeated rows too. component_id is the smallest vec_id
    reachable, the row's own included. An empty table gives an empty result.
    """
    kind = element(vectors, "embedding")
    exact = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), exact.alias("embedding"), good.alias("good"))
    # Two 64-bit hashes stand for a vector from here on.
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit("second"), F.col("embedding")).alias("k2")]
    classes = cut(packed(rows.where("good").select("vec_id", "embedding", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")).select("id", "n", "k1", "k2", "embedding")))
    found = [_links_of(classes.where(F.col("dim") == d), kind, d, 2 - 2 * cosine, cosine, blocks, axes, tile) for (d,) in classes.select("dim").distinct().collect()]
    if found:
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        links = cut(links)
        counted = links.groupBy("id").agg(F.sum("links").alias("links"))
        roots = connected_components(links.select("id", "root").where("id != root"), "id", "root").withColumnRenamed("node", "id")
        placed = classes.select("k1", "k2", "id", "n").join(counted, "id", "left").join(roots, "id", "left")
    else:
        placed = classes.select("k1", "k2", "id", "n", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("root"))
    result = rows.select("vec_id", F.when(F.col("good"), keys[0]).alias("k1"), F.when(F.col("good"), keys[1]).alias("k2")).join(placed, ["k1", "k2"], "left")
    component = F.coalesce("root", "id", "vec_id")
    return result.select(
        "vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def _links_of(classes: DataFrame, kind: str, dim: int, reach: float, cosine: float, blocks: int, axes: int, tile: int) -> DataFrame:
    """id, links, root per class and tile: how many vectors it links with there, and the smallest class it reaches there."""
    turn = Rotation(_second_moments(classes, kind, dim), reach, blocks)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        x = matrix(batch.column("embedding").to_pylist(), kind)
        for block, y in enumerate(turn.turn(x)):
            for who, cells, home in _cells(y, float(turn.radius[block]), axes):
                yield block, who, _key(cells), home

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, key, _ in placed(batch) if batch.num_rows else ():
                cells, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), block)), pa.array(cells), pa.array(n)], names=["block", "cell", "n"])

    # Cells are as wide as the threshold allows and unit vectors end at 1, so their number is bounded whatever the number of vectors.
    count = classes.select("embedding").mapInArrow(sizes, "block long, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n"))
    chunks = {(r.block, r.cell): -(-r.n // tile) for r in count.where(F.col("n") > tile).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                ids = batch.column("id").to_numpy()
                for block, who, key, home in placed(batch):
                    split = np.array([chunks.get((block, k), 1) for k in key.tolist()], dtype=np.int64)
                    for parts in np.unique(split):
                        some, cell = who[split == parts], key[split == parts]
                        own = (ids[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts
                        for other in range(parts):
                            tiles = np.minimum(own, other) * parts + np.maximum(own, other)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(some), block)), pa.array(cell), pa.array(tiles), pa.array(own), pa.array(np.full(len(some), home)), batch.column("id").take(pa.array(some)), batch.column("n").take(pa.array(some)), batch.column("embedding").take(pa.array(some))],
                                names=["block", "cell", "tile", "own", "home", "id", "n", "embedding"],
                            )

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        block, ids, n = int(rows["block"].iloc[0]), rows["id"].to_numpy(), rows["n"].to_numpy()
        x = matrix(rows["embedding"], kind)
        unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        turned = turn.turn(x)
        own, home = rows["own"].to_numpy(), rows["home"].to_numpy()
        links = np.zeros(len(ids), dtype=np.int64)
        lefts, rights = [], []
        near = _Near(turned[block], float(turn.budget[block]))
        one, other = own == own.min(), own == own.max()
        if own.min() == own.max():
            met = [near.pairs(np.flatnonzero(home)), near.pairs(np.flatnonzero(home), np.flatnonzero(~home))]
        else:  # of two chunks only pairs across; those within one are in the tile of that chunk alone
            met = [near.pairs(np.flatnonzero(one & home), np.flatnonzero(other)), near.pairs(np.flatnonzero(one & ~home), np.flatnonzero(other & home))]
        for left, right in chain.from_iterable(met):
            for at in range(0, len(left), 1 << 16):
                i, j = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                keep = (unit[i] * unit[j]).sum(axis=1) >= cosine
                i, j = i[keep], j[keep]
                first = ((turned[block][i] - turned[block][j]) ** 2).sum(axis=1) <= turn.budget[block]
                for b in range(block):
                    first &= ((turned[b][i] - turned[b][j]) ** 2).sum(axis=1) > turn.budget[b]
                i, j = i[first], j[first]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                lefts.append(i)
                rights.append(j)
        i, j = (np.concatenate(s) if s else np.zeros(0, dtype=np.int64) for s in (lefts, rights))
        linked = np.flatnonzero(links)
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = ids[order[_forest(place[i], place[j], len(ids))]][place]
        return pd.DataFrame({"id": ids[linked], "links": links[linked], "root": root[linked]})

    spread = classes.select("id", "n", "embedding").mapInArrow(dealt, "block long, cell long, tile long, own long, home boolean, id long, n long, embedding binary")
    return spread.groupBy("block", "cell", "tile").applyInPandas(joined, "id long, links long, root long")
