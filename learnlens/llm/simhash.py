"""Near-duplicate documents by SimHash, searched with the generalised pigeonhole principle.

Fingerprints are 64 bits from the XXH64 hashes of word shingles. Two documents link when their fingerprints differ in at
most `distance` bits. The search never compares all pairs:

1. Equal fingerprints are one class; only distinct fingerprints are searched, so a hot group of copies is one row.
2. Correlated bits are grouped into `parts` partitions (from a 64 x 64 table of bit counts over all fingerprints).
3. The principle in its general form: if two fingerprints differ in at most T bits and part thresholds add up to
   T - parts + 1, at least one part differs in no more bits than its threshold (-1 leaves the part out). Each fingerprint
   gets its own thresholds, by dynamic programming over the cost of a part at a threshold: the probes it takes plus
   the candidates it is expected to meet. The expectation comes from value counts of 8-bit pieces over all fingerprints.
4. A fingerprint probes each part with all values within its threshold; what it meets is verified on all 64 bits.

A fingerprint can link to no more than sum(C(64, k), k <= distance) others (43,744 for 3), whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.common import bounded_batches, cut, slices, texts
from learnlens.llm.components import connected_components

SEED = 42
BITS = 64
PIECE = 8
MOST_SENT = 1_000_000  # ids of 8 bytes
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included. Fewer words than a shingle: one hash of the whole sequence; none: empty."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(found) <= words:
        return np.array([digest(b" ".join(found), seed)], dtype=np.uint64)
    if words == 3:
        return np.array([digest(b"%b %b %b" % x, seed) for x in zip(found, found[1:], found[2:])], dtype=np.uint64)
    return np.array([digest(b" ".join(found[i : i + words]), seed) for i in range(len(found) - words + 1)], dtype=np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is set if it is set in over half of the hashes; no words: zero."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """`doc_id, fp` (64 bits as a signed long) of every row, over the whole text. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t, words) for t in texts(part)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, in how many both are set. The result has one row per pair of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            ones = unpacked(batch.column("fp").to_numpy()).astype(np.float32)
            total += ones.T @ ones
            rows += len(ones)
        if rows:
            both = np.append(total.ravel(), rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(BITS * BITS + 1)
    for cell, n in cells:
        table[cell] = n
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(rows: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Split the bits into equal groups; each takes, one at a time, the bit most correlated with those it has."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tie = np.abs(both / max(rows, 1) - np.outer(p, p)) / spread
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        own = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (tie[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(own)
    return out


def part_values(ones: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The bits of each part as one number: a row per fingerprint, a column per part."""
    return np.stack([ones[:, own].astype(np.int64) @ (np.int64(1) << np.arange(len(own), dtype=np.int64)) for own in parts], axis=1)


def piece_counts(distinct: DataFrame, parts: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """How often each value of each 8-bit piece of a part occurs: at most 8 * 256 rows reach the driver."""
    pieces = [(i, j, own[j : j + PIECE]) for i, own in enumerate(parts) for j in range(0, len(own), PIECE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pieces), 1 << PIECE), dtype=np.int64)
        for batch in batches:
            values = part_values(unpacked(batch.column("fp").to_numpy()), [own for _, _, own in pieces])
            for k in range(len(pieces)):
                total[k] += np.bincount(values[:, k], minlength=1 << PIECE)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "n"])

    out = {(i, j): np.zeros(1 << PIECE) for i, j, _ in pieces}
    for cell, n in distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        i, j, _ = pieces[cell >> PIECE]
        out[i, j][cell & ((1 << PIECE) - 1)] = n
    return out


def candidates_by_distance(counts: dict[tuple[int, int], np.ndarray], parts: list[list[int]], rows: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """For each piece and value, the share of fingerprints whose piece differs from it in 0..most bits."""
    values = np.arange(1 << PIECE)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    return {key: np.stack([(apart == k) @ n for k in range(most + 1)], axis=1) / max(rows, 1) for key, n in counts.items()}


def probe_counts(parts: list[list[int]], distance: int) -> np.ndarray:
    """Values within each threshold of a part's value; column 0 is threshold -1, which takes none."""
    return np.array([[0] + [sum(comb(len(own), k) for k in range(t + 1)) for t in range(distance + 1)] for own in parts], dtype=float)


def allocate(values: np.ndarray, parts: list[list[int]], near: dict[tuple[int, int], np.ndarray], rows: int, distance: int) -> np.ndarray:
    """Thresholds (-1..distance) per fingerprint and part that add up to distance - parts + 1 at the least expected cost."""
    n, m = values.shape
    probes = probe_counts(parts, distance)
    cost = np.zeros((n, m, distance + 2))
    for i, own in enumerate(parts):
        spread = np.zeros((n, distance + 1))
        spread[:, 0] = 1
        for j in range(0, len(own), PIECE):
            piece = near[i, j][(values[:, i] >> j) & ((1 << min(PIECE, len(own) - j)) - 1)]
            spread = np.stack([sum(spread[:, a] * piece[:, k - a] for a in range(k + 1)) for k in range(distance + 1)], axis=1)
        cost[:, i, 1:] = rows * np.cumsum(spread, axis=1)
        cost[:, i] += probes[i]
    # Thresholds are shifted by one, so that those of all parts add up to distance + 1.
    best = np.full((n, distance + 2), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, n, distance + 2), dtype=np.int64)
    for i in range(m):
        options = np.full((n, distance + 2, distance + 2), np.inf)
        for used in range(distance + 2):
            for own in range(distance + 2 - used):
                options[:, used + own, own] = best[:, used] + cost[:, i, own]
        choice[i] = options.argmin(axis=2)
        best = options.min(axis=2)
    out, left = np.zeros((n, m), dtype=np.int64), np.full(n, distance + 1)
    for i in reversed(range(m)):
        out[:, i] = choice[i][np.arange(n), left]
        left -= out[:, i]
    return out - 1


def masks(width: int, distance: int) -> list[np.ndarray]:
    """The masks that change exactly 0, 1, .. `distance` bits of a part."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], dtype=np.int64) for k in range(distance + 1)]


def links(distinct: DataFrame, distance: int = 3, parts: int = 2) -> DataFrame:
    """`a, b` (a < b): pairs of distinct fingerprints that differ in at most `distance` bits. Input: column fp, no repeats."""
    rows, both = bit_counts(distinct)
    groups = group_bits(rows, both, parts)
    near = candidates_by_distance(piece_counts(distinct, groups), groups, rows, distance)
    flips = [masks(len(own), distance) for own in groups]

    def data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            values = part_values(unpacked(fps), groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(fps))), pa.array(values.ravel()), pa.array(np.repeat(fps, parts))], names=["part", "value", "b"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 1024):
                some = fps[at : at + 1024]
                values = part_values(unpacked(some), groups)
                thresholds = allocate(values, groups, near, rows, distance)
                for i in range(parts):
                    for k in range(distance + 1):
                        who = np.flatnonzero(thresholds[:, i] >= k)
                        for part in np.array_split(who, max(1, len(who) * len(flips[i][k]) >> 18)):
                            if len(part):
                                value = (values[part, i][:, None] ^ flips[i][k][None, :]).ravel()
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, dtype=np.int32)), pa.array(value), pa.array(np.repeat(some[part], len(flips[i][k])))], names=["part", "value", "a"])

    shape = "part int, value long, {} long"
    met = distinct.select("fp").mapInArrow(probes, shape.format("a")).join(distinct.select("fp").mapInArrow(data, shape.format("b")), ["part", "value"])
    # Every pair is met from both ends: keep one of them.
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()


def _placed(docs: DataFrame, words: int, distance: int, parts: int) -> DataFrame:
    """doc_id, fp, root, component_id of every row of `docs`; root is the component's smallest fingerprint."""
    marked = cut(fingerprints(docs, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct, distance, parts), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # All rows of a hot fingerprint meet one row; the join can be split, as nothing above it needs them together.
    return marked.join(placed.join(component, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, parts: int = 2) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id reachable through links. Null and wordless texts have fingerprint zero and link
    like any other. Repeated rows come back as often as they came; rows without doc_id come back with the component of their
    fingerprint, or a null one if no document there has an id. An empty table gives an empty result.
    """
    return _placed(docs, words, distance, parts).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = 3, distance: int = 3, parts: int = 2, most_sent: int = MOST_SENT) -> DataFrame:
    """One row of `docs`, with all its columns, for each component: that of the smallest doc_id, ids before none.

    Rows are told apart by id and fingerprint. Where an id comes with several texts, each text stays or goes with its own component; of
    several texts of the smallest id in one component the one with the smallest fingerprint stays, and of rows alike in both the smallest by
    text and then by a hash of the other columns. An empty table gives an empty result.

    Ids that come once are decided by themselves: up to `most_sent` ids that go are sent to every task, so that no text is shuffled; more of them
    meet the documents in a shuffle join. Only rows whose id is null or repeated are fingerprinted again.
    """
    placed = cut(_placed(docs, words, distance, parts))
    ids = cut(placed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), F.min("component_id").alias("least")))
    own = "id" + "_" * max(map(len, docs.columns))  # a name that no column of the documents has
    gone = ids.where("times = 1 and doc_id <> least").select(F.col("doc_id").alias(own))
    again = ids.where("times > 1").select(F.col("doc_id").alias(own))
    sent = lambda some: F.broadcast(some) if some.count() <= most_sent else some
    doc_id = F.col("doc_id").cast("long")
    same = doc_id == F.col(own)
    kept = docs.where(doc_id.isNotNull()).join(sent(gone), same, "left_anti")
    odd = []
    if not again.isEmpty():
        again = sent(again)
        kept = kept.join(again, same, "left_anti")
        odd.append(docs.join(again, same, "left_semi"))
    if not placed.where("doc_id is null").isEmpty():
        odd.append(docs.where(doc_id.isNull()))
    for rows in odd:
        kept = kept.union(_winners(rows, placed, words, own))
    return kept


def _winners(rows: DataFrame, placed: DataFrame, words: int, own: str) -> DataFrame:
    """Those of `rows` that stay for their component, once each."""

    @F.pandas_udf("long")
    def fp(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", words) for t in column], dtype=np.uint64).view(np.int64))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    best = placed.groupBy("root").agg(first.alias("w")).select(F.col("w.doc_id").alias(own), F.col("w.fp").alias(own + "f"))
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    marked = rows.select(F.struct(*rows.columns).alias("row"), F.col("doc_id").cast("long").alias("i"), fp(F.col("text").cast("string")).alias("f"), F.struct(F.col("text"), F.xxhash64(F.lit(0), *others)).alias("order"))
    met = marked.join(best, F.col("i").eqNullSafe(F.col(own)) & (F.col("f") == F.col(own + "f")), "left_semi")
    return met.groupBy("i", "f").agg(F.min_by("row", "order").alias("row")).select("row.*")
