"""Packing token sequences: few sequences of at most `capacity` tokens, documents cut only where they are longer.

Every document is encoded once; ids never leave the task, only the length and checksum of its pieces do. Pieces are dealt to
groups of bounded size by a hash. A group is packed best fit, largest first, and improved by local search: documents are
moved, exchanged one for one or two for one between underfull bins whenever that raises the sum of squared fills, so that some
bins fill up and others empty. What a group cannot fill goes to the next round, where such rests of many groups meet again in
groups of the same bounded size, until one group is left or a round saves no bin. The last round, also where a bound on rounds ends them, keeps all its bins.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.byte_bpe import default_path, load
from learnlens.llm.common import bounded_batches, cut, record, slices, texts

CAPACITY = 2048
END = 0
GROUP = 20_000  # pieces in a group, about
PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())]
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, bin long, offset long, fill long"


def cuts(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin, and its length. The first piece takes what full pieces leave."""
    first = length % capacity or min(length, capacity)
    return [0, *range(first, length + 1, capacity)] if length else [0]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every row of `docs`: doc_id, piece, start, length, ids_crc32, and `deal`, a hash that spreads them.

    A null or empty text is a document of one token, the end mark.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                out = defaultdict(list)
                for doc_id, row, text in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), texts(part)):
                    ids = np.append(encoder.encode(text), np.uint32(END)).astype("<u4")
                    at = cuts(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(at, at[1:])):
                        for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32", "deal"), (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), hash((row, k)))):
                            out[name].append(value)
                yield record(out, PIECE)

    # Rows are spread by their place, not by their id, so that repeats of one id do not meet in one group.
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, PIECE_DDL)


class _Sizes:
    """Things by size, with the nearest size to a limit found by one bit operation."""

    def __init__(self) -> None:
        self.at: defaultdict[int, dict[int, None]] = defaultdict(dict)
        self.mask = 0

    def add(self, size: int, thing: int) -> None:
        self.at[size][thing] = None
        self.mask |= 1 << size

    def drop(self, size: int, thing: int) -> None:
        del self.at[size][thing]
        if not self.at[size]:
            self.mask &= ~(1 << size)

    def last(self, size: int) -> int:
        return next(reversed(self.at[size]))

    def pop(self, size: int) -> int:
        thing = self.last(size)
        self.drop(size, thing)
        return thing

    def up_to(self, limit: int) -> int:
        """The largest size not above the limit; 0 if none."""
        return (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.mask & ((1 << (limit + 1)) - 1) else 0

    def least_from(self, limit: int) -> int:
        """The smallest size not below the limit; 0 if none."""
        rest = self.mask >> limit
        return limit + (rest & -rest).bit_length() - 1 if rest else 0


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free = _Sizes()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = free.least_from(size)
        if room:
            b = free.pop(room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if room > size:
            free.add(room - size, b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, rounds: int = 20) -> list[list[int]]:
    """Raise the sum of squared fills of underfull bins by moves and exchanges; emptied bins go.

    Bins are taken fullest first. Each draws from bins that are not fuller: a piece that fits its room, else a larger piece for
    one of its own, else two pieces for one of its own, so that its fill grows and the other's shrinks. Rounds
    end when one changes nothing; the bound on rounds limits the time, not the pieces.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    home = {i: b for b, own in enumerate(bins) for i in own}
    for _ in range(rounds):
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        if sum(fill[b] for b in open_bins) > (len(open_bins) - 1) * capacity:
            break  # no bin can be saved
        stock = _Sizes()  # the pieces of bins that are still to be taken, which are not fuller than the one at hand
        for b in open_bins:
            for i in bins[b]:
                stock.add(size[i], i)
        changed = False

        def put(i: int, b: int) -> None:
            bins[home[i]].remove(i)
            fill[home[i]] -= size[i]
            bins[b].append(i)
            fill[b] += size[i]
            home[i] = b

        def exchange(b: int, given: int, taken: list[int]) -> tuple[int, int, list[int], int]:
            """What taking pieces for one would add to the sum of squared fills; the emptier source gets the given piece."""
            after = {b: fill[b] - size[given] + sum(size[t] for t in taken)}
            for t in taken:
                after[home[t]] = after.get(home[t], fill[home[t]]) - size[t]
            target = min((home[t] for t in taken), key=lambda x: (after[x], x))
            after[target] += size[given]
            gain = sum(f * f - fill[x] ** 2 for x, f in after.items()) if after[target] <= capacity else 0
            return gain, given, taken, target

        for b in open_bins:
            for i in bins[b]:
                stock.drop(size[i], i)
            while 0 < fill[b] < capacity:
                room = capacity - fill[b]
                got = stock.up_to(room)
                if got:
                    put(stock.pop(got), b)
                    changed = True
                    continue
                best: tuple[int, int, list[int], int] = (0, -1, [], -1)
                for i in bins[b]:
                    want = size[i] + room
                    one, half = stock.up_to(want), stock.up_to(want // 2)
                    pair: list[int] = []
                    if half:
                        a = stock.pop(half)
                        other = stock.up_to(want - half)
                        pair = [a, stock.last(other)] if other else []
                        stock.add(half, a)
                    for take in ([stock.last(one)] if one else [], pair):
                        if take and sum(size[t] for t in take) > size[i]:
                            best = max(best, exchange(b, i, take))
                gain, given, taken, target = best
                if gain <= 0:
                    break
                for t in taken:
                    stock.drop(size[t], t)
                    put(t, b)
                put(given, target)
                stock.add(size[given], given)
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill for every piece of a group."""
    bin_of, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    for b, own in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        own.sort()
        ends = np.cumsum(lengths[own])
        bin_of[own], offset[own], fill[own] = b, ends - lengths[own], ends[-1]
    return bin_of, offset, fill


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, group: int = GROUP, rest: float = 0.995, rounds: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs` (doc_id, text).

    Bins filled to less than `rest` of the capacity go to the next round; after the last of `rounds` (1 to 64) they stay as they are. Null texts are empty, null ids stay null, repeated rows
    are packed as often as they come, other columns are ignored, and an empty table gives an empty result.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["deal", "doc_id", "piece"], ignore_index=True)
        bin_of, offset, fill = pack_group(rows["length"].to_numpy(), capacity)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "deal"]].assign(bin=bin_of * (1 << 24) + int(key[0]), offset=offset, fill=fill)

    left = cut(pieces(docs, capacity, tokenizer))
    closed: list[DataFrame] = []
    bins = None
    for step in range(rounds):
        n = left.count()
        if not n and closed:
            break
        groups = max(1, round(n / group))
        packed = cut(left.withColumn("g", F.pmod(F.xxhash64("deal", F.lit(step)), F.lit(groups))).groupBy("g").applyInPandas(run, PACKED_DDL))
        packed = packed.withColumn("sequence_id", F.col("bin") * 64 + step)
        open_bins = F.col("fill") < int(rest * capacity)
        now = packed.where(open_bins & (F.col("offset") == 0)).count()
        if groups == 1 or step == rounds - 1 or (bins is not None and now >= bins):
            closed.append(packed)
            break
        bins = now
        closed.append(packed.where(~open_bins))
        left = packed.where(open_bins).select("doc_id", "piece", "start", "length", "ids_crc32", "deal")
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
