"""Benchmark passages in training documents, by an FM-index over each shard of the documents.

Benchmark items are cut into windows of `size` consecutive words (shorter items are one window). Every task turns its documents into shards of
bounded size and builds an FM-index of each: words as numbers, suffix order, wavelet tree over the preceding words. All windows are
searched at once from their last word to their first; occurrences are located by sampled suffix places, and the spans they cover are merged per document.

Words that no item holds are one symbol, a break that no window crosses; stretches between breaks that are shorter than the shortest window are
left out of the index, as nothing can occur there. Documents are never shuffled: a passage in a third of all documents costs each
shard its own occurrences and nothing else. Documents longer than a shard are indexed in stretches that overlap by one word less than the longest window.

Items are sent to all tasks in parts of at most about `part_bytes` of text. A larger benchmark takes several passes, chained in one job without a
shuffle, so that what is sent at once stays bounded.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from learnlens.llm.common import bounded_batches, slices
from learnlens.llm.fm_index import FMIndex

SIZE = 10
SHARD = 1 << 20  # words
PART_BYTES = 16 << 20
# Word bytes are digits, a-z and all bytes of characters beyond ASCII; A-Z become a-z, all else separates.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
BREAK, FIRST = 1, 2  # 0 ends a shard's text
SPAN = "array<struct<start: bigint, stop: bigint, char_start: bigint, char_stop: bigint>>"
_SPAN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop", "char_start", "char_stop")]))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_FOLD).split()


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in code points."""
    ends = np.array([m.span() for m in _RUN.finditer(text.translate(_FOLD))], dtype=np.int64).reshape(-1, 2)
    points = np.append(0, np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))
    return points[ends[:, 0]], points[ends[:, 1]]


class Phrases:
    """The distinct windows of some items, as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        self.numbers: dict[bytes, int] = {}
        places: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + FIRST) for w in words(text or b"")]
            for i in range(max(len(own) - size, 0) + 1 if own else 0):
                places[tuple(own[i : i + size])].add(item)
        self.items = [sorted(x for x in found if x is not None) for found in places.values()]
        self.lengths = np.array([len(w) for w in places], dtype=np.int64)
        self.windows = np.array([w + (0,) * (size - len(w)) for w in places], dtype=np.int64).reshape(-1, size)
        self.least, self.longest = int(self.lengths.min(initial=size)), int(self.lengths.max(initial=0))

    def found_in(self, docs: list[list[bytes]], shard: int = SHARD) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """For documents (as words) with occurrences: the merged spans of words, and the items."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        get = self.numbers.get
        batch: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for k, own in enumerate(docs):
            numbers = np.fromiter(map(get, own, repeat(BREAK)), dtype=np.int64, count=len(own))
            for a in range(0, max(len(numbers) - self.longest + 1, 1), shard):
                part = numbers[a : a + shard + self.longest - 1]
                if held and held + len(part) > shard:
                    self._search(batch, spans, items)
                    batch, held = [], 0
                batch.append((k, a, part))
                held += len(part)
        if batch:
            self._search(batch, spans, items)
        return {k: _merged(own) for k, own in spans.items()}, items

    def _search(self, batch: list[tuple[int, int, np.ndarray]], spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> None:
        """One shard: index the stretches that can hold a window, search, locate, cover."""
        gap = np.array([BREAK], dtype=np.int64)
        whole = np.concatenate([x for _, _, part in batch for x in (part, gap)])
        begins = np.append(0, np.cumsum([len(part) + 1 for _, _, part in batch]))[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], whole != BREAK, [False]]).astype(np.int8)))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        starts, sizes = starts[sizes >= self.least], sizes[sizes >= self.least]
        if not len(starts):
            return
        # The text: each stretch and the break after it, then the end.
        text_starts = np.append(0, np.cumsum(sizes + 1))[:-1]
        from_whole = np.repeat(starts - text_starts, sizes + 1) + np.arange((sizes + 1).sum())
        used, numbers = np.unique(np.append(BREAK, whole[from_whole]), return_inverse=True)
        text = np.append(numbers[1:] + 1, 0)
        # Only windows whose words all occur here, in this shard's own numbers.
        known = np.full(len(self.numbers) + FIRST, -1)
        known[used] = np.arange(len(used)) + 1
        known[0] = 0
        patterns = known[self.windows]
        here = np.flatnonzero((patterns >= 0).all(axis=1))
        if not len(here):
            return
        index = FMIndex(text, len(used) + 1)
        low, high = index.search(patterns[here], self.lengths[here])
        n = high - low
        which = np.repeat(here, n)
        if not len(which):
            return
        rows = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(len(which))
        at = from_whole[index.locate(rows)]
        cover = np.bincount(at, minlength=len(whole) + 1) - np.bincount(at + self.lengths[which], minlength=len(whole) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover)[: len(whole)] > 0, [False]]).astype(np.int8)))
        owner = np.searchsorted(begins, edges[::2], side="right") - 1
        for a, b, o in zip(edges[::2].tolist(), edges[1::2].tolist(), owner.tolist()):
            k, offset, _ = batch[o]
            move = offset - int(begins[o])
            spans[k].append((a + move, b + move))
        pairs = np.unique((np.searchsorted(begins, at, side="right") - 1) * len(self.lengths) + which)
        for o, w in zip((pairs // len(self.lengths)).tolist(), (pairs % len(self.lengths)).tolist()):
            items[batch[o][0]].update(self.items[w])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that meet or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, size: int, part_bytes: int) -> Iterator[Phrases]:
    """The items in parts of bounded size, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield Phrases([(r.item, bytes(r.text)) for r in own.collect()], size)


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, part_bytes: int = PART_BYTES, shard: int = SHARD, cleaned: bool = False) -> DataFrame:
    """doc_id, n_words, spans, items for every row of `docs` (doc_id, text); `benchmark` has item_id, text. Other columns are ignored.

    `spans` are the merged spans that occurrences of windows cover, in page order: start and stop in words, char_start and char_stop in code points of the
    text, the stop outside. `items` are the ids, as strings, of the items with an occurring window. With `cleaned` a column `text` follows:
    the text without its spans, null where it was null.

    Null and wordless texts have no words and no spans; such items have no windows. Windows of items without an id cover words, but name no item.
    Repeated documents come back each; rows of one item_id are one item. An empty benchmark leaves all spans empty, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = [spark.sparkContext.broadcast(p) for p in _parts(benchmark, size, part_bytes)]
    doc_id: Column = F.col("doc_id").cast("long")
    rows = bounded_batches(docs).select(doc_id.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for number, part in enumerate(held):
        last = number == len(held) - 1
        shape = "doc_id long, text binary, n_words long, spans {s}, items array<string>" if cleaned or not last else "doc_id long, n_words long, spans {s}, items array<string>"
        rows = rows.mapInArrow(_pass(part, shard, cleaned or not last), shape.format(s=SPAN))
    if not cleaned:
        return rows
    return rows.mapInArrow(_cut_out, f"doc_id long, n_words long, spans {SPAN}, items array<string>, text string")


def _pass(part: object, shard: int, with_text: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = part.value
        for batch in batches:
            for some in slices(batch, "text"):
                raw = [x or b"" for x in some.column("text").to_pylist()]
                docs = [words(x) for x in raw]
                found, items = phrases.found_in(docs, shard) if len(phrases.lengths) else ({}, {})
                spans, names = [x or [] for x in some.column("spans").to_pylist()], [x or [] for x in some.column("items").to_pylist()]
                for k, own in found.items():
                    begin, end = word_places(raw[k])
                    merged = _merged(own + [(x["start"], x["stop"]) for x in spans[k]])
                    spans[k] = [{"start": a, "stop": b, "char_start": int(begin[a]), "char_stop": int(end[b - 1])} for a, b in merged]
                    names[k] = sorted(items.get(k, set()) | set(names[k]))
                columns = {"doc_id": some.column("doc_id"), "text": some.column("text"), "n_words": pa.array([len(x) for x in docs], type=pa.int64()), "spans": pa.array(spans, type=_SPAN), "items": pa.array(names, type=pa.list_(pa.string()))}
                if not with_text:
                    del columns["text"]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            left, at = [], 0
            text = None if text is None else text.decode("utf-8", "replace")
            for span in spans:
                left.append(text[at : span["char_start"]])
                at = span["char_stop"]
            out.append(text if text is None else "".join(left) + text[at:])
        names = ["doc_id", "n_words", "spans", "items"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, type=pa.string())], names=[*names, "text"])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from a result of `occurrences`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
