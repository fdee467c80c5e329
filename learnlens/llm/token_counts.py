"""Token counts by section, from one encoding of the whole document.

A document is encoded once, and each token's place is known from the lengths of the tokens before it. Token spans meet section
spans in an interval join inside the document. A token that crosses a boundary goes to the section that holds most of its bytes,
ties to the earlier one; a token in no section counts as outside (section null). Nothing is encoded twice, so the
counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.byte_bpe import default_path, load
from learnlens.llm.common import bounded_batches, record, slices, texts

#: Sections of a text in order, without overlap, as (begin, end) in code points.
Cutter = Callable[[str], list[tuple[int, int]]]

OUT = [("doc_id", pa.int64()), ("section", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]
OUT_DDL = "doc_id long, section int, begin long, end long, n_tokens long, n_crossing long"


def lines(text: str) -> list[tuple[int, int]]:
    """Each line with the newline that ends it. An empty text has no line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return [x for x in out if x[0] < x[1]]


def byte_places(text: str, chars: np.ndarray) -> np.ndarray:
    """Where characters begin in the text's UTF-8 form."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) == len(text):
        return chars
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[chars]


def allocate(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether the token reaches beyond it. Sections are in order and do not overlap."""
    first = np.searchsorted(stops, starts, side="right")
    after = np.searchsorted(begins, ends, side="left")
    section = np.where(after > first, first, -1)
    for t in np.flatnonzero(after - first > 1).tolist():
        own = np.arange(first[t], after[t])
        section[t] = own[(np.minimum(stops[own], ends[t]) - np.maximum(begins[own], starts[t])).argmax()]
    inside = section >= 0
    crossing = np.zeros(len(starts), dtype=bool)
    crossing[inside] = (starts[inside] < begins[section[inside]]) | (ends[inside] > stops[section[inside]])
    return section, crossing


def count_by_section(docs: DataFrame, cutter: Cutter = lines, tokenizer: str | None = None) -> DataFrame:
    """doc_id, section (from 0), begin, end (code points), n_tokens, n_crossing: a row per section of every row of `docs` (doc_id, text).

    n_crossing counts the section's tokens that reach beyond it. Tokens in no section make one more row with a null section.
    A null or empty text has no rows with the default cutter. Repeated rows are counted each; other columns are ignored.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {name: [] for name, _ in OUT}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part)):
                    spans = np.array(cutter(text), dtype=np.int64).reshape(-1, 2)
                    sizes = encoder.sizes[encoder.encode(text)]
                    ends = np.cumsum(sizes)
                    section, crossing = allocate(ends - sizes, ends, byte_places(text, spans[:, 0]), byte_places(text, spans[:, 1]))
                    n = np.bincount(section + 1, minlength=len(spans) + 1).tolist()
                    over = np.bincount(section[crossing] + 1, minlength=len(spans) + 1).tolist()
                    k = len(spans)
                    out["doc_id"] += [doc_id] * k
                    out["section"] += range(k)
                    out["begin"] += spans[:, 0].tolist()
                    out["end"] += spans[:, 1].tolist()
                    out["n_tokens"] += n[1:]
                    out["n_crossing"] += over[1:]
                    if n[0]:
                        for name, value in zip(out, (doc_id, None, None, None, n[0], 0)):
                            out[name].append(value)
                yield record(out, OUT)

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, OUT_DDL)
