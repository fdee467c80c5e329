"""Language of whole texts by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 characters, words padded with one blank), most frequent first. A
document's own list is compared with each: every n-gram adds the difference of its two ranks, or the length of the profile
where the language lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from learnlens.llm.common import bounded_batches, held_out, slices, texts

PROFILE = 400
NONE = "und"
#: Documents that the profile of a language is taken from, at most: the first in the order of a hash of their id.
SAMPLE = 2_000
_SHIFT = 21


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower case, or a blank where it is no letter. Letters whose lower case is longer stay as they are."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.int64)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as numbers (21 bits a character) and their counts. No letter: both empty."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    letters = _folded()[np.concatenate([[32], code, [32]])]
    one = letters != 32
    keep = one.copy()
    keep[1:] |= one[:-1]
    keep[:-1] |= one[1:]
    letters, one = letters[keep], one[keep]  # blanks that touch no letter go
    if not one.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    two = (letters[:-1] << _SHIFT) | letters[1:]
    three = (two[:-1] << _SHIFT) | letters[2:]
    grams = np.concatenate([letters[one], two[one[:-1] | one[1:]], three[one[1:-1]]])
    grams.sort()
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by their number."""
    if len(counts) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:most]


@dataclass(frozen=True)
class Profiles:
    """The languages, all their profile n-grams in order, and each n-gram's rank in each language (its length where absent)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    length: int

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance to each language as a share of the largest possible; None without letters."""
        own = ranked(*ngrams(text), self.length)
        if not len(own) or not self.languages:
            return None
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own if len(self.grams) else np.zeros(len(own), dtype=bool)
        place = np.arange(len(own))
        apart = np.full((len(own), len(self.languages)), self.length, dtype=np.int64)
        ranks = self.ranks[at[known]]
        apart[known] = np.where(ranks < self.length, np.abs(ranks - place[known][:, None]), self.length)
        return apart.sum(axis=0) / (len(own) * self.length)

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and one minus its distance."""
        apart = self.distances(text)
        if apart is None:
            return NONE, 0.0
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best])


def make_profiles(counts: dict[str, tuple[np.ndarray, np.ndarray]], length: int = PROFILE) -> Profiles:
    languages = sorted(counts)
    lists = [ranked(*counts[x], length) for x in languages]
    grams = np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.int64)
    ranks = np.full((len(grams), len(languages)), length, dtype=np.int64)
    for j, own in enumerate(lists):
        ranks[np.searchsorted(grams, own), j] = np.arange(len(own))
    return Profiles(languages, grams, ranks, length)


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 40))


def learn(docs: DataFrame, length: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles of every language among documents that are not held out, from at most `sample` documents of each.

    The sample is drawn on ids alone; then only its texts are counted, in tasks, and summed by (language, n-gram).
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("lang").cast("string").alias("l"), F.col("doc_id").cast("long").alias("d")).agg(F.lit(1).alias("one"))
    # A hash bucket per document first: no window over all documents of one language.
    size = ids.groupBy("l").agg(F.count("*").alias("n"))
    spread = ids.join(size, "l").withColumn("h", _place(F.col("d")))
    near = spread.where(F.col("h") <= (1 << 40) * F.least(F.lit(1.0), F.lit(1.25 * sample) / F.col("n") + 200.0 / F.col("n")))
    last = near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "d"))).where(F.col("k") <= sample).groupBy("l").agg(F.max("h").alias("h")).collect()
    limits = F.create_map(*[F.lit(x) for row in last for x in row]) if last else F.create_map().cast("map<string,bigint>")
    d, lang = F.col("doc_id").cast("long"), F.col("lang").cast("string")
    own = docs.where(lang.isNotNull() & d.isNotNull() & ~held_out(d) & (_place(d) <= F.element_at(limits, lang))).select(lang.alias("l"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for name, text in zip(part.column("l").to_pylist(), texts(part)):
                    grams, counts = ngrams(text)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), type=pa.string()), pa.array(grams), pa.array(counts)], names=["l", "gram", "n"])

    counted = own.mapInArrow(run, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= length).collect()
    by: dict[str, list] = {}
    for row in top:
        by.setdefault(row.l, []).append((row.gram, row.n))
    return make_profiles({name: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows))) for name, rows in by.items()}, length)


def predict_documents(docs: DataFrame, length: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `docs` (doc_id, text, lang; all else is ignored).

    A null text or one without a letter is `und` with score 0, and so is everything if no language can be learned. Rows
    without an id are predicted and never learned from. An empty table gives an empty result.
    """
    profiles = learn(docs, length, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [profiles.predict(t) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified_documents(docs: DataFrame, least: float = 0.0, length: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, all their columns, whose text has a language: not `und`, and a score of `least` or more."""
    profiles = learn(docs, length, sample)

    @F.pandas_udf("boolean")
    def known(text):
        found = [profiles.predict(t) if isinstance(t, str) else (NONE, 0.0) for t in text]
        return text.__class__([name != NONE and score >= least for name, score in found], dtype=bool, index=text.index)

    return bounded_batches(docs).where(known(F.col("text").cast("string")))
