"""How much of a feedback text reappears in another text of the same assignment.

The overlap of two texts is the number of words of the first, repeats included, that occur in the second. A text wants its largest overlap
with any other of its assignment. No row per word and none per pair of texts is ever made:

1. Equal texts are collapsed by hash. A text that occurs twice overlaps fully with its copy and needs no search.
2. The texts of an assignment are dealt to blocks of up to `CHUNK` words. Two blocks meet in one task, each block also with itself; a text is one
   row, as it was written, in as many tasks as its assignment has blocks. Mostly that is one.
3. In a task each text is first compared with the `WIDE` texts of the other block that have most different words. A text that lies in one of them
   wholly is done, and where only a goal is to be decided so is one whose overlap falls short of the goal.
4. The others are compared with all texts of the block: words that many texts hold by a product of matrices, the others by the list of the texts
   that hold them. Only each text's maximum leaves the task.

The result is exact: no partner is capped or sampled. What grows with the square of an assignment's words is the copies of its texts, one per `CHUNK`
words, and the time of its comparisons.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.functions.staging import stage
from learnlens.functions.text import words
from learnlens.operators.assessment import graded_submissions, with_comments
from learnlens.operators.membership import MANY, key_bitmap, may_hold
from learnlens.sources.tables import LearningTables

TEXT = ["assignment_id", "text_id"]
RECORD = ["course_id", "assignment_id", "student_id", "submission_id", "record_key"]
MEETING = ["assignment_id", "a", "b"]
CHUNK = 1 << 22  # words of a block
ROW = 16  # words that a row weighs besides its own
WIDE = 32
TILE = 1_000  # texts whose overlaps are held at once
LOOKUPS = 2_000  # holders of a text's words that are added one by one; more are counted in an array
_COLUMNS = 4_096  # words held by many texts that are multiplied
_CELLS = 1 << 23  # numbers of a matrix


def _comments(t: LearningTables) -> DataFrame:
    return t.assignfeedback_comments.select(
        F.col("id").alias("feedback_id"),
        F.col("assignment").alias("assignment_id"),
        F.col("grade").alias("grade_id"),
        F.coalesce("commenttext", F.lit("")).alias("text"),
    )


def _records(t: LearningTables, graded: DataFrame) -> DataFrame:
    """One row per (submission, grade, comment), with two hashes and the word count of the text, but not the text.

    A missing comment is the one-word text ''. `record_key` is unique per text: a comment id, or the negative submission
    id where there is no comment.
    """
    empty = F.lit("")
    marks = lambda text: (F.xxhash64(text), F.xxhash64(F.lit(1), text), F.size(words(text)))
    named = ("hash_1", "hash_2", "n_words")
    comments = _comments(t).select(
        "feedback_id", "assignment_id", "grade_id", *[c.alias(n) for c, n in zip(marks(F.col("text")), named)]
    )
    return with_comments(graded, comments).select(
        *RECORD[:-1],
        F.coalesce(F.col("feedback_id"), -F.col("submission_id")).alias("record_key"),
        *[F.coalesce(F.col(n), c).alias(n) for c, n in zip(marks(empty), named)],
    )


def _different(records: DataFrame) -> DataFrame:
    """One row per different text of an assignment: copies, word count and its smallest record key."""
    return (
        records.groupBy("assignment_id", "hash_1", "hash_2", "n_words")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("record_key").alias("text_id"))
        .select(*TEXT, "copies", "n_words")
    )


def _texts(t: LearningTables, records: DataFrame) -> DataFrame:
    """The texts of `_different` and few others, as `_dealt`.

    The text itself is read again, for one record of each: a bitmap of the narrow keys drops most others at the scan. What passes goes straight
    to the tasks that compare it, which know the keys, so that texts are shuffled once.
    """
    different = _different(records)
    missing = different.filter("text_id < 0").select(*TEXT, F.lit("").alias("text"))
    found = different.filter("text_id >= 0")
    comments = _comments(t).select("assignment_id", F.col("feedback_id").alias("text_id"), "text")
    comments = comments.filter(may_hold(key_bitmap(found, TEXT, MANY), TEXT, MANY))
    return _dealt(comments.unionByName(missing), _blocks(different)).repartition(*MEETING)


def feedback_uniqueness(
    t: LearningTables, course_ids: Sequence[int] | None = None, open_end_at: int | None = None
) -> DataFrame:
    """Every feedback record with its word count, largest overlap and uniqueness `1 - overlap / n_words`."""
    return _scored(t, _graded(t, course_ids, open_end_at), None).select(*RECORD, "n_words", "overlap", "uniqueness")


def unique_feedback(
    t: LearningTables, goal: float, course_ids: Sequence[int] | None = None, open_end_at: int | None = None, graded: DataFrame | None = None
) -> DataFrame:
    """Every feedback record with `unique_enough`: its uniqueness is not below `goal`, a percentage.

    The search stops as soon as a record is known to be below the goal or not. `graded` are the rows of `graded_submissions`, if they are at hand.
    """
    scored = _scored(t, _graded(t, course_ids, open_end_at) if graded is None else graded, goal)
    # The formula keeps its order of operations so that ties agree.
    return scored.select(*RECORD, (~(F.col("uniqueness") < F.lit(float(goal) / 100))).alias("unique_enough"))


def _graded(t: LearningTables, course_ids: Sequence[int] | None, open_end_at: int | None) -> DataFrame:
    """`graded_submissions`, staged: three uses read them, and what made them is gone from the disk before texts are shuffled."""
    return stage(graded_submissions(t, course_ids, open_end_at))


def _scored(t: LearningTables, graded: DataFrame, goal: float | None) -> DataFrame:
    """Records with their overlap; with a goal only its side of the goal is certain."""
    records = stage(_records(t, graded))
    # Staged as well, so that the shuffled texts are gone before the caller's job begins.
    best = stage(_compared(_different(records), _texts(t, records), goal)).withColumnRenamed("text_id", "record_key")
    n_words = F.col("n_words").cast("long")
    overlap = F.coalesce("overlap", n_words)  # no row in `best`: the text has a copy
    return records.join(best, ["assignment_id", "record_key"], "left").select(
        *RECORD, n_words.alias("n_words"), overlap.alias("overlap"), _uniqueness(overlap, F.col("n_words")).alias("uniqueness")
    )


def _uniqueness(overlap: Column, n_words: Column) -> Column:
    return F.lit(1.0) - overlap.cast("double") / n_words.cast("double")


def largest_overlaps(texts: DataFrame, goal: float | None = None) -> DataFrame:
    """assignment_id, text_id, overlap for every text that occurs once in its assignment.

    `texts` has assignment_id, text_id, copies, n_words, words. With a goal, a percentage, only the overlap's side of the goal is certain.
    """
    written = texts.select(*TEXT, F.array_join("words", " ").alias("text"))
    return _compared(texts.select(*TEXT, "copies", "n_words"), _dealt(written, _blocks(texts)), goal)


def _blocks(different: DataFrame) -> Column:
    """How many blocks the texts of an assignment make, as a scalar: a map of the assignments that make several."""
    weight = F.sum(F.col("n_words").cast("long") + ROW)
    many = different.groupBy("assignment_id").agg(F.ceil(weight / CHUNK).alias("blocks")).filter("blocks > 1")
    return many.agg(F.map_from_entries(F.collect_list(F.struct("assignment_id", "blocks")))).scalar()


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every meeting (a, b) of two blocks of its assignment that its own block takes part in, with `block`."""
    of = F.coalesce(F.try_element_at(blocks, F.col("assignment_id")), F.lit(1).cast("long"))
    own = rows.withColumn("of", of).withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("of")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other")
    return own.select(*rows.columns, "block", other).select(
        *rows.columns, "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )


def _compared(different: DataFrame, dealt: DataFrame, goal: float | None) -> DataFrame:
    """`largest_overlaps` of the texts `different`, whose text is among the rows that were `dealt`."""
    enough = None if goal is None else float(goal) / 100
    keys = _dealt(different, _blocks(different))
    found = keys.groupBy(*MEETING).cogroup(dealt.groupBy(*MEETING)).applyInArrow(
        lambda left, right: _meeting(left, right, enough), "assignment_id long, text_id long, overlap long"
    )
    # one row even where a comment's id has several texts, so that no record is multiplied
    return found.groupBy(*TEXT).agg(F.max("overlap").alias("overlap"))


class _Coded(NamedTuple):
    """Texts as numbers of their different words: `words` and how often, `tf`, text after text, of which each has `sizes` words."""

    ids: np.ndarray
    single: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    tf: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def take(self, at: np.ndarray) -> _Coded:
        starts, sizes = self.starts[at], self.sizes[at]
        every = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(at) else np.zeros(0, int)
        return _Coded(self.ids[at], self.single[at], self.lengths[at], sizes, self.words[every], self.tf[every])


def _meeting(keys: pa.Table, texts: pa.Table, enough: float | None) -> pa.Table:
    """The largest overlap of each text that occurs once with a text of the other block, or of its own where a block meets itself."""
    result = pa.schema([("assignment_id", pa.int64()), ("text_id", pa.int64()), ("overlap", pa.int64())])
    if not keys.num_rows or not texts.num_rows:
        return result.empty_table()
    known = {key: rest for key, *rest in zip(*(keys[c].to_pylist() for c in ("text_id", "copies", "n_words", "block")))}
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words, tf, rows = array("i"), array("i"), []
    for batch in texts.select(["text_id", "text"]).to_batches(max_chunksize=1_000):
        for key, text in zip(batch["text_id"].to_pylist(), batch["text"].to_pylist()):
            if key in known:  # the bitmap at the scan lets some others pass
                counts = Counter(text.split(" "))
                words.extend(map(numbers.__getitem__, counts))
                tf.extend(counts.values())
                rows.append((key, *known[key], len(counts)))
    if not rows:
        return result.empty_table()
    total = len(numbers)
    numbers.clear()
    key, copies, n_words, block, sizes = np.array(rows, dtype=np.int64).T
    coded = _Coded(key, copies == 1, n_words, sizes, np.frombuffer(words, dtype=np.int32), np.frombuffer(tf, dtype=np.int32))
    a, b = keys["a"][0].as_py(), keys["b"][0].as_py()
    first, second = (coded.take(np.flatnonzero(block == x)) for x in (a, b))
    pairs = [(first, first)] if a == b else [(first, second), (second, first)]
    left = [(own.ids[own.single], _largest_with(own.take(np.flatnonzero(own.single)), other, total, enough)) for own, other in pairs]
    ids, overlap = (np.concatenate(x) for x in zip(*left))
    return pa.table([np.full(len(ids), keys["assignment_id"][0].as_py()), ids, overlap], schema=result)


def _largest_with(left: _Coded, right: _Coded, total: int, enough: float | None) -> np.ndarray:
    """The largest overlap of each left text with a right one but itself; words have numbers below `total`."""
    found = np.zeros(len(left.ids), dtype=np.int64)
    if not len(left.ids) or not len(right.ids):
        return found
    found[:] = _with_widest(left, right, total)
    if enough is None:
        opened = found < left.lengths
    else:
        opened = ~(1.0 - found / left.lengths < enough)  # the same order of operations as in `_uniqueness`
    at = np.flatnonzero(opened)
    found[at] = np.maximum(found[at], _with_all(left.take(at), right, total))
    return found


def _with_widest(left: _Coded, right: _Coded, total: int) -> np.ndarray:
    """The largest overlap with one of the WIDE right texts of most different words."""
    widest = np.lexsort((right.ids, -right.sizes))[:WIDE]
    wide = right.take(widest)
    marks = np.zeros((total, len(widest)), dtype=np.uint8)
    marks[wide.words, np.repeat(np.arange(len(widest)), wide.sizes)] = 1
    starts, found = left.starts, np.zeros(len(left.ids), dtype=np.int64)
    step = max(1, _CELLS // (len(widest) * max(1, int(left.sizes.max()))))
    for start in range(0, len(left.ids), step):
        end = min(start + step, len(left.ids))
        part = slice(starts[start], starts[end])
        overlap = np.add.reduceat(marks[left.words[part]] * left.tf[part, None], starts[start:end] - starts[start], axis=0, dtype=np.int64)
        overlap[left.ids[start:end, None] == wide.ids] = 0
        found[start:end] = overlap.max(axis=1)
    return found


def _with_all(left: _Coded, right: _Coded, total: int) -> np.ndarray:
    """The largest overlap with a right text: words that many of these hold as a matrix product, the others by lists of their holders."""
    n = len(right.ids)
    df = np.bincount(right.words, minlength=total)
    # A product costs every pair of texts a little, a list each holder more.
    frequent = np.flatnonzero((df > 1) & (df >= n / 32))
    frequent = frequent[np.argsort(-df[frequent], kind="stable")][: min(_COLUMNS, max(1, _CELLS // n))]
    column = np.full(total, -1, dtype=np.int32)
    column[frequent] = np.arange(len(frequent))
    exact = np.float32 if left.lengths.max(initial=0) < 1 << 24 else np.float64
    holder = np.repeat(np.arange(n, dtype=np.int32), right.sizes)
    dense = column[right.words] >= 0
    marks = np.zeros((len(frequent), n), dtype=exact)
    marks[column[right.words[dense]], holder[dense]] = 1
    order = np.argsort(right.words, kind="stable")
    holders, ends = holder[order], np.cumsum(df)
    by_id = np.argsort(right.ids, kind="stable")
    same = np.searchsorted(right.ids[by_id], left.ids, "left"), np.searchsorted(right.ids[by_id], left.ids, "right")

    starts, found = left.starts, np.zeros(len(left.ids), dtype=np.int64)
    step = max(1, min(TILE, _CELLS // max(n, len(frequent), 1)))
    for start in range(0, len(left.ids), step):
        end = min(start + step, len(left.ids))
        part = slice(starts[start], starts[end])
        place, tf, words = column[left.words[part]], left.tf[part], left.words[part]
        counts = np.zeros((end - start, len(frequent)), dtype=exact)
        counts[np.repeat(np.arange(end - start), left.sizes[start:end])[place >= 0], place[place >= 0]] = tf[place >= 0]
        overlaps = counts @ marks
        for i in range(start, end):
            overlap, own = overlaps[i - start], slice(starts[i] - starts[start], starts[i + 1] - starts[start])
            listed = place[own] < 0
            w, times = words[own][listed], tf[own][listed]
            _add_holders(overlap, w[times == 1], None, holders, ends, df)
            _add_holders(overlap, w[times > 1], times[times > 1], holders, ends, df)
            overlap[by_id[same[0][i] : same[1][i]]] = 0
            found[i] = overlap.max()
    return found


def _add_holders(overlap: np.ndarray, words: np.ndarray, times: np.ndarray | None, holders: np.ndarray, ends: np.ndarray, df: np.ndarray) -> None:
    """Add to `overlap` for each word, as often as it occurs, one at the places of all texts that hold it."""
    if not len(words):
        return
    sizes, last = df[words], ends[words]
    at = np.concatenate([holders[e - k : e] for e, k in zip(last.tolist(), sizes.tolist())])
    weights = None if times is None else np.repeat(times, sizes)
    if len(at) > LOOKUPS:
        overlap += np.bincount(at, weights, minlength=len(overlap))
    else:
        np.add.at(overlap, at, 1 if weights is None else weights)
