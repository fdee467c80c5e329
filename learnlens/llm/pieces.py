"""SentencePiece encoding and decoding in batched numpy.

Words never share a piece, so the distinct words of a batch are encoded once, words of equal length together as the rows of one matrix.

- Viterbi (`best`), for unigram models: at each end position, all rows probe the hashes of the substrings that end
  there in the sorted piece keys; the best sum so far is a vectorised maximum, and its start is the back pointer.
- Merges (`merged`), for BPE models, whose ids a Viterbi search does not give: all rows probe the pairs of neighbouring pieces in the sorted
  pair keys, each takes its best pair (leftmost on ties), and so on until no row has one.

Characters without a piece fall back to bytes, or to the unknown piece in models without byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from learnlens.llm.common import bounded_batches, record, slices, texts

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the format: piece kinds, model kinds, and what an unknown character costs beyond the least score.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Longer words are merged one by one with a heap, and cut in the Viterbi search one at a time.
LONG = 192
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_ROWS = 1 << 15


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_MODEL)


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is can be decoded to it")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.kind = model.trainer_spec.model_type
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        whole = [i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)]
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in whole):
            raise ValueError("a piece holds a blank after a letter, so words cannot be encoded on their own")
        self.scores = np.array([p.score for p in model.pieces], dtype=np.float32)
        self.unknown_score = np.float32(self.scores[whole].min() - np.float32(UNKNOWN_PENALTY))
        self.longest = max(len(self.texts[i]) for i in whole)
        keys = np.array([_hash(self.texts[i]) for i in whole], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(whole, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.maybe = np.zeros(1 << 20, dtype=bool)  # tells most misses before the sorted keys are probed
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        by_text = {self.texts[i]: i for i in whole}
        pairs = sorted((by_text[t[:k]] << 32 | by_text[t[k:]], i) for t, i in by_text.items() for k in range(1, len(t)) if t[:k] in by_text and t[k:] in by_text)
        self.pair_keys, self.pair_ids = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        self.raw = [bytes([int(t[3:5], 16)]) if i in set(self.bytes_at.values()) else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else t.replace(SPACE, " ").encode() for i, (t, p) in enumerate(zip(self.texts, model.pieces))]

    # -- words -----------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        whole = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return _WORDS.findall(whole)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each substring hash, -1 if none."""
        out = np.full(keys.shape, -1, dtype=np.int64)
        likely = self.maybe[(keys >> np.uint64(44)).astype(np.int64)]
        some = keys[likely]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[likely] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours merge to, -1 if none."""
        if not len(self.pair_keys):
            return np.full(left.shape, -1, dtype=np.int64)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ids[at], -1)

    def best(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over rows of equal length. Returns ids and lengths in characters, a cell for each piece at its first character, else length 0."""
        n, length = code.shape
        power = _powers(length + 1)
        prefix = np.zeros((n, length + 1), dtype=np.uint64)
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * _BASE + code[:, k].astype(np.uint64) + np.uint64(1)
        total = np.zeros((n, length + 1), dtype=np.float32)
        start = np.zeros((n, length + 1), dtype=np.int32)
        chosen = np.full((n, length + 1), -1, dtype=np.int64)
        for end in range(1, length + 1):
            begins = np.arange(max(0, end - self.longest), end)
            found = self.find(prefix[:, end, None] - prefix[:, begins] * power[end - begins])
            score = np.where(found >= 0, self.scores[found], np.float32(-np.inf))
            score[:, -1] = np.where(found[:, -1] >= 0, score[:, -1], self.unknown_score)
            sums = total[:, begins] + score
            pick = sums.argmax(axis=1)
            row = np.arange(n)
            total[:, end], start[:, end], chosen[:, end] = sums[row, pick], begins[pick], found[row, pick]
        ids, sizes = np.full((n, length), -1, dtype=np.int64), np.zeros((n, length), dtype=np.int32)
        at = np.full(n, length)
        while (live := np.flatnonzero(at > 0)).size:
            begin = start[live, at[live]]
            ids[live, begin], sizes[live, begin] = chosen[live, at[live]], at[live] - begin
            at[live] = begin
        return ids, sizes

    def merged(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges over rows of equal length; the same form of result as `best`."""
        n, length = code.shape
        symbol = self.find(code.astype(np.uint64) + np.uint64(1))
        place = np.tile(np.arange(length), (n, 1))
        ids, sizes = np.full((n, length), -1, dtype=np.int64), np.zeros((n, length), dtype=np.int32)
        rows = np.arange(n)
        pair = self.pair(symbol[:, :-1], symbol[:, 1:]) if length > 1 else np.zeros((n, 0), dtype=np.int64)
        count = length
        while len(rows):
            value = np.where(pair >= 0, self.scores[pair], np.float32(-np.inf))
            done = ~(pair >= 0).any(axis=1) if count > 1 else np.ones(len(rows), dtype=bool)
            if done.any():
                who = rows[done]
                ids[who[:, None], place[done]] = symbol[done]
                sizes[who[:, None], place[done]] = np.diff(place[done], axis=1, append=length)
                keep = ~done
                rows, symbol, place, pair, value = rows[keep], symbol[keep], place[keep], pair[keep], value[keep]
                if not len(rows):
                    break
            k = value.argmax(axis=1)
            row = np.arange(len(rows))
            symbol[row, k] = pair[row, k]
            column = np.arange(count - 1)
            drop = np.where(column <= k[:, None], column, column + 1)  # all but the piece to the right of the merge
            symbol, place = np.take_along_axis(symbol, drop, axis=1), np.take_along_axis(place, drop, axis=1)
            count -= 1
            if count > 1:
                pair = np.take_along_axis(pair, np.where(column[:-1] < k[:, None], column[:-1], column[:-1] + 1), axis=1)
                left, right = k > 0, k < count - 1
                pair[row[left], k[left] - 1] = self.pair(symbol[row[left], k[left] - 1], symbol[row[left], k[left]])
                pair[row[right], k[right]] = self.pair(symbol[row[right], k[right]], symbol[row[right], k[right] + 1])
            else:
                pair = np.zeros((len(rows), 0), dtype=np.int64)
        return ids, sizes

    def merged_long(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of one long word, with a heap of pairs."""
        symbol = self.find(code.astype(np.uint64) + np.uint64(1)).tolist()
        n = len(symbol)
        table = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist()))
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def add(i: int) -> None:
            j = right[i]
            if j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (p := table.get(symbol[i] << 32 | symbol[j])) is not None:
                heapq.heappush(heap, (-float(self.scores[p]), i, symbol[i], symbol[j]))

        for i in range(n - 1):
            add(i)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i] = table[a << 32 | b]
            gone[j] = True
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            add(i)
            if left[i] >= 0:
                add(left[i])
        begin = [i for i in range(n) if not gone[i]]
        ids, sizes = np.full((1, n), -1, dtype=np.int64), np.zeros((1, n), dtype=np.int32)
        ids[0, begin], sizes[0, begin] = [symbol[i] for i in begin], np.diff([*begin, n])
        return ids, sizes

    # -- texts -----------------------------------------------------------------------------------------------------

    def encode_words(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where each word's begin."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[np.ndarray] = []
        order: list[np.ndarray] = []
        lengths = np.zeros(len(words), dtype=np.int64)
        by_size = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[by_size], prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            size = int(sizes[by_size[a]])
            step = 1 if size > LONG else max(1, _ROWS * 8 // size)
            for c in range(a, b, step):
                who = by_size[c : min(c + step, b)]
                code = np.frombuffer("".join([words[i] for i in who]).encode("utf-32-le", "replace"), dtype="<u4").reshape(len(who), size)
                ids, spans = self.best(code) if kind == UNIGRAM else self.merged_long(code[0]) if size > LONG else self.merged(code)
                flat, per_word = self._flat(ids, spans, code)
                out.append(flat)
                order.append(who)
                lengths[who] = per_word
        begins = np.append(0, np.cumsum(lengths))
        if not out:
            return np.zeros(0, dtype=np.int64), begins
        order_of = np.concatenate(order)
        flat = np.concatenate(out)
        source = np.empty(len(words), dtype=np.int64)
        source[order_of] = np.cumsum(lengths[order_of]) - lengths[order_of]
        return flat[np.arange(begins[-1]) + np.repeat(source - begins[:-1], lengths)], begins

    def _flat(self, ids: np.ndarray, spans: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces row by row, with characters that have none as bytes, and the number of each row."""
        row, column = np.nonzero(spans)
        found = ids[row, column]
        if (found >= 0).all():
            return found, np.bincount(row, minlength=len(ids))
        many = np.ones(len(found), dtype=np.int64)
        odd = np.flatnonzero(found < 0)
        fall = [self._bytes(int(c)) for c in code[row[odd], column[odd]]]
        many[odd] = [len(f) for f in fall]
        out = np.repeat(found, many)
        out[np.repeat(found < 0, many)] = [x for f in fall for x in f]
        return out, np.bincount(row, weights=many, minlength=len(ids)).astype(np.int64)

    def _bytes(self, code: int) -> list[int]:
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in chr(code).encode("utf-8", "replace")]

    def encode(self, many: list[str], kind: int | None = None) -> list[np.ndarray]:
        """Ids of each text, by the model's own rule or the one given."""
        return self.encodings(many, kind or self.kind)[0]

    def encodings(self, many: list[str], *kinds: int) -> list[list[np.ndarray]]:
        """Ids of each text by each of the rules; the texts are cut into words once."""
        words: list[str] = []
        counts = [0]
        for text in many:
            words += self.words(text)
            counts.append(len(words))
        distinct = list(dict.fromkeys(words))
        number = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        out = []
        for kind in kinds:
            flat, begins = self.encode_words(distinct, kind)
            lengths = np.diff(begins)[at]
            ends = np.append(0, np.cumsum(lengths))
            ids = flat[np.arange(ends[-1]) + np.repeat(begins[:-1][at] - ends[:-1], lengths)] if len(at) else flat
            out.append([ids[ends[a] : ends[b]] for a, b in zip(counts, counts[1:])])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 come out as replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _powers(n: int) -> np.ndarray:
    """Powers of the hash base, modulo 2 ** 64."""
    return np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(n - 1, _BASE)), dtype=np.uint64)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """One model per worker process and path."""
    return Pieces(path)


def _rows(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str | None = None, kind: int | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every row of `docs` (doc_id, text; all else is ignored). A null or empty text has no ids."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pieces.encode(texts(part), kind), type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of every row of `encoded` (doc_id, ids; all else is ignored). Null ids are an empty text."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            found = [pieces.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGEST = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("viterbi_pieces", pa.int64()), ("viterbi_crc32", pa.int64()), ("round_trip", pa.bool_())]


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """A row for every row of `docs`: number and CRC-32 (little-endian 32-bit) of the ids by the model's own rule and by the Viterbi search,
    and whether the first decode to the text. A null or empty text has no ids and decodes to an empty text.
    """
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                many = texts(part)
                own, best = pieces.encodings(many, pieces.kind, UNIGRAM)
                crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
                yield record(
                    {
                        "doc_id": part.column("doc_id"), "n_pieces": [len(x) for x in own], "ids_crc32": [crc(x) for x in own], "viterbi_pieces": [len(x) for x in best],
                        "viterbi_crc32": [crc(x) for x in best], "round_trip": [pieces.decode(a) == t for a, t in zip(own, many)],
                    },
                    DIGEST,
                )

    return _rows(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, viterbi_pieces long, viterbi_crc32 long, round_trip boolean")
