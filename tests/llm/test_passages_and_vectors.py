"""Decontamination, hard negatives and centroid clustering against brute force, on awkward rows and small blocks."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnlens.llm import centroids, decontamination, fm_index, hard_negatives, queries
from tests.llm.conftest import AWKWARD
from tests.llm.test_operators import MEDIUM, VECTORS, awkward_vectors, vectors


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    for n, sigma in ((1, 2), (2, 3), (50, 3), (400, 4), (1500, 900), (600, 2)):
        text = np.append(rng.integers(1, sigma, n), 0) if sigma > 1 else np.zeros(1, dtype=np.int64)
        if n == 600:
            text[:600] = 1  # one long run: suffixes tie to the end
        order = fm_index.suffix_array(text, sigma)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = fm_index.FMIndex(text, sigma, sample=5)
        assert index.locate(np.arange(len(text))).tolist() == order.tolist()
        patterns = [text[a : a + size].tolist() for a in rng.integers(0, n, 20).tolist() for size in (1, 2, 5)] + [[1] * 5, [sigma - 1] * 3]
        patterns = [p for p in patterns if p and 0 not in p]
        lengths = np.array([len(p) for p in patterns])
        low, high = index.search(np.array([p + [0] * (5 - len(p)) for p in patterns]), lengths)
        for p, a, b in zip(patterns, low.tolist(), high.tolist()):
            real = [i for i in range(len(text) - len(p)) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == real


def test_wavelet_ranks():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 37, 1000)
    tree = fm_index.Wavelet(symbols, 37)
    at, which = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert tree.rank(which, at).tolist() == [int((symbols[:a] == c).sum()) for a, c in zip(at, which)]
    got, before = tree.access(np.arange(1000))
    assert got.tolist() == symbols.tolist() and before.tolist() == [int((symbols[:i] == c).sum()) for i, c in enumerate(symbols)]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def passages_by_brute_force(docs, items, size):
    """(doc_id, n_words, spans in words and code points, items, text without the spans) of every document."""
    windows = defaultdict(set)
    for item, text in items:
        own = [w for w, _, _ in folded(text)]
        for i in range(max(len(own) - size, 0) + 1 if own else 0):
            windows[tuple(own[i : i + size])].add(item)
    out = Counter()
    for doc_id, text in docs:
        own = folded(text)
        hit, names = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                found = windows.get(tuple(w for w, _, _ in own[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found - {None}
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        stops = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        spans = tuple((a, b, own[a][1], own[b - 1][2]) for a, b in zip(starts, stops))
        left, at = "", 0
        for _, _, a, b in spans:
            left, at = left + text[at:a], b
        out[doc_id, len(own), spans, tuple(sorted(map(str, names))), None if text is None else left + text[at:]] += 1
    return out


def passage_rows():
    rng = np.random.default_rng(6)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 60, n))
    items = [(k, some(int(rng.integers(1, 40)))) for k in range(25)] + [(7, some(30)), (None, some(12)), (30, ""), (31, None), (32, "Ünïcode ẞ passage — of NINE 9words, only"), (33, " ".join(["again"] * 14))]
    docs = list(AWKWARD)
    for k in range(60):
        passage = (items[k % len(items)][1] or "").upper()
        docs.append((500 + k, f"{some(20)}\n日本語, {passage}!! {some(int(rng.integers(0, 30)))} {passage[: 5 * k]}"))
    docs += [(900, "again " * 40), (901, " ".join(t for _, t in items if t) * 3), (902, "Ünïcode ẞ passage of nine 9words only"), (903, "ÜNÏCODE ẞ passage of nine 9words only")]
    return docs, items


@pytest.mark.parametrize("size,shard,part_bytes", [(10, 1 << 20, 1 << 20), (4, 37, 1 << 20), (10, 50, 400)])
def test_occurrences(spark, documents, size, shard, part_bytes):
    docs, items = passage_rows()
    benchmark = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, spans string")
    found = decontamination.occurrences(documents(docs), benchmark, size, part_bytes, shard, cleaned=True)
    assert found.columns == ["doc_id", "n_words", "spans", "items", "text"]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r.items), r.text) for r in found.collect())
    assert got == passages_by_brute_force(docs, items, size)
    plain = decontamination.occurrences(documents(docs), benchmark, size, part_bytes, shard)
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r.items)) for r in plain.collect()) == Counter({k[:4]: sum(v for j, v in got.items() if j[:4] == k[:4]) for k in got})
    digest = {(r.doc_id, r.n_hit, r.items_sha256, r.contaminated) for r in decontamination.digests(plain).collect()}
    assert digest == {(k[0], sum(b - a for a, b, _, _ in k[2]), hashlib.sha256(",".join(k[3]).encode()).hexdigest(), bool(k[2])) for k in got}


def test_occurrences_of_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontamination.occurrences(documents([]), benchmark).collect() == []
    none = decontamination.digests(decontamination.occurrences(documents([(1, "one two three"), (2, None)]), benchmark.limit(0))).collect()
    assert sorted(map(tuple, none)) == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False), (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def is_whole(v):
    return v is not None and None not in v and all(map(math.isfinite, v))


def negatives_by_brute_force(rows, anchor, positives, negatives):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and is_whole(v)]
    out = Counter()
    for a, (i, label, v) in enumerate(good):
        if not anchor(i):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, b, other) for b, (j, other, w) in enumerate(good) if b != a and len(w) == len(v))
        for s, j, _, _ in [x for x in scores if x[3] == label][:positives]:
            fitting = [x for x in scores if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out.update((i, j, rank, n, -s, -t) for rank, (t, n, _, _) in enumerate(fitting, 1))
    return out


@pytest.mark.parametrize("smallest,largest,group", [(512, 1 << 18, 1 << 16), (10, 40, 30)])
def test_hard_negatives(spark, smallest, largest, group):
    rows = [(i, None if k % 17 == 5 else k * k % 4, v) for k, (i, v) in enumerate(awkward_vectors())]
    rows += [(600 + k, k % 3, rows[k % 9][2]) for k in range(90)]  # a few vectors that many rows share
    frame = spark.createDataFrame([(i, v, label, 5, 6, "d", "r", 1, 2) for i, label, v in rows], VECTORS + ", block int, cluster int")
    found = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0, smallest=smallest, largest=largest, group=group)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = negatives_by_brute_force(rows, lambda i: i % 5 == 0, 5, 3)
    assert Counter(map(tuple, found.collect())) == expected and len(expected) > 300


@pytest.mark.parametrize("size", [1e2, 1e5, 1e6, 3e6])
def test_hard_negatives_of_long_vectors(spark, size):
    """Scores beyond 53 bits, next to short ones."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, (rng.standard_normal(5) * (size if k % 4 else 1)).tolist()) for k in range(120)]
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 5 == 0, smallest=50)
    expected = negatives_by_brute_force(rows, lambda i: i % 5 == 0, 5, 3)
    assert Counter(map(tuple, found.collect())) == expected and len(expected) > 60


def test_scores_beyond_63_bits_are_passed_over():
    x = np.array([[2.0**40, 0], [2.0**10, 1], [-(2.0**41), 3], [2.0**20, 0], [2.0**20, 0]])
    held = hard_negatives.Candidates(np.arange(5), np.arange(5), x)
    place, score = held.best(np.array([0]), x[:1], np.arange(5), np.array([[2**61]]), np.array([[-(2**61)]]), 3)
    assert place.tolist() == [[[3, 4, 1]]] and score.tolist() == [[[2**60, 2**60, 2**50]]]


def test_rows_without_id_are_negatives_and_positives_of_the_query(spark, tmp_path):
    """The contract names the rows that take no part, and rows without an id are not among them."""
    rows = [(50, 1, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (None, 2, [0.75, 0.75]), (51, 2, [0.75, 0.75]), (None, None, [0.75, 0.75])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(50, None, 1, 51, 131072, 98304), (50, None, 2, None, 131072, 98304)]


def test_walk_ends_early_and_finds_the_best():
    """Clustered vectors: the list is left long before its end, and the result is that of a full scan."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 16))
    x = np.floor(256 * (centres[rng.integers(0, 40, 20_000)] + 0.05 * rng.standard_normal((20_000, 16))))
    held = hard_negatives.Candidates(np.arange(20_000), np.arange(20_000), x)
    members = np.flatnonzero(np.linalg.norm(x - np.floor(256 * centres[3]), axis=1) < 200)[:20]

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            Counted.read = max(Counted.read, len(key)) if isinstance(key, np.ndarray) and key.dtype != bool and len(key) < 20_000 else Counted.read
            return np.asarray(super().__getitem__(key))

    held.x = held.x.view(Counted)
    most, least = np.full((20, 1), hard_negatives._MOST), np.full((20, 1), hard_negatives._LEAST)
    place, score = held.best(members, x[members], np.arange(20_000), most, least, 5)
    assert 0 < Counted.read <= 2 * hard_negatives.CHUNK
    for k, m in enumerate(members.tolist()):
        all_scores = np.rint(x @ x[m]).astype(np.int64)
        best = [j for j in np.lexsort((np.arange(20_000), -all_scores)).tolist() if j != m][:5]
        assert place[k, 0].tolist() == best and score[k, 0].tolist() == all_scores[best].tolist()


def clusters_by_brute_force(rows, clusters, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if is_whole(v) and len(v) == dim]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[k]) for col in zip(*own[k])] if k in own else x for k, x in enumerate(c)]
    done = [(i, *near(v)) for i, v in kept]
    spread = Counter()
    for _, d, k in done:
        spread[k] += d
    return Counter((i, k, d, spread[k], sum(spread.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in done)


@pytest.mark.parametrize("clusters", [1, 7, 16, 1000])
def test_centroids(spark, clusters):
    rows = awkward_vectors()
    if clusters == 1000:
        rows = rows[:12] + rows[150:]  # fewer rows than clusters
    found = centroids.cluster(vectors(spark, rows), clusters=clusters, dim=16)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == clusters_by_brute_force(rows, clusters, 3, 16)


def test_centroids_are_sql_only(spark):
    """No Python in any plan, and the component sums are one aggregation with partial sums below its only shuffle."""
    rows = spark.createDataFrame([(k, [float(k % 5), float(k % 3)]) for k in range(50)], "vec_id long, embedding array<double>").select("vec_id", "embedding")
    vector = centroids._whole(F.col("embedding"), 2, 64)
    best = centroids.assigned(rows.select("vec_id", vector.alias("v")), [[0, 0], [64, 64]]).select(F.col("best.cluster").alias("cluster"), "v").groupBy("cluster").agg(F.sum(F.col("v")[0]))
    plan = best._jdf.queryExecution().optimizedPlan().toString() + best._jdf.queryExecution().sparkPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan.replace("EvaluatePython", "") and "Pandas" not in plan


def test_vector_operators_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(none).collect() == [] and centroids.cluster(none).collect() == []
    only_bad = spark.createDataFrame([(1, None, [1.0]), (2, 1, None), (None, 1, [2.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(only_bad).collect() == [] and centroids.cluster(only_bad).collect() == []


def test_registered_queries_cover_their_tables(spark):
    documents = spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert queries.op11_decontamination(spark, MEDIUM).count() == documents
