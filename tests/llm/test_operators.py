"""Operators on awkward rows and on the small sample, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from learnlens.llm import ann, html_text, langid, packing, pieces, quality, queries, simhash, subspace, token_counts, url_filter
from learnlens.llm.components import connected_components
from tests.compare import connect, difference
from tests.llm.conftest import AWKWARD

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 200 + i) for i in range(40)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert found == groups(real, {n for e in real for n in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_by_brute_force(rows):
    fps = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    order = range(len(fps))
    reach = groups([(a, b) for a in order for b in order if a < b and bin(fps[a][1] ^ fps[b][1]).count("1") <= 3], order)
    least = defaultdict(list)
    for k, r in reach.items():
        least[r] += [fps[k][0]] if fps[k][0] is not None else []
    return Counter((i, f"{f:016x}", min(least[reach[k]], default=None)) for k, (i, f) in enumerate(fps))


def near_copies(n=120):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    out = []
    for k in range(n):
        own = list(words)
        for _ in range(k % 7):
            own[int(rng.integers(0, 400))] = "changed"
        out.append((1000 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("parts", [2, 3])
def test_simhash(documents, parts):
    rows = AWKWARD + near_copies()
    found = simhash.near_duplicates(documents(rows), parts=parts)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    expected = near_by_brute_force(rows)
    assert Counter(map(tuple, found.collect())) == expected
    assert len({c for _, _, c in expected}) < len(rows) - 20


def test_representatives(documents):
    rows = [(1, None), (2, ""), (6, "one two three four"), (6, "one two three four"), (7, "one two three four"), (None, "one two three four"), (9, "other words are in this")]
    found = [(r.doc_id, r.text) for r in simhash.representatives(documents(rows)).collect()]
    assert sorted(found, key=str) == sorted([(1, None), (6, "one two three four"), (9, "other words are in this")], key=str)


@pytest.mark.parametrize("swap", [False, True])
def test_representatives_of_ids_with_several_texts(documents, swap):
    """Each text of an id stays or goes with its own component, in any order of rows and on a re-run."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue black white", "north south east west")
    rows = [(1, a), (6, a), (6, b), (7, b), (8, c), (8, d), (8, d), (None, a), (None, "no id here at all"), (None, "no id here at all")]
    docs = documents(rows[::-1] if swap else rows)
    expected = sorted([(1, a), (6, b), (8, c), (8, d), (None, "no id here at all")], key=str)
    for _ in range(2):
        kept = simhash.representatives(docs)
        assert kept.columns == docs.columns
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == expected
    assert sorted([(r.doc_id, r.text) for r in simhash.representatives(docs, most_sent=0).collect()], key=str) == expected


def test_representatives_keep_one_row_of_each_component(documents):
    rows = near_copies(60) + [(1000 + k, f"other words of text {k} " * 30) for k in range(5)] + AWKWARD
    of = {}
    order = range(len(rows))
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    for k, root in groups([(a, b) for a in order for b in order if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3], order).items():
        of.setdefault(root, []).append((rows[k][0] is None, rows[k][0], np.uint64(fps[k]).astype(np.int64), rows[k][1] or ""))
    expected = Counter((i, t) for _, i, _, t in map(min, of.values()))
    assert Counter((r.doc_id, r.text or "") for r in simhash.representatives(documents(rows)).collect()) == expected


def test_packing(documents):
    rows = AWKWARD + [(100 + k, "some words " * k) for k in range(60)] + [(200, "a<|endoftext|>b" * 20)]
    found = packing.pack(documents(rows), capacity=64, group=20).collect()
    library = Tokenizer.from_file(packing.default_path())
    expected = Counter()
    for i, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = packing.cuts(len(ids), 64)
        expected.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in found) / 64) + 2


def test_packing_keeps_the_bins_of_the_last_round(documents):
    """Documents above half the capacity fill no bin; where the bound on rounds ends the search, they still come back."""
    rows = [(k, "some words " * (18 + k % 9)) for k in range(200)]
    whole = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(documents(rows), 64).collect())
    for rounds in (1, 2):
        found = packing.pack(documents(rows), capacity=64, group=20, rounds=rounds).collect()
        assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == whole
        assert all(sum(r.length for r in found if r.sequence_id == x) <= 64 for x in {r.sequence_id for r in found})


def test_token_counts(documents):
    encoder = packing.load(packing.default_path())
    rows = AWKWARD + [(20, "é\n\nzwei\nthree four")]
    found = token_counts.count_by_section(documents(rows)).collect()
    total = Counter()
    for r in found:
        total[r.doc_id] += r.n_tokens
    expected = Counter()
    for i, text in rows:
        expected[i] += len(encoder.encode(text or ""))
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in expected.items() if v}
    assert sorted((r.section, r.begin, r.end) for r in found if r.doc_id == 20) == [(0, 0, 2), (1, 2, 3), (2, 3, 8), (3, 8, 18)]
    gap = token_counts.count_by_section(documents([(1, "one two three")]), lambda text: [(0, 3)]).collect()
    assert [(r.section, r.n_tokens) for r in gap] == [(0, 1), (None, 2)]


def test_pieces(documents):
    own = pieces.load(pieces.default_path())
    docs = documents(AWKWARD)
    encoded = pieces.encode(docs)
    expected = Counter((i, tuple(own.encode([t or ""])[0].tolist())) for i, t in AWKWARD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == expected
    assert Counter(map(tuple, pieces.decode(encoded).collect())) == Counter((i, t or "") for i, t in AWKWARD)
    digests = pieces.digests(docs).collect()
    assert len(digests) == len(AWKWARD) and all(r.round_trip for r in digests)
    assert pieces.decode(docs.sparkSession.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_quality(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (4, 1, None), (5, None, 1), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(documents(AWKWARD), labels).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    none = quality.score_documents(documents(AWKWARD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_on_held_out_documents(spark):
    found = queries.op5_quality_classifier(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(found) > 100 and np.mean([p == q for p, q in found]) > 0.97


def test_language(documents):
    rows = [(k, "the house of the man and the dog", "en") for k in range(12)] + [(50 + k, "das haus und der mann ist nicht", "de") for k in range(12)]
    rows += [(i, t, None) for i, t in AWKWARD] + [(200, "12 34 !!", "en")]
    found = langid.predict_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.lang_pred, r.score))
    assert by[0] == {("en", by[0].copy().pop()[1])} and next(iter(by[50]))[0] == "de"
    assert by[1] >= {("und", 0.0)} and by[200] == {("und", 0.0)} and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in langid.predict_documents(documents([(1, "abc", None)])).collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    found = queries.op7_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet"), "doc_id").where("held_out").select("lang_pred", "lang").collect()
    assert len(found) > 200 and np.mean([p == q for p, q in found]) > 0.98


VECTORS = "vec_id long, embedding array<float>, label int, id long, n long, dim string, row string"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 0, 5, 6, "d", "r") for i, v in rows], schema)


def awkward_vectors():
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 16))
    near = base[:1] + rng.standard_normal((60, 16)) * 0.12
    rows = [(k, list(map(float, v))) for k, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    same = rows[3][1]
    return rows + [(300, same), (301, same), (301, same), (302, [2 * x for x in same]), (400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [float("inf")] + [1.0] * 15), (405, [1.0, 2.0]), (406, [1.0, 2.0]), (None, same)] + [(407, [None] + [1.0] * 15)]


def is_good(i, v):
    return i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)


def test_subspace_join(spark):
    rows = awkward_vectors()
    for tile, blocks in ((10_000, 8), (20, 4), (60, 2)):
        found = Counter(map(tuple, subspace.near_vectors(vectors(spark, rows), blocks=blocks, tile=tile).collect()))
        unit = [np.array(v, dtype=float) / np.linalg.norm(v) if is_good(i, v) else None for i, v in rows]
        pairs = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
        links = Counter(x for p in pairs for x in p)
        reach = groups(pairs, range(len(rows)))
        least = defaultdict(list)
        for k, r in reach.items():
            least[r].append(rows[k][0])
        expected = Counter()
        for k, (i, _) in enumerate(rows):
            c = min(least[reach[k]]) if i is not None else None
            expected[i, links[k], c, None if i is None else i == c] += 1
        assert found == expected
    assert sum(links.values()) > 1000


def test_double_vectors_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99999, 0.001])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, subspace.near_vectors(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert subspace.near_vectors(rows.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ann.search(rows, rows.where("vec_id = 1")).collect()] == [(1, 1, 2)]
    assert ann.search(rows.limit(0), rows.limit(0)).collect() == []


@pytest.mark.parametrize("smallest,largest,query_block", [(512, 10_000, 1000), (10, 50, 7)])
def test_neighbours(spark, smallest, largest, query_block):
    rows = awkward_vectors()
    data = vectors(spark, rows)
    found = defaultdict(list)
    for r in ann.search(data, data.where("vec_id % 10 = 0"), k=5, smallest=smallest, largest=largest, query_block=query_block).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    good = [(i, np.array(v, dtype=float)) for i, v in rows if is_good(i, v) and len(v) == 16]
    asked = {i: v for i, v in good if i % 10 == 0}
    assert set(found) == set(asked)
    hits = 0
    for i, q in asked.items():
        expected = sorted((math.sqrt(((v - q) ** 2).sum()), j) for j, v in good if j != i)[:5]
        assert len(found[i]) == 5 and found[i] == sorted(found[i])
        hits += len({j for _, j in expected} & {j for _, j in found[i]}) / len({j for _, j in expected})
    assert hits / len(asked) >= 0.95


def test_neighbour_recall(spark):
    con = connect(MEDIUM)
    rows = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = queries.op6_nearest_neighbours(spark, MEDIUM).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits += len(best & {r.vec_id for r in found if r.query_id == q})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.95


def test_pages(spark):
    html = "<article><p>One</p><p>Two &eacute;</p></article>"
    pages = spark.createDataFrame([(1, "http://a.org/x", html, "t"), (1, "http://a.org/x", html, "t"), (2, None, None, "t"), (3, "x", "", "t")], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_text.extract(pages).collect())) == Counter([(1, "http://a.org/x", "One\nTwo é", 9)] * 2 + [(2, None, "", 0), (3, "x", "", 0)])
    judged = url_filter.judge(pages, [("block", "org", "/")], default="allow").collect()
    assert Counter(map(tuple, judged)) == Counter([(1, "a.org", "/x", "org/", "block")] * 2 + [(2, "", "", None, "allow"), (3, "", "", None, "allow")])
    odd = spark.createDataFrame([(1, "HTTP://User@Ä.Org:80?q=/a"), (2, "://"), (3, "a://b://c/d#e?f"), (None, "x://Y/Z\n/w?")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path) for r in url_filter.judge(odd, []).collect()}
    assert got == {1: ("user@Ä.org:80", ""), 2: ("", ""), 3: ("b:", "//c/d"), None: ("y", "/Z\n/w")}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(queries.queries()[name](spark, MEDIUM), connect(MEDIUM), queries.oracle_sql()[name]) is None


def test_empty_tables(spark, documents):
    none = documents([]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        simhash.near_duplicates(none), packing.pack(none), token_counts.count_by_section(none), pieces.digests(none), langid.predict_documents(none), quality.score_documents(none, labels),
        langid.identified_documents(none), quality.good_documents(none, labels), simhash.representatives(none),
    ):
        assert result.collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).collect() == [] and url_filter.judge(pages, [("block", "org", "/")]).collect() == []


def test_texts_in_no_learned_language_go(documents):
    rows = [(k, "the house of the man and the dog in it", "en") for k in range(12)] + [(50 + k, "das haus und der mann ist nicht hier", "de") for k in range(12)]
    rows += [(100, "Привет мир как дела у вас сегодня", None), (101, "xq zv kj " * 40, None), (102, "12 34", "en"), (103, None, "en"), (104, "the dog und der mann", None)]
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](None, documents(rows), "").collect()}
    assert kept == {*range(12), *range(50, 62), 104}


def test_pipeline_of_awkward_rows(spark, documents, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, more columns than the tables have; and an empty table."""
    rows = AWKWARD + [(20, "some other words " * 50), (20, "some other words " * 50), (21, "some other words " * 50), (21, "quite another text of the same id " * 9)]
    for name, given in (("rows", rows), ("none", [])):
        documents(given).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (9, 1, 0), (20, 1, 0), (21, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    found = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    docs = documents(rows)
    good = quality.good_documents(docs, spark.read.parquet(f"{tmp_path}/rows/labels.parquet"))
    kept = simhash.representatives(langid.identified_documents(good, least=corpus_pipeline.LEAST_LANGUAGE_SCORE)).collect()
    library = Tokenizer.from_file(packing.default_path())
    total = Counter()
    for r in kept:
        total[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in found:
        got[r.doc_id] += r.length
    assert got == total and 20 in got


def test_pipeline(spark):
    """Each stage against its brute-force form on what the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "best_fit_packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    good = {i for i in rows if scores[i]}
    lettered = {i for i in good if any(map(str.isalpha, rows[i].text or ""))}
    near = near_by_brute_force([(i, rows[i].text) for i in sorted(lettered)])
    kept = {i for i, _, c in near if i == c}
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in found} == kept and kept < set(rows)
    encoder = packing.load(packing.default_path())
    assert sum(r.length for r in found) == sum(len(encoder.encode(rows[i].text)) + 1 for i in kept)


def test_pipeline_stages_keep_the_columns(spark, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
        assert stage(spark, docs, SMALL).schema.simpleString() == docs.schema.simpleString()
