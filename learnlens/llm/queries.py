"""The registered queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm import ann, centroids, decontamination, hard_negatives, html_text, langid, packing, pieces, quality, simhash, subspace, token_counts, url_filter


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, folder, "pages"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_by_section(_table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every document."""
    return quality.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return langid.predict_documents(_table(spark, folder, "documents"))


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of all other vectors for every vector whose id is divisible by 100."""
    vectors = _table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links at a cosine of 0.95 or more, and their components, over all vectors."""
    return subspace.near_vectors(_table(spark, folder, "embeddings"))


def op9_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's pieces, by the model's own merges and by the Viterbi search, and of their decoding."""
    return pieces.digests(_table(spark, folder, "documents"))


#: (verdict, rule) in production.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return url_filter.judge(_table(spark, folder, "pages"), [url_filter.parse_rule(rule, verdict) for verdict, rule in URL_RULES])


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark, and the items they come from."""
    return decontamination.digests(decontamination.occurrences(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; labels of ids divisible by 7 are shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, idless=True)


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every vector after three rounds, with inertia and digests of the centroids."""
    return centroids.cluster(_table(spark, folder, "embeddings"))


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e,
    coalesce(len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0, false) AS good
  FROM embeddings
), pairs AS (
  SELECT a.n AS a, b.n AS b FROM v a JOIN v b
    ON a.n <> b.n AND a.good AND b.good AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(n, m) AS (
  SELECT n, n FROM v UNION SELECT reach.n, b FROM reach JOIN pairs ON reach.m = pairs.a
), least AS (SELECT reach.n, min(vec_id) AS component_id FROM reach JOIN v ON v.n = reach.m GROUP BY reach.n)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = v.n) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (n)
"""

URL_SQL = """
WITH rest AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY len(rule_host) DESC, len(rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.n AS a, b.n AS b, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n AND len(a.e) = len(b.e)
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5
), found AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS rank
  FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""


PASSAGE_SQL = r"""
WITH folded AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT n, size, i, w[i:i + size - 1] AS win
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM folded, (SELECT DISTINCT size FROM windows))
), met AS (SELECT n, i, size, item_id FROM places JOIN windows USING (size, win)),
hit AS (SELECT n, count(DISTINCT j) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS j FROM met) GROUP BY n),
named AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit USING (n) LEFT JOIN named USING (n)
"""


def _centroid_sql(rounds: int = 3) -> str:
    """Each round: the nearest centroid of every vector, then new centroids from exact sums; empty clusters keep theirs."""
    parts = [
        """
  v AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  ), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS cluster, e AS c FROM v QUALIFY cluster < 16
  )"""
    ]
    nearest = """a{k} AS MATERIALIZED (
    SELECT n, min(struct_pack(distance := list_sum([(e[i] - c[i]) * (e[i] - c[i]) FOR i IN range(1, 65)])::BIGINT, cluster := cluster)) AS best FROM v, c{k} GROUP BY n
  )"""
    for k in range(rounds):
        parts.append(nearest.format(k=k))
        parts.append(f"""s{k} AS MATERIALIZED (
    SELECT best.cluster AS cluster, i, sum(e[i])::BIGINT AS s, count(*) AS m FROM a{k} JOIN v USING (n), range(1, 65) r(i) GROUP BY ALL
  ), c{k + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(moved, c) AS c FROM c{k} LEFT JOIN (SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY i) AS moved FROM s{k} GROUP BY cluster) USING (cluster)
  )""")
    parts.append(nearest.format(k=rounds))
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, best.cluster::INT AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (n) JOIN c{rounds} ON c{rounds}.cluster = best.cluster
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_html_text, op2_simhash, op3_best_fit_packing, op4_token_counts, op5_quality_classifier, op6_nearest_neighbours, op7_language_id, op8_embedding_near_dedup, op9_sentence_pieces, op10_url_filter, op11_decontamination, op12_hard_negatives, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op8_embedding_near_dedup": VECTOR_SQL, "op10_url_filter": URL_SQL, "op11_decontamination": PASSAGE_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_centroid_clusters": _centroid_sql()}
