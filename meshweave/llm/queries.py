"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .collocations import collocations
from .common import documents, embeddings
from .exact_topk import exact_top_k
from .langid import predict_languages
from .lm import score_documents
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .product_codes import product_codes
from .sharding import shard_documents
from .simhash import simhash_duplicates
from .suffix_dedup import repeat_digests
from .token_counts import count_tokens


def op1_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op4_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 24)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(embeddings(spark, sf_dir), F.pmod("vec_id", F.lit(20)) == 0)


def op6_merge_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))


def op7_pack_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(embeddings(spark, sf_dir), F.pmod("vec_id", F.lit(100)) == 0)


def op10_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def op11_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gru_scores": op1_gru_scores,
    "op2_language_mixture": op2_language_mixture,
    "op3_mix_sources": op3_mix_sources,
    "op4_jump_hash_shards": op4_jump_hash_shards,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_merge_transforms": op6_merge_transforms,
    "op7_pack_round_robin": op7_pack_round_robin,
    "op8_count_tokens": op8_count_tokens,
    "op9_pivot_top_k": op9_pivot_top_k,
    "op10_chosen_path_dedup": op10_chosen_path_dedup,
    "op11_pivot_simhash": op11_pivot_simhash,
    "op12_collocations": op12_collocations,
    "op13_va_codes": op13_va_codes,
}

_MIX = r"""
WITH narrow AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))), 1, 13))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n FROM narrow GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
weighed AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM ranked),
totals AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
    coalesce(sum(source_size) OVER smaller, 0)::BIGINT AS capped_size, coalesce(sum(weight) OVER smaller, 0)::BIGINT AS capped_weight
  FROM weighed WINDOW smaller AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - 3 * capped_size)::DOUBLE / (weights - capped_weight)::DOUBLE AS level FROM totals),
capped AS (SELECT *, weight * level > 3 * source_size::DOUBLE AS is_capped FROM levels),
settled AS (
  SELECT *, (SELECT level FROM capped WHERE NOT is_capped ORDER BY source_size::DOUBLE / weight::DOUBLE, rank LIMIT 1) AS common FROM capped),
targets AS (
  SELECT source, rank, source_size, greatest(1, ceil(source_size::DOUBLE / n::DOUBLE))::BIGINT AS mean, CASE WHEN is_capped THEN 3::DOUBLE * source_size ELSE weight * common END AS target FROM settled),
times AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS times FROM targets),
parts AS (
  SELECT *, floor(times)::BIGINT AS whole, times - floor(times) AS r, target - (floor(times)::BIGINT * source_size)::DOUBLE AS wanted FROM times),
classed AS (
  SELECT n.doc_id, n.size, n.u, p.*, floor((1024 * n.size)::DOUBLE / (n.size + p.mean)::DOUBLE)::BIGINT AS class
  FROM narrow n JOIN parts p ON n.source IS NOT DISTINCT FROM p.source),
chances AS (
  SELECT *, CASE WHEN r > 0 THEN r * (1 + (1 - r) * (((sum(size * class) OVER (PARTITION BY rank))::BIGINT::DOUBLE / source_size::DOUBLE - class::DOUBLE) / 1024::DOUBLE)) END AS p FROM classed),
odds AS (SELECT *, (u * (1 - p)) / ((1 - u) * p) AS odds FROM chances),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY odds NULLS FIRST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM odds)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies
FROM (SELECT *, whole + CASE WHEN r > 0 AND (2 * first + size)::DOUBLE <= 2 * wanted THEN 1 ELSE 0 END AS copies FROM placed)
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, max(list_dot_product(q.vec, x.vec)::BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.vec) = len(x.vec) WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

_NEAR = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS i, h FROM d WHERE len(h) >= 200),
hashed AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, 200)) AS w FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM hashed) WHERE nth > 1),
begins AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM again),
numbered AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begins),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(g.b, len(h) // 2) - a))::BIGINT), '' ORDER BY a) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM spot, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * u.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.cut + 1:], ' ') JOIN totals t ON t.lang = u.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM c, range(2, 5) x(s), range(1, 5) y(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase)::BIGINT AS rank, w.phrase, a, l, r, n, score::BIGINT AS score
FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000
"""


def _codes_sql(rounds: int = 4) -> str:
    """Product codes by exhaustive distances; one pair of tables a round."""
    out = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS MATERIALIZED (SELECT vec_id, e, p, vec[(p * (len(vec) // 4) + 1)::BIGINT:((p + 1) * (len(vec) // 4))::BIGINT] AS x FROM v, range(4) t(p)),
book0 AS (SELECT p, e, x AS c FROM q WHERE e < 256)"""
    for k in range(rounds + 1):
        out += f""",
near{k} AS MATERIALIZED (
  SELECT q.e AS row, q.p, min(struct_pack(d := (list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT, e := b.e)) AS best FROM q JOIN book{k} b ON b.p = q.p GROUP BY 1, 2)"""
        if k < rounds:
            out += f""",
means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT q.p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM q JOIN near{k} n ON n.row = q.e AND n.p = q.p, range(1, 1025) t(i) WHERE i <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)"""
    return out + f""",
coded AS (SELECT row, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: z::BIGINT), ','), ',' ORDER BY p, e)) AS s FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM v JOIN coded ON coded.row = v.e, digest
"""


ORACLE_SQL: dict[str, str] = {"op12_collocations": _PHRASES, "op13_va_codes": _codes_sql(), "op3_mix_sources": _MIX, "op6_merge_transforms": _REPEATS, "op9_pivot_top_k": _TOP_K, "op10_chosen_path_dedup": _NEAR}
