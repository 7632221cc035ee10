"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, html, minhash, mixing, quality, topk, toxicity, urlfilter, vectordup

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), alpha=0.1, seed=23)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = dac.write(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return dac.documents(spark, path)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_read(spark, sf_dir, "documents"), seed=17, share=1.5, max_epochs=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats", "part")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), percent=75)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_sentencepiece_dropout, op2_url_filter, op3_exact_top_k, op4_html_main_text, op5_toxicity_chain, op6_vector_near_dedup, op7_token_file, op8_source_mix, op9_minhash_near_dedup, op10_quality_classifier)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FINITE = "{0} IS NOT NULL AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

SQL: dict[str, str] = {
    "op2_url_filter": f"""
WITH split AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
named AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || split_part(path, '/', 1) LIKE '%spam-farm.%' OR host || split_part(path, '/', 1) LIKE '%cheap-pills.%' THEN 'block' ELSE 'allow' END AS verdict FROM named""",
    "op3_exact_top_k": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings WHERE {_FINITE.format('embedding')}),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_vector_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {_FINITE.format('embedding')} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON r.other = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least_of AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(m, e.vec_id), e.vec_id) AS component_id, coalesce(least(m, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings AS e LEFT JOIN counted AS c ON c.a = e.vec_id LEFT JOIN least_of AS l ON l.node = e.vec_id""",
    "op9_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM w),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM g),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON r.other = l.a),
least_of AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(least(m, doc_id), doc_id) AS component_id, coalesce(least(m, doc_id), doc_id) = doc_id AS kept FROM g LEFT JOIN least_of ON node = doc_id""",
    "op8_source_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT level FROM l AS x WHERE x.cap / x.weight >= x.level ORDER BY x.cap / x.weight, x.source IS NULL, x.source LIMIT 1) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.whole, round(p.target - p.whole * p.source_size)::BIGINT - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT *, greatest(0, least(size, room)) AS part FROM c)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken, source,
  CASE WHEN size = 0 THEN 0 ELSE whole + (part = size)::BIGINT END::BIGINT AS repeats, CASE WHEN part = size THEN 0 ELSE part END::BIGINT AS part FROM k""",
}
