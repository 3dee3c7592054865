"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corveil.llm import divergence, embeddings, html, langid, lexical, matroska, mixing, packing, quality, sharding, simhash, toxicity, urls
from corveil.llm.common import table


#: The installed vocabulary; each machine has its own copy at this place.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, its model taught by all documents."""
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4096 tokens."""
    return packing.best_fit_pack(packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, under the law `rows`."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media and read back, with digests of both."""
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and where."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "covered")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of its links."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's address."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and its most typical terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and whether the base rules and the outlier rule keep it."""
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_sharding, op4_media_columns, op5_toxicity, op6_mixing, op7_html_extraction, op8_simhash_near_dedup, op9_url_filters, op10_embedding_near_dedup, op11_source_divergence, op12_lexical_search, op13_quality_rules)}


MIXING = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE number % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope, 2 * source_size AS bound FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY bound::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(level, (bound::DOUBLE / weight, number)) AS final FROM l WHERE level * weight <= bound
), t AS (
  SELECT source, source_size, slope, CASE WHEN final IS NULL OR final * weight > bound THEN bound::DOUBLE ELSE final * weight END AS target FROM l, f
), p AS (
  SELECT doc_id, size, source_size, slope, target, floor(target)::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, greatest(0, least(size, whole - before))::BIGINT AS once, greatest(0, least(size, whole - source_size - before))::BIGINT AS twice,
    least(1.0::DOUBLE, before / target) AS u, least(1.0::DOUBLE, (before + source_size) / target) AS v FROM p
), q AS (
  SELECT *, CASE WHEN once > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 9) END AS position,
    CASE WHEN twice > 0 THEN round(CASE WHEN slope = 0 THEN v ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * v) - (1 - slope)) / (2 * slope) END, 9) END AS again FROM g
)
SELECT doc_id, size, source_size, target, once + twice AS taken, position, greatest(position, again) AS last_position FROM q
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM pairs GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), w AS (
  SELECT k, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT g.lang, g.source, term, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term) c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM n
), q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY lang, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', lang, source, item, value FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 50
"""

LEXICAL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM benchmark
), s AS (
  SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_words FROM d
), c AS (
  SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs
), r AS (
  SELECT q, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
  FROM i JOIN c USING (term) JOIN w USING (term), s GROUP BY q, item_id, k, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": MIXING, "op10_embedding_near_dedup": EMBEDDINGS, "op11_source_divergence": DIVERGENCE, "op12_lexical_search": LEXICAL}
