"""The queries of this folder's operators: (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and occurring benchmark items of every document."""
    from . import decontam

    out = decontam.scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stay after fuzzy line dedup over all documents."""
    from pyspark.sql import functions as F

    from . import lines

    kept = lines.keep_lines(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    import public_tokenizers

    from . import tokens

    return tokens.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after repeated 400-byte strings go, and how many shorter repeated strings cover."""
    from . import substrings

    return substrings.removed(load(spark, sf_dir, "documents")).drop("spans")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to the target mix and globally shuffled."""
    from . import mixing

    return mixing.mix(load(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and components of all documents' 5-word shingle sets."""
    from . import jaccard

    return jaccard.links(load(spark, sf_dir, "documents"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures drawn from every vector (and edited copies of every tenth) with the group of copies each belongs to."""
    from . import media

    return media.copies(media.render_media(load(spark, sf_dir, "embeddings")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from . import quality

    return quality.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from . import pii

    return pii.find(load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    from . import warc

    return warc.round_trip(load(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_line_dedup,
        op3_token_binary,
        op4_substring_dedup,
        op5_source_mixing,
        op6_ngram_jaccard,
        op7_media_copies,
        op8_quality,
        op9_pii,
        op10_warc,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_source_mixing"] = """
WITH by_source AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM by_source) * (SELECT sum(n) FROM by_source) / n AS rate FROM by_source),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM ks),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM terms),
uniform AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM uniform d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""

ORACLE_SQL["op1_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
bw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
grams AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, p, k, item_id FROM grams JOIN win USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op6_ngram_jaccard"] = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM dw WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
linked AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1) USING (doc_id)
"""

ORACLE_SQL["op10_warc"] = """
WITH base AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM base),
keep AS (SELECT payload_digest, max(page_id) AS keep FROM sized WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
  CASE WHEN keep IS NULL OR s.page_id IS NULL OR keep = s.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep IS NULL OR s.page_id IS NULL OR keep = s.page_id THEN NULL ELSE keep END AS refers_to
FROM sized s LEFT JOIN keep USING (payload_digest)
"""
