"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import embedding_components
from .exact_dedup import exact_dedup
from .language_id import predict_language
from .licences import scan
from .mixing import mix
from .packing import pack, piece_digests
from .phrases import phrases
from .quality import score_documents, with_verdict
from .simhash_dedup import simhash_components
from .suffix_dedup import repeated_spans, span_digests
from .token_store import token_output
from .unit_dedup import unit_dedup, with_span_text
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_span_text(unit_dedup(_table(spark, sf_dir, "documents")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(repeated_spans(_table(spark, sf_dir, "documents")))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).drop("kept")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents")).drop("places")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_embedding_dedup, op2_unit_dedup, op3_source_mixing, op4_harmonic_packing, op5_language_id, op6_suffix_dedup,
        op7_token_output, op8_exact_dedup, op9_quality_classifier, op10_simhash_dedup, op11_phrase_mining,
        op12_license_scan, op13_embedding_whitening,
    ]
    return {f.__name__: f for f in found}


_OP8 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""


_OP2 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM t),
laid AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
cut AS (SELECT doc_id, pos, line, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+')) AS part,
               generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+'), 1) AS nth FROM laid),
parts AS (SELECT doc_id, line, part, pos + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, pos ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM cut),
units AS (
  SELECT doc_id, pos AS a, least(pos + length(line) + 1, length(text)) AS b, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS unit, 13 AS need
  FROM laid JOIN t USING (doc_id)
  UNION ALL
  SELECT doc_id, pos, pos + length(part), trim(regexp_replace(lower(part), '\s+', ' ', 'g')), 8
  FROM parts WHERE trim(regexp_replace(part, '\s+', ' ', 'g')) <> trim(regexp_replace(line, '\s+', ' ', 'g'))
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, a, b) AS nth FROM units WHERE unit <> '' AND length(unit) - length(replace(unit, ' ', '')) + 1 >= need),
gone AS (SELECT doc_id, a, b FROM ranked WHERE nth > 1),
open AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM gone),
island AS (SELECT *, sum(new::int) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM open),
span AS (SELECT doc_id, k, min(a) AS a, max(b) AS b FROM island GROUP BY ALL),
hole AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS before, lead(a) OVER w AS after FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
),
kept AS (
  SELECT doc_id, string_agg(substr(text, (before + 1)::bigint, (a - before)::bigint) || CASE WHEN after IS NULL THEN substr(text, (b + 1)::bigint) ELSE '' END, '' ORDER BY a) AS text,
         sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(a::bigint || '-' || b::bigint, ',' ORDER BY a) AS removed_spans
  FROM hole JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, coalesce(kept.text, t.text) AS text, length(t.text) AS n_chars, coalesce(n_removed, 0)::bigint AS n_removed,
       coalesce(n_spans, 0) AS n_spans, coalesce(removed_spans, '') AS removed_spans
FROM t LEFT JOIN kept USING (doc_id)
"""


_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded) CROSS JOIN range(1, 6) r(m) WHERE i + m - 1 <= len(w)
),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
inside AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS b
  FROM cand CROSS JOIN range(2, 5) x(k) CROSS JOIN range(1, 5) y(s) WHERE k < m AND s + k - 1 <= m GROUP BY ALL
),
left_over AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, ((1000::hugeint * c.a * n) // (x.a::hugeint * y.a))::bigint AS score
  FROM left_over c CROSS JOIN range(1, 5) z(k) JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
  WHERE k < c.m
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_mining": _OP11, "op2_unit_dedup": _OP2, "op8_exact_dedup": _OP8}
