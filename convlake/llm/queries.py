"""One query per operator, over its whole tables with production parameters, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import store, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import encode_documents, read_media

    return read_media(store(encode_documents(table(spark, sf_dir, "documents")), "media"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import deduplicate_words

    return deduplicate_words(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicate_bytes

    return deduplicate_bytes(table(spark, sf_dir, "documents"))


def op7_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_era_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OPERATORS = (op1_sharding, op2_ogg, op3_warc, op4_recompression, op5_licences, op6_suffix_merge, op7_inverted_index, op8_order_minhash, op9_pfair, op10_toxicity, op11_era_collocations, op12_hard_negatives, op13_positive_unlabelled_quality)
QUERIES = {f.__name__: f for f in _OPERATORS}
_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
spans AS (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM placed),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM spans WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest p WHERE NOT EXISTS (
    SELECT 1 FROM cand q WHERE q.lang = p.lang AND 100 * q.a >= 100 * p.a AND len(q.w) > len(string_split(p.phrase, ' ')) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, cut FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
_HARD_NEGATIVES = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
ORACLES: dict[str, str] = {"op12_hard_negatives": _HARD_NEGATIVES, "op11_era_collocations": _COLLOCATIONS}
