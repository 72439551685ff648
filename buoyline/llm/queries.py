"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from buoyline.llm import bpe, common, langid, licenses, mixing, phrases, pii, ranking, rpforest, secret_scan, simhash, sketches, toxicity, warc
from buoyline.session import scratch_path


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_neighbours(common.read_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.search(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.read_table(spark, sf_dir, "documents"), vocabulary())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(common.read_table(spark, sf_dir, "documents"), size=3, distance=3)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), epochs=3)
    first = F.get("mix_positions", F.lit(0))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"), first.alias("position")).orderBy("position", "doc_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.made_model(spark))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages")
    path = warc.write_archive(pages, scratch_path(spark, "warc"), least_bytes=0)
    captures = warc.assemble(warc.read_records(spark, path))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), "capture.payload_bytes", "capture.payload_digest",
        F.col("capture.type").alias("record_type"), "refers_to")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(common.read_table(spark, sf_dir, "documents"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_fingerprints, op3_neighbours, op4_language, op5_bpe, op6_simhash, op7_mixing, op8_secrets, op9_licenses, op10_warc,
                               op11_toxicity, op12_phrases, op13_ranking)
}

OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per_source
), weighed AS (
  SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS base, CAST(rank % 3 - 1 AS DOUBLE) * 0.5::DOUBLE AS slope, source_size * 3 AS cap FROM ranked
), ramped AS (
  SELECT *, base * (1.0::DOUBLE - slope) AS w0, base * (1.0::DOUBLE + slope) AS w1 FROM weighed
), summed AS (
  SELECT *, (w0 + w1) / 2.0::DOUBLE AS weight FROM ramped
), leveled AS (
  SELECT *,
    CAST(coalesce(sum(cap) OVER tight, 0) AS BIGINT) AS capped, coalesce(sum(weight) OVER tight, 0.0::DOUBLE) AS freed,
    CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(weight) OVER () AS weights
  FROM summed
  WINDOW tight AS (ORDER BY cap / weight ASC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, CAST(total - capped AS DOUBLE) / (weights - freed) AS level FROM leveled
), final AS (
  SELECT source, source_size, weight, w0, w1,
    least(CAST(cap AS DOUBLE), (SELECT j.level FROM judged j WHERE j.level * j.weight <= j.cap ORDER BY j.cap / j.weight, j.rank LIMIT 1) * weight) AS target
  FROM judged
), running AS (
  SELECT s.doc_id, s.size, f.*,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source
), counted AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) AS BIGINT) AS whole FROM running
), copied AS (
  SELECT *, CASE WHEN target > 0 THEN least(whole + CASE WHEN through - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END, 3) ELSE 0 END AS copies FROM counted
), placed AS (
  SELECT *, least((through - size / 2.0::DOUBLE) / target, 1.0::DOUBLE) * weight AS demand FROM copied
), rooted AS (
  SELECT *, w0 + sqrt(greatest(w0 * w0 + (w1 - w0) * greatest(demand, 0.0::DOUBLE) * 2.0::DOUBLE, 0.0::DOUBLE)) AS root FROM placed
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN least(CASE WHEN root > 0 THEN greatest(demand, 0.0::DOUBLE) * 2.0::DOUBLE / root ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END AS position
FROM rooted
"""

OP10_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS least_id FROM hashed
), quads AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS q FROM firsts
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(q, lambda x: [(x >> 15) & 31, (x >> 10) & 31, (x >> 5) & 31, x & 31])),
    lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(d + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least_id AND least_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least_id THEN least_id END AS refers_to
FROM quads
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), parts AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM parts GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM parts
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM starts, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS pos FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.pos, x.a AS l, y.a AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.pos], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.pos + 1:c.k], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1
), kept AS (
  SELECT * FROM least s WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = s.lang AND g.k > s.k AND 100 * g.a >= 100 * s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT row_number() OVER () AS row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM lists WHERE len(t) > 0
), stats AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), tf AS (
  SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), part AS (
  SELECT tf.row, tf.doc_id, tf.term,
    CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS part
  FROM tf JOIN df USING (term), stats
), total AS (
  SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM total WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES = {"op7_mixing": OP7_SQL, "op10_warc": OP10_SQL, "op12_phrases": OP12_SQL, "op13_ranking": OP13_SQL}
