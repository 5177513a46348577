"""The registered queries of the training-data operators, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import ann, license, linededup, media, mixing, ngram, packing, quality, rans, unigram
from lumenrank.llm.common import materialise, scratch_folder, table


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store each text as a WAVE, read the bytes back, store the features computed from them, read those back and digest both."""
    stored = materialise(media.media_table(table(spark, sf_dir, "documents")), "media")
    computed = media.audio_features(stored).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "n_frames", "patches", "segments",
    )
    manifest = media.write_features(computed, scratch_folder(spark, "audio-features"))
    digest = F.concat_ws(":", F.lit("logmel"), "n_frames", F.size("patches"), F.size("segments"), F.lower(F.hex(F.xxhash64("patches", "segments"))))
    return media.read_features(spark, manifest, computed.schema).select(*computed.columns[:7], digest.alias("feature"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "removed_lines", "removed_chunks", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode ``documents`` into rANS files, read them back, report what the files hold."""
    manifest = rans.write_token_files(table(spark, sf_dir, "documents"), rans.token_folder(spark), end_id=2)
    return rans.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=0, capacity=2048)


def op8_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "round(target, 6) AS target", "taken")


REGISTERED = (
    op1_audio_features, op2_quality_discriminant, op3_ngram_jaccard, op4_line_dedup, op5_token_files,
    op6_license_scan, op7_best_fit_packing, op8_anisotropic_search, op9_unigram_counts, op10_mix_sources,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM sized GROUP BY source),
t AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () * 150 / 100.0 AS budget, sum(w) OVER () AS all_w FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS level
  FROM t WINDOW before AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
targets AS (
  SELECT source, source_size, least(cap, fixed.level * w) AS target FROM l, fixed),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         floor(t.target) AS budget, floor(floor(t.target) / greatest(t.source_size, 1)) AS whole
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(whole * size + least(size, greatest(0, budget - whole * source_size - start)) AS BIGINT) AS taken
FROM placed
"""


def _op3(words: int = 3, percent: int = 90) -> str:
    """All pairs that share a shingle, counted, then reachability."""
    fold = rf"regexp_extract_all(translate(text, '{license.UPPER}', '{license.LOWER}'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce({fold}, []) AS w FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.r AS a, y.r AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.r <> y.r
  GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT r, r FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(d.doc_id) AS component_id FROM reach JOIN sets d ON d.r = reach.b GROUP BY a) c ON c.a = s.r
"""


def _op6() -> str:
    """Every block against every template, with no filter."""
    places = [f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in license.PHRASES]
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(license.PHRASES))
    templates = ", ".join(f"('{label}', {sorted(set(license.words(t)))}, {license.block_size(len(license.words(t)))})" for label, t in license.TEMPLATES)
    words = r"regexp_extract_all(translate({}, '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (license.UPPER, license.LOWER)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, {words.format("text")} AS w FROM d),
base AS (SELECT *, {", ".join(f"{p} AS p{k}" for k, p in enumerate(places))} FROM words),
templates AS (SELECT * FROM (VALUES {templates}) AS t(label, words, size)),
sizes AS (SELECT DISTINCT size FROM templates),
starts AS (SELECT r, size, w, unnest(range(0, greatest(len(w) - size // 2, 1), size // 2)) AS first FROM words, sizes),
blocks AS (SELECT r, size, list_distinct(w[first + 1 : first + size]) AS b FROM starts),
met AS (
  SELECT r, label, len(list_intersect(b, words)) AS o, len(words) AS n FROM blocks JOIN templates USING (size)
  WHERE 100 * len(list_intersect(b, words)) >= {license.CONTAINMENT_PERCENT} * len(words)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(round(o / n, 6)) AS containment FROM met GROUP BY r),
named AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_concat(list_concat(p0, p1), p2) AS places FROM base)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(containment, 0.0))::DOUBLE AS score
FROM named LEFT JOIN found USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": _op3(), "op6_license_scan": _op6(), "op10_mix_sources": OP10}
