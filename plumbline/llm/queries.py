"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, htmltext, mixing, multisethash, quality, secrets, sharding, simhash, suffixdedup, urlgraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by place; the value itself is given as a digest."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select(
        "doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisethash.edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("vector")).alias("fingerprint"),
        F.lower(F.hex("edited_vector")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_secret_scans": op2_secret_scans,
        "op3_html_extraction": op3_html_extraction,
        "op4_source_mixing": op4_source_mixing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_byte_level_bpe": op6_byte_level_bpe,
        "op7_url_filters": op7_url_filters,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_document_fingerprints": op10_document_fingerprints,
        "pipeline": pipeline,
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A source's stream is its documents in the order of a digest; the slots it wins take its blocks, from the first on, and again.
MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         md5('0|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), sources AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source)
), levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT)
            / CAST((SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0) AS BIGINT) AS level
  FROM sources WINDOW before AS (ORDER BY source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, nth, source_size,
         least(CAST(3 * source_size AS DOUBLE), w * (SELECT max(level) FROM levels WHERE level * w <= 3 * source_size)) AS target
  FROM levels
), blocks AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE CAST(ceil(source_size / greatest(ceil(source_size / most), least(source_size, 128))) AS BIGINT) END AS block
  FROM (SELECT *, greatest(4096, ceil((SELECT sum(source_size) FROM targets) / 2147483648)) AS most FROM targets)
), planned AS (
  SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS per_epoch,
         CAST(round(round(target) * CAST(ceil(source_size / block) AS DOUBLE) / greatest(source_size, 1)) AS BIGINT) AS slots
  FROM blocks
), shares AS (
  SELECT source AS of, nth, source_size, target, block, per_epoch, sum(slots) OVER (ORDER BY nth) - slots AS low, sum(slots) OVER (ORDER BY nth) AS high FROM planned
), points AS (
  SELECT ((i + 1)::HUGEINT * 11400714819323198485 % 18446744073709551616) * (SELECT max(high) FROM shares) // 18446744073709551616 AS point
  FROM range((SELECT CAST(max(high) AS BIGINT) FROM shares)) r(i)
), won AS (
  SELECT s.*, least(CAST((SELECT count(*) FROM points WHERE point >= low AND point < high) AS BIGINT), 3 * per_epoch) AS n FROM shares s
), placed AS (
  SELECT s.doc_id, s.size, t.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM sized s JOIN won t ON s.source IS NOT DISTINCT FROM t.of
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE n // per_epoch * size + greatest(0, least(size, n % per_epoch * block - start)) END AS taken
FROM placed
"""

#: Scores are sums over walks along links: of the share that starts at a seed, what each step passes on.
URL_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
), verdicts AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM ruled
), seeds AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad
  FROM verdicts WHERE host <> '' GROUP BY host
), links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^\s"''>]+)', 1)) AS link FROM parts)
  ) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), passed AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS out_w, n / sum(n) OVER (PARTITION BY dst) AS in_w FROM links
), trust(host, score, k) AS (
  SELECT host, (1 - 0.85::DOUBLE) * good, 0 FROM seeds WHERE good > 0
  UNION ALL SELECT dst, 0.85::DOUBLE * out_w * score, k + 1 FROM trust JOIN passed ON src = host WHERE k < 30
), distrust(host, score, k) AS (
  SELECT host, (1 - 0.85::DOUBLE) * bad, 0 FROM seeds WHERE bad > 0
  UNION ALL SELECT src, 0.85::DOUBLE * in_w * score, k + 1 FROM distrust JOIN passed ON dst = host WHERE k < 30
)
SELECT page_id, v.host, path, rule, coalesce(ruled,
  CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > 0.5::DOUBLE * (1 - 0.85::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM verdicts v
LEFT JOIN (SELECT host, sum(score) AS score FROM trust GROUP BY host) t ON t.host = v.host
LEFT JOIN (SELECT host, sum(score) AS score FROM distrust GROUP BY host) d ON d.host = v.host
"""

#: Sketches are counts of logarithmic bins; a quantile is the value of the first bin that reaches its share.
QUALITY_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), windows AS (
  SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three
  FROM (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs) WINDOW o AS (PARTITION BY rid ORDER BY pos)
), again AS (
  SELECT rid, pos, three IS NOT NULL AND count(*) OVER (PARTITION BY rid, three) > 1 AS twice FROM windows
), repeats AS (
  SELECT rid, count(*) FILTER (twice OR coalesce(lag1, false) OR coalesce(lag2, false)) AS n FROM (
    SELECT rid, twice, lag(twice) OVER o AS lag1, lag(twice, 2) OVER o AS lag2 FROM again WINDOW o AS (PARTITION BY rid ORDER BY pos)
  ) GROUP BY rid
), stats AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs) LEFT JOIN repeats USING (rid)
), signals AS (
  SELECT lang, source, unnest(['mean_word', 'symbols', 'dup_lines', 'repeats']) AS signal,
         unnest([word_chars / n_words, n_symbols / n_words, n_dup_lines / greatest(n_lines, 1), n_repeat_words / n_words]) AS x
  FROM stats WHERE n_words > 0
), bins AS (
  SELECT lang, source, signal, CASE WHEN x <= 1e-6 THEN -10000 ELSE ceil(ln(x) / ln(1.01::DOUBLE / 0.99)) END AS bin, count(*) AS n
  FROM signals GROUP BY ALL
), ranked2 AS (
  SELECT signal, bin, n, sum(n) OVER (PARTITION BY signal ORDER BY bin) AS run, sum(n) OVER (PARTITION BY signal) AS total
  FROM (SELECT signal, bin, sum(n) AS n FROM bins GROUP BY ALL)
), lent2 AS (
  SELECT signal, bin, 3 * (100 * run // total - 100 * (run - n) // total) AS n FROM ranked2
), ranked1 AS (
  SELECT lang, signal, bin, n, sum(n) OVER (PARTITION BY lang, signal ORDER BY bin) AS run, sum(n) OVER (PARTITION BY lang, signal) AS total
  FROM (SELECT lang, signal, bin, sum(n) AS n FROM (
    SELECT lang, signal, bin, n FROM bins
    UNION ALL SELECT lang, l.signal, e.bin, e.n FROM (SELECT DISTINCT lang, signal FROM bins) l JOIN lent2 e ON l.signal = e.signal
  ) GROUP BY ALL)
), lent1 AS (
  SELECT lang AS l, signal, bin, 3 * (100 * run // total - 100 * (run - n) // total) AS n FROM ranked1
), ranked AS (
  SELECT lang, source, signal, CASE WHEN bin = -10000 THEN 0 ELSE pow(1.01::DOUBLE / 0.99, bin) END AS x,
         sum(n) OVER (PARTITION BY lang, source, signal ORDER BY bin) AS run, sum(n) OVER (PARTITION BY lang, source, signal) AS total
  FROM (SELECT lang, source, signal, bin, sum(n) AS n FROM (
    SELECT lang, source, signal, bin, n FROM bins
    UNION ALL SELECT g.lang, g.source, g.signal, w.bin, w.n FROM (SELECT DISTINCT lang, source, signal FROM bins) g
      JOIN lent1 w ON g.lang IS NOT DISTINCT FROM w.l AND g.signal = w.signal WHERE w.n > 0
  ) GROUP BY ALL)
), chosen AS (
  SELECT lang, source, signal, high + greatest(0.5::DOUBLE * (far - high), 2.0::DOUBLE * (high - mid)) AS cut
  FROM (SELECT lang, source, signal, min(x) FILTER (100 * run >= 50 * total) AS mid, min(x) FILTER (100 * run >= 90 * total) AS high,
               min(x) FILTER (100 * run >= 99 * total) AS far FROM ranked GROUP BY lang, source, signal)
), wide AS (
  SELECT lang AS l, source AS s, max(cut) FILTER (signal = 'mean_word') AS mean_word, max(cut) FILTER (signal = 'symbols') AS symbols,
         max(cut) FILTER (signal = 'dup_lines') AS dup_lines, max(cut) FILTER (signal = 'repeats') AS repeats
  FROM chosen GROUP BY lang, source
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(word_chars / greatest(n_words, 1) > mean_word OR n_symbols / greatest(n_words, 1) > symbols
           OR n_dup_lines / greatest(n_lines, 1) > dup_lines OR n_repeat_words / greatest(n_words, 1) > repeats, false) AS above
  FROM stats LEFT JOIN wide ON lang IS NOT DISTINCT FROM l AND source IS NOT DISTINCT FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM judged
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others' hashes, forests, flows and tokens have no counterpart in it."""
    return {"op4_source_mixing": MIXING_SQL, "op7_url_filters": URL_SQL, "op9_quality_rules": QUALITY_SQL}
