"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base-32 digits of the SHA-1, five bits at a time, from 20-bit groups of the hexadecimal form.
WARC_SQL = """
WITH p AS (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, url, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest),
u AS (SELECT *, md5('request|' || page_id || '|' || payload_digest) AS r, md5('metadata|' || page_id || '|' || payload_digest) AS m FROM d JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to,
  '<urn:uuid:' || concat_ws('-', substr(r, 1, 8), substr(r, 9, 4), substr(r, 13, 4), substr(r, 17, 4), substr(r, 21, 12)) || '>' AS request_id,
  'GET ' || regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || repeat(chr(13) || chr(10), 2) AS request,
  '<urn:uuid:' || concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) || '>' AS metadata_id,
  'payloadBytes: ' || payload_bytes || chr(13) || chr(10) AS metadata
FROM u
"""

#: All links by a join on shingles, and what each document reaches over them.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

WORDS = r"[^\x20\x09-\x0D]+"

#: The counts of op9 and its plain rules.
COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
three AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS p, w FROM d WHERE len(w) > 2),
found AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM three),
again AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM found WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM d) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

#: The edited texts of op8.
EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS following FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 3) || substring(following, 1, length(t) // 3)) AS edited_sha256 FROM n
"""


def _base_sql() -> str:
    """The base of op6, with the fold of every id by a byte-wise CRC-32."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return rf"""
WITH k AS (SELECT {table}::BIGINT[] AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {crc} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), ' ') AS w FROM documents, k),
tokens AS (SELECT r, held_out, unnest(w) AS token FROM d),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counts),
scored AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1)::DOUBLE)) AS s FROM tokens LEFT JOIN counts USING (token), total GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(s, 3) AS base_score FROM d JOIN scored USING (r), total
"""


Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.html_main import extract_main

    return extract_main(_table(spark, sf_dir, "pages"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture as its assembled transaction tells it, with what its own request and metadata records say."""
    from bitspark.llm import warc
    from bitspark.llm.scratch import fresh, store

    path = fresh(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    records = store(warc.read_warc(spark, path), "records")  # parsed once; captures, parts and originals are three reads of it
    whole = warc.assemble(records)
    size = F.coalesce("capture.payload_bytes", "original.payload_bytes")
    digest = F.coalesce("original.payload_digest", "capture.payload_digest")
    return whole.select(
        "capture.page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("capture.type").alias("record_type"), F.col("original.page_id").alias("refers_to"),
        F.col("request.record_id").alias("request_id"), F.col("request.fields").alias("request"), F.col("metadata.record_id").alias("metadata_id"), F.col("metadata.fields").alias("metadata"),
    )


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))[0].drop("source")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as it is read back from the shards."""
    from bitspark.llm.scratch import fresh
    from bitspark.llm.training_order import materialise, read_sequences

    path = fresh(spark, "shards")
    materialise(_table(spark, sf_dir, "documents"), path)
    back = read_sequences(spark, path)
    return back.select("doc_id", "part", "slot", F.length("tokens").cast("bigint").alias("n_tokens"), F.crc32("tokens").alias("crc"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.interpolation import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/id`` of one tree."""
    from bitspark.llm.licenses import scan

    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"), "text")
    found = scan(files)
    return found.select(F.substring_index("path", "/", -1).cast("bigint").alias("doc_id"), "*")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.spotsigs import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.sigtree import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.divergence import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitspark.llm.compression import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def interpolation_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6's base, fold and token counts are, which SQL can tell."""
    made = op6_deleted_interpolation(spark, sf_dir)
    return made.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's edited texts, by their digest."""
    return op8_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts and plain rules."""
    return op9_robust_outliers(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Query]:
    return {
        "op1_host_suffix_array": op1_host_suffix_array,
        "op2_warc_transactions": op2_warc_transactions,
        "op3_length_buckets": op3_length_buckets,
        "op4_mixing": op4_mixing,
        "op5_training_order": op5_training_order,
        "op6_deleted_interpolation": op6_deleted_interpolation,
        "op7_license_scan": op7_license_scan,
        "op8_spotsigs": op8_spotsigs,
        "op9_robust_outliers": op9_robust_outliers,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_filter_audit": op11_filter_audit,
        "op12_source_divergence": op12_source_divergence,
        "op13_compression_classifier": op13_compression_classifier,
        "interpolation_base": interpolation_base,
        "edited_texts": edited_texts,
        "quality_counts": quality_counts,
    }


def oracle_sql() -> dict[str, str]:
    from bitspark.llm import divergence, filter_audit, licenses, mixing, packing

    files = "SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, text FROM documents"
    return {
        "op7_license_scan": licenses.oracle(files), "op2_warc_transactions": WARC_SQL, "op3_length_buckets": packing.oracle(), "op4_mixing": mixing.oracle(), "op10_ngram_jaccard_join": NEAR_SQL, "op11_filter_audit": filter_audit.ORACLE, "op12_source_divergence": divergence.ORACLE,
        "interpolation_base": _base_sql(), "edited_texts": EDITED_SQL, "quality_counts": COUNTS_SQL,
    }
