"""The operators over their whole tables, and the SQL their rows must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_matches
from .divergence import source_divergence
from .embeddings import near_duplicate_vectors
from .language import language_scores
from .lines import dedup_lines
from .minhash import minhash_groups
from .periods import looped_text, periodic_runs
from .pieces import decode_pieces, encode_pieces
from .quality import quality_scores
from .sharding import interleave_shards
from .substring import remove_repeated_passages
from .suffixes import remove_repeated_bytes
from .token_counts import edited_token_counts, release_edits

Build = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP1 = """
WITH tokens AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM tokens WHERE len(w) >= 13),
hashed AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS passage FROM windows),
marked AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY passage) AS gone FROM hashed),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM marked WHERE gone),
gone AS (SELECT doc_id, list(p) AS places, count(*) AS n FROM covered GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM tokens t LEFT JOIN gone USING (doc_id)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(_read(spark, sf_dir, "documents"))


# crc32 by its table of 256 remainders, made by eight halvings each; a left fold over the bytes of a text.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_OP4 = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
rows AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key,
         hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, source, size, key,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, size * 2 - 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM rows, crc),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS part FROM summed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, key, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // total)::INT AS shard,
       place - ((place * 8 // total) * total + 7) // 8 AS slot, NULL::INT AS grown_shard FROM placed
"""

def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their number, and the checksum of the text decoded from them."""
    decoded = decode_pieces(encode_pieces(_read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after the edits of a release, with the checksum of the edited text."""
    counted = edited_token_counts(release_edits(_read(spark, sf_dir, "documents")))
    return counted.select("doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", F.sha2("edited", 256).alias("edited_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten of which ends in a loop: their number, the longest, and checksums of all and of what is left."""
    docs = _read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", looped_text(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat(*[x for name in ("start", "length", "period") for x in (r[name].cast("string"), F.lit("\n" if name == "period" else ","))])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.s")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.p")).alias("period"), F.floor(1000 * F.col("_longest.length") / -F.col("_longest.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as hexadecimal text: two letters a byte, so substrings are cut by letters.
_OP12 = """
WITH bytes AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS place FROM bytes WHERE n >= 100),
gone AS (
  SELECT unnest(list_sort(list((doc_id, place)))[2:]) AS w FROM windows GROUP BY substr(h, 2 * place + 1, 200) HAVING count(*) > 1),
marked AS (SELECT w[1] AS doc_id, w[2] AS place FROM gone),
islands AS (SELECT doc_id, place, place > 100 + lag(place, 1, -1000) OVER (PARTITION BY doc_id ORDER BY place) AS opens FROM marked),
numbered AS (SELECT doc_id, place, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM islands),
spans AS (SELECT doc_id, min(place) AS a, max(place) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


_OP13 = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
known AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM texts),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total, sum(coalesce(sum(n), 0)) OVER (PARTITION BY lang) AS lang_total FROM sources LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM totals JOIN known USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM rows QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


# Smallest id reachable, by spreading labels until none changes.
_REACHED = """
reach AS (
  SELECT id, id AS least FROM nodes
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id WHERE r.least < l.b),
roots AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)
"""
_OP7 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (SELECT id, v FROM nodes WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM sound x JOIN sound y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
{_REACHED}
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, component_id, n.id = component_id AS kept
FROM nodes n JOIN roots r ON r.id = n.id
"""
_OP10 = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
tokens AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tokens WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
{_REACHED}
SELECT r.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, r.id = component_id AS kept FROM roots r LEFT JOIN sizes s ON s.doc_id = r.id
"""

QUERIES: dict[str, Build] = {"op1_substring_dedup": op1_substring_dedup, "op2_sentencepiece": op2_sentencepiece, "op3_quality_classifier": op3_quality_classifier, "op4_sharding": op4_sharding, "op5_line_dedup": op5_line_dedup, "op6_token_counts": op6_token_counts,
                             "op7_embedding_near_dedup": op7_embedding_near_dedup,
                             "op8_lm_scoring": op8_lm_scoring, "op9_benchmark_decontamination": op9_benchmark_decontamination, "op10_minhash_near_dedup": op10_minhash_near_dedup,
                             "op11_periodic_runs": op11_periodic_runs, "op12_suffix_array_dedup": op12_suffix_array_dedup,
                             "op13_source_divergence": op13_source_divergence}
SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op4_sharding": _OP4, "op7_embedding_near_dedup": _OP7, "op10_minhash_near_dedup": _OP10, "op12_suffix_array_dedup": _OP12, "op13_source_divergence": _OP13}
