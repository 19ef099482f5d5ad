"""The queries opN_<name> over the test tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_format
from .decontaminate import leaked_items
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_id import language_id
from .line_dedup import MIN_SITES, SPACES, remove_boilerplate
from .merkle import manifest
from .near_dup import near_duplicates
from .packing import pack
from .quality import quality_scores
from .substrings import remove_repeats
from .timestamps import DATE, TIME, normalise
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    back = warc_round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select(
        F.col("record_id").try_cast("long").alias("page_id"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, upper(sha1(coalesce(html, ''))) AS hx FROM pages
), g AS (
  SELECT hx, max(page_id) AS best FROM p GROUP BY hx
), v AS (
  SELECT page_id, octet_length(body) AS n, best, list_transform(range(8), lambda i: CAST('0x' || substr(hx, 1 + 5 * i, 5) AS BIGINT)) AS q
  FROM p JOIN g USING (hx)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(q, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> 15) & 31) AS INT), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> 10) & 31) AS INT), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((x >> 5) & 31) AS INT), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (x & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM v
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and number of links."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without cross-site boilerplate lines."""
    return remove_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents
), e AS (
  SELECT * FROM (
    SELECT r, site, unnest(range(len(lines))) AS place, unnest(list_transform(lines, lambda x: trim(lower(x), {" || ".join(f"chr({ord(c)})" for c in SPACES)}))) AS key FROM d
  ) WHERE key <> ''
), p AS (
  SELECT min(site) AS site, keys FROM (SELECT r, min(site) AS site, list(key ORDER BY place) AS keys FROM e GROUP BY r) GROUP BY keys
), b AS (
  SELECT key FROM (SELECT site, unnest(keys) AS key FROM p) GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}
), x AS (
  SELECT r, list(place) AS removed FROM e JOIN b USING (key) GROUP BY r
)
SELECT doc_id, CASE WHEN removed IS NULL THEN text
    ELSE coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(removed, i)), lambda i: lines[i + 1]), chr(10)), '') END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN x USING (r)
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of the log, rendered."""
    return chat_format(_table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns, list(length(role) || ':' || role || text ORDER BY place) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_equal, turns FROM c GROUP BY turns
), inner_prefix AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM u)
)
SELECT u.conv_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts, CAST(c.n_turns AS BIGINT) AS n_turns,
  CAST(u.n_equal AS BIGINT) AS n_equal, c.text
FROM u JOIN c USING (conv_id) WHERE u.turns NOT IN (SELECT turns FROM inner_prefix)
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents leak."""
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest doc_id of its group of equal texts."""
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp as microseconds of UTC."""
    return normalise(_table(spark, sf_dir, "stamps"))


OP11_SQL = rf"""
WITH s AS (
  SELECT stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM stamps
), m AS (
  SELECT stamp_id, source, zone, CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN CAST(t AS BIGINT) * 1000 END AS epoch,
    regexp_extract(t, '^({DATE})(?:{TIME})?$', ['token', 'h', 'mi', 's', 'half', 'ahead']) AS x FROM s
), n AS (
  SELECT stamp_id, source, zone, epoch, x.token AS k, TRY_CAST(x.h AS BIGINT) AS h, TRY_CAST(x.mi AS BIGINT) AS mi, coalesce(TRY_CAST(x.s AS BIGINT), 0) AS s, x.half AS half, x.ahead AS ahead,
    regexp_replace(x.ahead, '[^0-9]', '', 'g') AS od FROM m
), p AS (
  SELECT stamp_id, source, zone, epoch, k,
    CASE WHEN h IS NULL THEN 0 WHEN mi < 60 AND s < 60 AND half = '' AND h < 24 THEN h * 3600 + mi * 60 + s
      WHEN mi < 60 AND s < 60 AND half <> '' AND h BETWEEN 1 AND 12 THEN (h % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END) * 3600 + mi * 60 + s END AS time,
    ahead IS NOT NULL AND ahead <> '' AS given, CASE WHEN ahead = 'Z' THEN 0 WHEN TRY_CAST(od[1:2] AS BIGINT) <= 14 AND TRY_CAST(od[3:4] AS BIGINT) < 60
      THEN (CAST(od[1:2] AS BIGINT) * 3600 + CAST(od[3:4] AS BIGINT) * 60) * CASE WHEN ahead[1] = '-' THEN -1 ELSE 1 END END AS ahead,
    contains(k, '/') AS slashed,
    TRY_CAST(CASE WHEN k[5] = '-' THEN k WHEN contains(k, '/') OR contains(k, '.') THEN k[7:10] || '-' || k[4:5] || '-' || k[1:2]
      WHEN length(k) = 8 THEN k[1:4] || '-' || k[5:6] || '-' || k[7:8]
      WHEN length(k) = 11 THEN k[8:11] || '-' || lpad(CAST(list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], k[4:6]) AS VARCHAR), 2, '0') || '-' || k[1:2] END AS DATE) AS dmy,
    CASE WHEN contains(k, '/') THEN TRY_CAST(k[7:10] || '-' || k[1:2] || '-' || k[4:5] AS DATE) END AS month_first
  FROM n
), r AS (
  SELECT stamp_id, source, zone, epoch, time, given, ahead, slashed, CASE WHEN good THEN dmy END AS dmy, CASE WHEN good AND slashed THEN month_first WHEN good THEN dmy END AS mdy
  FROM (SELECT *, epoch IS NULL AND time IS NOT NULL AND (ahead IS NOT NULL OR (NOT given AND zone IS NOT NULL)) AS good FROM p)
), v AS (
  SELECT source, count(dmy) AS d, count(mdy) AS m FROM r WHERE slashed AND (dmy IS NULL) <> (mdy IS NULL) GROUP BY source
), c AS (
  SELECT r.*, dmy <> mdy AS two, coalesce(d, 0) AS d, coalesce(m, 0) AS m FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source
), w AS (
  SELECT stamp_id, zone, epoch, ahead, given, (CASE WHEN two AND d > m THEN dmy WHEN two THEN mdy ELSE coalesce(dmy, mdy) END)::TIMESTAMP + to_seconds(time) AS wall,
    CASE WHEN epoch IS NOT NULL THEN 'epoch' WHEN two AND d <> m THEN 'votes' WHEN two THEN 'default' ELSE 'plain' END AS rule FROM c
), z AS (
  SELECT *, CASE WHEN NOT given AND wall IS NOT NULL THEN timezone(zone, wall) END AS last FROM w
), y AS (
  SELECT *, CASE WHEN timezone(zone, last - INTERVAL 1 HOUR) = wall THEN last - INTERVAL 1 HOUR WHEN timezone(zone, last - INTERVAL 30 MINUTE) = wall THEN last - INTERVAL 30 MINUTE ELSE last END AS first FROM z
), u AS (
  SELECT stamp_id, rule, coalesce(first <> last OR timezone(zone, last) <> wall, false) AS odd,
    coalesce(epoch, epoch_us(wall) - ahead * 1000000, epoch_us(first)) AS utc_us FROM y
)
SELECT stamp_id, CAST(utc_us AS BIGINT) AS utc_us, CASE WHEN utc_us IS NULL THEN 'bad' ELSE rule END AS rule,
  utc_us IS NOT NULL AND (rule IN ('votes', 'default') OR odd) AS ambiguous FROM u
"""


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 50 words that smaller documents hold too."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT r, doc_id, i, md5(array_to_string(words[i + 1:i + 50], ' ')) AS h FROM (SELECT r, doc_id, words, unnest(range(len(words) - 49)) AS i FROM d WHERE len(words) >= 50)
), m AS (
  SELECT h, min(doc_id) AS least FROM w GROUP BY h
), x AS (
  SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (h) WHERE least < doc_id) GROUP BY r
), y AS (
  SELECT d.r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS p FROM d) d LEFT JOIN (SELECT r, unnest(gone) AS p, true AS out FROM x) g USING (r, p)
  WHERE out IS NULL GROUP BY d.r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (r)
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof in the manifest of all documents."""
    return manifest(_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, lang, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda v, i: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1)))) AS crc,
    CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body FROM documents
), f AS (
  SELECT r, doc_id, lang, sha256(head || body) AS leaf, sha256(head || CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 3 = 0 THEN translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE body END) AS begin,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM d
), n AS (
  SELECT coalesce('=' || lang, '') AS tree, 0 AS level, i, leaf AS h FROM f
  UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM n) WHERE c > 1 GROUP BY tree, level, i // 8
), s AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS g FROM (SELECT tree, h, level, max(level) OVER (PARTITION BY tree) AS m FROM n) WHERE level = m
), u AS (
  SELECT 0 AS level, g AS i, h FROM s
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY level, i // 8
), t AS (
  SELECT tree, level AS l, i, h FROM n WHERE level < (SELECT max(level) FROM n x WHERE x.tree = n.tree)
), w AS (
  SELECT f.r, t.l, t.i, t.h FROM f JOIN t ON t.tree = coalesce('=' || lang, '') AND t.i // 8 = f.i // CAST(power(8, t.l + 1) AS BIGINT)
  UNION ALL
  SELECT f.r, 100 + u.level, u.i, u.h FROM f JOIN s ON s.tree = coalesce('=' || f.lang, '') JOIN u ON u.i // 8 = s.g // CAST(power(8, u.level + 1) AS BIGINT) WHERE u.level < (SELECT max(level) FROM u)
), o AS (
  SELECT w.*, w.i = CASE WHEN w.l < 100 THEN f.i // CAST(power(8, w.l) AS BIGINT) ELSE s.g // CAST(power(8, w.l - 100) AS BIGINT) END AS own
  FROM w JOIN f ON f.r = w.r JOIN s ON s.tree = coalesce('=' || f.lang, '')
), q AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY l) AS k, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT own), '') AS sib, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < mine), '') AS before, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > mine), '') AS after
  FROM (SELECT *, max(CASE WHEN own THEN i END) OVER (PARTITION BY r, l) AS mine FROM o) GROUP BY r, l
), z AS (
  SELECT r, 0 AS k, begin AS h FROM f
  UNION ALL
  SELECT z.r, z.k + 1, sha256(before || h || after) FROM z JOIN q ON q.r = z.r AND q.k = z.k + 1
), e AS (
  SELECT r, arg_max(h, k) AS folded_root FROM z GROUP BY r
), p AS (
  SELECT r, sha256(string_agg(sib, '' ORDER BY k)) AS proof FROM q GROUP BY r
)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u ORDER BY level DESC LIMIT 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM u ORDER BY level DESC LIMIT 1) AS verified
FROM f JOIN s ON s.tree = coalesce('=' || lang, '') JOIN e USING (r) LEFT JOIN p USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_timestamps": op11_timestamps,
    "op12_substrings": op12_substrings,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_chat": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_timestamps": OP11_SQL, "op12_substrings": OP12_SQL, "op13_merkle": OP13_SQL}
