"""The data model of the engine, mapped onto the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_name
from ..operators.chunking import chunk
from ..operators.store import Graph
from ..session import sized, written
from ..sources.tables import table

PART_IDS = 1_000_000_000


def asked(key: str) -> Column:
    """The stated set of questions of a search: rows whose id is divisible by 100."""
    return F.col(key) % 100 == 0


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """kb_id, doc_id, chunk_id, title, position, content."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), "doc_id", F.col("source").alias("title"), "text")
    return chunk(docs).withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("position"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's vector: the embeddings are dealt out over the documents in turn."""
    rows = table(spark, sf, "embeddings")
    n = rows.agg((F.max("vec_id") + 1).alias("n"))
    docs = table(spark, sf, "documents").select("doc_id").crossJoin(F.broadcast(n))
    return docs.select("doc_id", (F.col("doc_id") % F.col("n")).alias("vec_id")).join(rows, "vec_id").select(F.col("doc_id").alias("chunk_id"), "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where(asked("vec_id"))
    return rows.select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("kb_id"), F.col("embedding").alias("qvec"))


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The whole texts of the stated documents as questions, with their vectors."""
    rows = table(spark, sf, "documents").where(asked("doc_id"))
    rows = rows.select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    return rows.join(vectors(spark, sf).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")


def documents_as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as the table of chunks that a knowledge base keeps."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    return written(docs.join(vectors(spark, sf), "chunk_id"), "chunks")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and the parts they supply, by the supplier's nation as knowledge base."""
    supplier = table(spark, sf, "supplier")
    kb = F.col("s_nationkey").cast("bigint")
    number = F.col("s_suppkey").cast("string")
    own = supplier.select(
        kb.alias("kb_id"), F.col("s_suppkey").cast("bigint").alias("entity_id"), F.lit("Organization").alias("type"), F.col("s_name").alias("canonical_name"),
        F.array(F.concat(F.lit("S-"), number), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))).alias("aliases"),
    )
    pairs = sized(table(spark, sf, "lineitem")).select("l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    parts = pairs.select(kb.alias("kb_id"), "l_partkey").distinct().join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = parts.select(
        "kb_id", (F.lit(PART_IDS) + F.col("p_partkey") * 25 + F.col("kb_id")).alias("entity_id"), F.lit("Product").alias("type"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("canonical_name"), F.array("p_brand").alias("aliases"),
    )
    return own.unionByName(parts).withColumn("normalized_name", normalize_name(F.col("canonical_name")))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as evidence: supplier -> part, proved by the order."""
    joined = sized(table(spark, sf, "lineitem")).join(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("kb_id")), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        "kb_id", (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("relationship_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
        F.col("l_suppkey").cast("bigint").alias("source"), (F.lit(PART_IDS) + F.col("l_partkey") * 25 + F.col("kb_id")).alias("target"), F.lit("SUPPLIES").alias("type"),
        F.col("l_orderkey").alias("chunk_id"), F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.concat(F.lit("shipped by "), F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus")).alias("statement"), "l_returnflag", "l_discount",
    )


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """kb_id, relationship_id, source, target, weight (chunks of evidence), confidence."""
    rows = evidence(spark, sf).groupBy("kb_id", "relationship_id", "source", "target")
    return rows.agg(F.count_distinct("chunk_id").cast("double").alias("weight"), F.max("confidence").alias("confidence"))


def stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships as the tables that a knowledge base keeps."""
    return written(entities(spark, sf), "entities"), written(relationships(spark, sf), "relationships")


def extraction(spark: SparkSession, sf: str) -> DataFrame:
    """What a model might find in an order's lines with one supplier: a customer who buys from that supplier, who is
    called by an alias in some."""
    lines = sized(table(spark, sf, "lineitem")).groupBy("l_orderkey", "l_suppkey").agg(
        F.max(F.col("l_partkey") % 2).alias("odd"), F.min("l_discount").alias("l_discount"), F.min("l_returnflag").alias("l_returnflag")
    )
    lines = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    one = lambda key, name, kind: F.struct(F.lit(key).alias("key"), name.alias("name"), F.lit(kind).alias("type"), text.alias("description"), none.alias("aliases"))
    called = F.when(F.col("odd") == 1, F.concat(F.lit("S "), F.col("l_suppkey").cast("string"))).otherwise(F.col("s_name"))
    buyer = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    bought = F.struct(
        F.lit("c").alias("source_key"), F.lit("s").alias("target_key"), F.lit("buys from").alias("type"), F.lit("by order").alias("description"),
        F.col("l_returnflag").alias("statement"), F.round(1 - F.col("l_discount"), 4).alias("confidence"),
    )
    return lines.select(
        F.col("s_nationkey").cast("bigint").alias("kb_id"), (F.col("l_orderkey") * 10_000_000 + F.col("l_suppkey")).alias("chunk_id"),
        F.array(one("c", buyer, "Person"), one("s", called, "Organization")).alias("entities"), F.array(bought).alias("relationships"),
    )


def suppliers_graph(spark: SparkSession, sf: str) -> Graph:
    """A stored graph of suppliers alone, with a version for each even nation."""
    known = entities(spark, sf).where("type = 'Organization'").withColumns({"description": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<double>")})
    nation = F.col("n_nationkey").cast("bigint")
    versions = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(nation.alias("kb_id"), nation.alias("graph_version"))
    return Graph.of(spark, entities=known, versions=versions)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as call logs."""
    rows = table(spark, sf, "events")
    return rows.select(
        F.col("event_id").alias("call_id"), (F.col("user_id") % 3).alias("provider_id"), (F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("task_type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


#: The same views for DuckDB.
GRAPH_SQL = """
ev AS (
  SELECT CAST(s_nationkey AS BIGINT) AS kb_id, l_suppkey * 10000000 + l_partkey AS relationship_id, l_orderkey * 10 + l_linenumber AS evidence_id,
    CAST(l_suppkey AS BIGINT) AS source, 1000000000 + l_partkey * 25 + s_nationkey AS target, l_orderkey AS chunk_id,
    round(1 - l_discount, 4) AS confidence, 'shipped by ' || l_returnflag || '/' || l_linestatus AS statement, l_returnflag, l_discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), rel AS MATERIALIZED (
  SELECT kb_id, relationship_id, source, target, CAST(count(DISTINCT chunk_id) AS DOUBLE) AS weight, max(confidence) AS confidence FROM ev GROUP BY ALL
), ent AS MATERIALIZED (
  SELECT CAST(s_nationkey AS BIGINT) AS kb_id, CAST(s_suppkey AS BIGINT) AS entity_id, 'Organization' AS type, s_name AS canonical_name,
    ['S-' || s_suppkey, 'Nation ' || s_nationkey] AS aliases FROM supplier
  UNION ALL
  SELECT DISTINCT CAST(s_nationkey AS BIGINT), 1000000000 + p_partkey * 25 + s_nationkey, 'Product', p_name || ' ' || p_partkey, [p_brand]
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
), entn AS (
  SELECT *, regexp_replace(lower(trim(canonical_name)), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g') AS normalized_name FROM ent
)"""
STORED_SQL = """
lines AS MATERIALIZED (
  SELECT CAST(s_nationkey AS BIGINT) AS kb_id, l_orderkey * 10000000 + l_suppkey AS chunk_id, CAST(l_suppkey AS BIGINT) AS l_suppkey, o_custkey, s_name, by_alias, statement, confidence
  FROM (SELECT l_orderkey, l_suppkey, max(l_partkey % 2) = 1 AS by_alias, min(l_returnflag) AS statement, round(1 - min(l_discount), 4) AS confidence FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
), buyers AS (
  SELECT kb_id, o_custkey, row_number() OVER (ORDER BY min(chunk_id)) + (SELECT max(s_suppkey) FROM supplier) AS entity_id FROM lines GROUP BY kb_id, o_custkey
), edges AS (
  SELECT kb_id, entity_id AS source, l_suppkey AS target, row_number() OVER (ORDER BY min(chunk_id)) AS relationship_id, count(*) AS weight, max(confidence) AS confidence
  FROM lines JOIN buyers USING (kb_id, o_custkey) GROUP BY kb_id, entity_id, l_suppkey
)"""
CALLS_SQL = """
calls AS (
  SELECT event_id AS call_id, user_id % 3 AS provider_id, user_id % 5 AS model_id, event_type AS task_type,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS latency_ms,
    CAST(props->>'$.k' AS BIGINT) AS tokens, ts AS created_at FROM events
)"""
TRIM_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
CHUNKS_SQL = f"""
clean AS (
  SELECT lang AS kb_id, doc_id, source AS title, trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {TRIM_SQL}) AS t FROM documents
), cut AS (
  SELECT kb_id, doc_id, title, o, trim(substr(t, o + 1, 1200), {TRIM_SQL}) AS content FROM (SELECT *, unnest(range(0, length(t), 1000)) AS o FROM clean)
), chunks AS (
  SELECT kb_id, doc_id, title, content, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS position FROM cut WHERE content <> ''
)"""
