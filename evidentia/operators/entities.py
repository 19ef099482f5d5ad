"""Extraction validation, entity resolution, graph merge and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalar import ENTITY_TYPES, cosine, empty_to_null, lenient_json, normalize_name, relation_type, trim
from ..session import written
from .components import dealt_anew

EXTRACTION = (
    "entities array<struct<key:string,name:string,type:string,description:string,aliases:array<string>>>, "
    "relationships array<struct<source_key:string,target_key:string,type:string,description:string,statement:string,confidence:double>>"
)


#: Items of a type that one block matches against all entities of the type.
BLOCK_ITEMS = 1000


def clean_aliases(aliases: Column) -> Column:
    """Trimmed, without empty ones, distinct in order."""
    kept = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), trim), lambda a: a.isNotNull() & (a != ""))
    return F.array_distinct(kept)


def merge_aliases(existing: Column, more: Column, surface: Column, canonical: Column) -> Column:
    """The union of aliases; the surface form joins it if it names the entity in another way."""
    extra = F.when(normalize_name(surface) != normalize_name(canonical), F.array(surface)).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return clean_aliases(F.concat(F.coalesce(existing, empty), F.coalesce(more, empty), extra))


def parse_extraction(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Model answers (chunk_id, answer) as typed columns; what cannot be read is empty."""
    parsed = lenient_json(F.col(column), EXTRACTION)
    return answers.select("chunk_id", parsed["entities"].alias("entities"), parsed["relationships"].alias("relationships"))


def valid_entities(extraction: DataFrame, *keep: str) -> DataFrame:
    """Entities with key and name; of entities with one key the first counts; unknown types become Other.

    A chunk is one row of `extraction`, whose columns `keep` go with its entities."""
    own = lambda e, name: trim(F.coalesce(e[name], F.lit("")))
    told = F.transform("entities", lambda e, i: F.struct(i.cast("bigint").alias("position"), own(e, "key").alias("key"), F.substring(own(e, "name"), 1, 255).alias("name"), e.alias("e")))
    rows = extraction.select("chunk_id", *keep, F.filter(told, lambda x: (x["key"] != "") & (x["name"] != "")).alias("told"))
    rows = rows.withColumn("keys", F.transform("told", lambda x: x["key"]))
    once = F.when(F.size(F.array_distinct("keys")) == F.size("keys"), F.col("told")).otherwise(F.filter("told", lambda x, i: F.array_position(F.col("keys"), x["key"]) == i + 1))
    return rows.select("chunk_id", *keep, F.inline(once)).select(
        "chunk_id", *keep, "position", "key", "name", F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("Other").alias("type"),
        empty_to_null(trim(F.coalesce("e.description", F.lit("")))).alias("description"), clean_aliases(F.col("e.aliases")).alias("aliases"),
    )


def told_relationships(extraction: DataFrame, *keep: str) -> DataFrame:
    """Relationships with a type and a statement, between any keys; confidence is held within 0..1."""
    rows = extraction.select("chunk_id", *keep, F.posexplode("relationships").alias("position", "r")).where("r IS NOT NULL")
    told = lambda name: trim(F.coalesce(F.col(f"r.{name}"), F.lit("")))
    rows = rows.select(
        "chunk_id", *keep, F.col("position").cast("bigint").alias("position"), told("source_key").alias("source_key"), told("target_key").alias("target_key"),
        told("type").alias("raw_type"), told("statement").alias("statement"), empty_to_null(told("description")).alias("description"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.0)))).alias("confidence"),
    ).where("raw_type <> '' AND statement <> ''")
    return rows.withColumn("type", relation_type(F.col("raw_type"))).drop("raw_type")


def valid_relationships(extraction: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships between known keys, with a type and a statement; confidence is held within 0..1."""
    rows, keys = told_relationships(extraction), entities.select("chunk_id", "key")
    for side in ("source_key", "target_key"):
        rows = rows.join(keys.withColumnRenamed("key", side), ["chunk_id", side], "left_semi")
    return rows


def match_exact(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, entity_id) of items whose kb, type and normalized name exist."""
    left = items.select("item_id", "kb_id", "type", normalize_name(F.col("name")).alias("normalized_name"))
    return left.join(entities.select("kb_id", "type", "normalized_name", "entity_id"), ["kb_id", "type", "normalized_name"]).select("item_id", "entity_id")


def match_alias(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, entity_id) of items that are an alias of exactly one entity of their kb and type."""
    names = entities.select("kb_id", "type", "entity_id", F.explode("aliases").alias("alias"))
    names = names.select("kb_id", "type", "entity_id", normalize_name(F.col("alias")).alias("normalized_name"))
    # What an alias tells is known before any item meets it, so an alias that very many entities share is one row.
    key = ["kb_id", "type", "normalized_name"]
    names = names.groupBy(*key).agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last"))
    left = items.select("item_id", "kb_id", "type", normalize_name(F.col("name")).alias("normalized_name"))
    found = left.join(dealt_anew(names, *key), key).groupBy("item_id")
    found = found.agg(F.min("entity_id").alias("entity_id"), F.max("last").alias("last"))
    return found.where(F.col("entity_id") == F.col("last")).select("item_id", "entity_id")


def match_semantic(items: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(item_id, entity_id, score): the most similar entity of the kb and type, if near enough and clearly first.

    Every item meets every entity of its kb and type. The items of a type are dealt into blocks by their hash and each
    entity goes to all blocks of its type, so a large type is spread over as many tasks as it has blocks; of the pairs
    of a block only the best two of each item are kept.
    """
    own = items.select("item_id", "kb_id", "type", "embedding")
    blocks = own.groupBy("kb_id", "type").agg(F.ceil(F.count("*") / BLOCK_ITEMS).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    own = own.join(blocks, ["kb_id", "type"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int")).drop("blocks")
    told = entities.where("embedding IS NOT NULL").select("kb_id", "type", "entity_id", F.col("embedding").alias("other")).join(blocks, ["kb_id", "type"])
    told = told.select("kb_id", "type", "entity_id", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = own.join(told, ["kb_id", "type", "block"])
    scored = pairs.select("item_id", "entity_id", cosine(F.col("embedding"), F.col("other")).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "entity_id")
    best = scored.withColumn("n", F.row_number().over(order)).where("n <= 2").groupBy("item_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("entity_id"))).alias("entity_id"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(-1.0)).alias("second"),
    )
    near = (F.col("score") >= settings.similarity_threshold) & (F.col("score") - F.col("second") >= settings.similarity_margin)
    return best.where(near).select("item_id", "entity_id", "score")


def _plain(name: str) -> str:
    import regex

    return regex.sub(r"[\s\p{P}\p{S}]+", "", (name or "").strip(" \t\n\r\0\x0b").lower())


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table and those rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows in place of those that have their keys."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.dropDuplicates(key).select(table.columns))


def merge_edges(evidence: DataFrame) -> DataFrame:
    """Edges from evidence (kb_id, source, target, type, chunk_id, confidence): one for each key, with the number of
    chunks that prove it as weight and the largest confidence."""
    per_chunk = evidence.groupBy("kb_id", "source", "target", "type", "chunk_id").agg(F.max("confidence").alias("confidence"))
    return per_chunk.groupBy("kb_id", "source", "target", "type").agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"))


def prune_orphans(entities: DataFrame, relationships: DataFrame, evidence: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships that are left: first relationships without evidence go, then entities without
    mentions and without remaining relationships."""
    edges = relationships.join(evidence.select("relationship_id"), "relationship_id", "left_semi")
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity_id"))
    return entities.join(mentions.select("entity_id").unionByName(ends).distinct(), "entity_id", "left_semi"), edges


def delete_documents(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, evidence: DataFrame, gone: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables after the documents `gone` (doc_id) and all that hangs on them are deleted."""
    left = chunks.join(gone, "doc_id", "left_anti")
    lost = chunks.join(gone, "doc_id", "left_semi").select("chunk_id")
    return (
        documents.join(gone, "doc_id", "left_anti"), left,
        mentions.join(lost, "chunk_id", "left_anti"), evidence.join(lost, "chunk_id", "left_anti"),
    )
