"""Streamed indexing: documents that land in a folder are chunked, embedded, extracted, merged and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators.chunking import chunk
from ..operators.entities import parse_extraction
from ..operators.keyed import CHUNKS, DOCUMENTS, Held, Store
from ..operators.store import reindex
from ..plans.models import ChatModel, Embedder, embed_column, extract_graph
from ..session import written
from .ingest import LANDED, checked

#: Positions of a document's chunks; a chunk's id is that of its document and its position.
CHUNK_IDS = 1_000_000


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _fresh(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """The newest version of each document, without those that are older than the stored one, or as old and ready.

    Keys tell which are given twice or stale, so texts move only if some are.
    """
    twice = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        newest = F.max_by(F.struct(*[c for c in documents.columns if c != "doc_id"]), "index_version")
        documents = written(documents.groupBy("doc_id").agg(newest.alias("d")).select("doc_id", "d.*"), "newest")
    known = stored.select("doc_id", F.col("index_version").alias("have"), F.col("status").alias("was"))
    stale = (F.col("index_version") < F.col("have")) | ((F.col("index_version") == F.col("have")) & (F.col("was") == "ready"))
    old = written(documents.select("doc_id", "index_version").join(known, "doc_id").where(stale).select("doc_id"), "stale")
    return written(documents.join(old, "doc_id", "left_anti"), "fresh") if old.limit(1).count() else documents


def indexed(held: Held, documents: DataFrame, embedder: Embedder, model: ChatModel, settings: Settings = DEFAULTS) -> Held:
    """The tables after `documents` (the columns of a landed one) were indexed: chunks with vectors, what a model found in
    them merged into the graph, and what they held before gone.

    Of a document that is given several times the newest version counts; one that is older than the stored one, or as old
    and ready, is passed over. Documents that cannot be taken in fail with a reason and keep no chunks. A document stays in
    the knowledge base that it was first given to.
    """
    spark = documents.sparkSession
    fresh = checked(_fresh(documents, held.documents))
    told = fresh.select(*_columns(DOCUMENTS))
    chunks = chunk(fresh.where("status = 'ready'").select("kb_id", "doc_id", "title", "text"), settings)
    chunks = chunks.select("kb_id", (F.col("doc_id") * CHUNK_IDS + F.col("position")).alias("chunk_id"), "doc_id", "position", "title", "content")
    chunks = chunks.withColumn("embedding", embed_column(spark, embedder, F.col("content")))
    chunks = written(chunks, "chunks") if settings.graph_enabled else chunks  # else they are read once, to be stored
    answers = extract_graph(chunks, model) if settings.graph_enabled else spark.createDataFrame([], "chunk_id long, answer string")
    extraction = parse_extraction(answers).join(chunks.select("chunk_id", "kb_id"), "chunk_id")
    before = held.documents.join(told.select("doc_id"), "doc_id", "left_anti").unionByName(told)
    vectors = (lambda text: embed_column(spark, embedder, text)) if settings.semantic_resolution else None
    _, kept, graph = reindex(held.graph, held.documents, held.chunks, fresh.select("doc_id", "kb_id", "text"), chunks.select(*_columns(CHUNKS)), written(extraction, "extraction"), settings, vectors)
    return Held(before, kept, graph)


def index_batch(store: Store, documents: DataFrame, embedder: Embedder, model: ChatModel, settings: Settings = DEFAULTS, mark: tuple[str, int] | None = None) -> None:
    """Index documents in one transaction over the knowledge bases that they name."""
    documents = written(documents, "landed")
    kbs = [r[0] for r in documents.select("kb_id").where("kb_id IS NOT NULL").distinct().collect()]
    if kbs:
        store.transact(kbs, lambda held: indexed(held, documents.where("kb_id IS NOT NULL AND doc_id IS NOT NULL"), embedder, model, settings), mark)


def index_available(spark: SparkSession, landing: str, store: Store, checkpoint: str, embedder: Embedder, model: ChatModel, settings: Settings = DEFAULTS, files: int = 1000) -> None:
    """Index all documents that wait in `landing` (JSON lines), a batch of at most `files` files after the other.

    A batch is published with its number as a mark of the stream, so a batch that is run again after a failure changes
    nothing, and a killed one leaves nothing.
    """
    name = f"landing:{landing}"
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).json(landing)
    run = lambda batch, number: index_batch(store, batch, embedder, model, settings, (name, number))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
