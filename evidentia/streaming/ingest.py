"""Streamed ingestion: documents land in a folder and are chunked in micro-batches until nothing is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalar import trim
from ..operators.chunking import chunk

DOCUMENT = "doc_id long, kb_id long, title string, source string, metadata map<string,string>, text string, index_version long"
#: The same as it lands: metadata is whatever JSON value was sent, nested values included.
LANDED = DOCUMENT.replace("map<string,string>", "variant")
REASON_LENGTH = 2000
TITLE_LENGTH = 255
SOURCE_LENGTH = 2048


def _refusal() -> Column:
    """Why a document cannot be taken in; null if it can."""
    text, title = trim(F.coalesce("text", F.lit(""))), F.coalesce("title", F.lit(""))
    return (
        F.when(trim(title) == "", "the document has no title").when(F.length(title) > TITLE_LENGTH, "the title is too long")
        .when(F.length("source") > SOURCE_LENGTH, "the source is too long").when(text == "", "the document is empty")
    )


def checked(documents: DataFrame) -> DataFrame:
    """Documents with their status, ready or failed, and the reason why one cannot be taken in."""
    rows = documents.withColumn("reason", F.substring(_refusal(), 1, REASON_LENGTH))
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "ready").otherwise("failed"))


def ingest_now(documents: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Chunks, and the state (doc_id, index_version, status, reason) of documents (DOCUMENT), in one batch.

    Documents that cannot be taken in fail with a reason, and the others do not wait for them; of a document that is
    given several times the newest version counts.
    """
    columns = [x.split(" ")[0] for x in DOCUMENT.split(", ")]
    rows = documents.select(*[F.col(c) if c in documents.columns else F.lit(None).cast("map<string,string>" if c == "metadata" else "string").alias(c) for c in columns])
    newest = checked(rows.groupBy("doc_id").agg(F.max_by(F.struct(*columns[1:]), "index_version").alias("d")).select("doc_id", "d.*"))
    state = newest.select("doc_id", "index_version", "status", "reason")
    return chunk(newest.where("status = 'ready'").drop("status", "reason"), settings), state


def current_jobs(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs (doc_id, index_version) whose version is still the document's and whose document is not ready."""
    told = documents.select("doc_id", F.col("index_version").alias("now"), "status")
    return jobs.join(told, "doc_id").where((F.col("index_version") == F.col("now")) & (F.col("status") != "ready")).drop("now", "status")


def retry(documents: DataFrame, failed: DataFrame) -> DataFrame:
    """Documents after failed ones (doc_id) were queued again: the next version, pending."""
    marked = documents.join(failed.select("doc_id", F.lit(True).alias("again")), "doc_id", "left")
    again = F.coalesce("again", F.lit(False)) & (F.col("status") == "failed")
    return marked.withColumns({"index_version": F.col("index_version") + again.cast("bigint"), "status": F.when(again, "pending").otherwise(F.col("status"))}).drop("again")


def ingest_available(spark: SparkSession, landing: str, out: str, checkpoint: str, settings: Settings = DEFAULTS) -> None:
    """Chunk all documents that wait in `landing` (JSON lines) into Parquet at `out`, one batch after the other.

    Each batch is taken in as ingest_now does, and is written under its number, so that a repeated batch replaces itself.
    """

    def index(batch: DataFrame, number: int) -> None:
        chunks, state = ingest_now(batch, settings)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        state.write.mode("overwrite").parquet(f"{out}/status/batch={number}")

    stream = spark.readStream.schema(LANDED).json(landing)
    stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
