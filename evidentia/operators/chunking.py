"""Overlapping chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalar import TRIMMED, normalize_newlines, trim


def pieces(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Trimmed windows of the text in order, without empty ones; a tail inside the last window is still one."""
    return _cut(normalize_newlines(text), settings)


def _cut(clean: Column, settings: Settings) -> Column:
    starts = F.sequence(F.lit(0), F.length(clean) - 1, F.lit(settings.stride))
    cut = F.transform(starts, lambda o: trim(F.substring(clean, o + 1, F.lit(settings.size))))
    return F.when(F.length(clean) > 0, F.filter(cut, lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def chunk(docs: DataFrame, settings: Settings = DEFAULTS, text: str = "text") -> DataFrame:
    """The rows of `docs` without their text, one for each chunk: position (from 0 among kept chunks) and content."""
    others = [c for c in docs.columns if c != text]
    # Cleaning in a projection of its own happens once a document; inside the cut it would happen for each piece.
    clean = docs.select(*others, normalize_newlines(F.col(text)).alias("_clean"))
    cut = clean.select(*others, F.posexplode(_cut(F.col("_clean"), settings)).alias("position", "content"))
    return cut.withColumn("position", F.col("position").cast("bigint"))


@F.udtf(returnType="position long, content string")
class ChunkText:
    """The chunks of one text, for SQL: `SELECT * FROM chunk_text('...')` once it is registered with `spark.udtf`.

    It runs in Python, row by row; whole tables are for `chunk`.
    """

    def eval(self, text: str, size: int = DEFAULTS.size, overlap: int = DEFAULTS.overlap):
        settings = Settings(chunk_size=size, chunk_overlap=overlap)
        clean = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip(TRIMMED)
        kept = (clean[at : at + settings.size].strip(TRIMMED) for at in range(0, len(clean), settings.stride))
        for position, content in enumerate(piece for piece in kept if piece):
            yield position, content


def reindex(chunks: DataFrame, changed: DataFrame, settings: Settings = DEFAULTS, key: str = "doc_id") -> DataFrame:
    """Chunks after `changed` documents (key, text, ...) were indexed anew: their old chunks go, new ones come."""
    fresh = chunk(changed, settings).select(chunks.columns)
    return chunks.join(changed.select(key), key, "left_anti").unionByName(fresh)
