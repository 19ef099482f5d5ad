"""Reports over call logs, listings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(logs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows of the last hours, the boundary included."""
    return logs.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def by_status(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency")
    )


def summary(logs: DataFrame) -> DataFrame:
    """Calls, failures, tokens, and the plain mean of the mean latencies of each status, rounded."""
    return by_status(logs).agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("calls"))), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.round(F.avg("avg_latency")), F.lit(0)).cast("bigint").alias("avg_latency_ms"),
    )


def per_model(logs: DataFrame, limit: int = 12) -> DataFrame:
    """The most called (provider, model, task), ties by name."""
    keys = ["provider_id", "model_id", "task_type"]
    out = logs.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failures"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.round(F.avg("latency_ms")), F.lit(0)).cast("bigint").alias("avg_latency_ms"),
    )
    return out.orderBy(F.desc("calls"), *keys).limit(limit)


def page(rows: DataFrame, order: list[Column | str], number: int = 1, per_page: int = 25) -> DataFrame:
    """A page of a listing (from 1); 1 to 100 rows."""
    per_page = min(max(per_page, 1), 100)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * per_page).limit(per_page)


def listing(rows: DataFrame, order: list[Column | str], number: int = 1, per_page: int = 25) -> DataFrame:
    """A page with `total`, the number of all rows of the listing."""
    return page(rows, order, number, per_page).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def contains_text(rows: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose column holds the text, in any case; all rows without a text."""
    return rows if not text else rows.where(F.col(column).ilike(f"%{text}%"))


def with_counts(rows: DataFrame, key: str, **facts: tuple[DataFrame, str]) -> DataFrame:
    """Rows with the number of facts for each; counted before joining, so facts do not multiply each other."""
    for name, (fact, column) in facts.items():
        counted = fact.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        rows = rows.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def latest(rows: DataFrame, partition: str, order: str, key: str, n: int = 5) -> DataFrame:
    """The newest n rows of each partition, ties by key."""
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(order), F.desc(key)))
    return rows.withColumn("n", rank.cast("bigint")).where(F.col("n") <= n)
