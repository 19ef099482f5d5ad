"""Vector and keyword ranking, rank fusion and context assembly, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, keyword_score, terms
from ..session import written

RRF_K = 60
#: Questions that are broadcast at most; more are joined without a hint.
MOST_QUESTIONS = 10_000
#: Bytes a core below which chunks are dealt anew before they are scored.
SMALL_PIECE = 32 << 20


def bounded(rows: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """`rows` marked for broadcast if they are `most` at most, as a count tells; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, if they are few bytes for each, as the planner's statistics tell; else as they are.

    Scoring costs far more than reading, and a small table often comes in one piece.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SMALL_PIECE else rows


def _similarity(embedding: Column, norm: Column) -> Column:
    fits = (F.size(embedding) == F.size("qvec")) & (F.size(embedding) > 0) & (norm * F.col("qnorm") > 0)
    return F.when(fits, dot(embedding, F.col("qvec")) / (norm * F.col("qnorm"))).otherwise(-1.0)


def _asked(queries: DataFrame, *others: Column | str) -> DataFrame:
    asked = queries.select("query_id", *others, F.col("qvec").cast("array<double>").alias("qvec"))
    return asked.withColumn("qnorm", F.sqrt(dot(F.col("qvec"), F.col("qvec"))))


def _normed(vectors: DataFrame, *others: Column | str) -> DataFrame:
    """Chunks with the norm of their vector, which is computed once a chunk, not once a pair."""
    own = vectors.select("chunk_id", *others, F.col("embedding").cast("array<double>").alias("embedding"))
    return own.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


def vector_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk for every question.

    `queries` holds (query_id, qvec) and is a stated set of questions: up to MOST_QUESTIONS are sent to the chunks,
    which stay where they are, so scoring has no shuffle.
    """
    pairs = _normed(spread(vectors)).crossJoin(bounded(_asked(queries)))
    return pairs.select("query_id", "chunk_id", _similarity(F.col("embedding"), F.col("norm")).alias("score"))


def hybrid_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, keyword_score) of all chunks, or of those in the question's knowledge base, as a table.

    One pass over `chunks` (chunk_id, content, embedding) serves both orders; where both sides have a kb_id, a question
    meets the chunks of its own alone. Scores are rounded, so that those that differ by rounding alone are ties.
    """
    wanted = terms(F.col("question")).alias("terms")
    lowered = F.lower("content").alias("lowered")  # in a projection of its own, so once a chunk
    chunks = spread(chunks)
    if "kb_id" in questions.columns and "kb_id" in chunks.columns:
        pairs = _normed(chunks, "kb_id", lowered).join(bounded(_asked(questions, "kb_id", wanted)), "kb_id")
    else:
        pairs = _normed(chunks, lowered).crossJoin(bounded(_asked(questions, wanted)))
    scored = pairs.select(
        "query_id", "chunk_id", F.round(_similarity(F.col("embedding"), F.col("norm")), 12).alias("score"),
        keyword_score(F.col("lowered"), F.col("terms")).alias("keyword_score"),
    )
    return written(scored, "scores")


def full_rank(rows: DataFrame, by: str, order: list[Column | str], name: str) -> DataFrame:
    """Adds `name`: the position of each row among all rows of its `by`, in an order without ties.

    Rows are dealt by ranges of the order; a row's position is that in its range and the sizes of the ranges before, so
    no task holds all rows of a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_size"))
    sizes = sizes.select(by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    placed = dealt.withColumn(name, inside).join(sizes, [by, "_range"])
    return placed.withColumn(name, (F.col(name) + F.col("_skip")).cast("bigint")).drop("_range", "_skip")


def vector_rank(scores: DataFrame) -> DataFrame:
    """Adds vector_rank: position by score, ties by chunk id, among all chunks of the question."""
    return full_rank(scores, "query_id", [F.desc("score"), "chunk_id"], "vector_rank")


def vector_top(scores: DataFrame, k: int) -> DataFrame:
    """The first k by score; ranks survive partial limits in each task, so no task holds all chunks of a question."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("vector_rank", F.row_number().over(order).cast("bigint")).where(F.col("vector_rank") <= k)


#: Orders of the scored channels, as keys that grow from the first to the last chunk.
_KEYS = {
    "vector": lambda: F.struct((-F.col("score")).alias("a"), F.lit(0.0).alias("b"), F.col("chunk_id").alias("c")),
    "keyword": lambda: F.struct((-F.round("keyword_score", 9)).alias("a"), (-F.col("score")).alias("b"), F.col("chunk_id").alias("c")),
}
#: Steps of a binary search; candidates of a question are far fewer than 2**STEPS.
STEPS = 16


def keyword_hits(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("keyword_score") > 0)


def keyword_rank(scored: DataFrame) -> DataFrame:
    """(query_id, chunk_id, keyword_score, keyword_rank) of chunks with a positive score; ties keep the vector order."""
    ranked = full_rank(keyword_hits(scored), "query_id", [F.desc(F.round("keyword_score", 9)), F.desc("score"), "chunk_id"], "keyword_rank")
    return ranked.select("query_id", "chunk_id", "keyword_score", "keyword_rank")


def _counted_ranks(candidates: DataFrame, rows: DataFrame, channel: str) -> DataFrame:
    """(query_id, chunk_id, rank) of candidates among all rows of their question.

    The candidates' keys are sent to the rows as one sorted array for each question; a row finds by binary search how
    many candidates do not come after it, and counts by question and that number are all that is shuffled.
    """
    keyed = candidates.select("query_id", "chunk_id", _KEYS[channel]().alias("key"))
    arrays = keyed.groupBy("query_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    start = F.struct(F.lit(0).alias("low"), F.size("keys").alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        later = F.get("keys", middle) <= F.col("key")
        return F.when(state["low"] >= state["high"], state).when(later, F.struct((middle + 1).alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    placed = rows.select("query_id", _KEYS[channel]().alias("key")).join(bounded(arrays), "query_id")
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda state: state["low"])
    counts = placed.select("query_id", found.alias("before")).groupBy("query_id", "before").agg(F.count("*").alias("n"))
    # A candidate's rank is one more than the number of rows that come before it.
    slots = arrays.select("query_id", F.posexplode("keys").alias("before", "key"))
    both = slots.select("query_id", "before", F.col("key.c").alias("chunk_id")).join(counts, ["query_id", "before"], "left")
    running = Window.partitionBy("query_id").orderBy("before")
    return both.select("query_id", "chunk_id", (1 + F.sum(F.coalesce("n", F.lit(0))).over(running)).cast("bigint").alias("rank"))


def fuse(scored: DataFrame, channels: dict[str, DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of the vector order and the keyword order of hybrid_scores, and of further `channels` of
    (query_id, chunk_id, rank).

    Each channel adds 1 / (60 + rank); ids that the vector order lacks are ignored; ties keep the vector order. Returns
    query_id, chunk_id, score, vector_rank, retrieval_score, channels and position.

    The first `limit` have at least 1 / (60 + limit) each, so with c channels a fused one stands within the first
    c * (60 + limit) - 60 of some channel. Those are the candidates; their exact ranks elsewhere are counted.
    """
    reach = (len(channels) + 2) * (RRF_K + limit) - RRF_K
    ids = []
    for channel, rows in (("vector", scored), ("keyword", keyword_hits(scored))):
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(_KEYS[channel]()))
        ids.append(rows.withColumn("n", place).where(F.col("n") <= reach).select("query_id", "chunk_id"))
    for ranks in channels.values():
        ids.append(ranks.where(F.col("rank") <= reach).select("query_id", "chunk_id"))
    wanted = ids[0]
    for more in ids[1:]:
        wanted = wanted.unionByName(more)
    candidates = written(scored.join(wanted.distinct(), ["query_id", "chunk_id"], "left_semi"), "candidates")
    joined, total, names = candidates, F.lit(0.0), []
    given = {"vector": _counted_ranks(candidates, scored, "vector"), "keyword": _counted_ranks(keyword_hits(candidates), keyword_hits(scored), "keyword")}
    for name, ranks in (given | channels).items():
        joined = joined.join(ranks.select("query_id", "chunk_id", F.col("rank").alias(f"rank_{name}")), ["query_id", "chunk_id"], "left")
        total = total + F.coalesce(1 / (RRF_K + F.col(f"rank_{name}")), F.lit(0.0))
        names.append(F.when(F.col(f"rank_{name}").isNotNull(), name))
    fused = joined.select(
        "query_id", "chunk_id", "score", F.col("rank_vector").alias("vector_rank"), total.alias("retrieval_score"), F.array_compact(F.array(*names)).alias("channels")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("retrieval_score", 12)), "vector_rank")
    return fused.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit)


def sources(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source rows of an answer: index, document, rounded scores, channels and an excerpt."""
    return fused.join(chunks, "chunk_id").select(
        "query_id", F.col("position").alias("index"), "doc_id", "title", F.round("score", 5).alias("score"),
        F.round("retrieval_score", 5).alias("retrieval_score"), "channels", F.substring("content", 1, 240).alias("excerpt"),
    )


def context(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): `[i] title` and content of each chunk, in order, with blank lines between."""
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content"))
    rows = fused.join(chunks, "chunk_id").select("query_id", F.struct("position", line.alias("line")).alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n\n")
    return rows.groupBy("query_id").agg(joined.alias("context"))


def rerank(candidates: DataFrame, ranked_ids: DataFrame, limit: int) -> DataFrame:
    """Candidates in the order that a model returned, if it is a permutation of them; else in their own order.

    `ranked_ids` holds (query_id, ids). Adds final_position and applied.
    """
    own = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("own"))
    valid = (F.size("own") >= 2) & (F.sort_array("ids") == F.col("own"))
    judged = own.join(ranked_ids, "query_id", "left").select("query_id", "ids", F.coalesce(valid, F.lit(False)).alias("applied"))
    placed = candidates.join(judged, "query_id").withColumn(
        "final_position", F.when(F.col("applied"), F.array_position("ids", F.col("chunk_id"))).otherwise(F.col("position"))
    )
    return placed.drop("ids").where(F.col("final_position") <= limit)
