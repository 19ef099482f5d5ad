"""Bounded expansion around named entities, and search over community summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalar import normalize_name
from ..session import ship, written
from .components import dealt_anew
from .retrieval import MOST_QUESTIONS, bounded, spread
from .search import vector_best

#: Characters of a name by which it is found.
HEAD = 64
#: Rows of evidence that a task deals with at a time, and what it makes of them.
FIRST_ROWS = 1 << 14
FIRST = "chunk_id long, c double, r long, e long, queries array<long>"


def seeds(questions: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, kb_id, entity_id) of entities whose name or alias stands in the question, the first max_nodes by id.

    `questions` (query_id, kb_id, question) is a stated set; a bounded one is sent to the entities.
    """
    limit = settings.limits()["max_nodes"]
    empty = F.array().cast("array<string>")
    names = F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", empty)), normalize_name)
    asked = bounded(questions.select("query_id", "kb_id", normalize_name(F.col("question")).alias("plain")))
    named = entities.select("kb_id", "entity_id", names.alias("names")).join(asked, "kb_id")
    hit = named.where(F.exists("names", lambda n: (F.length(n) >= 2) & F.col("plain").contains(n)))
    order = Window.partitionBy("query_id").orderBy("entity_id")
    return hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("query_id", "kb_id", "entity_id")


def name_index(entities: DataFrame) -> DataFrame:
    """(kb_id, key, size, name, entity_id): the normalized names and aliases of entities by a hash of their first `size`
    characters: all of them, but of names of more than HEAD.

    A name stands in a question only if a piece of its size there has its hash, so what meets is what matches, however
    many names share their parts.
    """
    empty = F.array().cast("array<string>")
    names = F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", empty)), normalize_name)
    names = entities.select("kb_id", "entity_id", F.explode(F.array_distinct(names)).alias("name")).where(F.length("name") >= 2)
    size = F.least(F.length("name"), F.lit(HEAD)).alias("size")
    return names.select("kb_id", F.xxhash64("kb_id", F.substring("name", 1, HEAD)).alias("key"), size, "name", "entity_id")


def indexed_seeds(questions: DataFrame, index: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The seeds of any number of questions by an equi join of their pieces with a stored name_index, of the sizes that
    are in it; what meets is verified on the question's text.

    A question has hundreds of pieces, so neither side is sent whole to any task, whatever the planner takes the few bytes
    of the questions for. Of the entities that share a name only the first max_nodes can be seeds; others meet nothing.
    """
    limit = settings.limits()["max_nodes"]
    asked = written(questions.select("query_id", "kb_id", normalize_name(F.col("question")).alias("plain")), "questions")
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())  # HEAD at most
    sized = spread(asked).select("query_id", "kb_id", "plain", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where(F.length("plain") >= F.col("size"))
    cut = F.transform(F.sequence(F.lit(1), F.length("plain") - F.col("size") + 1), lambda i: F.xxhash64("kb_id", F.substring("plain", i, F.col("size"))))
    pieces = sized.select("query_id", F.explode(F.array_distinct(cut)).alias("key"))
    alike = Window.partitionBy("key", "kb_id", "name").orderBy("entity_id")
    names = index.select("kb_id", "key", "name", "entity_id").repartition("key").withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= limit).drop("n")
    met = pieces.hint("merge").join(names, "key").drop("key")
    hit = met.join(asked, ["query_id", "kb_id"]).where(F.col("plain").contains(F.col("name"))).select("query_id", "kb_id", "entity_id").distinct()
    order = Window.partitionBy("query_id").orderBy("entity_id")
    return hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("query_id", "kb_id", "entity_id")


def _endpoints(edges: DataFrame) -> DataFrame:
    """Edges by either end, so that expansion is an equi join and not a disjunction."""
    return edges.select("kb_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity_id"), "relationship_id", "source", "target", "confidence")


def _hop(state: DataFrame, by_end: DataFrame, hop: int, most: int) -> DataFrame:
    """The state after one more hop: one row a question with its nodes and edges so far, and the new frontier."""
    live = state.where((F.size("nodes") < most) & (F.size("frontier") > 0)).select("query_id", "kb_id", F.explode("frontier").alias("entity_id"))
    touched = by_end.join(live, ["kb_id", "entity_id"])
    # An edge may be met by both ends, so twice the wanted number is enough; a partial limit leaves no more in each task.
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "relationship_id")
    touched = touched.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 4 * most)
    edge = F.struct(F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c"), "relationship_id", "source", "target")
    found = touched.groupBy("query_id").agg(F.slice(F.array_distinct(F.array_sort(F.collect_list(edge))), 1, 2 * most).alias("touched"))
    joined = state.join(found, "query_id", "left")
    known = F.transform("nodes", lambda x: x["entity_id"])
    ends = F.flatten(F.transform("touched", lambda e: F.array(e["source"], e["target"])))
    fresh = F.when(F.col("touched").isNull(), F.array().cast("array<bigint>")).otherwise(F.slice(F.array_except(ends, known), 1, most - F.size("nodes")))
    old = F.transform("edges", lambda e: e["relationship_id"])
    placed = F.transform(F.coalesce("touched", F.array()), lambda e, i: F.struct(e["relationship_id"].alias("relationship_id"), F.lit(hop).alias("hop"), (i + 1).alias("position")))
    state = joined.select("query_id", "kb_id", "nodes", fresh.alias("frontier"), F.concat("edges", F.filter(placed, lambda e: ~F.array_contains(old, e["relationship_id"]))).alias("edges"))
    return state.withColumn("nodes", F.concat("nodes", F.transform("frontier", lambda x: F.struct(x.alias("entity_id"), F.lit(hop).alias("hop")))))


def expand(start: DataFrame, edges: DataFrame, max_hops: int = 2, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, entity_id, hop) and edges (query_id, relationship_id, hop, position) around the seeds.

    A hop takes the edges that touch the frontier, the most confident 2 * max_nodes of them; their ends join in edge
    order, source first, until the question has max_nodes nodes. An edge counts where it was first found, also if an
    end was not admitted; a question that is full expands no further.

    What a question has found is bounded, so it is one row of a table that is written after each hop. Its size is known
    then, and the planner sends a small frontier to the edges, which stay where they are.
    """
    limits = settings.limits(max_hops=max_hops)
    nodes = F.transform("frontier", lambda x: F.struct(x.alias("entity_id"), F.lit(0).alias("hop")))
    state = start.groupBy("query_id", "kb_id").agg(F.sort_array(F.collect_set(F.col("entity_id").cast("bigint"))).alias("frontier"))
    state = state.withColumns({"nodes": nodes, "edges": F.array().cast("array<struct<relationship_id:bigint,hop:int,position:int>>")})
    by_end = _endpoints(edges.withColumn("relationship_id", F.col("relationship_id").cast("bigint")))
    state = written(state, "hop")
    for hop in range(1, limits["max_hops"] + 1):
        state = written(_hop(state, by_end, hop, limits["max_nodes"]), "hop")
    found = state.select("query_id", F.explode("edges").alias("e")).select("query_id", "e.*")
    return state.select("query_id", F.explode("nodes").alias("n")).select("query_id", "n.*"), found


def evidence_chunks(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of the chunks that prove the edges, ranked in order of first discovery."""
    rows = found.join(evidence.select("relationship_id", "evidence_id", "chunk_id"), "relationship_id")
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hop", "position", "evidence_id")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "chunk_id", F.row_number().over(order).cast("bigint").alias("rank"))


def community_search(queries: DataFrame, communities: DataFrame, k: int = 5) -> DataFrame:
    """The k communities of the kb that are most similar to the question; ties go to the finer level, then the id.

    Communities are scored where they lie; a task keeps the first k of each question and level.
    """
    k = min(max(k, 1), 10)
    levels = [r[0] for r in communities.select("level").distinct().collect()]  # a handful
    asked = queries.select("query_id", "kb_id", "qvec")
    found = None
    for level in levels:
        of = F.col("level").eqNullSafe(F.lit(level))
        own = vector_best(asked, communities.where(of).select("kb_id", F.col("community_id").alias("chunk_id"), "embedding"), k)
        own = own.withColumn("level", F.lit(level).cast(communities.schema["level"].dataType))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = communities.limit(0).select(F.col("community_id").alias("query_id"), F.col("community_id").alias("chunk_id"), F.lit(0.0).alias("score"), "level")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "level", "chunk_id")
    ranked = found.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= k)
    ranked = ranked.join(asked.select("query_id", "kb_id"), "query_id")
    return ranked.select("query_id", "kb_id", F.col("chunk_id").alias("community_id"), "level", F.round("score", 5).alias("score"), "position")


def community_chunks(selected: DataFrame, members: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of chunks that prove edges between members of the selected communities.

    Entities of the same selected communities are alike to all questions, so edges meet the sets of communities at their
    ends, one row an edge, and questions only join once the pairs of sets are known that have any. All questions order
    evidence alike, so a row of it is placed once, with the list of the questions for which it is a chunk's first.
    """
    chosen = written(selected.select("query_id", "community_id").distinct(), "selected")
    inside = members.join(bounded(chosen.select("community_id").distinct()), "community_id")
    sets = inside.groupBy("entity_id").agg(F.array_sort(F.collect_set("community_id")).alias("held"))
    sets = written(sets.withColumn("set_id", F.sha2(F.array_join(F.col("held").cast("array<string>"), ","), 256)), "sets")
    asked = sets.select("set_id", "held").dropDuplicates(["set_id"]).select("set_id", F.explode("held").alias("community_id")).join(chosen, "community_id").select("query_id", "set_id").distinct()
    asked = written(asked, "asked-sets")
    own = lambda side: sets.select(F.col("entity_id").alias(side), F.col("set_id").alias(f"{side}_set"))
    placed = written(edges.select("relationship_id", "source", "target").join(own("source"), "source").join(own("target"), "target").select("relationship_id", "source_set", "target_set"), "inner-edges")
    pairs = placed.select("source_set", "target_set").distinct()
    pairs = pairs.join(asked.withColumnRenamed("set_id", "source_set"), "source_set").join(asked.withColumnRenamed("set_id", "target_set"), ["query_id", "target_set"])
    pairs = pairs.groupBy("source_set", "target_set").agg(F.collect_list(F.col("query_id").cast("long")).alias("queries"))
    pairs = written(pairs.withColumn("pair_id", F.monotonically_increasing_id()), "set-pairs")
    both = placed.join(dealt_anew(pairs.drop("queries"), "source_set", "target_set"), ["source_set", "target_set"]).select("relationship_id", "pair_id")
    rows = both.join(evidence, "relationship_id").select("chunk_id", "pair_id", F.struct((-F.col("confidence")).alias("c"), F.col("relationship_id").alias("r"), F.col("evidence_id").alias("e")).alias("at"))
    least = rows.repartition("chunk_id").groupBy("chunk_id", "pair_id").agg(F.min("at").alias("at"))
    few = pairs.limit(MOST_QUESTIONS + 1).count() <= MOST_QUESTIONS
    own = least.join(F.broadcast(pairs) if few else pairs, "pair_id").select("chunk_id", "at.*", "queries")
    own = own if few else own.repartition("chunk_id")
    ship(edges.sparkSession)
    columns = [F.col("chunk_id").cast("long").alias("chunk_id"), F.col("c").cast("double").alias("c"), F.col("r").cast("long").alias("r"), F.col("e").cast("long").alias("e"), "queries"]
    first = own.select(*columns).sortWithinPartitions("chunk_id", "c", "r", "e").mapInArrow(_firsts, FIRST)
    return _placed(written(first, "first"))


def _placed(first: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of rows (chunk_id, c, r, e, queries), whose order (c, r, e) is one for all questions.

    Rows are dealt by ranges of the order, and each range is told how many rows of a question stand before it; so a row
    moves once for all of its questions.
    """
    order, n = ["c", "r", "e"], int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(first.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.select("part", F.explode("queries").alias("query_id")).groupBy("part", "query_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("part", "query_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    starts = skips.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("query_id", "skip"))).alias("s"))
    starts = starts.select("part", F.lit(0).alias("kind"), F.col("s.query_id").alias("queries"), F.col("s.skip").alias("skips"))
    stream = starts.unionByName(dealt.withColumn("kind", F.lit(1)), True)
    return stream.repartition(n, "part").sortWithinPartitions("part", "kind", *order).mapInArrow(_ranked, "query_id long, chunk_id long, rank long")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of chunk and place; a question stays with the first row of a chunk that has it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FIRST_ROWS:
            rows = pa.Table.from_batches(held)
            chunk = rows["chunk_id"].to_numpy()
            end = int(np.searchsorted(chunk, chunk[-1]))  # the last chunk may go on
            if end:
                yield _own(rows.slice(0, end))
            held, n = rows.slice(end).to_batches(), n - end
    if n:
        yield _own(pa.Table.from_batches(held))


def _own(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    lists = rows["queries"].combine_chunks()
    row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    flat = lists.flatten().to_numpy()
    chunk, (ids, query) = np.unique(rows["chunk_id"].to_numpy(), return_inverse=True)[1], np.unique(flat, return_inverse=True)
    kept = np.sort(np.unique(chunk[row] * len(ids) + query, return_index=True)[1])
    sizes = np.bincount(row[kept], minlength=len(rows))
    some = np.flatnonzero(sizes)
    queries = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]), pa.int32()), pa.array(flat[kept]))
    told = rows.drop_columns(["queries"]).take(pa.array(some)).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*told.columns, queries], names=[*told.schema.names, "queries"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = counts = None
    for batch in batches:
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        own, kind = c["part"].to_numpy(), c["kind"].to_numpy()
        ends = np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *ends], [*ends, len(own)], strict=True):
            if a == b:
                continue
            lists = c["queries"].slice(a, b - a)
            flat = lists.flatten().to_numpy()
            if kind[a] == 0:
                ids, counts = flat, c["skips"].slice(a, b - a).flatten().to_numpy().copy()
                continue
            at = np.searchsorted(ids, flat)
            order = np.argsort(at, kind="stable")
            found = np.bincount(at, minlength=len(ids))
            number = np.empty(len(at), dtype=np.int64)
            number[order] = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
            chunks = np.repeat(c["chunk_id"].slice(a, b - a).to_numpy(), lists.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(chunks), pa.array(counts[at] + number + 1)], names=["query_id", "chunk_id", "rank"])
            counts += found
