"""Connected components, and joins whose hot keys can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, written


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with computed keys, so that a join brings an exchange of its own for it.

    An aggregate on the join's keys is already dealt by them, and the adaptive planner then has to leave the other side
    of the join as it is; between two exchanges it can split a hot key of the other side over several tasks.
    """
    return df.withColumns({key: F.when(F.col(key).isNotNull(), F.col(key)) for key in keys})


def _minima(rows: DataFrame) -> DataFrame:
    return dealt_anew(rows.select(F.col("a").alias("c"), "m"), "c")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of `edges` (a, b), where root is the smallest node of the component.

    Each round makes every node point at the smallest node that it or a neighbour points at (large star) and shortens
    the paths (small star); the rows never outnumber the edges, and each round is cut off with a written table, which
    replaces the one before.
    """
    state = [F.count("*").alias("n"), F.count_distinct("a").alias("nodes"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h")]
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = links.agg(*state).first()
    for _ in range(max_rounds if before["n"] else 0):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _minima(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = _minima(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, F.col("a") == F.col("c")).where("b <> m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
        links, old = written(small.distinct(), "links"), links
        forget(old)
        after = links.agg(*state).first()
        if after == before and after["n"] == after["nodes"]:
            break
        before = after
    else:
        if before["n"]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
