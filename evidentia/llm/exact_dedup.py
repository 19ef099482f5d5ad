"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import fold_ascii, pick

#: Runs at the leaves of the tree, and how many neighbours one round merges (2**3: three binomial rounds at once).
LEAF_RUNS = 64
FAN_IN = 8
#: Leading bytes of a digest that tell its range: 2**24 ranges, so a last round has room for as many tasks as there are.
RANGE_BYTES = 3


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest of the normalised text, and the length and second hash that verify it."""
    rows = pick(docs, {id_col: "long", text_col: "string"})
    text = fold_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return rows.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("verify"),
    )


def tree_merge(rows: DataFrame, keep: str, leaf_runs: int = LEAF_RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Groups of equal texts with the identifier that stays and the group's size.

    Each task sorts its digests into a run and keeps one row of each digest before anything is shuffled. In each round,
    the runs of `fan_in` neighbours go to one place: the rows are dealt by digest range and run, so a partition holds
    the runs of whole ranges; it sorts them together and merges equal digests of neighbouring runs. The last round has
    one run for each digest range. A digest that a third of all rows share arrives in the first round as at most one
    row per task, and in the later ones as at most `fan_in` rows. The key of every level holds the length and a second
    hash, so the identifier that a level keeps is verified there: texts merge only if all three agree.
    """
    best = F.max if keep == "largest" else F.min
    key = ["part", "run", "digest", "n_bytes", "verify"]
    # A struct as buffer makes the planner aggregate in sorted order, partial runs before an exchange included.
    level = rows.select(
        F.conv(F.hex(F.substring("digest", 1, RANGE_BYTES)), 16, 10).cast("int").alias("part"),
        F.pmod(F.spark_partition_id(), F.lit(leaf_runs)).alias("run"),
        *key[2:],
        F.struct(F.col("doc_id").alias("id")).alias("kept"),
        F.lit(1).cast("long").alias("n"),
    )
    runs = leaf_runs
    while True:
        level = level.groupBy(*key).agg(best("kept").alias("kept"), F.sum("n").alias("n"))
        if runs == 1:
            break
        runs = max(1, -(-runs // fan_in))
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = level.repartition("part", "run").sortWithinPartitions(*key)
    return level.select(*key[2:], F.col("kept.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    leaf_runs: int = LEAF_RUNS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Every row with the identifier that its group keeps.

    Texts are equal if they are identical after lower-casing A-Z. Returns doc_id, keep_id, group_size, kept and
    text_sha256 for each input row. `keep` says whether the smallest or the largest identifier stays.

    Defined cases: a null text counts as empty, and empty texts form one group; a null id is ordered before all
    others, so it stays only in a group without other ids under "largest", and stays first under "smallest"; rows
    that repeat an id and a text share their fate (`kept` is true for each of them); an empty table gives an empty
    result; further columns are ignored. Texts of any length cost one pass and no shuffle.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    groups = tree_merge(rows, keep, leaf_runs, fan_in)
    key = ["digest", "n_bytes", "verify"]
    return rows.join(groups, key).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
