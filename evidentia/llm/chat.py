"""Chat formatting after a collapse of cumulative snapshots. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import pick

#: Turn numbers of a range, which is placed, summed and rendered together.
BLOCK_TURNS = 256
LANES = ("h0", "h1", "h2", "h3")
#: A conversation, and a range of its turns; a null conv_id is a conversation of its own.
CONV = ("c", "c_null")
RANGE = (*CONV, "r", "r_role", "r_text")


def turn_rows(turns: DataFrame, block_turns: int) -> DataFrame:
    """Turns with their conversation and range; nulls as empty texts.

    A range holds `block_turns` turn numbers. Turns without a number come first; their ranges go by role and the first
    signs of the text, which is their order, so that a conversation without numbers is dealt over many ranges too.
    """
    rows = pick(turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}).select(
        F.coalesce("conv_id", F.lit(0).cast("long")).alias("c"), F.col("conv_id").isNull().alias("c_null"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    none = F.col("turn").isNull()
    return rows.select(
        *CONV,
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long").alias("r"),
        F.when(none, F.col("role")).otherwise("").alias("r_role"),
        F.when(none, F.substring("text", 1, 3)).otherwise("").alias("r_text"),
        F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "text",
    )


def hashed_turns(rows: DataFrame) -> DataFrame:
    """Turns with two hashes in place of the text, and `tie`, the text's place among those of its turn and role.

    Turns that share number and role are ordered by their text. Only the texts of such turns are read a second time.
    """
    hashes = [F.xxhash64(F.lit(seed), "role", F.length("role"), "text").alias(name) for seed, name in ((11, "t1"), (23, "t2"))]
    hashed = rows.select(*RANGE, "turn", "role", *hashes, "text")
    same = [*RANGE, "turn", "role"]
    tied = hashed.groupBy(*same).agg(F.min("t1").alias("low"), F.max("t1").alias("high")).where("low <> high")
    tied = written(tied.select(*same), "tied-turns")
    order = Window.partitionBy(*same).orderBy("text")
    ties = hashed.join(tied, same, "left_semi").distinct().withColumn("tie", F.row_number().over(order))
    plain = hashed.drop("text").join(ties.select(*same, "t1", "t2", "tie"), [*same, "t1", "t2"], "left")
    return plain.withColumn("tie", F.coalesce("tie", F.lit(0)))


def prefix_hashes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each turn the rolling hash of the turns up to it, and the ranges of each conversation.

    Turns are placed and their lanes summed inside their ranges; the sums of earlier ranges are added. A lane is a
    31-bit value that is bound to the turn's place, role and text. Returns (conversation, place, n_turns, lanes) and
    (range, part, n_parts, n_turns); all tables that are shuffled hold hashes and no text.
    """
    hashed = written(hashed_turns(rows), "hashed-turns")
    before = Window.partitionBy(*CONV).orderBy("r", "r_role", "r_text").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*CONV)
    ranges = hashed.groupBy(*RANGE).agg(F.count("*").alias("size"))
    ranges = ranges.select(
        *RANGE, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"), F.sum("size").over(whole).alias("n_turns"),
        F.count("*").over(before).alias("part"), F.count("*").over(whole).alias("n_parts"),
    )
    ranges = written(ranges, "ranges")
    inside = Window.partitionBy(*RANGE).orderBy("turn", "role", "tie", "t1", "t2")
    placed = hashed.withColumn("at", F.row_number().over(inside) - 1).join(ranges.select(*RANGE, "skip", "n_turns"), list(RANGE))
    place = (F.col("at") + F.col("skip")).cast("long")
    lanes = []
    for seed in (11, 23):
        wide = F.xxhash64(F.lit(seed), "place", "t1", "t2")
        lanes += [F.shiftrightunsigned(wide, 33), wide.bitwiseAND(F.lit(0x7FFFFFFF))]
    placed = placed.withColumn("place", place).select(*RANGE, "place", "n_turns", *[x.alias(name) for x, name in zip(lanes, LANES, strict=True)])
    running = Window.partitionBy(*RANGE).orderBy("place")
    sums = written(placed.select(*RANGE, "place", "n_turns", *[F.sum(x).over(running).alias(x) for x in LANES]), "range-sums")
    # The last turn of a range holds its sum.
    ends = sums.groupBy(*RANGE).agg(*[F.max_by(x, "place").alias(x) for x in LANES])
    ends = ends.select(*RANGE, *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"skip_{x}") for x in LANES])
    late = ends.where(" OR ".join(f"skip_{x} <> 0" for x in LANES))  # most conversations have a single range
    joined = sums.join(written(late, "range-skips"), list(RANGE), "left")
    lanes = [(F.col(x) + F.coalesce(f"skip_{x}", F.lit(0))).alias(x) for x in LANES]
    return joined.select(*CONV, "place", "n_turns", *lanes), ranges.drop("skip")


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """Conversations that no longer one continues; of equal ones the smallest conv_id (null first)."""
    last = hashes.where(F.col("place") == F.col("n_turns") - 1)
    first = F.min(F.struct((~F.col("c_null")).alias("known"), "c")).alias("first")
    whole = last.groupBy("place", *LANES).agg(first, F.count("*").alias("n_equal"))
    inner = hashes.where(F.col("place") < F.col("n_turns") - 1).select("place", *LANES).distinct()
    kept = whole.join(inner, ["place", *LANES], "left_anti")
    return kept.select(F.col("first.c").alias("c"), (~F.col("first.known")).alias("c_null"), "n_equal")


def chat_format(
    turns: DataFrame,
    block_turns: int = BLOCK_TURNS,
    begin: str = "<|im_start|>",
    end: str = "<|im_end|>",
) -> DataFrame:
    """Maximal conversations as chat text.

    A conversation that equals the first turns of a longer one is a snapshot of it and goes; of equal conversations
    the one with the smallest conv_id stays. Each remaining conversation is rendered as `begin role \\n text end \\n`
    per turn. Returns conv_id, part, n_parts, n_turns, n_equal (how many equal conversations it stands for) and text;
    a part holds the turns of one range of `block_turns` numbers, so that no row gathers an unbounded conversation, and
    joining the parts in order gives its whole text. Texts are hashed once and shuffled once, to be rendered.

    Defined cases: a null role or text counts as empty; a null conv_id names one conversation of its own, ordered
    before all others; null turn numbers come first; turns with equal numbers are ordered by role and text, and
    repeated rows are separate turns; an empty table gives an empty result; further columns are ignored.
    """
    rows = turn_rows(turns, block_turns)
    hashes, ranges = prefix_hashes(rows)
    kept = written(maximal_conversations(hashes), "maximal")
    parts = written(ranges.join(kept, list(CONV)), "parts")
    told = rows.join(parts, list(RANGE)).groupBy(*RANGE, "part", "n_parts", "n_turns", "n_equal").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    line = F.transform("turns", lambda x: F.concat(F.lit(begin), x["role"], F.lit("\n"), x["text"], F.lit(end + "\n")))
    return told.select(
        F.when(~F.col("c_null"), F.col("c")).alias("conv_id"),
        *[F.col(name).cast("long").alias(name) for name in ("part", "n_parts", "n_turns", "n_equal")],
        F.array_join(line, "").alias("text"),
    )
