"""A Merkle manifest of a dataset, with proofs looked up by coordinates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import fold_ascii

#: Children of a node, as a power of two.
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Rows of the node table that are broadcast at most: whole levels from the top, each row of at most FAN digests.
MOST_TOP = 4096
_LEVELS = 21  # 8**21 is beyond the range of a count


def sha(text: Column) -> Column:
    """The digest of a text as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(digests: Column) -> Column:
    """Digests that stand one behind the other, as the hex text that their parent is the hash of."""
    return F.lower(F.hex(digests))


def encoded(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, columns: list[str], id_col: str, group_col: str, text_col: str, every: int) -> DataFrame:
    """One narrow row for each input row, as a table: row, doc_id, tree, leaf, and the tampered leaf where `every` divides
    the id's checksum. Texts are read here and nowhere else."""
    own = docs.select(*[F.col(f"`{c}`").alias(c) for c in columns])
    whole = F.concat(*[encoded(F.col(c)) for c in columns])
    changed = F.concat(*[encoded(fold_ascii(F.col(c)) if c == text_col else F.col(c)) for c in columns])
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return written(own.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("tree"),
        sha(whole).alias("leaf"), F.when(chosen, sha(changed)).alias("tampered"),
    ), "leaves")


def numbered(rows: DataFrame, by: str, order: list[str], name: str, count: str) -> DataFrame:
    """Adds the place of each row within its `by`, in an order without ties, the number of rows there, and its range (`part`).

    Rows are dealt and sorted by ranges of the order, so no task holds a large group; a row's place is that in its range
    and the sizes of the ranges before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)
    at = F.monotonically_increasing_id()
    dealt = written(sorted_rows.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    sizes = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_in"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_skip"), F.sum("_n").over(Window.partitionBy(by)).alias(count))
    placed = dealt.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_in")))
    return placed.withColumn(name, F.col("_at") + F.col("_skip")).withColumnRenamed("_part", "part").drop("_at", "_by", "_in", "_skip")


def depth(n: Column) -> Column:
    """Levels above `n` leaves."""
    return sum(((n > F.lit(FAN**k)).cast("int") for k in range(1, _LEVELS)), (n > 1).cast("int"))


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of all levels (tree, level, run, digests) and the top (tree, digest) of trees over (tree, place, size, digest).

    A run is up to FAN digests of neighbours, one behind the other: the node table, by the coordinate of what a proof asks
    for. Each level is a table of its own, an eighth of the one below; trees with one node left are done.
    """
    level, runs, tops = 0, None, None
    while True:
        alone = nodes.where("size = 1").select("tree", "digest")
        tops = alone if tops is None else tops.unionByName(alone)
        rest = nodes.where("size > 1").withColumn("run", F.shiftright("place", FAN_BITS))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("digest").alias("h")))), lambda x: x["h"]), "")
        made = written(rest.groupBy("tree", "size", "run").agg(F.unhex(joined).alias("digests")), f"level-{level}")
        if made.isEmpty():
            break
        own = made.select("tree", F.lit(level).alias("level"), "run", "digests")
        runs = own if runs is None else runs.unionByName(own)
        nodes = made.select("tree", F.col("run").alias("place"), F.shiftright(F.col("size") + (FAN - 1), FAN_BITS).alias("size"), sha(hexed(F.col("digests"))).alias("digest"))
        level += 1
    if runs is None:
        runs = nodes.select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("run"), "digest").where("false").withColumnRenamed("digest", "digests")
    return runs, tops


def looked_up(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, level, at, digests) for each coordinate that `asked` (key, tree, place, size) needs: the runs on its way up.

    Whole levels that have at most MOST_TOP runs together are broadcast: they are what very many leaves ask for. Lower
    runs are asked for by few leaves each and meet them in a join of two exchanges.
    """
    steps = F.transform(F.sequence(F.lit(0), depth(F.col("size")) - 1), lambda i: i)
    rows = asked.where("size > 1").select("key", "tree", "place", F.explode(steps).alias("level"))
    up = lambda x, n: F.expr(f"shiftright({x}, {FAN_BITS} * ({n}))")
    rows = rows.select("key", "tree", "level", up("place", "level + 1").alias("run"), up("place", "level").bitwiseAND(FAN - 1).alias("at"))
    sizes = {r["level"]: r["n"] for r in runs.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row for each level
    cut, held = max(sizes, default=-1) + 1, 0
    while cut > 0 and held + sizes[cut - 1] <= MOST_TOP:
        cut -= 1
        held += sizes[cut]
    own = runs.withColumnRenamed("tree", "_tree").withColumnRenamed("level", "_level").withColumnRenamed("run", "_run")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("run") == F.col("_run"))
    top = rows.where(F.col("level") >= cut).join(F.broadcast(own.where(F.col("_level") >= cut)), same)
    found = top if cut == 0 else top.unionByName(rows.where(F.col("level") < cut).join(own.where(F.col("_level") < cut), same))
    return found.select("key", "level", "at", "digests")


def paths(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, path): for each asked key the steps from its leaf up, as (level, before, after) digests of its siblings."""
    found = looked_up(asked, runs)
    step = F.struct("level", F.expr("substring(digests, 1, 32 * at)").alias("before"), F.expr("substring(digests, 32 * at + 33)").alias("after"))
    return found.select("key", step.alias("step")).groupBy("key").agg(F.array_sort(F.collect_list("step")).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: sha(F.concat(hexed(s["before"]), hexed(node), hexed(s["after"]))))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper_every: int = 3,
) -> DataFrame:
    """Every row's leaf, subroot, root and proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a group stand in the order of their ids; every 8 consecutive nodes become one until one is left, the
    group's subroot, and the subroots in the order of their groups give the root in the same way. A leaf explodes the
    coordinates of the runs on its way up from its place and the size of its group alone, joins them with the node
    table, orders them and folds its siblings. The leaf that is folded is the tampered one for every third row.

    Defined cases: nulls are encoded as `-`, and a null group is the first; a null id is the first of its group and is not
    tampered with; rows that repeat an id are ordered by their leaves, and equal rows are leaves of their own; empty and
    very long texts are hashed whole; a single row is its own root, with a proof of no siblings; an empty table gives an
    empty result; further columns are ignored.
    """
    rows = leaves(docs, list(columns), id_col, group_col, text_col, tamper_every)
    placed = written(numbered(rows, "tree", ["doc_id", "leaf", "row"], "place", "size"), "placed")
    runs, tops = grown(placed.select("tree", "place", "size", F.col("leaf").alias("digest")))
    subroots = tops.select(F.lit(0).alias("all"), F.col("tree"), F.col("digest"))
    groups = written(numbered(subroots, "all", ["tree"], "place", "size"), "groups")
    upper, root = grown(groups.select(F.lit("").alias("tree"), "place", "size", "digest"))
    # A proof's end is the same for all leaves of a group; it is looked up once a group.
    ends = paths(groups.select(F.struct("tree").alias("key"), F.lit("").alias("tree"), "place", "size"), upper).select(F.col("key.tree").alias("tree"), F.col("path").alias("end"))
    groups = groups.select(F.col("tree").alias("group"), F.col("digest").alias("subroot")).join(ends, F.col("group").eqNullSafe(F.col("tree")), "left").drop("tree")
    groups = groups.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    # A group's rows find what they share by group and range, so a large group is spread over its ranges.
    ranges = placed.select(F.col("tree").alias("in_tree"), F.col("part").alias("in_part")).distinct()
    shared = written(ranges.join(groups, F.col("in_tree").eqNullSafe(F.col("group"))).drop("group"), "shared")
    told = placed.join(shared, F.col("tree").eqNullSafe(F.col("in_tree")) & (F.col("part") == F.col("in_part")))
    none = F.array().cast("array<struct<level:int,before:binary,after:binary>>")
    way = paths(placed.select(F.col("row").alias("key"), "tree", "place", "size"), runs)
    told = told.join(way, F.col("row") == F.col("key"), "left")
    path = F.concat(F.coalesce("path", none), F.coalesce("end", none))
    told = told.select("doc_id", "leaf", "subroot", "root", path.alias("path"), F.coalesce("tampered", "leaf").alias("begin"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(F.hex(s["before"]), F.hex(s["after"]))), "")
    told = told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(siblings).cast("binary"), 256).alias("proof_sha256"), folded(F.col("begin"), F.col("path")).alias("folded"))
    return told.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "proof_sha256",
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
