"""Removal of cross-site boilerplate lines by their spread over distinct sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 3
#: Lines of fewer words never count.
MIN_WORDS = 1
#: White space that is trimmed off a line.
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace() and chr(code) != "\n")
#: Sketch size: 2**12 registers, a relative standard error of about 1.6 %.
LOG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LOG_K / 2)


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(r1, r2, site, lines) of each row: a hash that finds it again, its site, and its countable lines as structs of
    place and a 128-bit key of the trimmed, lower-cased line."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    # Lower-casing in a projection of its own happens once a text.
    rows = docs.select(
        *[F.xxhash64(F.lit(seed), id_col, text_col).alias(name) for name, seed in (("r1", 3), ("r2", 5))],
        site.alias("site"),
        F.transform(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(SPACES))).alias("plain"),
    )

    def line(x: Column, at: Column) -> Column:
        counts = x != ""
        if min_words > 1:
            counts = counts & (F.size(F.filter(F.split(x, f"[{SPACES}]+"), lambda w: w != "")) >= min_words)
        return F.when(counts, F.struct(at.alias("at"), F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(29), x).alias("k2")))

    return rows.select("r1", "r2", "site", F.filter(F.transform("plain", line), lambda x: x.isNotNull()).alias("lines"))


def page_lines(rows: DataFrame) -> DataFrame:
    """(k1, k2, site): the lines of each page with its site; one that a page repeats is told again.

    Rows with the same lines in the same order are copies: they are one page, on one site.
    """
    keys = F.transform("lines", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2")))
    pages = rows.where(F.size("lines") > 0).select("site", keys.alias("keys"))
    pages = pages.groupBy(F.xxhash64("keys").alias("t1"), F.xxhash64(F.lit(7), "keys").alias("t2")).agg(
        F.min("site").alias("site"), F.first("keys").alias("keys")
    )
    return pages.select("site", F.explode("keys").alias("key")).select("key.k1", "key.k2", "site")


def boilerplate_keys(lines: DataFrame, min_sites: int) -> DataFrame:
    """(k1, k2): lines on at least `min_sites` sites.

    A HyperLogLog sketch per line, merged by the aggregation, gives its spread. Where the estimate is within three
    standard errors (at least one site) of the threshold, the distinct sites of the line are counted exactly.
    """
    margin = max(1, round(3 * STANDARD_ERROR * min_sites))
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites - margin), "spread")
    near = F.col("sites") <= min_sites + margin
    exact = lines.join(spread.where(near).select("k1", "k2"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.count_distinct("site").alias("exact"))
    return spread.where(~near).select("k1", "k2").unionByName(exact.where(F.col("exact") >= min_sites).select("k1", "k2"))


def remove_boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    id_col: str = "doc_id",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The id, text and site columns of `docs`, the text without lines that stand on `min_sites` distinct sites.

    Adds n_lines and n_removed. Lines are compared trimmed and lower-cased; every line that is not empty counts, or has
    `min_words` words where that is set higher. Rows with the same lines are one page on one site, so the copies of a
    text do not make its lines boilerplate; lines that near copies share go like any others.

    Defined cases: a null text stays null and has no lines; a null site is one site of its own; null ids and repeated
    rows are treated like any other row, repeated rows alike; an empty table gives no rows; other columns are not
    carried along, so clashing names cannot interfere. No row gathers more than the lines of one text.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("own_id"),
        F.col(f"`{text_col}`").cast("string").alias("own_text"),
        F.col(f"`{site_col}`").alias("own_site"),
        *[F.col(f"`{name}`").alias(f"carried_{i}") for i, name in enumerate(carry)],
    )
    lined = written(line_rows(rows, "own_id", "own_text", "own_site", min_words), "lines")
    keys = written(boilerplate_keys(page_lines(lined), min_sites), "boilerplate")
    placed = lined.select("r1", "r2", F.explode("lines").alias("line")).select("r1", "r2", "line.at", "line.k1", "line.k2").join(keys, ["k1", "k2"])
    # Equal ids with equal texts lose the same lines, so a hash of both stands for the row; sets tell them once.
    found = placed.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("at")).alias("removed"))
    row = {name: F.xxhash64(F.lit(seed), "own_id", "own_text") for name, seed in (("r1", 3), ("r2", 5))}
    joined = rows.withColumns(row).join(found, ["r1", "r2"], "left")
    lines = F.split("own_text", "\n")
    # What stands between lines that go is taken in slices, so the work grows with the lines and not with their square.
    edges = F.concat(F.array(F.lit(-1)), "removed", F.array(F.size(lines)))
    between = lambda own, cut: F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut) - 2), lambda i: F.slice(own, F.get(cut, i) + 2, F.get(cut, i + 1) - F.get(cut, i) - 1)))
    # A lambda's argument is computed once; named inside it, the text would be split anew for each slice.
    left = F.transform(F.array(F.struct(lines.alias("own"), edges.alias("cut"))), lambda x: F.array_join(between(x["own"], x["cut"]), "\n"))[0]
    return joined.select(
        F.col("own_id").alias(id_col),
        F.when(F.col("removed").isNull(), F.col("own_text")).otherwise(left).alias(text_col),
        F.col("own_site").alias(site_col),
        *[F.col(f"carried_{i}").alias(name) for i, name in enumerate(carry)],
        F.when(F.col("own_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )
