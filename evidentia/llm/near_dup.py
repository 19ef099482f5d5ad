"""N-gram Jaccard join by MinHash banding, with verification on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected, dealt_anew
from ..session import ship, written
from .common import U64, mix64, shingles, steps, tidy, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 256
#: Texts of a candidate group that one step compares with each other or with another block. A group of n texts
#: moves n / BLOCK_ROWS copies of itself, in pairs of blocks that are dealt over all tasks.
BLOCK_ROWS = 64
#: Characters that a block aims at, so that very long texts do not meet by the dozen in one task.
BLOCK_CHARS = 4 << 20
#: Shingles of a batch that are hashed at a time, so that they stay in the processor's cache.
HASH_STEP = 1 << 15


def choose_bands(threshold: float, target_recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance candidates) whose bands reach the recall at the threshold."""
    best = (max_hashes, 1)
    for rows in range(1, 33):
        agree = threshold**rows
        bands = math.ceil(math.log(1 - target_recall) / math.log1p(-agree)) if agree < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def min_hashes(values: np.ndarray, starts: np.ndarray, n_hashes: int) -> np.ndarray:
    """Minimum of each hash function over each text's shingles; every text has at least one shingle."""
    out = np.empty((len(starts) - 1, n_hashes), dtype=np.uint32)
    factors = _multipliers(n_hashes)
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + HASH_STEP, side="right")) - 1)
        part = values[starts[first] : starts[last]]
        at = starts[first:last] - starts[first]
        for k in range(n_hashes):
            out[first:last, k] = np.minimum.reduceat(((part * factors[k]) >> U64(32)).astype(np.uint32), at)
        first = last
    return out


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(minima), bands), dtype=U64)
    for k in range(bands):
        h = np.full(len(minima), U64(k + 1))
        for r in range(rows):
            h = mix64(h * U64(0x100000001B3) + minima[:, k * rows + r].astype(U64))
        out[:, k] = h
    return out.view(np.int64)


def _signer(bands: int, rows: int, size: int):
    names = ["doc_id", "r1", "r2", "chars", "key", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
            for first, last in steps(texts):
                hashes, bounds = words(texts[first:last])
                keys = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                values, starts = shingles(hashes, bounds, size)
                full = np.flatnonzero(np.diff(starts))
                lists: list = [[] for _ in range(last - first)]
                if len(full):
                    edge = np.append(starts[:-1][full], starts[-1])
                    for i, row in zip(full, band_hashes(min_hashes(values, edge, bands * rows), bands, rows), strict=True):
                        lists[i] = row
                told = [batch.column(name).slice(first, last - first) for name in names[:4]]
                yield pa.RecordBatch.from_arrays([*told, pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=names)

    return sign


class _Sets:
    """Shingle sets of a block as rows of sorted, distinct hashes."""

    def __init__(self, texts: list[str], size: int) -> None:
        rows = []
        for first, last in steps(texts):
            values, starts = shingles(*words(texts[first:last]), size)
            rows += [np.unique(values[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.values = np.concatenate(rows) if rows else np.zeros(0, dtype=U64)
        self.rows = np.repeat(np.arange(len(rows)), self.sizes)


#: Cells of a block's membership matrix that are multiplied at a time.
MATRIX_CELLS = 4 << 20


def common_counts(a: _Sets, b: _Sets) -> np.ndarray:
    """For each row of `a` and of `b` the number of shingles that both hold."""
    out = np.zeros((len(a.sizes), len(b.sizes)), dtype=np.float32)
    ids, place = np.unique(np.concatenate([a.values, b.values]), return_inverse=True)
    left, right = place[: len(a.values)], place[len(a.values) :]
    shared = (np.bincount(left, minlength=len(ids)) > 0) & (np.bincount(right, minlength=len(ids)) > 0)
    if a is b:
        shared = np.bincount(left, minlength=len(ids)) > 1
    column = np.cumsum(shared) - 1
    n = int(shared.sum())
    width = max(1, MATRIX_CELLS // max(len(a.sizes), len(b.sizes), 1))
    keep_a, keep_b = shared[left], shared[right]
    col_a, row_a, col_b, row_b = column[left[keep_a]], a.rows[keep_a], column[right[keep_b]], b.rows[keep_b]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    col_a, row_a, col_b, row_b = col_a[order_a], row_a[order_a], col_b[order_b], row_b[order_b]
    for low in range(0, n, width):
        high = min(n, low + width)
        parts = []
        for col, row, height in ((col_a, row_a, len(a.sizes)), (col_b, row_b, len(b.sizes))):
            i, j = np.searchsorted(col, [low, high])
            matrix = np.zeros((height, high - low), dtype=np.float32)
            matrix[row[i:j], col[i:j] - low] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    if a is b:
        np.fill_diagonal(out, a.sizes)
    return out


def similar(a: _Sets, b: _Sets, threshold: float) -> np.ndarray:
    """Which rows of `a` and `b` have a Jaccard similarity of at least `threshold`."""
    both = common_counts(a, b).astype(np.float64)
    union = a.sizes[:, None] + b.sizes[None, :] - both
    return (both >= threshold * union - 1e-9) & (union > 0)


def _components(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component under a symmetric relation."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        if (new == root).all():
            return root
        root = new


@dataclass
class _Block:
    """Texts of a unit that are compared together, with the band hashes of a bucket's texts."""

    keys: list = field(default_factory=list)
    copies: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    bands: list = field(default_factory=list)

    def add(self, key: bytes, copies: int, text: str | None, bands: list | None) -> None:
        self.keys.append(key)
        self.copies.append(copies)
        self.texts.append((text or "").lower())
        self.bands.append(bands)


def _earlier(a: _Block, b: _Block, bucket: int) -> np.ndarray:
    """Which pairs of a bucket's texts share a band before this one; they are compared there."""
    left, right = np.array(a.bands, dtype=np.int64), np.array(b.bands, dtype=np.int64)
    place = int(np.flatnonzero(left[0] == bucket)[0])
    met = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(place):
        met |= left[:, k][:, None] == right[:, k][None, :]
    return met


def _links_of(first: _Block, second: _Block, bucket: int | None, size: int, threshold: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, the first row of each one's component, and how many rows each is linked to."""
    a = _Sets(first.texts, size)
    copies = np.array(first.copies, dtype=np.int64)
    alone = not second.keys
    other = first if alone else second
    linked = similar(a, a if alone else _Sets(second.texts, size), threshold)
    if bucket is not None:
        linked &= ~_earlier(first, other, bucket)
    if alone:
        np.fill_diagonal(linked, False)
        return first.keys, _components(linked), linked @ copies
    n, both = len(first.keys), len(first.keys) + len(second.keys)
    whole = np.zeros((both, both), dtype=bool)
    whole[:n, n:], whole[n:, :n] = linked, linked.T
    counts = [linked @ np.array(second.copies, dtype=np.int64), linked.T @ copies]
    return first.keys + second.keys, _components(whole), np.concatenate(counts)


#: Rows of results that a task hands over at a time.
OUT_ROWS = 10_000


def _verifier(size: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"key": [], "root": [], "n": []}
        now, bucket, blocks = None, None, (_Block(), _Block())

        def close() -> None:
            if now is None or not blocks[0].keys or (now[1] != now[2] and not blocks[1].keys):
                return  # a block may have got no text by its hash
            keys, roots, counts = _links_of(*blocks, bucket, size, threshold)
            for i in np.flatnonzero(counts):
                out["key"].append(keys[i])
                out["root"].append(keys[roots[i]])
                out["n"].append(int(counts[i]))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.binary()), ("root", pa.binary()), ("n", pa.int64())]))
            for column in out.values():
                column.clear()
            return made

        names = ("unit", "low", "high", "bucket", "side", "key", "copies", "text", "bands")
        for batch in batches:
            rows = zip(*[batch.column(x).to_pylist() for x in names], strict=True)
            for unit, low, high, of, side, key, copies, text, bands in rows:
                if (unit, low, high) != now:
                    close()
                    now, bucket, blocks = (unit, low, high), of, (_Block(), _Block())
                    if len(out["key"]) > OUT_ROWS:
                        yield batch_of()
                blocks[side].add(key, copies, text, bands)
        close()
        yield batch_of()

    return verify


def _units(classes: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """(unit, bucket, blocks, key): the texts that are compared with each other, in how many blocks.

    Buckets are joined up to components as stars. A small component, or one whose texts mostly share buckets anyway, is
    one unit: each text travels once for each of its blocks. A component that chance has strung together from many
    buckets would cost the square of its size, so its buckets are the units, and a pair is compared in the first bucket
    that holds both. The cheaper way is taken, by the numbers of pairs.
    """
    def blocks(n: Column, chars: Column) -> Column:
        return F.least(n, F.greatest(F.ceil(n / block_rows), F.ceil(chars / block_chars))).cast("int")

    # A bucket's least key and its counts are enough to make a star; a band's number is part of its hash.
    keyed = classes.select("key", "chars", F.explode("bands").alias("hash"))
    buckets = keyed.groupBy("hash").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    buckets = written(buckets.where("n > 1"), "buckets")
    stars = keyed.select("key", "hash").join(buckets.select("hash", "least"), "hash")
    groups = connected(stars.select(F.col("key").alias("a"), F.col("least").alias("b")))
    sizes = groups.join(classes.select(F.col("key").alias("node"), "chars"), "node")
    sizes = sizes.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    rooted = buckets.join(groups, F.col("least") == F.col("node")).select("hash", "n", "chars", "root")
    pairs = rooted.groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    one = (F.col("n") <= block_rows) | (F.col("n") * F.col("n") <= F.col("pairs"))
    sizes = sizes.join(pairs, "root").select("root", one.alias("one"), blocks(F.col("n"), F.col("chars")).alias("blocks"))
    sizes = written(sizes, "components")
    whole = groups.join(sizes.where("one").select("root", "blocks"), "root")
    whole = whole.select(F.col("root").alias("unit"), F.lit(None).cast("long").alias("bucket"), "blocks", F.col("node").alias("key"))
    loose = rooted.join(sizes.where("NOT one").select("root"), "root")
    loose = written(loose.select("hash", blocks(F.col("n"), F.col("chars")).alias("blocks")), "loose-buckets")
    parts = keyed.select("key", "hash").join(loose, "hash")
    return whole.unionByName(parts.select(F.unhex(F.lpad(F.hex("hash"), 16, "0")).alias("unit"), F.col("hash").alias("bucket"), "blocks", "key"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    block_rows: int = BLOCK_ROWS,
    block_chars: int = BLOCK_CHARS,
    carry: Sequence[str] = (),
    representatives_only: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, text_class, class_id and n_links.

    Texts are compared by their sets of `size` successive words (lower-cased, split at white space; a shorter text is
    one n-gram). `text_class` is the smallest id with the same words, `class_id` the smallest id that is reached over
    links of similarity `threshold` or more, and `n_links` counts the other rows that the row is linked to, copies
    included. Bands collide for a pair at the threshold with `target_recall`; the collisions form candidate groups
    (as stars around one text, never as all pairs), inside which full n-gram sets are compared block by block, by
    component or by bucket, whichever has fewer pairs (see _units); a block's comparisons stay in one task, and only
    counts and roots by text leave it.

    With `representatives_only` the result is instead one row of each class, the one with the smallest id, with the
    id, the text and the columns `carry`; of repeated rows one stays.

    Defined cases: a null text counts as empty; texts without words are copies of each other; rows that repeat an id
    are rows like others, and rows with null ids are compared too (a class with null ids alone has class null); an
    empty table gives no rows; further columns are ignored; texts of any length are compared whole.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(threshold, target_recall)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{name}`").alias(f"carried_{i}") for i, name in enumerate(carry)],
    )
    # Ids may repeat or be null, so a hash of id and text finds a row again.
    carried = [f"carried_{i}" for i in range(len(carry))]
    rows_of = texts.select("doc_id", _row(3).alias("r1"), _row(5).alias("r2"), "text", *carried)
    texts = rows_of.drop(*carried)
    sized = texts.withColumn("chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    schema = "doc_id long, r1 long, r2 long, chars long, key binary, bands array<long>"
    signed = sized.mapInArrow(tidy(_signer(bands, rows, size)), schema)
    signed = written(signed, "signatures")
    # Classes of equal word sequences; a map-side aggregation leaves one row of a hot class for each task.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
    classes = signed.groupBy("key").agg(
        first, F.count("*").alias("copies"), F.max("chars").alias("chars"), F.first("bands").alias("bands")
    )
    classes = written(
        classes.select("key", F.col("first.doc_id").alias("rep"), "first.r1", "first.r2", "copies", "chars", "bands"), "classes"
    )
    members = _units(classes, block_rows, block_chars).join(classes.select("key", "r1", "r2", "copies", "bands"), "key")
    members = members.withColumn("bands", F.when(F.col("bucket").isNotNull(), F.col("bands")))
    told = texts.select("r1", "r2", "text").join(members, ["r1", "r2"])
    # Repeated rows would tell a text twice; the join has already brought them together.
    held = ("bucket", "key", "copies", "blocks", "bands", "text")
    told = told.groupBy("r1", "r2", "unit").agg(*[F.first(x).alias(x) for x in held])
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    told = told.select(
        "unit", "bucket", "key", "copies", "text", "bands", block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    dealt = told.select(
        "unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "bucket", "key", "copies", "text", "bands",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "unit", "low", "high").sortWithinPartitions("unit", "low", "high")
    found = written(dealt.mapInArrow(tidy(_verifier(size, threshold)), "key binary, root binary, n long"), "found")
    if not representatives_only:
        return _named(signed, classes, found)
    best = _rooted(classes, found).groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "r1", "r2")).alias("best"))
    kept = rows_of.join(best.select("best.r1", "best.r2"), ["r1", "r2"]).dropDuplicates(["r1", "r2"])
    named = [F.col(f"carried_{i}").alias(name) for i, name in enumerate(carry)]
    return kept.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), *named)


def _row(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _rooted(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes with the root of their component."""
    roots = connected(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "root")
    return classes.drop("bands", "chars").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _named(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the smallest ids of their text and of their component, and their links."""
    counts = found.groupBy("key").agg(F.sum("n").alias("linked"))
    named = written(_rooted(classes, found).join(counts, "key", "left").select("key", "rep", "copies", "root", "linked"), "named")
    # A class of many texts is a hot root, so the ids are dealt out by themselves.
    ids = dealt_anew(named.groupBy("root").agg(F.min("rep").alias("class_id")), "root")
    named = named.join(ids, "root").select(
        "key", F.col("rep").alias("text_class"), "class_id",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "text_class", "class_id", "n_links")
