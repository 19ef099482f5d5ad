"""Removal of long passages that documents repeat: rolling hashes of all windows of words, counted, and merged to intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import dealt_anew
from ..session import ship, written
from .common import U64, hash_runs, mix64, pick, runs, tidy

#: Words of a window, and of the shorter windows one of which is its anchor.
WINDOW = 50
ANCHOR = 16
#: The id that a null id counts as.
LAST = (1 << 63) - 1
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes and words that are looked at together, and bytes from which a word is hashed by itself.
STEP_BYTES, STEP_WORDS, LONG_WORD = 1 << 20, 1 << 18, 1 << 16

#: Bits of the map that tells most texts apart that a join need not move: 2048 rows of 4 KB, whatever the input.
MAP_BITS, PART_BITS = 26, 15

BLOCKS = "at long, key long, start int, n int, anchor long, first long, last long"
WINDOWS = "at long, id long, anchor long, place int, hash long"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


class Words:
    """The words of a few texts: their bytes with a line feed after each text, where words begin and end, and where the
    words of each text begin."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"".join([t + b"\n" for t in texts])
        self.data = np.frombuffer(joined, dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.begin, self.end = runs(~_is_space(self.data))
        self.bounds = np.searchsorted(self.begin, bounds)

    def hashes(self) -> np.ndarray:
        out, i = np.zeros(len(self.begin), dtype=U64), 0
        for j in np.flatnonzero(self.end - self.begin > LONG_WORD):
            self._some(out, i, j)
            digest = hashlib.blake2b(self.data[self.begin[j] : self.end[j]].tobytes(), digest_size=8).digest()
            out[j], i = U64(int.from_bytes(digest, "little")), j + 1
        self._some(out, i, len(out))
        return out

    def _some(self, out: np.ndarray, first: int, last: int) -> None:
        while first < last:
            stop = max(first + 1, min(last, int(np.searchsorted(self.begin, self.begin[first] + STEP_BYTES))))
            out[first:stop] = hash_runs(self.data, self.begin[first:stop], self.end[first:stop])
            first = stop


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `size` successive words, modulo 2**64, then mixed."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=U64)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, dtype=U64), np.full(n - 1, _BASE, dtype=U64))))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, dtype=U64), np.full(n - size, _INVERSE, dtype=U64))))
    total = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(hashes * power, dtype=U64)))
    return mix64((total[size:] - total[:-size]) * back)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def blocks(words: Words, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of successive windows of a text with the same anchor: text, first window, number, anchor, and the hashes of the
    first and the last window. An anchor is the least hash of a window's shorter windows, so equal windows have equal ones.
    A run holds so few windows that its first and last cover all its words: two runs of the same hashes are the same words.
    """
    hashes, longest = words.hashes(), size - anchor + 1
    text_of = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    found = []
    for low in range(0, max(len(hashes) - size + 1, 0), STEP_WORDS):
        own = hashes[low : low + STEP_WORDS + size - 1]
        window, chosen, text = rolling(own, size), least(rolling(own, anchor), longest), text_of[low : low + len(own)]
        n = len(window)
        whole = text[:n] == text[size - 1 : size - 1 + n]
        same = np.zeros(n, dtype=bool)
        same[1:] = (chosen[1:] == chosen[:-1]) & whole[:-1] & (text[1:n] == text[: n - 1])
        place = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        starts = np.flatnonzero(whole & (place % longest == 0))
        cut = np.flatnonzero(~whole | (place % longest == 0))
        ends = np.append(cut, n)[np.searchsorted(cut, starts, side="right")]
        owner = text[starts]
        found.append((owner, starts + low - words.bounds[owner], ends - starts, chosen[starts], window[starts], window[ends - 1]))
    if not found:
        return tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, np.int64, U64, U64, U64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[slice, Words]]:
    """Ranges of rows whose texts hold about STEP_BYTES together, with their words; a longer text is a piece of its own."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text or b"") > STEP_BYTES:
            yield slice(first, i), Words([t or b"" for t in texts[first:i]])
            first, held = i, 0
        held += len(text or b"")
    if first < len(texts):
        yield slice(first, len(texts)), Words([t or b"" for t in texts[first:]])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _blocks(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, words in _pieces(batch):
                owner, start, n, chosen, first, last = blocks(words, size, anchor)
                if len(owner):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[rows][owner]), pa.array(key[rows][owner]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *map(_signed, (chosen, first, last))],
                        names=["at", "key", "start", "n", "anchor", "first", "last"])

    return tidy(run)


def _windows(size: int):
    """The windows of the blocks that each row asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            wanted = batch.column(1)
            bounds = wanted.offsets.to_numpy()
            asked = wanted.values  # the child without the rows of a slice's other parts is cut by the bounds
            start, n, block, chosen = (asked.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for rows, words in _pieces(batch):
                hashes = words.hashes()
                for i in range(rows.start, rows.stop):
                    base = words.bounds[i - rows.start]
                    some = np.arange(bounds[i], bounds[i + 1])
                    if not len(some):
                        continue
                    own = [rolling(hashes[base + start[j] : base + start[j] + n[j] + size - 1], size) for j in some]
                    each = n[some]
                    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), at[i])), *[pa.array(np.repeat(x[some], each)) for x in (block, chosen)], pa.array(place.astype(np.int32)), _signed(np.concatenate(own))],
                        names=["at", "id", "anchor", "place", "hash"])

    return tidy(run)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the words of its intervals."""
    for batch in batches:
        begins, ends = batch.column(2), batch.column(3)
        for rows, words in _pieces(batch):
            count = np.diff(words.bounds)
            change = np.zeros(len(words.begin) + 1, dtype=np.int32)
            for values, step in ((begins, 1), (ends, -1)):
                part = values.slice(rows.start, rows.stop - rows.start)
                held = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                np.add.at(change, part.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.bounds[:-1], held), step)
            kept = np.cumsum(change[:-1]) == 0
            # The bytes of the words that stay, each with the one byte after it, which becomes a space.
            edge = np.zeros(len(words.data) + 1, dtype=np.int8)
            edge[words.begin[kept]] += 1
            edge[words.end[kept] + 1] -= 1
            data = words.data.copy()
            data[words.end[kept]] = 0x20
            taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
            left = data[taken]
            sizes = np.concatenate(([0], np.cumsum((words.end - words.begin + 1)[kept])))
            word_at = np.concatenate(([0], np.cumsum(kept)))[words.bounds]
            cut = sizes[word_at]
            digests = [hashlib.sha256(left[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(count), pa.array(count - np.diff(word_at)), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, at, key, text): rows of one id and text share at and key, and with them all that is found out."""
    rows = pick(docs, {id_col: "long", text_col: "string"}).toDF("doc_id", "text")
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.xxhash64("text").alias("key"), "text")


def marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`texts` with `maybe`: false where (at, key) is surely not among `wanted`, so that the text need not be moved.

    A hash of the key is looked up in a bit map of 2**MAP_BITS bits, which is broadcast in parts. More keys fill the map and
    let more texts through, up to all of them; the join that follows decides.
    """
    bit = F.pmod(F.xxhash64("at", "key"), F.lit(1 << MAP_BITS))
    part, place = F.shiftright(bit, PART_BITS), bit.bitwiseAND((1 << PART_BITS) - 1)
    parts = wanted.select(part.alias("_part"), place.alias("_place")).groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_map"))
    placed = texts.withColumns({"_part": part, "_place": place}).join(F.broadcast(parts), "_part", "left")
    byte = F.conv(F.hex(F.expr("substring(_map, int(_place div 8) + 1, 1)")), 16, 10).cast("int")
    return placed.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_place", "_map")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(at, key, begin, end): the maximal intervals of words that windows cover which start in a document of a smaller id too.

    Every window is hashed and every window is judged, but runs of windows with one anchor are counted as one row (about a
    row for each 18 words), and only where its anchor stands in two documents. A run that a smaller document holds is
    removed whole. Where an anchor stands in several different runs, their windows are counted one by one, once for each
    different run, for its smallest document.
    """
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    block = ["anchor", "first", "last", "n"]
    occurrences = written(texts.select("at", "key", "text").mapInArrow(_blocks(window, anchor), BLOCKS), "blocks")
    anchors = occurrences.groupBy("anchor").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most")
    shared = written(occurrences.join(dealt_anew(anchors.select("anchor"), "anchor"), "anchor"), "shared")
    distinct = written(shared.groupBy(*block).agg(F.min(F.struct("at", "key", "start")).alias("one"), F.max("at").alias("most")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    several = distinct.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    asked = distinct.join(dealt_anew(several.select("anchor"), "anchor"), "anchor")
    asked = asked.groupBy(F.col("one.at").alias("at"), F.col("one.key").alias("key")).agg(F.collect_list(F.struct("one.start", "n", "id", "anchor")).alias("asked"))
    asked = written(asked, "asked")
    single = marked(texts, asked).where("maybe").drop("maybe").join(dealt_anew(asked, "at", "key"), ["at", "key"]).select("at", "asked", "text")
    windows = written(single.mapInArrow(_windows(window), WINDOWS), "windows")
    smaller = windows.groupBy("anchor", "hash").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most").drop("most")
    some = windows.join(dealt_anew(smaller, "anchor", "hash"), ["anchor", "hash"]).where("least < at")
    # Any two windows of a run overlap, so those that go cover one interval.
    some = some.groupBy("id").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    judged = distinct.join(some, "id", "left").where("one.at < most OR low IS NOT NULL").select(*block, F.col("one.at").alias("least"), "low", "high")
    found = shared.join(dealt_anew(judged, *block), block).where("at > least OR low IS NOT NULL")
    later = F.col("at") > F.col("least")
    begin = F.col("start") + F.when(later, 0).otherwise(F.col("low"))
    end = F.col("start") + F.when(later, F.col("n") - 1).otherwise(F.col("high")) + window
    spans = found.select("at", "key", begin.alias("begin"), end.alias("end")).groupBy("at", "key", "begin").agg(F.max("end").alias("end"))
    own = Window.partitionBy("at", "key").orderBy("begin")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(own))
    return spans.groupBy("at", "key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """What is left of every document without its repeated windows: doc_id, n_words, n_removed, kept_sha256.

    Words are parted by ASCII white space. A word goes if a window of `window` words covers it whose words also start in a
    document with a smaller id; windows are judged on the input. Hashes of a window's words and of its anchor (64 bits
    each) stand for the words.

    Defined cases: a null or empty text has no words; texts of fewer than `window` words have no window and stay whole; a
    passage that one document repeats within itself stays; rows that repeat an id are no smaller than each other, so
    their common passages stay in all; a null id counts as the largest; texts of any length are cut in pieces for hashing;
    an empty table gives an empty result; further columns are ignored.
    """
    spans = repeated(docs, id_col, text_col, window, anchor)
    cuts = spans.groupBy("at", "key").agg(F.array_sort(F.collect_list("begin")).alias("begins"), F.array_sort(F.collect_list("end")).alias("ends"))
    cuts = written(cuts, "cuts")
    texts = marked(_texts(docs, id_col, text_col), cuts)
    none = F.lit(None).cast("array<int>")
    whole = texts.where("NOT maybe").select("doc_id", "text", none.alias("begins"), none.alias("ends"))
    cut = texts.where("maybe").join(dealt_anew(cuts, "at", "key"), ["at", "key"], "left").select("doc_id", "text", "begins", "ends")
    return whole.unionByName(cut).mapInArrow(tidy(_kept), KEPT)
