"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import U64, code_points, held_out, mix64, pick, steps, tidy

GRAM = 3
#: An n-gram belongs to a language if it makes up this share of the language's n-grams; at most 1 / share can.
MIN_SHARE = 5e-5
#: ... and at least this part of its largest share in any language, so that stray foreign passages teach nothing.
MIN_OF_LARGEST = 0.02
HASHES = 4
BITS_PER_GRAM = 12
UNDETERMINED = "und"
COUNTS = "lang string, gram long, n long"
COMPACT = 1 << 20

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed character trigrams of the lower-cased texts, and where each text's trigrams begin (plus the end).

    Everything but a letter counts as one boundary sign; a trigram needs a letter in its middle, so words are padded
    by one boundary sign on either side and trigrams never join two words.
    """
    codes, bounds = code_points([" " + t.lower() if t else t for t in texts])
    signs = np.where(letter_table()[codes], codes, 0).astype(np.int64)
    middle = np.flatnonzero(signs[1:-1] > 0) + 1
    packed = (signs[middle - 1] << 42) | (signs[middle] << 21) | signs[middle + 1]
    return packed, np.searchsorted(middle, bounds)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts by language for one task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([n for _, n in held[lang]])).astype(np.int64)

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        langs, texts = [langs[i] for i in order], [texts[i] for i in order]
        for first, last in steps(texts):
            packed, bounds = grams(texts[first:last])
            for lang in dict.fromkeys(langs[first:last]):
                own = [i for i in range(first, last) if langs[i] == lang]
                part = packed[bounds[own[0] - first] : bounds[own[-1] - first + 1]]
                if len(part):
                    held.setdefault(lang, []).append(np.unique(part, return_counts=True))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
                    if size[lang] > COMPACT:
                        held[lang] = [merged(lang)]
                        size[lang] = 0
    for lang in held:
        keys, counts = merged(lang)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys, "n": counts})


@dataclass
class Filters:
    """One Bloom filter per language, stored by position: a row holds a bit for each language."""

    languages: list[str]
    masks: np.ndarray  # positions x words of 64 languages
    false_positive: np.ndarray  # by language

    def positions(self, packed: np.ndarray) -> Iterator[np.ndarray]:
        first = mix64(packed.astype(U64))
        second = mix64(first ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)
        for k in range(HASHES):
            yield ((first + U64(k) * second) >> U64(20)).astype(np.int64) & (len(self.masks) - 1)

    def languages_of(self, packed: np.ndarray) -> np.ndarray:
        """Bit masks of all languages whose filter holds the n-gram."""
        out = None
        for at in self.positions(packed):
            out = self.masks[at] if out is None else out & self.masks[at]
        return out

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of n-grams, and by language the corrected share of n-grams that it holds."""
        packed, bounds = grams(texts)
        n = np.diff(bounds)
        found = self.languages_of(packed)
        hits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = ((found[:, k >> 6] >> U64(k & 63)) & U64(1)).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(bit)))
            hits[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
        expected = n[:, None] * self.false_positive
        return n, np.maximum(hits - expected, 0) / (1 - self.false_positive) / np.maximum(n, 1)[:, None]


def build_filters(learned: dict[str, np.ndarray]) -> Filters:
    """Filters from the n-grams of each language."""
    languages = sorted(learned)
    most = max([len(v) for v in learned.values()], default=1)
    size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM))))
    masks = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=U64)
    out = Filters(languages, masks, np.zeros(len(languages)))
    for k, lang in enumerate(languages):
        for at in out.positions(learned[lang]):
            np.bitwise_or.at(masks[:, k >> 6], at, U64(1) << U64(k & 63))
        share = ((masks[:, k >> 6] >> U64(k & 63)) & U64(1)).mean()
        out.false_positive[k] = share**HASHES
    return out


def learn(docs: DataFrame, min_share: float = MIN_SHARE, min_of_largest: float = MIN_OF_LARGEST) -> Filters:
    """Filters from all rows of `docs` (lang, text). The driver gets at most 1 / min_share n-grams a language."""
    ship(docs.sparkSession)
    rows = pick(docs, {"lang": "string", "text": "string"}).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(tidy(_count_grams), COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    shares = shares.where(F.col("share") >= min_share)
    largest = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("largest", largest).where(F.col("share") >= min_of_largest * F.col("largest"))
    learned = kept.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()
    return build_filters({r["lang"]: np.array(r["grams"], dtype=np.int64) for r in learned})


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        names = np.array(filters.languages or [UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            for first, last in steps(texts) if filters.languages else ():
                n, share = filters.evidence(texts[first:last])
                best = share.argmax(axis=1)
                total = share.sum(axis=1)
                top = share[np.arange(len(best)), best]
                pred[first:last] = np.where(n > 0, names[best], UNDETERMINED)
                score[first:last] = np.where(total > 0, top / np.where(total > 0, total, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(pred, pa.string()), pa.array(score)],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; only the text decides."""
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, {"doc_id": "long", "text": "string"}).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(tidy(_predictor(spark.sparkContext.broadcast(filters))), schema)


def language_id(
    docs: DataFrame, min_share: float = MIN_SHARE, min_of_largest: float = MIN_OF_LARGEST
) -> DataFrame:
    """Language of each whole text, learned from the rows of `docs` that are not held out and have a language.

    Counts of all character trigrams by language are aggregated over all learning rows; those with a sufficient share
    go into the language's Bloom filter. A lookup returns the languages that hold an n-gram as one bit mask. The
    hits of a language, less those that its filter's false positives explain, decide; `score` is the winner's part of
    all corrected hits. Between equal languages the first by name wins.

    Defined cases: a null or empty text, or one without letters, is `und` with score 0; a text none of whose n-grams
    is known gets the first language with score 0; without any learning row all are `und`; null ids count as not
    held out; repeated rows are scored alike and each counts in learning; an empty table gives no rows; further
    columns are ignored; texts of any length are read whole.
    """
    taught = docs.where(~held_out(F.col("doc_id")))
    return predict(docs, learn(taught, min_share, min_of_largest))
