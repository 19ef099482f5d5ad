"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, written
from .common import U64, code_points, hash_runs, held_out, is_space, mix64, pick, steps, tidy

#: The most labelled rows that are learned from; they are the first by a hash of their id.
SAMPLE_ROWS = 20_000
DIMENSIONS = 64
NONZERO = 4
WORD_BUCKETS = 8192
SHAPE_BUCKETS = 512
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
HIDDEN = 32
THRESHOLD = 0.7
FIT_TASKS = 8

_KINDS: list[np.ndarray] = []
_SPACE_KIND, _LETTER, _UPPER, _DIGIT, _SIGN = range(5)


def _kind_table() -> np.ndarray:
    """The kind of each code point; built once per worker."""
    if not _KINDS:
        table = np.full(0x110000, _SIGN, dtype=np.uint8)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isalpha():
                table[code] = _UPPER if sign.isupper() else _LETTER
            elif sign.isdigit():
                table[code] = _DIGIT
        table[:0x3001][is_space(np.arange(0x3001, dtype=np.uint32))] = _SPACE_KIND
        _KINDS.append(table)
    return _KINDS[0]


@dataclass
class Tokens:
    """Runs of letters, digits or other signs of a batch of texts."""

    word: np.ndarray  # bucket of the case-folded run
    shape: np.ndarray  # bucket of its form
    bounds: np.ndarray  # where each text's tokens begin, plus the end


def tokens(texts: list[str | None]) -> Tokens:
    """Tokens of the texts: a word bucket, and a shape bucket that knows case, length, signs and repetition."""
    codes, at = code_points(texts)
    kinds = _kind_table()[codes]
    group = np.where(kinds == _UPPER, _LETTER, kinds)
    edge = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
    begin, end = edge[:-1], edge[1:]
    real = group[begin] != _SPACE_KIND
    begin, end = begin[real], end[real]
    kind, length = group[begin], end - begin
    upper = np.concatenate(([0], np.cumsum(kinds == _UPPER)))
    n_upper = upper[end] - upper[begin]
    # Case folding by the usual offset of 32 covers the Latin letters; other capitals keep their own hash.
    folded = np.where((kinds == _UPPER) & (codes < 0xDF), codes + 32, codes)
    hashes = hash_runs(folded, begin, end)
    case = np.where(n_upper == 0, 0, np.where((n_upper == length) & (length > 1), 2, 1))
    form = kind.astype(np.int64) * 1000 + case * 100 + np.minimum(length, 12)
    form = form.astype(U64)
    signs = kind == _SIGN
    form[signs] = hashes[signs]
    bounds = np.searchsorted(begin, at)
    # A letter run that equals the one before it in its text has a shape of its own.
    letters = np.flatnonzero(kind == _LETTER)
    again = np.zeros(len(begin), dtype=bool)
    if len(letters) > 1:
        text_of = np.searchsorted(bounds, letters, side="right")
        same = (hashes[letters[1:]] == hashes[letters[:-1]]) & (text_of[1:] == text_of[:-1])
        again[letters[1:][same]] = True
    form[again] = U64(7)
    word = (hashes >> U64(11)).astype(np.int64) % WORD_BUCKETS
    shape = WORD_BUCKETS + (mix64(form + U64(1)) >> U64(9)).astype(np.int64) % SHAPE_BUCKETS
    return Tokens(word, shape, bounds)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few nonzero entries of each bucket's index vector, by a rule."""
    seeds = mix64(np.arange(BUCKETS * NONZERO, dtype=U64) + U64(1)).reshape(BUCKETS, NONZERO)
    places = (seeds >> U64(7)).astype(np.int64) % DIMENSIONS
    signs = np.where((seeds >> U64(40)) & U64(1), 1.0, -1.0)
    return places, signs


def context_sums(texts: list[str | None]) -> np.ndarray:
    """For each bucket the sum of the index vectors of its neighbours: the words beside it and their shapes."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    for first, last in steps(texts):
        t = tokens(texts[first:last])
        if not len(t.word):
            continue
        joined = np.ones(len(t.word) - 1, dtype=bool)
        joined[t.bounds[1:-1][(t.bounds[1:-1] > 0) & (t.bounds[1:-1] < len(t.word))] - 1] = False
        left, right = np.flatnonzero(joined), np.flatnonzero(joined) + 1
        pairs = [(t.word[left], t.word[right]), (t.word[left], t.shape[right]), (t.shape[left], t.shape[right])]
        pairs += [(b, a) for a, b in pairs] + [(t.word, t.shape), (t.shape, t.word)]
        for centre, neighbour in pairs:
            cell = (centre[:, None] * DIMENSIONS + places[neighbour]).ravel()
            sums += np.bincount(cell, weights=signs[neighbour].ravel(), minlength=len(sums))
    return sums.reshape(BUCKETS, DIMENSIONS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors, with the bucket's own index vector so that unseen contexts still tell buckets apart."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    out = np.where(norm > 0, sums / np.maximum(norm, 1e-12), 0) + own / np.sqrt(NONZERO)
    return out.astype(np.float32)


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Mean of the word rows and mean of the shape rows of `table` (a row per bucket) for each text."""
    out = np.zeros((len(texts), 2 * table.shape[1]), dtype=np.float32)
    width = table.shape[1]
    for first, last in steps(texts):
        t = tokens(texts[first:last])
        n = np.diff(t.bounds)
        full = np.flatnonzero(n)
        if len(full):
            starts = t.bounds[:-1][full]
            for k, ids in enumerate((t.word, t.shape)):
                sums = np.add.reduceat(table[ids], starts, axis=0)
                out[first + full, k * width : (k + 1) * width] = sums / n[full][:, None]
    return out


@dataclass
class Network:
    """Two layers; the first is folded into a table by bucket, so that scoring never builds word vectors."""

    table: np.ndarray  # bucket x (hidden of the word part), float32
    shape_table: np.ndarray  # bucket x (hidden of the shape part), float32
    bias: np.ndarray
    output: np.ndarray
    output_bias: float
    temperature: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, last in steps(texts):
            t = tokens(texts[first:last])
            n = np.diff(t.bounds)
            layer = np.tile(self.bias, (last - first, 1))
            full = np.flatnonzero(n)
            if len(full):
                starts = t.bounds[:-1][full]
                both = self.table[t.word] + self.shape_table[t.shape - WORD_BUCKETS]
                layer[full] += np.add.reduceat(both, starts, axis=0) / n[full][:, None]
            logit = np.tanh(layer) @ self.output + self.output_bias
            out[first:last] = 1 / (1 + np.exp(-np.clip(logit / self.temperature, -60, 60)))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _loss(logit: np.ndarray, y: np.ndarray, temperature: float) -> float:
    p = np.clip(_sigmoid(logit / temperature), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass
class Layers:
    """The two layers as they are trained, over pooled rows that are centred and scaled."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    output: np.ndarray
    output_bias: float
    temperature: float

    def folded(self, vectors: np.ndarray) -> Network:
        inner = self.inner / self.scale[:, None]
        wide = vectors.astype(np.float64)
        return Network(
            (wide @ inner[:DIMENSIONS]).astype(np.float32), (wide[WORD_BUCKETS:] @ inner[DIMENSIONS:]).astype(np.float32),
            self.inner_bias - self.centre @ inner, self.output, self.output_bias, self.temperature,
        )


def fit_layers(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Layers:
    """Train on nine tenths of the rows with Adam, and choose the temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    n_test = len(x) // 10
    test, train = order[:n_test], order[n_test:]
    if not n_test:
        test = train
    centre, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    z = (x - centre) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            w1, b1, w2, b2 = params
            hidden = np.tanh(z[part] @ w1 + b1)
            error = (_sigmoid(hidden @ w2 + b2) - y[part]) / len(part)
            back = error[:, None] * w2 * (1 - hidden**2)
            grads = [z[part].T @ back + 1e-5 * w1, back.sum(axis=0), hidden.T @ error + 1e-5 * w2, error.sum(keepdims=True)]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                params[k] = params[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = params
    logit = np.tanh(z[test] @ w1 + b1) @ w2 + b2
    temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logit, y[test], t)))
    return Layers(centre, scale, w1, b1, w2, float(b2[0]), temperature)


def _constant(score: float) -> Network:
    logit = float(np.log(score / (1 - score)))
    return Network(np.zeros((BUCKETS, HIDDEN), np.float32), np.zeros((SHAPE_BUCKETS, HIDDEN), np.float32), np.zeros(HIDDEN), np.zeros(HIDDEN), logit, 1.0)


def _bucket_rows(sums: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    rows = pa.array([row.tobytes() for row in sums], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), rows], names=["bucket", "sums"])


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, DIMENSIONS))
    for batch in batches:
        total += context_sums(batch.column(0).to_pylist())
    met = np.flatnonzero(total.any(axis=1))
    yield _bucket_rows(total[met], met)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        sums = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, DIMENSIONS)
        for bucket, row in zip(batch.column(0).to_pylist(), sums, strict=True):
            held[bucket] = held[bucket] + row if bucket in held else row
    if held:
        yield _bucket_rows(np.stack(list(held.values())), np.array(list(held)))


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """The context sums of all texts (docs has the text alone).

    Each task gives a row for each bucket that it met, which are added up by bucket; the driver gets one row a bucket,
    however large the corpus is. The sums are whole numbers, so their order is nothing.
    """
    parts = docs.mapInArrow(tidy(_sum_contexts), "bucket int, sums binary")
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in parts.repartition("bucket").mapInArrow(tidy(_add), "bucket int, sums binary").collect():
        out[row["bucket"]] = np.frombuffer(row["sums"])
    return out


def _pool_rows(shared):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pooled(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1)], names=["x", "y"]
            )

    return pool


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network on the word vectors of all texts, fitted on at most `sample_rows` labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    known = pick(labels, {"doc_id": "long", "quality": "int"}).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = pick(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(
        F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("quality").alias("quality")
    )
    sample = written(sample.select("text", (F.col("quality") > 0).cast("double").alias("y")), "labelled")
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return _constant((counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2))
    sample = sample.coalesce(FIT_TASKS)
    vectors = word_vectors(corpus_contexts(pick(docs, {"text": "string"})))
    shared = spark.sparkContext.broadcast(vectors)
    rows = sample.mapInArrow(tidy(_pool_rows(shared)), "x binary, y double").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
    y = np.array([r["y"] for r in rows])
    order = np.lexsort((*x.T[:8], y))  # rows come in any order from the tasks
    return fit_layers(x[order], y[order]).folded(vectors)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for batch in batches:
            scores = network.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"]
            )

    return score


def score(docs: DataFrame, network: Network, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of `docs` (doc_id, text, ...) with its held_out and score; only the text decides."""
    spark = docs.sparkSession
    ship(spark)
    held = [F.col(f"`{name}`").alias(name) for name in keep]
    rows = docs.select(*held, held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("scored_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_scorer(spark.sparkContext.broadcast(network))), schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Quality of each whole text as a probability, and `predicted` = 1 from `threshold` on.

    Word vectors are sums of the sparse random index vectors of neighbouring words and word shapes, over all texts; a
    document is the mean of its vectors, which a two-layer network scores; the temperature makes held-back labels
    likeliest. The network is fitted on at most `sample_rows` labelled rows, none of them held out; every row of `docs`
    is scored.

    Defined cases: a null text counts as empty, and empty texts get the score of a document without words; of labels
    that repeat an id the lowest counts, of texts the greatest; null ids or labels teach nothing; without labels of
    both kinds every score is the smoothed share of label 1; an empty table gives no rows; further columns are
    ignored; texts of any length are read whole.
    """
    out = score(docs, fit(docs, labels, sample_rows))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
