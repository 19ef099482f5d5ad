"""Helpers that the operators share: column handling, and vectorised work on code points.

The numpy helpers take a batch of texts as one array of code points, so that the cost per
character is a few array passes and not a Python call per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Characters that one vectorised step looks at; a longer text makes a step of its own.
STEP_CHARS = 1 << 19
_BASE = U64(0x9E3779B97F4A7C15)
_POWERS = 4096


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, cast, and nothing else: further columns and clashing names cannot interfere."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a worker's batches; at the end the worker gives the memory back that its allocators keep for later."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, dtype=U64))


_POW = _powers(_POWERS, _BASE)


def steps(texts: Sequence[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with a line feed after each text, and the position where each text begins (plus the end)."""
    joined = "".join([(t or "") + "\n" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([(len(t) if t else 0) + 1 for t in texts], out=bounds[1:])
    return codes, bounds


def _space_table() -> np.ndarray:
    table = np.zeros(0x3002, dtype=bool)
    for code in range(0x3001):
        table[code] = chr(code).isspace()
    return table


_SPACE = _space_table()


def is_space(codes: np.ndarray) -> np.ndarray:
    """Unicode white space, as str.split sees it."""
    return _SPACE[np.minimum(codes, 0x3001)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; the last value must be false."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def hash_runs(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[begin:end] for each run; runs are disjoint and in order."""
    if not len(begin):
        return np.zeros(0, dtype=U64)
    length = end - begin
    inside = np.arange(int(length.sum()), dtype=np.int64)
    first = np.cumsum(length) - length
    place = inside - np.repeat(first, length)
    values = codes[np.repeat(begin, length) + place].astype(U64)
    values = (values + U64(0x51ED27)) * _BASE
    values ^= values >> U64(29)
    values *= _POW[place & (_POWERS - 1)]
    return mix64(np.add.reduceat(values, first) + length.astype(U64))


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and where each text's words begin (plus the end)."""
    codes, bounds = code_points(texts)
    begin, end = runs(~is_space(codes))
    return hash_runs(codes, begin, end), np.searchsorted(begin, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` successive words within each text; a text with fewer words is one shingle of all its words.

    Returns the hashes and where each text's shingles begin (plus the end). A text without words has none.
    """
    count = np.diff(bounds)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    starts = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=starts[1:])
    total = int(starts[-1])
    place = np.arange(total, dtype=np.int64) - np.repeat(starts[:-1], made) + np.repeat(bounds[:-1], made)
    stop = np.repeat(bounds[1:], made)
    out = np.zeros(total, dtype=U64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=U64)])
    for k in range(size):
        term = np.where(place + k < stop, padded[place + k], U64(0x5851F42D4C957F2D))
        out = (out + term) * U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return mix64(out), starts
