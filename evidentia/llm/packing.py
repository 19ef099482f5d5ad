"""Packing of token ids into training windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import ship
from .common import pick, tidy

WINDOW = 4096
END_ID = 2
#: Tokens that a task packs at a time; what it holds in memory is a small multiple of this.
BLOCK_TOKENS = 4 << 20
#: Entries of the word caches of one worker; beyond it they start anew.
CACHE_WORDS = 700_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

#: Texts with these need the tokenizer's own normaliser; in others lower-casing and splitting give the same pieces.
_OTHER = re.compile("[\\x1c-\\x1f\\u0130\\u0250-\\u200f\\u2028-\\U0010ffff]|<\\|startoftext\\|>|<\\|endoftext\\|>")


def _byte_signs() -> list[str]:
    """The sign that the byte-level pre-tokenizer writes for each byte: printable Latin-1 bytes stay, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


class _Words(dict):
    """White-space separated token -> number of its entry in the encoder's table."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        self[word] = number = self.encoder.new(word)
        return number


class Encoder:
    """Ids by a word-level tokenizer file, with a cache of the ids of words.

    The tokenizer's pre-tokenizer never joins what white space separates, so the ids of a text are those of its
    words one after the other; a text outside the plain range of characters is encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Fixed value: the pre-tokenizer's own pattern.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.merge = self.tokenizer.model.tokenize
        self.limit = cache_words
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = _Words(self), {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.begin, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.count = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def add(self, ids: list[int]) -> int:
        """The number of a new entry with these ids; entries are stored flat, not as Python objects."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), dtype=np.uint32)])
        if self.count == len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[self.count], self.size[self.count] = self.used, len(ids)
        self.used, self.count = self.used + len(ids), self.count + 1
        return self.count - 1

    def part(self, part: str) -> int:
        number = self.parts.get(part)
        if number is None:
            signs = part if part.isascii() and part.isprintable() else "".join([_BYTE_SIGNS[b] for b in part.encode()])
            number = self.parts[part] = self.add([token.id for token in self.merge(signs)])
        return number

    def new(self, word: str) -> int:
        """The number of a word's entry: that of its only part, or a new one with the ids of all its parts."""
        if word.isalpha():
            return self.part(word)
        numbers = [self.part(p) for p in self.pieces(word)]
        if len(numbers) == 1:
            return numbers[0]
        return self.add([i for n in numbers for i in self.flat[self.begin[n] : self.begin[n] + self.size[n]].tolist()])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if _OTHER.search(text):
            return self.whole(text)
        if len(self.words) + len(self.parts) > self.limit:
            self.clear()
        split = text.lower().split()
        at = np.fromiter(map(self.words.__getitem__, split), dtype=np.int64, count=len(split))
        size = self.size[at]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(self.begin[at] - first, size)
        return self.flat[place]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; its caches last as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest one that still holds a piece in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`, taken out, and its room."""
        node, count, leaves = need + self.leaves, self.count, self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.windows[room].pop(), room


Piece = tuple[int, int, int]  # document, start, length


def best_fit_decreasing(lengths: Sequence[int], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of pieces: full windows of overlong documents first, then the rests by best-fit decreasing."""
    out: list[list[Piece]] = []
    rests: list[tuple[int, int]] = []
    for doc, length in enumerate(lengths):
        full = length // window
        out += [[(doc, k * window, window)] for k in range(full)]
        if length % window:
            rests.append((length % window, doc))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree = CapacityTree(window)
    for length, doc in rests:
        found = tree.take(length)
        if found is None:
            at, room = len(out), window
            out.append([])
        else:
            at, room = found
        out[at].append((doc, lengths[doc] - length, length))
        if room > length:
            tree.add(room - length, at)
    return out


def close_gaps(windows: list[list[Piece]], window: int = WINDOW) -> list[list[Piece]]:
    """Windows without padding: the emptiest open windows are dealt out, in cuts, over the gaps of the fullest.

    What remains of the last open window becomes sequences whose lengths are powers of two, which need no padding.
    """
    filled = [sum(p[2] for p in w) for w in windows]
    out = [w for w, n in zip(windows, filled, strict=True) if n == window]
    left = sorted((n, i) for i, n in enumerate(filled) if n < window)
    low, high = 0, len(left) - 1
    pool: list[Piece] = []
    while low <= high:
        n, i = left[high]
        target, high = list(windows[i]), high - 1
        gap = window - n
        while gap and (pool or low <= high):
            if not pool:
                pool = list(reversed(windows[left[low][1]]))
                low += 1
            doc, start, length = pool.pop()
            used = min(length, gap)
            target.append((doc, start, used))
            if used < length:
                pool.append((doc, start + used, length - used))
            gap -= used
        if gap:
            pool = list(reversed(target))
            break
        out.append(target)
    rest = sum(p[2] for p in pool)
    size = 1 << (window.bit_length() - 1)
    while rest:
        while size > rest:
            size >>= 1
        target, gap = [], size
        while gap:
            doc, start, length = pool.pop()
            used = min(length, gap)
            target.append((doc, start, used))
            if used < length:
                pool.append((doc, start + used, length - used))
            gap -= used
        out.append(target)
        rest -= size
    return out


def _pack_block(docs: list, ids: list[np.ndarray], window: int, base: int, with_ids: bool) -> tuple[dict, int]:
    windows = close_gaps(best_fit_decreasing([len(x) for x in ids], window), window)
    rows: dict[str, list] = {name.split(" ")[0]: [] for name in PIECES.split(", ")}
    tokens = []
    for k, pieces in enumerate(windows):
        offset = 0
        for doc, start, length in pieces:
            cut = ids[doc][start : start + length]
            rows["doc_id"].append(docs[doc])
            rows["start"].append(start)
            rows["length"].append(length)
            rows["ids_crc32"].append(zlib.crc32(cut.astype("<u4", copy=False).tobytes()))
            rows["doc_tokens"].append(len(ids[doc]))
            rows["sequence_id"].append(base + k)
            rows["offset"].append(offset)
            offset += length
            if with_ids:
                tokens.append(cut.astype(np.int32))
    if with_ids:
        rows["ids"] = tokens
    return rows, base + len(windows)


def _packer(path: str, window: int, end_id: int, block_tokens: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        types = [pa.field(n.split(" ")[0], pa.int64()) for n in PIECES.split(", ")]
        schema = pa.schema(types + ([pa.field("ids", pa.list_(pa.int32()))] if with_ids else []))
        sequence = TaskContext.get().partitionId() << 40
        docs, ids, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                docs.append(doc)
                ids.append(one)
                held += len(one)
                if held >= block_tokens:
                    rows, sequence = _pack_block(docs, ids, window, sequence, with_ids)
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    docs, ids, held = [], [], 0
        if docs:
            rows, sequence = _pack_block(docs, ids, window, sequence, with_ids)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return pack


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """All documents as pieces of sequences of at most `window` tokens, without padding.

    A document is its token ids and then `end_id`. Each task packs its own rows in blocks of about `block_tokens`
    tokens, so no row moves between tasks and memory has a bound; a block costs at most one open window, which is cut
    into sequences of powers of two. Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves with `with_ids`. Sequence ids are unique, not dense.

    Defined cases: a null or empty text is the end id alone; null ids and rows that repeat an id are packed like any
    other row; a text of any length is encoded whole and cut; an empty table gives no rows; further columns are
    ignored. `tokenizer` is a path that every executor has.
    """
    ship(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    rows = pick(docs, {id_col: "long", text_col: "string"})
    return rows.mapInArrow(tidy(_packer(tokenizer or default_tokenizer(), window, end_id, block_tokens, with_ids)), schema)
