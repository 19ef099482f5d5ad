import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from evidentia.llm.packing import CapacityTree, best_fit_decreasing, close_gaps, default_tokenizer, encoder, pack

TEXTS = [
    "Hello there, it's a test's TEST don't we've 12 3.5!! ***",
    "",
    None,
    "naïve café ÉÉ ß ª º ² x y\x85z\tq\x0bw",
    "Σίσυφος ΟΔΟΣ 中文字符 é \x1c a\x1db",
    "a <|endoftext|> b <|startoftext|>",
    "word " * 9000,
]


def test_word_cache_gives_the_tokenizers_ids():
    plain = Tokenizer.from_file(default_tokenizer())
    ours = encoder(default_tokenizer())
    for text in TEXTS:
        assert ours.encode(text or "").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_capacity_tree_finds_the_tightest_window():
    tree, open_windows = CapacityTree(64), []
    rng = random.Random(1)
    for k in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(1, 63)
            tree.add(room, k)
            open_windows.append(room)
        else:
            need = rng.randint(1, 63)
            fits = [r for r in open_windows if r >= need]
            found = tree.take(need)
            assert (found is None) == (not fits)
            if fits:
                assert found[1] == min(fits)
                open_windows.remove(found[1])


@pytest.mark.parametrize("seed", range(20))
def test_every_token_lies_in_one_piece_and_nothing_is_padded(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 60, 700, 5000]) + rng.randint(0, 50) for _ in range(rng.randint(0, 60))]
    windows = close_gaps(best_fit_decreasing(lengths, 1024), 1024)
    seen = defaultdict(list)
    for pieces in windows:
        size = sum(p[2] for p in pieces)
        assert size == 1024 or size & (size - 1) == 0
        for doc, start, length in pieces:
            seen[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_pack_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS length")
    out = pack(docs.repartition(2), window=256, with_ids=True).collect()
    plain = Tokenizer.from_file(default_tokenizer())
    per_sequence = defaultdict(list)
    got = defaultdict(int)
    for r in out:
        per_sequence[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    want = defaultdict(int)
    for doc, text in rows:
        want[doc] += len(plain.encode(text or "", add_special_tokens=False).ids) + 1
    assert got == want
    whole = sorted((r.start, r.ids) for r in out if r.doc_id == 6)
    assert sum((x[1] for x in whole), []) == plain.encode(TEXTS[6], add_special_tokens=False).ids + [2]
    assert pack(docs.limit(0)).count() == 0
