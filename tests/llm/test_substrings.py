import hashlib
import random

import numpy as np
import pytest

from evidentia.llm import substrings
from evidentia.llm.substrings import Words, blocks, remove_repeats, repeated, rolling


def brute(rows, size):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: substrings.LAST if i is None else i
    for i, words in cut:
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            first[w] = min(first.get(w, substrings.LAST), order(i))
    for i, words in cut:
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < order(i):
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(words) if k not in gone]
        yield i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "Ünï", "x y", "long" * 9, "w%d" % r.randint(0, 400)])
    space = lambda: r.choice([" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "])
    shared = [[word() for _ in range(r.randint(3, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(shared) if r.random() < 0.6 else [word() for _ in range(r.randint(1, 30))]
        rows.append((i * 3 % 47 if i % 11 else None, space() + "".join(w + space() for w in words)))
    rows += [(rows[5][0], rows[5][1]), (200, rows[7][1]), (201, rows[7][1]), (1, "a " * 90), (300, "a " * 70), (301, "b a " * 40), (302, None), (303, ""), (304, " \n "), (305, "a"), (306, "a " * 9)]
    return rows


@pytest.mark.parametrize(("seed", "size", "anchor"), [(1, 10, 4), (2, 10, 4), (3, 7, 7), (4, 12, 1)])
def test_equals_brute_force(spark, seed, size, anchor):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS anchor", "3 AS begins").repartition(4)
    got = sorted(map(tuple, remove_repeats(docs, window=size, anchor=anchor).collect()), key=str)
    want = sorted(brute(rows, size), key=str)
    assert got == want and 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_passages_of_fifty_words_and_long_texts(spark, monkeypatch):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    noise = lambda n: " ".join(f"n{r.random()}" for _ in range(n))
    rows = [(1, noise(40) + " " + passage + " " + noise(3)), (2, passage), (3, noise(5) + "\n" + passage), (4, passage.rsplit(" ", 1)[0]), (5, noise(30_000) + " " + passage + " " + "z" * 200_000), (6, "z" * 200_000 + " " + passage)]
    monkeypatch.setattr(substrings, "STEP_WORDS", 777)
    monkeypatch.setattr(substrings, "STEP_BYTES", 5000)
    got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: 0, 2: 50, 3: 50, 4: 0, 5: 50, 6: 50}
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(brute(rows, 50))


def test_intervals_are_maximal(spark):
    rows = [(1, " ".join(map(str, range(100)))), (2, "x " + " ".join(map(str, range(60))) + " y " + " ".join(map(str, range(40, 100))))]
    spans = repeated(spark.createDataFrame(rows, "doc_id long, text string")).select("at", "begin", "end").collect()
    assert sorted(map(tuple, spans)) == [(2, 1, 61), (2, 62, 122)]


def test_blocks_cover_every_window_once():
    words = Words([b"a b c d e f g h " * 40, b"", b"one two", b"x " * 300])
    hashes = words.hashes()
    owner, start, n, _, first, last = blocks(words, 10, 4)
    window = rolling(hashes, 10)
    seen = []
    for o, s, k, f, e in zip(owner, start, n, first, last, strict=True):
        base = words.bounds[o] + s
        assert window[base] == f and window[base + k - 1] == e and k <= 7
        seen += range(base, base + k)
    whole = [i for d in range(4) for i in range(words.bounds[d], words.bounds[d + 1] - 9)]
    assert seen == whole


def test_rolling_hashes_do_not_depend_on_the_place():
    h = np.arange(1, 30, dtype=np.uint64)
    assert rolling(np.concatenate([h, h]), 5)[29:34].tolist() == rolling(h, 5)[:5].tolist()


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
