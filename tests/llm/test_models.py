import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import language_id as L
from evidentia.llm import quality as Q

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def test_trigrams_equal_a_plain_loop():
    texts = ["Ab, c É", "", None, "x", "1 2", "né\nan  b"]
    packed, bounds = L.grams(texts)
    for k, text in enumerate(texts):
        signs = " " + (text or "").lower() + "\n" if text else "\n"
        signs = [c if c.isalpha() else "\0" for c in signs]
        want = ["".join(signs[i - 1 : i + 2]) for i in range(1, len(signs) - 1) if signs[i] != "\0"]
        got = ["".join(chr((int(x) >> s) & 0x1FFFFF) for s in (42, 21, 0)) for x in packed[bounds[k] : bounds[k + 1]]]
        assert got == want


def test_filters_have_no_false_negatives_and_few_positives():
    rng = np.random.default_rng(1)
    learned = {f"l{k}": np.unique(rng.integers(1, 1 << 60, 500 + k)) for k in range(70)}  # more than one word of bits
    filters = L.build_filters(learned)
    for k, lang in enumerate(filters.languages):
        found = filters.languages_of(learned[lang])
        assert ((found[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).all()
    other = filters.languages_of(rng.integers(1 << 61, 1 << 62, 20_000))
    share = np.mean([((other[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).mean() for k in range(70)])
    assert share < 0.02 and abs(share - filters.false_positive.mean()) < 0.005


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog that is here", "en", "s") for i in range(12)] + [(20 + i, "der hund und die katze ist nicht hier", "de", "s") for i in range(12)]
    rows += [(50, None, "en", None), (51, "", None, None), (52, "123 !!", "de", None), (None, "der hund und die katze", None, None), (53, "ωψ", None, None), (54, "the dog " * 60_000, None, None), (54, "the dog", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    got = L.language_id(docs.repartition(3)).collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 20, 50, 51, 52, None, 54)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert by[53].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in L.language_id(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert L.language_id(docs.limit(0)).count() == 0


def test_equal_languages_are_told_by_name(spark):
    docs = spark.createDataFrame([(i, "same words in both", lang) for i, lang in enumerate(["zz", "aa"] * 8)], "doc_id long, text string, lang string")
    got = L.language_id(docs).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 0.5)}


@needs_data
def test_predictions_equal_plain_sets(spark):
    """The same choice from sets of trigrams in place of filters, which err on a few trigrams."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]

    def cut(text):
        signs = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()}\n") if text else ""
        return [signs[i : i + 3] for i in range(len(signs) - 2) if signs[i + 1] != "\0"]

    counts = defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and text and not held(doc):
            counts[lang].update(cut(text))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= L.MIN_SHARE} for lang, c in counts.items()}
    known = {lang: {g for g, x in s.items() if x >= L.MIN_OF_LARGEST * max(o.get(g, 0) for o in shares.values())} for lang, s in shares.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for doc, text, _ in rows:
        trigrams = cut(text)
        hits = {lang: sum(g in known[lang] for g in trigrams) for lang in sorted(known)}
        if not trigrams:
            assert got[doc] == ("und", 0.0)
            continue
        best = max(hits, key=hits.get)
        second = max(n for lang, n in hits.items() if lang != best)
        assert abs(got[doc][1] - hits[best] / sum(hits.values())) < 0.03 or len(trigrams) < 50
        assert got[doc][0] == best or hits[best] - second <= 0.03 * len(trigrams)


@needs_data
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_tokens_know_case_signs_and_repetition():
    t = Q.tokens(["the The THE", "the, the", "", "a1!"])
    assert np.diff(t.bounds).tolist() == [3, 3, 0, 3]
    assert t.word[0] == t.word[1] == t.word[2] == t.word[3] == t.word[5]
    assert len(set(t.shape[:3].tolist())) >= 2 and t.shape[1] == t.shape[2] == t.shape[5]


def test_folded_network_equals_the_plain_one():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "bad!!", "ugly##"], 30)) for _ in range(200)]
    y = np.array([t.count("!!") + t.count("##") < 15 for t in texts], dtype=float)
    vectors = Q.word_vectors(Q.context_sums(texts))
    x = Q.pooled(texts, vectors).astype(np.float64)
    layers = Q.fit_layers(x, y)
    network = layers.folded(vectors)

    def plain(text):
        t = Q.tokens([text])
        words, shapes = (np.mean([vectors[k] for k in ids], axis=0) if len(ids) else np.zeros(Q.DIMENSIONS) for ids in (t.word, t.shape))
        z = (np.concatenate([words, shapes]) - layers.centre) / layers.scale
        logit = np.tanh(z @ layers.inner + layers.inner_bias) @ layers.output + layers.output_bias
        return 1 / (1 + np.exp(-logit / layers.temperature))

    more = [*texts, "", "unseen words", "fine"]
    assert np.allclose(network.scores(more), [plain(t) for t in more], atol=2e-4)
    assert np.mean((network.scores(texts) > 0.5) == y) > 0.9
    # a text alone scores as it does among others
    assert np.allclose([network.scores([t])[0] for t in texts[:10]], network.scores(texts)[:10], atol=1e-5)


def test_contexts_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "bb!", "Cc", "12"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None, ""]
    places, signs = Q.index_vectors()
    want = np.zeros((Q.BUCKETS, Q.DIMENSIONS))
    for text in texts:
        t = Q.tokens([text])
        for i in range(len(t.word)):
            pairs = [(t.word[i], t.shape[i]), (t.shape[i], t.word[i])]
            for j in (i - 1, i + 1):
                if 0 <= j < len(t.word):
                    pairs += [(t.word[i], t.word[j]), (t.shape[i], t.shape[j]), (t.word[i], t.shape[j]) if j > i else (t.shape[i], t.word[j])]
            for centre, neighbour in pairs:
                np.add.at(want[centre], places[neighbour], signs[neighbour])
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 40):
        assert np.array_equal(Q.corpus_contexts(docs.repartition(parts)), want)


def test_quality_edge_cases(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        words = [rng.choice(["plain", "words", "read", "well"]) + ("" if good else rng.choice(["###", "$$$"])) for _ in range(20)]
        rows.append((i, " ".join(words)))
        labels.append((i, good))
    rows += [(900, None), (901, ""), (None, "plain words read"), (902, "plain words " * 50_000), (902, "plain words")]
    labels += [(5, None), (None, 1), (7, 1), (7, 0), (12345, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "2 AS score")
    marks = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'x' AS text")
    got = Q.quality_scores(docs.repartition(3), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == held(r.doc_id) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 300]) > 0.97
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    twice = Q.quality_scores(docs.unionByName(docs), marks.unionByName(marks)).collect()
    assert len(twice) == 2 * len(got) and len({(r.doc_id, r.score) for r in twice}) == len({(r.doc_id, r.score) for r in got})
    assert {round(r.score, 6) for r in Q.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), marks).count() == 0


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.quality_scores(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_learning_ignores_held_out_rows(spark):
    rows = [(i, "aaa bbb", "xx" if held(i) else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.language_id(docs).collect()} == {"yy"}
