import os
from collections import defaultdict

import pytest

import corpus_pipeline as P
from evidentia.llm import quality as Q
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_near

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over all documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = (docs.collect(), made.collect(), made.columns)
        docs = made
    return out


@needs_data
def test_stages_pass_documents_on(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "decontaminate", "packing"]
    for name, _ in P.STAGES[:-1]:
        assert stages[name][2] == COLUMNS


@needs_data
def test_quality_stage_keeps_what_the_classifier_accepts(spark, stages):
    docs, kept, _ = stages["quality"]
    told = Q.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in told.collect() if r.predicted)
    whole = {r.doc_id: r for r in docs}
    assert all(whole[r.doc_id] == r for r in kept)


@needs_data
def test_line_stage_equals_brute_force(stages):
    docs, made, _ = stages["line_dedup"]
    want = brute_lines([(r.doc_id, r.text, r.source) for r in docs])
    assert sorted((r.doc_id, r.text) for r in made) == sorted((w[0], w[1]) for w in want)
    assert all(r.n_chars == len(r.text) for r in made)


@needs_data
def test_near_duplicate_stage_equals_brute_force(stages):
    docs, made, _ = stages["ngram_jaccard"]
    groups = defaultdict(list)
    for doc, group, _ in brute_near([(r.doc_id, r.text) for r in docs]):
        groups[group].append(doc)
    assert sorted(r.doc_id for r in made) == sorted(groups)
    whole = {r.doc_id: r for r in docs}
    assert all(whole[r.doc_id] == r for r in made)


@needs_data
def test_leak_stage_equals_brute_force(spark, stages):
    docs, made, _ = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in docs if len(r.text) < 4000]  # the plain version is quadratic
    leaked = {x[0] for x in brute_leaks(short, items)}
    left = {r.doc_id for r in made}
    assert left & {d for d, _ in short} == {d for d, _ in short} - leaked


@needs_data
def test_packing_stage_holds_every_token_once(stages):
    docs, made, _ = stages["packing"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in made:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {r.doc_id for r in docs}
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "word " * 100_000, "en", "s", 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing of these words at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    wide = docs.selectExpr("*", "1 AS score", "2 AS key", "3 AS r1", "4 AS held_out", "'x' AS item_id", "5 AS root", "6 AS removed", "7 AS lines")
    for name, stage in P.STAGES:
        for given in (docs, wide, docs.limit(0)):
            made = stage(spark, given, folder)
            assert name == "packing" or made.columns == COLUMNS
            assert made.count() <= 10_000
    kept = P.near_dup(spark, docs, folder).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 4]
