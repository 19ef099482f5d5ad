"""Keyed tables, transactions of several writers, and streamed indexing into them."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from evidentia.config import Settings
from evidentia.functions.scalar import metadata_field
from evidentia.operators.communities import StaleGraph
from evidentia.operators.keyed import SCHEMAS, Held, Store
from evidentia.plans.models import HashEmbedder, ScriptedChat
from evidentia.streaming.indexing import index_available, index_batch
from evidentia.streaming.ingest import LANDED

SETTINGS = Settings(chunk_size=200, chunk_overlap=20, graph_enabled=True)


def found(messages):
    """A model that finds the capitalised words of a chunk, and links neighbours."""
    names = [w for w in dict.fromkeys(messages[-1]["content"].replace(".", " ").split()) if w[0].isupper()]
    return json.dumps({
        "entities": [{"key": n, "name": n, "type": "Person"} for n in names],
        "relationships": [{"source_key": a, "target_key": b, "type": "knows", "statement": f"{a} {b}", "confidence": 0.9} for a, b in zip(names, names[1:], strict=False)],
    })


EMBEDDER, MODEL = HashEmbedder(4), ScriptedChat(found)


def landed(spark, *docs):
    rows = [json.dumps({"title": "t", "source": "s", "index_version": 1} | d) for d in docs]
    return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", LANDED).alias("d")).select("d.*")


def doc(i, kb, text, **more):
    return {"doc_id": i, "kb_id": kb, "text": text, "metadata": {"author": {"name": f"a{i}", "tags": ["x", i]}, "n": i}} | more


FIRST = [doc(1, 1, "Ann meets Bob. " * 20), doc(2, 1, "Bob meets Cid."), doc(3, 2, "Ann meets Dan."), doc(4, 2, "  "), doc(5, 3, "Eve and Fay and Ann.")]


def tables(store):
    """All rows without the numbers that the store gives, which depend on the order of batches."""
    held = store.load()
    g = held.graph
    names = {r.entity_id: (r.kb_id, r.canonical_name) for r in g.entities.collect()}
    edges = {r.relationship_id: (names[r.source], names[r.target], r.type) for r in g.relationships.collect()}
    assert len(names) == g.entities.count() and len(edges) == g.relationships.count()
    return {
        "documents": sorted((r.kb_id, r.doc_id, r.index_version, r.status, r.reason or "") for r in held.documents.collect()),
        "chunks": sorted((r.kb_id, r.chunk_id, r.content, tuple(r.embedding)) for r in held.chunks.collect()),
        "entities": sorted(names.values()), "mentions": sorted((names[r.entity_id], r.chunk_id) for r in g.mentions.collect()),
        "edges": sorted((*edges[r.relationship_id], r.weight) for r in g.relationships.collect()),
        "evidence": sorted((edges[r.relationship_id], r.chunk_id) for r in g.evidence.collect()),
    }


def test_a_stream_equals_one_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    streamed, whole = Store(spark, str(tmp_path / "a"), 4), Store(spark, str(tmp_path / "b"), 4)
    (landing / "1.json").write_text("\n".join(json.dumps({"title": "t", "index_version": 1} | d) for d in FIRST[:3]))
    index_available(spark, str(landing), streamed, str(tmp_path / "ck"), EMBEDDER, MODEL, SETTINGS)
    again = [doc(1, 1, "Gus meets Bob.", index_version=2), doc(2, 1, "old", index_version=0), doc(3, 2, "same version, already there")]
    (landing / "2.json").write_text("\n".join(json.dumps({"title": "t", "index_version": 1} | d) for d in FIRST[3:] + again))
    index_available(spark, str(landing), streamed, str(tmp_path / "ck"), EMBEDDER, MODEL, SETTINGS)
    index_batch(whole, landed(spark, *FIRST[1:], again[0]), EMBEDDER, MODEL, SETTINGS)
    got = tables(streamed)
    assert got == tables(whole) and got["documents"][0] == (1, 1, 2, "ready", "") and got["documents"][3][3] == "failed"
    assert got["entities"] == [(1, "Bob"), (1, "Cid"), (1, "Gus"), (2, "Ann"), (2, "Dan"), (3, "Ann"), (3, "Eve"), (3, "Fay")]
    # A batch whose end the checkpoint never heard of comes again, and changes nothing.
    before = streamed.state()
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    index_available(spark, str(landing), streamed, str(tmp_path / "ck"), EMBEDDER, MODEL, SETTINGS)
    assert streamed.state() == before
    named = streamed.load().documents.where(metadata_field(F.col("metadata"), "$.author.tags[1]", "int") == 5)
    assert [(r.doc_id, r.n, r.m) for r in named.select("doc_id", metadata_field(F.col("metadata"), "$.author.name").alias("n"), metadata_field(F.col("metadata"), "$.nothing").alias("m")).collect()] == [(5, "a5", None)]


def test_other_buckets_stay_and_old_states_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    index_batch(store, landed(spark, *FIRST), EMBEDDER, MODEL, SETTINGS)
    first = store.state()
    index_batch(store, landed(spark, doc(6, 2, "Hal meets Ann.")), EMBEDDER, MODEL, SETTINGS)
    second = store.state()
    touched = set(store.buckets_of([2]))
    assert touched != set(store.buckets_of([1, 2, 3]))
    for table in SCHEMAS:
        for bucket in {*first.folders[table], *second.folders[table]} - touched:
            assert first.folders[table][bucket] == second.folders[table][bucket]
    want = tables(store)
    assert store.clean(keep=1) > 0 and tables(store) == want and store.clean(keep=1) == 0
    assert sorted(r.canonical_name for r in store.load([2]).graph.entities.collect()) == ["Ann", "Dan", "Hal"]


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 8)
    index_batch(store, landed(spark, *FIRST), EMBEDDER, MODEL, SETTINGS)
    gone = lambda kb: lambda held: Held(held.documents, held.chunks.where(F.col("doc_id") < 0), held.graph)
    calls = []

    def slow(held):
        calls.append(len(calls))
        if len(calls) == 1:  # another one is first, on another knowledge base
            store.transact([3], gone(3))
        return gone(1)(held)

    number = store.state().number
    assert store.transact([1], slow).number == number + 2 and calls == [0]
    assert {r.kb_id for r in store.load().chunks.select("kb_id").distinct().collect()} == {2}

    def beaten(held):
        store.transact([2], gone(2), tries=1)
        return held

    with pytest.raises(StaleGraph):
        store.transact([2], beaten, tries=1)
    threads = [threading.Thread(target=index_batch, args=(store, landed(spark, doc(10 + k, k, f"Nina{k} meets Olaf{k}.")), EMBEDDER, MODEL, SETTINGS)) for k in (1, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = [r.entity_id for r in store.load().graph.entities.collect()]
    assert len(ids) == len(set(ids)) and {"Nina1", "Olaf3"} <= {r.canonical_name for r in store.load().graph.entities.collect()}


def test_texts_do_not_move_unless_documents_are_given_twice_or_again(spark, tmp_path):
    """New documents are chunked where they are read, whatever is stored; twice given and stale ones are still told apart."""
    from evidentia.session import written
    from evidentia.streaming.indexing import indexed

    plain, store = Settings(chunk_size=200, chunk_overlap=20), Store(spark, str(tmp_path / "s"), 4)
    index_batch(store, landed(spark, *FIRST[:3]), EMBEDDER, MODEL, plain)
    held, limit = store.load([1, 2, 3]), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = indexed(held, written(landed(spark, *FIRST[3:]), "landed"), EMBEDDER, MODEL, plain)
        assert "Exchange" not in after.chunks._jdf.queryExecution().executedPlan().toString()
        assert sorted({r.doc_id for r in after.chunks.collect()}) == [1, 2, 3, 5] and after.documents.count() == 5
        more = [doc(6, 1, "one"), doc(6, 1, "two", index_version=2), doc(2, 1, "same"), doc(1, 1, "older", index_version=0), doc(3, 2, "newer", index_version=2)]
        after = indexed(held, written(landed(spark, *more), "landed"), EMBEDDER, MODEL, plain)
        assert sorted((r.doc_id, r.content) for r in after.chunks.collect() if r.doc_id != 1) == [(2, "Bob meets Cid."), (3, "newer"), (6, "two")]
        assert sorted((r.doc_id, r.index_version) for r in after.documents.collect()) == [(1, 1), (2, 1), (3, 2), (6, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
