import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.config import Settings
from evidentia.operators import evaluation as V
from evidentia.operators import retrieval as R
from evidentia.operators import usage as U
from evidentia.plans.ask import KnowledgeBase, ask, citation_gate, retrieve
from evidentia.plans.models import HashEmbedder, ScriptedChat, summarize_communities

GRAPH = Settings(graph_enabled=True)
CHUNKS = "kb_id long, chunk_id long, doc_id long, title string, content string, embedding array<double>"


def local_kb(spark):
    chunks = spark.createDataFrame([(1, 10, 1, "evidence", "Alice works for Acme.", [0.0, 1.0]), (1, 11, 2, "other", "Generic text.", [1.0, 0.0]), (2, 12, 3, "foreign", "Alice elsewhere", [1.0, 0.0])], CHUNKS)
    entities = spark.createDataFrame([(1, 1, "Alice", ["A."]), (1, 2, "Acme", []), (2, 3, "Alice", [])], "kb_id long, entity_id long, canonical_name string, aliases array<string>")
    edges = spark.createDataFrame([(1, 5, 1, 2, 0.99), (2, 6, 3, 3, 0.5)], "kb_id long, relationship_id long, source long, target long, confidence double")
    evidence = spark.createDataFrame([(5, 50, 10, 0.99), (6, 51, 12, 0.5)], "relationship_id long, evidence_id long, chunk_id long, confidence double")
    return KnowledgeBase(chunks, entities, edges, evidence)


def test_local_mode_promotes_evidence_and_stays_in_its_kb(spark):
    questions = spark.createDataFrame([(1, 1, "Where does Alice work?", [1.0, 0.0])], "query_id long, kb_id long, question string, qvec array<double>")
    found = retrieve(questions, local_kb(spark), GRAPH)
    rows = found["candidates"].orderBy("position").collect()
    assert [(r.chunk_id, r.channels) for r in rows] == [(10, ["vector", "keyword", "graph"]), (11, ["vector"])]
    stats = found["stats"].first()
    assert (stats.vector_hits, stats.keyword_hits, stats.graph_hits, stats["mode"]) == (2, 1, 1, "local")
    for plain in (retrieve(questions, local_kb(spark), GRAPH, mode="vector"), retrieve(questions, local_kb(spark))):
        assert plain["stats"].first()["mode"] == "vector"  # the graph is off unless it is asked for


def test_exact_code_wins_by_keyword(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "a", "Incident ZX-491 is resolved.", [0.0, 1.0]), (1, 2, 2, "b", "Generic semantic match.", [1.0, 0.0])], CHUNKS)
    questions = spark.createDataFrame([(1, 1, "what about ZX-491", [1.0, 0.0])], "query_id long, kb_id long, question string, qvec array<double>")
    rows = retrieve(questions, KnowledgeBase(chunks))["candidates"].orderBy("position").collect()
    assert rows[0].chunk_id == 1 and abs(rows[0].retrieval_score - (1 / 62 + 1 / 61)) < 1e-12


def test_global_mode_uses_communities(spark):
    kb = local_kb(spark)
    kb.communities = spark.createDataFrame([(1, 1, 0, "Alice and Acme", "about work", [1.0, 0.0]), (1, 2, 0, "Others", "nothing", [0.0, 1.0])], "kb_id long, community_id long, level long, title string, summary string, embedding array<double>")
    kb.members = spark.createDataFrame([(1, 1), (1, 2)], "community_id long, entity_id long")
    edges = kb.relationships
    kb.relationships = edges.select("relationship_id", "source", "target")
    questions = spark.createDataFrame([(1, 1, "tell me", [1.0, 0.0])], "query_id long, kb_id long, question string, qvec array<double>")
    found = retrieve(questions, kb, GRAPH, mode="global", community_top_k=1)
    assert [r.community_id for r in found["communities"].collect()] == [1]
    assert found["stats"].first()["mode"] == "global"
    assert "graph" in found["candidates"].where("chunk_id = 10").first().channels


def test_ask_end_to_end(spark):
    def script(messages):
        return "Acme [1]." if "[1] evidence" in messages[1]["content"] or "[2] evidence" in messages[1]["content"] else "I see nothing"

    questions = spark.createDataFrame([(1, 1, "Where does Alice work?")], "query_id long, kb_id long, question string")
    kb = local_kb(spark)
    kb.chunks = kb.chunks.withColumn("embedding", F.array(*[F.lit(float(i == 0)) for i in range(16)]))
    out = ask(questions, kb, HashEmbedder(16), ScriptedChat(script))
    assert [(r.answer, r.retried) for r in out["answers"].collect()] == [("Acme [1].", False)]
    assert {r["index"] for r in out["sources"].collect()} == {1, 2}


def test_questions_and_arguments_are_checked(spark):
    questions = spark.createDataFrame([(1, 1, "Where does Alice work?"), (2, 1, " \n"), (3, 1, "x" * 10_001), (4, 1, None)], "query_id long, kb_id long, question string")
    kb = local_kb(spark)
    kb.chunks = kb.chunks.withColumn("embedding", F.array(*[F.lit(float(i == 0)) for i in range(16)]))
    out = ask(questions, kb, HashEmbedder(16), ScriptedChat(lambda m: "told [1]"))
    assert [r.query_id for r in out["answers"].collect()] == [1]
    assert {r.query_id: r.reason.rsplit(" ", 1)[1] for r in out["refused"].collect()} == {2: "empty", 3: "long", 4: "empty"}
    for mode, settings in (("best", Settings()), ("auto", Settings(temperature=2.1))):
        with pytest.raises(ValueError):
            ask(questions, kb, HashEmbedder(16), ScriptedChat(str), settings, mode)


def test_chunks_by_a_table_function(spark):
    from evidentia.operators.chunking import ChunkText, chunk

    texts = ["", "short", " a\r\nb \r" + "word " * 900 + "\n", "x" * 1000 + " " * 300 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.udtf.register("chunk_text", ChunkText)
    docs.createOrReplaceTempView("told_texts")
    got = spark.sql("SELECT doc_id, position, content FROM told_texts, LATERAL chunk_text(text)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunk(docs).select("doc_id", "position", "content").collect()))


def test_a_model_orders_the_candidates(spark):
    def script(messages):
        if "ranked_chunk_ids" not in messages[0]["content"]:
            return "told [1]"
        ids = sorted((c["chunk_id"] for c in json.loads(messages[1]["content"])["candidates"]), reverse=True)
        assert all(len(c["content"]) <= 2000 for c in json.loads(messages[1]["content"])["candidates"])
        if "broken" in messages[1]["content"]:
            raise RuntimeError("down")
        return "```json\n" + json.dumps({"ranked_chunk_ids": ids}) + "\n```"

    questions = spark.createDataFrame([(1, 1, "Where does Alice work?"), (2, 1, "broken")], "query_id long, kb_id long, question string")
    kb = local_kb(spark)
    kb.chunks = kb.chunks.withColumns({"embedding": F.array(*[F.lit(float(i == 0)) for i in range(16)]), "content": F.concat("content", F.repeat(F.lit("x"), 3000))})
    for enabled, first in ((True, 11), (False, 10)):
        out = ask(questions, kb, HashEmbedder(16), ScriptedChat(script), Settings(rerank_enabled=enabled))
        assert {(r.query_id, r["index"]): r.doc_id for r in out["sources"].collect()} == {(1, 1): first - 9, (1, 2): 12 - first, (2, 1): 1, (2, 2): 2}


def test_citation_gate(spark):
    def script(messages):
        if messages[0]["content"] and "kept" in messages[1]["content"]:
            return "now cited [1]"
        if "error" in messages[1]["content"]:
            raise RuntimeError("down")
        return "still nothing"

    rows = [(1, "plain", "kept", True), (2, "plain", "dropped", True), (3, "cited [1]", "kept", True), (4, "no information", "kept", True), (5, "plain", "kept", None), (6, "plain", "error", True)]
    got = citation_gate(spark.createDataFrame(rows, "query_id long, answer string, prompt string, has_evidence boolean"), ScriptedChat(script)).orderBy("query_id").collect()
    assert [(r.answer, r.retried) for r in got] == [("now cited [1]", True), ("plain", False), ("cited [1]", False), ("no information", False), ("plain", False), ("plain", False)]


def test_rerank_accepts_only_permutations(spark):
    rows = spark.createDataFrame([(q, c, p) for q in (1, 2, 3) for p, c in enumerate((10, 20), 1)] + [(4, 10, 1)], "query_id long, chunk_id long, position long")
    ids = spark.createDataFrame([(1, [20, 10]), (2, [999, 10]), (3, [10, 10]), (4, [10])], "query_id long, ids array<long>")
    got = {(r.query_id, r.chunk_id): (r.final_position, r.applied) for r in R.rerank(rows, ids, 5).collect()}
    assert got[1, 20] == (1, True) and got[2, 10] == (1, False) and got[3, 20] == (2, False) and got[4, 10] == (1, False)


@pytest.mark.parametrize("seed", range(3))
def test_fusion_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(q, c, rng.choice([0.1, 0.2, rng.random()]), rng.choice([0.0, 0.0, 1.0, 2.0, rng.random()])) for q in range(3) for c in range(400)]
    graph = [(q, c, k + 1) for q in range(2) for k, c in enumerate(rng.sample(range(450), 40))]
    scored = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, keyword_score double").repartition(5)
    got = R.fuse(scored, {"graph": spark.createDataFrame(graph, "query_id long, chunk_id long, rank long")}, 7)
    want = []
    for q in range(3):
        own = {c: (s, k) for a, c, s, k in rows if a == q}
        vector = {c: i + 1 for i, c in enumerate(sorted(own, key=lambda c: (-own[c][0], c)))}
        hits = sorted((c for c in own if own[c][1] > 0), key=lambda c: (-round(own[c][1], 9), vector[c]))
        keyword = {c: i + 1 for i, c in enumerate(hits)}
        linked = {c: r for a, c, r in graph if a == q and c in own}
        total = {c: sum(1 / (60 + r[c]) for r in (vector, keyword, linked) if c in r) for c in own}
        best = sorted(own, key=lambda c: (-round(total[c], 12), vector[c]))[:7]
        want += [(q, c, vector[c], i + 1, [n for n, r in (("vector", vector), ("keyword", keyword), ("graph", linked)) if c in r]) for i, c in enumerate(best)]
    assert sorted((r.query_id, r.chunk_id, r.vector_rank, r.position, r.channels) for r in got.collect()) == sorted(want)
    ranks = {(r.query_id, r.chunk_id): r.vector_rank for r in R.vector_rank(scored).collect()}
    assert all(ranks[q, c] == v for q, c, v, *_ in want) and sorted(ranks.values()) == sorted(list(range(1, 401)) * 3)


def test_evaluation(spark):
    schema = "id string, expected_mode string, mode string, answer string, answerable boolean, expected_sources array<string>, expected_terms array<string>, sources array<struct<document_id:bigint,title:string,source:string>>"
    source = (7, "Report", "s")
    cases = [
        ("good", "vector", "vector", "ZX-491 is resolved [1].", True, ["7", "Report"], ["zx-491"], [source, (8, "Report", None)]),
        ("outside", None, "vector", "Claimed [2].", True, ["Report"], None, [source]),
        ("abstains", None, "vector", "资料不足", False, None, None, []),
        ("late", None, "local", "x [2]", None, ["z"], ["a", "x"], [source, (9, "q", "z")]),
    ]
    judged = {r.id: r for r in V.judge(spark.createDataFrame(cases, schema)).collect()}
    assert (judged["good"].recall_at_k, judged["good"].reciprocal_rank, judged["good"].citation_valid, judged["good"].mode_correct) == (1.0, 1.0, True, True)
    assert judged["outside"].citation_valid is False and judged["outside"].mode_correct is None
    assert judged["abstains"].abstention_correct is True and judged["abstains"].citation_valid is None and judged["abstains"].recall_at_k is None
    assert judged["late"].reciprocal_rank == 0.5 and judged["late"].answer_term_coverage == 0.5
    summary = V.summarize(V.judge(spark.createDataFrame(cases, schema))).first().asDict()
    assert summary["cases"] == 4 and summary["abstention_accuracy"] == 1.0
    timed = spark.createDataFrame(cases, schema).withColumn("latency_ms", F.lit(2.5))
    told = V.report(V.judge(timed), "set", 3, "2024-01-01T00:00:00Z")
    assert told["summary"]["average_latency_ms"] == 2.5 and told["knowledge_base_id"] == 3 and len(told["cases"]) == 4
    numbers = spark.createDataFrame([("n", None, None, "", None, [x], None, [source]) for x in ("7.9", " 7e0", "+7", "7x", "0x7", "")], schema)
    assert [r.recall_at_k for r in V.judge(numbers).collect()] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    assert V.gate(summary, {"mrr": 0.9, "recall_at_k": 0.0}) == ["mrr"]
    assert V.gate({"mrr": None}, {"mrr": 0.1}) == ["mrr"]


def test_usage_keeps_the_mean_of_means(spark):
    rows = [("success", 120.0, 14), ("failed", 3000.0, 0), ("success", 900.0, 12)]
    logs = spark.createDataFrame(rows, "status string, latency_ms double, total_tokens long")
    assert U.summary(logs).first().asDict() == {"calls": 3, "failures": 1, "tokens": 26, "avg_latency_ms": round((510 + 3000) / 2)}
    assert U.summary(logs.limit(0)).first().asDict() == {"calls": 0, "failures": 0, "tokens": 0, "avg_latency_ms": 0}


def test_summaries_need_title_and_text(spark):
    rows = spark.createDataFrame([(1, ["Alice"], ["fact"])], "community_id long, names array<string>, facts array<string>")
    good = ScriptedChat(lambda m: json.dumps({"title": " T ", "summary": "about Alice"}))
    got = summarize_communities(rows, good, HashEmbedder(4)).first()
    assert (got.title, got.summary, len(got.embedding)) == ("T", "about Alice", 4)
