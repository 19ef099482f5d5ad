"""Near vectors by cells, and resolution of linked items alone, against all pairs and one walk."""

import random

import numpy as np
import pytest

from evidentia.config import Settings
from evidentia.operators import graph as G
from evidentia.operators import vectors as V
from evidentia.operators.resolution import Walk, resolve
from evidentia.operators.entities import _plain

ITEMS = "kb_id long, type string, chunk_id long, position long, name string, description string, aliases array<string>, embedding array<double>"
ENTITIES = "kb_id long, entity_id long, type string, canonical_name string, normalized_name string, description string, aliases array<string>, embedding array<double>"


def clusters(seed, n, dims=6, spread=0.08, centres=25):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(middle[k % centres] + rng.normal(size=dims) * spread).tolist() for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_what_near_pairs_connect(spark, monkeypatch, seed):
    monkeypatch.setattr(V, "BLOCK", 20)
    vectors = [("a" if k % 3 else "b", f"v{k}", e) for k, e in enumerate(clusters(seed, 240))] + [("a", "zero", [0.0] * 6), ("a", "short", [1.0, 2.0])]
    links, told = V.near_links(spark.createDataFrame(vectors, "grp string, vid string, embedding array<double>"), 0.95)
    parent = {v: v for _, v, _ in vectors}

    def root(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for r in links.collect():
        parent[root(r.a, parent)] = root(r.b, parent)
    want = {v: v for _, v, _ in vectors}
    for i, (g, v, e) in enumerate(vectors):
        for h, w, f in vectors[:i]:
            if g == h and len(e) == len(f) and np.linalg.norm(e) * np.linalg.norm(f) > 0 and np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f) >= 0.95:
                want[root(v, want)] = root(w, want)
    sets = lambda of: sorted(sorted(v for v in of if root(v, of) == r) for r in {root(v, of) for v in of})
    assert sets(parent) == sets(want) and len(sets(want)) < len(vectors)
    met = {r.grp: r.met / r.cells for r in told.collect() if r.cells > 1}
    assert max(met.values()) < 0.5  # clustered vectors leave out most cells


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_one_walk(spark, seed):
    rng, vectors = random.Random(seed), clusters(seed, 60, spread=0.15, centres=9)
    name = lambda: f"N{rng.randint(0, 25)}"
    entities = [(1, k + 1, "Person", n := f"E{k}", _plain(n), None, [name()], vectors[k] if k % 4 else None) for k in range(12)]
    items = [(1, "Person", k // 3, k % 3, rng.choice([name(), f"E{rng.randint(0, 14)}", f"only {k}"]), None, [name()] if k % 5 == 0 else [], rng.choice(vectors) if k % 6 else None) for k in range(50)]
    settings = Settings(semantic_resolution=True, similarity_threshold=0.9, similarity_margin=0.03)
    made, placed = resolve(spark.createDataFrame(items, ITEMS), spark.createDataFrame(entities, ENTITIES), settings)
    walk, at = Walk(True, 0.9, 0.03), {}
    for e in entities:
        walk.keep({"entity_id": e[1], "canonical_name": e[3], "normalized_name": e[4], "aliases": list(e[6]), "embedding": e[7], "chunk_id": None, "position": None})
    for i in items:
        at[i[2], i[3]] = walk.resolve({"canonical_name": i[4], "normalized_name": _plain(i[4]), "aliases": i[6], "embedding": i[7], "chunk_id": i[2], "position": i[3]})
    numbers = {k: e["entity_id"] for k, e in enumerate(walk.made)}
    for number, k in enumerate(sorted((k for k, v in numbers.items() if v is None), key=lambda k: (walk.made[k]["chunk_id"], walk.made[k]["position"])), 13):
        numbers[k] = number
    assert {(r.chunk_id, r.position): r.entity_id for r in placed.collect()} == {k: numbers[v] for k, v in at.items()}
    assert {r.entity_id: set(r.aliases) for r in made.collect()} == {numbers[k]: set(e["aliases"]) for k, e in enumerate(walk.made)}


def test_indexed_seeds_equal_a_search_of_all_names(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["Al", "ALPHA", "alphabet", "b-2", "x", "中文", "Ünï x", "a.b", "supplier 00", "pier"])
    entities = [(rng.randint(1, 2), k, " ".join(part() for _ in range(rng.randint(1, 3))), [part() for _ in range(rng.randint(0, 2))] if k % 5 else None) for k in range(80)]
    asked = [(q, rng.randint(1, 3), " ".join(part() for _ in range(rng.randint(0, 6)))) for q in range(25)]
    ents = spark.createDataFrame(entities, "kb_id long, entity_id long, canonical_name string, aliases array<string>")
    questions = spark.createDataFrame(asked, "query_id long, kb_id long, question string")
    got = G.indexed_seeds(questions, G.name_index(ents), Settings(max_nodes=6))
    want = sorted(map(tuple, G.seeds(questions, ents, Settings(max_nodes=6)).collect()))
    assert sorted(map(tuple, got.collect())) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_indexed_seeds_meet_no_names_that_only_share_parts(spark, monkeypatch):
    """What meets does not grow with the names of a knowledge base that share all of their short pieces."""
    names = [f"supplier {k:09d}" for k in range(3000)] + ["x" * 70 + "a", "x" * 70 + "b", "x" * 64]
    ents = spark.createDataFrame([(1, k, name, None) for k, name in enumerate(names)], "kb_id long, entity_id long, canonical_name string, aliases array<string>")
    asked = [(q, 1, f"which parts does {names[q * 29]} supply?") for q in range(100)] + [(100, 1, "x" * 70 + "b?"), (101, 2, names[5]), (102, 1, None)]
    questions = spark.createDataFrame(asked, "query_id long, kb_id long, question string")
    frame = type(questions)
    met, plain = [], frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **k: met.append(plain(self, *a, **k)) or met[-1])
    got = sorted(map(tuple, G.indexed_seeds(questions, G.name_index(ents)).collect()))
    monkeypatch.undo()
    assert got == [(q, 1, q * 29) for q in range(100)] + [(100, 1, 3001), (100, 1, 3002)]
    assert max(df.count() for df in met) <= len(got) + 1  # the other name of the same HEAD characters


def test_indexed_seeds_send_no_pieces_to_all_tasks_and_meet_few_of_one_name(spark, monkeypatch):
    """However few bytes the questions are, their pieces are not broadcast; entities of one name meet as max_nodes at most."""
    ents = spark.createDataFrame([(1, k, "One Name", [f"n{k}"]) for k in range(200)], "kb_id long, entity_id long, canonical_name string, aliases array<string>")
    questions = spark.createDataFrame([(q, 1, f"one-name, n{q}?") for q in range(100, 130)], "query_id long, kb_id long, question string")
    frame = type(questions)
    met, plain = [], frame.join
    monkeypatch.setattr(frame, "join", lambda self, *a, **k: met.append(plain(self, *a, **k)) or met[-1])
    got = sorted(map(tuple, G.indexed_seeds(questions, G.name_index(ents), Settings(max_nodes=6)).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, G.seeds(questions, ents, Settings(max_nodes=6)).collect()))
    assert met[0].count() <= 30 * (6 + 3)
    assert "SortMergeJoin" in met[0]._jdf.queryExecution().sparkPlan().toString()
