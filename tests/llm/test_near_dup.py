import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from evidentia.llm.near_dup import _units, choose_bands, near_duplicates
from evidentia.operators.components import connected, dealt_anew


def brute(rows, size=5, threshold=0.8):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    words = [tuple((t or "").lower().split()) for _, t in rows]
    n = len(rows)
    near = [[i != j and (words[i] == words[j] or (bool(sets[i] | sets[j]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))) for j in range(n)] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if near[i][j]:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(known, default=None), sum(near[i])) for i in members]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(40):  # one large group, over several blocks
        text = list(base)
        text[k] = "other"
        rows.append(" ".join(text))
    rows += ["", None, "  \n", "One two", "one  TWO", "a b c d e", "é è 中 文 字"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [(i, t) for i, t in enumerate(corpus(seed))] + [(None, "lonely row of five words here"), (7, "repeated id"), (7, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS class_id")
    got = near_duplicates(docs.repartition(3), block_rows=16)
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got.collect()], key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_chains_of_chance_are_compared_by_bucket(spark):
    """Texts that change step by step: neighbours are similar, the ends are not."""
    rng = random.Random(8)
    words, rows = [f"w{rng.randrange(900)}" for _ in range(100)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = rng.randrange(100)
        words[at] = f"new{i}"
    rows += [(70, "long " * 100_000), (71, "long " * 100_000 + "end"), (72, "long " * 100_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(docs, block_rows=2, block_chars=2000).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=str) == brute(rows)


def test_units(spark):
    chain = [(bytes([i]), 10, [i, i + 1]) for i in range(10)]
    dense = [(bytes([100 + i]), 10, [777, 1000 + i]) for i in range(9)] + [(b"long", 1000, [888]), (b"more", 1000, [888])]
    classes = spark.createDataFrame(chain + dense, "key binary, chars long, bands array<long>")
    rows = _units(classes, 2, 100).collect()
    assert sorted((r.bucket, r.key) for r in rows if r.bucket is not None) == sorted((b, bytes([i])) for i in range(10) for b in (i, i + 1) if 0 < b < 10)
    whole = {bytes(r.key): r.blocks for r in rows if r.bucket is None}
    assert whole == {bytes([100 + i]): 5 for i in range(9)} | {b"long": 2, b"more": 2}


def test_aggregates_are_dealt_by_themselves(spark):
    """Between two exchanges the adaptive planner can split a hot key."""
    rows = spark.range(100).select((F.col("id") % 7).alias("root"), "id")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [rows.join(side, "root")._jdf.queryExecution().sparkPlan().toString() for side in (sizes, dealt_anew(sizes, "root"))]
        made = [rows.join(side, "root")._jdf.queryExecution().executedPlan().toString() for side in (sizes, dealt_anew(sizes, "root"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("SortMergeJoin" in plan for plan in plans)
    assert [plan.count("Exchange") for plan in made] == [2, 3]
