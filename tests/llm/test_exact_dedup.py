import hashlib

import pytest

from evidentia.llm.exact_dedup import digest_rows, exact_dedup, tree_merge

ROWS = [(5, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (9, "SAME TEXT"), (3, "Ünïque Ä"), (4, "ünïque Ä"), (6, ""), (7, None), (None, "only null id"), (None, ""), (8, "x" * 300_000), (1, "X" * 300_000)]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, keep):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS digest", "'x' AS n", "2 AS keep_id")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(fold(t), []).append(i)
    best = max if keep == "largest" else min
    rank = lambda i: (i is not None, i or 0)
    want = []
    for i, t in ROWS:
        ids = groups[fold(t)]
        stays = best(ids, key=rank)
        want.append((i, stays, len(ids), i == stays, hashlib.sha256(fold(t).encode()).hexdigest()))
    for parts in (1, 7):
        got = exact_dedup(docs.repartition(parts), keep=keep, leaf_runs=5, fan_in=2).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_deal_runs_by_digest_range_and_merge_them_sorted(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    plan = tree_merge(digest_rows(docs), "largest")._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" +-:") for x in plan.split("\n")]
    exchanges = [x for x in lines if x.startswith("Exchange hashpartitioning")]
    assert len(exchanges) == 3 and all(x.startswith("Exchange hashpartitioning(part#") and "digest" not in x for x in exchanges[:2])
    assert sum(x.startswith("SortAggregate") for x in lines) == 6 and "HashAggregate" not in plan.replace("SortAggregate", "")
    assert sum(x.startswith("Sort ") for x in lines) <= 4  # one for each merge, and one before the first exchange
