import hashlib
import zlib

import pytest

from evidentia.llm.merkle import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        base = i // 8 * 8
        run = level[base : base + 8]
        yield run[: i - base], run[i - base + 1 :]
        i //= 8


def brute(rows):
    leaf = {id(r): H(*map(enc, r)) for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf[id(r)]))
        trees[g] = levels([leaf[id(r)] for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = H(*map(enc, (*r[:4], lower(r[4])))) if tampered else leaf[id(r)]
            for before, after in steps:
                node = H(*before, node, *after)
            yield r[0], leaf[id(r)], trees[g][-1][0], top[-1][0], H(*[x for b, a in steps for x in (*b, *a)]), node, node == top[-1][0]


def drawn(n, langs):
    return [(i * 7 % 100_003, f"s{i % 5}" if i % 6 else None, langs[i % len(langs)], i if i % 9 else None, (f"Text {i} Ünï " * (i % 4)) if i % 10 else None) for i in range(n)]


CASES = {
    "hot": drawn(700, ["en", "en", "en", "de", None, "", "zh"]) + [(5, "s", "Ünï", 1, "X" * 200_000)],
    "many groups": drawn(150, [f"l{i}" for i in range(70)] + [None]),
    "nulls and repeated rows": [(None, None, None, None, None), (None, "a", None, 1, "B"), (3, "a", None, 1, ""), (3, "a", None, 1, "A"), (3, "a", None, 1, "A"), (3, "a", "x", 1, "A")],
    "one": [(3, "a", "en", 1, "ABC")],
    "eight": drawn(8, ["en"]), "nine": drawn(9, ["en"]), "sixty-five": drawn(65, ["en"]),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS tree", "'x' AS leaf", "2 AS level")
    want = sorted(brute(rows), key=str)
    got = manifest(docs.repartition(5)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_lower_levels_meet_in_a_join(spark, monkeypatch):
    monkeypatch.setattr("evidentia.llm.merkle.MOST_TOP", 3)
    rows = CASES["hot"]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, manifest(docs).collect()), key=str) == sorted(brute(rows), key=str)


def test_tampering_is_found(spark):
    rows = drawn(200, ["en", "de"])
    got = {r.doc_id: r.verified for r in manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()}
    for r in rows:
        changed = zlib.crc32(str(r[0]).encode()) % 3 == 0 and lower(r[4]) != r[4]
        assert got[r[0]] is not changed


def test_empty(spark):
    assert manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0
