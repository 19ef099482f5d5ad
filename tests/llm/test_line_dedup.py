import random
from collections import defaultdict

from evidentia.llm.line_dedup import boilerplate_keys, line_rows, page_lines, remove_boilerplate

SCHEMA = "doc_id long, text string, source string"


def key(line):
    return line.lower().strip()


def brute(rows, min_sites=3):
    pages = {}
    for _, text, source in rows:
        told = tuple(k for k in map(key, (text or "").split("\n")) if k)
        if told:
            pages[told] = min(pages.get(told, source or ""), source or "")
    sites = defaultdict(set)
    for told, site in pages.items():
        for k in told:
            sites[k].add(site)
    spread = {k for k in sites if len(sites[k]) >= min_sites}
    out = []
    for doc, text, source in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in spread]
        out.append((doc, None if text is None else "\n".join(left), source, 0 if text is None else len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    shared = [f"shared line number {k} of the site" for k in range(8)]
    rows = []
    for doc in range(150):
        lines = [f"own line {doc} {k} with some more words in it to be long" for k in range(rng.randint(0, 6))]
        for k in range(8):
            if rng.random() < 0.03 * (k + 1):
                lines.insert(rng.randint(0, len(lines)), rng.choice([shared[k], shared[k].upper(), f"  {shared[k]} \r"]))
        rows.append((doc, "\n".join([*lines, "short line"] + ["rare"] * (doc < 2)), f"s{rng.choice([0, 0, 0, *range(9)])}"))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "\n\n", None), (None, shared[7] + "\n" + "mine alone for a while, and longer than that other line", None), (3, rows[3][1], "s5"), (3, rows[3][1], "s5"), (204, "a b c d " * 40_000, "s1")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k1", "2 AS removed", "3 AS n_lines")
    got = sorted(map(tuple, remove_boilerplate(docs.repartition(4)).collect()), key=str)
    assert got == brute(rows)
    assert any(r[4] for r in got)


def test_sketches_and_exact_counts_agree_with_sets(spark):
    rows = [(i, f"line with a number {i % 40}\nown {i}", f"site{i % (i % 40 + 1)}") for i in range(4000)]
    lines = page_lines(line_rows(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source", 1))
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in text.split("\n"):
            sites[line].add(site)
    for least in (1, 5, 20):
        assert boilerplate_keys(lines, least).count() == sum(len(x) >= least for x in sites.values())


def test_empty(spark):
    assert remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_of_mostly_boilerplate_lose_it(spark):
    shared = [f"shared line number {k} of the site" for k in range(3)]
    rows = [(k, "\n".join([*shared, f"own line of document {k}"]), f"s{k}") for k in range(6)]
    rows += [(10 + k, f"Home\nPrivacy policy\nwhat page {k} tells, and nobody else\nContact us", f"s{k}") for k in range(6)]
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (rows[k][1].split("\n")[3], 3) for k in range(6)} | {10 + k: (f"what page {k} tells, and nobody else", 3) for k in range(6)}


def test_copies_stay_and_shared_lines_go(spark):
    notice = ["this notice stands on the pages of very many sites and is long", "a second notice that stands below the first one here"]
    rows = [(k, f"own words of page {k} which go on for much longer than all of the notices do\n" + notice[k % 2], f"s{k % 7}") for k in range(14)]
    rows += [(20, notice[0], "s1"), (21, "\n".join(notice), "s2")]
    rows += [(40 + k, "a text that was copied whole to many sites\nand its second line of words", f"s{k}") for k in range(5)]
    news = "\n".join(f"line {k} of a story that many sites print, with some more words {k}" for k in range(6))
    rows += [(60 + k, f"{news}\nprinted by {k} alone", f"s{k}") for k in range(5)]
    got = {r.doc_id: r.text for r in remove_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for doc, text, _ in rows:
        assert got[doc] == (text.split("\n")[0] if doc < 20 else "" if doc < 40 else text if doc < 60 else text.split("\n")[-1])


def test_three_lines_of_notice_go_whatever_their_share(spark):
    notice = "\n".join(f"a long line of notice with the number {k} that every site shows below its pages" for k in range(3))
    rows = [(k, f"{notice}\nown {k}", f"s{k}") for k in range(6)]
    assert {(r.doc_id, r.text, r.n_removed) for r in remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()} == {(k, f"own {k}", 3) for k in range(6)}


def test_texts_of_very_many_lines(spark):
    many = [f"line {k % 3}" if k % 2 else f"own {k}" for k in range(200_000)]
    rows = [(0, "\n".join(many), "s0"), *((k, "\n".join(["line 0", "line 1", "line 2", f"mine {k}"]), f"s{k}") for k in range(1, 4))]
    got = {r.doc_id: r.text for r in remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == "\n".join(many[::2]) and got[2] == "mine 2"


def test_white_space_and_scripts_without_spaces(spark):
    lines = ["Imprint.", "保留所有权利未经许可不得以任何形式转载或使用本网站的内容", "terms\tof use\u3000apply here", "Rare."]
    rows = []
    for k in range(15):
        text = f"own words of page {k} which go on for longer than all of the other lines that stand below, and for more still\n"
        rows.append((k, text + "\n".join([x + "\u00a0" * (k % 2) for x in lines[:3]] + lines[3:] * (k < 2)), f"s{k}"))
    for r in remove_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        assert r.text.split("\n")[1:] == lines[3:] * (r.doc_id < 2) and r.n_removed == 3


def test_least_words(spark):
    rows = [(k, f"two words\nthese are four words\nown {k} {'x' * 99}", f"s{k}") for k in range(4)]
    got = remove_boilerplate(spark.createDataFrame(rows, SCHEMA), min_words=3).collect()
    assert {(r.doc_id, r.n_removed, r.text) for r in got} == {(k, 1, f"two words\nown {k} {'x' * 99}") for k in range(4)}
