import random
from collections import defaultdict

from evidentia.llm.chat import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    rank = lambda c: (c is not None, c or 0)
    out = {}
    for c, v in turns.items():
        equal = [d for d in turns if turns[d] == v]
        longer = any(len(turns[d]) > len(v) and turns[d][: len(v)] == v for d in turns)
        if not longer and c == min(equal, key=rank):
            out[c] = (len(v), len(equal), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t * rng.choice([1, 1, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])))
    rows += [(100, t, "user", str(t)) for t in range(20)] + [(101, t, "user", str(t)) for t in range(19)] + [(102, t + 5, "user", str(t)) for t in range(20)]
    rows += [(None, 0, "user", "q"), (103, None, "user", "q"), (103, 0, "user", "z"), (103, 0, "user", "z"), (104, 0, "user", "long" * 50_000)]
    got = defaultdict(dict)
    for r in chat_format(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS block", "3 AS h0").repartition(5), block_turns=4).collect():
        got[r.conv_id][r.part] = r
    whole = {}
    for c, parts in got.items():
        assert sorted(parts) == list(range(parts[0].n_parts))
        whole[c] = (parts[0].n_turns, parts[0].n_equal, "".join(parts[k].text for k in sorted(parts)))
    assert whole == brute(rows)


def test_empty(spark):
    assert chat_format(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_without_numbers_are_dealt_over_ranges(spark):
    rows = [(1, None, "user", f"{k:05d}") for k in range(300)] + [(2, None, "user", f"{k:05d}") for k in range(300)] + [(2, 7, "user", "end")]
    got = chat_format(spark.createDataFrame(rows, SCHEMA).repartition(4)).orderBy("part").collect()
    assert {r.conv_id for r in got} == {2} and [r.part for r in got] == list(range(got[0].n_parts)) and len(got) == 4
    assert "".join(r.text for r in got) == brute(rows)[2][2]


def test_texts_are_shuffled_once(spark):
    plan = chat_format(spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
