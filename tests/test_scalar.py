from pyspark.sql import functions as F

from evidentia.config import Settings
from evidentia.functions import scalar as S
from evidentia.operators.chunking import chunk, pieces


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_normalize_and_terms(spark):
    assert one(spark, S.normalize_name(F.col("a")), a=" I.B.M.　Corp! ") == "ibmcorp"
    assert one(spark, S.terms(F.col("a")), a="What does ZX-491 do, and the 资料库 zx-491 x?") == ["zx-491", "do", "资料库"]


def test_substring_count_does_not_overlap(spark):
    assert one(spark, S.substring_count(F.col("a"), F.col("b")), a="aaaa", b="aa") == 2
    assert one(spark, S.substring_count(F.col("a"), F.col("b")), a="aaaa", b="") == 0


def test_cosine(spark):
    for a, b, want in [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 0.0], -1.0), ([0.0], [0.0], -1.0)]:
        rows = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        assert abs(rows.select(S.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"] - want) < 1e-12


def test_answers(spark):
    assert one(spark, S.citations(F.col("a")), a="x [2] y [1] [2] [a]") == [2, 1]
    assert one(spark, S.is_abstention(F.col("a")), a="The text Does Not Contain it.")
    assert one(spark, S.is_abstention(F.col("a")), a="")
    assert one(spark, S.is_abstention(F.col("a")), a="知识库中没有提到")
    assert not one(spark, S.is_abstention(F.col("a")), a="Alice works for Acme [1].")
    assert one(spark, S.relation_type(F.col("a")), a=" works  for!") == "WORKS_FOR_"
    assert one(spark, S.strip_code_fence(F.col("a")), a='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, S.weight_text(F.col("a")), a=3.0) == "3" and one(spark, S.weight_text(F.col("a")), a=0.5) == "0.5"


def test_chunks_of_short_and_long_texts(spark):
    settings = Settings(chunk_size=200, chunk_overlap=50)
    text = "".join(chr(97 + i % 26) for i in range(430))
    got = one(spark, pieces(F.col("a"), settings), a=text)
    assert got == [text[o : o + 200] for o in range(0, 430, 150)]
    assert one(spark, pieces(F.col("a"), settings), a=" \r\n ") == []
    rows = spark.createDataFrame([(1, "x" + " " * 500 + "y"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.position, r.content) for r in chunk(rows, settings).orderBy("doc_id", "position").collect()]
    assert got == [(1, 0, "x"), (1, 1, "y")]  # windows of white space alone do not count
    assert Settings(chunk_size=10).size == 200 and Settings(chunk_overlap=5000).stride == 1


def test_limits():
    assert Settings().limits(top_k=99, max_hops=9, community_top_k=0) == {"top_k": 20, "max_hops": 2, "community_top_k": 1, "max_nodes": 50, "levels": 2, "candidates": 20}


def test_estimate_of_messages(spark):
    rows = spark.createDataFrame([([("user", "abc"), ("user", "é"), ("user", None)],), ([],)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in rows.select(S.messages_tokens(F.col("m"))).collect()] == [2, 0]
