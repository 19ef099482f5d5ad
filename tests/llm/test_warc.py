import base64
import gzip
import hashlib
import io
import random


from evidentia.llm.warc import MAGIC, members, parse_record, read_warc, with_responses, write_warc
from evidentia.session import scratch_path

SCHEMA = "page_id long, url string, html string"
PAGES = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 1000), (None, "http://n/", "alone"), (6, "http://f/", "WARC/1.1\r\n\r\n" * 3), (7, "u", "z" * 3_000_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS id", "2 AS payload").repartition(3)
    manifest = write_warc(pages, scratch_path(spark, "test-warc"), file_bytes=400)
    for split in (37, 1 << 20):
        rows = {r.record_id: r for r in read_warc(manifest, split_bytes=split).collect()}
        assert len(rows) == len(PAGES) == read_warc(manifest, split_bytes=split).count()
        for page, _, html in PAGES:
            body = (html or "").encode()
            r = rows[str(page) if page is not None else "null"]
            same = [p for p, _, h in PAGES if (h or "").encode() == body and p is not None]
            best = max(same, default=None)
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert r.record_type == ("response" if page == best else "revisit")
            assert r.refers_to == (None if page == best else str(best))
            assert r.payload == (body if page == best else None)
            assert r.verified in (True, None)


def test_repeated_rows_and_plans(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "v", "x"), (2, "v", "x"), (None, "n", "y"), (None, "n", "y")], SCHEMA)
    rows = read_warc(write_warc(pages, scratch_path(spark, "test-warc"))).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in rows if r.record_type == "revisit") == [("1", "revisit", "2")] * 2
    assert sorted((r.record_id, r.payload) for r in rows if r.record_type == "response") == [("2", b"x")] * 2 + [("null", b"y")] * 2
    plan = with_responses(pages, "page_id", "url", "html", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # groups are a table, which a join deals out by itself


def test_small_payloads_are_never_revisits(spark):
    manifest = write_warc(spark.createDataFrame(PAGES, SCHEMA), scratch_path(spark, "test-warc"), min_bytes=12)
    assert read_warc(manifest).where("record_type = 'revisit'").count() == 0


def test_empty(spark):
    manifest = write_warc(spark.createDataFrame([], SCHEMA), scratch_path(spark, "test-warc"))
    assert manifest.count() == 0 and read_warc(manifest).count() == 0


def test_ranges_own_each_member_once():
    rng = random.Random(5)
    blocks = [b"WARC/1.0\r\nA: b\r\nContent-Length: 9\r\n\r\n" + MAGIC + rng.randbytes(rng.randint(1, 400)) for _ in range(40)]
    parts = [gzip.compress(b, compresslevel=rng.choice([0, 6])) for b in blocks]
    parts.insert(7, MAGIC + b"\x00" * 30)  # damaged
    parts.insert(20, gzip.compress(b"not a record"))
    data = b"".join(parts)
    for size in (1, 50, 333, len(data)):
        found = [record for start in range(0, len(data), size) for _, record in members(io.BytesIO(data), len(data), start, min(len(data), start + size))]
        assert found == blocks


def test_headers():
    got = parse_record(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n")
    assert got["record_type"] == "warcinfo" and got["payload"] is None
