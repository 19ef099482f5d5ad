import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from evidentia.plans.models import chat_rows, embed_column
from evidentia.sources.http_models import HttpModels
from evidentia.sources.tables import synthetic


class Server(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _send(self, body: bytes):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._send(json.dumps({"data": [{"id": "m1"}, {"id": "m2"}]}).encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embeddings"):
            data = [] if body["input"] == "none" else [{"embedding": [len(body["input"]), 1]}]
            self._send(json.dumps({"data": data}).encode())
        elif body["stream"]:
            self._send(b"".join(b'data: {"n": %d}\n\n' % k for k in range(300)) + b"data: [DONE]\n\n")
        else:
            self._send(json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode())


@pytest.fixture(scope="module")
def server():
    made = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield HttpModels(f"http://127.0.0.1:{made.server_port}/v1/", "e", "c")
    made.shutdown()


def test_connector(server):
    assert server.embed(["abc"]) == [[3.0, 1.0]] and server.chat([{"role": "user", "content": "hi"}]) == "HI"
    assert server.models() == ["m1", "m2"] and server.ping()
    assert len(list(server.stream([]))) == 301
    with pytest.raises(RuntimeError):
        server.embed(["none"])
    gone = HttpModels("http://127.0.0.1:9")
    assert gone.models() == [] and not gone.ping()


def test_connector_on_executors(spark, server):
    rows = spark.createDataFrame([(1, "abc"), (2, "de")], "query_id long, text string")
    got = rows.withColumn("v", embed_column(spark, server, F.col("text"))).orderBy("query_id").collect()
    assert [r.v for r in got] == [[3.0, 1.0], [2.0, 1.0]]
    none = F.lit(None).cast("string")
    prompts = rows.select("query_id", F.lit("s").alias("system"), F.col("text").alias("prompt"), none.alias("previous"), none.alias("follow_up"))
    assert {r.query_id: r.answer for r in chat_rows(prompts, server).collect()} == {1: "ABC", 2: "DE"}


def test_synthetic_tables_repeat(spark):
    a, b = synthetic(spark, 20, 10, 30, 8), synthetic(spark, 20, 10, 30, 8)
    for name in a:
        assert a[name].collect() == b[name].collect()
    assert a["chunks"].select(F.size("embedding")).distinct().first()[0] == 8
