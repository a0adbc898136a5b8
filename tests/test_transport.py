"""Pictures, a model gateway on the local host, documents, and the numbering of sorted tables."""

from __future__ import annotations

import hashlib
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sylvatica.operators import frames, gate, keys, trials, workflow
from sylvatica.schemas import FRAME, NODE
from sylvatica.sources import readers, sinks, transport


class Handler(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):  # noqa: N802
        self.send_response(200 if self.path == "/picture" else 404)
        self.end_headers()
        self.wfile.write(b"from the net")

    def do_POST(self):  # noqa: N802
        request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Handler.asked.append((self.path, self.headers["Authorization"], request))
        told = {"one": {"choices": [{"message": {"content": " yes \n"}}]}, "list": {"choices": [{"message": {"content": [{"text": "a"}, "b"]}}]}}.get(request["model"], {"choices": []})
        self.send_response(500 if request["model"] == "broken" else 200)
        self.end_headers()
        self.wfile.write(json.dumps(told).encode())

    def log_message(self, *args):
        return


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_pictures(spark, server, tmp_path):
    (tmp_path / "a.png").write_bytes(b"from the disk")
    rows = [("local", "http://unused", f"{tmp_path}/a.png"), ("file", f"file://{tmp_path}/a.png", None), ("net", f"{server}/picture", ""), ("gone", f"{server}/none", None), ("none", None, None)]
    df = spark.createDataFrame(rows, "observation_id string, image_url string, local_path string")
    found = {r.observation_id: (bytes(r.picture) if r.picture is not None else None, r.error) for r in transport.pictures(frames.ensure_columns(df, [f.split()[0] for f in FRAME.split(", ")])).collect()}
    assert found["local"] == found["file"] == (b"from the disk", None) and found["net"] == (b"from the net", None)
    assert found["gone"][0] is None and "404" in found["gone"][1] and found["none"][0] is None


def test_gateway(server):
    call = transport.gateway_call(f"{server}/v1/", "k")
    parts = [{"kind": "image", "value": "u"}, {"kind": "text", "value": "what?"}]
    assert call(" one ", parts) == "yes" and call("list", parts) == "a\nb"
    path, key, request = Handler.asked[0]
    assert (path, key) == ("/v1/chat/completions", "Bearer k")
    assert request == {"model": "one", "messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "what?"}]}], "max_tokens": 200, "temperature": 0.0}
    for model, message in (("broken", "HTTP 500"), ("other", "unexpected answer")):
        with pytest.raises(RuntimeError, match=message):
            call(model, parts)
    with pytest.raises(RuntimeError, match="network error"):
        transport.gateway_call("http://127.0.0.1:9", "k", timeout=2)("one", parts)
    with pytest.raises(ValueError):
        call(" ", parts)
    with pytest.raises(ValueError):
        transport.gateway_call(server, " ")
    assert transport.asked_once(call, io.StringIO(json.dumps({"model": "one", "parts": ["a", {"image": "u"}]}))) == "yes"
    with pytest.raises(ValueError):
        transport.asked_once(call, io.StringIO('{"parts": 3}'))


def test_numbering_does_not_hang_on_what_is_read_later(spark):
    rows = spark.range(50_000, numPartitions=7).select((F.col("id") * 7919 % 50_021).alias("k"), F.concat(F.lit("x"), F.col("id") % 11).alias("other"), F.col("id"))
    numbered = frames.numbered_by(rows, "k", "n")
    assert numbered.select("n").distinct().count() == 50_000 and numbered.agg(F.min("n"), F.max("n")).first()[:] == (0, 49_999)
    order = [r.k for r in numbered.orderBy("n").select("k").collect()]
    assert order == sorted(order)
    few = numbered.join(spark.createDataFrame([("x3",)], "other string"), "other").select("k", "n").collect()
    assert all(order[r.n] == r.k for r in few)


def test_sorted_paths(spark):
    rows = [("b", None, 2), ("a", 3, 1), ("a", 1, 1), (None, 1, 1), ("a", None, 1)]
    paths = frames.ensure_columns(spark.createDataFrame(rows, f"{keys.SPECIES} string, species_page int, key_group_number int"), keys.PATH_COLUMNS)
    found = keys.sorted_paths(paths).collect()
    assert [(r[keys.SPECIES], r.species_page, r["index"]) for r in found] == [("a", 1, 0), ("a", 3, 1), ("a", None, 2), ("b", None, 3), (None, 1, 4)]


def test_deep_and_broken_trees(spark):
    chain = [(f"n{i}", f"n{i}", "notice", f"n{i - 1}" if i else None, None, None) for i in range(5000)]
    odd = [("loop", "x", "notice", "loop", None, None), ("below", "x", "notice", "loop", None, None), ("lost", "x", "notice", "nowhere", None, None), ("blank", "x", "notice", "", None, None)]
    nodes = spark.createDataFrame(chain + odd, NODE)
    depth = {r.node_id: r.depth for r in workflow.depths(nodes).collect()}
    assert depth == {f"n{i}": i for i in range(5000)} | {"blank": 0}
    assert sorted(r.subject for r in workflow.cycle_violations(nodes).collect()) == ["below", "loop", "lost"]


def test_documents_and_metadata(spark, tmp_path):
    made = sinks.metadata(spark, command=["run", "x"], commit="abc", versions={"python": "3", "engine": "1"})
    sinks.write_once(made, f"{tmp_path}/m")
    with pytest.raises(Exception, match="exist"):
        sinks.write_once(made, f"{tmp_path}/m")
    row = readers.read_document(spark, f"{tmp_path}/m", "command array<string>, commit string, versions struct<python: string, engine: string>").first()
    assert (row.command, row.commit, row.versions.python) == (["run", "x"], "abc", "3")
    failed = spark.createDataFrame([("a", None), ("b", "late"), ("c", "late")], "task string, error string")
    assert tuple(trials.error_count(failed).first()) == (2, 3)


def test_requests_as_they_arrive(spark):
    body = json.dumps({"threshold": "0.5", "prompts": ["a", " "], "image_base64": "aGk="})
    rows = [(1, body), (2, '{"prompts": "one"}'), (3, "no JSON"), (4, None), (5, "[1]"), (6, '{"threshold": "high"}')]
    got = {r.request_id: r for r in gate.received_requests(spark.createDataFrame(rows, "request_id int, body string")).collect()}
    assert (got[1].threshold, got[1].prompts, got[1].image_base64, got[1].malformed) == (0.5, ["a", " "], "aGk=", False)
    assert got[2].prompts == ["one"] and got[6].threshold is None
    assert [got[i].malformed for i in (2, 3, 4, 5)] == [False, True, True, True]
    keyed = spark.createDataFrame([("k",), ("x",), (None,)], "key string")
    assert [r[0] for r in keyed.select(gate.authorise(F.col("key"), "k")).collect()] == [True, False, False]
    assert all(r[0] for r in keyed.select(gate.authorise(F.col("key"), None)).collect())
    assert hashlib.sha256(b"k").hexdigest() not in str(rows)
