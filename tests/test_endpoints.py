"""Clients against a server in this process: batches, pauses, hard ends, mending calls."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import responses as R
from quern.operators import tree
from quern.plans import service
from quern.sources import endpoints
from quern.sources.endpoints import Endpoint


@pytest.fixture()
def server():
    """Calls are kept as (time, path, payload); ``answer`` (payload, number) gives (status, headers, body)."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            payload = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                calls.append((time.monotonic(), self.path, payload))
                number = len(calls)
            status, headers, body = self.server.answer(payload, number)
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            try:
                for part in body if isinstance(body, list) else [body]:
                    self.wfile.write(part.encode())
                    self.wfile.flush()
                    if isinstance(body, list):
                        time.sleep(0.2)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    calls, lock = [], threading.Lock()
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.calls, s.url = calls, f"http://127.0.0.1:{s.server_address[1]}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def vectors(payload, _):
    return 200, {}, json.dumps({"embeddings": [[float(len(t)), 1.0] for t in payload["input"]]})


def said(text):
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}}]})


def test_embeddings_go_in_batches(spark, server):
    server.answer = vectors
    texts = [(i, f"text {'x' * (i % 150)}") for i in range(300)] + [(300, None), (301, "")]
    rows = spark.createDataFrame(texts, "i int, t string").coalesce(1)
    got = {r.i: r.v for r in rows.select("i", endpoints.embedder(Endpoint(server.url, "m", "key"))(F.col("t")).alias("v")).collect()}
    sizes = sorted(len(p["input"]) for _, _, p in server.calls)
    assert sizes == [23, 64, 64] and {p for _, p, _ in server.calls} == {"/api/embed"}  # 151 different texts, once each
    assert got[300] is None and got[301] == [0.0, 1.0] and abs(sum(x * x for x in got[7]) - 1) < 1e-6


def test_pauses_and_pace(server):
    server.answer = lambda p, n: (429, {"Retry-After": "0.6"}, "") if n == 1 else (503, {}, "") if n == 2 else (200, {}, "yes")
    assert endpoints.post(Endpoint(server.url, "m", delay=0.1), "/x", {}) == "yes"
    a, b, c = (t for t, _, _ in server.calls)
    assert b - a >= 0.6 and 0.15 <= c - b < 0.6
    server.calls.clear()
    server.answer = lambda p, n: (200, {}, "yes")
    paced = Endpoint(server.url, "m", pace=0.2, threads=4)
    endpoints._each(paced, range(5), lambda i: endpoints.post(paced, "/x", {"i": i}))
    times = sorted(t for t, _, _ in server.calls)
    assert len(times) == 5 and all(y - x > 0.1 for x, y in zip(times, times[1:], strict=False))  # threads share the pace
    assert endpoints.retry_after("2") == 2 and endpoints.retry_after(None) is endpoints.retry_after("soon") is None
    assert endpoints.retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0


def test_hard_ends_and_refusals(server):
    server.answer = lambda p, n: (200, {}, ["slow"] * 50)
    began = time.monotonic()
    with pytest.raises(OSError):
        endpoints.post(Endpoint(server.url, "m", timeout=0.7), "/x", {})
    assert time.monotonic() - began < 2  # an answer that trickles does not hold the call
    server.calls.clear()
    server.answer = lambda p, n: (503, {"Retry-After": "60"}, "")
    with pytest.raises(TimeoutError):
        endpoints.post(Endpoint(server.url, "m", timeout=1), "/x", {})
    assert len(server.calls) == 1
    server.calls.clear()
    server.answer = lambda p, n: (400, {}, "")
    with pytest.raises(OSError):
        endpoints.post(Endpoint(server.url + "/", "m"), "/x", {})
    assert len(server.calls) == 1  # a refusal is not asked again


def test_chat_and_vision(spark, server):
    server.answer = lambda p, n: said("seen") if isinstance(p["messages"][0]["content"], list) else said(f"to {p['messages'][0]['content']}") if p["messages"][0]["content"] != "bad" else (400, {}, "")
    to = Endpoint(server.url, "m")
    rows = spark.createDataFrame([("one", b"abc"), ("one", None), ("bad", b""), (None, b"x")], "p string, c binary").coalesce(1)
    got = rows.select(R.message(endpoints.chat(to)(F.col("p"))).alias("a"), R.message(endpoints.vision(to, "what")(F.col("c"))).alias("b")).collect()
    assert [tuple(r) for r in got] == [("to one", "seen"), ("to one", ""), ("", "seen"), ("", "seen")]
    texts = [p["messages"][0]["content"] for _, _, p in server.calls]
    assert texts.count("one") == 1 and any(isinstance(t, list) and t[1]["image_url"]["url"] == "data:image/png;base64,YWJj" for t in texts)


SENTENCE = "The stone stands by the river. Its letters are old. "


def test_windows_are_asked_again_only_where_refused(spark, server):
    good = json.dumps({"chunks": [SENTENCE.strip()] * 4})

    def answer(p, n):
        prompt = p["messages"][0]["content"]
        return said(good if "Title: one" in prompt or "not a list of exact" in prompt else '["A short summary"]')

    server.answer = answer
    ask = endpoints.chat(Endpoint(server.url, "m"))
    rows = spark.createDataFrame([("a", "one", SENTENCE * 4), ("b", "two", SENTENCE * 4), ("c", "short", "few words"), ("d", "none", None)], "node_id string, title string, text string").coalesce(1)
    got = {r.node_id: r.chunks for r in R.chunk_rows(rows, [ask, ask, ask], 150, 0).collect()}
    assert got == {"a": [SENTENCE.strip()] * 4, "b": [SENTENCE.strip()] * 4, "c": ["few words"], "d": []}
    assert len(server.calls) == 4  # one call for the first, two and a mending one for the second
    server.answer = lambda p, n: (400, {}, "")
    refused = R.chunk_rows(rows, [ask], 150, 0).where("node_id = 'a'").first().chunks
    assert " ".join(refused).count("stone") == 4 and max(map(len, refused)) <= 150


def test_service_with_models(spark, server, tmp_path, monkeypatch):
    def answer(p, n):
        if "input" in p:
            return vectors(p, n)
        prompt = p["messages"][0]["content"]
        return said("The model's answer.") if prompt.startswith("Answer the question") else said(json.dumps([SENTENCE.strip()] * 30))

    server.answer = answer
    monkeypatch.setenv("RAG_OLLAMA_ENDPOINT", server.url)
    settings = Settings.load(env={"RAG_SEGMENTER_ENDPOINT": server.url, "RAG_ANSWER_ENDPOINT": server.url, "RAG_CHUNK_SIZE": "200", "RAG_CHUNK_OVERLAP": "0"})
    r = service.Retrieval(spark, settings, f"file://{tmp_path}/i", "ollama:some-model")
    out = r.ingest(spark.createDataFrame([("b", "Book")], "book_id string, title string"), spark.createDataFrame([("b", 1, SENTENCE * 30, [], [])], tree.PAGES))
    assert out["book_nodes"] == 3 + 30  # the model's chunks, not the rules'
    asked = spark.createDataFrame([(1, "Where does the stone stand?")], "query_id bigint, query string")
    assert r.query(asked, 2, 1).first().answer == "The model's answer."
    for env, error in (({"RAG_SEGMENTER_MODE": "odd"}, "not known"), ({}, "endpoint")):
        with pytest.raises(ValueError, match=error):
            service.segmenter(Settings.load(env=env))
    assert service.segmenter(Settings.load(env={"RAG_SEGMENTER_MODE": "rules"})) is None
    with pytest.raises(ValueError):
        service.embedder("ollama: ")
