"""Remote embedders under load: refusals, broken and late answers, other orders, bounded requests at once."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from passagework.sources import embedders
from passagework.sources.embedders import OpenAiEmbedder, RemoteEmbedder


@pytest.fixture
def unsteady():
    """Every request fails in one way or another before it is answered."""
    state = {"tries": {}, "answered": [], "now": 0, "most": 0, "lock": threading.Lock(), "times": [], "bad": ["429", "500", "short", "late", "broken"]}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = body.get("content", body.get("input"))
            with state["lock"]:
                n = state["tries"][texts[0]] = state["tries"].get(texts[0], 0) + 1
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["times"].append(time.monotonic())
            how = state["bad"][n - 1] if n <= len(state["bad"]) else "good"
            rows = [[float(t), 1.0] for t in texts]
            time.sleep(0.02 if how != "late" else 0.6)
            with state["lock"]:
                state["now"] -= 1
                if how == "good":
                    state["answered"] += texts
            if how in ("429", "500", "400"):
                self.send_response(int(how))
                self.send_header("Retry-After", "0.01")
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            data = [{"index": k, "embedding": v} for k, v in enumerate(rows)][::-1]
            answer = {"embeddings": rows[1:] if how == "short" else rows, "data": data[1:] if how == "short" else data}
            out = b"{" if how == "broken" else json.dumps(answer).encode()
            try:
                self.send_response(200)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)
            except OSError:
                pass

        def log_message(self, *_) -> None:
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", state
    s.shutdown()


@pytest.mark.parametrize("kind", ["remote", "openai"])
def test_nothing_is_lost_or_embedded_twice(unsteady, kind, monkeypatch):
    url, state = unsteady
    monkeypatch.setattr(embedders, "BATCH", 7)
    monkeypatch.setattr(embedders, "TIMEOUT", 0.3)
    monkeypatch.setenv("OPENAI_API_KEY", "secret")
    texts = [str(k) for k in range(100)]
    how = {"concurrency": 4, "wait": 0.01, "attempts": 6}
    e, model = (RemoteEmbedder(url, **how), "m") if kind == "remote" else (OpenAiEmbedder(url, **how), "text-embedding-3-small")
    assert e.embed(texts, model).tolist() == [[float(k), 1.0] for k in range(100)]
    assert sorted(state["answered"], key=int) == texts and state["most"] <= 4 + 4  # late requests may still be under way
    assert all(n == 6 for n in state["tries"].values()) and len(state["tries"]) == 15


def test_what_cannot_succeed_is_raised(unsteady):
    url, state = unsteady
    state["bad"] = ["400"]
    with pytest.raises(embedders.urllib.error.HTTPError):
        RemoteEmbedder(url, wait=0.01).embed(["1"], "m")
    assert state["tries"]["1"] == 1
    state["bad"] = ["500"] * 9
    with pytest.raises(embedders.urllib.error.HTTPError):
        RemoteEmbedder(url, wait=0.01, attempts=3).embed(["2"], "m")
    assert state["tries"]["2"] == 3


def test_requests_keep_to_the_rate(unsteady, monkeypatch):
    url, state = unsteady
    monkeypatch.setattr(embedders, "BATCH", 1)
    state["bad"] = []
    RemoteEmbedder(url, concurrency=4, rate=20).embed([str(k) for k in range(8)], "m")
    assert state["times"][-1] - state["times"][0] >= 7 / 20 - 0.05
