from __future__ import annotations

import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import errors as E
from passagework import service
from passagework.operators.pdf import pdf_text
from passagework.service import Services
from passagework.sources import embedders
from passagework.sources.embedders import HashingEmbedder, LocalEmbedder, OpenAiEmbedder, RemoteEmbedder, embedding
from passagework.sources.providers import Providers
from passagework.sources.store import FolderStore
from passagework.sources.tables import RegistryStore


def services(spark, tmp_path) -> Services:
    (tmp_path / "files").mkdir()
    store = FolderStore(spark, f"file://{tmp_path}/files")
    return Services(spark, Providers(fs=store), Providers(hashing=HashingEmbedder()), ["local"], storage=RegistryStore(spark, f"file://{tmp_path}/registry"))


def test_a_read_opens_the_files_that_are_asked_for(spark, tmp_path, monkeypatch):
    store = FolderStore(spark, f"file://{tmp_path}")
    paths = {n: store.write(n, n.encode()) for n in ("a[1].txt", "a1.txt", "b {x}.md", "c*.txt", "cd.txt")}
    files = {r.name: r.path for r in store.list_files().collect()}
    assert set(files) == set(paths)
    for names in (["a[1].txt"], ["c*.txt", "b {x}.md"], []):
        asked = spark.createDataFrame([(files[n],) for n in names] * 2, "path string")
        got = store.read(asked)
        assert sorted((r.name, bytes(r.content)) for r in got.collect()) == sorted((n, n.encode()) for n in names)
        assert len(got.inputFiles()) == len(names) or not names
    monkeypatch.setattr("passagework.sources.store.FEW_PATHS", 1)
    assert {r.name for r in store.read(spark.createDataFrame([(files[n],) for n in ("a1.txt", "cd.txt")], "path string")).collect()} == {"a1.txt", "cd.txt"}


def written(tmp_path) -> set[str]:
    return {str(p.relative_to(tmp_path / "registry")) for p in (tmp_path / "registry").rglob("*.parquet")}


def test_a_change_writes_what_it_changes(spark, tmp_path):
    s = services(spark, tmp_path)
    ids, _ = s.documents.upload("fs", [(f"{k}.txt", f"Text {k}. More of it.".encode()) for k in range(3)])
    one, two = (s.vectors.create_collection(n, "hashing-64", "hashing", "local") for n in ("One", "Two"))
    for c in (one, two):
        for d in ids:
            s.vectors.create_embeddings(d, c, ["x y", "y z"])
    assert s.registry.vectors.count() == 12
    before = written(tmp_path)
    s.documents.update(ids[0], "new.txt")
    new = written(tmp_path) - before
    assert {p.split("/")[1] for p in new} == {"documents"} and s.documents.get(ids[0])["name"] == "new.txt"
    before = written(tmp_path)
    assert s.vectors.delete_embeddings(one, ids[0]) == 2
    new = written(tmp_path) - before
    assert {p.split("/")[1] for p in new} == {"embeddings", "vectors-touched"} and all(f"collection_id={one}" in p for p in new if "vectors" in p)
    assert s.vectors.count_embeddings(one, ids[1]) == 2 and s.registry.vectors.count() == 10
    again = RegistryStore(spark, s.storage.base).load()
    assert again.vectors.count() == 10 and again.vectors.where(F.col("collection_id") == two).count() == 6
    assert s.documents.delete(ids[1]) == 1 and s.registry.vectors.count() == 6
    assert s.vectors.delete_collection(two) == 1 and {r.collection_id for r in s.registry.vectors.collect()} == {one}
    assert s.vectors.search("y z", 1, one) == ["y z"]


def test_many_parts_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("passagework.sources.tables.MOST_PARTS", 3)
    s = services(spark, tmp_path)
    ids, _ = s.documents.upload("fs", [(f"{k}.txt", f"Text {k}.".encode()) for k in range(4)])
    c = s.vectors.create_collection("One", "hashing-64", "hashing", "local")
    sizes = []
    for d in ids:
        s.vectors.create_embeddings(d, c, ["x"])
        sizes.append(len(s.storage.manifest(s.storage.version())["vectors"]))
    assert max(sizes) <= 3 and s.registry.vectors.count() == 4


def test_a_second_writer_is_told(spark, tmp_path):
    s = services(spark, tmp_path)
    s.documents.upload("fs", [("a.txt", b"x y")])
    number = s.storage.version()
    with pytest.raises(E.AlreadyExists):
        s.storage._publish(number, {"tables": {}, "vectors": []})
    assert s.storage.version() == number and RegistryStore(spark, s.storage.base).load().documents.count() == 1


def test_limits_and_rows_affected(spark, tmp_path, monkeypatch):
    s = services(spark, tmp_path)
    monkeypatch.setattr(service, "UPLOAD_BYTES", 10)
    with pytest.raises(E.InvalidInput):
        s.documents.upload("fs", [("a.txt", b"123456"), ("b.txt", b"789012")])
    (a, b), bad = s.documents.upload("fs", [(" a.txt ", b"12345"), ("b.txt", b"6789")])
    assert not bad and s.documents.get(a)["name"] == "a.txt"
    assert s.documents.update("none", "x") == 0 and s.documents.update(a, "z.txt", "label", ["t"]) == 1
    assert tuple(s.documents.get(a)[c] for c in ("name", "label", "tags")) == ("z.txt", "label", ["t"])
    path = s.documents.get(b)["path"]
    assert s.documents.delete_by_path(path) == 1 and s.documents.delete_by_path(path) == 0
    assert [json.loads(c) and next(iter(json.loads(c))) for c in s.info()["defaultChunkers"]] == ["sliding", "snapping", "semantic"]


def pdf(pages: list[bytes], flate: bool = True) -> bytes:
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0010> <00E9> endbfchar"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 << /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >> >> >> >>" % kids, b"<< /Type /Font /Subtype /Type1 >>"]
    objects.append(b"<< /Length %d >> stream\n%s\nendstream" % (len(cmap), cmap))
    for k, content in enumerate(pages):
        data = zlib.compress(content) if flate else content
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * k))
        objects.append(b"<< /Length %d %s >>\nstream\r\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if flate else b"", data))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


@pytest.mark.parametrize("flate", [True, False])
def test_text_of_pdf(spark, tmp_path, flate):
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) world) Tj 0 -14 Td [(sp)-300(lit) 10 (ted)] TJ T* (caf\\351) Tj ET"
    second = b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <000100020003> Tj 1 0 0 1 72 680 Tm <0010> Tj ET"
    data = pdf([first, second], flate)
    assert pdf_text(data) == ["Hello (big) world\nsp litted\ncafé\n", "ABC\né\n"]
    assert pdf_text(b"no pdf") == [] and pdf_text(b"%PDF-1.4 1 0 obj << /Type") == []
    s = services(spark, tmp_path)
    (doc,), _ = s.documents.upload("fs", [("a.pdf", data)])
    assert s.documents.content(doc) == "Hello (big) world\nsp litted\ncafé\nABC\né\n"


def field(number: int, value: bytes | int) -> bytes:
    def varint(x: int) -> bytes:
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def onnx(table: np.ndarray) -> bytes:
    """A model that looks up each token's row: input_ids -> last_hidden_state."""
    tensor = b"".join(field(1, n) for n in table.shape) + field(2, 1) + field(8, b"rows") + field(9, table.astype("<f4").tobytes())
    shape = lambda names: b"".join(field(1, field(2, n)) for n in names)
    value = lambda name, kind, names: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(names))))
    node = field(1, b"rows") + field(1, b"input_ids") + field(2, b"last_hidden_state") + field(4, b"Gather")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value(b"input_ids", 7, [b"n", b"l"])) + field(12, value(b"last_hidden_state", 1, [b"n", b"l", b"d"]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_local_models(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer, models, pre_tokenizers

    monkeypatch.setitem(embedders.LOCAL_MODELS, "own/mean", 3)
    monkeypatch.setitem(embedders.LOCAL_MODELS, "own/bge", 3)
    rows = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0], [0, 0, 4]], float)
    for name in ("mean", "bge"):
        folder = tmp_path / "own" / name
        folder.mkdir(parents=True)
        (folder / "model.onnx").write_bytes(onnx(rows))
        t = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "c": 3}, unk_token="[UNK]"))
        t.pre_tokenizer = pre_tokenizers.Whitespace()
        t.save(str(folder / "tokenizer.json"))
    e = LocalEmbedder(str(tmp_path))
    assert np.allclose(e.embed(["a", "b c", ""], "own/mean"), [[1, 0, 0], [0, 1 / 5**0.5, 2 / 5**0.5], [0, 0, 0]])
    assert np.allclose(e.embed(["b c", "c b"], "own/bge"), [[0, 1, 0], [0, 0, 1]]) and e.embed([], "own/bge").shape == (0, 3)
    with pytest.raises(E.InvalidModel):
        e.embed(["a"], "Xenova/bge-small-en-v1.5")
    with pytest.raises(E.InvalidModel):
        e.embed(["a"], "none")


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer({"m": 2})

        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            texts = body.get("content", body.get("input"))
            vectors = [[float(len(t)), 1.0] for t in texts]
            self._answer({"embeddings": vectors} if self.path == "/embed" else {"data": [{"embedding": v} for v in vectors]})

        def log_message(self, *_) -> None:
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_remote_embedders_against_a_server(spark, server, monkeypatch):
    url, seen = server
    e = RemoteEmbedder(url + "/")
    assert e.models() == {"m": 2} and e.embed(["ab", "c"], "m").tolist() == [[2, 1], [1, 1]]
    assert seen[-1][:2] == ("/embed", {"model": "m", "content": ["ab", "c"]})
    assert e.embed(["x"] * 600, "m").shape == (600, 2) and [len(b["content"]) for _, b, _ in seen[1:]] == [256, 256, 88]
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert sorted(tuple(r.v) for r in df.select(embedding(F.col("t"), e, "m").alias("v")).collect()) == [(0.0, 1.0), (3.0, 1.0)]
    monkeypatch.setenv("OPENAI_API_KEY", "secret")
    o = OpenAiEmbedder(url + "/v1/embeddings")
    assert o.embed(["abcd"], "text-embedding-3-small").tolist() == [[4, 1]]
    assert seen[-1] == ("/v1/embeddings", {"model": "text-embedding-3-small", "input": ["abcd"]}, "Bearer secret")
    with pytest.raises(E.InvalidModel):
        o.embed(["x"], "none")
