from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import errors as E
from passagework.config import Page, ParseConfig, Semantic, Sliding, Snapping
from passagework.functions.text import file_type, lossy_utf8, unicode_trim
from passagework.functions.vectors import similarity
from passagework.operators import registry as R
from passagework.operators.parsing import docx_text, paged_text, parse, require_type
from passagework.operators.search import top_k, top_k_of_many
from passagework.service import Services
from passagework.sources.embedders import HashingEmbedder, OpenAiEmbedder, embedding, size_of
from passagework.sources.providers import Providers
from passagework.sources.store import FolderStore
from passagework.sources.tables import RegistryStore
from passagework.streaming import jobs


def test_text_functions(spark):
    df = spark.createDataFrame([(" 　 a\x1c\x85", bytearray(b"a\xffb\xc3")), (None, None)], "t string, b binary")
    row, empty = df.select(unicode_trim(F.col("t")).alias("t"), lossy_utf8(F.col("b")).alias("b")).collect()
    assert (row.t, row.b) == ("a\x1c", "a�b�") and (empty.t, empty.b) == (None, None)
    names = ["a.txt", "a.tar.md", "a.TXT", "txt", "a.", ".pdf", "b.exe"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(file_type(F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == ["txt", "md", None, None, None, "pdf", None]
    with pytest.raises(E.UnsupportedFileType):
        require_type("b.exe")


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(*[similarity(n, F.col("a"), F.col("b"), 3 if n == "minkowski" else None).alias(n) for n in ("cosine", "euclidean", "manhattan", "angular", "chebyshev", "dotProduct", "minkowski")]).collect()]
    assert np.allclose(got[0], (2 / np.sqrt(20), np.sqrt(5), 3, np.arccos(2 / np.sqrt(20)) / np.pi, 2, 2, 9 ** (1 / 3)))
    assert got[1][0] is None and got[1][1] == 1.0 and got[2] == (None,) * 7
    with pytest.raises(E.InvalidConfig):
        similarity("near", F.col("a"), F.col("b"))


PAGES = [f"first {k}\n  {k}  \nkeep {k}\r\nDraft {k}\n\n" for k in range(5)]


@pytest.mark.parametrize(("config", "kept"), [(ParseConfig(), [0, 1, 2, 3, 4]), (ParseConfig(1, 1), [1, 2, 3]), (ParseConfig(2, 4, True), [1, 2]), (ParseConfig(0, 6), None), (ParseConfig(0, 4, filters=["^Draft", "t 0"]), [0])])
def test_pages(spark, config, kept):
    got = spark.createDataFrame([(PAGES,)], "p array<string>").select(paged_text(F.col("p"), config).alias("t")).first().t
    if kept is None:
        assert got is None
        return
    drop = lambda line: any(p.strip("^") in line for p in config.filters)
    want = [x for k in kept for x in (f"first {k}", f"keep {k}", f"Draft {k}", "") if not drop(x)]
    assert got == "".join(f"{x}\n" for x in want)


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_docx():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    link = "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>gone</w:t></w:r></w:ins></w:p>"
    text = docx_text(docx(p(" Hello ", " ", "world") + link + f"<w:tbl><w:tr>{cell('a')}{cell('é')}</w:tr></w:tbl>"))
    assert text == "Hello world \nlink \n| a | é |\n|---|----|\n\n"


def test_parse_by_type(spark):
    files = [("a.txt", b"x\xff"), ("b.docx", docx(p("hi"))), ("c.docx", b"no zip"), ("d.pdf", b"one|two"), ("e.exe", b"")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary")
    got = {r.name: (r.text, r.error) for r in parse(df, ParseConfig(1, 0), lambda b: b.decode().split("|")).collect()}
    assert got == {"a.txt": ("x�", None), "b.docx": ("hi \n", None), "c.docx": (None, "empty output"), "d.pdf": ("two\n", None), "e.exe": (None, "unsupported file type")}
    assert {r.name: r.error for r in parse(df).collect()}["d.pdf"] == "no PDF extractor"


def test_top_k(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = [r.vec_id for r in top_k(df, [1.0, 0.0], 4).collect()]
    assert best == [6, 13, 20, 27]
    queries = df.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    many = {(r.query_id, r["rank"]): r.vec_id for r in top_k_of_many(df.where("embedding is not null"), queries, 2).collect()}
    assert many == {(q, k + 1): v for q in range(3) for k, v in enumerate([q, q + 7])}


def test_hashing_embedder(spark):
    e = HashingEmbedder()
    a, b, c = e.embed(["big red dog", "red dog, big.", "Something else entirely"])
    assert np.isclose(a @ b, 1) and a @ c < 0.9 and (e.embed([""])[0] == 0).all()
    assert size_of(e, "hashing-256") == 256
    with pytest.raises(E.InvalidModel):
        e.embed(["x"], "other")
    with pytest.raises(E.InvalidInput):
        OpenAiEmbedder().embed([], "text-embedding-ada-002")
    got = spark.createDataFrame([("big red dog",)], "t string").select(embedding(F.col("t"), e).alias("v")).first().v
    assert np.allclose(got, a)


def test_providers():
    known = Providers(a=1)
    known.register("a", 2)
    known.register("b", 3)
    assert known.get("a") == 2 and known.ids() == ["a", "b"]
    with pytest.raises(E.InvalidProvider):
        known.get("c")


def services(spark, tmp_path, storage: bool = False) -> Services:
    (tmp_path / "files").mkdir()
    store = FolderStore(spark, f"file://{tmp_path}/files")
    return Services(spark, Providers(fs=store), Providers(hashing=HashingEmbedder()), ["local"], storage=RegistryStore(spark, f"file://{tmp_path}/registry") if storage else None)


def test_store(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "inner.txt").write_text("x")
    (tmp_path / "bad.exe").write_text("x")
    store = FolderStore(spark, f"file://{tmp_path}")
    path = store.write("a.txt", b"hello")
    with pytest.raises(E.AlreadyExists):
        store.write("a.txt", b"other")
    assert [(r.name, r.ext, r.length) for r in store.list_files().collect()] == [("a.txt", "txt", 5)]
    assert bytes(store.read().first().content) == b"hello"
    store.delete(path)
    with pytest.raises(E.NotFound):
        store.delete(path)


def test_documents_from_upload_to_delete(spark, tmp_path):
    s = services(spark, tmp_path)
    ids, bad = s.documents.upload("fs", [(" a.txt ", b"One thing. Another thing."), ("b.exe", b"x"), ("c.txt", b"One thing. Another thing."), ("d.md", b"Dogs bark. Cats meow.")])
    assert len(ids) == 2 and bad == {"b.exe": "unsupported file type", "c.txt": "already exists"}
    assert s.documents.upload("fs", [("e.txt", b"Dogs bark. Cats meow.")]) == ([], {"e.txt": "already exists"})
    total, page = s.documents.list(Page(1, 1, "name", False), ready=True)
    assert total == 2 and [r.name for r in page.collect()] == ["a.txt"]
    a = s.registry.documents.where("name = 'a.txt'").first().id
    assert s.documents.content(a) == "One thing. Another thing."
    assert s.documents.chunks(a) == ["One thing. Another thing."]
    assert s.documents.chunk_preview(a, Sliding(10, 0)) == ["One thing.", " Another t", "hing."]
    assert s.documents.chunk_preview(a, Semantic(1, 0.99)) == ["One thing.", "Another thing."]
    before = s.registry.chunkers.where(F.col("document_id") == a).first()
    s.documents.update_chunker(a, Snapping(1, 0))
    after = s.registry.chunkers.where(F.col("document_id") == a).first()
    assert (after.id, after.created_at) == (before.id, before.created_at) and after.config != before.config
    assert s.documents.chunks(a) == ["One thing.", " Another thing."]
    s.documents.update_parser(a, ParseConfig(10, 20, True, ["foo"]))
    assert s.documents.parser(a) == ParseConfig(10, 20, True, ["foo"])
    s.documents.delete(a)
    assert s.registry.chunkers.where(F.col("document_id") == a).isEmpty()
    with pytest.raises(E.NotFound):
        s.documents.get(a)
    assert s.documents.create_default("fs") is None


def test_sync(spark, tmp_path):
    s = services(spark, tmp_path)
    first = s.documents.create_default("fs")
    (tmp_path / "files" / "new.txt").write_text("new text")
    s.documents.sync("fs")
    assert {r.name for r in s.registry.documents.collect()} == {"welcome.txt", "new.txt"}
    new = s.registry.documents.where("name = 'new.txt'").first()
    with pytest.raises(E.NotFound):
        s.documents.chunks(new.id)
    assert s.documents.content(new.id) == "new text"
    (tmp_path / "files" / "welcome.txt").unlink()
    s.documents.sync("fs")
    assert [r.name for r in s.registry.documents.collect()] == ["new.txt"] and s.registry.parsers.where(F.col("document_id") == first).isEmpty()


def test_vectors_from_collection_to_search(spark, tmp_path):
    s = services(spark, tmp_path, storage=True)
    (doc,), _ = s.documents.upload("fs", [("a.txt", b"Dogs bark. Cats meow. Birds sing.")], Snapping(1, 0))
    v = s.vectors
    assert len(v.create_default_collections()) == 1 and v.create_default_collections() == []
    own = v.create_collection("My_collection", "hashing-64", "hashing", "local")
    with pytest.raises(E.AlreadyExists):
        v.create_collection("My_collection", "hashing-64", "hashing", "local")
    with pytest.raises(E.InvalidModel):
        v.create_collection("Other", "none", "hashing", "local")
    v.create_embeddings(doc, own, s.documents.chunks(doc))
    with pytest.raises(E.AlreadyExists):
        v.create_embeddings(doc, own, ["x"])
    assert v.search("cats meow", 1, own) == [" Cats meow."] == v.search("cats meow", 1, name="My_collection", provider="local")
    for bad in ({"name": "My_collection"}, {"provider": "local"}, {}):
        with pytest.raises(E.InvalidInput):
            v.search("x", 1, **bad)
    assert v.count_embeddings(own, doc) == 3 and v.get_embeddings(doc, own) is not None
    shown = v.get_collection_display(own)
    assert shown.document_count == 1 and [d.document_name for d in shown.documents] == ["a.txt"]
    total, listed = v.list_collections_display(Page(1, 10, "name", False))
    assert total == 2 and [r.document_count for r in listed.collect()] == [0, 1]
    total, listed = s.documents.list_display(Page(1, 10, "name"))
    assert [c.collection_name for c in listed.first().collections] == ["My_collection"]
    assert RegistryStore(spark, s.storage.base).load().vectors.count() == 3
    assert v.list_embeddings(Page(), own)[0] == 1
    assert v.delete_embeddings(own, doc) == 3 and v.get_embeddings(doc, own) is None
    v.create_embeddings(doc, own, ["x y"])
    s.documents.delete(doc)
    assert v.count_embeddings(own, doc) == 0 and v.list_embeddings()[0] == 0
    v.delete_collection(own)
    assert v.list_collections()[0] == 1
    assert s.info()["embeddingProviders"] == {"hashing": {"hashing-64": 64, "hashing-256": 256}}


def test_job_stream(spark, tmp_path):
    s = services(spark, tmp_path)
    ids, _ = s.documents.upload("fs", [("a.txt", b"One. Two."), ("b.txt", b"Three. Four.")])
    collection = s.vectors.create_collection("Jobs", "hashing-64", "hashing", "local")
    texts = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, ["One. Two.", " "], strict=True)], "document_id string, text string, kind int")
    (tmp_path / "jobs").mkdir()
    put = lambda name, rows: (tmp_path / "jobs" / name).write_text("\n".join(map(json.dumps, rows)))
    store = RegistryStore(spark, f"file://{tmp_path}/registry")
    store.save(s.registry)

    def run() -> None:
        q = jobs.start(spark, f"file://{tmp_path}/jobs", f"file://{tmp_path}/checkpoint", store.load, store.save, f"file://{tmp_path}/reports", texts, [Snapping(1, 0)], HashingEmbedder(), once=True)
        q.awaitTermination(120)

    put("1.json", [{"job_id": "j1", "collection_id": collection, "add": [*ids, "none", ids[0]], "remove": []}, {"job_id": "j2", "collection_id": "no", "add": ["x"], "remove": []}, {"job_id": "j0", "collection_id": collection, "add": [], "remove": []}])
    run()
    got = sorted((r.job_id, r.kind, r.error, r.total_chunks) for r in spark.read.parquet(f"file://{tmp_path}/reports").collect())
    assert [(a, b, c) for a, b, c, _ in got if c] == [("j1", "error", "already exists"), ("j1", "error", "chunks cannot be empty"), ("j1", "error", "no such document"), ("j2", "error", "no such collection")]
    assert [x for x in got if x[1] == "addition"] == [("j1", "addition", None, 2)]
    assert store.load().vectors.count() == 2
    put("2.json", [{"job_id": "j3", "collection_id": collection, "add": [ids[0]], "remove": [ids[0]]}])
    run()
    kinds = sorted((r.kind, r.error) for r in spark.read.parquet(f"file://{tmp_path}/reports").where("job_id = 'j3'").collect())
    assert kinds == [("error", "already exists"), ("removal", None)] and store.load().vectors.count() == 0


def test_registry_rules(spark):
    r = R.Registry.empty(spark)
    row = spark.createDataFrame([("1", "n", "p", "txt", "h", "s"), ("2", "n", "p", "txt", "h", "s")], "id string, name string, path string, ext string, hash string, src string")
    for name, kind in (("label", "string"), ("tags", "array<string>"), ("created_at", "timestamp"), ("updated_at", "timestamp")):
        row = row.withColumn(name, F.lit(None).cast(kind))
    r = R.insert_documents(R.insert_documents(r, row), row)
    assert [x.id for x in r.documents.collect()] == ["1"]
    with pytest.raises(E.InvalidInput):
        R.ordered(r.documents, Page(sort_by="nothing"))
