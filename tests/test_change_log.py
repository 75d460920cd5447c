"""Change logs, deletion vectors, transactions, replayed batches, keyed state and pruned search."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import errors as E
from passagework.config import Snapping
from passagework.operators import paging, pivots
from passagework.operators import registry as R
from passagework.operators.search import top_k_of_many
from passagework.sources import tables
from passagework.sources.embedders import HashingEmbedder
from passagework.sources.tables import RegistryStore
from passagework.streaming import jobs, membership

AT = "timestamp'2020-01-01 00:00:00'"


def documents(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", "concat('doc ', id) AS name", "concat('/d/', id) AS path", "'txt' AS ext", "id AS hash", "'s' AS src", "CAST(null AS string) AS label", "CAST(null AS array<string>) AS tags", f"{AT} AS created_at", f"{AT} AS updated_at")


def vectors(spark, collection, rows):
    return spark.createDataFrame([(f"{collection}-{d}-{k}", collection, d, k, f"text {d}", [float(k)]) for d, n in rows for k in range(n)], R.SCHEMAS["vectors"])


def members(spark, collection, docs):
    return spark.createDataFrame([(f"{collection}-{d}", d, collection) for d in docs], "id string, document_id string, collection_id string").selectExpr("*", f"{AT} AS created_at", f"{AT} AS updated_at")


def filled(spark, tmp_path, n=200):
    """A store with n documents and one collection that has three vectors of each."""
    store = RegistryStore(spark, f"file://{tmp_path}/registry")
    r = R.Registry.empty(spark)
    names = [f"{k:04d}" for k in range(n)]
    r = R.insert_documents(r, documents(spark, names))
    r = R.add_embeddings(r, members(spark, "c", names), vectors(spark, "c", [(d, 3) for d in names]))
    return store, store.save(r)


def bytes_of(tmp_path) -> int:
    return sum(p.stat().st_size for p in (tmp_path / "registry").rglob("*.parquet"))


def ids_of(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_a_delta_is_read_as_the_latest_rows(spark, tmp_path):
    store, r = filled(spark, tmp_path, 20)
    change = lambda r, ids, name: R.update_documents(r, spark.createDataFrame([(i, name, None, None) for i in ids], "id string, name string, label string, tags array<string>"), F.expr(AT))
    r = store.save(change(r, ["0001", "0002", "none"], "first"))
    r = store.save(change(change(r, ["0002", "0003"], "second"), ["0003"], "third"))  # two changes in one save
    r = store.save(R.delete_documents(r, r.documents.where("id in ('0001', '0004', 'none')").select("id")))
    r = store.save(R.insert_documents(r, documents(spark, ["0001", "new"])))
    r = RegistryStore(spark, store.base).load()
    names = {x.id: x.name for x in r.documents.collect()}
    assert names["0002"] == "second" and names["0003"] == "third" and names["0001"] == "doc 0001" and "0004" not in names and len(names) == 20 and "none" not in names
    assert r.documents.where("id = '0001'").count() == 1 and r.vectors.where("document_id in ('0001', '0004')").count() == 0


def test_what_a_change_writes_grows_with_the_change(spark, tmp_path):
    store, r = filled(spark, tmp_path, 3000)
    before = bytes_of(tmp_path)
    one = spark.createDataFrame([("k", "0007", "{}")], "id string, document_id string, config string")
    r = store.save(R.upsert_configs(r, "chunkers", one, F.expr(AT)))
    r = store.save(R.update_documents(r, spark.createDataFrame([("0007", "n", None, None)], "id string, name string, label string, tags array<string>"), F.expr(AT)))
    assert bytes_of(tmp_path) - before < before / 10
    before = bytes_of(tmp_path)
    r = store.save(R.delete_embeddings(r, spark.createDataFrame([("0007", "c")], "document_id string, collection_id string")))
    assert bytes_of(tmp_path) - before < 10_000 and r.vectors.count() == 3 * 2999
    assert r.vectors.where("document_id = '0007'").count() == 0 and r.embeddings.count() == 2999


def test_deletion_vectors_by_model(spark, tmp_path, monkeypatch):
    """A random series of additions, removals and compactions, against plain Python."""
    monkeypatch.setattr(tables, "MOST_PARTS", 4)
    store, r = filled(spark, tmp_path, 30)
    want = {("c", f"{k:04d}", i) for k in range(30) for i in range(3)}
    rng = random.Random(3)
    for step in range(7):
        if step % 3 == 0:
            c, docs = f"c{step}", [f"{k:04d}" for k in rng.sample(range(30), 8)]
            docs = sorted(set(docs) & set(ids_of(r.documents)))
            r = R.add_embeddings(r, members(spark, c, docs), vectors(spark, c, [(d, 2) for d in docs]))
            want |= {(c, d, i) for d in docs for i in range(2)}
        present = sorted({(c, d) for c, d, _ in want})
        some = rng.sample(present, min(3, len(present)))
        r = R.delete_embeddings(r, spark.createDataFrame([(d, c) for c, d in [*some, ("no", "no")]], "document_id string, collection_id string"))
        want = {x for x in want if (x[0], x[1]) not in some}
        if step == 4:
            r = R.delete_collections(r, spark.createDataFrame([("c0",)], "id string"))
            want = {x for x in want if x[0] != "c0"}
        if step == 5:
            r = R.delete_documents(r, spark.createDataFrame([("0003",), ("0004",)], "id string"))
            want = {x for x in want if x[1] not in ("0003", "0004")}
        r = store.save(r)
        if step == 6:
            r = store.compact()
            m = store.manifest(store.version())
            assert len(m["vectors"]) == 1 and m["deletions"] == [] and not any(t["deltas"] for t in m["tables"].values())
        got = sorted((x.collection_id, x.document_id, x.chunk_idx) for x in RegistryStore(spark, store.base).load().vectors.collect())
        assert got == sorted(want)
        pairs = {(c, d) for c, d, _ in want}
        told = {x.collection_id: (x.n_documents, x.n_vectors) for x in store.counts().collect()}
        assert told == {c: (sum(x == c for x, _ in pairs), sum(x[0] == c for x in want)) for c in {c for c, _ in pairs}}
    assert store.vacuum() and len(store.vacuum()) == 0
    assert sorted((x.collection_id, x.document_id, x.chunk_idx) for x in RegistryStore(spark, store.base).load().vectors.collect()) == sorted(want)


def test_many_deleted_rows_are_left_behind(spark, tmp_path):
    store, r = filled(spark, tmp_path, 12)
    r = store.save(R.delete_embeddings(r, r.embeddings.where("document_id < '0003'")))
    assert len(store.manifest(store.version())["deletions"]) == 1
    r = store.save(R.delete_embeddings(r, r.embeddings.where("document_id < '0006'")))
    assert store.manifest(store.version())["deletions"] == [] and r.vectors.count() == 18


def test_deltas_of_one_size_become_one(spark, tmp_path, monkeypatch):
    store, r = filled(spark, tmp_path, 5)
    depth = []
    for k in range(6):
        r = store.save(R.update_documents(r, spark.createDataFrame([(f"000{k % 3}", f"n{k}", None, None)], "id string, name string, label string, tags array<string>"), F.expr(AT)))
        depth.append(len(store.manifest(store.version())["tables"]["documents"]["deltas"]))
    assert max(depth) < tables.TIER and {x.id: x.name for x in r.documents.collect()} == {"0000": "n3", "0001": "n4", "0002": "n5", "0003": "doc 0003", "0004": "doc 0004"}
    monkeypatch.setattr(tables, "SMALL", 1)
    more = [f"more {k} {'x' * 40}" for k in range(300)]
    r = store.save(R.insert_documents(R.delete_documents(r, r.documents.where("id = '0003'").select("id")), documents(spark, more)))
    assert store.manifest(store.version())["tables"]["documents"]["deltas"] == [] and ids_of(r.documents) == sorted(["0000", "0001", "0002", "0004", *more])


def test_a_repeated_transaction_does_nothing(spark, tmp_path):
    store, r = filled(spark, tmp_path, 3)
    gone = lambda r, i: R.delete_documents(r, spark.createDataFrame([(i,)], "id string"))
    r = store.save(gone(r, "0000"), ("w", 5))
    number = store.version()
    for again in (5, 4):
        r = store.save(gone(r, "0001"), ("w", again))
        assert store.version() == number and ids_of(r.documents) == ["0001", "0002"]
    r = store.save(gone(r, "0001"), ("other", 1))
    assert store.transaction("w") == 5 and store.transaction("other") == 1 and store.transaction("none") is None and ids_of(r.documents) == ["0002"]
    stale = RegistryStore(spark, store.base)
    stale.load()
    store.save(gone(r, "0002"))
    monkey = stale.version
    stale.version = lambda: monkey() - 1  # as a writer that began before
    with pytest.raises(E.AlreadyExists):
        stale.save(gone(stale.loaded[1], "0002"))


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["before the publishing", "after the publishing"])
def test_a_batch_that_is_run_again_tells_what_it_did(spark, tmp_path, where, monkeypatch):
    store, r = filled(spark, tmp_path, 4)
    collection = spark.createDataFrame([("j", "J", "m", "hashing", "local", 64)], "id string, name string, model string, embedder string, provider string, dim int").selectExpr("*", f"{AT} AS created_at", f"{AT} AS updated_at")
    store.save(R.insert_collection(r, collection))
    texts = spark.createDataFrame([(f"{k:04d}", f"One {k}. Two.", 0) for k in range(4)], "document_id string, text string, kind int")
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "1.json").write_text(json.dumps({"job_id": "a", "collection_id": "j", "add": ["0000", "0001", "0002"], "remove": []}))
    publish, fail = RegistryStore.save, [True]

    def failing(self, r, transaction=None):
        if where.startswith("before") and fail:
            fail.clear()
            raise Stop
        out = publish(self, r, transaction)
        if fail:
            fail.clear()
            raise Stop
        return out

    monkeypatch.setattr(RegistryStore, "save", failing)
    run = lambda: jobs.start(spark, f"file://{tmp_path}/jobs", f"file://{tmp_path}/checkpoint", store.load, store.save, f"file://{tmp_path}/reports", texts, [Snapping(1, 0)], HashingEmbedder(), once=True).awaitTermination(120)
    with pytest.raises(Exception, match="Stop"):
        run()
    run()
    (tmp_path / "jobs" / "2.json").write_text(json.dumps({"job_id": "b", "collection_id": "j", "add": ["0003", "0000"], "remove": ["0001"]}))
    run()
    told = sorted((x.job_id, x.kind, x.document_id, x.error) for x in spark.read.parquet(f"file://{tmp_path}/reports").collect())
    assert told == [("a", "addition", "0000", None), ("a", "addition", "0001", None), ("a", "addition", "0002", None), ("b", "addition", "0003", None), ("b", "error", "0000", "already exists"), ("b", "removal", "0001", None)]
    now = RegistryStore(spark, store.base).load()
    assert ids_of(now.embeddings.where("collection_id = 'j'"), "document_id") == ["0000", "0002", "0003"] and now.vectors.where("collection_id = 'j'").count() == 6
    read = jobs.report_stream(spark, f"file://{tmp_path}/reports").writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    read.awaitTermination(60)
    assert spark.table("told").count() == 6


def test_memberships_as_keyed_state(spark, tmp_path):
    """Changes over several batches, some sent twice, against the log in order; memberships to begin with."""
    rng = random.Random(4)
    log = [{"number": k, "job_id": f"j{k}", "collection_id": f"c{rng.randrange(2)}", "document_id": f"d{rng.randrange(4)}", "action": rng.choice(["add", "remove"])} for k in range(60)]
    begin = {("c0", "d0"), ("c1", "d3"), ("c1", "never")}
    start = spark.createDataFrame(sorted(begin), "collection_id string, document_id string")
    (tmp_path / "log").mkdir()
    want, now = [], set(begin)
    for x in log:
        pair, add = (x["collection_id"], x["document_id"]), x["action"] == "add"
        error = None if add != (pair in now) else "already exists" if add else "not there"
        now = now | {pair} if add else now - {pair}
        want.append((x["number"], "addition" if add else "removal", *pair, error))
    for wave in range(3):
        own = log[20 * wave : 20 * wave + 20] + log[:5] + [{"number": 900, "job_id": "x", "collection_id": "c0", "document_id": "d0", "action": "other"}]
        rng.shuffle(own)
        (tmp_path / "log" / f"{wave}.json").write_text("\n".join(map(json.dumps, own)))
        membership.start(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/out", start, once=True).awaitTermination(120)
    got = sorted((x.number, x.kind, x.collection_id, x.document_id, x.error) for x in spark.read.schema(membership.RESULT).parquet(f"file://{tmp_path}/out").collect())
    assert got == want


def test_keyed_state_has_a_bounded_number_of_keys(spark, tmp_path, monkeypatch):
    """Many pairs share few keys, nulls among them, each with its own state and memberships to begin with."""
    monkeypatch.setattr(membership, "BUCKETS", 3)
    (tmp_path / "log").mkdir()
    start = spark.createDataFrame([("c0", f"d{k}") for k in range(0, 40, 2)], "collection_id string, document_id string")
    names = [f"d{k}" for k in range(40)] + [None]
    for wave in range(2):
        rows = [{"number": 100 * wave + k, "job_id": "j", "collection_id": "c0", "document_id": d, "action": "remove" if wave else "add"} for k, d in enumerate(names)]
        (tmp_path / "log" / f"{wave}.json").write_text("\n".join(map(json.dumps, rows)))
        query = membership.start(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/out", start, once=True)
        query.awaitTermination(120)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = {(x.number, x.kind, x.document_id, x.error) for x in spark.read.schema(membership.RESULT).parquet(f"file://{tmp_path}/out").collect()}
    first = {(k, "addition", d, "already exists" if k < 40 and k % 2 == 0 else None) for k, d in enumerate(names)}
    assert got == first | {(100 + k, "removal", d, None) for k, d in enumerate(names)}


@pytest.mark.parametrize("name", ["cosine", "euclidean"])
@pytest.mark.parametrize("rows", [1024, 7])
def test_pruned_search_is_exact(spark, tmp_path, name, rows, monkeypatch):
    monkeypatch.setattr(pivots, "SHARD_ROWS", rows)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 6)) * 20
    data = [(i, (centres[i % 30] + rng.normal(size=6) * 0.1).tolist()) for i in range(900)]
    data += [(2000 + i, data[3][1]) for i in range(5)] + [(3000, None), (3001, [None] * 6), (3002, [float("nan")] * 6), (3003, [1.0, 2.0]), (None, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("cluster", F.lit(1))
    queries = df.where("vec_id % 20 = 0 or vec_id in (3, 3001)").withColumnRenamed("vec_id", "query_id")
    index = pivots.build(df, f"file://{tmp_path}/index", name)
    got = pivots.search(index, queries, 9).collect()
    usable = df.where("vec_id not in (3000, 3001, 3002, 3003)")
    if name == "cosine":
        want = top_k_of_many(usable, queries.where("query_id < 3000"), 9).collect()
    else:
        want = []
        ok = [(i, np.array(v)) for i, v in data if i is not None and i < 3000]
        for q, v in [(i, v) for i, v in ok if i % 20 == 0 or i == 3]:
            best = sorted((round(float(np.sqrt(((v - x) ** 2).sum())), 9), i) for i, x in ok)[:9]
            want += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    assert [(a, b, c, round(d, 6)) for a, b, c, d in sorted(map(lambda r: (r[0], r[1], r[2], r[3]), got))] == [(a, b, c, round(d, 6)) for a, b, c, d in sorted(tuple(r)[:4] for r in want)]
    assert all(r["of"] == 905 and r.scored < 400 for r in got)
    assert pivots.search(pivots.build(df.where("false"), f"file://{tmp_path}/none", name), queries).collect() == []
    few = pivots.search(pivots.build(df.where("vec_id < 3"), f"file://{tmp_path}/few", name), queries.where("query_id = 3"), 9, skip_own=True).collect()
    assert sorted(r.vec_id for r in few) == [0, 1, 2]
    with pytest.raises(E.InvalidConfig):
        pivots.build(df, f"file://{tmp_path}/x", "manhattan")


@pytest.mark.parametrize("descending", [True, False])
def test_deep_pages(spark, descending, monkeypatch):
    """Ties, nulls and repeated values, over every place where ranges meet."""
    monkeypatch.setattr(paging, "SHALLOW", 3)
    monkeypatch.setattr(paging, "FEW", 20)
    monkeypatch.setattr(paging, "CUTS", 5)
    rng = random.Random(6)
    data = [(k, rng.choice([None, 1, 1, 2, 3, rng.randrange(50), 7])) for k in range(400)] + [(None, 4), (None, None)]
    df = spark.createDataFrame(data, "id long, v int").repartition(4)
    key = lambda r: ((r[1] is not None, -(r[1] or 0)) if descending else (r[1] is None, r[1] or 0), (r[0] is not None, r[0] or 0))
    want = sorted(data, key=key)
    for offset, limit in ((4, 3), (50, 60), (133, 20), (399, 10), (500, 5)):
        got = [tuple(r) for r in paging.page(df, "v", "id", descending, offset, limit).collect()]
        assert got == want[offset : offset + limit]
    same = spark.createDataFrame([(k, 1) for k in range(300)], "id long, v int")
    assert [r.id for r in paging.page(same, "v", "id", descending, 250, 9).collect()] == list(range(250, 259))
    assert paging.page(df.where("false"), "v", "id", descending, 10, 5).collect() == []


def test_listings_nest_only_what_they_show(spark, tmp_path):
    store, r = filled(spark, tmp_path, 10)
    from passagework.config import Page

    plan = R.documents_display(r, Page(1, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_set") < plan.index("LeftSemi")  # the semi join stands below the aggregate
    shown = R.documents_display(r, Page(2, 3, "id", False)).collect()
    assert [x.id for x in shown] == ["0003", "0004", "0005"]


def test_a_service_searches_its_index(spark, tmp_path):
    from test_storage_and_models import services

    s = services(spark, tmp_path)
    c = s.vectors.create_collection("One", "hashing-64", "hashing", "local")
    words = ["apple pear", "pear plum", "stone road", "road tree", "apple plum"]
    ids, _ = s.documents.upload("fs", [(f"{k}.txt", w.encode()) for k, w in enumerate(words)])
    for d, w in zip(ids, words, strict=True):
        s.vectors.create_embeddings(d, c, [w])
    plain = s.vectors.search("apple pear plum", 3, c)
    assert s.vectors.build_index(c) == 5 and s.vectors.search("apple pear plum", 3, c) == plain and plain[0] in words
    s.vectors.delete_embeddings(c, ids[words.index(plain[0])])
    assert plain[0] not in s.vectors.search("apple pear plum", 3, c)  # the index is of another version


def test_sql_similarities_are_the_native_ones(spark):
    from passagework.functions.vectors import similarity
    from passagework.operators.chunking import register

    register(spark)
    rows = [([1.0, 2.0, -3.0], [0.5, -1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), ([1.0, None], [2.0, 3.0]), (None, [1.0]), ([3.0, 4.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for name in ("cosine", "euclidean", "manhattan", "angular", "chebyshev", "dotProduct", "minkowski"):
        got = df.select(F.expr(f"vector_similarity('{name}', a, b)").alias("x"), similarity(name, F.col("a"), F.col("b"), 3 if name == "minkowski" else None).alias("y")).collect()
        assert [r.x is None for r in got] == [r.y is None for r in got] and all(r.x is None or abs(r.x - r.y) < 1e-12 for r in got), name
    four = spark.sql("SELECT vector_similarity('minkowski', array(1D, 2D), array(3D, 5D), 4) AS v").first().v
    assert abs(four - (2**4 + 3**4) ** 0.25) < 1e-12


@pytest.mark.parametrize("name", ["cosine", "euclidean"])
def test_pruned_search_broadcasts_no_queries(spark, tmp_path, name, monkeypatch):
    """Packed queries, a copy for each cluster, were broadcast through the driver, as Spark took them for small. Clusters in groups,
    some over a group's rows, give what scoring everything gives."""
    monkeypatch.setattr(pivots, "SHARD_ROWS", 16)
    monkeypatch.setattr(pivots, "GROUP_ROWS", 40, raising=False)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 4))
    v[:150] = v[0] + rng.normal(size=(150, 4)) * 1e-3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = pivots.search(pivots.build(df, f"file://{tmp_path}/index", name), df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q, ids in got.items():
        score = -(unit @ unit[q]) if name == "cosine" else np.linalg.norm(v - v[q], axis=1)
        assert ids == np.argsort(score, kind="stable")[:5].tolist()
    assert len(got) == 25
