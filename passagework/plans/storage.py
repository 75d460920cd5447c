"""Queries through stores, streams and indexes: what they hold after series of changes, and their DuckDB SQL.

Each builds its registry from the test tables on storage, changes it by the operators, and reads the result back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Page, ParseConfig, Sliding
from ..functions.variants import kind_of, parsed, shredded
from ..operators import changes, pivots
from ..operators import registry as R
from ..sources.embedders import HashingEmbedder
from ..sources.tables import RegistryStore, new_base
from ..streaming import jobs, membership

SMALL_JSON, SLIDING_JSON = '{"sliding": {"size": 64, "overlap": 16}}', '{"sliding": {"size": 1000, "overlap": 200}}'


def typed(r: R.Registry) -> R.Registry:
    """With the columns' types on storage."""
    cast = lambda name: getattr(r, name).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(R.SCHEMAS[name])])
    return R.Registry(**{name: cast(name) for name in R.SCHEMAS})


def number(name: str = "id"):
    return F.col(name).cast("long")


def _now():
    return F.timestamp_seconds(F.lit(1800000000))


CHANGE_LOG_SQL = f"""
, d AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed_' || id ELSE name END AS name, path, hash, src FROM docs WHERE id % 10 <> 3),
c1 AS (SELECT coalesce(c.id, d.id + 300000000) AS id, d.id AS document_id, CASE WHEN d.id % 4 = 0 THEN '{SLIDING_JSON}' WHEN d.id % 2 = 0 THEN '{SMALL_JSON}' ELSE c.config END AS config
  FROM d LEFT JOIN chunkers c ON c.document_id = d.id WHERE d.id % 2 = 0 OR c.id IS NOT NULL)
SELECT 'documents' AS table_name, id::VARCHAR AS id, name AS a, path AS b FROM d
UNION ALL SELECT 'documents', (min(id) + 500000000)::VARCHAR, 'new', '/new' FROM d WHERE src = 'src1' GROUP BY hash
UNION ALL SELECT 'chunkers', id::VARCHAR, document_id::VARCHAR, config FROM c1
"""


def change_log(r: R.Registry) -> DataFrame:
    """Upserts, updates, a cascade and inserts as deltas; a repeated transaction changes nothing."""
    store = RegistryStore(r.documents.sparkSession)
    r = store.save(typed(r))
    configs = lambda r, keep, text: r.documents.where(keep).select((number() + 300000000).cast("string").alias("id"), F.col("id").alias("document_id"), F.lit(text).alias("config"))
    r = store.save(R.upsert_configs(r, "chunkers", configs(r, number() % 2 == 0, SMALL_JSON), _now()), ("writer", 1))
    r = store.save(R.upsert_configs(r, "chunkers", configs(r, number() % 3 == 0, SLIDING_JSON), _now()), ("writer", 1))  # done before
    names = r.documents.where(number() % 5 == 0).select("id", F.concat(F.lit("renamed_"), "id").alias("name"), "label", "tags")
    r = store.save(R.update_documents(r, names, _now()), ("writer", 2))
    r = store.save(R.delete_documents(r, r.documents.where(number() % 10 == 3).select("id")))
    r = store.save(R.upsert_configs(r, "chunkers", configs(r, number() % 4 == 0, SLIDING_JSON), _now()))
    new = r.documents.where("src = 'src1'").withColumn("id", (number() + 500000000).cast("string")).withColumn("path", F.lit("/new")).withColumn("name", F.lit("new"))
    store.save(R.insert_documents(r, new.unionByName(new)), ("writer", 3))
    r = RegistryStore(store.spark, store.base).load()
    docs = r.documents.select(F.lit("documents").alias("table_name"), "id", F.col("name").alias("a"), F.col("path").alias("b"))
    return docs.unionByName(r.chunkers.select(F.lit("chunkers").alias("table_name"), "id", F.col("document_id").alias("a"), F.col("config").alias("b")))


DELETIONS_SQL = """
, v AS (SELECT vec_id::VARCHAR AS vec_id, collection_id, document_id FROM vectors
  UNION ALL SELECT 'n-' || vec_id, 7, vec_id FROM vectors WHERE vec_id % 5 = 0 AND vec_id IN (SELECT id FROM docs)
    AND NOT (collection_id = 1 AND document_id % 3 = 0 AND document_id IN (SELECT document_id FROM members WHERE collection_id = 1)))
SELECT vec_id, collection_id::VARCHAR AS collection_id, document_id::VARCHAR AS document_id FROM v
WHERE NOT (collection_id = 1 AND document_id % 3 = 0 AND document_id IN (SELECT document_id FROM members WHERE collection_id = 1))
  AND NOT (document_id % 7 = 2 AND document_id IN (SELECT id FROM docs)) AND collection_id <> 2 AND NOT (collection_id = 7 AND document_id % 4 = 1)
"""


def _vector_changes(r: R.Registry) -> RegistryStore:
    """Removals of vectors by membership, document and collection between additions, and a compaction."""
    store = RegistryStore(r.documents.sparkSession)
    r = store.save(typed(r))
    r = store.save(R.delete_embeddings(r, r.embeddings.where((F.col("collection_id") == "1") & (number("document_id") % 3 == 0))))
    some = r.vectors.where(number("vec_id") % 5 == 0).join(r.documents.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    new = some.select(F.concat(F.lit("n-"), "vec_id").alias("vec_id"), F.lit("7").alias("collection_id"), F.col("vec_id").alias("document_id"), "chunk_idx", "content", "embedding")
    members = new.select(F.concat(F.lit("m-"), "document_id").alias("id"), "document_id", "collection_id", _now().alias("created_at"), _now().alias("updated_at"))
    r = store.save(R.add_embeddings(r, members, new))
    r = store.save(R.delete_documents(r, r.documents.where(number() % 7 == 2).select("id")))
    r = store.compact()
    r = store.save(R.delete_collections(r, r.collections.where("id = '2'").select("id")))
    store.save(R.delete_embeddings(r, r.embeddings.where((F.col("collection_id") == "7") & (number("document_id") % 4 == 1))))
    return RegistryStore(store.spark, store.base)


def deletions(r: R.Registry) -> DataFrame:
    """All vectors after these changes."""
    return _vector_changes(r).load().vectors.select("vec_id", "collection_id", "document_id")


COUNTS_SQL = f""", left_v AS (SELECT * FROM (WITH {DELETIONS_SQL.strip().removeprefix(",")})),
m AS (SELECT document_id, collection_id FROM members WHERE NOT (collection_id = 1 AND document_id % 3 = 0)
  UNION ALL SELECT vec_id, 7 FROM vectors WHERE vec_id % 5 = 0 AND vec_id IN (SELECT id FROM docs) AND NOT (collection_id = 1 AND document_id % 3 = 0 AND document_id IN (SELECT document_id FROM members WHERE collection_id = 1))),
left_m AS (SELECT collection_id::VARCHAR AS c, count(*) AS n FROM m WHERE document_id % 7 <> 2 AND collection_id <> 2 AND NOT (collection_id = 7 AND document_id % 4 = 1) GROUP BY 1),
n AS (SELECT collection_id AS c, count(*) AS n FROM left_v GROUP BY 1)
SELECT coalesce(left_m.c, n.c) AS collection_id, coalesce(left_m.n, 0)::BIGINT AS n_documents, coalesce(n.n, 0)::BIGINT AS n_vectors FROM left_m FULL JOIN n ON left_m.c = n.c
"""


def kept_counts(r: R.Registry) -> DataFrame:
    """Memberships and vectors of each collection after these changes, from what each change added and took away."""
    return _vector_changes(r).counts()


PRUNED_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, {score} AS score FROM v q JOIN v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id)::INTEGER AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"""


def pruned(spark: SparkSession, v: DataFrame, name: str) -> DataFrame:
    index = pivots.build(v, f"{new_base(spark)}-pivots", name)
    return pivots.search(index, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5)


def _job_files(spark: SparkSession, rows: DataFrame, place: str) -> None:
    """(id, job_id, field) -> JSON jobs of 100 documents about."""
    of = lambda field: F.collect_list(F.when(F.col("field") == field, F.col("id")))
    rows.groupBy("job_id", F.floor(F.col("id") / 400)).agg(of("add").alias("add"), of("remove").alias("remove")).select("job_id", F.lit("6").alias("collection_id"), "add", "remove").write.json(place)


STREAM_SQL = """
, tt AS (SELECT doc_id, octet_length(encode(regexp_replace(text, '^SPACE|SPACE$', '', 'g'))) AS size FROM documents),
n AS (SELECT doc_id, CASE WHEN size = 0 THEN 0 WHEN size <= 1200 THEN 1 ELSE (size - 200) // 1000 + 1 END::INTEGER AS n FROM tt),
told AS (
  SELECT 'job-1' AS job_id, 'add' AS what, id FROM docs WHERE id % 4 = 1
  UNION ALL SELECT 'job-2', 'again', id FROM docs WHERE id % 8 = 1 UNION ALL SELECT 'job-2', 'removal', id FROM docs WHERE id % 16 = 13
  UNION ALL SELECT 'job-3', 'add', id FROM docs WHERE id % 16 = 13 UNION ALL SELECT 'job-3', 'again', id FROM docs WHERE id % 16 = 5)
SELECT job_id, CASE WHEN what = 'removal' THEN what WHEN what = 'again' AND n > 0 OR n = 0 THEN 'error' ELSE 'addition' END AS kind, id::VARCHAR AS document_id,
  CASE WHEN what = 'add' AND n > 0 THEN n END AS total_chunks, CASE WHEN what = 'again' AND n > 0 THEN 'already exists' WHEN what <> 'removal' AND n = 0 THEN 'chunks cannot be empty' END AS error
FROM told JOIN n ON doc_id = id
"""


def stream_reports(spark: SparkSession, r: R.Registry, texts: DataFrame) -> DataFrame:
    """Job files in three waves through the job stream, one checkpoint, and its reports read as a stream."""
    base = new_base(spark)
    store = RegistryStore(spark, f"{base}/registry")
    store.save(typed(r))
    ids = r.documents.select(number().alias("id"))
    tell = lambda keep, field, job: ids.where(keep).select("id", F.lit(job).alias("job_id"), F.lit(field).alias("field"))
    i = F.col("id")
    waves = [
        tell(i % 4 == 1, "add", "job-1"),
        tell(i % 8 == 1, "add", "job-2").unionByName(tell(i % 16 == 13, "remove", "job-2")),
        tell(i % 16 == 13, "add", "job-3").unionByName(tell(i % 16 == 5, "add", "job-3")),
    ]
    own = texts.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.lit(0).alias("kind"))
    for k, rows in enumerate(waves):
        _job_files(spark, rows, f"{base}/jobs/wave-{k}")
        jobs.start(spark, f"{base}/jobs/*", f"{base}/checkpoint", store.load, store.save, f"{base}/reports", own, [Sliding()], HashingEmbedder(), once=True).awaitTermination()
    out = jobs.report_stream(spark, f"{base}/reports").writeStream.format("parquet").option("checkpointLocation", f"{base}/reports-checkpoint").trigger(availableNow=True).start(f"{base}/read")
    out.awaitTermination()
    return spark.read.schema(f"{jobs.REPORT}, batch int").parquet(f"{base}/read").select("job_id", "kind", "document_id", "total_chunks", "error")


#: Six rounds of changes of each document's membership in one of five collections.
KEYED_STATE_SQL = """WITH log AS (SELECT doc_id, k, doc_id % 5 AS c, CASE WHEN (doc_id * 7 + k * k) % 3 = 0 THEN 'remove' ELSE 'add' END AS action FROM documents, range(6) r(k) WHERE (doc_id + k) % 4 <> 0),
s AS (SELECT *, lag(action) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM log)
SELECT doc_id::VARCHAR AS document_id, c::VARCHAR AS collection_id, k::BIGINT * 1000000000 + doc_id AS number, CASE WHEN action = 'add' THEN 'addition' ELSE 'removal' END AS kind,
  CASE WHEN action = 'add' AND before = 'add' THEN 'already exists' WHEN action = 'remove' AND coalesce(before, 'remove') = 'remove' THEN 'not there' END AS error,
  row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1 AS latest FROM s"""


def keyed_state(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Changes in three micro-batches, each out of order in itself, through keyed state."""
    base, k = new_base(spark), F.col("k")
    log = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where((F.col("doc_id") + k) % 4 != 0)
    action = F.when((F.col("doc_id") * 7 + k * k) % 3 == 0, "remove").otherwise("add")
    log = log.select((k.cast("long") * 1000000000 + F.col("doc_id")).alias("number"), F.concat(F.lit("job-"), k).alias("job_id"), (F.col("doc_id") % 5).cast("string").alias("collection_id"), F.col("doc_id").cast("string").alias("document_id"), action.alias("action"), "k")
    for wave in range(3):
        log.where(F.floor(k / 2) == wave).drop("k").orderBy(F.col("number").desc()).write.json(f"{base}/log/wave-{wave}")
        membership.start(spark, f"{base}/log/*", f"{base}/checkpoint", f"{base}/out", once=True).awaitTermination()
    out = spark.read.schema(membership.RESULT).parquet(f"{base}/out")
    last = F.row_number().over(Window.partitionBy("collection_id", "document_id").orderBy(F.col("number").desc())) == 1
    return out.select("document_id", "collection_id", "number", "kind", "error", last.alias("latest"))


#: Page 1000 of five rows: all lines by price, dearest first.
DEEP_PAGE_SQL = """SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey * 8 + l_linenumber LIMIT 5 OFFSET 4995"""


def deep_page(lines: DataFrame) -> DataFrame:
    keyed = lines.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return R.ordered(keyed, Page(1000, 5, "price")).drop("id")


VARIANTS_SQL = """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not json'
  WHEN doc_id % 4 = 0 THEN '{"sliding": {"size": ' || doc_id || ', "overlap": 7}}'
  WHEN doc_id % 4 = 1 THEN '{"snapping": {"size": ' || doc_id || ', "overlap": 2, "delimiter": ".", "skipF": ["x", "' || lang || '"], "skipB": []}}'
  WHEN doc_id % 4 = 2 THEN '{"semantic": {"size": 3, "threshold": 0.5, "distanceFn": {"minkowski": 3}, "delimiter": "!", "skipF": [], "skipB": ["' || lang || '"]}}'
  ELSE '{"semantic": {"size": 4, "threshold": 0.25, "distanceFn": "cosine", "delimiter": ".", "skipF": [], "skipB": []}}' END AS t FROM documents),
j AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM c),
k AS (SELECT doc_id, j, json_keys(j)[1] AS kind FROM j), b AS (SELECT doc_id, kind, json_extract(j, '$.' || kind) AS b FROM k)
SELECT doc_id, kind, (b->>'$.size')::INTEGER AS size, (b->>'$.overlap')::INTEGER AS overlap, b->>'$.delimiter' AS delimiter, (b->>'$.threshold')::DOUBLE AS threshold,
  CASE WHEN kind = 'semantic' THEN coalesce(CASE WHEN b->>'$.distanceFn.minkowski' IS NOT NULL THEN 'minkowski' END, b->>'$.distanceFn') END AS distance,
  (b->>'$.distanceFn.minkowski')::INTEGER AS power, array_to_string((b->'$.skipF')::VARCHAR[], '|') AS skip_f, array_to_string((b->'$.skipB')::VARCHAR[], '|') AS skip_b FROM b"""


def variants(docs: DataFrame) -> DataFrame:
    """Configurations of all three kinds, and broken ones, parsed once into a variant with shredded columns."""
    i, lang = F.col("doc_id"), F.col("lang")
    text = (
        F.when(i % 5 == 0, "not json")
        .when(i % 4 == 0, F.format_string('{"sliding": {"size": %d, "overlap": 7}}', i))
        .when(i % 4 == 1, F.format_string('{"snapping": {"size": %d, "overlap": 2, "delimiter": ".", "skipF": ["x", "%s"], "skipB": []}}', i, lang))
        .when(i % 4 == 2, F.format_string('{"semantic": {"size": 3, "threshold": 0.5, "distanceFn": {"minkowski": 3}, "delimiter": "!", "skipF": [], "skipB": ["%s"]}}', lang))
        .otherwise('{"semantic": {"size": 4, "threshold": 0.25, "distanceFn": "cosine", "delimiter": ".", "skipF": [], "skipB": []}}')
    )
    out = shredded(docs.select("doc_id", text.alias("config")))
    listed = lambda c: F.array_join(c, "|").alias(c)
    return out.select("doc_id", "kind", "size", "overlap", "delimiter", "threshold", "distance", "power", listed("skip_f"), listed("skip_b"))


UPLOAD_SQL = """
, files AS (SELECT 'page-' || page_id || CASE WHEN page_id % 9 = 0 THEN '.exe' ELSE '.txt' END AS name, sha256(html) AS hash, page_id % 9 <> 0 AS ok FROM pages
  UNION ALL SELECT 'again-' || doc_id || '.md', sha256(text), true FROM documents WHERE doc_id % 10 = 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY name) = 1 AND hash NOT IN (SELECT hash FROM docs) AS fresh FROM files WHERE ok)
SELECT name, CASE WHEN fresh THEN hash END AS hash, CASE WHEN fresh THEN 'sliding' END AS chunker, CASE WHEN fresh THEN 2 END AS skipped_pages, CASE WHEN NOT fresh THEN 'already exists' END AS error FROM seen
UNION ALL SELECT name, NULL, NULL, NULL, 'unsupported file type' FROM files WHERE NOT ok
"""


def uploaded(r: R.Registry, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """All pages as files, and documents that are there already, uploaded into the registry by a plan."""
    ext = F.when(F.col("page_id") % 9 == 0, ".exe").otherwise(".txt")
    files = pages.select(F.concat(F.lit("page-"), "page_id", ext).alias("name"), F.encode("html", "UTF-8").alias("content"))
    files = files.unionByName(docs.where("doc_id % 10 = 0").select(F.concat(F.lit("again-"), "doc_id", F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content")))
    after, errors = changes.upload(typed(r), files, "web", _now(), Sliding(100_000, 0), ParseConfig(1, 2, filters=["x"]))
    new = R.document_configs(replace(after, documents=R.documents(after, "web")))
    good = new.select("name", "hash", kind_of(parsed(F.col("chunk_config"))).alias("chunker"), F.get_json_object("parse_config", "$.end").cast("int").alias("skipped_pages"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("hash", "string"), ("chunker", "string"), ("skipped_pages", "int"))]
    return good.unionByName(errors.select("name", *none, "error"))


SYNC_SQL = """
, gone AS (SELECT id FROM docs WHERE src = 'src4' AND id % 3 = 0)
SELECT 'documents' AS table_name, name AS what FROM docs WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'documents', 'new-' || id || '.md' FROM docs WHERE src = 'src4' AND id % 4 = 0
UNION ALL SELECT 'chunkers', id::VARCHAR FROM chunkers WHERE document_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'embeddings', id::VARCHAR FROM members WHERE document_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vectors', vec_id::VARCHAR FROM vectors WHERE document_id NOT IN (SELECT id FROM gone)
"""


def synced(r: R.Registry) -> DataFrame:
    """The registry after files of one source went and others came."""
    r = typed(r)
    own = r.documents.where("src = 'src4'")
    new = own.where(number() % 4 == 0).select(F.concat(F.lit("new-"), "id", F.lit(".md")).alias("name"), F.concat("path", F.lit(".new")).alias("path"), F.lit("md").alias("ext"), F.sha2("id", 256).alias("hash"))
    after = changes.sync(r, own.where(number() % 3 != 0).select("name", "path", "ext", "hash").unionByName(new), "src4", _now())
    told = lambda table, what: getattr(after, table).select(F.lit(table).alias("table_name"), F.col(what).alias("what"))
    return told("documents", "name").unionByName(told("chunkers", "id")).unionByName(told("embeddings", "id")).unionByName(told("vectors", "vec_id"))


EMBED_SQL = """
, tt AS (SELECT doc_id, octet_length(encode(regexp_replace(text, '^SPACE|SPACE$', '', 'g'))) AS size FROM documents WHERE doc_id % 6 = 0),
n AS (SELECT doc_id, CASE WHEN size <= 1200 THEN 1 ELSE (size - 200) // 1000 + 1 END AS n FROM tt WHERE size > 0),
c AS (SELECT name, provider, id::VARCHAR AS id FROM collections UNION ALL SELECT 'Default_' || p || '_hashing', p, NULL FROM (VALUES ('alpha'), ('gamma')) t(p))
SELECT name, provider, CASE WHEN name = 'Default_gamma_hashing' THEN doc_id::VARCHAR END AS document_id, CASE WHEN name = 'Default_gamma_hashing' THEN n END AS n_vectors
FROM c LEFT JOIN n ON name = 'Default_gamma_hashing'
"""


def embedded(r: R.Registry, docs: DataFrame) -> DataFrame:
    """Default collections, and a sixth of all documents embedded into one of them, twice, which changes nothing more."""
    r = changes.default_collections(typed(r), ["alpha", "gamma"], [("hashing", "hashing-64", 64)], _now())
    r = changes.default_collections(r, ["gamma"], [("hashing", "hashing-64", 64)], _now())
    own = R.filtered(r.collections, name="Default_gamma_hashing").first()["id"]
    texts = docs.where("doc_id % 6 = 0").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    for _ in range(2):
        r = changes.embed_into(r, texts, own, HashingEmbedder(), _now())
    counts = R.vector_counts(r, own).select(F.col("collection_id").alias("id"), "document_id", "n_vectors")
    return r.collections.select("id", "name", "provider").join(counts, "id", "left").drop("id")


def register(query: Callable, on_registry: Callable, registry: Callable, table: Callable, space: str, registry_sql: str) -> None:
    on_registry("store_change_log", CHANGE_LOG_SQL)(change_log)
    on_registry("store_vector_deletions", DELETIONS_SQL)(deletions)
    on_registry("store_kept_counts", COUNTS_SQL)(kept_counts)
    for name, score, order in (("cosine", "list_cosine_similarity(q.e, v.e)", "DESC"), ("euclidean", "list_distance(q.e, v.e)", "ASC")):
        query(f"vec_topk_pruned_{name}", PRUNED_SQL.format(score=score, order=order))(lambda spark, sf_dir, n=name: pruned(spark, table(spark, sf_dir, "embeddings"), n).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score")))
    query("jobs_stream_reports", f"WITH {registry_sql} {STREAM_SQL.replace('SPACE', space)}")(lambda spark, sf_dir: stream_reports(spark, registry(spark, sf_dir), table(spark, sf_dir, "documents")))
    query("plan_upload", f"WITH {registry_sql} {UPLOAD_SQL}")(lambda spark, sf_dir: uploaded(registry(spark, sf_dir), table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")))
    on_registry("plan_sync", SYNC_SQL)(synced)
    query("plan_embed", f"WITH {registry_sql} {EMBED_SQL.replace('SPACE', space)}")(lambda spark, sf_dir: embedded(registry(spark, sf_dir), table(spark, sf_dir, "documents")))
    query("config_variants", VARIANTS_SQL)(lambda spark, sf_dir: variants(table(spark, sf_dir, "documents")))
    query("page_1000", DEEP_PAGE_SQL)(lambda spark, sf_dir: deep_page(table(spark, sf_dir, "lineitem")))
    query("jobs_keyed_state", KEYED_STATE_SQL)(lambda spark, sf_dir: keyed_state(spark, table(spark, sf_dir, "documents")))
