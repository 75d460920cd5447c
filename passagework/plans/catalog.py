"""All named queries of the library (without those of the optional subpackage) and their DuckDB SQL.

The registry that the listings and changes run on is derived from the test tables by the same rules in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Page, ParseConfig, Semantic, Sliding, Snapping
from ..functions.text import content_hash, file_type, lossy_utf8, once
from ..functions.vectors import doubles, similarity
from ..operators import registry as R
from ..operators.chunking import chunk_rows, semantic, sentence_groups, snapping
from ..operators.parsing import paged_text
from ..operators.search import top_k, top_k_of_many
from ..service import embed_documents
from ..sources.embedders import HashingEmbedder, embedding
from ..sources.store import ingest
from ..streaming.jobs import run_jobs
from . import sentences_sql, services, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- chunks ---

# Fixed value: Unicode White_Space for DuckDB's patterns.
_SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sliding_sql(size: int, overlap: int) -> str:
    """CTE windows(doc_id, lang, chunk_idx, chunk)."""
    starts_char = "substr(h, CAST(2 * ({}) + 1 AS BIGINT), 1) NOT IN ('8', '9', 'A', 'B')"
    return f"""
t AS (SELECT doc_id, lang, regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, lang, hex(encode(t)) AS h, octet_length(encode(t)) AS size FROM t WHERE t <> ''),
w AS (SELECT *, unnest(range(CASE WHEN size <= {size + overlap} THEN 1 ELSE (size - {overlap}) // {size} + 1 END)) AS k FROM b),
e AS (SELECT *, CASE WHEN size <= {size + overlap} THEN 0 ELSE greatest(k * {size} - {overlap}, 0) END AS s0,
             CASE WHEN size <= {size + overlap} THEN size ELSE least((k + 1) * {size} + {overlap}, size) END AS e0 FROM w),
c AS (SELECT *, CASE WHEN s0 = 0 THEN 0 ELSE list_max(list_transform(range(4), lambda j: CASE WHEN {starts_char.format("s0 - j")} THEN s0 - j END)) END AS s1,
             CASE WHEN e0 >= size THEN size ELSE list_min(list_transform(range(4), lambda j: CASE WHEN e0 + j >= size THEN size WHEN {starts_char.format("e0 + j")} THEN e0 + j END)) END AS e1 FROM e),
windows AS (SELECT doc_id, lang, k::INTEGER AS chunk_idx, decode(unhex(substr(h, CAST(2 * s1 + 1 AS BIGINT), CAST(2 * (e1 - s1) AS BIGINT)))) AS chunk FROM c)"""


def _sliding(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    return chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), Sliding(size, overlap))


for _name, _size, _overlap in (("default", 1000, 200), ("small", 64, 16), ("no_overlap", 500, 0)):
    query(f"chunk_sliding_{_name}", f"WITH {sliding_sql(_size, _overlap)} SELECT doc_id, chunk_idx, chunk FROM windows")(
        lambda spark, sf_dir, size=_size, overlap=_overlap: _sliding(spark, sf_dir, size, overlap).select("doc_id", "chunk_idx", "chunk")
    )


@query("chunk_stats_by_lang", f"WITH {sliding_sql(1000, 200)} SELECT lang, count(*) AS n_chunks, round(avg(octet_length(encode(chunk))), 6) AS avg_bytes, max(octet_length(encode(chunk)))::INTEGER AS max_bytes FROM windows GROUP BY lang")
def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("chunk")
    return _sliding(spark, sf_dir, 1000, 200).groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(size), 6).alias("avg_bytes"), F.max(size).alias("max_bytes"))


@query(
    "chunk_neighbours",
    f"""WITH {sliding_sql(1000, 200)}
SELECT doc_id, chunk_idx, sha256(lag(chunk) OVER o) AS previous_hash, sha256(lead(chunk) OVER o) AS next_hash FROM windows WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_idx)""",
)
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.partitionBy("doc_id").orderBy("chunk_idx")
    rows = _sliding(spark, sf_dir, 1000, 200)
    return rows.select("doc_id", "chunk_idx", content_hash(F.lag("chunk").over(o)).alias("previous_hash"), content_hash(F.lead("chunk").over(o)).alias("next_hash"))


for _name, _config in (("default", Snapping()), ("small", Snapping(200, 1))):
    query(f"chunk_snapping_{_name}", sentences_sql.snapping_sql(_config.size, _config.overlap))(
        lambda spark, sf_dir, c=_config: table(spark, sf_dir, "documents").select("doc_id", F.posexplode(snapping(F.col("text"), c)).alias("chunk_idx", "chunk"))
    )


@query("split_sentences", f"WITH {sentences_sql.groups_sql(1)} SELECT doc_id, g AS sentence_idx, content AS sentence FROM grouped")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_groups(F.col("text"))).alias("sentence_idx", "sentence"))


@query("sentence_groups_of_ten", f"WITH {sentences_sql.groups_sql(10)} SELECT doc_id, g AS group_idx, content AS sentences FROM grouped")
def sentence_groups_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_groups(F.col("text"), 10)).alias("group_idx", "sentences"))


@query("chunk_semantic", sentences_sql.semantic_sql(10, 0.5))
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic(F.col("text"), Semantic(threshold=0.5), HashingEmbedder().embed)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(out).alias("chunk_idx", "chunk"))


def _clusters(name: str, threshold: float, best: bool = False) -> Query:
    config = Semantic(size=2, threshold=threshold, distance=name, p=3 if name == "minkowski" else None, best_match=best)
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.posexplode(semantic(F.col("text"), config, HashingEmbedder().embed)).alias("chunk_idx", "chunk"))


for _name, _threshold in (("euclidean", 1.3137), ("manhattan", 6.137), ("angular", 0.4137), ("chebyshev", 0.4137), ("dotProduct", 0.2137), ("minkowski", 0.7137)):
    query(f"chunk_semantic_{_name.lower()}", sentences_sql.semantic_sql(2, _threshold, _name))(_clusters(_name, _threshold))
query("chunk_semantic_best_match", sentences_sql.semantic_sql(2, 0.2137, best=True))(_clusters("cosine", 0.2137, True))

# --- hashes, files, pages ---


@query("doc_sha256", "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text))::INTEGER AS n_bytes FROM documents")
def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"), F.octet_length("text").alias("n_bytes"))


@query("doc_dedup_by_hash", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS n FROM documents GROUP BY sha256(text)")
def doc_dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("doc_duplicates", "SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id")
def doc_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "hash").where("doc_id <> first_id").select("doc_id")


@query(
    "file_type",
    """WITH n AS (SELECT page_id, 'p' || page_id || CASE page_id % 6 WHEN 0 THEN '.html' WHEN 1 THEN '.md' WHEN 2 THEN '.tar.json' WHEN 3 THEN '.PDF' WHEN 4 THEN '' ELSE '.docx' END AS name FROM pages),
x AS (SELECT page_id, name, CASE WHEN contains(name, '.') THEN list_last(string_split(name, '.')) END AS ext FROM n)
SELECT page_id, name, CASE WHEN ext IN ('md', 'xml', 'json', 'csv', 'txt', 'pdf', 'docx') THEN ext END AS ext FROM x""",
)
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 6
    end = F.when(i == 0, ".html").when(i == 1, ".md").when(i == 2, ".tar.json").when(i == 3, ".PDF").when(i == 4, "").otherwise(".docx")
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), "page_id", end).alias("name"))
    return named.withColumn("ext", file_type(F.col("name")))


@query("ingest_errors", "SELECT 'd' || doc_id || '.exe' AS name, 'unsupported file type' AS error FROM documents WHERE doc_id % 9 = 0")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" d"), "doc_id", F.when(F.col("doc_id") % 9 == 0, ".exe ").otherwise(".txt"))
    return ingest(table(spark, sf_dir, "documents").select(name.alias("name"), F.encode("text", "UTF-8").alias("content")))[1]


@query("lossy_decode", "SELECT doc_id, chr(65533) || text AS text FROM documents")
def lossy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit(bytearray(b"\xff")), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", lossy_utf8(content).alias("text"))


#: Ten lines of a document stand for a page.
_PAGES_SQL = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
                  len(string_split(text, chr(10))) AS n FROM documents),
p AS (SELECT doc_id, i, i // 10 AS page, (n + 9) // 10 AS pages, regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g') AS line FROM l),
k AS (SELECT * FROM p WHERE line <> page::VARCHAR AND {{keep}})
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) || chr(10) AS text FROM k GROUP BY doc_id"""


def _paged(spark: SparkSession, sf_dir: str, c: ParseConfig) -> DataFrame:
    def paged(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / 10).cast("int"))
        # a page's last line end is kept by one more
        return F.transform(starts, lambda p: F.concat(F.array_join(F.slice(rows, p * 10 + 1, 10), "\n"), F.lit("\n")))

    text = paged_text(once(F.split("text", "\n"), paged), c)
    # a filter on the expression itself would compute it once more
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array(text)).alias("text")).where("text is not null")


query("parse_line_filters", "WITH " + _PAGES_SQL.replace("{keep}", "NOT regexp_matches(line, '^Licensed') AND NOT regexp_matches(line, '[0-9]{3}')"))(lambda spark, sf_dir: _paged(spark, sf_dir, ParseConfig(filters=["^Licensed", "[0-9]{3}"])))
query("parse_page_slice", "WITH " + _PAGES_SQL.replace("{keep}", "page >= 1 AND page < pages - 1"))(lambda spark, sf_dir: _paged(spark, sf_dir, ParseConfig(1, 1)))
query("parse_page_range", "WITH " + _PAGES_SQL.replace("{keep}", "page >= 1 AND page < 3"))(lambda spark, sf_dir: _paged(spark, sf_dir, ParseConfig(2, 4, True)))

# --- the registry ---

_SLIDING_JSON, _SMALL_JSON = '{"sliding": {"size": 1000, "overlap": 200}}', '{"sliding": {"size": 64, "overlap": 16}}'
_PARSER_JSON = '{"start": 0, "end": 0, "range": false, "filters": []}'

REGISTRY_SQL = f"""
docs AS (SELECT doc_id AS id, 'doc_' || doc_id || '.txt' AS name, '/data/' || source || '/doc_' || doc_id || '.txt' AS path, 'txt' AS ext, sha256(text) AS hash, source AS src,
                CASE WHEN doc_id % 7 <> 0 THEN lang END AS label, make_timestamp((1700000000 + doc_id) * 1000000) AS updated_at FROM documents),
chunkers AS (SELECT id + 100000000 AS id, id AS document_id, CASE WHEN id % 3 = 1 THEN '{_SLIDING_JSON}' ELSE '{_SMALL_JSON}' END AS config, updated_at FROM docs WHERE id % 3 <> 0),
parsers AS (SELECT id + 200000000 AS id, id AS document_id, '{_PARSER_JSON}' AS config, updated_at FROM docs WHERE id % 4 <> 0),
collections AS (SELECT i AS id, 'Collection_' || i AS name, 'hashing-64' AS model, 'hashing' AS embedder, CASE WHEN i % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, 64 AS dim, make_timestamp((1700000000 + i) * 1000000) AS updated_at FROM range(7) r(i)),
members AS (SELECT d.id * 10 + c.id AS id, d.id AS document_id, c.id AS collection_id FROM docs d JOIN collections c ON d.id % 5 = c.id % 5 AND c.id < 6),
vectors AS (SELECT vec_id, vec_id % 6 AS collection_id, vec_id % 50 AS document_id, 'content ' || vec_id AS content FROM embeddings)
"""


def registry(spark: SparkSession, sf_dir: str) -> R.Registry:
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("id"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.concat(F.lit("/data/"), "source", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.lit("txt").alias("ext"),
        content_hash(F.col("text")).alias("hash"), F.col("source").alias("src"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("label"), F.lit(None).cast("array<string>").alias("tags"),
    )
    docs = docs.withColumn("created_at", at).withColumn("updated_at", at)

    def configs(base: int, keep, config) -> DataFrame:
        return docs.where(keep).select((F.col("id") + base).alias("id"), F.col("id").alias("document_id"), config.alias("config"), "created_at", "updated_at")

    i = F.col("id")
    collections = spark.range(7).select("id", F.concat(F.lit("Collection_"), "id").alias("name"), F.lit("hashing-64").alias("model"), F.lit("hashing").alias("embedder"), F.when(i % 2 == 0, "alpha").otherwise("beta").alias("provider"), F.lit(64).alias("dim"))
    collections = collections.withColumn("created_at", at).withColumn("updated_at", at)
    left = docs.select(F.col("id").alias("document_id"), (i % 5).alias("k"))
    right = collections.where("id < 6").select(F.col("id").alias("collection_id"), (i % 5).alias("k"))
    members = left.join(right, "k").select((F.col("document_id") * 10 + F.col("collection_id")).alias("id"), "document_id", "collection_id").withColumn("created_at", at).withColumn("updated_at", at)
    v = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", (v % 6).alias("collection_id"), (v % 50).alias("document_id"), F.lit(0).alias("chunk_idx"), F.concat(F.lit("content "), v).alias("content"), doubles(F.col("embedding")).alias("embedding"))
    return R.Registry(docs, configs(100000000, i % 3 != 0, F.when(i % 3 == 1, _SLIDING_JSON).otherwise(_SMALL_JSON)), configs(200000000, i % 4 != 0, F.lit(_PARSER_JSON)), collections, members, vectors)


def on_registry(name: str, sql: str) -> Callable[[Callable[[R.Registry], DataFrame]], Query]:
    def add(f: Callable[[R.Registry], DataFrame]) -> Query:
        return query(name, f"WITH {REGISTRY_SQL} {sql}")(lambda spark, sf_dir: f(registry(spark, sf_dir)))

    return add


_DOC = ["id", "name", "path", "hash", "src", "label"]
_DOC_SQL = ", ".join(_DOC)
_PAIRS = "concat_ws(':', {0}::VARCHAR, {1})"


def _flat(column: str, a: str, b: str):
    """A list of structs as one string."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), ",")


on_registry("doc_by_id", f"SELECT {_DOC_SQL} FROM docs WHERE id = 17")(lambda r: R.filtered(r.documents, id=17).select(_DOC))
on_registry("doc_by_path_src", f"SELECT {_DOC_SQL} FROM docs WHERE path = '/data/src3/doc_23.txt' AND src = 'src3'")(lambda r: R.filtered(r.documents, path="/data/src3/doc_23.txt", src="src3").select(_DOC))
on_registry("doc_path_by_id", "SELECT path FROM docs WHERE id = 17")(lambda r: R.filtered(r.documents, id=17).select("path"))
on_registry("doc_by_hash", f"SELECT {_DOC_SQL} FROM docs WHERE hash = (SELECT hash FROM docs WHERE id = 40)")(lambda r: r.documents.join(R.filtered(r.documents, id=40).select("hash"), "hash", "left_semi").select(_DOC))
on_registry("doc_config_join", "SELECT d.id, c.config AS chunk_config, p.config AS parse_config FROM docs d LEFT JOIN chunkers c ON c.document_id = d.id LEFT JOIN parsers p ON p.document_id = d.id")(
    lambda r: R.document_configs(r).select("id", "chunk_config", "parse_config")
)
on_registry("config_extract", "SELECT document_id, CAST(json_extract(config, '$.sliding.size') AS INTEGER) AS size, CAST(json_extract(config, '$.sliding.overlap') AS INTEGER) AS overlap FROM chunkers")(
    lambda r: r.chunkers.select("document_id", F.from_json("config", "sliding struct<size:int,overlap:int>").alias("c")).select("document_id", "c.sliding.size", "c.sliding.overlap")
)
on_registry("docs_count", "SELECT src, count(id) AS n FROM docs GROUP BY src")(lambda r: r.documents.groupBy("src").agg(F.count("id").alias("n")))
on_registry("docs_ready", f"SELECT {_DOC_SQL} FROM docs WHERE id IN (SELECT document_id FROM chunkers) AND id IN (SELECT document_id FROM parsers)")(lambda r: R.documents(r, ready=True).select(_DOC))
on_registry("docs_not_ready", f"SELECT {_DOC_SQL} FROM docs WHERE id NOT IN (SELECT document_id FROM chunkers) AND id NOT IN (SELECT document_id FROM parsers)")(lambda r: R.documents(r, ready=False).select(_DOC))
on_registry("docs_page", f"SELECT {_DOC_SQL} FROM docs ORDER BY updated_at DESC NULLS FIRST, id LIMIT 10 OFFSET 20")(lambda r: R.ordered(r.documents, Page(3)).select(_DOC))
on_registry("docs_page_by_src", f"SELECT {_DOC_SQL} FROM docs WHERE src = 'src5' ORDER BY label ASC NULLS LAST, id LIMIT 7 OFFSET 7")(lambda r: R.ordered(R.documents(r, "src5"), Page(2, 7, "label", False)).select(_DOC))
on_registry("docs_page_nulls_first", f"SELECT {_DOC_SQL} FROM docs ORDER BY label DESC NULLS FIRST, id LIMIT 15")(lambda r: R.ordered(r.documents, Page(1, 15, "label")).select(_DOC))
on_registry(
    "docs_display",
    f"""SELECT d.id, d.name, coalesce(string_agg({_PAIRS.format("c.id", "c.name")}, ',' ORDER BY c.id), '') AS in_collections
FROM (SELECT * FROM docs ORDER BY updated_at DESC, id LIMIT 20) d LEFT JOIN members m ON m.document_id = d.id LEFT JOIN collections c ON c.id = m.collection_id GROUP BY d.id, d.name""",
)(lambda r: R.documents_display(r, Page(1, 20)).select("id", "name", _flat("collections", "collection_id", "collection_name").alias("in_collections")))
_COLLECTION_SQL = f"""SELECT c.id, c.name, c.model, c.embedder, c.provider, count(DISTINCT m.document_id) AS document_count,
 sha256(coalesce(string_agg({_PAIRS.format("d.id", "d.name")}, ',' ORDER BY d.id), '')) AS documents_hash
FROM {{some}} c LEFT JOIN members m ON m.collection_id = c.id LEFT JOIN docs d ON d.id = m.document_id GROUP BY ALL"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "model", "embedder", "provider", F.col("document_count").cast("long"), F.sha2(_flat("documents", "document_id", "document_name"), 256).alias("documents_hash"))


on_registry("collections_display", _COLLECTION_SQL.format(some="(SELECT * FROM collections ORDER BY updated_at DESC, id LIMIT 5)"))(lambda r: _shown(R.collections_display(r, Page(1, 5))))
on_registry("collection_display", _COLLECTION_SQL.format(some="(SELECT * FROM collections WHERE id = 3)"))(lambda r: _shown(R.collections_display(r, None, 3)))
on_registry("collection_by_name", "SELECT id, name, provider FROM collections WHERE name = 'Collection_3' AND provider = 'beta'")(lambda r: R.filtered(r.collections, name="Collection_3", provider="beta").select("id", "name", "provider"))
on_registry("collection_document_counts", "SELECT collection_id, count(DISTINCT document_id) AS document_count FROM members GROUP BY collection_id")(R.document_counts)
on_registry("assigned_collections", "SELECT id, name FROM collections WHERE id IN (SELECT collection_id FROM members WHERE document_id = 15)")(lambda r: R.assigned_collections(r, 15).select("id", "name"))
on_registry("embedding_by_name", "SELECT id, document_id FROM members WHERE document_id = 15 AND collection_id = (SELECT id FROM collections WHERE name = 'Collection_5' AND provider = 'beta')")(
    lambda r: R.embeddings_by_name(r, 15, "Collection_5", "beta").select("id", "document_id")
)
on_registry("embeddings_list", "SELECT id, document_id, collection_id FROM members WHERE collection_id = 2 ORDER BY id LIMIT 10 OFFSET 10")(
    lambda r: R.ordered(R.filtered(r.embeddings, collection_id=2), Page(2, 10, "id", False)).select("id", "document_id", "collection_id")
)
on_registry("embeddings_list_all", "SELECT id, document_id, collection_id FROM members")(lambda r: R.filtered(r.embeddings, collection_id=None).select("id", "document_id", "collection_id"))
on_registry("count_vectors", "SELECT collection_id, document_id, count(*) AS n_vectors FROM vectors WHERE collection_id = 4 GROUP BY ALL")(lambda r: R.vector_counts(r, 4))
on_registry("collection_name_valid", r"SELECT path AS name, regexp_full_match(trim(upper(src[1]) || substr(src, 2)), '[A-Z][A-Za-z0-9_]*') AS capital, regexp_full_match(src, '[A-Z][A-Za-z0-9_]*') AS as_is FROM docs")(
    lambda r: r.documents.select(F.col("path").alias("name"), F.initcap("src").rlike("^[A-Z][A-Za-z0-9_]*$").alias("capital"), F.col("src").rlike("^[A-Z][A-Za-z0-9_]*$").alias("as_is"))
)

# --- changes: what the tables hold afterwards ---


def _now():
    return F.timestamp_seconds(F.lit(1800000000))


def _state(r: R.Registry) -> DataFrame:
    """Rows by table."""
    out = None
    for name in ("documents", "chunkers", "parsers", "collections", "embeddings", "vectors"):
        own = getattr(r, name).select(F.lit(name).alias("table_name"), F.col("vec_id" if name == "vectors" else "id").cast("long").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def _state_sql(**where: str) -> str:
    names = {"documents": "docs", "embeddings": "members"}
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, {'vec_id' if t == 'vectors' else 'id'} AS id FROM {names.get(t, t)} WHERE {where.get(t, 'true')}" for t in ("documents", "chunkers", "parsers", "collections", "embeddings", "vectors"))


on_registry("doc_delete_cascade", _state_sql(documents="id % 10 <> 3", chunkers="document_id % 10 <> 3", parsers="document_id % 10 <> 3", embeddings="document_id % 10 <> 3", vectors="document_id % 10 <> 3"))(
    lambda r: _state(R.delete_documents(r, r.documents.where("id % 10 = 3").select("id")))
)
_AT = "(SELECT id FROM docs WHERE path = '/data/src3/doc_23.txt')"
on_registry("doc_delete_by_path", _state_sql(documents=f"id NOT IN {_AT}", **{t: f"document_id NOT IN {_AT}" for t in ("chunkers", "parsers", "embeddings", "vectors")}))(lambda r: _state(R.delete_documents(r, R.documents_at(r, "/data/src3/doc_23.txt"))))
on_registry("collection_delete_cascade", _state_sql(collections="id <> 2", embeddings="collection_id <> 2", vectors="collection_id <> 2"))(lambda r: _state(R.delete_collections(r, r.collections.where("id = 2").select("id"))))
on_registry("embeddings_delete", _state_sql(embeddings="NOT (document_id % 3 = 0 AND collection_id = 1)", vectors="NOT (document_id % 3 = 0 AND collection_id = 1 AND document_id IN (SELECT document_id FROM members WHERE collection_id = 1))"))(
    lambda r: _state(R.delete_embeddings(r, r.embeddings.where("document_id % 3 = 0 AND collection_id = 1")))
)


@on_registry(
    "config_upsert",
    f"""SELECT coalesce(c.id, n.id) AS id, coalesce(c.document_id, n.document_id) AS document_id, coalesce(n.config, c.config) AS config,
CASE WHEN n.id IS NULL THEN c.updated_at WHEN c.config = n.config THEN c.updated_at ELSE make_timestamp(1800000000000000) END AS updated_at
FROM chunkers c FULL JOIN (SELECT id + 300000000 AS id, id AS document_id, '{_SMALL_JSON}' AS config FROM docs WHERE id % 2 = 0) n ON n.document_id = c.document_id""",
)
def config_upsert(r: R.Registry) -> DataFrame:
    new = r.documents.where("id % 2 = 0").select((F.col("id") + 300000000).alias("id"), F.col("id").alias("document_id"), F.lit(_SMALL_JSON).alias("config"))
    return R.upsert_configs(r, "chunkers", new, _now()).chunkers.select("id", "document_id", "config", "updated_at")


@on_registry("doc_update", "SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed_' || id ELSE name END AS name, CASE WHEN id % 5 <> 0 THEN label END AS label, CASE WHEN id % 5 = 0 THEN make_timestamp(1800000000000000) ELSE updated_at END AS updated_at FROM docs")
def doc_update(r: R.Registry) -> DataFrame:
    changes = r.documents.where("id % 5 = 0").select("id", F.concat(F.lit("renamed_"), "id").alias("name"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("tags"))
    return R.update_documents(r, changes, _now()).documents.select("id", "name", "label", "updated_at")


@on_registry(
    "doc_insert_unique",
    """SELECT id, path, hash FROM docs UNION ALL SELECT min(id) + 500000000 AS id, '/new' AS path, hash FROM docs WHERE src = 'src1' GROUP BY src, hash""",
)
def doc_insert_unique(r: R.Registry) -> DataFrame:
    again = r.documents.where("src = 'src1'")
    new = again.withColumn("id", F.col("id") + 500000000).withColumn("path", F.lit("/new"))
    return R.insert_documents(r, new.unionByName(again)).documents.select("id", "path", "hash")


def _store_files(r: R.Registry) -> DataFrame:
    """Of one source's files a third is gone, and some are new."""
    own = r.documents.where("src = 'src4'")
    return own.where("id % 3 <> 0").select("path").unionByName(own.where("id % 4 = 0").select(F.concat("path", F.lit(".new")).alias("path")))


on_registry("sync_prune", "SELECT id, path FROM docs WHERE src = 'src4' AND id % 3 = 0")(lambda r: R.missing_files(r, _store_files(r), "src4").select("id", "path"))
on_registry("sync_new", "SELECT path || '.new' AS path FROM docs WHERE src = 'src4' AND id % 4 = 0")(lambda r: R.new_files(r, _store_files(r), "src4").select("path"))


@query(
    "batch_embed_report",
    f"WITH {REGISTRY_SQL}"
    + """, asked AS (SELECT 'job-1' AS job_id, id AS document_id, 6 AS collection_id FROM docs WHERE id % 4 = 1 UNION ALL SELECT 'job-2', id, 6 FROM docs WHERE id % 8 = 1 UNION ALL SELECT 'job-2', 1000000000000, 6),
tt AS (SELECT doc_id, octet_length(encode(regexp_replace(text, '^SPACE|SPACE$', '', 'g'))) AS size, doc_id % 3 AS kind FROM documents),
n AS (SELECT doc_id, CASE kind WHEN 1 THEN CASE WHEN size = 0 THEN 0 WHEN size <= 1200 THEN 1 ELSE (size - 200) // 1000 + 1 END WHEN 2 THEN CASE WHEN size = 0 THEN 0 WHEN size <= 80 THEN 1 ELSE (size - 16) // 64 + 1 END END AS n FROM tt)
SELECT a.job_id, CASE WHEN a.job_id = 'job-1' AND n.n > 0 THEN 'addition' ELSE 'error' END AS kind, a.document_id::VARCHAR AS document_id, '6' AS collection_id,
 CASE WHEN a.job_id = 'job-1' AND n.n > 0 THEN n.n::INTEGER END AS total_chunks,
 CASE WHEN a.document_id = 1000000000000 THEN 'no such document' WHEN a.job_id = 'job-2' THEN 'already exists' WHEN n.n IS NULL THEN 'no chunker' WHEN n.n = 0 THEN 'chunks cannot be empty' END AS error
FROM asked a LEFT JOIN n ON n.doc_id = a.document_id
UNION ALL SELECT 'job-2', 'removal', id::VARCHAR, '6', NULL, NULL FROM docs WHERE id % 100 = 0
UNION ALL SELECT 'job-3', 'error', NULL, '99', NULL, 'no such collection'""".replace("SPACE", _SPACE),
)
def batch_embed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir)
    docs = r.documents
    some = lambda keep: F.collect_list(F.when(keep, F.col("id")))  # noqa: E731  of 400 ids at most
    dealt = docs.groupBy(F.floor(F.col("id") / 400))
    none = F.array().cast("array<bigint>")
    job = lambda name: [F.lit(name).alias("job_id"), F.lit(6).cast("long").alias("collection_id")]
    one = dealt.agg(some(F.col("id") % 4 == 1).alias("add")).select(*job("job-1"), "add", none.alias("remove"))
    two = dealt.agg(some(F.col("id") % 8 == 1).alias("add"), some(F.col("id") % 100 == 0).alias("remove")).select(*job("job-2"), "add", "remove")
    two = two.unionByName(spark.range(1).select(*job("job-2"), F.array(F.lit(1000000000000)).alias("add"), none.alias("remove")))
    three = spark.range(1).select(F.lit("job-3").alias("job_id"), F.lit(99).cast("long").alias("collection_id"), F.array(F.lit(5).cast("long")).alias("add"), F.array().cast("array<bigint>").alias("remove"))
    kind = F.when(F.col("document_id") % 3 == 1, 0).when(F.col("document_id") % 3 == 2, 1)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text").withColumn("kind", kind)
    out = run_jobs(r, one.unionByName(two).unionByName(three), texts, [Sliding(), Sliding(64, 16)], HashingEmbedder())
    return out.reports.select("job_id", "kind", F.col("document_id").cast("string"), F.col("collection_id").cast("string"), "total_chunks", "error")


# --- vectors ---

_PAIRED_SQL = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round({}, 6) AS score FROM p"
_GAPS = "list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))"
_DISTANCE_SQL = {
    "cosine": "list_cosine_similarity(a, b)",
    "euclidean": "list_distance(a, b)",
    "manhattan": f"list_sum({_GAPS})",
    "angular": "acos(list_cosine_similarity(a, b)) / pi()",
    "chebyshev": f"list_max({_GAPS})",
    "dotProduct": "list_inner_product(a, b)",
    "minkowski": f"pow(list_sum(list_transform({_GAPS}, lambda x: pow(x, 3))), 1.0 / 3)",
}


def _paired(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("a"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(after, "vec_id").select("vec_id", F.round(similarity(name, F.col("a"), F.col("b"), 3 if name == "minkowski" else None), 6).alias("score"))


for _name, _sql in _DISTANCE_SQL.items():
    query(f"vec_distance_{_name.lower()}", _PAIRED_SQL.format(_sql))(lambda spark, sf_dir, n=_name: _paired(spark, sf_dir, n))


def _first_vector(v: DataFrame) -> list[float]:
    return v.where("vec_id = 7").select(doubles(F.col("embedding")).alias("e")).first()["e"]


@query("vec_topk", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 7) q ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id LIMIT 5")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, _first_vector(v), 5).select("vec_id", F.round("score", 6).alias("score"))


@query("vec_topk_filtered", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT v.vec_id, round(list_distance(v.e, q.e), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 7) q WHERE v.vec_id % 6 = 2 ORDER BY list_distance(v.e, q.e), v.vec_id LIMIT 5")
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v.where("vec_id % 6 = 2"), _first_vector(v), 5, "euclidean", ascending=True).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "vec_topk_per_query",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def vec_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    out = top_k_of_many(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5)
    return out.withColumn("score", F.round("score", 6))


@query(
    "embed_search_end_to_end",
    f"""WITH {sliding_sql(1000, 200)},
chunked AS (SELECT doc_id || '-' || chunk_idx AS vec_id, chunk FROM windows),{sentences_sql.embedding_sql("chunked", "vec_id", "chunk")},
asked AS (SELECT text AS chunk, item_id FROM benchmark ORDER BY item_id LIMIT 1),
q AS (SELECT * FROM (WITH {sentences_sql.embedding_sql("asked", "item_id", "chunk")} SELECT embedding AS q FROM embedded)),
scored AS (SELECT vec_id, list_cosine_similarity(embedding, q) AS score FROM embedded, q WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT vec_id, chunk AS content, round(score, 6) AS score FROM scored JOIN chunked USING (vec_id) ORDER BY scored.score DESC, vec_id LIMIT 5""",
)
def embed_search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, embedded; the nearest ones to the first benchmark item."""
    e = HashingEmbedder()
    vectors = embed_documents(table(spark, sf_dir, "documents"), Sliding(), e)
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return top_k(vectors.withColumn("vec_id", F.concat_ws("-", "doc_id", "chunk_idx")), list(e.embed([asked])[0]), 5).select("vec_id", "content", F.round("score", 6).alias("score"))


@query("embed_documents", f"WITH {sentences_sql.embedding_sql('documents', 'doc_id', 'text')} SELECT doc_id, embedding FROM embedded")
def embed_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", embedding(F.col("text"), HashingEmbedder()).alias("embedding"))


# --- services and files ---

services.register(query)

# --- stores, streams, indexes ---

storage.register(query, on_registry, registry, table, _SPACE, REGISTRY_SQL)
