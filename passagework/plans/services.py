"""Named queries that go through the services: uploads, folders, configurations, collections, jobs, searches; and through
files of the formats that are parsed. Files come from whole test tables; `add` registers a query with its SQL."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Page, ParseConfig, Semantic, Sliding, Snapping
from ..errors import EngineError
from ..functions.batches import in_slices
from ..operators import registry as R
from ..operators.parsing import docx_column, paged_text, parse, pdf_pages
from ..operators.pdf import pdf_text
from ..service import Services
from ..sources.embedders import HashingEmbedder, LocalEmbedder, OpenAiEmbedder
from ..sources.providers import Providers
from ..sources.store import FolderStore
from ..sources.tables import RegistryStore, new_base
from ..streaming.jobs import JOB, run_jobs
from .sentences_sql import SPACE, embedding_sql

#: All benchmark items as files; of equal texts the first by id is the one that is stored.
_FILES_SQL = """
files AS (SELECT item_id, text, sha256(text) AS hash, min(item_id) OVER (PARTITION BY text) AS first_id FROM benchmark),
stored AS (SELECT item_id, text, hash, 'item-' || item_id || '.txt' AS name FROM files WHERE item_id = first_id)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def services(spark: SparkSession) -> Services:
    base = new_base(spark)
    return Services(spark, Providers(fs=FolderStore(spark, f"{base}/files")), Providers(hashing=HashingEmbedder()), ["local"], storage=RegistryStore(spark, f"{base}/registry"))


def _items(spark: SparkSession, sf_dir: str) -> list[tuple[int, bytes]]:
    """The benchmark's items, as a client would send them."""
    return [(r["item_id"], r["text"].encode()) for r in _table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]


def uploaded(spark: SparkSession, sf_dir: str, more: Callable[[int, bytes], list[tuple[str, bytes]]] = lambda i, b: []) -> tuple[Services, dict[str, str]]:
    s, items = services(spark), _items(spark, sf_dir)
    files = [(f"item-{i}.txt", b) for i, b in items] + [x for i, b in items for x in more(i, b)]
    _, errors = s.documents.upload("fs", files, Sliding(100_000, 0), ParseConfig(1, 2, filters=["x"]))
    return s, errors


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload stores, with its configurations, and what it refuses."""
    s, errors = uploaded(spark, sf_dir, lambda i, b: [(f"copy-{i}.txt", b), (f"item-{i}.exe", b)])
    kind = F.regexp_extract("chunk_config", '^."([a-z]+)"', 1)
    good = R.document_configs(s.registry).select("name", "ext", "hash", "src", kind.alias("chunker"), F.get_json_object("parse_config", "$.end").cast("int").alias("skipped_pages"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ext", "string"), ("hash", "string"), ("src", "string"), ("chunker", "string"), ("skipped_pages", "int"))]
    return good.unionByName(spark.createDataFrame(sorted(errors.items()), "name string, error string").select("name", *none, "error"))


_UPLOAD_SQL = f"""WITH {_FILES_SQL}
SELECT name, 'txt' AS ext, hash, 'fs' AS src, 'sliding' AS chunker, 2 AS skipped_pages, NULL AS error FROM stored
UNION ALL SELECT 'item-' || item_id || '.txt', NULL, NULL, NULL, NULL, NULL, 'already exists' FROM files WHERE item_id <> first_id
UNION ALL SELECT 'copy-' || item_id || '.txt', NULL, NULL, NULL, NULL, NULL, 'already exists' FROM files
UNION ALL SELECT 'item-' || item_id || '.exe', NULL, NULL, NULL, NULL, NULL, 'unsupported file type' FROM files"""


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, listed and read and parsed; one is deleted before."""
    s, _ = uploaded(spark, sf_dir)
    store = s.stores.get("fs")
    store.delete(s.registry.documents.where("name = 'item-0.txt'").first()["path"])
    listed = store.list_files().select(F.col("path").alias("p"), "length")
    read = store.read(listed.select(F.col("p").alias("path"))).withColumn("p", F.col("path"))
    return parse(read, s.documents.parser(s.registry.documents.first()["id"])).join(listed, "p").select("name", "ext", "hash", "length", "text", "error")


_STORED_SQL = f"WITH {_FILES_SQL} SELECT name, 'txt' AS ext, hash, strlen(text) AS length, text, NULL::VARCHAR AS error FROM stored WHERE name <> 'item-0.txt'"


def sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after files of the folder went and others came; new ones have no configurations."""
    s, _ = uploaded(spark, sf_dir)
    store, rows = s.stores.get("fs"), s.registry.documents.select("name", "path").collect()  # what was uploaded
    for r in rows:
        number = int(r["name"][5:-4])
        if number % 3 == 0:
            store.delete(r["path"])
        if number % 3 == 1:
            store.write(f"new-{number}.md", b"new %d" % number)
    s.documents.sync("fs")
    return R.document_configs(s.registry).select("name", "ext", "hash", "src", F.col("chunk_config").isNotNull().alias("has_chunker"), F.col("parse_config").isNotNull().alias("has_parser"))


_SYNC_SQL = f"""WITH {_FILES_SQL}
SELECT name, 'txt' AS ext, hash, 'fs' AS src, true AS has_chunker, true AS has_parser FROM stored WHERE item_id % 3 <> 0
UNION ALL SELECT 'new-' || item_id || '.md', 'md', sha256('new ' || item_id), 'fs', false, false FROM stored WHERE item_id % 3 = 1"""


def embedded(spark: SparkSession, sf_dir: str) -> tuple[Services, str]:
    """All items in one collection, by one job, beside the default collections."""
    s, _ = uploaded(spark, sf_dir)
    s.vectors.create_default_collections()
    collection = s.vectors.create_collection("Own", "hashing-64", "hashing", "local")
    docs = s.registry.documents
    texts = parse(s.stores.get("fs").read(docs.select("path"))).join(docs.select("path", F.col("id").alias("document_id")), "path").select("document_id", "text", F.lit(0).alias("kind"))
    ids = [r["id"] for r in docs.select("id").orderBy("id").collect()]  # what a client asks for
    jobs = spark.createDataFrame([("job", collection, ids, [])], JOB)
    s.publish(run_jobs(s.registry, jobs, texts, [Sliding(100_000, 0)], HashingEmbedder()).registry)
    return s, collection


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their numbers of documents, embeddings and vectors, before and after one document left."""
    s, own = embedded(spark, sf_dir)
    n, shown = s.vectors.list_collections_display(Page(1, 10, "name", False))
    memberships, _ = s.vectors.list_embeddings(Page(), own)
    first = R.filtered(s.registry.documents, name="item-0.txt").first()["id"]
    held = s.vectors.get_embeddings(first, own) is not None
    vectors = s.registry.vectors.count()
    gone = s.vectors.delete_embeddings(own, first)
    told = [F.lit(x).alias(c) for c, x in (("n_collections", n), ("n_embeddings", memberships), ("n_vectors", vectors), ("first_is_in", held), ("vectors_gone", gone), ("vectors_left", s.registry.vectors.count()))]
    return shown.select("name", "model", "embedder", "provider", "dim", "document_count", *told)


_COLLECTIONS_SQL = f"""WITH {_FILES_SQL}, n AS (SELECT count(*) AS n FROM stored)
SELECT name, 'hashing-64' AS model, 'hashing' AS embedder, 'local' AS provider, 64 AS dim, CASE WHEN name = 'Own' THEN n ELSE 0 END AS document_count,
       2 AS n_collections, n::INTEGER AS n_embeddings, n::INTEGER AS n_vectors, true AS first_is_in, 1 AS vectors_gone, (n - 1)::INTEGER AS vectors_left
FROM n, (VALUES ('Own'), ('Default_local_hashing')) t(name)"""


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks to the text of the last item."""
    s, own = embedded(spark, sf_dir)
    asked = _items(spark, sf_dir)[-1][1].decode()
    found = s.vectors.search(f"  {asked} ", 7, own)
    return spark.createDataFrame(list(enumerate(found)), "place int, content string")


_SEARCH_SQL = f"""WITH {_FILES_SQL},
chunked AS (SELECT item_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS content FROM stored),{embedding_sql("chunked", "item_id", "content")},
q AS (SELECT e.embedding AS q FROM files f JOIN embedded e ON e.item_id = f.first_id ORDER BY f.item_id DESC LIMIT 1),
scored AS (SELECT c.content, round(list_cosine_similarity(e.embedding, q.q), 12) AS score FROM embedded e JOIN chunked c USING (item_id), q)
SELECT (row_number() OVER (ORDER BY score DESC) - 1)::INTEGER AS place, content FROM scored QUALIFY place < 7"""


def delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's documents go, whatever their source; the rows affected are told."""
    s, _ = uploaded(spark, sf_dir)
    path = R.filtered(s.registry.documents, name="item-1.txt").first()["path"]
    affected = [s.documents.delete_by_path(path), s.documents.delete_by_path(path), s.documents.update("none", "x"), s.documents.update(R.filtered(s.registry.documents, name="item-2.txt").first()["id"], "other.txt", "label", ["a", "b"])]
    return s.registry.documents.select("name", "label", F.array_join("tags", ",").alias("tags"), *[F.lit(n).alias(f"affected_{k}") for k, n in enumerate(affected)])


_DELETE_SQL = f"""WITH {_FILES_SQL}
SELECT CASE WHEN item_id = 2 THEN 'other.txt' ELSE name END AS name, CASE WHEN item_id = 2 THEN 'label' END AS label, CASE WHEN item_id = 2 THEN 'a,b' END AS tags,
       1 AS affected_0, 0 AS affected_1, 0 AS affected_2, 1 AS affected_3 FROM stored WHERE item_id <> 1"""


def _ok(make: Callable[[], object]) -> bool:
    try:
        make()
    except EngineError:
        return False
    return True


def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sizes and overlaps, page limits and distances the configurations accept."""
    grid = [(a, b) for a in range(-1, 6) for b in range(-1, 6)]
    rows = [("sliding", a, b, _ok(lambda: Sliding(a, b))) for a, b in grid] + [("snapping", a, b, _ok(lambda: Snapping(a, b))) for a, b in grid]
    rows += [("slice", a, b, _ok(lambda: ParseConfig(a, b))) for a, b in grid] + [("range", a, b, _ok(lambda: ParseConfig(a, b, True))) for a, b in grid] + [("page", a, b, _ok(lambda: Page(a, b))) for a, b in grid]
    rows += [("minkowski", a, b, _ok(lambda: Semantic(a, 0.5, "minkowski", b))) for a, b in grid]
    return spark.createDataFrame(rows, "kind string, a int, b int, accepted boolean")


_RULES_SQL = """WITH g AS (SELECT a::INTEGER AS a, b::INTEGER AS b FROM range(-1, 6) x(a), range(-1, 6) y(b))
SELECT 'sliding' AS kind, a, b, a >= 1 AND b >= 0 AND b <= a AS accepted FROM g UNION ALL SELECT 'snapping', a, b, a >= 0 AND b >= 0 AND b <= a FROM g
UNION ALL SELECT 'slice', a, b, a >= 0 AND b >= 0 FROM g UNION ALL SELECT 'range', a, b, a >= 1 AND b > a FROM g
UNION ALL SELECT 'page', a, b, a >= 1 AND b >= 1 FROM g UNION ALL SELECT 'minkowski', a, b, a >= 0 AND b >= 1 FROM g"""


def sort_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the labels' and sources' names could be a sort column, padded with what must not be in one."""
    names = _table(spark, sf_dir, "documents").select("source").distinct().collect()  # the sources' names
    tried = [x for r in names for x in (r["source"], f"{r['source']}_id", f"{r['source']} desc", f"{r['source']};--", r["source"] * 20, "")]
    return spark.createDataFrame([(x, _ok(lambda: Page(sort_by=x))) for x in tried], "name string, accepted boolean")


_SORT_SQL = """WITH s AS (SELECT DISTINCT source FROM documents), t AS (SELECT unnest([source, source || '_id', source || ' desc', source || ';--', repeat(source, 20), '']) AS name FROM s)
SELECT name, regexp_full_match(name, '[A-Za-z0-9_]{1,64}') AS accepted FROM t"""


def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {e.id: e.models() for e in (HashingEmbedder(), OpenAiEmbedder(), LocalEmbedder(""))}
    return spark.createDataFrame([(p, m, d) for p, models in known.items() for m, d in models.items()], "provider string, model string, dim int")


_MODELS_SQL = """SELECT * FROM (VALUES ('hashing', 'hashing-64', 64), ('hashing', 'hashing-256', 256), ('openai', 'text-embedding-3-large', 3072), ('openai', 'text-embedding-3-small', 1536),
('openai', 'text-embedding-ada-002', 1536), ('local', 'Xenova/bge-small-en-v1.5', 384), ('local', 'Xenova/bge-large-en-v1.5', 1024), ('local', 'Xenova/bge-base-en-v1.5', 768),
('local', 'Qdrant/all-MiniLM-L6-v2-onnx', 384), ('local', 'Xenova/all-MiniLM-L12-v2', 384)) t(provider, model, dim)"""


def made_docx(text: str) -> bytes:
    """A DOCX file with a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def made_pdf(text: str, per_page: int = 10) -> bytes:
    """A PDF file with a page for each ten lines, in a font whose codes a ToUnicode map tells."""
    rows, code = text.split("\n"), {c: k + 1 for k, c in enumerate(sorted(set(text) - {"\n"}))}
    hexed = lambda c: c.encode("utf-16-be").hex()
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar " + " ".join(f"<{k:04x}> <{hexed(c)}>" for c, k in code.items()) + " endbfchar"
    pages = [rows[i : i + per_page] for i in range(0, len(rows), per_page)]
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"]
    for content, head in [(cmap.encode(), None)] + [(b"BT /F1 9 Tf " + b" 0 -12 Td ".join(b"<%s> Tj" % "".join(f"{code[c]:04x}" for c in row).encode() for row in p) + b" ET", True) for p in pages]:
        if head:
            objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {len(objects) + 2} 0 R >>".encode())
        data = zlib.compress(content)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, x) for i, x in enumerate(objects)) + b"%%EOF"


def _made(spark: SparkSession, sf_dir: str, make: Callable[[str], bytes]) -> DataFrame:
    content = in_slices(F.coalesce("text", F.lit("")), lambda texts: [make(t) for t in texts], "binary", pa.binary())
    return _table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def parsed_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DOCX files, and their text again."""
    return _made(spark, sf_dir, made_docx).select("doc_id", docx_column(F.col("content")).alias("text"))


_DOCX_SQL = f"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN x <> '' THEN x || ' ' ELSE '' END || chr(10)), '') AS text FROM l"""


def parsed_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, and the text of all but the last page of each."""
    paged = _made(spark, sf_dir, made_pdf).select("doc_id", pdf_pages(F.col("content"), pdf_text).alias("pages"))
    return paged.select("doc_id", paged_text(F.col("pages"), ParseConfig(0, 1)).alias("text"))


_PDF_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
p AS (SELECT doc_id, i, i // 10 AS page, (n + 9) // 10 AS pages, regexp_replace(regexp_replace(line, ' +', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') AS line, line <> '' AS shown FROM l),
k AS (SELECT * FROM p WHERE shown AND page < pages - 1 AND line <> page::VARCHAR)
SELECT d.doc_id, string_agg(line, chr(10) ORDER BY i) || chr(10) AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def register(add: Callable[[str, str | None], Callable]) -> None:
    for name, sql, f in (
        ("service_upload", _UPLOAD_SQL, upload), ("service_stored_files", _STORED_SQL, stored_files), ("service_sync", _SYNC_SQL, sync), ("service_collections", _COLLECTIONS_SQL, collections),
        ("service_search", _SEARCH_SQL, search), ("service_delete_by_path", _DELETE_SQL, delete_by_path), ("config_rules", _RULES_SQL, config_rules), ("sort_column_rules", _SORT_SQL, sort_columns),
        ("embedding_models", _MODELS_SQL, embedding_models), ("parse_docx", _DOCX_SQL, parsed_docx), ("parse_pdf", _PDF_SQL, parsed_pdf),
    ):
        add(name, sql)(f)
