"""Services over a registry: documents (store, parse, chunk) and vectors (collections, embeddings, search).

A service holds the present Registry; each change is written and published by its RegistryStore, so no plan grows with
the number of changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ChunkConfig, Page, ParseConfig, Semantic, Sliding, Snapping, chunk_config_from_json, chunk_config_to_json, collection_name
from .errors import AlreadyExists, EmptyResult, InvalidInput, InvalidModel, NotFound
from .operators import pivots
from .operators import registry as R
from .operators.chunking import chunk, chunk_rows
from .operators.parsing import PageExtractor, parse, require_type
from .operators.pdf import pdf_text
from .operators.pivots import PivotIndex
from .operators.search import top_k
from .sources.embedders import Embedder, embedding, size_of
from .sources.providers import Providers
from .sources.store import FolderStore, ingest
from .sources.tables import RegistryStore

DEFAULT_COLLECTION = "Default"
#: Bytes that an upload may have in all.
UPLOAD_BYTES = 100_000_000
DEFAULT_DOCUMENT = ("welcome.txt", b"Documents are stored, parsed, cut into chunks, embedded and searched.")


def _now():
    return F.current_timestamp()


class Services:
    """Shared state: the registry, its storage, and the providers."""

    def __init__(self, spark: SparkSession, stores: Providers[FolderStore], embedders: Providers[Embedder], vector_stores: list[str], registry: R.Registry | None = None, storage: RegistryStore | None = None, extract: PageExtractor | None = pdf_text):
        self.spark, self.stores, self.embedders, self.vector_stores, self.extract = spark, stores, embedders, vector_stores, extract
        self.storage = storage or RegistryStore(spark)
        self.registry = registry or R.Registry.empty(spark)
        self.documents, self.vectors = DocumentService(self), VectorService(self)

    def publish(self, r: R.Registry) -> None:
        self.registry = self.storage.save(r)

    def default_semantic(self) -> Semantic:
        """With the first embedder and its default model."""
        first = self.embedders.get(self.embedders.ids()[0])
        return Semantic(model=first.default_model[0], provider=first.id)

    def info(self) -> dict:
        """Providers, models with their dimensions, default chunkers."""
        models = {e: self.embedders.get(e).models() for e in self.embedders.ids()}
        return {"documentProviders": self.stores.ids(), "vectorProviders": self.vector_stores, "embeddingProviders": models, "defaultChunkers": [chunk_config_to_json(c) for c in (Sliding(), Snapping(), self.default_semantic())]}


class DocumentService:
    def __init__(self, s: Services):
        self.s = s

    def list(self, page: Page = Page(), src: str | None = None, ready: bool | None = None) -> tuple[int, DataFrame]:
        """The number of all that match, and a page of them."""
        some = R.documents(self.s.registry, src, ready)
        return some.count(), R.ordered(some, page)

    def list_display(self, page: Page = Page(), src: str | None = None, document_id: str | None = None) -> tuple[int, DataFrame]:
        total = R.filtered(self.s.registry.documents, src=src, id=document_id).count()
        return total, R.documents_display(self.s.registry, page, src, document_id)

    def get(self, document_id: str):
        row = R.filtered(self.s.registry.documents, id=document_id).first()
        if row is None:
            raise NotFound(f"document {document_id}")
        return row

    def config(self, document_id: str):
        row = R.document_configs(self.s.registry, document_id).first()
        if row is None:
            raise NotFound(f"document {document_id}")
        return row

    def _chunker(self, document_id: str) -> ChunkConfig:
        stored = self.config(document_id)["chunk_config"]
        if stored is None:
            raise NotFound(f"chunker of {document_id}")
        return chunk_config_from_json(stored)

    def parser(self, document_id: str) -> ParseConfig:
        stored = self.config(document_id)["parse_config"]
        return ParseConfig() if stored is None else ParseConfig.from_json(stored)

    def _parsed(self, row, c: ParseConfig) -> DataFrame:
        paths = R.filtered(self.s.registry.documents, id=row["id"]).select("path")
        return parse(self.s.stores.get(row["src"]).read(paths), c, self.s.extract)

    def content(self, document_id: str, c: ParseConfig | None = None) -> str:
        """The document's text, by its own parser or the default one."""
        got = self._parsed(self.get(document_id), c or self.parser(document_id)).first()
        if got is None:
            raise NotFound(f"content of {document_id}")
        if got["error"]:
            raise EmptyResult(got["error"])
        return got["text"]

    parse_preview = content

    def _chunks(self, text: str, c: ChunkConfig) -> list[str]:
        embed = None
        if isinstance(c, Semantic):
            embedder = self.s.embedders.get(c.provider)
            size_of(embedder, c.model)
            embed = lambda texts: embedder.embed(texts, c.model)
        df = self.s.spark.createDataFrame([(text,)], "text string")
        out = df.select(chunk(F.col("text"), c, embed).alias("c")).first()["c"]
        if not out:
            raise EmptyResult("chunks cannot be empty")
        return out

    def chunks(self, document_id: str) -> list[str]:
        """By the stored chunker, which must be there."""
        return self._chunks(self.content(document_id), self._chunker(document_id))

    def chunk_preview(self, document_id: str, chunker: ChunkConfig, parser: ParseConfig | None = None) -> list[str]:
        """By the given chunker; parsed by the given parser, else by the stored one, which must be there."""
        if parser is None and self.config(document_id)["parse_config"] is None:
            raise NotFound(f"parser of {document_id}")
        return self._chunks(self.content(document_id, parser), chunker)

    def upload(self, src: str, files: list[tuple[str, bytes]], chunker: ChunkConfig | None = None, parser: ParseConfig | None = None) -> tuple[list[str], dict[str, str]]:
        """Ids of the new documents and errors by name; a file fails alone. New documents get configurations. Raises if the
        files have more than UPLOAD_BYTES together."""
        if sum(len(b) for _, b in files) > UPLOAD_BYTES:
            raise InvalidInput(f"an upload has {UPLOAD_BYTES} bytes at most")
        df = self.s.spark.createDataFrame([(n, bytearray(b)) for n, b in files], "name string, content binary")
        good, bad = ingest(df)
        known = {r["hash"] for r in good.join(self.s.registry.documents.select("hash"), "hash", "left_semi").select("hash").collect()}  # of the uploaded files
        errors = {r["name"]: r["error"] for r in bad.collect()}
        rows, store = [], self.s.stores.get(src)
        for r in good.collect():  # what the caller passed in
            if r["hash"] in known:
                errors[r["name"]] = "already exists"
                continue
            known.add(r["hash"])
            try:
                rows.append((str(uuid.uuid4()), r["name"], store.write(r["name"], bytes(r["content"])), require_type(r["name"]), r["hash"], src))
            except AlreadyExists:
                errors[r["name"]] = "already exists"
        if rows:
            self._insert(rows, chunker or Snapping(), parser or ParseConfig())
        return [r[0] for r in rows], errors

    def _insert(self, rows: list[tuple], chunker: ChunkConfig | None, parser: ParseConfig | None) -> None:
        new = self.s.spark.createDataFrame(rows, "id string, name string, path string, ext string, hash string, src string")
        new = new.withColumn("label", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>")).withColumn("created_at", _now()).withColumn("updated_at", _now())
        r = R.insert_documents(self.s.registry, new)
        for table, text in (("chunkers", chunker and chunk_config_to_json(chunker)), ("parsers", parser and parser.to_json())):
            if text:
                r = R.upsert_configs(r, table, new.select(F.concat(F.lit(f"{table}-"), "id").alias("id"), F.col("id").alias("document_id"), F.lit(text).alias("config")), _now())
        self.s.publish(r)

    def delete(self, document_id: str) -> int:
        """The number of documents that went."""
        row = self.get(document_id)
        self.s.publish(R.delete_documents(self.s.registry, self._ids(document_id)))
        self.s.stores.get(row["src"]).delete(row["path"])
        return 1

    def delete_by_path(self, path: str) -> int:
        """Removes the documents with this path, of whatever source, from the registry; files stay. Returns their number."""
        gone = R.documents_at(self.s.registry, path)
        n = gone.count()
        if n:
            self.s.publish(R.delete_documents(self.s.registry, gone))
        return n

    def update(self, document_id: str, name: str, label: str | None = None, tags: list[str] | None = None) -> int:
        """Sets the name, label and tags; returns the number of documents that were changed, 0 if there is none."""
        if R.filtered(self.s.registry.documents, id=document_id).isEmpty():
            return 0
        row = self.s.spark.createDataFrame([(document_id, name, label, tags)], "id string, name string, label string, tags array<string>")
        self.s.publish(R.update_documents(self.s.registry, row, _now()))
        return 1

    def _ids(self, *ids: str) -> DataFrame:
        return self.s.spark.createDataFrame([(i,) for i in ids], "id string")

    def sync(self, src: str) -> None:
        """Documents whose files are gone go; new files are registered without configurations. Only new files are read."""
        store = self.s.stores.get(src)
        files = store.list_files()
        r = R.delete_documents(self.s.registry, R.missing_files(self.s.registry, files, src).select("id"))
        fresh = store.read(R.new_files(r, files, src))
        new = fresh.select(F.sha2(F.concat_ws("|", F.lit(src), "path", "hash"), 256).alias("id"), "name", "path", "ext", "hash", F.lit(src).alias("src"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("tags"), _now().alias("created_at"), _now().alias("updated_at"))
        self.s.publish(R.insert_documents(r, new))

    def update_parser(self, document_id: str, c: ParseConfig) -> None:
        self._update("parsers", document_id, c.to_json())

    def update_chunker(self, document_id: str, c: ChunkConfig) -> None:
        self._update("chunkers", document_id, chunk_config_to_json(c))

    def _update(self, table: str, document_id: str, text: str) -> None:
        self.get(document_id)
        new = self.s.spark.createDataFrame([(str(uuid.uuid4()), document_id, text)], "id string, document_id string, config string")
        self.s.publish(R.upsert_configs(self.s.registry, table, new, _now()))

    def create_default(self, src: str) -> str | None:
        """A first document, if there is none at all."""
        if not self.s.registry.documents.isEmpty():
            return None
        ids, _ = self.upload(src, [DEFAULT_DOCUMENT])
        return ids[0] if ids else None


class VectorService:
    def __init__(self, s: Services):
        self.s = s
        #: By collection: the registry's version and the index of its vectors then.
        self.indexes: dict[str, tuple[int, PivotIndex]] = {}

    def list_collections(self, page: Page = Page()) -> tuple[int, DataFrame]:
        return self.s.registry.collections.count(), R.ordered(self.s.registry.collections, page)

    def list_collections_display(self, page: Page = Page()) -> tuple[int, DataFrame]:
        return self.s.registry.collections.count(), R.ordered(R.collections_display(self.s.registry, page), Page(1, page.per_page, page.sort_by, page.descending))

    def get_collection(self, collection_id: str | None = None, name: str | None = None, provider: str | None = None):
        """By id, or by name and provider."""
        if collection_id is None and (name is None or provider is None):
            raise InvalidInput("a collection's id, or its name and provider")
        keys = {"id": collection_id} if collection_id is not None else {"name": name, "provider": provider}
        row = R.filtered(self.s.registry.collections, **keys).first()
        if row is None:
            raise NotFound(f"collection {collection_id or name}")
        return row

    def get_collection_display(self, collection_id: str):
        self.get_collection(collection_id)
        return R.collections_display(self.s.registry, None, collection_id).first()

    def list_embedding_models(self, embedder: str) -> dict[str, int]:
        return self.s.embedders.get(embedder).models()

    def create_collection(self, name: str, model: str, embedder: str, provider: str) -> str:
        name = collection_name(name)
        if provider not in self.s.vector_stores:
            raise InvalidInput(f"no vector store {provider}")
        dim = size_of(self.s.embedders.get(embedder), model)
        new_id = str(uuid.uuid4())
        row = self.s.spark.createDataFrame([(new_id, name, model, embedder, provider, dim)], "id string, name string, model string, embedder string, provider string, dim int").withColumn("created_at", _now()).withColumn("updated_at", _now())
        self.s.publish(R.insert_collection(self.s.registry, row))
        return new_id

    def create_default_collections(self) -> list[str]:
        """One for each vector store and embedder, unless it is there already."""
        out = []
        for provider in self.s.vector_stores:
            for e in self.s.embedders.ids():
                embedder = self.s.embedders.get(e)
                try:
                    out.append(self.create_collection(f"{DEFAULT_COLLECTION}_{provider}_{e}", embedder.default_model[0], e, provider))
                except AlreadyExists:
                    continue
        return out

    def delete_collection(self, collection_id: str) -> int:
        """The number of collections that went."""
        self.get_collection(collection_id)
        gone = self.s.spark.createDataFrame([(collection_id,)], "id string")
        self.s.publish(R.delete_collections(self.s.registry, gone))
        return 1

    def create_embeddings(self, document_id: str, collection_id: str, chunks: list[str]) -> str:
        """Embeds the chunks and stores them with the membership, at once."""
        collection = self.get_collection(collection_id)
        pair = self.s.spark.createDataFrame([(document_id, collection_id)], "document_id string, collection_id string")
        if R.not_embedded(self.s.registry, pair).isEmpty():
            raise AlreadyExists(f"{document_id} in {collection_id}")
        embedder = self.s.embedders.get(collection["embedder"])
        if size_of(embedder, collection["model"]) != collection["dim"]:
            raise InvalidModel(f"{collection['model']} has another dimension than {collection['name']}")
        new_id = str(uuid.uuid4())
        rows = self.s.spark.createDataFrame(list(enumerate(chunks)), "chunk_idx int, content string")
        vectors = rows.select(F.concat_ws("-", F.lit(new_id), "chunk_idx").alias("vec_id"), F.lit(collection_id).alias("collection_id"), F.lit(document_id).alias("document_id"), "chunk_idx", "content", embedding(F.col("content"), embedder, collection["model"]).alias("embedding"))
        member = pair.select(F.lit(new_id).alias("id"), "document_id", "collection_id", _now().alias("created_at"), _now().alias("updated_at"))
        self.s.publish(R.add_embeddings(self.s.registry, member, vectors))
        return new_id

    def search(self, query: str, limit: int = 5, collection_id: str | None = None, name: str | None = None, provider: str | None = None) -> list[str]:
        """Contents of the nearest chunks, nearest first."""
        if not query.strip() or limit < 1:
            raise InvalidInput("a query and a limit of 1 or more")
        collection = self.get_collection(collection_id, name, provider)
        vector = self.s.embedders.get(collection["embedder"]).embed([query.strip()], collection["model"])[0]
        own = R.filtered(self.s.registry.vectors, collection_id=collection["id"]).where("content is not null")
        number, index = self.indexes.get(collection["id"], (None, None))
        if index is not None and number == self.s.storage.version():
            asked = self.s.spark.createDataFrame([("asked", [float(x) for x in vector])], "query_id string, embedding array<double>")
            found = {r["vec_id"]: r["rank"] for r in pivots.search(index, asked, limit).collect()}
            rows = own.where(F.col("vec_id").isin(list(found))).select("vec_id", "content").collect()  # `limit` rows
            return [r["content"] for r in sorted(rows, key=lambda r: found[r["vec_id"]])]
        return [r["content"] for r in top_k(own, list(vector), limit).select("content", "score").collect()]

    def build_index(self, collection_id: str) -> int:
        """Indexes a collection's vectors; searches use it until the registry changes. Returns the number of vectors."""
        self.get_collection(collection_id)
        number = self.s.storage.version()
        own = R.filtered(self.s.registry.vectors, collection_id=collection_id).where("content is not null")
        index = pivots.build(own, f"{self.s.storage.base}/index-{uuid.uuid4().hex}")
        self.indexes[collection_id] = number, index
        return index.size

    def get_embeddings(self, document_id: str, collection_id: str):
        return R.filtered(self.s.registry.embeddings, document_id=document_id, collection_id=collection_id).first()

    def list_embeddings(self, page: Page = Page(), collection_id: str | None = None) -> tuple[int, DataFrame]:
        some = R.filtered(self.s.registry.embeddings, collection_id=collection_id)
        return some.count(), R.ordered(some, Page(page.page, page.per_page, "id", False))

    def delete_embeddings(self, collection_id: str, document_id: str) -> int:
        """The number of vectors that went."""
        pair = self.s.spark.createDataFrame([(document_id, collection_id)], "document_id string, collection_id string")
        n = self.count_embeddings(collection_id, document_id)
        self.s.publish(R.delete_embeddings(self.s.registry, pair))
        return n

    def count_embeddings(self, collection_id: str, document_id: str) -> int:
        return R.filtered(self.s.registry.vectors, collection_id=collection_id, document_id=document_id).count()


def embed_documents(docs: DataFrame, c: ChunkConfig, e: Embedder, model: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of whole tables with their embeddings: id, chunk_idx, content, embedding."""
    embed = lambda texts: e.embed(texts, model or e.default_model[0])
    rows = chunk_rows(docs.select(id_col, text), c, text, embed)
    return rows.select(id_col, "chunk_idx", F.col("chunk").alias("content"), embedding(F.col("chunk"), e, model).alias("embedding"))
