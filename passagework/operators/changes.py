"""Changes of a registry over whole tables, as plans: uploads, folders that are looked at again, collections, embeddings.

What a service does for one caller's files, these do for tables of files of any size: nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig, ParseConfig, Sliding, chunk_config_to_json
from ..sources.embedders import Embedder, embedding
from ..sources.store import ingest
from . import registry as R
from .chunking import chunk_rows


def _documents(r: R.Registry, rows: DataFrame, src: str, now: Column) -> DataFrame:
    """Rows (name, path, ext, hash) as documents of the source; ids follow from what they hold."""
    id_ = F.sha2(F.concat_ws("|", F.lit(src), "path", "hash"), 256)
    out = rows.select(id_.alias("id"), "name", "path", "ext", "hash", F.lit(src).alias("src"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("tags"), now.alias("created_at"), now.alias("updated_at"))
    return out.select(*[F.col(c).cast(r.documents.schema[c].dataType) for c in r.documents.columns])


def upload(r: R.Registry, files: DataFrame, src: str, now: Column, chunker: ChunkConfig | None = None, parser: ParseConfig | None = None) -> tuple[R.Registry, DataFrame]:
    """The registry with the new ones of these files (name, content) and their configurations, and (name, error) of the others:
    of an unsupported type, without content, or there already, by content, in the registry or under an earlier name."""
    good, bad = ingest(files)
    first = Window.partitionBy("hash").orderBy("name")
    marked = good.withColumn("place", F.row_number().over(first)).join(r.documents.select(F.col("hash").alias("known")).distinct(), F.col("hash") == F.col("known"), "left")
    fresh = (F.col("place") == 1) & F.col("known").isNull()
    again = marked.where(~fresh).select("name", F.lit("already exists").alias("error"))
    new = _documents(r, marked.where(fresh).withColumn("path", F.concat(F.lit(f"{src}/"), "name")), src, now)
    out = R.insert_documents(r, new)
    for table, text in (("chunkers", chunker and chunk_config_to_json(chunker)), ("parsers", parser and parser.to_json())):
        if text:
            out = R.upsert_configs(out, table, new.select(F.concat(F.lit(f"{table}-"), "id").alias("id"), F.col("id").alias("document_id"), F.lit(text).alias("config")), now)
    return out, bad.unionByName(again)


def sync(r: R.Registry, files: DataFrame, src: str, now: Column) -> R.Registry:
    """Documents of the source whose paths aren't among the files (name, path, ext, hash) go, with all that refers to them; files
    that aren't registered become documents without configurations."""
    pruned = R.delete_documents(r, R.missing_files(r, files, src).select("id"))
    return R.insert_documents(pruned, _documents(r, R.new_files(pruned, files, src), src, now))


def default_collections(r: R.Registry, providers: Iterable[str], embedders: Iterable[tuple[str, str, int]], now: Column) -> R.Registry:
    """With a collection for each provider and embedder (id, model, dimension) whose name and provider aren't taken."""
    spark = r.documents.sparkSession
    names = [(f"Default_{p}_{e}", model, e, p, dim) for p in providers for e, model, dim in embedders]
    rows = spark.createDataFrame(names, "name string, model string, embedder string, provider string, dim int")
    new = rows.join(r.collections.select("name", "provider"), ["name", "provider"], "left_anti").withColumn("created_at", now).withColumn("updated_at", now)
    new = new.withColumn("id", F.sha2(F.concat_ws("|", "name", "provider"), 256)).select(*[F.col(c).cast(r.collections.schema[c].dataType) for c in r.collections.columns])
    return r.changed("collections", "put", new, r.collections.unionByName(new))


def embed_into(r: R.Registry, texts: DataFrame, collection_id: object, embedder: Embedder, now: Column, chunker: ChunkConfig = Sliding()) -> R.Registry:
    """With the chunks of these documents (document_id, text) as vectors of the collection; those that are in it stay as they
    are, those without chunks don't get in."""
    todo = texts.join(R.filtered(r.embeddings, collection_id=collection_id).select("document_id"), "document_id", "left_anti")
    chunks = chunk_rows(todo.select("document_id", "text"), chunker)
    key = F.sha2(F.concat_ws("|", F.lit(collection_id).cast("string"), F.col("document_id").cast("string")), 256)
    vectors = chunks.select(F.concat_ws("-", key, "chunk_idx").alias("vec_id"), F.lit(collection_id).alias("collection_id"), "document_id", "chunk_idx", F.col("chunk").alias("content"), embedding(F.col("chunk"), embedder).alias("embedding"))
    members = chunks.where("chunk_idx = 0").select(key.alias("id"), "document_id", F.lit(collection_id).alias("collection_id"), now.alias("created_at"), now.alias("updated_at"))
    return R.add_embeddings(r, members, vectors)
