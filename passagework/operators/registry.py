"""The registry of documents, configurations, collections and embeddings as DataFrames: listings, look-ups, changes.

A Registry is a value: a change gives a new one, whose tables are plans over the old ones, and keeps a log of the rows that
it put and dropped, from which a store writes what changed and no more. Uniqueness is held by anti joins, cascades by anti
joins on the keys that went. Nothing is collected but the keys and rows that a caller passes in.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Page
from ..errors import AlreadyExists, InvalidInput
from . import paging

SCHEMAS = {
    "documents": "id string, name string, path string, ext string, hash string, src string, label string, tags array<string>, created_at timestamp, updated_at timestamp",
    "chunkers": "id string, document_id string, config string, created_at timestamp, updated_at timestamp",
    "parsers": "id string, document_id string, config string, created_at timestamp, updated_at timestamp",
    "collections": "id string, name string, model string, embedder string, provider string, dim int, created_at timestamp, updated_at timestamp",
    "embeddings": "id string, document_id string, collection_id string, created_at timestamp, updated_at timestamp",
    "vectors": "vec_id string, collection_id string, document_id string, chunk_idx int, content string, embedding array<double>",
}


@dataclass(frozen=True)
class Change:
    table: str
    #: "put" or "drop".
    kind: str
    rows: DataFrame
    #: The table afterwards.
    after: DataFrame


@dataclass(frozen=True, eq=False)
class Registry:
    documents: DataFrame
    chunkers: DataFrame
    parsers: DataFrame
    collections: DataFrame
    embeddings: DataFrame
    vectors: DataFrame
    #: How the tables came from those of `origin`, in order.
    changes: tuple[Change, ...] = ()
    origin: Registry | None = None

    def changed(self, table: str, kind: str, rows: DataFrame, after: DataFrame) -> Registry:
        """With `after` as the table, which is the present one with `rows` put (whole rows; of the keyed tables they replace those
        with their ids), or without those that `rows` name (by id; vectors by document_id, collection_id or both)."""
        return replace(self, **{table: after}, changes=(*self.changes, Change(table, kind, rows, after)), origin=self.origin or self)

    @classmethod
    def empty(cls, spark: SparkSession) -> Registry:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def ordered(df: DataFrame, page: Page, id_col: str = "id") -> DataFrame:
    """A page by the page's column (nulls first when descending, last when ascending), ties by id. A deep page doesn't gather
    the rows before it."""
    if page.sort_by not in df.columns:
        raise InvalidInput(f"no column {page.sort_by}")
    return paging.page(df, page.sort_by, id_col, page.descending, page.offset, page.per_page)


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have these values; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def documents(r: Registry, src: str | None = None, ready: bool | None = None) -> DataFrame:
    """Documents by source; ready: with both a chunker and a parser; not ready: with neither."""
    df = filtered(r.documents, src=src)
    if ready is None:
        return df
    how = "left_semi" if ready else "left_anti"
    for configs in (r.chunkers, r.parsers):
        keys = configs.select(F.col("document_id").alias("id"))
        df = df.join(keys, "id", how)
    return df


def document_configs(r: Registry, document_id: object | None = None) -> DataFrame:
    """Documents with their chunker's and parser's configuration, null where there is none."""
    chunkers = r.chunkers.select(F.col("document_id").alias("id"), F.col("config").alias("chunk_config"))
    parsers = r.parsers.select(F.col("document_id").alias("id"), F.col("config").alias("parse_config"))
    return filtered(r.documents, id=document_id).join(chunkers, "id", "left").join(parsers, "id", "left")


def documents_display(r: Registry, page: Page, src: str | None = None, document_id: object | None = None) -> DataFrame:
    """A page of documents, each with the collections it is embedded in, by their ids."""
    some = ordered(filtered(r.documents, src=src, id=document_id), page)
    shown = some.select(F.col("id").alias("document_id"))
    where = r.embeddings.join(shown, "document_id", "left_semi").join(r.collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name")), "collection_id")
    listed = where.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("collection_id", "collection_name"))).alias("collections"))
    none = F.array().cast(listed.schema["collections"].dataType)
    out = some.join(listed, "id", "left").withColumn("collections", F.coalesce("collections", none))
    return ordered(out, replace(page, page=1))


def document_counts(r: Registry) -> DataFrame:
    """Distinct documents of each collection that has any."""
    return r.embeddings.groupBy("collection_id").agg(F.countDistinct("document_id").alias("document_count"))


def collections_display(r: Registry, page: Page | None = None, collection_id: object | None = None) -> DataFrame:
    """Collections with their number of documents and the documents (id, name) by id; a page of them, or one."""
    some = filtered(r.collections, id=collection_id)
    some = ordered(some, page) if page else some
    names = r.documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    shown = some.select(F.col("id").alias("collection_id"))
    members = r.embeddings.select("document_id", "collection_id").join(shown, "collection_id", "left_semi")
    listed = names.join(members, "document_id", "right").groupBy("collection_id").agg(F.array_sort(F.collect_set(F.struct("document_id", "document_name"))).alias("documents"))
    none = F.array().cast(listed.schema["documents"].dataType)
    out = some.join(listed, some["id"] == listed["collection_id"], "left").drop("collection_id")
    counts = members.groupBy("collection_id").agg(F.countDistinct("document_id").alias("document_count"))
    out = out.join(counts, out["id"] == counts["collection_id"], "left").drop("collection_id")
    return out.withColumn("document_count", F.coalesce("document_count", F.lit(0))).withColumn("documents", F.coalesce("documents", none))


def assigned_collections(r: Registry, document_id: object) -> DataFrame:
    """Collections that the document is embedded in."""
    of = filtered(r.embeddings, document_id=document_id).select(F.col("collection_id").alias("id"))
    return r.collections.join(of, "id", "left_semi")


def embeddings_by_name(r: Registry, document_id: object, name: str, provider: str) -> DataFrame:
    named = r.collections.where((F.col("name") == name) & (F.col("provider") == provider)).select(F.col("id").alias("collection_id"))
    return filtered(r.embeddings, document_id=document_id).join(named, "collection_id", "left_semi")


def vector_counts(r: Registry, collection_id: object | None = None, document_id: object | None = None) -> DataFrame:
    return filtered(r.vectors, collection_id=collection_id, document_id=document_id).groupBy("collection_id", "document_id").agg(F.count(F.lit(1)).alias("n_vectors"))


def without(df: DataFrame, keys: DataFrame, on: str, key: str = "id") -> DataFrame:
    return df.join(keys.select(F.col(key).alias(on)), on, "left_anti")


def _dropped(r: Registry, table: str, keys: DataFrame, on: list[str]) -> Registry:
    """Without the table's rows that have these keys."""
    old = getattr(r, table)
    rows = keys.select(on) if table == "vectors" else old.join(keys.select(on), on, "left_semi").select("id", *(["collection_id"] if table == "embeddings" else []))
    return r.changed(table, "drop", rows, old.join(keys.select(on), on, "left_anti").select(old.columns))


def insert_documents(r: Registry, new: DataFrame) -> Registry:
    """Rows whose (src, path, hash) isn't there yet, and of equal ones the first by id, are added."""
    once = new.groupBy("src", "path", "hash").agg(F.min_by(F.struct(*new.columns), "id").alias("row")).select("row.*")
    fresh = once.join(r.documents.select("src", "path", "hash"), ["src", "path", "hash"], "left_anti").select(r.documents.columns)
    return r.changed("documents", "put", fresh, r.documents.unionByName(fresh))


def delete_documents(r: Registry, gone: DataFrame) -> Registry:
    """Without the documents whose ids are in `gone`, and without all that refers to them."""
    keys = gone.select(F.col("id").alias("document_id"))
    out = r.changed("documents", "drop", gone.select("id"), without(r.documents, gone, "id").select(r.documents.columns))
    for name in ("chunkers", "parsers", "embeddings", "vectors"):
        out = _dropped(out, name, keys, ["document_id"])
    return out


def documents_at(r: Registry, path: str) -> DataFrame:
    """Ids of the documents with this path, of whatever source."""
    return filtered(r.documents, path=path).select("id")


def upsert_configs(r: Registry, table: str, new: DataFrame, now: Column) -> Registry:
    """Chunkers or parsers by document: a new configuration replaces the old one, whose id and creation time stay; the time
    of change moves only if the configuration did. new: id, document_id, config."""
    old = getattr(r, table)
    fresh = new.select(F.col("document_id"), F.col("id").alias("n_id"), F.col("config").alias("n_config"))
    both = fresh.join(old, "document_id", "left")
    changed = F.col("n_config").isNotNull() & ~F.col("config").eqNullSafe(F.col("n_config"))
    put = both.select(
        F.coalesce("id", "n_id").alias("id"), "document_id", F.coalesce("n_config", "config").alias("config"), F.coalesce("created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(old.columns)
    return r.changed(table, "put", put, old.join(fresh.select("document_id"), "document_id", "left_anti").select(old.columns).unionByName(put))


def update_documents(r: Registry, changes: DataFrame, now: Column) -> Registry:
    """Name, label and tags of the documents in `changes` (id, name, label, tags): all three are set, to null as well."""
    new = changes.select("id", *[F.col(c).alias(f"n_{c}") for c in ("name", "label", "tags")])
    put = r.documents.join(new, "id")
    for c in ("name", "label", "tags"):
        put = put.withColumn(c, F.col(f"n_{c}"))
    put = put.withColumn("updated_at", now).select(r.documents.columns)
    return r.changed("documents", "put", put, without(r.documents, changes, "id").select(r.documents.columns).unionByName(put))


def insert_collection(r: Registry, row: DataFrame) -> Registry:
    """One collection; its (name, provider) must be new."""
    if not row.join(r.collections.select("name", "provider"), ["name", "provider"], "left_semi").isEmpty():
        raise AlreadyExists("collection")
    own = row.select(r.collections.columns)
    return r.changed("collections", "put", own, r.collections.unionByName(own))


def delete_collections(r: Registry, gone: DataFrame) -> Registry:
    keys = gone.select(F.col("id").alias("collection_id"))
    out = r.changed("collections", "drop", gone.select("id"), without(r.collections, gone, "id").select(r.collections.columns))
    for name in ("embeddings", "vectors"):
        out = _dropped(out, name, keys, ["collection_id"])
    return out


def not_embedded(r: Registry, pairs: DataFrame) -> DataFrame:
    """Of (document_id, collection_id), those without an embedding."""
    return pairs.join(r.embeddings.select("document_id", "collection_id"), ["document_id", "collection_id"], "left_anti")


def add_embeddings(r: Registry, embeddings: DataFrame, vectors: DataFrame) -> Registry:
    """Memberships that aren't there yet, and the vectors that belong to them."""
    new = embeddings.join(r.embeddings.select("document_id", "collection_id"), ["document_id", "collection_id"], "left_anti").dropDuplicates(["document_id", "collection_id"]).select(r.embeddings.columns)
    own = vectors.join(new.select("document_id", "collection_id"), ["document_id", "collection_id"], "left_semi").select(r.vectors.columns)
    out = r.changed("embeddings", "put", new, r.embeddings.unionByName(new))
    return out.changed("vectors", "put", own, r.vectors.unionByName(own))


def delete_embeddings(r: Registry, pairs: DataFrame) -> Registry:
    """Without the memberships and vectors of these (document_id, collection_id)."""
    out = r
    for name in ("embeddings", "vectors"):
        out = _dropped(out, name, pairs, ["document_id", "collection_id"])
    return out


def missing_files(r: Registry, files: DataFrame, src: str) -> DataFrame:
    """Documents of the source whose path isn't among the files."""
    return filtered(r.documents, src=src).join(files.select("path"), "path", "left_anti")


def new_files(r: Registry, files: DataFrame, src: str) -> DataFrame:
    """Files whose (path, src) isn't registered. What they hold isn't looked at before."""
    return files.join(filtered(r.documents, src=src).select("path"), "path", "left_anti")
