"""Registries on storage: append-only change logs for the keyed tables, deletion vectors for the vectors, and manifests.

A manifest is a small JSON file with a number; the highest number counts. It names the folders that make each table:

* A keyed table (documents, chunkers, parsers, collections, embeddings) has a base and deltas. A change appends one delta with
  the rows that it put and the ids that it dropped; the delta of a higher number wins, so at read the deltas are reduced to
  the latest row of each id, and the base goes through an anti join with those ids. Deltas are compacted by size: TIER of
  them in a row of about the same size become one, and deltas that weigh as much as their base are merged into it, so a row
  is written again a logarithmic number of times.
* Vectors have parts, partitioned by collection, and deletions: bitmaps of row positions for each file and bucket of positions,
  which the scan of the parts applies. A removal reads the keys of the collections that it concerns and writes bitmaps; no
  vector is written again before compaction: the smaller half of the parts becomes one when there are more than MOST_PARTS,
  all do when a third of all rows are deleted.

* Counts of the memberships and vectors of each collection are sums of what each change added and took away, so counts()
  reads no membership and no vector.

So what a change writes grows with the change, not with its table. A manifest also holds the last transaction of each
writer: one that is saved again changes nothing. vacuum() removes folders that the present manifest doesn't name.

Defined results: a put replaces the row with its id; within one change the last put or drop of an id counts; dropping what
isn't there does nothing; null ids are kept apart from all others and can't be dropped; vectors are dropped by document_id,
collection_id or both, null keys match nothing.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import AlreadyExists, NotFound
from ..operators.registry import SCHEMAS, Change, Registry

#: Parts of the vectors beyond which the smaller half become one, and the inverse of the share of deleted rows that makes all one.
MOST_PARTS, DELETED = 64, 3
#: Deltas of about one size that become one, by how much sizes differ that count as one, and bytes below which all count as one.
TIER, STEP, SMALL = 4, 4, 1 << 16

KEYED = [name for name in SCHEMAS if name != "vectors"]
_DELTA = "_at int, _gone boolean"
_COUNTS = "collection_id string, n_documents bigint, n_vectors bigint"
_BITMAPS = "collection_id string, file string, bucket bigint, bits binary"


def new_base(spark: SparkSession) -> str:
    """A folder for a registry in the one that spark.checkpoint.dir names; without a cluster a local one will do."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise NotFound("spark.checkpoint.dir must name a shared folder")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='passagework-')).rstrip('/')}/registry-{uuid.uuid4().hex}"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _has_bit(bits: Column, position: Column) -> Column:
    """Whether the bitmap has the bit at a position."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class RegistryStore:
    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, (base or new_base(spark)).rstrip("/")
        self.loaded: tuple[int, Registry] | None = None

    # --- files ---

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _bytes(self, path: str) -> int:
        fs, at = self._fs()
        return fs.getContentSummary(at(f"{self.base}/{path}")).getLength()

    def version(self) -> int | None:
        """The number of the present manifest."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.base}/manifest-*.json")) or []
        return max((int(m[1]) for x in found if (m := re.search(r"manifest-(\d+)\.json$", x.getPath().toString()))), default=None)

    def manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.base}/manifest-{number:012d}.json").first()["value"])

    def transaction(self, writer: str) -> int | None:
        """The last transaction of this writer that was saved."""
        number = self.version()
        return None if number is None else self.manifest(number).get("transactions", {}).get(writer)

    def vacuum(self) -> list[str]:
        """Removes the folders of changes that the present manifest names nothing of; older readers must be done. Returns them."""
        number = self.version()
        if number is None:
            return []
        m = self.manifest(number)
        paths = [p for t in m["tables"].values() for p in (t["base"], *(d["path"] for d in t["deltas"])) if p] + [p["path"] for p in m["vectors"]] + [d["path"] for d in m["deletions"]] + m["counts"]
        used = {p.split("/")[0] for p in paths}
        fs, path = self._fs()
        gone = [x.getPath() for x in fs.globStatus(path(f"{self.base}/v-*")) or [] if x.getPath().getName() not in used]
        for x in gone:
            fs.delete(x, True)
        return [x.getName() for x in gone]

    # --- reading ---

    def _latest(self, name: str, deltas: list[dict]) -> DataFrame:
        """The last row of each id in these deltas, dropped ones with _gone."""
        columns = StructType.fromDDL(SCHEMAS[name]).fieldNames()
        rows = _union([self.spark.read.schema(f"{SCHEMAS[name]}, {_DELTA}").parquet(f"{self.base}/{d['path']}").withColumn("_part", F.lit(k)) for k, d in enumerate(deltas)])
        last = rows.groupBy("id").agg(F.max_by(F.struct(*columns, "_gone"), F.struct("_part", "_at")).alias("row"))
        return last.select("row.*")

    def _table(self, name: str, entry: dict) -> DataFrame:
        columns = StructType.fromDDL(SCHEMAS[name]).fieldNames()
        base = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{entry['base']}")
        if not entry["deltas"]:
            return base
        last = self._latest(name, entry["deltas"])
        return base.join(last.select("id"), "id", "left_anti").select(columns).unionByName(last.where("not _gone").select(columns))

    def _placed(self, parts: list[dict]) -> DataFrame:
        """Rows of these parts with their file and position, counted from 1."""
        rows = _union([self.spark.read.schema(SCHEMAS["vectors"]).parquet(f"{self.base}/{p['path']}").select("*", "_metadata.file_path", "_metadata.row_index") for p in parts])
        file = F.regexp_extract("file_path", r"(v-[0-9a-f]{32}/.*)$", 1)
        return rows.withColumn("file", file).withColumn("row", F.col("row_index") + 1).drop("file_path", "row_index")

    def _live(self, parts: list[dict], deletions: list[dict]) -> DataFrame:
        """Rows of these parts that no deletion has, with their file and position."""
        rows = self._placed(parts)
        if not deletions:
            return rows
        marks = _union([self.spark.read.schema(_BITMAPS).parquet(f"{self.base}/{d['path']}") for d in deletions])
        marks = marks.groupBy(*[F.col(c).alias(f"d_{c}") for c in ("collection_id", "file", "bucket")]).agg(F.bitmap_or_agg("bits").alias("d_bits"))
        same = rows["collection_id"].eqNullSafe(F.col("d_collection_id")) & (F.col("file") == F.col("d_file")) & (F.bitmap_bucket_number("row") == F.col("d_bucket"))
        gone = F.coalesce(_has_bit(F.col("d_bits"), F.bitmap_bit_position("row")), F.lit(False))
        return rows.join(marks, same, "left").where(~gone).select(rows.columns)

    def _vectors(self, m: dict) -> DataFrame:
        names = StructType.fromDDL(SCHEMAS["vectors"]).fieldNames()
        if not m["deletions"]:
            return _union([self.spark.read.schema(SCHEMAS["vectors"]).parquet(f"{self.base}/{p['path']}") for p in m["vectors"]])
        return self._live(m["vectors"], m["deletions"]).select(names)

    def counts(self) -> DataFrame:
        """collection_id, n_documents, n_vectors of each collection that has any."""
        number = self.version()
        if number is None:
            raise NotFound(self.base)
        return self._summed(self.manifest(number)["counts"])

    def _summed(self, paths: list[str]) -> DataFrame:
        rows = _union([self.spark.read.schema(_COUNTS).parquet(f"{self.base}/{p}") for p in paths])
        summed = rows.groupBy("collection_id").agg(F.sum("n_documents").alias("n_documents"), F.sum("n_vectors").alias("n_vectors"))
        return summed.where("n_documents <> 0 or n_vectors <> 0")

    def load(self) -> Registry:
        number = self.version()
        if number is None:
            raise NotFound(self.base)
        if self.loaded is None or self.loaded[0] != number:
            m = self.manifest(number)
            self.loaded = number, Registry(**{name: self._table(name, entry) for name, entry in m["tables"].items()}, vectors=self._vectors(m))
        return self.loaded[1]

    # --- writing ---

    def _counted(self, df: DataFrame, path: str, by: str | None = None, what: Column | None = None) -> dict:
        """Writes df; its path, and the number of its rows or the sum of `what`."""
        seen = Observation()
        writer = df.observe(seen, F.coalesce(F.sum(what), F.lit(0)).alias("n") if what is not None else F.count(F.lit(1)).alias("n")).write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.base}/{path}")
        return {"path": path, "rows": seen.get.get("n") or 0}

    def _whole(self, df: DataFrame, path: str) -> dict:
        df.write.parquet(f"{self.base}/{path}")
        return {"base": path, "deltas": []}

    def _appended(self, name: str, entry: dict, log: list[Change], new: str) -> dict:
        """The table's entry with one more delta, compacted where that is due."""
        schema = StructType.fromDDL(SCHEMAS[name])
        rows = []
        for at, change in enumerate(log):
            own = change.rows if change.kind == "put" else change.rows.select("id")
            columns = [F.col(f.name) if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            rows.append(own.select(*columns, F.lit(at).alias("_at"), F.lit(change.kind == "drop").alias("_gone")))
        path = f"{new}/{name}/delta"
        _union(rows).write.parquet(f"{self.base}/{path}")
        deltas = [*entry["deltas"], {"path": path, "bytes": self._bytes(path)}]
        tier = lambda d: max(d["bytes"], SMALL).bit_length() // (STEP.bit_length() - 1)
        k = 0
        while len(deltas) >= TIER and len({tier(d) for d in deltas[-TIER:]}) == 1:
            merged = self._latest(name, deltas[-TIER:]).select(*schema.fieldNames(), F.lit(0).alias("_at"), "_gone")
            path, k = f"{new}/{name}/merged-{k}", k + 1
            merged.write.parquet(f"{self.base}/{path}")
            deltas = [*deltas[:-TIER], {"path": path, "bytes": self._bytes(path)}]
        if sum(d["bytes"] for d in deltas) >= max(self._bytes(entry["base"]), TIER * SMALL):
            return self._whole(self._table(name, {"base": entry["base"], "deltas": deltas}), f"{new}/{name}/base")
        return {"base": entry["base"], "deltas": deltas}

    def _changed_vectors(self, log: list[Change], m: dict, new: str) -> tuple[list[dict], list[dict]]:
        """Parts and deletions after these changes."""
        parts, deletions = list(m["vectors"]), list(m["deletions"])
        for k, change in enumerate(log):
            if change.kind == "put":
                rows = change.rows
                for later in log[k + 1 :]:
                    if later.kind == "drop":
                        rows = rows.join(later.rows, later.rows.columns, "left_anti").select(change.rows.columns)
                parts.append(self._counted(rows, f"{new}/vectors-{k}", "collection_id"))
            elif m["vectors"]:
                live = self._live(m["vectors"], deletions).join(change.rows.distinct(), change.rows.columns, "left_semi")
                bits = live.groupBy("collection_id", "file", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
                name = "vectors-touched" if k == 0 or all(c.kind == "put" for c in log[:k]) else f"vectors-touched-{k}"
                told = self._counted(bits, f"{new}/{name}", "collection_id", F.bitmap_count("bits"))
                if told["rows"]:
                    deletions.append(told)
        return parts, deletions

    def _counts_of(self, rows: DataFrame, name: str, sign: int = 1, what: Column | None = None) -> DataFrame:
        """Counts of these rows by collection, as n_documents or n_vectors."""
        n = (F.count(F.lit(1)) if what is None else F.sum(what)) * sign
        none = F.lit(0).cast("bigint")
        return rows.groupBy("collection_id").agg(*[(n if c == name else F.max(none)).cast("bigint").alias(c) for c in ("n_documents", "n_vectors")])

    def _counted_changes(self, log: list[Change], old: dict, parts: list[dict], deletions: list[dict], new: str) -> list[str]:
        """The counts' folders with one more for these changes."""
        frames = [self._counts_of(c.rows, "n_documents", 1 if c.kind == "put" else -1) for c in log if c.table == "embeddings"]
        read = lambda x, schema: self.spark.read.schema(schema).parquet(f"{self.base}/{x['path']}")
        frames += [self._counts_of(read(p, SCHEMAS["vectors"]), "n_vectors") for p in parts if p not in old["vectors"]]
        frames += [self._counts_of(read(d, _BITMAPS), "n_vectors", -1, F.bitmap_count("bits")) for d in deletions if d not in old["deletions"]]
        if not frames:
            return old["counts"]
        _union(frames).write.parquet(f"{self.base}/{new}/embeddings/counts")
        paths = [*old["counts"], f"{new}/embeddings/counts"]
        if len(paths) > 2 * TIER:
            self._summed(paths).write.parquet(f"{self.base}/{new}/embeddings/counts-merged")
            paths = [f"{new}/embeddings/counts-merged"]
        return paths

    def _all_counts(self, tables: dict, parts: list[dict], deletions: list[dict], new: str) -> list[str]:
        members, vectors = self._table("embeddings", tables["embeddings"]), self._vectors({"vectors": parts, "deletions": deletions})
        self._counts_of(members, "n_documents").unionByName(self._counts_of(vectors, "n_vectors")).write.parquet(f"{self.base}/{new}/embeddings/counts")
        return [f"{new}/embeddings/counts"]

    def _compacted(self, parts: list[dict], deletions: list[dict], new: str) -> tuple[list[dict], list[dict]]:
        names = StructType.fromDDL(SCHEMAS["vectors"]).fieldNames()
        rows, gone = sum(p["rows"] for p in parts), sum(d["rows"] for d in deletions)
        if gone * DELETED > rows:
            return [self._counted(self._live(parts, deletions).select(names), f"{new}/vectors-whole", "collection_id")], []
        if len(parts) > MOST_PARTS:
            by_size = sorted(parts, key=lambda p: p["rows"])
            some = by_size[: max(2, len(parts) // 2)]
            one = self._counted(self._live(some, deletions).select(names), f"{new}/vectors-merged", "collection_id")
            return [p for p in parts if p not in some] + [one], deletions
        return parts, deletions

    def save(self, r: Registry, transaction: tuple[str, int] | None = None) -> Registry:
        """What r changed, under a new version, then the manifest; readers see the old version or the new one. What a table
        is computed from is never overwritten. A transaction (writer, number) that isn't over the writer's last one does nothing.
        Raises if another writer was first."""
        number, new = self.version(), f"v-{uuid.uuid4().hex}"
        old = None if number is None else self.manifest(number)
        done = {} if old is None else old.get("transactions", {})
        if transaction and done.get(transaction[0], -1) >= transaction[1]:
            return self.load()
        before = self.loaded[1] if old is not None and self.loaded is not None and self.loaded[0] == number else None
        tables, whole = {}, False
        for name in KEYED:
            log = [c for c in r.changes if c.table == name]
            if before is not None and getattr(r, name) is getattr(before, name):
                tables[name] = old["tables"][name]
            elif before is not None and r.origin is before and log and log[-1].after is getattr(r, name):
                tables[name] = self._appended(name, old["tables"][name], log, new)
            else:
                tables[name] = self._whole(getattr(r, name), f"{new}/{name}/base")
                whole = whole or name == "embeddings"
        log = [c for c in r.changes if c.table == "vectors"]
        if before is not None and r.vectors is before.vectors:
            parts, deletions = old["vectors"], old["deletions"]
        elif before is not None and r.origin is before and log and log[-1].after is r.vectors:
            parts, deletions = self._changed_vectors(log, old, new)
        else:
            parts, deletions, whole = [self._counted(r.vectors, f"{new}/vectors", "collection_id")], [], True
        counts = self._all_counts(tables, parts, deletions, new) if whole or "counts" not in (old or {}) else self._counted_changes(list(r.changes), old, parts, deletions, new)
        if old is None or parts is not old["vectors"]:
            parts, deletions = self._compacted(parts, deletions, new)
        done = done | ({transaction[0]: transaction[1]} if transaction else {})
        self._publish((number or 0) + 1, {"tables": tables, "vectors": parts, "deletions": deletions, "counts": counts, "transactions": done})
        return self.load()

    def compact(self) -> Registry:
        """Every table as one base, the vectors as one part without deletions."""
        number, new = self.version(), f"v-{uuid.uuid4().hex}"
        if number is None:
            raise NotFound(self.base)
        m, r = self.manifest(number), self.load()
        tables = {name: self._whole(getattr(r, name), f"{new}/{name}/base") if entry["deltas"] else entry for name, entry in m["tables"].items()}
        vectors = m["vectors"] if len(m["vectors"]) == 1 and not m["deletions"] else [self._counted(r.vectors, f"{new}/vectors-whole", "collection_id")]
        self._summed(m["counts"]).write.parquet(f"{self.base}/{new}/embeddings/counts-merged")
        self._publish(number + 1, {**m, "tables": tables, "vectors": vectors, "deletions": [], "counts": [f"{new}/embeddings/counts-merged"]})
        return self.load()

    def _publish(self, number: int, manifest: dict) -> None:
        fs, path = self._fs()
        staged, at = path(f"{self.base}/.staged-{uuid.uuid4().hex}"), path(f"{self.base}/manifest-{number:012d}.json")
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(at) or not fs.rename(staged, at):
            fs.delete(staged, False)
            raise AlreadyExists(f"version {number} of {self.base}")
