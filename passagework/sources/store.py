"""Document bytes in folders: a listing is a scan without the contents, a read is a scan with them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, NotFound
from ..functions.text import content_hash, file_type, unicode_trim

#: Paths up to which a read opens just these files; more of them are found by scanning the folder.
FEW_PATHS = 10_000


class FolderStore:
    """Files directly in a folder of any file system that Spark knows; those of unsupported types are left out."""

    def __init__(self, spark: SparkSession, base: str, name: str = "fs"):
        self.spark, self.base, self.id = spark, base.rstrip("/"), name

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _files(self, paths: list[str] | None = None) -> DataFrame:
        # a path is taken for a pattern, so what would mean something in one is escaped
        where = self.base if paths is None else [re.sub(r"([\[\]{}*?\\])", r"\\\1", x) for x in paths]
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(where)
        name = F.substring_index("path", "/", -1)
        return files.withColumn("name", name).withColumn("ext", file_type(name)).where("ext is not null")

    def list_files(self) -> DataFrame:
        """name, ext, path, length; contents aren't read."""
        return self._files().select("name", "ext", "path", "length")

    def read(self, paths: DataFrame | None = None) -> DataFrame:
        """name, ext, path, hash, content; of these paths, which must be there, if there are any given. Only their files
        are opened; of more than FEW_PATHS the whole folder is scanned."""
        if paths is None:
            files = self._files()
        else:
            wanted = [r["path"] for r in paths.select("path").distinct().limit(FEW_PATHS + 1).collect()]
            if not wanted:
                files = self._files().limit(0)
            elif len(wanted) <= FEW_PATHS:
                files = self._files(wanted)
            else:
                files = self._files().join(paths.select("path"), "path", "left_semi")
        return files.select("name", "ext", "path", content_hash(F.col("content")).alias("hash"), "content")

    def write(self, name: str, content: bytes) -> str:
        """The new file's path; a file of that name must not exist."""
        fs, path = self._fs()
        at = path(f"{self.base}/{name}")
        if fs.exists(at):
            raise AlreadyExists(name)
        out = fs.create(at, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return fs.makeQualified(at).toString()

    def delete(self, path: str) -> None:
        fs, at = self._fs()
        if not fs.delete(at(path), False):
            raise NotFound(path)


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of uploaded files (name, content): good ones with ext and hash, and (name, error) of the others."""
    checked = files.withColumn("name", unicode_trim(F.col("name"))).withColumn("ext", file_type(F.col("name"))).withColumn("hash", content_hash(F.col("content")))
    error = F.when(F.col("ext").isNull(), "unsupported file type").when(F.col("content").isNull(), "no content")
    checked = checked.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null").select("name", "error")
