"""Memberships as keyed state: a stream of single changes, each an addition or a removal of a document in a collection.

The state of a pair (collection, document) is the number of its last change and whether it is a member. Pairs are dealt to
BUCKETS keys by their hash, as each key of a batch costs calls between Python and Spark that take far longer than its changes;
a batch rewrites the states of the buckets that it touches. A batch's changes of a pair run by their numbers; one whose number
isn't over the last one has been seen and gives nothing, so a change that is sent twice counts once. Every other change gives a
row: an addition of a member is told as "already exists", a removal of what isn't one as "not there". The memberships of a
registry can be given as the state to begin with; afterwards no batch reads them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGE = "number long, job_id string, collection_id string, document_id string, action string"
RESULT = "number long, job_id string, collection_id string, document_id string, kind string, error string"
FILES_PER_BATCH = 128
#: Keys of the state, at most; fixed for a checkpoint.
BUCKETS = 4096
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Memberships(StatefulProcessor):
    """The pairs of one bucket: their state is read once for a batch's changes and written once after them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memberships", "collections array<string>, documents array<string>, numbers array<long>, members array<boolean>")

    def _held(self) -> dict[tuple, tuple[int, bool]]:
        held = self.state.get()
        return {} if held is None else {(c, d): (n, m) for c, d, n, m in zip(*held, strict=True)}

    def _keep(self, pairs: dict[tuple, tuple[int, bool]]) -> None:
        self.state.update(([c for c, _ in pairs], [d for _, d in pairs], [n for n, _ in pairs.values()], [m for _, m in pairs.values()]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = zip(initialState["collection_id"].tolist(), initialState["document_id"].tolist(), strict=True)
        self._keep(self._held() | dict.fromkeys(first, (-1, True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("number", kind="stable")
        pairs, out = self._held(), []
        for number, job, collection, document, action in zip(*(changes[c].tolist() for c in ("number", "job_id", "collection_id", "document_id", "action")), strict=True):
            last, member = pairs.get((collection, document), (-1, False))
            if number <= last:
                continue
            add = action == "add"
            error = ("already exists" if add else "not there") if add == member else None
            out.append((number, job, collection, document, "addition" if add else "removal", error))
            pairs[collection, document] = number, add
        if out:
            self._keep(pairs)
            yield pd.DataFrame(out, columns=["number", "job_id", "collection_id", "document_id", "kind", "error"])

    def close(self) -> None:
        pass


def changed(stream: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The results of a stream of changes; members: (collection_id, document_id) to begin with."""
    bucket = F.pmod(F.xxhash64("collection_id", "document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    first = None if members is None else members.select("collection_id", "document_id", bucket).distinct().groupBy("bucket")
    rows = stream.where(F.col("action").isin("add", "remove") & F.col("number").isNotNull())
    return rows.select("*", bucket).groupBy("bucket").transformWithStateInPandas(Memberships(), RESULT, "append", "none", first)


def start(spark: SparkSession, log_dir: str, checkpoint: str, out_dir: str, members: DataFrame | None = None, once: bool = False, files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Changes from JSON files in a folder; results as Parquet, each once."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).json(log_dir)
        writer = changed(stream, members).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start(out_dir)
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
