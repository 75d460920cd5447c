"""Embedding jobs as a stream: each row adds documents to a collection and removes others; reports come out.

A job is (job_id, collection_id, add array<string>, remove array<string>). Batches run through foreachBatch; within a
batch additions come first. A failing document is reported and the rest goes on; an unknown collection ends its job.
Documents that are in the collection already, by the registry or by an earlier job of the batch, are reported as such.

memberships() keeps, for a stream of single changes, what a job log makes of each document in each collection, as keyed
state: additions and removals of a pair in the order of their numbers, whatever batches they come in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkConfig
from ..operators import registry as R
from ..operators.chunking import chunk_by_config
from ..sources.embedders import Embedder, embedding
from ..sources.tables import RegistryStore

JOB = "job_id string, collection_id string, add array<string>, remove array<string>"
REPORT = "job_id string, kind string, document_id string, collection_id string, model_used string, vector_db string, total_chunks int, error string, started_at timestamp, finished_at timestamp"

#: Job files of a batch: what a queue's capacity is elsewhere.
FILES_PER_BATCH = 128


@dataclass
class Outcome:
    registry: R.Registry
    reports: DataFrame


def run_jobs(r: R.Registry, jobs: DataFrame, texts: DataFrame, chunkers: list[ChunkConfig], embedder: Embedder, embed: Callable | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Outcome:
    """The registry after these jobs, and their reports. texts: document_id, text, kind (a number of `chunkers`). `keep`
    writes and rereads the embedded chunks, from which both are made, so that nothing is embedded twice."""
    started = F.current_timestamp()
    jobs = jobs.where((F.size(F.coalesce("add", F.array())) > 0) | (F.size(F.coalesce("remove", F.array())) > 0))
    named = jobs.join(r.collections.select(F.col("id").alias("collection_id"), F.col("model").alias("model_used"), F.col("provider").alias("vector_db")), "collection_id", "left")
    lost = named.where("model_used is null").select("job_id", F.lit("error").alias("kind"), F.lit(None).cast("string").alias("document_id"), "collection_id", F.lit("no such collection").alias("error"))
    live = named.where("model_used is not null")
    asked = live.select("job_id", "collection_id", "model_used", "vector_db", F.posexplode("add").alias("at", "document_id"))
    first = Window.partitionBy("collection_id", "document_id").orderBy("job_id", "at")
    asked = asked.withColumn("again", F.row_number().over(first) > 1)
    there = r.embeddings.select("document_id", "collection_id", F.lit(True).alias("there"))
    asked = asked.join(there.distinct(), ["document_id", "collection_id"], "left").join(r.documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known")), "document_id", "left")
    error = F.when(F.col("there") | F.col("again"), "already exists").when(F.col("known").isNull(), "no such document")
    asked = asked.withColumn("error", error)
    todo = asked.where("error is null")
    chunks = chunk_by_config(todo.select("document_id").distinct().join(texts, "document_id", "left").select("document_id", "text", "kind"), chunkers, "kind", "text", embed)
    chunks = chunks.withColumn("embedding", F.when(F.col("chunk_idx").isNotNull(), embedding(F.coalesce("chunk", F.lit("")), embedder)))
    chunks = keep(chunks) if keep else chunks
    failed = chunks.where("chunk_idx is null").select("document_id", F.col("error").alias("chunk_error")).distinct()
    counts = chunks.where("chunk_idx is not null").groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    done = todo.join(failed, "document_id", "left").join(counts, "document_id", "left").withColumn("error", F.col("chunk_error"))
    good = done.where("error is null")
    key = F.sha2(F.concat_ws("|", "collection_id", "document_id"), 256)
    members = good.select(key.alias("id"), "document_id", "collection_id", started.alias("created_at"), started.alias("updated_at"))
    placed = good.select("document_id", "collection_id").join(chunks.where("chunk_idx is not null"), "document_id")
    vectors = placed.select(F.concat_ws("-", key, "chunk_idx").alias("vec_id"), "collection_id", "document_id", "chunk_idx", F.col("chunk").alias("content"), "embedding")
    removed = live.select("job_id", "collection_id", "model_used", "vector_db", F.explode("remove").alias("document_id"))
    after = R.delete_embeddings(R.add_embeddings(r, members, vectors), removed)
    parts = [
        lost,
        asked.where("error is not null").select("job_id", F.lit("error").alias("kind"), "document_id", "collection_id", "error"),
        done.select("job_id", F.when(F.col("error").isNull(), "addition").otherwise("error").alias("kind"), "document_id", "collection_id", "model_used", "vector_db", F.when(F.col("error").isNull(), F.col("total_chunks")).alias("total_chunks"), "error"),
        removed.select("job_id", F.lit("removal").alias("kind"), "document_id", "collection_id", "model_used", "vector_db"),
    ]
    reports = parts[0]
    for p in parts[1:]:
        reports = reports.unionByName(p, allowMissingColumns=True)
    reports = reports.withColumn("started_at", started).withColumn("finished_at", F.current_timestamp())
    names = [x.split(" ")[0] for x in REPORT.split(", ")]
    return Outcome(after, reports.select(names))


def start(spark: SparkSession, jobs_dir: str, checkpoint: str, load: Callable[[], R.Registry], publish: Callable[[R.Registry], object], reports_dir: str, texts: DataFrame, chunkers: list[ChunkConfig], embedder: Embedder, embed: Callable | None = None, once: bool = False, files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Jobs from JSON files in a folder; reports as Parquet, a folder for each batch.

    With a RegistryStore's load and save each batch is one transaction of the checkpoint: its reports are written where readers
    don't look, the registry is published with the batch's number, then the reports' folder gets its name. A batch that is run
    again after a failure before the publishing starts over; after it, only the renaming is made good. So the registry changes
    once and the reports are those of the run that changed it. Other functions get no such promise: a repeated batch finds its
    additions in the registry.
    """
    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", files_per_batch).json(jobs_dir)
    store = getattr(publish, "__self__", None)
    store = store if isinstance(store, RegistryStore) else None
    writer_id = f"jobs {checkpoint}"

    def batch(jobs: DataFrame, number: int) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(reports_dir).getFileSystem(spark._jsc.hadoopConfiguration())
        path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
        place, hidden, shown = f"{reports_dir}/_chunks-{number}", f"{reports_dir}/_batch-{number}", f"{reports_dir}/batch={number}"

        def keep(chunks: DataFrame) -> DataFrame:
            chunks.write.mode("overwrite").parquet(place)
            return spark.read.schema(chunks.schema).parquet(place)

        last = None if store is None else store.transaction(writer_id)
        if last is None or last < number:
            out = run_jobs(load(), jobs, texts, chunkers, embedder, embed, keep)
            out.reports.write.mode("overwrite").parquet(hidden)
            publish(out.registry) if store is None else store.save(out.registry, (writer_id, number))
        if fs.exists(path(hidden)):
            fs.delete(path(shown), True)
            if not fs.rename(path(hidden), path(shown)):
                raise OSError(f"{hidden} could not be renamed")
        fs.delete(path(place), True)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def report_stream(spark: SparkSession, reports_dir: str) -> DataFrame:
    """The reports as a stream, each once, with their batch."""
    return spark.readStream.schema(f"{REPORT}, batch int").parquet(reports_dir)
