"""Indexing as files arrive: a stream of a files table, applied to the graph batch by batch.

The engine itself works on whole repositories; here a batch holds some files of some repositories, so that nothing is stale but what
a file itself left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.extract import registry
from codeloom.operators import merge
from codeloom.sources.ship import ship


def file_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """The rows of Parquet files as they are put into a folder."""
    ship(spark)
    schema = "repository string, file_path string, name string, suffix string, content binary, content_hash string, collected_at timestamp_ntz, loaded_at timestamp_ntz"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def changed_files(files: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Each content of a file once: repeated deliveries within the lateness are dropped by the stream's state."""
    timed = files.withColumn("at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["repository", "file_path", "content_hash"])


def extracted_batch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and raw edges of the last delivery of each file of a batch."""
    last = merge.last_by_key(files.select("repository", "file_path", "content", "content_hash", "loaded_at"), ["repository", "file_path"], ["loaded_at", "content_hash"])
    found = registry.extract(last).filter(F.size("errors") == 0)
    nodes = found.select(F.explode("nodes").alias("x")).select("x.*")
    edges = found.select("repository", F.explode("edges").alias("e")).select("repository", "e.*")
    return nodes, edges


def start(files: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `sink(nodes, edges, batch)` on what is there; a batch that is repeated after a failure carries the same number."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(*extracted_batch(batch), number)
        batch.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_rates(results: DataFrame, window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Parsed files and files with errors per language and time window, late rows included up to the lateness."""
    timed = results.withColumn("at", F.col("parsed_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window), "language").agg(F.count("*").alias("n_files"), F.count_if(F.size("errors") > 0).alias("n_errors"))
