"""Change detection by content hash between delivered files and the stored snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repository", "file_path"]


def latest_files(files: DataFrame) -> DataFrame:
    """(repository, file_path, content_hash): the delivery of each file that was loaded last; ties go to the greater hash.

    A missing hash is computed from the content.
    """
    own = F.coalesce("content_hash", F.md5("content"))
    return files.groupBy(*KEY).agg(F.max(F.struct("loaded_at", own.alias("h"))).alias("x")).select(*KEY, F.col("x.h").alias("content_hash"))


def stored_hashes(nodes: DataFrame) -> DataFrame:
    """(repository, file_path, content_hash) of the stored File nodes, each as it was indexed last."""
    rows = nodes.filter(F.col("label") == "File")
    last = rows.groupBy(*KEY).agg(F.max(F.struct("indexed_at", "content_hash")).alias("x"))
    return last.select(*KEY, F.col("x.content_hash").alias("content_hash"))


def change_plan(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repository, file_path, content_hash, known, needs_reindex): every delivered file against the snapshot.

    A file needs indexing if it is not stored or its hash differs; a null hash equals only a null one.
    """
    old = stored_hashes(nodes).withColumnRenamed("content_hash", "old").withColumn("known", F.lit(True))
    new = latest_files(files)
    same = F.col("known").isNotNull() & F.col("content_hash").eqNullSafe(F.col("old"))
    return new.join(old, KEY, "left").select(*KEY, "content_hash", F.coalesce("known", F.lit(False)).alias("known"), (~same).alias("needs_reindex"))


def stale_paths(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored files that are not delivered any more."""
    return stored_hashes(nodes).select(*KEY).join(files.select(*KEY).distinct(), KEY, "left_anti")


def change_stats(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per repository: files in all, to process, skipped and stale, and whether the graph must be refreshed."""
    plan = change_plan(files, nodes).groupBy("repository").agg(
        F.count("*").alias("files_total"), F.count_if("needs_reindex").alias("files_processed"), F.count_if(~F.col("needs_reindex")).alias("files_skipped"),
        F.lit(0).cast("long").alias("files_stale"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("files_total", "files_processed", "files_skipped")]
    gone = stale_paths(files, nodes).groupBy("repository").agg(*zero, F.count("*").alias("files_stale"))
    sums = [F.sum(c).alias(c) for c in ("files_total", "files_processed", "files_skipped", "files_stale")]
    both = plan.unionByName(gone).groupBy("repository").agg(*sums)
    return both.withColumn("refresh", (F.col("files_processed") + F.col("files_stale")) > 0)
