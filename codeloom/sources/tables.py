"""Reading the engine's tables and spreading them over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.ship import ship

def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` below the folder `base`."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give several cores some rows before Python work where a table is one small file, which the reader cannot split.

    Such a table is repartitioned, by `keys` if given, else round robin. Tables of several files are read as they are split,
    whatever their size and that of the cluster.
    """
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2, *keys)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where none is set, a local session takes a
    folder below its warehouse; a cluster must name one. The files survive the loss of any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = spark.conf.get("spark.checkpoint.dir", None)
        if set_dir is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if set_dir is None:
            set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(set_dir)
    return df.checkpoint(eager=True)
