"""A graph at rest: Parquet tables of one version, and a file that names the current version."""

from __future__ import annotations

import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import NODE, REPOSITORY, STORED_EDGE

SCHEMAS = {"nodes": NODE + ", indexed_at timestamp_ntz", "edges": STORED_EDGE, "repositories": REPOSITORY.replace("timestamp", "timestamp_ntz")}


def part_of(repository: Column) -> Column:
    """The name of a repository's folder."""
    return F.md5(F.coalesce(repository, F.lit("")))


class Conflict(RuntimeError):
    """Another run has made its version current since this one read the graph."""


class Snapshot:
    """Tables below a folder on a file system that driver and executors share.

    A version is written whole and then named by an atomic replace of the file CURRENT, so that a run that fails leaves the version before it
    in place, and readers keep the files they have begun to read. Nodes are parted by their repository and edges by that of their source. A
    version may list folders of the version before it: a run that changes one repository writes that repository only, and the file MANIFEST of
    the version says in which version each repository's folder lies.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def version(self) -> str | None:
        current = self.folder / "CURRENT"
        return current.read_text().strip() if current.exists() else None

    def manifest(self, version: str | None = None) -> dict[str, dict[str, str]]:
        """For each table, the folder of each of its parts."""
        version = version or self.version()
        return json.loads((self.folder / version / "MANIFEST").read_text()) if version else {name: {} for name in SCHEMAS}

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """A table of a version, or of the current one; before the first one it is empty."""
        parts = self.manifest(version)[name]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*sorted(str(self.folder / x) for x in parts.values()))

    def commit(self, tables: dict[str, DataFrame], base: str | None, changed: DataFrame | None = None) -> str:
        """Makes a new version current that holds these tables in full (and those of `base` that are not named), if `base` still is the current one; else raises Conflict.

        `changed` holds the names of the repositories (`repository`) whose nodes or edges differ from those of `base`: only theirs are
        written, the folders of the others are listed again. Without it all are written. The repositories' own table is always written.
        """
        version = f"v-{uuid.uuid4().hex}"
        old = self.manifest(base) if base else {name: {} for name in SCHEMAS}
        parts = dict(old)
        for name, df in tables.items():
            target = self.folder / version / name
            if name == "repositories":
                df.write.parquet(str(target))
                parts[name] = {"": f"{version}/{name}"}
                continue
            part = part_of(F.col("repository") if name == "nodes" else F.split_part(F.col("source_id"), F.lit("::"), F.lit(1)))
            rows = df.withColumn("part", part)
            if changed is not None:
                rows = rows.join(changed.select(part_of(F.col("repository")).alias("part")).distinct(), "part", "left_semi")
            rows.repartition("part", "id" if name == "nodes" else "source_id").sortWithinPartitions("part", "label" if name == "nodes" else "rel_type").write.partitionBy("part").parquet(str(target))
            mine = {x.name.removeprefix("part="): f"{version}/{name}/{x.name}" for x in target.iterdir() if x.name.startswith("part=")}
            gone = {r.part for r in changed.select(part_of(F.col("repository")).alias("part")).distinct().toLocalIterator()} if changed is not None else set(old[name])
            parts[name] = {k: v for k, v in old[name].items() if k not in gone} | mine
        (self.folder / version).mkdir(exist_ok=True)
        (self.folder / version / "MANIFEST").write_text(json.dumps(parts))
        with self._lock():
            if self.version() != base:
                raise Conflict(f"the graph has moved from {base} to {self.version()}")
            pointer = self.folder / f"CURRENT.{uuid.uuid4().hex}"
            pointer.write_text(version)
            os.replace(pointer, self.folder / "CURRENT")
        return version

    @contextmanager
    def _lock(self) -> Iterator[None]:
        """Held while the current version is compared and replaced, which takes no longer than writing one small file."""
        with open(self.folder / "LOCK", "w") as handle:
            fcntl.flock(handle, fcntl.LOCK_EX)
            yield
