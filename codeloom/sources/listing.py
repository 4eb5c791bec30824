"""Files of a directory as a table: the driver lists, the executors read."""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.schema import FILE
from codeloom.sources.paths import DEFAULT_EXCLUSIONS, EXTENSIONS, matches


def list_files(root: str, extensions: tuple[str, ...] = EXTENSIONS, patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS) -> list[str]:
    """Relative paths of the regular files of a tree, hidden ones too, that have an extension and match no pattern."""
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            path = Path(folder, name)
            relative = path.relative_to(root).as_posix()
            if path.is_file() and path.suffix in extensions and not any(matches(relative, p) for p in patterns):
                out.append(relative)
    return sorted(out)


def read_files(spark: SparkSession, root: str, repository: str, extensions: tuple[str, ...] = EXTENSIONS, patterns: tuple[str, ...] = DEFAULT_EXCLUSIONS) -> DataFrame:
    """The files table of one tree on a file system that all executors share. Only paths pass through the driver."""
    paths = list_files(root, extensions, patterns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            data = [Path(root, p).read_bytes() for p in names]
            yield pa.RecordBatch.from_pydict(
                {
                    "repository": pa.array([repository] * len(names), pa.string()),
                    "file_path": pa.array(names, pa.string()),
                    "name": pa.array([Path(p).name for p in names], pa.string()),
                    "suffix": pa.array([Path(p).suffix for p in names], pa.string()),
                    "content": pa.array(data, pa.binary()),
                    "content_hash": pa.array([hashlib.md5(x).hexdigest() for x in data], pa.string()),
                }
            )

    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    return listed.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))).mapInArrow(read, FILE)


@contextmanager
def checkout(source: str) -> Iterator[str]:
    """A local folder for a source: itself, or a shallow clone that is removed afterwards."""
    if os.path.isdir(source):
        yield source
        return
    with tempfile.TemporaryDirectory(prefix="codeloom-clone-") as folder:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", source, folder], check=True, capture_output=True)
        yield folder


def commit_sha(folder: str) -> str | None:
    """The checked-out commit, or None outside a repository."""
    run = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return run.stdout.strip() if run.returncode == 0 else None
