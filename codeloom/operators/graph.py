"""Reads of the graph: scans, patterns, hierarchies, counts and similar vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.schema import STRUCTURAL
from codeloom.sources.tables import durable


def by_label(nodes: DataFrame, label: str, repository: str | None = None) -> DataFrame:
    found = nodes.filter(F.col("label") == label)
    return found if repository is None else found.filter(F.col("repository") == repository)


def entity_counts(nodes: DataFrame) -> DataFrame:
    """(repository, n_entities): distinct nodes of each repository."""
    return nodes.select("repository", "label", "id").distinct().groupBy("repository").agg(F.count("*").alias("n_entities"))


def pattern(nodes: DataFrame, edges: DataFrame, rel_type: str, source_labels: tuple[str, ...], target_labels: tuple[str, ...]) -> DataFrame:
    """(source_id, target_id) of the distinct typed edges between nodes of these labels."""
    ids = nodes.select("id", "label").distinct()
    source = ids.filter(F.col("label").isin(*source_labels)).select(F.col("id").alias("source_id")).distinct()
    target = ids.filter(F.col("label").isin(*target_labels)).select(F.col("id").alias("target_id")).distinct()
    typed = edges.filter(F.col("rel_type") == rel_type).select("source_id", "target_id").distinct()
    return typed.join(source, "source_id", "left_semi").join(target, "target_id", "left_semi").select("source_id", "target_id")


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, c) of edges a-b in `first` and b-c in `second`."""
    x = first.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    y = second.select(F.col("source_id").alias("b"), F.col("target_id").alias("c")).distinct()
    return x.join(y, "b").select("a", "b", "c")


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, id, hops): what each seed reaches within some steps, with the least number of them.

    Every step joins the newest ids only; what has been seen is written to the shared folder, so that plans stay short.
    """
    step = edges.select("source_id", "target_id").filter(F.col("target_id").isNotNull()).distinct()
    seen = durable(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for n in range(1, hops + 1):
        ahead = front.join(step, front.id == step.source_id).select("seed", F.col("target_id").alias("id")).distinct()
        front = durable(ahead.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def first_parents(edges: DataFrame) -> DataFrame:
    """(file_path, child, parent): of a file's structural edges into a node, the first one's source."""
    rows = edges.filter(F.col("rel_type").isin(*STRUCTURAL) & F.col("target_id").isNotNull())
    first = rows.groupBy("repository", "file_path", "target_id").agg(F.min(F.struct("ordinal", "source_id")).alias("x"))
    return first.select("repository", "file_path", F.col("target_id").alias("child"), F.col("x.source_id").alias("parent"))


def hierarchy(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, path, depth): names from the outermost parent to each node, joined by points.

    `nodes` has (id, name), `parents` (child, parent). A node without parent, or with one that is not in `nodes`, begins a path. Nodes on
    a cycle or below one give no row.
    """
    named = nodes.select("id", "name").dropDuplicates(["id"])
    inner = parents.select(F.col("child").alias("id"), "parent").join(named.select(F.col("id").alias("parent")), "parent", "left_semi").dropDuplicates(["id"])
    level = durable(named.join(inner, "id", "left_anti").select("id", F.col("name").alias("path"), F.lit(0).alias("depth")))
    out = level
    below = named.join(inner, "id")
    for n in count(1):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = durable(below.join(up, "parent").select("id", F.concat_ws(".", "above", "name").alias("path"), F.lit(n).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def unique_paths(rows: DataFrame, scope: list[str], path: str, line: str, order: list[str]) -> DataFrame:
    """Adds `unique_path`: the first taker of a path keeps it, later ones get @L and their line, and @L…_2, _3 where that is taken too."""
    place = F.row_number().over(Window.partitionBy(*scope, path).orderBy(*order))
    ranked = rows.withColumn("_place", place)
    with_line = F.concat(F.col(path), F.lit("@L"), F.col(line).cast("string"))
    again = F.row_number().over(Window.partitionBy(*scope, path, F.col("_place") > 1, line).orderBy(*order))
    ranked = ranked.withColumn("_again", again)
    name = F.when(F.col("_place") == 1, F.col(path)).when(F.col("_again") == 1, with_line).otherwise(F.concat(with_line, F.lit("_"), F.col("_again").cast("string")))
    return ranked.withColumn("unique_path", name).drop("_place", "_again")


#: Vectors in a block.
BLOCK = 1024


def _blocks(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                columns = [part.column(0).to_pylist(), part.column(1).flatten().to_pylist(), part.column(2).to_pylist()]
                kinds = [pa.int64(), pa.float32(), pa.int32()]
                arrays = [pa.array([c], pa.list_(t)) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"{prefix}_ids", f"{prefix}_vectors", f"{prefix}_groups"])

    return run


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, same_group: bool = False) -> DataFrame:
    """(query_id, id, similarity, place): for each query row the k vectors with the greatest cosine, itself apart.

    Both sides have (id long, vector array<float>, group int) of one dimension. They meet block by block, BLOCK rows of each, and every
    pair of blocks keeps k rows a query, so that what is shuffled grows with queries and blocks, not with pairs.
    """
    def sound(df: DataFrame) -> DataFrame:
        return df.filter(F.col("id").isNotNull() & F.exists("vector", lambda v: v != 0) & ~F.exists("vector", lambda v: v.isNull()))

    kinds = "array<bigint>", "array<float>", "array<int>"
    q = sound(queries).mapInArrow(_blocks("q"), ", ".join(f"q_{n} {t}" for n, t in zip(("ids", "vectors", "groups"), kinds)))
    v = sound(vectors).mapInArrow(_blocks("v"), ", ".join(f"v_{n} {t}" for n, t in zip(("ids", "vectors", "groups"), kinds)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, vi = np.array(row["q_ids"]), np.array(row["v_ids"])
                x, y = (np.array(row[c], np.float64).reshape(len(i), -1) for c, i in (("q_vectors", qi), ("v_vectors", vi)))
                s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                barred = qi[:, None] == vi[None, :]
                if same_group:
                    barred |= np.array(row["q_groups"])[:, None] != np.array(row["v_groups"])[None, :]
                s[barred] = -np.inf
                s6 = np.round(s, 6)
                best = np.lexsort((np.broadcast_to(vi, s.shape), -s6), axis=1)[:, :k]
                a, value = np.repeat(qi, best.shape[1]), np.take_along_axis(s6, best, 1).ravel()
                kept = np.isfinite(value)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(a[kept]), "id": pa.array(vi[best.ravel()][kept]), "similarity": pa.array(value[kept])})

    found = q.crossJoin(v).mapInArrow(search, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
