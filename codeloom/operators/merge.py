"""Upserts, deletes and reconciliation of the property graph, each a function from tables to tables.

Nodes have the key (label, id), edges (source label, source, type, target label, target). An upsert replaces all
properties of a key; of several new rows with one key the last one, by the order columns given, counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import durable

NODE_KEY = ["label", "id"]
EDGE_KEY = ["src_label", "source_id", "rel_type", "dst_label", "target_id"]


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, nulls least. Partial aggregation keeps hot keys small."""
    rest = [c for c in rows.columns if c not in keys]
    kept = F.max_by(F.struct(*rest), F.struct(*order)) if rest else None
    if kept is None:
        return rows.distinct()
    return rows.groupBy(*keys).agg(kept.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`old` with the rows of `new` put in place of those with the same key, properties and all."""
    last = last_by_key(new, keys, order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def created(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of `new` that `old` has not."""
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def bind_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of both ends. Ids are matched over all labels and repositories: an edge binds every
    node with its id, and an edge with an end that no node has is dropped."""
    ids = nodes.select("id", "label").distinct()
    source = ids.select(F.col("id").alias("source_id"), F.col("label").alias("src_label"))
    target = ids.select(F.col("id").alias("target_id"), F.col("label").alias("dst_label"))
    return edges.join(source, "source_id").join(target, "target_id")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is null or stands for no node."""
    ids = nodes.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    rest = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return left.unionByName(rest.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*left.columns))


def upsert_edges(nodes: DataFrame, old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Bound and deduplicated new edges put in place of stored ones with the same key."""
    return upsert(old, bind_edges(nodes, new).select(*old.columns, *[c for c in order if c not in old.columns]), EDGE_KEY, order)


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the (label, id) of `doomed`, and edges without those at either end of which one stands."""
    keys = doomed.select(*NODE_KEY).distinct()
    left = nodes.join(keys, NODE_KEY, "left_anti")
    source = keys.select(F.col("label").alias("src_label"), F.col("id").alias("source_id"))
    target = keys.select(F.col("label").alias("dst_label"), F.col("id").alias("target_id"))
    kept = edges.join(source, ["src_label", "source_id"], "left_anti").join(target, ["dst_label", "target_id"], "left_anti")
    return left, kept.select(*edges.columns)


def prepare_reindex(nodes: DataFrame, edges: DataFrame, changed: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before changed files are written anew: their nodes that are not current go with all their edges, the others lose
    their outgoing edges. Packages stay. `changed` has (repository, file_path), `current` (repository, file_path, id)."""
    own = nodes.filter(F.col("label") != "Package").join(changed.distinct(), ["repository", "file_path"], "left_semi")
    stale = own.join(current.select("repository", "file_path", "id").distinct(), ["repository", "file_path", "id"], "left_anti")
    left, kept = detach_delete(nodes, edges, stale)
    out = own.select(F.col("label").alias("src_label"), F.col("id").alias("source_id")).distinct()
    return left, kept.join(out, ["src_label", "source_id"], "left_anti").select(*edges.columns)


def file_nodes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes, packages apart, of the files in `paths` (repository, file_path)."""
    return nodes.filter(F.col("label") != "Package").join(paths.distinct(), ["repository", "file_path"], "left_semi")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return detach_delete(nodes, edges, file_nodes(nodes, paths))


def prefixes(dotted: Column) -> Column:
    """All dotted prefixes of an id, itself included."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def orphan_packages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Packages that neither they nor any package below them has an incoming edge.

    This is where the step-by-step rule (drop a package without incoming edge and without longer package, again and again) comes to
    rest, as long as no edge leads from a package to another one; see orphan_packages_stepwise for the rule itself.
    """
    packages = nodes.filter(F.col("label") == "Package").select("label", "id", "repository").distinct()
    used = edges.filter(F.col("dst_label") == "Package").select(F.col("target_id").alias("id")).distinct()
    alive = packages.join(used, "id", "left_semi").select("repository", F.explode(prefixes(F.col("id"))).alias("id")).distinct()
    return packages.join(alive, ["repository", "id"], "left_anti").select("label", "id")


def orphan_packages_stepwise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rule itself, for graphs with edges between packages: leaves without incoming edges go, until none is left.

    Each step takes a level of packages away, so there are no more steps than names have parts; what a step finds is written to the
    shared folder, which keeps the plan of the next one short.
    """
    left, kept = nodes, edges
    out = nodes.filter(F.lit(False)).select("label", "id")
    while True:
        packages = left.filter(F.col("label") == "Package").select("label", "id", "repository").distinct()
        used = kept.filter(F.col("dst_label") == "Package").select(F.col("target_id").alias("id")).distinct()
        above = packages.select("repository", F.explode(F.slice(F.reverse(prefixes(F.col("id"))), 2, 1000)).alias("id")).distinct()
        gone = packages.join(used, "id", "left_anti").join(above, ["repository", "id"], "left_anti").select("label", "id")
        gone = durable(gone)
        if gone.isEmpty():
            return out
        out = out.unionByName(gone)
        left, kept = (durable(x) for x in detach_delete(left, kept, gone))


def orphan_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reference nodes without an incoming edge."""
    used = edges.filter(F.col("dst_label") == "Reference").select(F.col("target_id").alias("id"))
    return nodes.filter(F.col("label") == "Reference").select("label", "id").distinct().join(used, "id", "left_anti").select("label", "id")


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orphan packages and then orphan references, with their edges."""
    nodes, edges = detach_delete(nodes, edges, orphan_packages(nodes, edges))
    return detach_delete(nodes, edges, orphan_references(nodes, edges))


def delete_repository(nodes: DataFrame, edges: DataFrame, repositories: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes of a repository with their edges, and its row. Without such a row nothing happens."""
    row = repositories.filter(F.col("name") == name)
    doomed = nodes.filter(F.col("repository") == name).join(F.broadcast(row.select(F.col("name").alias("repository")).limit(1)), "repository", "left_semi")
    left, kept = detach_delete(nodes, edges, doomed)
    return left, kept, repositories.filter(~F.col("name").eqNullSafe(F.lit(name)))
