"""Indexing a repository into the graph, and reading the graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.operators import diff, embed, graph, merge
from codeloom.plans.snapshot import Conflict, Snapshot
from codeloom.sources.listing import checkout, commit_sha, read_files
from codeloom.sources.paths import DEFAULT_EXCLUSIONS
from codeloom.sources.ship import ship
from codeloom.sources.tables import durable


class Result(NamedTuple):
    repository: str
    files_total: int
    files_processed: int
    files_skipped: int
    entities_created: int
    relationships_created: int
    errors: list[str]


#: Times that a change is made again because another run was faster.
REPEATS = 5


class Engine:
    def __init__(self, spark: SparkSession, folder: str, provider: str | None = "hashed", dimensions: int = 64) -> None:
        ship(spark)
        self.spark, self.store, self.provider, self.dimensions = spark, Snapshot(spark, folder), provider, dimensions

    # --- writing

    def index(self, source: str, name: str, patterns: tuple[str, ...] = (), reindex: bool = False) -> Result:
        """Indexes a folder or a repository's address. Only files whose content changed write nodes; if any changed or vanished, the
        edges of all files are merged again, which restores edges between files. A file that does not parse writes nothing and is tried again
        the next time. Patterns add to the default exclusions."""
        with checkout(source) as folder:
            files = read_files(self.spark, folder, name, registry.supported(), tuple(DEFAULT_EXCLUSIONS) + tuple(patterns))
            return self.apply(files, name, source, commit_sha(folder), reindex)

    def apply(self, files: DataFrame, name: str, source: str, sha: str | None = None, reindex: bool = False) -> Result:
        """The same for a table of one repository's files. All or nothing: the new version becomes current at the end.

        If another run has changed the graph in between, it is done again on what that one left, so that no change is lost.
        """
        return self._repeated(lambda: self._apply(files, name, source, sha, reindex))

    def _repeated(self, change):
        for _ in range(REPEATS - 1):
            try:
                return change()
            except Conflict:
                pass
        return change()

    def _changed(self, name: str, nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame]) -> DataFrame:
        """Repositories that a change touches: its own, and those that lose nodes or edges by it."""
        own = self.spark.createDataFrame([(name,)], "repository string")
        lost = nodes[0].select("repository", *merge.NODE_KEY).join(nodes[1].select(*merge.NODE_KEY), merge.NODE_KEY, "left_anti").select("repository")
        cut = edges[0].select(*merge.EDGE_KEY).join(edges[1].select(*merge.EDGE_KEY), merge.EDGE_KEY, "left_anti")
        return own.unionByName(lost).unionByName(cut.select(F.split_part("source_id", F.lit("::"), F.lit(1)).alias("repository"))).distinct()

    def _apply(self, files: DataFrame, name: str, source: str, sha: str | None, reindex: bool) -> Result:
        base = self.store.version()
        nodes, edges, repositories = (self.store.table(t, base) for t in ("nodes", "edges", "repositories"))
        own = nodes.filter(F.col("repository") == name)
        key = ["repository", "file_path"]
        plan = durable(diff.change_plan(files.withColumn("loaded_at", F.lit(0)), own))
        plan = plan.withColumn("needs_reindex", F.col("needs_reindex") | F.lit(reindex))
        stale = durable(diff.stale_paths(files, own))
        total, todo = plan.count(), plan.filter("needs_reindex").count()
        some_stale = not stale.isEmpty()
        if not todo and not some_stale:
            self.store.commit({"repositories": self._repositories(repositories, own, name, source, sha)}, base)
            return Result(name, total, 0, total, 0, 0, [])
        found = durable(registry.extract(files))
        errors = [f"{r.file_path}: {e}" for r in found.filter(F.size("errors") > 0).select("file_path", "errors").toLocalIterator() for e in r.errors]
        sound = found.filter(F.size("errors") == 0)
        changed = durable(sound.select(*key).join(plan.filter("needs_reindex").select(*key, "known"), key))
        new = sound.join(changed.select(*key), key, "left_semi").select(F.posexplode("nodes").alias("n", "x"), F.col("file_path").alias("_f"))
        new = new.select("x.*", "n", "_f").withColumn("embedding", F.lit(None).cast("array<float>"))
        now = F.localtimestamp()
        fresh = merge.last_by_key(new, merge.NODE_KEY, ["_f", "n"]).drop("n", "_f")
        if self.provider:
            fresh = embed.embed(fresh, self.provider, self.dimensions)
        fresh = durable(fresh.withColumn("indexed_at", now))
        current = fresh.select(*key, "id")
        left, kept = merge.prepare_reindex(nodes, edges, changed.filter("known").select(*key), current)
        left = durable(left)
        made = merge.created(left, fresh, merge.NODE_KEY).count()
        merged = merge.upsert(left, fresh, merge.NODE_KEY, ["indexed_at"])
        if some_stale:
            merged, kept = merge.delete_files(merged, kept, stale)
        merged = durable(merged)
        raw = sound.select(F.explode("edges").alias("e")).select("e.*")
        before = durable(kept)
        bound = durable(merge.last_by_key(merge.bind_edges(merged, raw).select(*before.columns, "file_path", "ordinal"), merge.EDGE_KEY, ["file_path", "ordinal"]).select(*before.columns))
        linked = merge.created(before, bound, merge.EDGE_KEY).count()
        joined = before.join(bound.select(*merge.EDGE_KEY), merge.EDGE_KEY, "left_anti").unionByName(bound)
        if some_stale or not changed.filter("known").isEmpty():
            merged, joined = merge.drop_orphans(merged, joined)
        merged = durable(merged)
        rows = self._repositories(repositories, merged.filter(F.col("repository") == name), name, source, sha)
        joined = durable(joined)
        self.store.commit({"nodes": merged, "edges": joined, "repositories": rows}, base, self._changed(name, (nodes, merged), (edges, joined)))
        return Result(name, total, todo, total - todo, made, linked, errors)

    def _repositories(self, old: DataFrame, own: DataFrame, name: str, source: str, sha: str | None) -> DataFrame:
        counted = own.agg(F.count("*").alias("entity_count"))
        row = counted.select(F.lit(name).alias("name"), F.lit(source).alias("source"), F.localtimestamp().alias("last_indexed_at"), F.lit(sha).cast("string").alias("last_commit_sha"), "entity_count")
        return merge.upsert(old, row, ["name"], ["last_indexed_at"])

    def delete_repository(self, name: str) -> bool:
        """Whether there was such a repository; its nodes go with all their edges."""
        return self._repeated(lambda: self._delete(name))

    def _delete(self, name: str) -> bool:
        base = self.store.version()
        nodes, edges, repositories = (self.store.table(t, base) for t in ("nodes", "edges", "repositories"))
        if repositories.filter(F.col("name") == name).isEmpty():
            return False
        left, kept, rows = merge.delete_repository(nodes, edges, repositories, name)
        left, kept = durable(left), durable(kept)
        self.store.commit({"nodes": left, "edges": kept, "repositories": rows}, base, self._changed(name, (nodes, left), (edges, kept)))
        return True

    # --- reading

    @property
    def nodes(self) -> DataFrame:
        return self.store.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.table("edges")

    def list_repositories(self) -> DataFrame:
        return self.store.table("repositories").orderBy("name")

    def get_repository(self, name: str) -> DataFrame:
        return self.store.table("repositories").filter(F.col("name") == name)

    def callers(self, node_id: str) -> DataFrame:
        return self.edges.filter((F.col("rel_type") == "CALLS") & (F.col("target_id") == node_id)).select("source_id").distinct()

    def similar(self, label: str, k: int) -> DataFrame:
        """For every node of a label the k nodes of it with the most similar embedding."""
        rows = graph.by_label(self.nodes, label).filter(F.col("embedding").isNotNull())
        keyed = rows.select(F.xxhash64("id").alias("id"), F.col("id").alias("name"), F.col("embedding").alias("vector"), F.lit(0).alias("group"))
        vectors = keyed.drop("name")
        names = keyed.select("id", "name")
        found = graph.top_similar(vectors, vectors, k)
        named = found.join(names.withColumnsRenamed({"id": "query_id", "name": "node"}), "query_id").join(names.withColumnRenamed("name", "similar"), "id")
        return named.select("node", "similar", "similarity", "place")

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Parameterised SQL over the views nodes, edges and repositories."""
        for name in ("nodes", "edges", "repositories"):
            self.store.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)

    def healthy(self) -> bool:
        return self.spark.range(1).count() == 1 and (self.store.version() is None or self.store.table("nodes").limit(1).count() >= 0)
