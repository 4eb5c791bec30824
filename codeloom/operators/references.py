"""References to records that do not exist (problem 2): orphan edge ends and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids with this prefix are placeholders by design.
PLACEHOLDER = "external::"
#: A key with more than one in so many of all ends is hot; there are fewer than this many. Its ends are joined in so many parts as it holds such shares.
SHARES = 1_000


def _begin() -> Column:
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


def _end() -> Column:
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")


def edge_ends(edges: DataFrame) -> DataFrame:
    """One row (edge_id, rel_type, emitted_at, side, key) for each end of each distinct edge that names a node.

    Redelivered edges (equal but for their load time) count once. Null keys and placeholders are left out.
    """
    distinct = edges.select("edge_id", "rel_type", "emitted_at", "source_id", "target_id").distinct()
    sides = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("source_id").alias("key")),
            F.struct(F.lit("target").alias("side"), F.col("target_id").alias("key")),
        )
    )
    ends = distinct.select("edge_id", "rel_type", "emitted_at", sides.alias("end")).select(
        "edge_id", "rel_type", "emitted_at", "end.side", "end.key"
    )
    return ends.filter(F.col("key").isNotNull() & ~F.col("key").startswith(PLACEHOLDER))


def key_uses(ends: DataFrame) -> DataFrame:
    """(key, n, first_use, last_use): one row for each referenced key. Partial aggregation leaves one row of a hot key per task."""
    return ends.groupBy("key").agg(F.count("*").alias("n"), F.min("emitted_at").alias("first_use"), F.max("emitted_at").alias("last_use"))


def hot_keys(keys: DataFrame) -> DataFrame:
    """(key, parts) of the hot keys, fewer than SHARES."""
    total = keys.agg(F.sum("n").alias("total"))
    parts = F.ceil(F.col("n") * SHARES / F.col("total")).cast("int")
    return keys.crossJoin(F.broadcast(total)).filter(F.col("n") * SHARES > F.col("total")).select("key", parts.alias("parts"))


def absence_spans(ends: DataFrame, nodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """The times (key, reason, since, until) at which a referenced key stands for no live record.

    Keys are first reduced to one row each with their first and last use, so a hot key costs one row in the joins.
    `missing` comes from the left anti-join of these keys against the parent keys, `late` is the time before the first
    indexing, `deleted` the time from a deletion to the next indexing. A node without indexed_at counts as always
    there, a deletion without deleted_at is ignored.
    """
    keys = key_uses(ends)
    seen = nodes.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("key"), F.coalesce("indexed_at", _begin()).alias("indexed_at")
    )
    first = seen.groupBy("key").agg(F.min("indexed_at").alias("first_seen"))
    missing = keys.join(first, "key", "left_anti").select(
        "key", F.lit("missing").alias("reason"), _begin().alias("since"), _end().alias("until")
    )
    late = (
        keys.join(first, "key")
        .filter(F.col("first_seen") > F.col("first_use"))
        .select("key", F.lit("late").alias("reason"), _begin().alias("since"), F.col("first_seen").alias("until"))
    )
    gone = deletions.filter(F.col("id").isNotNull() & F.col("deleted_at").isNotNull()).select(
        F.col("id").alias("key"), "deleted_at"
    ).distinct()
    used = gone.join(keys, "key").filter(F.col("deleted_at") <= F.col("last_use")).select("key", "deleted_at")
    deleted = (
        used.join(seen.distinct(), "key")
        .groupBy("key", "deleted_at")
        .agg(
            F.min("indexed_at").alias("first_seen"),
            F.min(F.when(F.col("indexed_at") > F.col("deleted_at"), F.col("indexed_at"))).alias("next_seen"),
        )
        .select(
            "key",
            F.lit("deleted").alias("reason"),
            F.greatest("deleted_at", "first_seen").alias("since"),
            F.coalesce("next_seen", _end()).alias("until"),
        )
        .filter(F.col("since") < F.col("until"))
    )
    return missing.unionByName(late).unionByName(deleted)


def orphan_ends(edges: DataFrame, nodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """Every orphan end as (edge_id, rel_type, emitted_at, side, reason), each once.

    Ids are compared exactly. An edge without emitted_at can only be `missing`. A null edge_id stays a null. Empty
    tables give an empty result, or all ends `missing` where only `nodes` is empty. Other columns are ignored. The ends of
    a hot key are parted over several tasks, and its spans are repeated in each part.
    """
    ends = edge_ends(edges)
    spans = absence_spans(ends, nodes, deletions)
    hot = F.broadcast(hot_keys(key_uses(ends)))
    part = F.coalesce(F.pmod(F.xxhash64("edge_id", "side", "emitted_at"), F.col("parts")).cast("int"), F.lit(0))
    ends = ends.join(hot, "key", "left").withColumn("part", part).drop("parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    spans = spans.join(hot, "key", "left").withColumn("part", every).drop("parts")
    at: Column = F.col("emitted_at")
    inside = (F.col("reason") == "missing") | ((at >= F.col("since")) & (at < F.col("until")))
    return (
        ends.join(spans, ["key", "part"]).filter(inside).select("edge_id", "rel_type", "emitted_at", "side", "reason").distinct()
    )


def orphan_counts(edges: DataFrame, nodes: DataFrame, deletions: DataFrame, table: str = "edges_raw") -> DataFrame:
    """Counts per table, relation type, side and month: all ends, and the orphans by reason. Null groups are kept."""
    month = F.date_format("emitted_at", "yyyy-MM").alias("month")
    keys = ["rel_type", "side", "month"]
    total = edge_ends(edges).select("rel_type", "side", month).groupBy(*keys).agg(F.count("*").alias("n_ends"))
    zero = [F.lit(0).cast("long").alias(f"n_{r}") for r in ("missing", "late", "deleted")]
    found = (
        orphan_ends(edges, nodes, deletions)
        .select("rel_type", "side", month, "reason")
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "late", "deleted")])
    )
    both = total.select(*keys, "n_ends", *zero).unionByName(
        found.select(*keys, F.lit(0).cast("long").alias("n_ends"), "n_missing", "n_late", "n_deleted")
    )
    sums = [F.sum(c).alias(c) for c in ("n_ends", "n_missing", "n_late", "n_deleted")]
    return both.groupBy(*keys).agg(*sums).select(F.lit(table).alias("table_name"), *keys, *(s for s in ("n_ends", "n_missing", "n_late", "n_deleted")))
