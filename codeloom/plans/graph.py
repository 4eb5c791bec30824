"""Registered queries over the graph's tables: change detection, upserts, deletes, reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import diff, embed, graph, merge
from codeloom.schema import EMBEDDABLE, STRUCTURAL
from codeloom.sources import paths
from codeloom.sources.tables import load

#: Rows before this time stand for the stored snapshot, later ones for a new run.
SPLIT = "2024-07-01"


def _AT():
    return F.lit(SPLIT).cast("timestamp_ntz")


_SMALL = ["label", "id", "name", "repository", "file_path", "line_number", "docstring", "indexed_at"]
_ORDER = ["indexed_at", "file_path", "line_number"]


def _text(column):
    return F.coalesce(F.col(column).cast("string"), F.lit("-"))


def _nodes(spark, d):
    return load(spark, d, "nodes").filter(F.col("id").isNotNull() & F.col("label").isNotNull())


def _current(spark, d):
    """Each node as it was indexed last."""
    return merge.last_by_key(_nodes(spark, d).select(*_SMALL), merge.NODE_KEY, _ORDER)


def _edges(spark, d):
    return load(spark, d, "edges_raw").select("repository", "source_id", "target_id", "rel_type", "file_path", "ordinal", "emitted_at", "edge_id").distinct()


def _bound(spark, d):
    """Distinct stored edges, bound to the labels of their ends."""
    return merge.bind_edges(_nodes(spark, d).select("id", "label"), _edges(spark, d)).select(*merge.EDGE_KEY).distinct()


# --- sources and change detection


def file_hash(spark, d):
    files = load(spark, d, "files")
    return files.select("repository", "file_path", F.md5("content").alias("md5"), F.coalesce(F.md5("content") == F.col("content_hash"), F.lit(False)).alias("agrees")).distinct()


def ext_filter(spark, d):
    files = load(spark, d, "files").select("repository", "file_path").distinct()
    found = files.filter(paths.is_supported(F.col("file_path")))
    return found.groupBy(paths.suffix(F.col("file_path")).alias("suffix")).agg(F.count("*").alias("n_files"))


def exclude_paths(spark, d):
    files = load(spark, d, "files").select("repository", "file_path").distinct()
    patterns = paths.DEFAULT_EXCLUSIONS + ("vendor", "**/static/**", "lib/*.ts")
    return files.select("repository", "file_path", paths.is_excluded(F.col("file_path")).alias("by_default"), paths.is_excluded(F.col("file_path"), patterns).alias("by_patterns"))


def repo_name(spark, d):
    repos = load(spark, d, "repositories")
    return repos.select("name", "source", paths.is_hosted(F.col("source")).alias("hosted"), paths.repository_name(F.col("source")).alias("derived"))


def relative_path(spark, d):
    files = load(spark, d, "files").select("repository", "file_path").distinct()
    root = F.concat(F.lit("/srv/"), F.col("repository"), F.lit("/"))
    return files.select("repository", "file_path", paths.relative_path(F.concat(root, F.col("file_path")), root).alias("relative"))


def change_plan(spark, d):
    return diff.change_plan(load(spark, d, "files"), load(spark, d, "nodes"))


def stale_paths(spark, d):
    early = load(spark, d, "files").filter(F.col("loaded_at") < _AT())
    return diff.stale_paths(early, load(spark, d, "nodes"))


def change_stats(spark, d):
    early = load(spark, d, "files").filter(F.col("loaded_at") < _AT())
    return diff.change_stats(early, load(spark, d, "nodes"))


_HASHES = """
WITH new AS (SELECT repository, file_path, h AS content_hash FROM (SELECT repository, file_path, coalesce(content_hash, md5(content)) AS h,
  row_number() OVER (PARTITION BY repository, file_path ORDER BY loaded_at DESC, coalesce(content_hash, md5(content)) DESC) AS n FROM files {where}) WHERE n = 1),
old AS (SELECT repository, file_path, content_hash FROM (SELECT repository, file_path, content_hash,
  row_number() OVER (PARTITION BY repository, file_path ORDER BY indexed_at DESC, content_hash DESC NULLS LAST) AS n FROM nodes WHERE label = 'File') WHERE n = 1)
"""
_EARLY = _HASHES.replace("{where}", f"WHERE loaded_at < TIMESTAMP '{SPLIT}'")

# --- upserts and deletes


def node_upsert(spark, d):
    rows = _nodes(spark, d).select(*_SMALL)
    old = merge.last_by_key(rows.filter(F.col("indexed_at") < _AT()), merge.NODE_KEY, _ORDER)
    return merge.upsert(old, rows.filter(F.col("indexed_at") >= _AT()), merge.NODE_KEY, _ORDER)


def node_upsert_created(spark, d):
    rows = _nodes(spark, d).select("label", "id", "indexed_at")
    new = merge.created(rows.filter(F.col("indexed_at") < _AT()), rows.filter(F.col("indexed_at") >= _AT()), merge.NODE_KEY)
    return new.groupBy("label").agg(F.count("*").alias("n_created"))


def node_rows_per_key(spark, d):
    return _nodes(spark, d).groupBy("label", "id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def edge_upsert(spark, d):
    ids = _nodes(spark, d).select("id", "label")
    rows = _edges(spark, d).select("source_id", "target_id", "rel_type", "ordinal", "file_path", "emitted_at")
    old = rows.filter(F.col("emitted_at") < _AT())
    new = rows.filter(F.col("emitted_at") >= _AT())
    order = ["emitted_at", "ordinal", "file_path"]
    stored = merge.last_by_key(merge.bind_edges(ids, old), merge.EDGE_KEY, order)
    return merge.upsert_edges(ids, stored, new, order).select(*merge.EDGE_KEY, "ordinal", "emitted_at")


def edge_created(spark, d):
    ids = _nodes(spark, d).select("id", "label")
    rows = _edges(spark, d).select("source_id", "target_id", "rel_type", "emitted_at")
    bound = merge.bind_edges(ids, rows)
    new = merge.created(bound.filter(F.col("emitted_at") < _AT()), bound.filter(F.col("emitted_at") >= _AT()), merge.EDGE_KEY)
    return new.groupBy("rel_type").agg(F.count("*").alias("n_created"))


def edge_dangling(spark, d):
    gone = merge.dangling_edges(_nodes(spark, d).select("id"), _edges(spark, d).select("edge_id", "source_id", "target_id", "rel_type"))
    return gone.groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def edge_label_fanout(spark, d):
    bound = merge.bind_edges(_nodes(spark, d).select("id", "label"), _edges(spark, d).select("edge_id", "source_id", "target_id", "rel_type"))
    return bound.groupBy("src_label", "rel_type", "dst_label").agg(F.count("*").alias("n_edges"), F.countDistinct("edge_id").alias("n_requests"))


def _changed(spark, d):
    """Files whose File node was indexed again after the split."""
    rows = _nodes(spark, d).filter((F.col("label") == "File") & (F.col("indexed_at") >= _AT()))
    old = _nodes(spark, d).filter((F.col("label") == "File") & (F.col("indexed_at") < _AT()))
    key = ["repository", "file_path"]
    return rows.select(*key).join(old.select(*key), key, "left_semi").distinct()


def _reindexed(spark, d):
    rows = _nodes(spark, d)
    stored = rows.filter(F.col("indexed_at") < _AT()).select("label", "id", "repository", "file_path").distinct()
    stored = merge.last_by_key(stored, merge.NODE_KEY, ["file_path", "repository"])
    current = rows.filter(F.col("indexed_at") >= _AT()).select("repository", "file_path", "id")
    return merge.prepare_reindex(stored, _bound(spark, d), _changed(spark, d), current)


def prepare_reindex_nodes(spark, d):
    return _reindexed(spark, d)[0].groupBy("label").agg(F.count("*").alias("n_nodes"))


def prepare_reindex_edges(spark, d):
    return _reindexed(spark, d)[1].groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def _stale(spark, d):
    early = load(spark, d, "files").filter(F.col("loaded_at") < _AT())
    return diff.stale_paths(early, load(spark, d, "nodes"))


def delete_stale_nodes(spark, d):
    nodes = _current(spark, d).select("label", "id", "repository", "file_path")
    left, _ = merge.delete_files(nodes, _bound(spark, d), _stale(spark, d))
    return left.groupBy("repository", "label").agg(F.count("*").alias("n_nodes"))


def delete_stale_edges(spark, d):
    nodes = _current(spark, d).select("label", "id", "repository", "file_path")
    _, kept = merge.delete_files(nodes, _bound(spark, d), _stale(spark, d))
    return kept.groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def detach_delete(spark, d):
    gone = load(spark, d, "node_deletions").select("label", "id")
    nodes, edges = merge.detach_delete(_nodes(spark, d).select("label", "id").distinct(), _bound(spark, d), gone)
    counted = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("type"), "n")
    return counted.unionByName(edges.groupBy("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("type"), "n"))


def orphan_packages(spark, d):
    return merge.orphan_packages(_nodes(spark, d), _late_edges(spark, d)).select("id")


def orphan_references(spark, d):
    return merge.orphan_references(_nodes(spark, d), _late_edges(spark, d)).select("id")


def _late_edges(spark, d):
    edges = _edges(spark, d).filter(F.col("emitted_at") >= _AT())
    return merge.bind_edges(_nodes(spark, d).select("id", "label"), edges).select(*merge.EDGE_KEY).distinct()


def delete_repository(spark, d):
    name = "stalenetwork/canvas-orbit"
    nodes = _nodes(spark, d).select("label", "id", "repository").distinct()
    left, kept, repos = merge.delete_repository(nodes, _bound(spark, d), load(spark, d, "repositories"), name)
    one = [left.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "n"), kept.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"), repos.agg(F.count("*").alias("n")).select(F.lit("repositories").alias("kind"), "n")]
    return one[0].unionByName(one[1]).unionByName(one[2])


def repository_upsert(spark, d):
    """Repository rows renewed with the counts of their nodes."""
    old = load(spark, d, "repositories").select("name", "source", "entity_count")
    counts = graph.entity_counts(_nodes(spark, d)).select(F.col("repository").alias("name"), F.col("n_entities").alias("entity_count"))
    new = old.select("name", "source").join(counts, "name")
    return merge.upsert(old, new, ["name"], ["entity_count"])


_N = "WITH n AS (SELECT * FROM nodes WHERE id IS NOT NULL AND label IS NOT NULL), ids AS (SELECT DISTINCT id, label FROM n), "
_E = "e AS (SELECT DISTINCT repository, source_id, target_id, rel_type, file_path, ordinal, emitted_at, edge_id FROM edges_raw), "
_B = """b AS (SELECT DISTINCT s.label AS src_label, e.source_id, e.rel_type, t.label AS dst_label, e.target_id FROM e JOIN ids s ON s.id = e.source_id JOIN ids t ON t.id = e.target_id)"""
_CUR = """cur AS (SELECT label, id, repository, file_path FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY indexed_at DESC NULLS LAST, file_path DESC NULLS LAST, line_number DESC NULLS LAST) AS k FROM n) WHERE k = 1)"""
_T = f"TIMESTAMP '{SPLIT}'"
_STALE = f"stale AS (SELECT DISTINCT repository, file_path FROM n WHERE label = 'File' AND (repository, file_path) NOT IN (SELECT (repository, file_path) FROM files WHERE loaded_at < {_T})), doomed AS (SELECT c.label, c.id FROM cur c JOIN stale s USING (repository, file_path) WHERE c.label <> 'Package')"
_REINDEX = f"""
ch AS (SELECT DISTINCT repository, file_path FROM n WHERE label = 'File' AND indexed_at >= {_T} AND (repository, file_path) IN (SELECT (repository, file_path) FROM n WHERE label = 'File' AND indexed_at < {_T})),
st AS (SELECT label, id, repository, file_path FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY file_path DESC NULLS LAST, repository DESC NULLS LAST) AS k FROM n WHERE indexed_at < {_T}) WHERE k = 1),
own AS (SELECT st.* FROM st JOIN ch USING (repository, file_path) WHERE label <> 'Package'),
gone AS (SELECT label, id FROM own WHERE (repository, file_path, id) NOT IN (SELECT (repository, file_path, id) FROM n WHERE indexed_at >= {_T} AND file_path IS NOT NULL))"""
_LATE = f"""lb AS (SELECT DISTINCT e.rel_type, s.label AS src_label, t.label AS dst_label, e.source_id, e.target_id FROM e JOIN ids s ON s.id = e.source_id JOIN ids t ON t.id = e.target_id WHERE e.emitted_at >= {_T})"""

# --- reads


def repo_counts(spark, d):
    return graph.entity_counts(_nodes(spark, d))


def repo_list(spark, d):
    return load(spark, d, "repositories").select("name", "source", F.date_format("last_indexed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_indexed_at"), "last_commit_sha", "entity_count").orderBy("name")


def scan_by_label(spark, d):
    found = graph.by_label(_nodes(spark, d), "Interface")
    return found.select("id", "name", "file_path", F.array("label").alias("labels")).distinct().select("id", "name", "file_path", F.array_join("labels", ",").alias("labels"))


def scan_file(spark, d):
    """Nodes of each file but packages: the ids that a reindex compares."""
    return _nodes(spark, d).filter(F.col("label") != "Package").groupBy("repository", "file_path").agg(F.countDistinct("id").alias("n_ids"))


def sparse_projection(spark, d):
    """Which optional properties each label's nodes carry; empty lists count as absent."""
    rows = _nodes(spark, d)
    has = {c: F.col(c).isNotNull() for c in ("code", "signature", "return_type", "docstring", "content_hash", "embedding", "line_end")}
    has |= {c: F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("modifiers", "stereotypes")}
    return rows.groupBy("label").agg(*[F.count_if(v).alias(f"n_{c}") for c, v in has.items()])


def flat_properties(spark, d):
    """Free properties flattened beside the core ones; core names win."""
    rows = _nodes(spark, d).filter(F.size("properties") > 0).select("label", "id", F.explode("properties").alias("key", "value"))
    core = ("id", "name", "repository", "file_path", "line_number", "line_end", "language", "code")
    return rows.filter(~F.col("key").isin(*core)).select("label", "id", "key", "value").distinct()


def conditional_count(spark, d):
    rows = _nodes(spark, d)
    return rows.groupBy("repository").agg(F.sum(F.when(F.col("docstring").isNotNull(), 1).otherwise(0)).alias("n_documented"), F.sum(F.when(F.col("embedding").isNotNull(), 1).otherwise(0)).alias("n_embedded"), F.count("*").alias("n_rows"))


def collect_names(spark, d):
    rows = _nodes(spark, d).filter(F.col("label") == "Class").select("repository", "name").distinct()
    return rows.groupBy("repository").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"))


def relation_matrix(spark, d):
    """Edges by type, with their share of the repository's edges."""
    rows = _edges(spark, d).groupBy("repository", "rel_type").agg(F.countDistinct("edge_id").alias("n_edges"))
    total = F.sum("n_edges").over(Window.partitionBy("repository"))
    return rows.select("repository", "rel_type", "n_edges", F.round(F.col("n_edges") / total, 6).alias("share"))


def first_calls(spark, d):
    """Of a function's calls into one target the first by ordinal."""
    rows = _edges(spark, d).filter((F.col("rel_type") == "CALLS") & F.col("target_id").isNotNull())
    return rows.groupBy("source_id", "target_id").agg(F.min("ordinal").alias("first_ordinal"), F.countDistinct("edge_id").alias("n_calls"))


def any_error(spark, d):
    rows = load(spark, d, "parse_results")
    return rows.groupBy("repository", "language").agg(F.bool_or(F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("any_error"), F.sum("entity_count").alias("entities"))


def id_remap(spark, d):
    """Edge ends through a map from raw to canonical ids; what the map has not stays as it is."""
    raw = _nodes(spark, d).filter(F.col("label") == "Reference").select(F.col("id").alias("raw_id")).distinct()
    mapped = raw.withColumn("mapped", F.concat(F.lit("external::"), F.element_at(F.split("raw_id", "::ref:"), -1)))
    edges = _edges(spark, d).filter(F.col("rel_type") == "CALLS").select("edge_id", "source_id", "target_id").distinct()
    joined = edges.join(mapped, edges.target_id == mapped.raw_id, "left")
    return joined.select("edge_id", "source_id", F.coalesce("mapped", "target_id").alias("target_id"))


def call_alias(spark, d):
    """Targets of CALLS, and of no other type, through the aliases `repository::local path` of scoped ids."""
    scoped = _nodes(spark, d).filter(F.col("label").isin("Method", "Constructor") & F.col("id").contains("#")).select("id", "repository", "file_path").distinct()
    alias = scoped.select(F.concat("repository", F.lit("::"), F.element_at(F.split("id", "#"), -1)).alias("local_name"), "id").groupBy("local_name").agg(F.min("id").alias("aliased"))
    edges = _edges(spark, d).select("edge_id", "rel_type", F.concat("repository", F.lit("::"), F.element_at(F.split("target_id", "#"), -1)).alias("wanted"), "target_id").distinct()
    joined = edges.filter(F.col("wanted").isNotNull()).join(alias, edges.wanted == alias.local_name, "left")
    return joined.groupBy("rel_type").agg(F.count_if((F.col("rel_type") == "CALLS") & F.col("aliased").isNotNull()).alias("n_resolved"), F.count("*").alias("n_edges"))


def file_ids(spark, d):
    """File ids rebuilt from repository and path."""
    rows = graph.by_label(_nodes(spark, d), "File").select("id", "repository", "file_path").distinct()
    return rows.select("id", F.concat("repository", F.lit("::"), "file_path").alias("canonical"))


def first_parent(spark, d):
    return graph.first_parents(load(spark, d, "edges_raw"))


def unique_path(spark, d):
    """Names made unique within a file, by line."""
    rows = _current(spark, d).filter(F.col("label").isin("Method", "Field", "Constructor") & F.col("file_path").isNotNull())
    named = graph.unique_paths(rows, ["repository", "file_path"], "name", "line_number", ["line_number", "id"])
    return named.select("id", "label", "unique_path")


def hierarchy_paths(spark, d):
    nodes = _current(spark, d).filter(F.col("label").isin("Class", "Interface", "Method", "Constructor", "Field", "File")).groupBy("id").agg(F.min("name").alias("name"))
    parents = graph.first_parents(load(spark, d, "edges_raw")).groupBy("child").agg(F.min("parent").alias("parent"))
    return graph.hierarchy(nodes, parents)


def two_hop(spark, d):
    """Files, the types they contain, and the members of these."""
    edges = _edges(spark, d)
    first = edges.filter(F.col("rel_type") == "CONTAINS").select("source_id", "target_id")
    second = edges.filter(F.col("rel_type").isin("HAS_METHOD", "HAS_CONSTRUCTOR")).select("source_id", "target_id")
    return graph.two_hops(first, second).groupBy("a").agg(F.countDistinct("b").alias("n_types"), F.count("*").alias("n_members"))


def callers(spark, d):
    calls = graph.pattern(_nodes(spark, d), _edges(spark, d), "CALLS", ("Method", "Constructor"), ("Method", "Constructor", "Reference"))
    return calls.groupBy("target_id").agg(F.countDistinct("source_id").alias("n_callers"))


def inherits(spark, d):
    edges = _edges(spark, d).filter(F.col("rel_type").isin("EXTENDS", "IMPLEMENTS"))
    return edges.select("source_id", "target_id", "rel_type", F.coalesce(F.col("target_id").startswith("external::"), F.lit(False)).alias("external")).distinct()


def reach_calls(spark, d):
    """What every interface's file reaches over calls and containment within three steps."""
    seeds = graph.by_label(_nodes(spark, d), "Interface").select(F.concat("repository", F.lit("::"), "file_path").alias("id"))
    edges = _edges(spark, d).filter(F.col("rel_type").isin("CONTAINS", "HAS_METHOD", "CALLS"))
    return graph.reach(seeds.filter(F.col("id").isNotNull()), edges, 3)


def in_list(spark, d):
    """Deleted ids that are nodes of their repository."""
    wanted = load(spark, d, "node_deletions").select("repository", "id").distinct()
    return _nodes(spark, d).select("repository", "id", "label").distinct().join(wanted, ["repository", "id"], "left_semi")


def optional_match(spark, d):
    """Methods with the number of their distinct outgoing edges, also where there are none."""
    rows = _nodes(spark, d).filter(F.col("label") == "Method").select("id", "repository").distinct()
    out = _edges(spark, d).groupBy("source_id").agg(F.countDistinct("target_id").alias("n"))
    return rows.join(out, rows.id == out.source_id, "left").select("repository", "id", F.coalesce("n", F.lit(0).cast("long")).alias("n_targets"))


def package_children(spark, d):
    """Packages with the number of classes and interfaces below them, by id prefix."""
    ids = _nodes(spark, d).filter(F.col("label") == "Package").select("id").distinct()
    types = _nodes(spark, d).filter(F.col("label").isin("Class", "Interface")).select(F.col("id").alias("child")).distinct()
    above = types.select("child", F.explode(merge.prefixes(F.col("child"))).alias("id")).filter("child <> id")
    return ids.join(above, "id").groupBy("id").agg(F.count("*").alias("n_below"))


# --- embeddings


def embed_filter(spark, d):
    rows = _nodes(spark, d)
    return rows.filter(embed.is_embeddable(F.col("label"))).groupBy("label").agg(F.countDistinct("id").alias("n_ids"), F.count_if(F.col("embedding").isNull()).alias("n_without"))


def embedding_text(spark, d):
    rows = _nodes(spark, d).filter(embed.is_embeddable(F.col("label")))
    text = embed.embedding_text(rows)
    return rows.select("id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars")).distinct()


def embed_batches(spark, d):
    rows = _nodes(spark, d).filter(embed.is_embeddable(F.col("label")) & F.col("embedding").isNull()).select("repository", "id").distinct()
    return embed.batches_of(rows, ["repository"], ["id"]).groupBy("repository", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def embed_new(spark, d):
    """Vectors for embeddable nodes that have none, by the provider that needs no network."""
    rows = _nodes(spark, d).filter(F.col("embedding").isNull() & embed.is_embeddable(F.col("label"))).drop("indexed_at").dropDuplicates(["label", "id"])
    done = embed.embed(rows, dimensions=64)
    return done.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))


def cosine_topk(spark, d):
    vectors = _vectors(spark, d)
    return graph.top_similar(vectors.filter(F.col("id") % 20 == 0), vectors, 10)


def cosine_topk_by_label(spark, d):
    vectors = _vectors(spark, d)
    return graph.top_similar(vectors.filter(F.col("id") % 20 == 0), vectors, 5, same_group=True)


def _topk_sql(k: int, extra: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
p AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.v, v.v), 6) AS similarity FROM v q JOIN v ON q.id <> v.id {extra} WHERE q.id % 20 = 0)
SELECT query_id, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM p) WHERE place <= {k}"""


_EMB = "(" + ", ".join(f"'{x}'" for x in EMBEDDABLE) + ")"
_STRUCT = "(" + ", ".join(f"'{x}'" for x in STRUCTURAL) + ")"
_FP = f"fp AS (SELECT repository, file_path, target_id AS child, source_id AS parent FROM (SELECT *, row_number() OVER (PARTITION BY repository, file_path, target_id ORDER BY ordinal, source_id) AS k FROM edges_raw WHERE rel_type IN {_STRUCT} AND target_id IS NOT NULL) WHERE k = 1)"

QUERIES = {f.__name__: f for f in (
    file_hash, ext_filter, exclude_paths, repo_name, relative_path, change_plan, stale_paths, change_stats, node_upsert, node_upsert_created, node_rows_per_key, edge_upsert, edge_created,
    edge_dangling, edge_label_fanout, prepare_reindex_nodes, prepare_reindex_edges, delete_stale_nodes, delete_stale_edges, detach_delete, orphan_packages, orphan_references, delete_repository,
    repository_upsert, repo_counts, repo_list, scan_by_label, scan_file, sparse_projection, flat_properties, conditional_count, collect_names, relation_matrix, first_calls, any_error, id_remap,
    call_alias, file_ids, first_parent, unique_path, hierarchy_paths, two_hop, callers, inherits, reach_calls, in_list, optional_match, package_children, embed_filter, embedding_text,
    embed_batches, embed_new, cosine_topk, cosine_topk_by_label,
)}

ORACLE = {
    "file_hash": "SELECT DISTINCT repository, file_path, md5(content) AS md5, coalesce(md5(content) = content_hash, false) AS agrees FROM files",
    "ext_filter": r"SELECT regexp_extract(file_path, '(?:^|/)[^/]+(\.[^./]+)$', 1) AS suffix, count(*) AS n_files FROM (SELECT DISTINCT repository, file_path FROM files) WHERE regexp_matches(file_path, '[^/]\.(py|java|js|jsx|ts|tsx|cs)$') GROUP BY 1",
    "exclude_paths": r"""WITH f AS (SELECT DISTINCT repository, file_path, string_split(file_path, '/') AS parts FROM files),
x AS (SELECT *, list_has_any(parts, ['node_modules', 'venv', '__pycache__', 'build', 'dist', 'target', '.git', '.venv']) OR regexp_matches(file_path, '^.*/generated-sources/.*$|^.*/migrations/.*$|^.*\.min\.js$|^.*\.min\.css$') AS by_default FROM f)
SELECT repository, file_path, by_default, by_default OR list_contains(parts, 'vendor') OR regexp_matches(file_path, '^.*/static/.*$|^lib/.*\.ts$') AS by_patterns FROM x""",
    "repo_name": r"""SELECT name, source, (starts_with(source, 'https://github.com/') OR starts_with(source, 'git@github.com:')) AS hosted,
CASE WHEN starts_with(source, 'https://github.com/') OR starts_with(source, 'git@github.com:') THEN regexp_replace(regexp_replace(regexp_replace(source, '^(https://github\.com/|git@github\.com:)', ''), '/+$', ''), '\.git$', '')
ELSE string_split(regexp_replace(source, '/+$', ''), '/')[-1] END AS derived FROM repositories""",
    "relative_path": "SELECT DISTINCT repository, file_path, file_path AS relative FROM files",
    "change_plan": _HASHES.replace("{where}", "") + "SELECT new.repository, new.file_path, new.content_hash, old.file_path IS NOT NULL AS known, NOT (old.file_path IS NOT NULL AND new.content_hash IS NOT DISTINCT FROM old.content_hash) AS needs_reindex FROM new LEFT JOIN old USING (repository, file_path)",
    "stale_paths": _EARLY + "SELECT repository, file_path FROM old ANTI JOIN new USING (repository, file_path)",
    "change_stats": _EARLY + """, p AS (SELECT new.repository, NOT (old.file_path IS NOT NULL AND new.content_hash IS NOT DISTINCT FROM old.content_hash) AS nr, 0 AS gone FROM new LEFT JOIN old USING (repository, file_path)
UNION ALL SELECT repository, NULL, 1 FROM old ANTI JOIN new USING (repository, file_path))
SELECT repository, count(nr) AS files_total, count(*) FILTER (nr) AS files_processed, count(*) FILTER (NOT nr) AS files_skipped, CAST(sum(gone) AS BIGINT) AS files_stale, count(*) FILTER (nr) + sum(gone) > 0 AS refresh FROM p GROUP BY 1""",
    "node_upsert": _N + """r AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY indexed_at DESC NULLS LAST, file_path DESC NULLS LAST, line_number DESC NULLS LAST) AS k FROM n)
SELECT label, id, name, repository, file_path, line_number, docstring, indexed_at FROM r WHERE k = 1""",
    "node_upsert_created": _N + f"f AS (SELECT label, id, min(indexed_at) AS a FROM n GROUP BY 1, 2) SELECT label, count(*) AS n_created FROM f WHERE a >= {_T} GROUP BY 1",
    "node_rows_per_key": _N + "x AS (SELECT label, id, count(*) AS n_rows FROM n GROUP BY 1, 2) SELECT * FROM x WHERE n_rows > 1",
    "edge_upsert": _N + _E + """r AS (SELECT s.label AS src_label, e.source_id, e.rel_type, t.label AS dst_label, e.target_id, e.ordinal, e.emitted_at, row_number() OVER (PARTITION BY s.label, e.source_id, e.rel_type, t.label, e.target_id ORDER BY e.emitted_at DESC, e.ordinal DESC NULLS LAST, e.file_path DESC NULLS LAST) AS k
FROM e JOIN ids s ON s.id = e.source_id JOIN ids t ON t.id = e.target_id) SELECT src_label, source_id, rel_type, dst_label, target_id, ordinal, emitted_at FROM r WHERE k = 1""",
    "edge_created": _N + _E + f"""r AS (SELECT s.label AS sl, e.source_id, e.rel_type, t.label AS tl, e.target_id, min(e.emitted_at) AS a FROM e JOIN ids s ON s.id = e.source_id JOIN ids t ON t.id = e.target_id GROUP BY ALL)
SELECT rel_type, count(*) AS n_created FROM r WHERE a >= {_T} GROUP BY 1""",
    "edge_dangling": _N + _E + "x AS (SELECT edge_id, source_id, target_id, rel_type FROM e WHERE source_id IS NULL OR target_id IS NULL OR source_id NOT IN (SELECT id FROM ids) OR target_id NOT IN (SELECT id FROM ids)) SELECT rel_type, count(*) AS n_edges FROM x GROUP BY 1",
    "edge_label_fanout": _N + _E + "r AS (SELECT s.label AS src_label, e.rel_type, t.label AS dst_label, e.edge_id FROM e JOIN ids s ON s.id = e.source_id JOIN ids t ON t.id = e.target_id) SELECT src_label, rel_type, dst_label, count(*) AS n_edges, count(DISTINCT edge_id) AS n_requests FROM r GROUP BY ALL",
    "prepare_reindex_nodes": _N + _REINDEX.strip() + " SELECT label, count(*) AS n_nodes FROM st WHERE (label, id) NOT IN (SELECT (label, id) FROM gone) GROUP BY 1",
    "prepare_reindex_edges": _N + _E + _B + "," + _REINDEX + """ SELECT rel_type, count(*) AS n_edges FROM b WHERE (src_label, source_id) NOT IN (SELECT (label, id) FROM gone) AND (dst_label, target_id) NOT IN (SELECT (label, id) FROM gone)
AND (src_label, source_id) NOT IN (SELECT (label, id) FROM own) GROUP BY 1""",
    "delete_stale_nodes": _N + _CUR + ", " + _STALE + " SELECT repository, label, count(*) AS n_nodes FROM cur WHERE (label, id) NOT IN (SELECT (label, id) FROM doomed) GROUP BY 1, 2",
    "delete_stale_edges": _N + _E + _B + ", " + _CUR + ", " + _STALE + " SELECT rel_type, count(*) AS n_edges FROM b WHERE (src_label, source_id) NOT IN (SELECT (label, id) FROM doomed) AND (dst_label, target_id) NOT IN (SELECT (label, id) FROM doomed) GROUP BY 1",
    "detach_delete": _N + _E + _B + """, x AS (SELECT DISTINCT label, id FROM node_deletions)
SELECT 'node' AS kind, label AS type, count(*) AS n FROM ids WHERE (label, id) NOT IN (SELECT (label, id) FROM x) GROUP BY 2
UNION ALL SELECT 'edge', rel_type, count(*) FROM b WHERE (src_label, source_id) NOT IN (SELECT (label, id) FROM x) AND (dst_label, target_id) NOT IN (SELECT (label, id) FROM x) GROUP BY 2""",
    "orphan_packages": _N + _E + _LATE + """, p AS (SELECT DISTINCT id, repository FROM n WHERE label = 'Package'), u AS (SELECT DISTINCT target_id AS id FROM lb WHERE dst_label = 'Package')
SELECT DISTINCT p.id FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = p.id OR starts_with(u.id, p.id || '.'))""",
    "orphan_references": _N + _E + _LATE + " SELECT DISTINCT id FROM n WHERE label = 'Reference' AND id NOT IN (SELECT target_id FROM lb WHERE dst_label = 'Reference')",
    "delete_repository": _N + _E + _B + """, m AS (SELECT DISTINCT label, id, repository FROM n), x AS (SELECT DISTINCT label, id FROM n WHERE repository = 'stalenetwork/canvas-orbit')
SELECT 'nodes' AS kind, count(*) AS n FROM m WHERE (label, id) NOT IN (SELECT (label, id) FROM x)
UNION ALL SELECT 'edges', count(*) FROM b WHERE (src_label, source_id) NOT IN (SELECT (label, id) FROM x) AND (dst_label, target_id) NOT IN (SELECT (label, id) FROM x)
UNION ALL SELECT 'repositories', count(*) FROM repositories WHERE name <> 'stalenetwork/canvas-orbit'""",
    "repository_upsert": _N + "c AS (SELECT repository, count(*) AS k FROM (SELECT DISTINCT repository, label, id FROM n) GROUP BY 1) SELECT r.name, r.source, coalesce(c.k, r.entity_count) AS entity_count FROM repositories r LEFT JOIN c ON c.repository = r.name",
    "repo_counts": _N + "x AS (SELECT DISTINCT repository, label, id FROM n) SELECT repository, count(*) AS n_entities FROM x GROUP BY 1",
    "repo_list": "SELECT name, source, strftime(last_indexed_at, '%Y-%m-%dT%H:%M:%S') AS last_indexed_at, last_commit_sha, entity_count FROM repositories ORDER BY name",
    "scan_by_label": _N + "x AS (SELECT DISTINCT id, name, file_path, label AS labels FROM n WHERE label = 'Interface') SELECT * FROM x",
    "scan_file": _N + "x AS (SELECT repository, file_path, count(DISTINCT id) AS n_ids FROM n WHERE label <> 'Package' GROUP BY 1, 2) SELECT * FROM x",
    "sparse_projection": _N + """x AS (SELECT label, count(code) AS n_code, count(signature) AS n_signature, count(return_type) AS n_return_type, count(docstring) AS n_docstring, count(content_hash) AS n_content_hash,
count(embedding) AS n_embedding, count(line_end) AS n_line_end, count(*) FILTER (len(modifiers) > 0) AS n_modifiers, count(*) FILTER (len(stereotypes) > 0) AS n_stereotypes FROM n GROUP BY 1) SELECT * FROM x""",
    "flat_properties": _N + "x AS (SELECT label, id, unnest(map_entries(properties)) AS p FROM n) SELECT DISTINCT label, id, p.key AS key, p.value AS value FROM x WHERE p.key NOT IN ('id', 'name', 'repository', 'file_path', 'line_number', 'line_end', 'language', 'code')",
    "conditional_count": _N + "x AS (SELECT repository, CAST(sum(CASE WHEN docstring IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_documented, CAST(sum(CASE WHEN embedding IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_embedded, count(*) AS n_rows FROM n GROUP BY 1) SELECT * FROM x",
    "collect_names": _N + "x AS (SELECT DISTINCT repository, name FROM n WHERE label = 'Class') SELECT repository, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM x GROUP BY 1",
    "relation_matrix": "WITH x AS (SELECT repository, rel_type, count(DISTINCT edge_id) AS n_edges FROM edges_raw GROUP BY 1, 2) SELECT *, round(n_edges / sum(n_edges) OVER (PARTITION BY repository), 6) AS share FROM x",
    "first_calls": "SELECT source_id, target_id, min(ordinal) AS first_ordinal, count(DISTINCT edge_id) AS n_calls FROM edges_raw WHERE rel_type = 'CALLS' AND target_id IS NOT NULL GROUP BY 1, 2",
    "any_error": "SELECT repository, language, bool_or(coalesce(len(errors), 0) > 0) AS any_error, CAST(sum(entity_count) AS BIGINT) AS entities FROM parse_results GROUP BY 1, 2",
    "id_remap": _N + "r AS (SELECT DISTINCT id FROM n WHERE label = 'Reference'), c AS (SELECT DISTINCT edge_id, source_id, target_id FROM edges_raw WHERE rel_type = 'CALLS') SELECT edge_id, source_id, CASE WHEN r.id IS NOT NULL THEN 'external::' || string_split(r.id, '::ref:')[-1] ELSE target_id END AS target_id FROM c LEFT JOIN r ON r.id = c.target_id",
    "call_alias": _N + """s AS (SELECT DISTINCT id, repository FROM n WHERE label IN ('Method', 'Constructor') AND contains(id, '#')), a AS (SELECT DISTINCT repository || '::' || string_split(id, '#')[-1] AS alias FROM s),
c AS (SELECT DISTINCT edge_id, rel_type, repository || '::' || string_split(target_id, '#')[-1] AS wanted, target_id FROM edges_raw WHERE target_id IS NOT NULL)
SELECT rel_type, count(*) FILTER (rel_type = 'CALLS' AND alias IS NOT NULL) AS n_resolved, count(*) AS n_edges FROM c LEFT JOIN a ON a.alias = c.wanted GROUP BY 1""",
    "file_ids": _N + "x AS (SELECT DISTINCT id, repository, file_path FROM n WHERE label = 'File') SELECT id, repository || '::' || file_path AS canonical FROM x",
    "first_parent": f"WITH {_FP} SELECT * FROM fp",
    "unique_path": _N + _CUR.replace("label, id, repository, file_path FROM", "label, id, name, repository, file_path, line_number FROM") + """, a AS (SELECT *, row_number() OVER (PARTITION BY repository, file_path, name ORDER BY line_number, id) AS p FROM cur WHERE label IN ('Method', 'Field', 'Constructor') AND file_path IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY repository, file_path, name, p > 1, line_number ORDER BY line_number, id) AS g FROM a)
SELECT id, label, CASE WHEN p = 1 THEN name WHEN g = 1 THEN name || '@L' || line_number ELSE name || '@L' || line_number || '_' || g END AS unique_path FROM z""",
    "hierarchy_paths": "WITH RECURSIVE " + _N[5:] + _CUR.replace("label, id, repository, file_path FROM", "label, id, name FROM") + f", {_FP}," + """
m AS (SELECT id, min(name) AS name FROM cur WHERE label IN ('Class', 'Interface', 'Method', 'Constructor', 'Field', 'File') GROUP BY 1),
p AS (SELECT child, parent FROM (SELECT child, min(parent) AS parent FROM fp GROUP BY 1) WHERE parent IN (SELECT id FROM m)),
h AS (SELECT id, name AS path, 0 AS depth FROM m WHERE id NOT IN (SELECT child FROM p) UNION ALL SELECT m.id, h.path || '.' || m.name, h.depth + 1 FROM h JOIN p ON p.parent = h.id JOIN m ON m.id = p.child WHERE h.depth < 11)
SELECT id, path, depth FROM h""",
    "two_hop": """WITH x AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges_raw WHERE rel_type = 'CONTAINS'), y AS (SELECT DISTINCT source_id AS b, target_id AS c FROM edges_raw WHERE rel_type IN ('HAS_METHOD', 'HAS_CONSTRUCTOR'))
SELECT a, count(DISTINCT b) AS n_types, count(*) AS n_members FROM x JOIN y USING (b) GROUP BY 1""",
    "callers": _N + """c AS (SELECT DISTINCT source_id, target_id FROM edges_raw WHERE rel_type = 'CALLS' AND source_id IN (SELECT id FROM ids WHERE label IN ('Method', 'Constructor')) AND target_id IN (SELECT id FROM ids WHERE label IN ('Method', 'Constructor', 'Reference')))
SELECT target_id, count(DISTINCT source_id) AS n_callers FROM c GROUP BY 1""",
    "inherits": "SELECT DISTINCT source_id, target_id, rel_type, coalesce(starts_with(target_id, 'external::'), false) AS external FROM edges_raw WHERE rel_type IN ('EXTENDS', 'IMPLEMENTS')",
    "reach_calls": """WITH RECURSIVE s AS (SELECT DISTINCT source_id, target_id FROM edges_raw WHERE rel_type IN ('CONTAINS', 'HAS_METHOD', 'CALLS') AND target_id IS NOT NULL),
r AS (SELECT DISTINCT repository || '::' || file_path AS seed, repository || '::' || file_path AS id, 0 AS hops FROM nodes WHERE label = 'Interface' AND file_path IS NOT NULL
UNION SELECT r.seed, s.target_id, r.hops + 1 FROM r JOIN s ON s.source_id = r.id WHERE r.hops < 3) SELECT seed, id, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "in_list": _N + "x AS (SELECT DISTINCT repository, id, label FROM n) SELECT * FROM x WHERE (repository, id) IN (SELECT (repository, id) FROM node_deletions)",
    "optional_match": _N + "m AS (SELECT DISTINCT id, repository FROM n WHERE label = 'Method'), o AS (SELECT source_id, count(DISTINCT target_id) AS k FROM edges_raw GROUP BY 1) SELECT repository, id, coalesce(k, 0) AS n_targets FROM m LEFT JOIN o ON o.source_id = m.id",
    "package_children": _N + "p AS (SELECT DISTINCT id FROM n WHERE label = 'Package'), t AS (SELECT DISTINCT id FROM n WHERE label IN ('Class', 'Interface')) SELECT a.id, count(*) AS n_below FROM p a JOIN t c ON starts_with(c.id, a.id || '.') GROUP BY 1",
    "embed_filter": _N + f"x AS (SELECT label, count(DISTINCT id) AS n_ids, count(*) FILTER (embedding IS NULL) AS n_without FROM n WHERE label IN {_EMB} GROUP BY 1) SELECT * FROM x",
    "embedding_text": _N + f"""x AS (SELECT id, substring(concat_ws(chr(10), '[' || label || '] ' || id, CASE WHEN length(signature) > 0 THEN 'Signature: ' || signature END,
CASE WHEN len(stereotypes) > 0 THEN 'Stereotypes: ' || array_to_string(stereotypes, ', ') END, CASE WHEN length(docstring) > 0 THEN 'Docstring: ' || docstring END, CASE WHEN length(code) > 0 THEN 'Code: ' || code END), 1, 2500) AS t FROM n WHERE label IN {_EMB})
SELECT DISTINCT id, md5(t) AS text_md5, length(t) AS n_chars FROM x""",
    "embed_batches": _N + f"x AS (SELECT DISTINCT repository, id FROM n WHERE label IN {_EMB} AND embedding IS NULL), y AS (SELECT *, (row_number() OVER (PARTITION BY repository ORDER BY id) - 1) // 8 AS batch FROM x) SELECT repository, batch, count(*) AS n, min(id) AS first_id FROM y GROUP BY 1, 2",
    "embed_new": _N + f"x AS (SELECT DISTINCT label, id FROM n WHERE label IN {_EMB} AND embedding IS NULL) SELECT label, count(*) AS n, 64 AS least, 64 AS most FROM x GROUP BY 1",
    "cosine_topk": _topk_sql(10, ""),
    "cosine_topk_by_label": _topk_sql(5, "AND q.label = v.label"),
}
