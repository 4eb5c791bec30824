"""Registered queries that read the source files themselves, and the parser's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.extract import registry
from codeloom.operators import merge
from codeloom.sources.tables import load, spread
from codeloom.streaming import incremental


def _found(spark, d):
    return registry.extract(spread(load(spark, d, "files")))


def extract_nodes(spark, d):
    """Nodes read from all files, by language and label."""
    rows = _found(spark, d).select(F.explode("nodes").alias("x")).select("x.language", "x.label", "x.id").distinct()
    return rows.groupBy("language", "label").agg(F.count("*").alias("n_nodes"))


def extract_edges(spark, d):
    """Edges read from all files, by type."""
    rows = _found(spark, d).select(F.explode("edges").alias("e")).select("e.source_id", "e.rel_type", "e.target_id").distinct()
    return rows.groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def extract_errors(spark, d):
    return _found(spark, d).filter(F.size("errors") > 0).select("repository", "file_path", F.array_join("errors", "; ").alias("errors")).distinct()


def extract_bound_edges(spark, d):
    """Edges read from all files of which both ends were read, by type and labels."""
    found = _found(spark, d)
    nodes = found.select(F.explode("nodes").alias("x")).select("x.id", "x.label").distinct()
    edges = found.select(F.explode("edges").alias("e")).select("e.source_id", "e.rel_type", "e.target_id").distinct()
    return merge.bind_edges(nodes, edges).groupBy("rel_type", "src_label", "dst_label").agg(F.count("*").alias("n_edges"))


#: Labels that the recorded nodes and the extraction are compared on, and the longest line of a file in ordinary layout.
COMPARED = ("Class", "Interface", "Method", "Constructor")
LAYOUT = 250
_KEY = ["repository", "file_path"]
#: Words before a declaration that recorded signatures hold and extracted ones need not.
_BEFORE = "^((public|private|protected|internal|static|abstract|final|override|virtual|sealed|synchronized|async|export|default|function|readonly|const) )+"
_ARROW = r"( =)? ?(\(.*\)) =>(: .*)?$"


def _standing(spark, d):
    """Files whose recorded state is the delivered one: the hash agrees, all recorded code stands in the content, and lines are of ordinary length."""
    nodes, files = load(spark, d, "nodes"), load(spark, d, "files")
    stored = nodes.filter("label = 'File' AND content_hash IS NOT NULL").groupBy(*_KEY).agg(F.min("content_hash").alias("h"), F.max("content_hash").alias("h2")).filter("h = h2")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    whole = files.filter("content IS NOT NULL").select(*_KEY, "content", F.md5("content").alias("h"), text.alias("text")).filter(F.array_max(F.transform(F.split("text", "\n"), F.length)) <= LAYOUT)
    found = whole.join(stored, [*_KEY, "h"]).dropDuplicates([*_KEY, "h"])
    codes = nodes.filter("code IS NOT NULL").select(*_KEY, "code").distinct()
    sound = found.join(codes, _KEY).groupBy(*_KEY).agg(F.bool_and(F.contains("text", "code")).alias("sound")).filter("sound").select(*_KEY)
    return found.join(sound, _KEY).select(*_KEY, "content", F.col("h").alias("content_hash"))


def _recorded(nodes):
    """One row for each recorded node of the compared labels."""
    text = lambda c: F.max(c).alias(c)
    joined = lambda c: F.max(F.array_join(F.array_sort(c), ",")).alias(c)
    return nodes.filter(F.col("label").isin(*COMPARED)).groupBy(*_KEY, "label", "id", "language").agg(*map(text, ("name", "signature", "return_type", "docstring")), *map(joined, ("modifiers", "stereotypes")))


def _bare(signature):
    """A signature without modifiers, without the type of its result behind it, and without marks of its kind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(signature, _BEFORE, ""), _ARROW, "$2"), r"\): .*$", ")"), ":$", "")


def _words(text):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _extracted(spark, d, languages):
    """What the extraction reads of each recorded node in files that stand as recorded; fields that no record fills are left out."""
    x = registry.extract(spread(_standing(spark, d))).select(F.explode("nodes").alias("x")).select("x.*").filter(F.col("label").isin(*COMPARED) & F.col("language").isin(*languages))
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(F.col(c), F.array())), ",")
    x = x.select(*_KEY, "label", "id", "language", "name", _bare(F.col("signature")).alias("s"), F.col("return_type").alias("r"), _words(F.col("docstring")).alias("t"), joined("modifiers").alias("m"), joined("stereotypes").alias("k"))
    said = _recorded(load(spark, d, "nodes")).select(*_KEY, "label", "id", "language", *[F.col(c).alias("_" + c) for c in ("signature", "return_type", "docstring", "modifiers", "stereotypes")])
    both = x.join(said, [*_KEY, "label", "id", "language"])
    plain = (_words(F.col("_docstring")) != "") & ~_words(F.col("_docstring")).rlike('^(/[/*]|"""|#)')
    return both.select(
        "label", "id", "name",
        F.when(F.col("_signature").isNotNull() & (F.col("label") != "Interface"), F.col("s")).alias("signature"),
        F.when(F.col("_return_type").isNotNull() & ~F.col("language").isin("typescript", "javascript"), F.col("r")).alias("return_type"),
        F.when(plain, F.col("t")).alias("docstring"),
        F.when(F.col("_modifiers") != "", F.col("m")).alias("modifiers"),
        F.when(F.col("_stereotypes") != "", F.col("k")).alias("stereotypes"),
    )


def extract_python(spark, d):
    """Classes, methods and functions of Python files as extracted, for comparison with the recorded ones."""
    return _extracted(spark, d, ["python"])


def extract_java(spark, d):
    """The same of Java files."""
    return _extracted(spark, d, ["java"])


def extract_csharp(spark, d):
    """The same of C# files."""
    return _extracted(spark, d, ["csharp"])


def extract_script(spark, d):
    """The same of JavaScript and TypeScript files."""
    return _extracted(spark, d, ["javascript", "typescript"])


def extract_members(spark, d):
    """Recorded relations between nodes of one file that the extraction gives as well."""
    edges = registry.extract(spread(_standing(spark, d))).select(F.explode("edges").alias("e")).select("e.source_id", "e.rel_type", "e.target_id").distinct()
    ids = load(spark, d, "nodes").filter("id IS NOT NULL").select("id").distinct()
    raw = load(spark, d, "edges_raw").filter(F.col("rel_type").isin(*MEMBERS)).select("source_id", "rel_type", "target_id").distinct()
    raw = raw.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return edges.join(raw, ["source_id", "rel_type", "target_id"], "left_semi")


def extract_per_file(spark, d):
    """How many nodes of each compared label the extraction reads from each file that stands as recorded; components (.jsx, .tsx) are not counted."""
    found = registry.extract(spread(_standing(spark, d).filter(~F.col("file_path").rlike("[.][jt]sx$"))))
    return found.select(*_KEY, F.explode("nodes").alias("x")).filter(F.col("x.label").isin(*COMPARED)).groupBy(*_KEY, F.col("x.label").alias("label")).agg(F.countDistinct("x.id").alias("n"))


#: Relations between a node and its members.
MEMBERS = ("HAS_METHOD", "HAS_CONSTRUCTOR", "CONTAINS", "IN_PACKAGE", "EXPORTS")


def job_status(spark, d):
    """The state of each file's last parse run: failed with errors, completed without, queued where a file has none."""
    key = ["repository", "file_path"]
    last = merge.last_by_key(load(spark, d, "parse_results").select(*key, "language", "parsed_at", "loaded_at", F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"), "entity_count"), key, ["parsed_at", "loaded_at", "n_errors", "entity_count", "language"])
    files = load(spark, d, "files").select(*key).distinct()
    state = F.when(F.col("n_errors").isNull(), "queued").when(F.col("n_errors") > 0, "failed").otherwise("completed")
    return files.join(last, key, "left").select(*key, state.alias("status"), F.coalesce("entity_count", F.lit(0).cast("long")).alias("entities_found"))


def job_progress(spark, d):
    """Files parsed so far on each day of a repository."""
    from pyspark.sql import Window

    rows = load(spark, d, "parse_results").groupBy("repository", F.date_format("parsed_at", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("file_path").alias("n_files"), F.sum("entity_count").alias("n_entities"))
    so_far = Window.partitionBy("repository").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("repository", "day", "n_files", F.sum("n_files").over(so_far).alias("files_so_far"), F.sum("n_entities").over(so_far).alias("entities_so_far"))


def parse_rates(spark, d):
    """The aggregation that the stream of parse results keeps, over the table as it stands."""
    rates = incremental.parse_rates(load(spark, d, "parse_results"))
    return rates.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "language", "n_files", "n_errors")


QUERIES = {f.__name__: f for f in (extract_nodes, extract_edges, extract_errors, extract_bound_edges, extract_python, extract_java, extract_csharp, extract_script, extract_members, extract_per_file, job_status, job_progress, parse_rates)}

#: SQL of the files that stand as recorded, and of the recorded nodes.
_STANDING = f"""t AS (SELECT DISTINCT repository, file_path, md5(content) AS h, regexp_replace(decode(content), chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM files WHERE content IS NOT NULL),
s AS (SELECT repository, file_path, min(content_hash) AS h FROM nodes WHERE label = 'File' AND content_hash IS NOT NULL GROUP BY 1, 2 HAVING min(content_hash) = max(content_hash)),
c AS (SELECT DISTINCT repository, file_path, code FROM nodes WHERE code IS NOT NULL),
standing AS (SELECT repository, file_path FROM t JOIN s USING (repository, file_path, h) JOIN c USING (repository, file_path)
WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= {LAYOUT} GROUP BY 1, 2 HAVING bool_and(contains(text, code))),
recorded AS (SELECT repository, file_path, label, id, language, max(name) AS name, max(signature) AS signature, max(return_type) AS return_type, max(docstring) AS docstring,
max(array_to_string(list_sort(modifiers), ',')) AS modifiers, max(array_to_string(list_sort(stereotypes), ',')) AS stereotypes FROM nodes WHERE label IN {COMPARED} GROUP BY 1, 2, 3, 4, 5)"""


def _oracle(languages: str) -> str:
    words = "trim(regexp_replace(docstring, '\\s+', ' ', 'g'))"
    bare = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(signature, '{_BEFORE}', ''), '{_ARROW}', '\\2'), '\\): .*$', ')'), ':$', '')"
    return f"""WITH {_STANDING} SELECT label, id, name, CASE WHEN label <> 'Interface' THEN {bare} END AS signature,
CASE WHEN language NOT IN ('typescript', 'javascript') THEN return_type END AS return_type,
CASE WHEN NOT regexp_matches({words}, '^(/[/*]|\"\"\"|#)') THEN nullif({words}, '') END AS docstring,
nullif(modifiers, '') AS modifiers, nullif(stereotypes, '') AS stereotypes
FROM recorded JOIN standing USING (repository, file_path) WHERE language IN ({languages})"""


ORACLE = {
    "extract_python": _oracle("'python'"),
    "extract_java": _oracle("'java'"),
    "extract_csharp": _oracle("'csharp'"),
    "extract_script": _oracle("'javascript', 'typescript'"),
    "extract_members": f"""WITH {_STANDING}, n AS (SELECT DISTINCT id FROM nodes), e AS (SELECT DISTINCT repository, file_path, source_id, rel_type, target_id FROM edges_raw WHERE rel_type IN {MEMBERS})
SELECT DISTINCT source_id, rel_type, target_id FROM e JOIN standing USING (repository, file_path) WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""",
    "extract_per_file": f"""WITH {_STANDING} SELECT repository, file_path, label, count(DISTINCT id) AS n FROM recorded JOIN standing USING (repository, file_path)
WHERE NOT regexp_matches(file_path, '[.][jt]sx$') GROUP BY 1, 2, 3""",
    "job_status": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY repository, file_path ORDER BY parsed_at DESC NULLS LAST, loaded_at DESC NULLS LAST, coalesce(len(errors), 0) DESC, entity_count DESC NULLS LAST, language DESC NULLS LAST) AS k FROM parse_results),
f AS (SELECT DISTINCT repository, file_path FROM files)
SELECT repository, file_path, CASE WHEN k IS NULL THEN 'queued' WHEN coalesce(len(errors), 0) > 0 THEN 'failed' ELSE 'completed' END AS status, coalesce(entity_count, 0) AS entities_found
FROM f LEFT JOIN (SELECT * FROM l WHERE k = 1) USING (repository, file_path)""",
    "job_progress": """WITH x AS (SELECT repository, strftime(parsed_at, '%Y-%m-%d') AS day, count(DISTINCT file_path) AS n_files, sum(entity_count) AS n_entities FROM parse_results GROUP BY 1, 2)
SELECT repository, day, n_files, CAST(sum(n_files) OVER w AS BIGINT) AS files_so_far, CAST(sum(n_entities) OVER w AS BIGINT) AS entities_so_far FROM x WINDOW w AS (PARTITION BY repository ORDER BY day)""",
    "parse_rates": "SELECT strftime(parsed_at, '%Y-%m-%d') AS day, language, count(*) AS n_files, count(*) FILTER (len(errors) > 0) AS n_errors FROM parse_results GROUP BY 1, 2",
}
