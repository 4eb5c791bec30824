import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import diff, embed, graph, merge
from codeloom.sources import listing, paths

KEY = ["label", "id"]


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    schema = "label string, id string, doc string, n int"
    old = spark.createDataFrame([("C", "a", "x", 1), ("M", "a", "y", 1)], schema)
    new = spark.createDataFrame([("C", "a", None, 2), ("C", "a", "late", 3), ("C", "b", None, None)], schema)
    once = merge.upsert(old, new, KEY, ["n"])
    rows = {tuple(r) for r in once.collect()}
    assert rows == {("C", "a", "late", 3), ("M", "a", "y", 1), ("C", "b", None, None)}
    assert {tuple(r) for r in merge.upsert(once, new, KEY, ["n"]).collect()} == rows
    assert {tuple(r) for r in merge.created(old, new, KEY).collect()} == {("C", "b")}


def test_edges_bind_all_labels_and_drop_dangling(spark):
    nodes = spark.createDataFrame([("C", "a"), ("M", "a"), ("M", "b"), ("M", "b")], "label string, id string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "z", "CALLS"), (None, "b", "CALLS")], "source_id string, target_id string, rel_type string")
    assert {(r.src_label, r.dst_label) for r in merge.bind_edges(nodes, edges).collect()} == {("C", "M"), ("M", "M")}
    assert merge.dangling_edges(nodes, edges).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_orphan_packages_closed_form_equals_the_rule(spark, seed):
    rng = random.Random(seed)
    names = ["r::" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(14)]
    nodes = spark.createDataFrame([("Package", n, "r") for n in set(names)] + [("Class", "c", "r")], "label string, id string, repository string")
    used = [n for n in set(names) if rng.random() < 0.3]
    edges = spark.createDataFrame([("Class", "c", "IN_PACKAGE", "Package", n) for n in used], "src_label string, source_id string, rel_type string, dst_label string, target_id string")
    closed = {r.id for r in merge.orphan_packages(nodes, edges).collect()}
    assert closed == {r.id for r in merge.orphan_packages_stepwise(nodes, edges).collect()}


def test_change_plan_and_empty_snapshot(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, k) for k in range(1, 5)]
    files = spark.createDataFrame([("r", "a", b"x", "h1", t[0]), ("r", "a", b"x", "h2", t[1]), ("r", "b", b"y", None, t[0]), ("r", "c", b"z", "h", t[0])], "repository string, file_path string, content binary, content_hash string, loaded_at timestamp_ntz")
    schema = "label string, repository string, file_path string, content_hash string, indexed_at timestamp_ntz"
    nodes = spark.createDataFrame([("File", "r", "a", "h2", t[2]), ("File", "r", "c", None, t[2]), ("File", "r", "d", "h", t[2]), ("Class", "r", "e", None, t[2])], schema)
    plan = {r.file_path: (r.known, r.needs_reindex) for r in diff.change_plan(files, nodes).collect()}
    assert plan == {"a": (True, False), "b": (False, True), "c": (True, True)}
    assert [r.file_path for r in diff.stale_paths(files, nodes).collect()] == ["d"]
    assert diff.change_plan(files, spark.createDataFrame([], schema)).filter("needs_reindex").count() == 3


def test_paths_against_the_listing_rules(spark):
    names = ["a/b.py", "build/x.py", "a/build", "m.min.js", "a/migrations/x.py", "migrations/x.py", "x/generated-sources/y/Z.java", ".hid.py", ".py", "a.b/c", "t.tsx", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: (r.x, r.s) for r in df.select("p", paths.is_excluded(F.col("p")).alias("x"), paths.suffix(F.col("p")).alias("s")).collect()}
    for n in names[:-1]:
        assert got[n][0] == any(listing.matches(n, p) for p in paths.DEFAULT_EXCLUSIONS), n
    assert got[".py"][1] == "" and got[".hid.py"][1] == ".py" and got["a.b/c"][1] == "" and got["t.tsx"][1] == ".tsx" and got[None] == (None, None)
    repos = spark.createDataFrame([("https://github.com/u/r.git/",), ("git@github.com:u/r.git",), ("/srv/code/demo/",), ("demo",)], "s string")
    assert [r[0] for r in repos.select(paths.repository_name(F.col("s"))).collect()] == ["u/r", "u/r", "demo", "demo"]


def test_unique_paths_hierarchy_and_reach(spark):
    rows = spark.createDataFrame([("f", "p", 1, 1), ("f", "p", 1, 2), ("f", "p", 1, 3), ("f", "p", 9, 4), ("g", "p", 1, 1)], "file string, path string, line int, n int")
    got = sorted((r.file, r.n, r.unique_path) for r in graph.unique_paths(rows, ["file"], "path", "line", ["n"]).collect())
    assert got == [("f", 1, "p"), ("f", 2, "p@L1"), ("f", 3, "p@L1_2"), ("f", 4, "p@L9"), ("g", 1, "p")]
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("x", "X"), ("y", "Y")], "id string, name string")
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert {r.id: r.path for r in graph.hierarchy(nodes, parents).collect()} == {"a": "A", "b": "A.B", "c": "A.B.C"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None)], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.hops for r in graph.reach(seeds, edges, 5).collect()} == {"a": 0, "b": 1, "c": 2}


def test_top_similar_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[7], x[8] = x[9], 0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, None, 1), (91, [1.0] * 7 + [None], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, group int")
    got = {(r.query_id, r.place): r.id for r in graph.top_similar(df.filter("id % 20 = 0"), df, 4, same_group=True).collect()}
    y = x.astype(float)
    for q in (0, 20, 40):
        s = [(-round(float(y[q] @ y[i] / np.linalg.norm(y[q]) / np.linalg.norm(y[i])), 6), i) for i in range(60) if i not in (q, 8) and i % 3 == q % 3]
        assert [got[q, k] for k in (1, 2, 3, 4)] == [i for _, i in sorted(s)[:4]]


def test_embedding_text_batches_and_failures(spark):
    rows = [("Method", "r::f", "f()", ["test", "x"], "doc", "c" * 3000), ("Class", "r::C", None, None, "", None), ("Field", "r::C.a", None, None, None, None)]
    df = spark.createDataFrame(rows, "label string, id string, signature string, stereotypes array<string>, docstring string, code string").withColumn("embedding", F.lit(None).cast("array<float>"))
    text = [r[0] for r in df.select(embed.embedding_text(df)).collect()]
    assert text[0].startswith("[Method] r::f\nSignature: f()\nStereotypes: test, x\nDocstring: doc\nCode: ccc") and len(text[0]) == 2500 and text[1] == "[Class] r::C"
    done = {r.id: r.embedding for r in embed.embed(df, dimensions=4).collect()}
    assert len(done["r::f"]) == 4 and done["r::C.a"] is None
    embed.register_provider("short", lambda n: lambda texts: [[0.0] * n] * (len(texts) - 1))
    assert all(r.embedding is None for r in embed.embed(df, "short", 4).collect())
    with pytest.raises(ValueError):
        embed.provider("nobody", 4)


def test_hierarchy_has_no_deepest_level(spark):
    names = [f"n{i:02d}" for i in range(15)]
    nodes = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    parents = spark.createDataFrame(list(zip(names[1:], names)), "child string, parent string")
    got = {r.id: (r.path, r.depth) for r in graph.hierarchy(nodes, parents).collect()}
    assert got == {n: (".".join(names[: i + 1]), i) for i, n in enumerate(names)}


def test_providers_with_failures_and_of_single_texts(spark):
    from codeloom.operators import embed

    def single(dimensions):
        def vector(text):
            if "bad" in text:
                raise ValueError("no vector for this")
            return [float(len(text))] * (dimensions + ("long" in text))

        return vector

    embed.register_provider("single", embed.one_by_one(single))
    rows = [("Method", f"m{i:02d}", "x", None, None, c, None) for i, c in enumerate(["good"] * 8 + ["bad"] + ["good"] * 7 + ["long"])] + [("Field", "f", "x", None, None, None, None)]
    nodes = spark.createDataFrame(rows, "label string, id string, signature string, stereotypes array<string>, docstring string, code string, embedding array<float>").coalesce(1)
    got = {r.id: r for r in embed.embed_with_errors(nodes, "single", 4, attempts=2, wait=0.0).collect()}
    assert all(len(got[f"m{i:02d}"].embedding) == 4 and got[f"m{i:02d}"].embedding_error is None for i in range(8))
    assert all(got[f"m{i:02d}"].embedding is None and got[f"m{i:02d}"].embedding_error == "ValueError: no vector for this" for i in range(8, 16))
    assert got["m16"].embedding_error == "vectors of another size than 4" and got["f"].embedding is None and got["f"].embedding_error is None
    assert embed.embed(nodes, "single", 4, attempts=1).columns == nodes.columns
