"""States of the graph after edits of a source tree, run by run."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans.engine import Engine

PY = '''import os


class UserService(Base):
    """Serves users."""

    def __init__(self, repo):
        self.repo = repo
        self._cache = {}

    async def find(self, key: str) -> dict:
        """Finds one."""
        return self.load(key)

    def load(self, key):
        return helper(key)


def helper(key):
    return os.path.join("a", key)
'''
JAVA = """package com.example;

import java.util.List;

/** Keeps orders. */
@Service
public class OrderService extends BaseService implements Auditable {
    private final List<String> names;

    public OrderService(List<String> names) {
        this.names = names;
    }

    @PostMapping("/orders")
    public String process(String id, int n) {
        save(id);
        audit.log(id);
        return id;
    }

    void save(String id) {
    }
}
"""
BASE = """package com.example;

public class BaseService {
}
"""


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "graph"), dimensions=8)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "service.py").write_text(PY)
    (root / "OrderService.java").write_text(JAVA)
    return root


def ids(df, label):
    return {r.id for r in df.filter(F.col("label") == label).select("id").collect()}


def links(engine, kind):
    return {(r.source_id, r.target_id) for r in engine.edges.filter(F.col("rel_type") == kind).collect()}


def test_first_run_then_unchanged(engine, tree):
    one = engine.index(str(tree), "demo")
    assert (one.files_total, one.files_processed, one.files_skipped, one.errors) == (2, 2, 0, [])
    assert one.entities_created == engine.nodes.count() > 0 and one.relationships_created == engine.edges.count() > 0
    assert "demo::service.py#UserService.find" in ids(engine.nodes, "Method")
    assert ids(engine.nodes, "Field") == {"demo::service.py#UserService.repo", "demo::service.py#UserService._cache", "demo::com.example.OrderService.names"}
    assert ("demo::service.py#UserService.find", "demo::service.py#UserService.load") in links(engine, "CALLS")
    assert ("demo::service.py#UserService.load", "demo::service.py#helper") in links(engine, "CALLS")
    calls = {b for a, b in links(engine, "CALLS") if "process" in a}
    assert calls == {"demo::com.example.OrderService.save(String)", "demo::com.example.OrderService.process(String,int)::ref:audit.log"}
    row = engine.get_repository("demo").first()
    assert row.entity_count == engine.nodes.count()
    assert {len(r.embedding) for r in engine.nodes.filter("label = 'Method'").collect()} == {8}
    two = engine.index(str(tree), "demo")
    assert (two.files_skipped, two.files_processed, two.entities_created, two.relationships_created) == (2, 0, 0, 0)
    assert engine.nodes.groupBy("label", "id").count().filter("count > 1").isEmpty()
    both = engine.nodes.select("id", "label")
    ends = engine.edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("src_label").alias("label")), F.struct(F.col("target_id").alias("id"), F.col("dst_label").alias("label")))).alias("x")).select("x.*")
    assert ends.join(both, ["id", "label"], "left_anti").isEmpty()
    assert engine.healthy() and engine.similar("Method", 2).count() > 0
    assert engine.sql("SELECT count(*) AS n FROM nodes WHERE label = :l", {"l": "Class"}).first().n == 2


def test_body_edit_removed_method_and_cleared_docstring(engine, tree):
    engine.index(str(tree), "demo")
    (tree / "service.py").write_text(PY.replace('return helper(key)', 'return helper(key + "x")').replace('        """Finds one."""\n', ""))
    two = engine.index(str(tree), "demo")
    assert (two.files_processed, two.entities_created) == (1, 0)
    assert engine.nodes.filter(F.col("id").endswith("UserService.find")).first().docstring is None
    (tree / "service.py").write_text(PY.split("    def load")[0])
    engine.index(str(tree), "demo")
    assert not any("load" in x or "helper" in x for x in ids(engine.nodes, "Method"))


def test_vanished_and_returned_file(engine, tree):
    (tree / "BaseService.java").write_text(BASE)
    engine.index(str(tree), "demo")
    assert len(links(engine, "EXTENDS")) == 1
    (tree / "BaseService.java").unlink()
    gone = engine.index(str(tree), "demo")
    assert gone.files_total == 2 and links(engine, "EXTENDS") == set()
    assert "demo::com.example.OrderService" in ids(engine.nodes, "Class") and ids(engine.nodes, "Package") == {"demo::com.example"}
    (tree / "BaseService.java").write_text(BASE)
    engine.index(str(tree), "demo")
    assert len(links(engine, "EXTENDS")) == 1
    (tree / "BaseService.java").unlink()
    (tree / "OrderService.java").unlink()
    engine.index(str(tree), "demo")
    assert ids(engine.nodes, "Package") == set() and ids(engine.nodes, "Reference") == set()


def test_broken_file_is_tried_again(engine, tree):
    engine.index(str(tree), "demo")
    before = ids(engine.nodes, "Method")
    (tree / "service.py").write_text("def broken(:\n")
    for _ in range(2):
        run = engine.index(str(tree), "demo")
        assert run.files_processed == 1 and run.files_skipped == 1 and len(run.errors) == 1
        assert ids(engine.nodes, "Method") == before


def test_nested_namespaces_survive(engine, tmp_path):
    root = tmp_path / "cs"
    root.mkdir()
    (root / "A.cs").write_text("namespace App { namespace Services { public class A { public void Run() { } } } }\n")
    (root / "B.cs").write_text("namespace Other { public class B { } }\n")
    engine.index(str(root), "demo")
    (root / "B.cs").unlink()
    engine.index(str(root), "demo")
    assert ids(engine.nodes, "Package") == {"demo::App", "demo::App.Services"}


def test_moved_id_and_delete_repository(engine, tree):
    engine.index(str(tree), "demo")
    engine.index(str(tree), "other")
    assert engine.delete_repository("demo") and not engine.delete_repository("demo")
    assert {r.repository for r in engine.nodes.select("repository").distinct().collect()} == {"other"}
    assert [r.name for r in engine.list_repositories().collect()] == ["other"]
    moved = tree / "sub"
    moved.mkdir()
    (tree / "OrderService.java").rename(moved / "OrderService.java")
    engine.index(str(tree), "other")
    assert engine.nodes.filter(F.col("id") == "other::com.example.OrderService").first().file_path == "sub/OrderService.java"


def test_failed_commit_leaves_the_old_version(engine, tree, monkeypatch):
    engine.index(str(tree), "demo")
    version, n = engine.store.version(), engine.nodes.count()
    (tree / "more.py").write_text("def more():\n    pass\n")
    monkeypatch.setattr("codeloom.plans.snapshot.os.replace", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        engine.index(str(tree), "demo")
    assert engine.store.version() == version and engine.nodes.count() == n


def test_exclusions_and_hidden_files(engine, tree):
    for path in ("node_modules/x.py", "lib/__init__.py", "lib/.hid.py", "lib/app.min.js", "gen/a.py", "notes.txt"):
        target = tree / path
        target.parent.mkdir(exist_ok=True)
        target.write_text("x = 1\n")
    run = engine.index(str(tree), "demo", patterns=("gen",))
    assert run.files_total == 4
    assert {"demo::lib/__init__.py", "demo::lib/.hid.py"} <= ids(engine.nodes, "File")


def test_indexing_one_repository_leaves_the_files_of_the_others(engine, tree):
    engine.index(str(tree), "demo")
    engine.index(str(tree), "other")
    before = engine.store.manifest()
    (tree / "more.py").write_text("def more():\n    pass\n")
    engine.index(str(tree), "demo")
    after = engine.store.manifest()
    for table in ("nodes", "edges"):
        assert len(before[table]) == len(after[table]) == 2 and len(set(before[table].items()) & set(after[table].items())) == 1
    assert {"demo::more.py"} <= ids(engine.nodes, "File") and "other::more.py" not in ids(engine.nodes, "File")


def test_two_runs_at_the_same_time_keep_both_results(engine, tree, monkeypatch):
    from codeloom.plans.snapshot import Snapshot

    engine.index(str(tree), "first")
    commit, calls = Snapshot.commit, []

    def slow(self, *args):
        calls.append(1)
        if len(calls) == 1:
            engine.index(str(tree), "second")  # another run is faster
        return commit(self, *args)

    monkeypatch.setattr(Snapshot, "commit", slow)
    (tree / "more.py").write_text("def more():\n    pass\n")
    engine.index(str(tree), "first")
    assert len(calls) == 3 and [r.name for r in engine.list_repositories().collect()] == ["first", "second"]
    assert {"first::more.py", "second::more.py"} <= ids(engine.nodes, "File")
