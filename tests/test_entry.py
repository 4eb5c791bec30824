"""The driver's contract, with and without the optional subpackage."""

import importlib
import os
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("codeloom.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "codeloom.llm", None)
    return importlib.import_module("__spark_entry__")


def test_core_stands_alone(without_llm):
    queries = without_llm.queries()
    assert "p2_found" in queries and not any(n.startswith(("p1_", "p5_", "p10_")) for n in queries)
    assert set(without_llm.oracle_sql()) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_queries_equal_their_sql(spark, without_llm):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {path.split('.')[0]} AS SELECT * FROM '{FOLDER}/{path}'")

    def rows(df):
        df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
        return sorted(map(repr, ([round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r] for r in df.itertuples(index=False, name=None))))

    assert without_llm.entry(spark).count() >= 0
    for name in ("p2_found", "p2_counts", "change_plan", "node_upsert", "edge_upsert", "prepare_reindex_edges", "orphan_packages", "detach_delete", "callers", "embedding_text", "cosine_topk", "unique_path", "job_status"):
        got = without_llm.queries()[name](spark, FOLDER).toPandas()
        want = con.sql(without_llm.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want), name
