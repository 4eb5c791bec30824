"""Orphan ends against a brute-force reading of the definition."""

import datetime as dt
import random

from codeloom.operators import references as R

EDGES = "edge_id long, source_id string, target_id string, rel_type string, emitted_at timestamp_ntz, loaded_at timestamp_ntz, key string, reason string"
NODES = "id string, indexed_at timestamp_ntz, key string, since string"
GONE = "id string, deleted_at timestamp_ntz, label string"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(edges, nodes, gone):
    out = set()
    for edge_id, source, target, _, at, *_ in edges:
        for side, key in (("source", source), ("target", target)):
            if key is None or key.startswith("external::"):
                continue
            seen = [t or dt.datetime(1, 1, 1) for i, t, *_ in nodes if i == key]
            if not seen:
                out.add((edge_id, side, "missing"))
            elif at is None:
                continue
            elif min(seen) > at:
                out.add((edge_id, side, "late"))
            else:
                events = [(t, 1) for t in seen if t <= at] + [(t, 0) for i, t, *_ in gone if i == key and t is not None and t <= at]
                if max(events)[1] == 0:
                    out.add((edge_id, side, "deleted"))
    return out


def test_random_tables_with_nulls_ties_and_hot_keys(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(12)] + ["external::x", None, "hot", "N1"]
    edges = [(rng.choice([1, 2, 3, None, *range(4, 90)]), rng.choice(names + ["hot"] * 8), rng.choice(names + ["hot"] * 8), rng.choice(["CALLS", None]), day(rng.choice([None, *range(1, 40, 2)])), day(90), "k", "r") for _ in range(150)]
    edges += edges[:40]
    nodes = [(rng.choice(names[:9] + ["hot", None]), day(rng.choice([None, *range(0, 40, 2)])) if rng.random() < 0.9 else day(3), "a", "b") for _ in range(40)]
    gone = [(rng.choice(names + ["hot"]), day(rng.choice([None, *[x + 0.5 for x in range(0, 40, 3)]])), "Method") for _ in range(40)]
    got = R.orphan_ends(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(gone, GONE)).collect()
    assert {(r.edge_id, r.side, r.reason) for r in got} == brute(edges, nodes, gone)


def test_counts_add_up(spark):
    edges = [(1, "a", "b", "CALLS", day(5), day(6), "", ""), (2, "a", None, "CALLS", day(40), day(41), "", ""), (3, "x", "a", "EXTENDS", day(1), day(2), "", "")]
    nodes, gone = [("a", day(2), "", "")], [("a", day(30), "")]
    args = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(gone, GONE)
    rows = {(r.rel_type, r.side, r.month): (r.n_ends, r.n_missing, r.n_late, r.n_deleted) for r in R.orphan_counts(*args).collect()}
    assert rows == {("CALLS", "source", "2024-01"): (1, 0, 0, 0), ("CALLS", "target", "2024-01"): (1, 1, 0, 0), ("CALLS", "source", "2024-02"): (1, 0, 0, 1), ("EXTENDS", "source", "2024-01"): (1, 1, 0, 0), ("EXTENDS", "target", "2024-01"): (1, 0, 1, 0)}


def test_empty_tables(spark):
    e, n, g = (spark.createDataFrame([], s) for s in (EDGES, NODES, GONE))
    assert R.orphan_ends(e, n, g).isEmpty() and R.orphan_counts(e, n, g).isEmpty()
    one = spark.createDataFrame([(1, "a", None, "CALLS", day(1), day(1), "", "")], EDGES)
    assert [tuple(r) for r in R.orphan_ends(one, n, g).select("edge_id", "side", "reason").collect()] == [(1, "source", "missing")]


def test_ends_of_a_hot_key_are_joined_in_parts(spark):
    edges = [(i, "hot", f"t{i}", "CALLS", day(i % 30), day(60), "", "") for i in range(600)]
    nodes = [("hot", day(10), "", "")] + [(f"t{i}", day(0), "", "") for i in range(600)]
    gone = [("hot", day(20.5), "")]
    args = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(gone, GONE)
    hot = R.hot_keys(R.key_uses(R.edge_ends(args[0]))).collect()
    assert {r.key: r.parts for r in hot}["hot"] == 500 and len(hot) < R.SHARES
    assert {(r.edge_id, r.side, r.reason) for r in R.orphan_ends(*args).collect()} == brute(edges, nodes, gone)
