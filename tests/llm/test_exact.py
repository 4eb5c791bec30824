"""Problems with exact definitions, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, fmindex, leakage, neighbours, spans

tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = "ab cdé漢字😀1 2,.\n\t'sİß<|endoftext|>"


def random_text(rng, n, letters=ALPHABET):
    return "".join(rng.choice(letters) for _ in range(n))


# --- problem 8


def test_bpe_equals_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = [random_text(rng, rng.randint(0, 300)) for _ in range(120)] + ["", None, "a" * 5000, "<|endoftext|>", "ab" * 3000, random_text(rng, 4000, "abcdefghij")]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "hello", "y")]
    got = bpe.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"), path, tokenizers.PATTERN).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in got) == sorted((i if i is not None else -1, public.encode_ordinary(t) if t else []) for i, t, _ in rows)
    back = b"".join(dict((v, k) for k, v in bpe.read_ranks(path).items())[i] for i in got[0].ids).decode()
    assert back == texts[got[0].doc_id]
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), path, tokenizers.PATTERN).isEmpty()


# --- problem 9


def test_suffix_order_and_search():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s = rng.integers(0, 4, rng.integers(1, 200)).astype(np.int32)
        index = fmindex.FMIndex(s, 3)
        phrases = rng.integers(1, 4, (20, rng.integers(1, 5)))
        row, at = index.search(phrases)
        want = sorted((r, i) for r, p in enumerate(phrases) for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all())
        assert sorted(zip(row.tolist(), at.tolist())) == want


def test_leaks_against_all_phrases(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD", 500)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(6)] + [(7, "too short"), (8, None), (9, "")]
    docs = []
    for d in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            _, text = items[d % 6]
            part = text.split()[(a := rng.randint(0, 28)) : a + rng.randint(9, 20)]
            body[10:10] = [rng.choice([w, w.upper(), f"_{w}_", f"({w})"]) for w in part]
        docs.append((d, rng.choice([" ", "\n> ", "-", "_"]).join(body), "x"))
    docs += [(60, None, "x"), (61, "", "x"), (0, docs[0][1], "again"), (62, " ".join(words) * 400 + " " + items[2][1], "long")]
    schema = "doc_id long, text string, item_id string"
    got = {tuple(r) for r in leakage.leaked_documents(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def grams(t):
        w = leakage.words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    of = {i: grams(t) for i, t in items}
    assert got == {(d, i) for d, t, _ in docs for i in of if of[i] & grams(t)} and len(got) > 8
    empty = spark.createDataFrame([], schema)
    assert leakage.leaked_documents(empty, spark.createDataFrame(items, "item_id long, text string")).isEmpty()
    assert leakage.leaked_documents(spark.createDataFrame(docs, schema), spark.createDataFrame([], "item_id long, text string")).isEmpty()


def test_leaked_spans_merge(spark):
    item = " ".join(f"u{i}" for i in range(30))
    doc = "before it " + " ".join(f"u{i}" for i in range(3, 20)) + " gap " + " ".join(f"u{i}" for i in range(12))
    rows = leakage.leaked_spans(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r.first_word, r.n_words) for r in rows) == [(2, 17), (20, 12)]


# --- problem 7


def shared(texts, n=200):
    windows = {}
    for k, t in texts:
        for i in range(len(t) - n + 1):
            windows.setdefault(t[i : i + n], set()).add(k)
    return {(min(a, b), max(a, b)) for ks in windows.values() for a in ks for b in ks if a != b}


def test_shared_spans_against_all_windows(spark):
    rng = random.Random(11)
    texts = [(f"n{i:02d}", random_text(rng, rng.randint(0, 700), "abcdefgh \n")) for i in range(24)]
    for i, size in enumerate([199, 200, 201, 230, 350, 199, 600, 200]):
        donor = texts[i][1] + random_text(rng, 800, "xyz")
        part = donor[(a := rng.randint(0, 90)) : a + size]
        texts[i] = (texts[i][0], donor)
        texts.append((f"m{i}", random_text(rng, rng.randint(0, 150), "klmno") + part + random_text(rng, rng.randint(0, 150), "pqrst")))
    texts += [("copy1", texts[0][1]), ("copy2", texts[0][1]), ("short", "a" * 199), ("shorter", "a" * 199), ("run1", "ab" * 300), ("run2", "b" + "ab" * 150), ("漢", "漢字" * 120), ("漢2", "x" + "漢字" * 110)]
    rows = [(k, t, "clash") for k, t in texts] + [("n00", texts[0][1], "again"), (None, texts[0][1], ""), ("null", None, ""), ("empty", "", "")]
    df = spark.createDataFrame(rows, "id string, code string, text string")
    assert {(r.id_a, r.id_b) for r in spans.shared_pairs(df).collect()} == shared(texts)
    parts = {r.id: (r.n_chars, r.shared_chars) for r in spans.shared_parts(df).collect()}
    for k, t in texts:
        others = [u for j, u in texts if j != k]
        covered = set()
        for i in range(len(t) - 199):
            if any(t[i : i + 200] in u for u in others):
                covered |= set(range(i, i + 200))
        if any(u == t for u in others) and len(t) >= 200:
            covered = set(range(len(t)))
        assert parts[k] == (len(t), len(covered)), k
    assert parts["empty"] == (0, 0) and "null" not in parts
    assert spans.shared_pairs(spark.createDataFrame([], "id string, code string")).isEmpty()


def test_anchors_at_every_place_of_a_span(spark):
    rng = random.Random(12)
    alone: dict[int, str] = {}
    while len(alone) < 157:
        texts = [random_text(rng, 200, "abcdefgh") for _ in range(400)]
        h = spans.Hasher(texts)
        at = h.anchors()
        alone |= {int(a): texts[o] for a, o in zip(at - h.begins[h.owner(at)], h.owner(at))}
    rows = [(f"s{o:03d}", t) for o, t in alone.items()]
    rows += [(f"w{o:03d}", random_text(rng, rng.randint(1, 90), "klmno") + t + random_text(rng, rng.randint(1, 90), "pqrst")) for o, t in alone.items()]
    df = spark.createDataFrame(rows, "id string, code string")
    assert {(r.id_a, r.id_b) for r in spans.shared_pairs(df).collect()} == {(f"s{o:03d}", f"w{o:03d}") for o in range(157)}
    assert {r.shared_chars for r in spans.shared_parts(df).collect()} == {200}


# --- problem 1


def test_neighbours_recall_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([c + 0.25 * rng.standard_normal((12, 64)) for c in centres] + [rng.standard_normal((500, 64))]).astype(np.float32)
    x *= rng.uniform(0.1, 9, (len(x), 1)).astype(np.float32)
    x[3:12] = x[2]
    rows = [(f"v{i:04d}", v.tolist(), "c") for i, v in enumerate(x)]
    odd = [("zero", [0.0] * 64, "c"), ("short", [1.0] * 32, "c"), ("null", None, "c"), (None, [1.0] * 64, "c"), ("nan", [float("nan")] * 64, "c"), ("hole", [None] + [1.0] * 63, "c")]
    df = spark.createDataFrame(rows + odd + rows[:5], "id string, embedding array<float>, vector string")
    got = {}
    for r in neighbours.nearest_neighbours(df).collect():
        got.setdefault(r.id, {})[r.place] = r.neighbour
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(y @ y.T, 6)
    np.fill_diagonal(s, -1)
    hits = total = 0
    for i in range(len(x)):
        want = [f"v{j:04d}" for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 0.85]
        if 2 <= i < 12:
            assert sorted(got[f"v{i:04d}"].values()) == sorted(f"v{j:04d}" for j in [k for k in range(2, 9) if k != i][:5])
            continue
        hits += len(set(want) & set(got.get(f"v{i:04d}", {}).values()))
        total += len(want)
    assert hits >= 0.97 * total > 1000 and not {"zero", "short", "null", "nan", "hole"} & set(got)
    assert neighbours.neighbour_pairs(spark.createDataFrame([], "id string, embedding array<float>")).isEmpty()


def test_hot_cells_are_parted(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 150)
    rng = np.random.default_rng(4)
    base = 3 * rng.standard_normal(64)
    groups = [base + rng.standard_normal(64) for _ in range(60)]
    x = np.concatenate([g + 0.1 * rng.standard_normal((8, 64)) for g in groups])
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.nearest_neighbours(df).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -1)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_a_dense_cell_loses_no_neighbours(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neighbours, "HOT", 1000)
    rng = np.random.default_rng(6)
    noise = rng.standard_normal((18_000, 64))
    x = noise / np.linalg.norm(noise, axis=1, keepdims=True)
    centre = x[-1]
    side = x[:6000] - np.outer(x[:6000] @ centre, centre)
    x[:6000] = 0.9 * centre + np.sqrt(1 - 0.81) * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = x.astype(np.float32)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"id": [f"v{i:05d}" for i in range(len(x))], "embedding": vectors}), tmp_path / "x.parquet")
    got = {(r.id, r.neighbour) for r in neighbours.nearest_neighbours(spark.read.parquet(str(tmp_path / "x.parquet"))).collect()}
    s = x[:600] @ x.T
    s[np.arange(600), np.arange(600)] = -1
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(600) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    assert len(got & want) >= 0.98 * len(want) > 2000


def test_large_classes_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 3)
    rng = random.Random(5)
    letters = "abcdefghijklmnop "
    same = "".join(rng.choice(letters) for _ in range(260))
    span = "".join(rng.choice(letters) for _ in range(210))
    texts = {f"c{i:02d}": same for i in range(10)} | {f"s{i:02d}": f"{i:03d}{span}{i:04d}" for i in range(11)} | {"x": same[:230] + "y" * 40}
    df = spark.createDataFrame(list(texts.items()), "id string, code string")

    def share(a: str, b: str) -> bool:
        return any(a[i : i + 200] in b for i in range(len(a) - 199))

    want = {(a, b) for a in texts for b in texts if a < b and share(texts[a], texts[b])}
    assert {(r.id_a, r.id_b) for r in spans.shared_pairs(df).collect()} == want and len(want) == 45 + 55 + 10
    classes = {r.id: (r.class_id, r.n_members, r.n_links) for r in spans.shared_classes(df).collect()}
    assert classes["c07"] == ("c00", 10, 1) and classes["x"] == ("x", 1, 1) and classes["s03"] == ("s03", 1, 10)


def test_leaks_across_cuts_are_one_span_and_can_be_cut_out(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD", 100)
    leak = " ".join(f"leak{i}" for i in range(50))
    other = " ".join(f"leak{i}" for i in range(40, 50)) + " " + " ".join(f"more{i}" for i in range(20))
    before = " ".join(f"Word{i}" for i in range(80))
    doc = f"{before}, {leak} " + " ".join(f"more{i}" for i in range(20)) + "; " + " ".join(f"end{i}" for i in range(90))
    docs = spark.createDataFrame([(1, doc), (2, None), (3, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(5, leak), (6, other)], "item_id long, text string")
    spans = sorted(tuple(r) for r in leakage.leaked_spans(docs, items).collect())
    assert spans == [(1, 5, 80, 50), (1, 6, 120, 30)]
    (cut,) = leakage.removals(docs, items).collect()
    assert doc[: cut.first_char] == before + ", " and doc[cut.first_char : cut.end_char] == leak + " " + " ".join(f"more{i}" for i in range(20)) and cut.n_items == 2
