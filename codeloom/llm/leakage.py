"""Evaluation texts leaking into training text (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.fmindex import GAP, FMIndex

#: Consecutive words that make a leak.
SPAN = 12
#: Words of a training shard that share one index; longer documents are cut with an overlap of SPAN - 1 words.
SHARD = 400_000
#: Characters of evaluation text that one pass over the corpus takes to the executors. More text takes more passes.
PASS_CHARS = 4_000_000

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


class Phrases:
    """The word numbers and all SPAN-word phrases of some evaluation items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.number: dict[str, int] = {}
        grams: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(len(ids) - SPAN + 1):
                of = grams.setdefault(tuple(ids[i : i + SPAN]), [])
                if not of or of[-1] != item:
                    of.append(item)
        self.matrix = np.array(list(grams), np.int64).reshape(-1, SPAN)
        self.items = list(grams.values())


def _passes(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    group, size = [], 0
    for row in items.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        group.append((row[0], row[1]))
        size += len(row[1])
        if size >= PASS_CHARS:
            yield group
            group, size = [], 0
    yield group


def _shards(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[tuple[np.ndarray, list]]:
    """Word numbers of some texts with a gap after each, and where each text (or piece of it) begins: place, document, first word, text."""
    parts, begins, size = [], [], 0
    get = number.get
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.fromiter((get(w.lower(), GAP) for w in WORD.findall(text or "")), np.int32)
            if len(ids) < SPAN:
                continue
            for cut in range(0, max(1, len(ids) - SPAN + 1), SHARD):
                piece = ids[cut : cut + SHARD + SPAN - 1]
                begins.append((size, doc, cut, text))
                parts += [piece, np.zeros(1, np.int32)]
                size += len(piece) + 1
                if size >= SHARD:
                    yield np.concatenate(parts), begins
                    parts, begins, size = [], [], 0
    if parts:
        yield np.concatenate(parts), begins


def _merged(spans: DataFrame, keys: list[str], begin: str, end: str, *more: Column) -> DataFrame:
    """Spans of equal keys that overlap or touch as one, with what else is gathered of them."""
    so_far = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col(begin) > reach).cast("int"), F.lit(1)))
    parted = new.withColumn("part", F.sum("new").over(so_far))
    return parted.groupBy(*keys, "part").agg(F.min(begin).alias(begin), F.max(end).alias(end), *more).drop("part")


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """(key, item_id, first_word, end_word, first_char, end_char): the spans of each shard; a span across a cut comes in two that overlap."""
    schema = T.StructType([docs.schema[key]] + [T.StructField(n, T.LongType()) for n in ("item_id", "first_word", "end_word", "first_char", "end_char")])
    sc = docs.sparkSession.sparkContext
    out = None
    for group in _passes(items, item_key, item_text):
        shared = sc.broadcast(group)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value)
            if not len(phrases.matrix):
                return
            for symbols, begins in _shards(batches, phrases.number):
                row, at = FMIndex(symbols, len(phrases.number)).search(phrases.matrix)
                starts = np.array([b[0] for b in begins])
                which = np.searchsorted(starts, at, "right") - 1
                hits = sorted(
                    {(int(w), item, int(p - starts[w]) + begins[w][2]) for r, p, w in zip(row, at, which) for item in phrases.items[r]}
                )
                spans: list[list] = []
                for w, item, p in hits:
                    if spans and spans[-1][:2] == [w, item] and p <= spans[-1][3]:
                        spans[-1][3] = p + SPAN
                    else:
                        spans.append([w, item, p, p + SPAN])
                places, last = [], -1
                for s in spans:
                    if s[0] != last:
                        last, own = s[0], [m.span() for m in WORD.finditer(begins[s[0]][3])]
                    places.append((own[s[2]][0], own[s[3] - 1][1]))
                columns = [pa.array([begins[s[0]][1] for s in spans], batch_type)]
                columns += [pa.array([s[k] for s in spans], pa.int64()) for k in (1, 2, 3)]
                columns += [pa.array([x[k] for x in places], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        batch_type = pa.string() if isinstance(docs.schema[key].dataType, T.StringType) else pa.int64()
        found = docs.select(key, text).filter(F.length(text) >= 2 * SPAN - 1).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, first_word, n_words): maximal spans of words of a document that are made of phrases of an item.

    Every partition of documents is indexed in shards; all phrases of SPAN words are searched backward in each index and
    overlapping or touching places of one item merge to one span, also across the cuts of a long document. Null and empty
    texts, and texts of fewer than SPAN words, give no row; repeated documents each give theirs if their keys differ; an
    empty table on either side gives an empty result.
    """
    spans = _found(docs, items, key, text, item_key, item_text).select(key, "item_id", "first_word", "end_word")
    merged = _merged(spans, [key, "item_id"], "first_word", "end_word")
    return merged.select(key, "item_id", "first_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))


def removals(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, first_char, end_char, n_items): the ranges of characters to cut out of a document, over all items; end_char is the first one after.

    Ranges that overlap or touch are one. Characters count from 0. Rows as for `leaked_spans`.
    """
    spans = _found(docs, items, key, text, item_key, item_text).select(key, "item_id", "first_char", "end_char")
    return _merged(spans, [key], "first_char", "end_char", F.countDistinct("item_id").alias("n_items"))


def leaked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return _found(docs, items, "doc_id", "text", "item_id", "text").select("doc_id", "item_id").distinct()
