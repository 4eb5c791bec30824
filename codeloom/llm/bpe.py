"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Every short word that the vocabulary's pattern cuts from a text is merged with a contiguous rank array: the part
boundaries stand in one list, the rank of each part joined with its right neighbour in a parallel one; the least rank is
found by a scan, its boundary deleted and the two ranks beside it renewed. Words longer than LONG bytes, for which repeated
scans would be quadratic, keep the same state in linked boundaries and take the least rank from a heap; the ids are equal.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes up to which a word is merged by repeated scans.
LONG = 256
#: Words whose ids a Python worker remembers.
REMEMBER = 400_000

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    starts = list(range(len(word) + 1))
    rank = ranks.get
    pairs = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        at = pairs.index(least)
        del starts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = rank(word[starts[at] : starts[at + 2]], _NONE)
        if at:
            pairs[at - 1] = rank(word[starts[at - 1] : starts[at + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    current = {i: r for r, i in heap}

    def renew(i: int) -> None:
        right = after[i]
        current.pop(i, None)
        if right < n and (r := ranks.get(word[i : after[right]])) is not None:
            current[i] = r
            heapq.heappush(heap, (r, i))

    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or current.get(i) != r:
            continue
        gone = after[i]
        alive[gone] = False
        current.pop(gone, None)
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Splits texts by the vocabulary's pattern and merges each distinct word once."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty text give an empty list."""
        if not text:
            return []
        known, out = self.known, []
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                ids = merge_word(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(known) >= REMEMBER:
                    known.clear()
                if len(word) <= LONG:
                    known[word] = ids
            out += ids
        return out


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens and without normalisation.

    Null and empty texts give an empty list, repeated rows repeat, a null key stays null. Text that looks like a
    special token is ordinary text. Other columns are not read. `vocabulary` is a path that every executor can read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            ids = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(encode, schema)
