"""Long exact spans shared between records (problem 7), by level-wise doubling.

A span of SPAN characters that two records share holds, in both, the same window of LEVELS[0] characters with the least hash
among all such windows of the span. These anchors alone are compared first. Those that occur in several texts are
extended to twice the length, to the left or to the right; those that still occur in several texts are extended to
twice that length, by LEFT_2 steps; what survives names the places where whole spans are compared, one by one. Each
level is computed only for the texts and places that were repeated at the level before, and the work ends when nothing is.

Windows are compared by 64-bit polynomial hashes, computed by numpy for all positions of a batch of texts at once, whole spans by
two of them with different bases (128 bits); texts are known by their 64-bit hash. Records with equal text form one class
throughout, whose members appear at the end only. Pairs within a set of texts, or within a class, are made in blocks of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import durable

#: Characters of a span that is worth reporting.
SPAN = 200
#: Window lengths, each twice the one before.
LEVELS = (44, 88, 176)
#: Characters to the left of the anchor in the windows of the second level: any span has 44 more on one side.
LEFT_1 = (0, 44)
#: The same at the third level. Of the 156 characters that a span has besides the anchor, a window takes 132; each
#: way to share them out lies at most STEP beyond one of these.
LEFT_2 = (0, 24, 48, 72, 96, 120, 132)
STEP = 24
#: Characters hashed at a time.
CHUNK = 1_000_000
#: Members of a set of texts, or of a class of copies, that one task pairs with as many others.
BLOCK = 1_000

_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class Hasher:
    """Hashes of any window of some texts, joined to one array of code points."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, texts: list[str], base: int = _BASE) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        n = len(points)
        if len(Hasher.powers.get(base, ((),))[0]) <= n:
            with np.errstate(over="ignore"):
                Hasher.powers[base] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64)))
        powers, self.inverses = Hasher.powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def windows(self, at: np.ndarray | slice, size: int) -> np.ndarray:
        """Mixed hashes of the windows of `size` that begin at these places, or at all places."""
        if isinstance(at, slice):
            x = (self.sums[size:] - self.sums[:-size]) * self.inverses[: len(self.sums) - size]
        else:
            x = (self.sums[at + size] - self.sums[at]) * self.inverses[at]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x

    def anchors(self) -> np.ndarray:
        """Places of the windows whose hash is the least of some span's."""
        size, wide = LEVELS[0], SPAN - LEVELS[0] + 1
        if len(self.sums) <= SPAN:
            return np.zeros(0, np.int64)
        grams = self.windows(slice(None), size)
        least = _sliding(np.minimum, grams, wide)
        owner_end = np.repeat(self.ends, self.sizes)[: len(least)]
        least[np.arange(len(least)) + SPAN > owner_end] = 0  # spans that cross into the next text
        pad = np.zeros(wide - 1, np.uint64)
        best = _sliding(np.maximum, np.concatenate((pad, least, pad)), wide)
        return np.flatnonzero((best == grams) & (best > 0))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _sliding(fold: np.ufunc, x: np.ndarray, wide: int) -> np.ndarray:
    """fold of every `wide` neighbours."""
    n = len(x)
    blocks = -(-n // wide)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF if fold is np.minimum else 0)
    y = np.full(blocks * wide, fill, np.uint64)
    y[:n] = x
    y = y.reshape(blocks, wide)
    ahead = fold.accumulate(y, axis=1).ravel()
    back = fold.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: n - wide + 1], ahead[wide - 1 : n])


def _chunks(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[list[int], list[str], list]]:
    """Rows of a batch, CHUNK characters at a time: keys, texts and what else the third column holds.

    A text that the partition had before is passed over, so that a third of all rows with one text costs one row a partition.
    """
    rest = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
    keys, texts, more, size = [], [], [], 0
    for key, text, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rest):
        if key in seen:
            continue
        seen.add(key)
        keys.append(key), texts.append(text), more.append(other)
        size += len(text)
        if size >= CHUNK:
            yield keys, texts, more
            keys, texts, more, size = [], [], [], 0
    if keys:
        yield keys, texts, more


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a partition once."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and hashes of the anchors of each text."""
    seen: set[int] = set()
    for batch in batches:
        for keys, texts, _ in _chunks(batch, seen):
            h = Hasher(texts)
            at = h.anchors()
            own = h.owner(at)
            yield pa.RecordBatch.from_pydict(
                {"text_key": pa.array(np.array(keys, np.int64)[own]), "at": pa.array((at - h.begins[own]).astype(np.int32)), "h": _signed(h.windows(at, LEVELS[0]))}
            )


def _placed(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[Hasher, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(hasher, text keys, owners, places, texts) of the places listed for each text."""
    for keys, texts, listed in _chunks(batch, seen):
        h = Hasher(texts)
        size = np.array([len(p) for p in listed])
        local = np.fromiter((x for p in listed for x in p), np.int64, int(size.sum()))
        yield h, np.array(keys, np.int64), np.repeat(np.arange(len(texts)), size), local, texts


def _extended(lefts: tuple[int, ...], size: int):
    """Windows of a size that begin so many characters to the left of the anchors listed for each text: (text_key, at, k, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, keys, own, local, _ in _placed(batch, seen):
                at = local + h.begins[own]
                for k, left in enumerate(lefts):
                    inside = (local >= left) & (at - left + size <= h.ends[own])
                    x = h.windows(at[inside] - left, size)
                    yield pa.RecordBatch.from_pydict(
                        {"text_key": pa.array(keys[own[inside]]), "at": pa.array(local[inside].astype(np.int32)), "k": pa.array(np.full(len(x), k, np.int32)), "h": _signed(x)}
                    )

    return run


def _spans(places: bool):
    """Hashes of whole spans at the places listed for each text; without places, each hash of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, keys, own, local, texts in _placed(batch, seen):
                at = local + h.begins[own]
                inside = (local >= 0) & (at + SPAN <= h.ends[own])
                at, own, local = at[inside], own[inside], local[inside]
                x, y = h.windows(at, SPAN), Hasher(texts, _BASE_2).windows(at, SPAN)
                columns = {}
                if places:
                    columns["at"] = pa.array(local.astype(np.int32))
                else:
                    order = np.lexsort((y, x, own))
                    x, y, own = x[order], y[order], own[order]
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (own[1:] != own[:-1])
                    x, y, own = x[new], y[new], own[new]
                yield pa.RecordBatch.from_pydict({"text_key": pa.array(keys[own]), **columns, "h": _signed(x), "h2": _signed(y)})

    return run


def _repeated(windows: DataFrame, *by: str) -> DataFrame:
    """Hashes that occur in several texts. Partial aggregation leaves one row of a hot hash per task."""
    ends = windows.groupBy(*by).agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    return ends.filter("least < most").select(*by)


def _texts(records: DataFrame, key: str, text: str) -> DataFrame:
    long = records.filter(F.col(key).isNotNull() & (F.length(text) >= SPAN))
    return long.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def _at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(text_key, text, places): the texts that have places (text_key, at) left, each once."""
    listed = places.groupBy("text_key").agg(F.collect_set("at").alias("places"))
    return texts.join(listed, "text_key").dropDuplicates(["text_key"]).select("text_key", "text", "places")


def _surviving(records: DataFrame, key: str, text: str) -> DataFrame:
    """(text_key, text, places): the texts that survive all levels, and where their spans may begin.

    The texts that survive a level are written to the shared folder, since the next one reads them twice: to find the
    windows that are repeated, and to keep the places of these.
    """
    texts = _texts(records, key, text)
    anchors = texts.mapInArrow(_anchors, "text_key long, at int, h long")
    level_0 = anchors.join(_repeated(anchors.select("text_key", "h"), "h"), "h", "left_semi").select("text_key", "at")
    once = texts.mapInArrow(_once, "text_key long, text string")
    left = durable(_at(once, level_0))

    def level(found: DataFrame, lefts: tuple[int, ...], size: int) -> DataFrame:
        windows = found.mapInArrow(_extended(lefts, size), "text_key long, at int, k int, h long")
        return windows.join(_repeated(windows.select("text_key", "h"), "h"), "h", "left_semi").select("text_key", "at", "k")

    level_1 = level(left, LEFT_1, LEVELS[1]).select("text_key", "at").distinct()
    left = durable(_at(left.select("text_key", "text"), level_1))
    begin = F.col("at") - F.element_at(F.array(*map(F.lit, LEFT_2)), F.col("k") + 1)
    starts = level(left, LEFT_2, LEVELS[2]).select("text_key", begin.alias("begin")).distinct()
    level_2 = starts.select("text_key", F.explode(F.sequence(F.greatest(F.col("begin") - STEP, F.lit(0)), F.col("begin"))).alias("at"))
    return durable(_at(left.select("text_key", "text"), level_2))


def repeated_spans(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(text_key, at, h): every place of every text at which a span begins that another text has as well."""
    spans = _surviving(records, key, text).mapInArrow(_spans(True), "text_key long, at int, h long, h2 long")
    return spans.join(_repeated(spans.select("text_key", "h", "h2"), "h", "h2"), ["h", "h2"], "left_semi").select("text_key", "at", "h")


def _pairs_within(members: DataFrame, group: list[str], item: str, size: str) -> DataFrame:
    """(a, b), a < b: all pairs of the items of each group, whose `size` each row names. Every task pairs two blocks of a group."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64(item), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    a = members.select(*group, F.col(item).alias("a"), own.alias("i"), F.explode(every).alias("j"))
    b = members.select(*group, F.col(item).alias("b"), own.alias("j"), F.explode(every).alias("i"))
    return a.join(b, [*group, "i", "j"]).filter("a < b").select("a", "b")


def sharing_texts(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(text_a, text_b): texts that share a span, text_a < text_b, each pair once.

    Neighbouring spans mostly stand in the same set of texts. Each set is known by its size and the mixed hashes of its
    members, and only one span of each set makes pairs.
    """
    inside = _surviving(records, key, text).mapInArrow(_spans(False), "text_key long, h long, h2 long")
    sets = inside.groupBy("h", "h2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_key")).alias("mix")).filter("n > 1")
    chosen = sets.groupBy("n", "mix").agg(F.min(F.struct("h", "h2")).alias("x")).select("x.h", "x.h2", "n")
    members = durable(inside.join(chosen, ["h", "h2"]))
    return _pairs_within(members, ["h", "h2"], "text_key", "n").select(F.col("a").alias("text_a"), F.col("b").alias("text_b")).distinct()


def _members(records: DataFrame, key: str, text: str) -> DataFrame:
    """(text_key, key, n, slot): the keys of each text, their number, and the block of these that a key belongs to."""
    long = records.filter(F.col(key).isNotNull() & (F.length(text) >= SPAN))
    members = long.select(F.xxhash64(text).alias("text_key"), F.col(key).alias("key")).distinct()
    sizes = members.groupBy("text_key").agg(F.count("*").alias("n"))
    sized = members.join(sizes, "text_key")
    return sized.withColumn("slot", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int"))


def shared_pairs(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(id_a, id_b): pairs of keys whose texts share a span of SPAN characters, id_a < id_b by code points.

    A key may have several rows. Null keys, null texts and texts shorter than SPAN give no row. Keys with equal text of at
    least that length are pairs. Other columns are ignored. An empty table gives an empty result.
    """
    pairs = sharing_texts(records, key, text)
    members = durable(_members(records, key, text))
    large = members.filter(F.col("n") > BLOCK).groupBy("text_key").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("slots"))
    between = pairs
    for side in ("a", "b"):
        at = f"text_{side}"
        slots = large.select(F.col("text_key").alias(at), "slots")
        parted = between.join(slots, at, "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        own = members.select(F.col("text_key").alias(at), "slot", F.col("key").alias(f"k{side}"))
        between = parted.join(own, [at, "slot"]).drop("slot", at)
    within = _pairs_within(members.filter("n > 1"), ["text_key"], "key", "n").select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    both = between.filter("ka <> kb").select("ka", "kb").unionByName(within)
    return both.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def shared_classes(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(id, class_id, n_members, n_links): each key with the class of its text, known by its least key, and with how many other classes share a span.

    Only keys with a text of SPAN characters at least have a row; one that has several texts has a row for each. No copies are paired.
    """
    members = _members(records, key, text)
    pairs = durable(sharing_texts(records, key, text))
    both = pairs.select(F.col("text_a").alias("text_key")).unionByName(pairs.select(F.col("text_b").alias("text_key")))
    classes = members.groupBy("text_key").agg(F.min("key").alias("class_id"), F.max("n").alias("n_members"))
    linked = classes.join(both.groupBy("text_key").agg(F.count("*").alias("n_links")), "text_key", "left")
    found = members.select("text_key", F.col("key").alias("id")).join(linked, "text_key")
    return found.select("id", "class_id", "n_members", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def shared_parts(records: DataFrame, key: str = "id", text: str = "code") -> DataFrame:
    """(id, n_chars, shared_chars, shared_part): how much of each text stands in spans that another key's text has too.

    Every key with a text has a row; a text that another key has as a whole is shared as a whole if it has SPAN characters.
    """
    spans = repeated_spans(records, key, text).select("text_key", "at").distinct()
    following = F.lead("at").over(Window.partitionBy("text_key").orderBy("at"))
    width = F.least(F.lit(SPAN), F.coalesce(following - F.col("at"), F.lit(SPAN)))
    covered = spans.select("text_key", width.alias("w")).groupBy("text_key").agg(F.sum("w").alias("covered"))
    rows = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    members = rows.select(F.xxhash64(text).alias("text_key"), F.col(key).alias("id"), F.length(text).cast("long").alias("n_chars")).distinct()
    copies = members.groupBy("text_key").agg(F.countDistinct("id").alias("copies")).filter("copies > 1")
    found = members.join(covered, "text_key", "left").join(copies, "text_key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= SPAN)
    shared = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    part = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    return found.select("id", "n_chars", shared.alias("shared_chars")).withColumn("shared_part", part)
