"""Most similar vectors for every vector (problem 1), by collision counting over single projections.

Each projection orders all vectors in one array. Near its far end an array is selective: two similar vectors lie far out in
the same arrays. The arrays stand on the sums of two sets of random directions, so that any number of them costs two small
products; every vector enters the arrays in which it lies farthest out. The far end of one array is a cell of about CELL
members whatever the table's size, and the cells are what Spark distributes. As more rows mean more and narrower far ends, the
number of them that a vector enters grows with the table too (`far_ends_of`), by which recall holds.

Within a cell, all members are sorted along each of DIMENSIONS orthogonal projections. A query counts in those COUNTED arrays in
which it lies farthest out among the members, where a window holds few. A window centred on the query's place opens in each;
while fewer than k members are found within the radius that the windows stand for, they expand to the next radius
(virtual rehashing). Each expansion counts only the members that it newly covers, and members whose count reaches
THRESHOLD are verified by their cosine, once.

The projections come from a fixed seed, so nothing is fitted, and every vector is both query and data. A cell with more than
HOT members, as one dense cluster makes, is cut into blocks, and each pair of its blocks is a task: all its
members stay comparable, no task holds more than two blocks, and the cost grows with the square of the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 64
NEIGHBOURS = 5
#: Least cosine of a neighbour.
LIMIT = 0.85
#: Members that a cell has on average.
CELL = 2_000
#: Far ends that a vector of a table of FAR_ROWS rows enters, and the power of the rows by which they grow.
FAR, FAR_ROWS, FAR_POWER = 7, 18_000, 1 / 7
#: Members beyond which a cell is cut into blocks of about that size.
HOT = 12_000
#: Arrays of a cell in which a query counts, and windows out of these that a candidate must share.
COUNTED, THRESHOLD = 4, 3
#: Distances of unit vectors that the widening windows stand for; the last one is that of LIMIT.
RADII = (0.36, float(np.sqrt(2 - 2 * LIMIT)))
#: Half a window's width: this many standard deviations of the projected difference of two vectors at the radius.
SPREAD = 2.4
#: Pairs of queries and members counted at a time, vectors projected at a time, and pairs verified at a time.
COUNTS, ROWS, PAIRS = 250_000, 2048, 100_000
#: Vectors travel as whole numbers of 16 bits, this many to one.
SCALE = 32_767
#: Count of a member that has been verified; it is never reached by counting.
VERIFIED = 128
_SEED = 20240117


def far_ends_of(n: int) -> int:
    """Far ends that each vector of a table of n rows enters."""
    return max(FAR, ceil(FAR * (n / FAR_ROWS) ** FAR_POWER))


def directions(n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of random unit vectors as columns; the sum of one of each is the direction of an array."""
    first = ceil(n_cells**0.5)
    both = []
    for salt, n in enumerate((first, ceil(n_cells / first))):
        d = np.random.default_rng(_SEED + salt).standard_normal((n, DIMENSIONS)).astype(np.float32)
        both.append((d / np.linalg.norm(d, axis=1, keepdims=True)).T.copy())
    return both[0], both[1]


def counted_directions() -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(_SEED - 1).standard_normal((DIMENSIONS, DIMENSIONS)))
    return q.astype(np.float32)


def _far_ends(x: np.ndarray, d: tuple[np.ndarray, np.ndarray], far: int) -> np.ndarray:
    """The `far` arrays in which each vector lies farthest out. These are sums of two of the `far` largest projections of each set."""
    n = d[1].shape[1]
    far = min(far, d[0].shape[1] * n)
    parts = []
    for i in range(0, len(x), ROWS):
        best = []
        for side in d:
            p = x[i : i + ROWS] @ side
            at = np.argpartition(-p, min(far, p.shape[1]) - 1, axis=1)[:, :far]
            best.append((at, np.take_along_axis(p, at, 1)))
        (a, pa_), (b, pb) = best
        sums = (pa_[:, :, None] + pb[:, None, :]).reshape(len(a), -1)
        ids = (a[:, :, None] * n + b[:, None, :]).reshape(len(a), -1)
        parts.append(np.take_along_axis(ids, np.argpartition(-sums, far - 1, axis=1)[:, :far], 1))
    return np.concatenate(parts) if parts else np.zeros((0, far), np.int64)


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a batch, each distinct vector once."""
    keys, first = np.unique(batch.column(0).to_numpy(), return_index=True)
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)[first].astype(np.float32)
    return keys, x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a[q], b[c]): one by one, PAIRS at a time, or picked from one product where they are many."""
    if len(q) * 12 > len(a) * len(b):
        return (a @ b.T)[q, c]
    parts = [np.einsum("ij,ij->i", a[q[i : i + PAIRS]], b[c[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _windows(arrays: np.ndarray, projected: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, bounds): of each query its COUNTED arrays, and where its window begins and ends in each of them at each radius.

    Bounds have the shape (radii + 1, 2, queries, COUNTED); the first ones are those of an empty window at the query's own place.
    """
    n = arrays.shape[1]
    centre, spread = np.median(arrays, axis=1), arrays.std(axis=1) + 1e-9
    out = np.abs(projected[queries] - centre) / spread
    chosen = np.argpartition(-out, COUNTED - 1, axis=1)[:, :COUNTED]
    bounds = np.empty((len(RADII) + 1, 2, len(queries), COUNTED), np.int32)
    for j in range(DIMENSIONS):
        q, k = np.nonzero(chosen == j)
        at = projected[queries[q], j]
        bounds[0, :, q, k] = np.searchsorted(arrays[j], at)[:, None]
        for r, radius in enumerate(RADII, 1):
            half = np.float32(SPREAD * radius / np.sqrt(DIMENSIONS))
            bounds[r, 0, q, k] = np.searchsorted(arrays[j], at - half, "left")
            bounds[r, 1, q, k] = np.searchsorted(arrays[j], at + half, "right")
    np.clip(bounds, 0, n, out=bounds)
    return chosen, bounds


def _covered(order: np.ndarray, chosen: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """query * members + member for each place of the chosen arrays from begin to end."""
    n = order.shape[1]
    size = (end - begin).ravel()
    stop = np.cumsum(size, dtype=np.int32)
    first = (chosen * n + begin).ravel().astype(np.int32) - (stop - size)
    places = np.repeat(first, size) + np.arange(stop[-1], dtype=np.int32)
    query = np.arange(0, len(chosen) * n, n, dtype=np.int32)
    return np.repeat(query, size.reshape(chosen.shape).sum(axis=1)) + order.ravel()[places]


def _among(keys: np.ndarray, x: np.ndarray, projected: np.ndarray, queries: np.ndarray, members: np.ndarray) -> Iterator[tuple]:
    """(query, neighbour, cosine): of each query its NEIGHBOURS nearest among the members, by their places in x."""
    n = len(members)
    arrays = np.ascontiguousarray(projected[members].T)
    order = np.argsort(arrays, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(arrays, order, 1)
    chosen_of_all, bounds_of_all = _windows(arrays, projected, queries)
    block = max(1, COUNTS // n)
    for first in range(0, len(queries), block):
        todo, chosen, bounds = queries[first : first + block], chosen_of_all[first : first + block], bounds_of_all[:, :, first : first + block]
        counts = np.zeros(len(todo) * n, np.uint8)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]  # verified neighbours of those still searched
        for r, radius in enumerate(RADII, 1):
            for side in (_covered(order, chosen, bounds[r, 0], bounds[r - 1, 0]), _covered(order, chosen, bounds[r - 1, 1], bounds[r, 1])):
                np.add.at(counts, side, np.uint8(1))
            reached = np.flatnonzero(counts - np.uint8(THRESHOLD) < np.uint8(VERIFIED - THRESHOLD))
            counts[reached] = VERIFIED
            q, c = np.divmod(reached, n)
            cosine = _verified(x[todo], x[members], q, c)
            near = (cosine >= LIMIT) & (todo[q] != members[c])
            kept.append((q[near], members[c[near]], cosine[near]))
            q, c, cosine = (np.concatenate(parts) for parts in zip(*kept))
            within = np.bincount(q[cosine >= 1 - radius * radius / 2 - 1e-6], minlength=len(todo))
            done = (within >= NEIGHBOURS) | (r == len(RADII))
            mine = done[q]
            dq, dc, dcos = q[mine], c[mine], cosine[mine]
            by = np.lexsort((keys[dc], -dcos, dq))
            dq, dc, dcos = dq[by], dc[by], dcos[by]
            best = np.arange(len(dq)) - np.searchsorted(dq, dq, "left") < NEIGHBOURS
            yield todo[dq[best]], dc[best], dcos[best]
            if done.all():
                break
            place = np.cumsum(~done) - 1
            kept = [(place[q[~mine]], c[~mine], cosine[~mine])]
            counts = counts.reshape(len(todo), n)[~done].ravel()
            todo, chosen, bounds = todo[~done], chosen[~done], bounds[:, :, ~done]


def nearest(keys: np.ndarray, x: np.ndarray, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of one cell: of each member its NEIGHBOURS nearest with LIMIT at least.

    With `block`, which holds two values, the nearest of the other block.
    """
    projected = x @ counted_directions()
    if block is None:
        each = [(np.arange(len(x)), np.arange(len(x)))]
    else:
        first = block == block.min()
        each = [(np.flatnonzero(first), np.flatnonzero(~first)), (np.flatnonzero(~first), np.flatnonzero(first))]
    out = [found for queries, members in each for found in _among(keys, x, projected, queries, members)]
    if not out:
        return keys[:0], keys[:0], np.zeros(0, np.float32)
    q, c, cosine = (np.concatenate(x) for x in zip(*out))
    return keys[q], keys[c], cosine


def _cell_sizes(n_cells: int, far: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directions(n_cells)
        count = np.zeros(d[0].shape[1] * d[1].shape[1], np.int64)
        for batch in batches:
            count += np.bincount(_far_ends(_unit(batch)[1], d, far).ravel(), minlength=len(count))
        cells = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(count[cells])})

    return run


def _parts(keys: np.ndarray, row: np.ndarray, cell: np.ndarray, hot: dict[int, int]) -> Iterator[tuple]:
    """(rows, cells, parts, blocks); in a hot cell each row once for every pair of blocks that its own belongs to."""
    warm = np.isin(cell, np.array(sorted(hot), np.int64))
    none = np.zeros(len(row) - warm.sum(), np.int64)
    yield row[~warm], cell[~warm], none, none
    for c in np.unique(cell[warm]).tolist():
        n, own = hot[c], row[cell == c]
        block = (keys[own].view(np.uint64) % np.uint64(n)).astype(np.int64)
        for other in range(n):
            yield own, np.full(len(own), c), 1 + np.minimum(block, other) * n + np.maximum(block, other), block


def _assign(n_cells: int, far: int, hot: dict[int, int]):
    """Rows (cell, part, block, key, vector): each vector once for each far end.

    Part and block are 0 but in hot cells, which have the given number of blocks: there a part is a pair of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directions(n_cells)
        for batch in batches:
            keys, x = _unit(batch)
            ends = _far_ends(x, d, far)
            packed = np.rint(x * SCALE).astype("<i2")
            every = np.repeat(np.arange(len(x)), ends.shape[1])
            for row, cell, part, block in _parts(keys, every, ends.ravel(), hot):
                for i in range(0, len(row), 4 * ROWS):
                    r = row[i : i + 4 * ROWS]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "cell": pa.array(cell[i : i + 4 * ROWS].astype(np.int32)),
                            "part": pa.array(part[i : i + 4 * ROWS]),
                            "block": pa.array(block[i : i + 4 * ROWS].astype(np.int32)),
                            "key": pa.array(keys[r]),
                            "vector": pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DIMENSIONS), len(r), [None, pa.py_buffer(packed[r].tobytes())]).cast(pa.binary()),
                        }
                    )

    return run


def _search(cell: pa.Table) -> pa.Table:
    keys, first = np.unique(cell.column("key").to_numpy(), return_index=True)
    packed = b"".join(v.as_py() for v in cell.column("vector"))
    x = np.frombuffer(packed, "<i2").reshape(-1, DIMENSIONS)[first].astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = cell.column("block").to_numpy()[first]
    a, b, cosine = nearest(keys, x, block if (block != block[0]).any() else None)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float32())})


def _usable(records: DataFrame, key: str, vector: str) -> DataFrame:
    full = F.col(key).isNotNull() & (F.size(vector) == DIMENSIONS) & F.exists(vector, lambda v: v != 0)
    sound = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return records.filter(full & sound)


def nearest_classes(records: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine): of each distinct vector, known by its hash, the NEIGHBOURS nearest other ones."""
    vectors = _usable(records, key, vector).select(F.xxhash64(vector).alias("key"), F.col(vector).alias("vector"))
    n = vectors.count()
    far = far_ends_of(n)
    n_cells = max(2 * far, n * far // CELL)
    sizes = vectors.mapInArrow(_cell_sizes(n_cells, far), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    hot = {r.cell: -(-r.n // HOT) for r in sizes.filter(F.col("n") > HOT).collect()}  # fewer than n_cells * CELL / HOT
    cells = vectors.mapInArrow(_assign(n_cells, far, hot), "cell int, part long, block int, key long, vector binary")
    found = cells.groupBy("cell", "part").applyInArrow(_search, "a long, b long, cosine float")
    once = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return once.withColumn("place", rank).filter(F.col("place") <= NEIGHBOURS).drop("place")


def nearest_neighbours(records: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, neighbour, cosine, place): of each record its NEIGHBOURS nearest other records with cosine LIMIT at least.

    Records without a key, and vectors that are null, of another size, all zero or hold a null or NaN, are left out; a key with several
    rows counts once. Equal vectors are searched once: of a class of copies the NEIGHBOURS + 1 least keys can be
    neighbours, so a large class makes no more rows than its members. Ties go to the lesser key.
    """
    rows = _usable(records, key, vector)
    members = rows.select(F.xxhash64(vector).alias("vkey"), F.col(key).alias("id")).distinct()
    rank = F.row_number().over(Window.partitionBy("vkey").orderBy("id"))
    first = members.withColumn("n", rank).filter(F.col("n") <= NEIGHBOURS + 1).select("vkey", F.col("id").alias("neighbour"))
    near = nearest_classes(records, key, vector)
    others = near.join(first.withColumnRenamed("vkey", "b"), "b").select(F.col("a").alias("vkey"), "neighbour", "cosine")
    twins = first.join(first.groupBy("vkey").agg(F.count("*").alias("n")).filter("n > 1").select("vkey"), "vkey")
    same = twins.select("vkey", "neighbour", F.lit(1.0).cast("float").alias("cosine"))
    order = Window.partitionBy("vkey").orderBy(F.desc("cosine"), "neighbour")
    listed = others.unionByName(same).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= NEIGHBOURS + 1)
    pairs = members.join(listed, "vkey").filter("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return pairs.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).select("id", "neighbour", "cosine", "place")


def neighbour_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of which one is a near neighbour of the other, id_a < id_b by code points."""
    near = nearest_neighbours(records)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
