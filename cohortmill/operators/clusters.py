"""Density clusters of vectors: exact neighbours within a radius, joined to components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill import scale

# rows of a block; a pair of blocks is compared at a time
BLOCK_ROWS = 4_000
# rows placed at a time, and pivots whose distances rule out pairs of blocks
PLACED_ROWS, BOUNDS = 2_000, 64
# a cell for so many points, up to the square root of their number
CELL_POINTS = 100


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((b - a) ** 2).sum(1))


def choose_pivots(points: DataFrame, rows: int) -> np.ndarray:
    """Points, by hash order, as centres of the cells.

    Their number grows with the square root of the rows: cells stay of that size, too, and the centres fit any driver.
    """
    k = max(1, min(rows // CELL_POINTS, math.isqrt(rows)))
    sample = points.orderBy(F.xxhash64("id"), "id").limit(k).select("vec").collect()
    return np.array([r["vec"] for r in sample], dtype="float64")


def cells_of(x: np.ndarray, pivots: np.ndarray, eps: float, halo: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's home, for every cell that a row is put into."""
    cells = np.arange(len(pivots))
    d = _distances(x, pivots)
    home = d.argmin(1)
    near = d[np.arange(len(x)), home]
    homes, own = np.unique(home, return_inverse=True)
    gap = 2.0 * _distances(pivots[homes], pivots)[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d**2 - near[:, None] ** 2) / gap, 0.0)
    take = plane <= eps + 1e-9
    if halo == "lower":
        take &= cells[None, :] < home[:, None]
    elif halo == "none":
        take[:] = False
    take[np.arange(len(x)), home] = True
    row, cell = np.nonzero(take)
    return row, cell, cell == home[row]


def _chained(pivots: np.ndarray) -> np.ndarray:
    """Pivots, each followed by the nearest one left, so that blocks over several cells stay close together."""
    d = _distances(pivots, pivots)
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, d[order[-1]], np.inf).argmin()) if np.isfinite(d[order[-1]][left]).any() else int(left.argmax()))
        left[order[-1]] = False
    return pivots[order]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(block: int, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A block as one row; bounds are widened by what rounding can do, and open where a distance is no number."""
    d = _distances(x, bounds)
    slack = 1e-6 * (1.0 + np.sqrt(max((x * x).sum(1).max(), (bounds * bounds).sum(1).max())))
    known = np.isfinite(d).all(0) & np.isfinite(slack)
    low, high = np.where(known, d.min(0) - slack, -np.inf), np.where(known, d.max(0) + slack, np.inf)
    columns = [pa.array([block]), pa.array([len(ids)]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x)), pa.array([low]), pa.array([high])]
    return pa.RecordBatch.from_arrays(columns, names=["blk", "n", "ids", "vecs", "low", "high"])


def _blocks(points: DataFrame, pivots: np.ndarray, rows: int, block_rows: int) -> DataFrame:
    """Points in blocks of at most ``block_rows``, cell by cell, each a row of packed ids and vectors.

    ``low`` and ``high`` bound the distances of a block's points to the first pivots. Sorted points are streamed, so a task holds one
    block and not a cell.
    """
    centres = _chained(pivots) if len(pivots) else pivots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLACED_ROWS):
                part = batch.slice(at, PLACED_ROWS)
                _, cell, _ = cells_of(_matrix(part.column("vec")), centres, 0.0, "none")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], names=["id", "vec", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vecs = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - sum(map(len, ids)))
                ids.append(part.column("id").to_numpy())
                vecs.append(_matrix(part.column("vec")))
                at += part.num_rows
                if sum(map(len, ids)) == block_rows:
                    yield _packed(block, np.concatenate(ids), np.concatenate(vecs), pivots[:BOUNDS])
                    block, ids, vecs = block + 1, [], []
        if ids:
            yield _packed(block, np.concatenate(ids), np.concatenate(vecs), pivots[:BOUNDS])

    placed = points.select("id", "vec").mapInArrow(place, "id long, vec array<double>, cell int")
    tasks = max(1, rows // (8 * block_rows))
    ranged = placed.repartitionByRange(tasks, "cell", "id").sortWithinPartitions("cell", "id")
    return scale.cut(ranged.mapInArrow(pack, "blk long, n long, ids binary, vecs binary, low array<double>, high array<double>"))


def _compared(left: DataFrame, right: DataFrame, eps: float, compare: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``compare(ids, vectors, ids, vectors, same)`` of all pairs of blocks that can have points within ``eps``.

    Two blocks whose distances to one pivot are more than ``eps`` apart have none, by the triangle inequality. The others meet as two packed
    rows, so what a task holds does not grow with the points. If both sides are one, a pair of blocks is taken once.
    """
    one = left is right
    ours = left.select(F.col("blk").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    theirs = right.select(F.col("blk").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    apart = lambda low, high: F.exists(F.zip_with(low, high, lambda x, y: x - y > eps), lambda far: far)
    # one row per block without its points
    pairs = ours.join(F.broadcast(theirs), ~apart("la", "hb") & ~apart("lb", "ha")).select("a", "b")
    pairs = scale.cut(pairs.where("a <= b") if one else pairs)
    side = lambda df, x: df.select(
        F.col("blk").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "ids", "vecs"))
    ).hint("shuffle_hash")

    def unpacked(batch: pa.RecordBatch, r: int, x: str) -> tuple[np.ndarray, np.ndarray]:
        values = [np.frombuffer(batch.column(f"{c}_{x}")[r].as_buffer(), kind) for c, kind in (("ids", np.int64), ("vecs", np.float64))]
        return values[0], values[1].reshape(len(values[0]), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for r in range(batch.num_rows):
                found = compare(*unpacked(batch, r, "a"), *unpacked(batch, r, "b"), one and a[r] == b[r])
                yield from found.to_batches()

    return pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").mapInArrow(run, schema)


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within eps: by matrix product, near the border exactly."""
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    square = sa[:, None] + sb[None, :] - 2.0 * (a @ b.T)
    doubt = 1e-11 * (sa[:, None] + sb[None, :]) + 1e-300
    near = square <= eps * eps
    rows, cols = np.nonzero(np.abs(square - eps * eps) <= doubt)
    if rows.size:
        near[rows, cols] = _exact(a[rows], b[cols]) <= eps
    return near


def _forest(
    x: np.ndarray, ids: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, eps: float
) -> list[tuple[int, int]]:
    """Edges that join all rows linked by a pair within eps, at most one less than the rows.

    Compares ``left`` rows with ``right`` rows; a pair that is already connected, by ``group``, adds no edge.
    """
    edges = []
    rows, others = np.nonzero(left)[0], np.nonzero(right)[0]
    y = x[others]
    for at in range(0, len(rows), 256):
        chunk = rows[at : at + 256]
        for i, near in zip(chunk, _within(x[chunk], y, eps)):
            close = others[near]
            kinds, where = np.unique(group[close], return_index=True)
            for kind, first in zip(kinds, where):
                if kind != group[i]:
                    edges.append((int(ids[i]), int(ids[close[first]])))
                    group[group == kind] = group[i]
    return edges


def eps_edges(points: DataFrame, eps: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A spanning set of edges ``(src, dst)`` of the graph of points within ``eps``.

    Points stand in blocks by the nearest pivot, and pairs of blocks that can have partners are compared (:func:`_compared`). A pair of
    blocks returns connecting edges only, never all pairs.
    """
    rows = points.count()
    blocks = _blocks(points, choose_pivots(points, rows), rows, block_rows)

    def compare(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, same: bool) -> pa.Table:
        if not same:
            ids, x = np.concatenate([ids, others]), np.concatenate([x, y])
        left = np.arange(len(ids)) < len(ids) - (0 if same else len(others))
        edges = _forest(x, ids, np.arange(len(ids)), left, left if same else ~left, eps)
        src, dst = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"src": src, "dst": dst})

    return _compared(blocks, blocks, eps, compare, "src long, dst long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id) of all nodes in ``edges(src, dst)``, ids of any type that has an order.

    Alternates two star steps that hang neighbours on the smallest id seen, until nothing changes; rounds grow with the
    logarithm of the longest path. Minima are written before they are joined, so that the join may split the
    edges of a hub. Each round is written to the shared folder.
    """
    pairs = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    pairs, last = scale.cut(pairs), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scale.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        # neighbours above a node hang on the smallest id around it
        above = scale.skew_join(both.where("v > u"), low, "u")
        large = scale.cut(above.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = scale.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = scale.skew_join(large, low, "u")
        # neighbours below a node, and the node, hang on the smallest of them
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs = scale.cut(small)
        mark = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if mark == last:
            ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return ends.unionByName(roots)
        last = mark


def density_clusters(vectors: DataFrame, eps: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, cluster`` (null for noise) of ``vectors(id, vec)``.

    With two points enough for a core, clusters are the components of at least two points. Equal
    vectors are compared once: their copies join the one with the smallest id.
    """
    typed = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    copies = typed.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = scale.cut(copies)
    points = reps.where("vec IS NOT NULL").select(F.col("rep").alias("id"), "vec")
    parts = connected_components(eps_edges(points, eps, block_rows=block_rows)).withColumnRenamed("id", "rep")
    own = reps.join(parts, "rep", "left").select(
        "vec", F.when(F.col("component").isNull() & (F.col("n") > 1), F.col("rep")).otherwise(F.col("component")).alias("cluster")
    )
    return typed.join(own.where("vec IS NOT NULL"), "vec", "left").select("id", "cluster")


def assign_clusters(points: DataFrame, cores: DataFrame, eps: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, cluster`` of new points: that of the nearest core nearer than ``eps``, else null.

    ``cores(id, vec, cluster)``. Ties go to the smaller core id.
    """
    new = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    old = cores.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    old, new = scale.cut(old), scale.cut(new)
    known, asked = old.where("vec IS NOT NULL"), new.where("vec IS NOT NULL")
    rows = known.count()
    pivots = choose_pivots(known, rows)

    def nearest(ids: np.ndarray, x: np.ndarray, cores: np.ndarray, y: np.ndarray, _: bool) -> pa.Table:
        found = []
        square = (y * y).sum(1)
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            own = (part * part).sum(1)[:, None]
            about = own + square[None, :] - 2.0 * (part @ y.T)
            # all that may be nearest for rounding, and near enough, are measured exactly
            doubt = 1e-11 * (own + square[None, :]) + 1e-300
            least = (about + doubt).min(1, initial=np.inf)[:, None]
            row, core = np.nonzero((about - doubt <= least) & (about - doubt <= eps * eps))
            exact = _exact(part[row], y[core])
            order = np.lexsort((cores[core], exact, row))
            first = order[np.diff(row[order], prepend=-1) > 0]
            first = first[exact[first] < eps]
            found.append((ids[at + row[first]], exact[first], cores[core[first]]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table(dict(zip(["id", "dist", "core"], columns)))

    blocks = _blocks(known, pivots, rows, block_rows)
    best = (
        _compared(_blocks(asked, pivots, asked.count(), block_rows), blocks, eps, nearest, "id long, dist double, core long")
        .groupBy("id")
        .agg(F.min(F.struct("dist", "core")).alias("b"))
        .select("id", F.col("b.core").alias("core_id"))
    )
    names = cores.select(F.col("id").cast("long").alias("core_id"), "cluster")
    return new.select("id").join(best.join(names, "core_id"), "id", "left").select("id", "cluster")
