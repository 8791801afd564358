"""Approximate nearest neighbours by inner product: probed lists with an adaptive dimension scan.

Vectors get one more component that gives all of them the same length, which turns the largest inner product
into the smallest distance; then they are rotated at random. A k-means fitted on a bounded sample makes lists, and every
vector is put into its nearest list. A query looks into so many nearest lists as, on the sample, hold ``TARGET`` of the true
neighbours. Before any list is read, each query has its ``K`` best neighbours in the sample; the last of them is a bound that all lists know. Within a
list the rotated components are read in blocks of columns, for many queries and candidates by one matrix product. After each block a
candidate is abandoned if its distance so far, scaled up to all dimensions, is above the bound by more than
chance explains. Those that survive are scored on the original vectors in double precision, and only what reaches the bound is handed on.

A list meets its queries in cells: at most about ``BLOCK_ROWS`` candidates and ``PART_ROWS`` queries each, dealt by a hash
of id and vector, so a list, or an id, that holds a third of all vectors is the work of many tasks. The driver holds the sample, the centroids
and the sizes of the lists, all bounded by ``SAMPLE``.

Defined results: vectors that are null, zero, of another than the most frequent length, or hold null or non-finite
components take no part. Rows that repeat an id and vector count once, query rows of one id are one query. Equal scores go
by the smaller id. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cohortmill.llm.common import map_arrow
from cohortmill.scale import cut

K = 20
#: Vectors that the index is fitted on, and sample rows for each list.
SAMPLE, PER_LIST = 16_384, 16
#: Share of the true neighbours, on the sample, that the probed lists must hold; sample queries for that.
TARGET, TRIALS = 0.985, 256
#: Rows of a list in one block, and queries in one part.
BLOCK_ROWS, PART_ROWS = 4096, 2048
#: Columns of a block, how far above the bound chance may carry a partial distance, and pairs that are looked at, and scored, at once.
COLUMNS, CHANCE, PAIRS, SCORED = 16, 2.1, 1 << 20, 1 << 16
#: Share of pairs left from which on they are followed one by one.
SPARSE = 0.1
SEED = 9


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct rows (id, vec) that can be searched, with double components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common.n if common else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """Rotation, centroids and the number of lists to look into."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, ids: np.ndarray, k: int = K):
        """``ids`` are those of the sample, in order."""
        self.ids, self.first = np.unique(ids, return_index=True)
        self.sample, self.single, self.k = sample, sample.astype(np.float32), k
        draw = np.random.default_rng(SEED)
        self.longest = longest
        n, d = sample.shape
        self.rotation = np.linalg.qr(draw.standard_normal((d + 1, d + 1)))[0].astype(np.float32)
        points = self.turned(sample)
        lists = int(max(1, min(np.sqrt(rows), n // PER_LIST)))
        self.centroids = points[draw.choice(n, lists, replace=False)]
        for _ in range(12):
            own = self.nearest(points, 1)[:, 0]
            for c in np.unique(own):
                self.centroids[c] = points[own == c].mean(axis=0)
        self.probes = self._probes(sample, points, draw)

    def turned(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors of equal length; a query gets 0 as its further component."""
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        return np.column_stack((vectors, more)).astype(np.float32) @ self.rotation

    def nearest(self, points: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each point, nearest first."""
        out = np.empty((len(points), n), np.int32)
        half = (self.centroids**2).sum(axis=1) / 2
        for at in range(0, len(points), 4096):
            far = half - points[at : at + 4096] @ self.centroids.T
            out[at : at + 4096] = np.argsort(far, axis=1, kind="stable")[:, :n]
        return out

    def known_best(self, vectors: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, float]]]:
        """The ``k`` best (id, inner product) of each query in the sample, repeated ids once; all of them if there are fewer."""
        last = np.append(self.first[1:], len(self.sample))
        wanted = min(self.k, len(self.ids))
        out = []
        step = max(1, PAIRS // len(self.sample))
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            about = np.maximum.reduceat(part.astype(np.float32) @ self.single.T, self.first, axis=1)
            best = np.argpartition(about, len(self.ids) - min(wanted + 1, len(self.ids)), axis=1)[:, -wanted - 1 :]
            for query, own, chosen in zip(part, ids[at : at + step], best, strict=True):
                near = [(int(self.ids[c]), float((self.sample[self.first[c] : last[c]] * query).sum(axis=1).max())) for c in chosen if self.ids[c] != own]
                out.append(sorted(near, key=lambda x: (-x[1], x[0]))[: self.k])
        return out

    def _probes(self, sample: np.ndarray, points: np.ndarray, draw: np.random.Generator) -> int:
        """Lists to look into so that they hold TARGET of the true neighbours on the sample."""
        lists = len(self.centroids)
        trial = draw.choice(len(sample), min(TRIALS, len(sample)), replace=False)
        own = self.nearest(points, 1)[:, 0]
        order = np.argsort(self.nearest(self.turned(sample[trial], query=True), lists), axis=1)
        places = []
        for k, row in enumerate(trial):
            score = sample @ sample[row]
            score[row] = -np.inf
            places.append(order[k, own[np.argsort(-score, kind="stable")[: min(K, len(sample) - 1)]]])
        places = np.sort(np.concatenate(places)) if places else np.array([])
        return int(places[min(len(places) - 1, int(TARGET * len(places)))]) + 1 if len(places) else lists


def survivors(points: np.ndarray, turned: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose distance is not found to be above the query's bound (squared), block of columns by block."""
    dims = points.shape[1]
    # rounding in single precision must not drop an equal
    noise = 1e-5 * ((turned**2).sum(axis=1) + (points[0] ** 2).sum())
    far, query, row = np.zeros((len(turned), len(points)), np.float32), None, None
    for at in range(0, dims, COLUMNS):
        p, q = points[:, at : at + COLUMNS], turned[:, at : at + COLUMNS]
        seen = min(dims, at + COLUMNS)
        # the components seen are a draw without replacement, so chance ends with the last of them
        chance = (1 + CHANCE * np.sqrt((1 - seen / dims) / seen)) ** 2
        slack = chance * (1 + 1e-4) * seen / dims
        if query is None:
            far += (p * p).sum(axis=1) + (q * q).sum(axis=1)[:, None]
            far -= 2 * (q @ p.T)
            stay = far <= (bound * slack + noise)[:, None]
            if seen == dims or stay.mean() < SPARSE:
                query, row = np.nonzero(stay)
                far = far[query, row]
        else:
            far = far + ((p[row] - q[query]) ** 2).sum(axis=1)
            stay = far <= (bound * slack + noise)[query]
            query, row, far = query[stay], row[stay], far[stay]
    return query, row


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of each query, each id once, the smaller id first among equals."""
    order = np.lexsort((-score, ids, query))
    once = np.ones(len(order), bool)
    once[1:] = (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[once]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    first = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - first < k]


def scan(cell: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, index: Index):
    """Rows of the cell that reach the bound of a query, as (query ids, ids, scores), the best ``k`` ids of each query."""
    own_ids, own, points = cell
    turned = index.turned(vectors, query=True)
    # the same bound as a squared distance of the turned vectors
    far = (vectors**2).sum(axis=1) + index.longest**2 - 2 * bounds
    found = []
    step = max(1, PAIRS // len(points))
    for at in range(0, len(ids), step):
        query, row = survivors(points, turned[at : at + step], far[at : at + step])
        query = query + at
        other = own_ids[row] != ids[query]
        query, row = query[other], row[other]
        parts = [slice(x, x + SCORED) for x in range(0, max(1, len(row)), SCORED)]
        score = np.concatenate([(own[row[x]] * vectors[query[x]]).sum(axis=1) for x in parts])
        good = score >= bounds[query]
        query, row, score = query[good], row[good], score[good]
        best = best_of(query, own_ids[row], score, index.k)
        found.append((ids[query[best]], own_ids[row[best]], score[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


FOUND = StructType(
    [StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())]
)


def cells(rows: DataFrame, queries: DataFrame, plan: DataFrame) -> DataFrame:
    """Candidates (kind 0) and queries (kind 1) of every cell."""
    plan = F.broadcast(plan)  # a row for each list
    mixed = F.xxhash64("id", "vec")
    own = rows.join(plan, "list").select(
        "list",
        F.pmod(mixed, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("kind"),
        "id",
        "vec",
        F.lit(0.0).alias("bound"),
    )
    asked = queries.join(plan, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(mixed, "parts").cast("int").alias("part"),
        F.lit(1).alias("kind"),
        "id",
        "vec",
        "bound",
    )
    key = ["list", "block", "part"]
    return own.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind")


def scanned(cell_rows: DataFrame, shared) -> DataFrame:
    """The nearest rows of each query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key, parts, cell = shared.value, None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "part", "kind")])
            ids, vectors = batch.column("id").to_numpy(), matrix(batch.column("vec"))
            bounds = batch.column("bound").to_numpy()
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), len(ids)]
            out = []
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                here = tuple(marks[:3, start])
                if here != key:
                    key, parts, cell = here, [], None
                if marks[3, start] == 0:
                    parts.append((ids[start:end], vectors[start:end]))
                    continue
                if cell is None:
                    if not parts:
                        continue
                    own = np.concatenate([v for _, v in parts])
                    cell = (np.concatenate([i for i, _ in parts]), own, index.turned(own))
                    parts = []
                out.append(scan(cell, ids[start:end], vectors[start:end], bounds[start:end], index))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=FOUND.names
                )

    return cell_rows.mapInArrow(run, FOUND)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest vectors found for each query.

    ``queries`` has the columns of ``vectors``; a vector with the id of the query is not its neighbour.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the rows with the smallest hashes; each task sends no more than it would keep
    share = min(1.0, 1.25 * sample_rows / about.n)
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    drawn = rows.where(place <= int(share * (1 << 30))).limit(2 * sample_rows).collect()
    drawn.sort(key=lambda r: r.id)
    index = Index(np.array([r.vec for r in drawn]), float(np.sqrt(about.square)), about.n, np.array([r.id for r in drawn]), k)
    shared = spark.sparkContext.broadcast(index)

    def assign(column):
        return [index_of(column, False, 1)[:, 0].tolist()]

    def index_of(column, query, n):
        return shared.value.nearest(shared.value.turned(matrix(column), query), n)

    listed = cut(map_arrow(rows, ["vec"], [StructField("list", IntegerType())], assign, keep=["id", "vec"]))
    held = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect()
    sizes, ids = {r["list"]: r.n for r in held}, {r["list"]: r.ids for r in held}
    lists = len(index.centroids)
    room = np.array([ids.get(c, 0) for c in range(lists)])

    def probe(column, names):
        order = index_of(column, True, lists)
        # further lists while those taken hold too few ids
        enough = (np.cumsum(room[order], axis=1) < 2 * k + 2).sum(axis=1) + 1
        probed = [o[: max(index.probes, e)].tolist() for o, e in zip(order, enough, strict=True)]
        known = index.known_best(matrix(column), names.to_numpy())
        bound = [near[-1][1] if len(near) == k else -float("inf") for near in known]
        return [probed, bound, [[{"vec_id": i, "score": x} for i, x in near] for near in known]]

    asked = taking_part(queries, id_col, vec_col).withColumn("id", F.col("id").cast("long"))
    dims = len(drawn[0].vec)
    asked = asked.where(F.size("vec") == dims)
    made = [StructField("lists", ArrayType(IntegerType())), StructField("bound", DoubleType()), StructField("known", ArrayType(StructType(FOUND.fields[1:])))]
    asked = map_arrow(asked, ["vec", "id"], made, probe, keep=["id", "vec"])
    asked = cut(asked)
    known = asked.select(F.col("id").alias("query_id"), F.inline("known"))
    asked = asked.select("id", "vec", "bound", F.explode("lists").alias("list"))
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    plan = [
        (c, int(-(-sizes[c] // BLOCK_ROWS)), int(max(1, -(-wanted.get(c, 0) // PART_ROWS)))) for c in sizes
    ]
    plan = spark.createDataFrame(plan, "list int, blocks int, parts int")
    found = scanned(cells(listed, asked, plan), shared).unionByName(known)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20) -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every`` among all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0))
