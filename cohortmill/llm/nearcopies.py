"""MinHash near-deduplication: chosen-path set similarity join, then exact confirmation.

A document is the set of its word shingles. Documents with equal sets are one class and go on as one row. Of each set a
few minwise tokens are kept: one for the root of each tree, and ``SKETCH`` short ones. In a tree, documents are branched by the
token chosen at their node; the coordinate that is chosen depends on the path, and a quarter of the nodes branch by two. A node
with at most ``SMALL`` documents is compared exhaustively by sketch. After ``DEPTH`` levels only nodes above ``WIDE`` that still shrink
are branched further; other large nodes, which means very many documents that are much alike, are first dealt out in chunks that all hold
the same leaders, and then compared block by block as below. Independent trees are repeated so that a pair at the
threshold is missed with a chance below 0.2 to the power ``TREES`` at the first level.

Pairs that look alike are then confirmed on the full sets. Pairs that hang together meet in cells, so that a text
travels about once, and each cell gives the links of a spanning forest. Components of these links are the groups. Nothing is
collected for a group, and copies are never written as pairs.

Documents of a dense node first name few partners, which joins most copies. A second round then compares, in every dense
node, all documents that the links have left in different groups: cells of two blocks, first by sketch, then, where a pair looks alike, on the
full sets inside the cell, which returns links of a spanning forest only.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing. A text with fewer words than a shingle is
one shingle. Rows that repeat a document are in its class. Rows with a null id take part, but give no component id of their own: a group of such
rows only has a null component and, in :func:`deduplicated`, one of them stays. Extra columns are ignored or handed on. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from cohortmill.llm.common import map_arrow, texts
from cohortmill.llm.hashing import U64, Hashes, mixed
from cohortmill.operators.clusters import connected_components
from cohortmill.scale import cut

#: Words of a shingle, and the least similarity of a link in percent.
WORDS, PERCENT = 5, 80
TREES, SKETCH = 10, 64
#: Documents of a node that are compared exhaustively, levels of a tree, and leaders of a node that stays large.
SMALL, DEPTH, LEADERS = 128, 5, 16
#: A node of more than ``WIDE`` documents is branched further, unless its last branching left more than this share of its parent.
WIDE, SHRINK = 16_384, 0.8
#: Share of equal sketch tokens below which a pair is not confirmed: four deviations below 0.8.
ALIKE = 0.6
#: In nodes of more than ``DENSE`` documents, each names those that look most alike: ``PARTNERS`` of them if the last of these is
#: surely a link, two deviations above 0.8, and else up to ``UNSURE``. A spanning forest is added.
DENSE, PARTNERS, UNSURE, SURE = 16, 1, 4, 0.9
#: Documents and shingles of one block of the second round, documents of a cell that are named one by one, and shingles of one product.
BLOCK, BLOCK_SHINGLES, FEW, SLICE = 512, 1 << 21, 64, 4096
#: Edges of one cell of confirmations; with more than ``CROWDED`` edges a document, cells take ``CELL_NODES`` by ``CELL_NODES`` documents.
CELL_EDGES, CROWDED, CELL_NODES = 256, 8, 128
#: Bytes of text that are cut into words at once.
PIECE = 1 << 19

_DRAW = np.random.default_rng(6)
_FACTORS = _DRAW.integers(0, 2**64, TREES + SKETCH, dtype=U64) | U64(1)
_SHIFTS = _DRAW.integers(0, 2**64, TREES + SKETCH, dtype=U64)
_STEP = U64(0xD6E8FEB86659FD93)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII blanks, A-Z lower-cased, piece by piece."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b"\x20\t\n\v\f\r":
            end += 1
        data = np.frombuffer(text[at:end].lower(), np.uint8)
        inside = np.concatenate(([False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edges):
            out.append(Hashes(data, 0).of(edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    own = word_hashes(text) if text else np.zeros(0, U64)
    if not len(own):
        return own
    size = min(words, len(own))
    total = np.zeros(len(own) - size + 1, U64)
    for k in range(size):
        total = total * _STEP + own[k : len(own) - size + 1 + k]
    return np.unique(mixed(total + U64(size)))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    parts = np.array([mixed(shingles).sum(), mixed(shingles ^ _STEP).sum()]) + U64(len(shingles))
    return mixed(parts).astype(">u8").tobytes()


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: the least value of each of several hash functions."""
    out = np.empty(len(_FACTORS), U64)
    for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        out[k] = (shingles * factor + shift).min()
    return mixed(out)


def child(path: np.ndarray, sketches: np.ndarray, branch: int) -> np.ndarray:
    """Paths of the next level: the path chooses a coordinate of the sketch, whose token is the branch."""
    choice = mixed(path + U64(branch + 1) * _STEP)
    token = sketches[np.arange(len(path)), (choice % U64(SKETCH)).astype(np.int64)].astype(U64)
    return mixed(choice ^ ((token + U64(1)) * _STEP))


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, mark of the text, n_shingles, node (fingerprint of the set, null if empty), paths and sketch of every row."""
    fields = [
        StructField("n_shingles", LongType()),
        StructField("node", BinaryType()),
        StructField("paths", ArrayType(LongType())),
        StructField("sketch", BinaryType()),
    ]

    def sketch(column):
        out = [[], [], [], []]
        for text in texts(column):
            own = shingle_set(text, words)
            out[0].append(len(own))
            if not len(own):
                for x in out[1:]:
                    x.append(None)
                continue
            tokens = minwise(own)
            out[1].append(fingerprint(own))
            out[2].append(mixed(tokens[:TREES] + np.arange(TREES, dtype=U64)).view(np.int64).tolist())
            out[3].append((tokens[TREES:] >> U64(48)).astype(np.uint16).tobytes())
        return out

    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    return cut(map_arrow(rows, ["text"], fields, sketch, keep=["id", "name", "mark"]))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Name and mark that tell rows apart, unless id and text are the same; never null."""
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"),
        F.xxhash64(text_col).alias("mark"),
    ]


def matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 16-bit tokens."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SKETCH)


def branched(rows: DataFrame) -> DataFrame:
    """The next level of (path, node, before, sketch); each path has one branch, a quarter of them two."""

    def step(paths, sketches):
        path, sketch = paths.to_numpy().view(U64), matrix(sketches)
        one, two = child(path, sketch, 0), child(path, sketch, 1)
        both = mixed(path ^ _STEP) % U64(4) == 0
        return [[[a, b] if c else [a] for a, b, c in zip(one.view(np.int64), two.view(np.int64), both, strict=True)]]

    out = map_arrow(rows, ["path", "sketch"], [StructField("paths", ArrayType(LongType()))], step, keep=["node", "before"])
    return out.select(F.explode("paths").alias("path"), "node", "before")


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, node) of all nodes of the trees that are compared, each with at most about ``SMALL`` documents; and of the dense nodes."""
    rows = classes.select(F.explode("paths").alias("path"), "node", F.lit(None).cast("long").alias("before"))
    sketches = classes.select("node", "sketch")
    found, dense = [], []
    for level in itertools.count(1):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("before").alias("before"))
        counts = cut(counts.where("n > 1"))
        met = cut(rows.drop("before").join(counts, "path"))
        found.append(met.where(F.col("n") <= SMALL).select("path", "node"))
        dense.append(met.where((F.col("n") > DENSE) & (F.col("n") <= SMALL)).select("path", "node"))
        large = F.col("n") > SMALL
        if level >= DEPTH:
            shrunk = F.coalesce(F.col("n") <= SHRINK * F.col("before"), F.lit(True))
            further = large & (F.col("n") > WIDE) & shrunk
            ended = met.where(large & ~further)
            found += dealt(ended)
            dense.append(ended.select("path", "node"))
            large = further
        if counts.where(large).isEmpty():
            break
        goes = met.where(large).select("path", "node", F.col("n").alias("before"))
        rows = cut(branched(goes.join(sketches, "node"))).distinct()
    return together(found), together(dense)


def together(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables of the same columns."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def dealt(large: DataFrame) -> list[DataFrame]:
    """Nodes that stay large, in chunks of about ``SMALL`` documents; each chunk has the leaders of its node.

    This only joins most of a family early; the second round compares what is left apart in different chunks.
    """
    chunks = F.ceil(F.col("n") / F.lit(SMALL - LEADERS))
    inside = lambda chunk: F.xxhash64("path", chunk).alias("path")
    own = large.select(inside(F.pmod(F.xxhash64("node", "path"), chunks)), "node")
    order = Window.partitionBy("path").orderBy(F.xxhash64("node"), "node")
    first = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
    first = first.select("path", "node", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    return [own, first.select(inside(F.col("chunk")), "node")]


EDGE = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("alike", DoubleType())])


def spanning(same: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of the most alike, so that what hangs together in a node does so by its edges."""
    best, parent = np.zeros(len(same)), np.zeros(len(same), np.int64)
    left = np.ones(len(same), bool)
    edges = []
    for _ in range(len(same)):
        j = int(np.argmax(np.where(left, best, -1.0)))
        if best[j] > 0:
            edges.append((parent[j], j))
        left[j] = False
        closer = left & (same[j] > best)
        best[closer], parent[closer] = same[j][closer], j
    return np.array(edges, np.int64).reshape(-1, 2).T


def alike_pairs(sketches: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs of the rows of a node that look alike and whose sizes allow a link."""
    n = len(sketches)
    same = np.empty((n, n))
    for i in range(n):
        same[i] = (sketches == sketches[i]).mean(axis=1)
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    same[(same < ALIKE) | (100 * low < PERCENT * high)] = 0
    np.fill_diagonal(same, 0)
    if n <= DENSE:
        rows, cols = np.nonzero(np.triu(same))
    else:
        order = np.argsort(-same, axis=1, kind="stable")[:, :UNSURE]
        best = np.take_along_axis(same, order, axis=1)
        named = best > 0
        named[:, PARTNERS:] &= (best[:, PARTNERS - 1] < SURE)[:, None]
        rows, k = np.nonzero(named)
        cols = order[rows, k]
        pairs = np.column_stack((np.stack((rows, cols)), spanning(same)))
        rows, cols = np.unique(np.sort(pairs, axis=0), axis=1)
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        yield i, j, float(same[i, j])


def distinct_edges(found: DataFrame) -> DataFrame:
    """Edges (a, b, alike) with a < b, each once."""
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("alike").alias("alike"))


def candidates(classes: DataFrame, met: DataFrame) -> DataFrame:
    """Distinct edges (a, b, alike) of classes that look alike in some node (path, node) of some tree."""
    rows = met.join(classes.select("node", "sketch", "n_shingles"), "node")
    rows = rows.select("path", "node", "sketch", "n_shingles").repartition("path").sortWithinPartitions("path", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def edges_of(nodes, sketches, sizes, starts):
            out = ([], [], [])
            for s, e in zip(starts, starts[1:]):
                if e - s > 1:
                    for i, j, same in alike_pairs(sketches[s:e], sizes[s:e]):
                        if nodes[s + i] != nodes[s + j]:
                            out[0].append(nodes[s + i])
                            out[1].append(nodes[s + j])
                            out[2].append(same)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=EDGE.names)

        kinds = (pa.binary(), pa.binary(), pa.float64())
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            path = table["path"].to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path))
            whole = int(edges[-2]) if len(edges) > 1 else 0
            rest = table.slice(whole).combine_chunks().to_batches()[0] if whole < len(path) else None
            if whole:
                done = table.slice(0, whole).combine_chunks()
                yield edges_of(
                    done["node"].to_pylist(), matrix(done["sketch"].chunk(0)), done["n_shingles"].to_numpy(), edges[:-1].tolist()
                )
        if rest is not None:
            n = rest.num_rows
            yield edges_of(
                rest.column(1).to_pylist(), matrix(rest.column(2)), rest.column(3).to_numpy(), [0, n]
            )

    return distinct_edges(rows.mapInArrow(compare, EDGE))


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows with the same values."""
    n = len(columns[0])
    if not n:
        return []
    borders = functools.reduce(operator.or_, (c[1:] != c[:-1] for c in columns))
    edges = [0, *(np.flatnonzero(borders) + 1).tolist(), n]
    return list(itertools.pairwise(edges))


def cells_between(classes: DataFrame, dense: DataFrame, known: DataFrame) -> DataFrame:
    """(cell, kind, node, root): in a dense node, whoever is outside of the most frequent group (kind 0) meets all (kind 1), block by block.

    A block has at most about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles.
    """
    rows = dense.join(known.select("node", "root"), "node").join(classes.select("node", "n_shingles"), "node")
    tally = rows.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    most = F.max(F.struct("n", "root", "size"))
    plan = tally.groupBy("path").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), most.alias("most")).where("most.n < n")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    plan = plan.select(
        "path",
        F.col("most.root").alias("major"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("few"),
        blocks(F.col("n"), F.col("size")).alias("all"),
    )
    rows = cut(rows.drop("n_shingles").join(plan, "path"))

    def side(kind: int, here: DataFrame, own: str, others: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("node", "path"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("each")
        out = here.select("*", mine.alias("mine"), each)
        cell = F.xxhash64("path", *(("mine", "each") if kind == 0 else ("each", "mine")))
        return out.select(cell.alias("cell"), F.lit(kind).alias("kind"), "node", "root")

    return side(0, rows.where(F.col("root") != F.col("major")), "few", "all").unionByName(side(1, rows, "all", "few"))


MET = StructType([StructField("cell", LongType()), StructField("kind", IntegerType()), StructField("node", BinaryType()), StructField("root", BinaryType())])


def alike_in_cells(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (cell, kind, node, root) whose sketch looks like one of another group in their cell.

    A cell with more than ``FEW`` of them is named once instead, without a node.
    """
    rows = rows.join(classes.select("node", "sketch", "n_shingles"), "node")
    rows = rows.select("cell", "kind", "node", "root", "sketch", "n_shingles").repartition("cell").sortWithinPartitions("cell", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, found = None, [], {}

        def named():
            some = list(found.items()) if len(found) <= FEW else [((None, None), None)]
            return [(cell, kind, node, root) for (kind, node), root in some]

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, roots = (np.array(batch.column(k).to_pylist(), object) for k in (2, 3))
            sketches, sizes = matrix(batch.column(4)), batch.column(5).to_numpy()
            out = []
            for s, e in runs_of(cells, kinds):
                if cells[s] != cell:
                    out += named()
                    cell, asked, found = int(cells[s]), [], {}
                if kinds[s] == 0:
                    asked.extend(zip(nodes[s:e], roots[s:e], sketches[s:e], sizes[s:e], strict=True))
                    continue
                for node, root, sketch, size in asked:
                    if len(found) > FEW:
                        break
                    same = (sketches[s:e] == sketch).mean(axis=1)
                    low, high = np.minimum(sizes[s:e], size), np.maximum(sizes[s:e], size)
                    near = (same >= ALIKE) & (100 * low >= PERCENT * high)
                    near[near] = roots[s:e][near] != root
                    if near.any():
                        found[0, node] = root
                        found.update(((1, nodes[s + j]), roots[s + j]) for j in np.flatnonzero(near).tolist())
            yield pa.RecordBatch.from_pylist([dict(zip(MET.names, r, strict=True)) for r in out], schema=met)
        yield pa.RecordBatch.from_pylist([dict(zip(MET.names, r, strict=True)) for r in named()], schema=met)

    met = pa.schema([("cell", pa.int64()), ("kind", pa.int32()), ("node", pa.binary()), ("root", pa.binary())])
    return rows.mapInArrow(compare, MET)


def common_counts(few: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, by products of slices of their indicator matrices."""
    flat = np.concatenate([*few, *many])
    shingle, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(few) + len(many)), [len(x) for x in [*few, *many]])
    # a shingle counts only if both lists hold it
    both = np.zeros((2, len(shingle)), bool)
    both[(row >= len(few)).astype(int), column] = True
    number = np.cumsum(both.all(axis=0)) - 1
    kept = both.all(axis=0)[column]
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(few), len(many)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        first, last = np.searchsorted(column, [low, low + SLICE])
        part = np.zeros((len(few) + len(many), SLICE), np.float32)
        part[row[first:last], column[first:last] - low] = 1
        counts += (part[: len(few)] @ part[len(few) :].T).astype(np.int64)
    return counts


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of the given nodes, from the text of their class."""
    own = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    rows = own.join(nodes.join(classes.select("node", "name", "mark"), "node"), ["name", "mark"])

    def shingled(column, expected):
        sets = [shingle_set(t, words) for t in texts(column)]
        # rows that share name and mark but not the text are left out
        return [[x.tobytes() if fingerprint(x) == n else None for x, n in zip(sets, expected.to_pylist(), strict=True)]]

    made = map_arrow(rows, ["text", "node"], [StructField("shingles", BinaryType())], shingled, keep=["node"])
    return made.where("shingles IS NOT NULL").dropDuplicates(["node"])


LINK = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def linked_in_cells(rows: DataFrame) -> DataFrame:
    """Links (a, b) between groups that some pair of (cell, kind, node, root, shingles) confirms: a spanning forest per cell."""
    rows = rows.select("cell", "kind", "root", "shingles").repartition("cell").sortWithinPartitions("cell", "kind")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, above = None, [], {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            roots = batch.column(2).to_pylist()
            sets = [np.frombuffer(x, U64) for x in batch.column(3).to_pylist()]
            links = ([], [])
            for s, e in runs_of(cells, kinds):
                if cells[s] != cell:
                    cell, asked, above = cells[s], [], {}
                if kinds[s] == 0:
                    asked += zip(roots[s:e], sets[s:e], strict=True)
                    continue
                if not asked:
                    continue
                common = common_counts([x for _, x in asked], sets[s:e])
                sizes = np.add.outer([len(x) for _, x in asked], [len(x) for x in sets[s:e]])
                for i, j in zip(*np.nonzero(100 * common >= PERCENT * (sizes - common)), strict=True):
                    one, two = asked[i][0], roots[s + j]
                    if top(one) != top(two):
                        above[top(two)] = top(one)
                        links[0].append(one)
                        links[1].append(two)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], names=LINK.names)

    return rows.mapInArrow(confirm, LINK).distinct()


def between(classes: DataFrame, dense: DataFrame, known: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Links (a, b) between the groups (node, root) of classes that met in a dense node and that a first round has left apart.

    Cells that hold no pair alike by sketch end there. The others compare the full sets and name links only, so what is
    written grows with the documents also where very many of them are just below the threshold.
    """
    rows = cut(cells_between(classes, dense, known))
    met = cut(alike_in_cells(rows, classes))
    whole = met.where("node IS NULL").select("cell")
    asked = cut(met.where("node IS NOT NULL").unionByName(rows.join(whole, "cell", "left_semi")))
    sets = cut(sets_of(asked.select("node").distinct(), classes, docs, id_col, text_col, words))
    return linked_in_cells(asked.join(sets, "node"))


def in_cells(edges: DataFrame) -> DataFrame:
    """Edges with the cell in which they are confirmed: edges that hang together share cells of bounded size."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    label = ends.distinct().withColumn("label", F.col("node"))
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    for _ in range(2):
        known = label.select(F.col("node").alias("b"), "label")
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        label = cut(label.join(near, "node").select("node", F.least("label", "near").alias("label")))
    edges = edges.join(label.select(F.col("node").alias("a"), "label"), "a")
    edges = cut(edges)
    sizes = edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.join(label.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")), "label"))
    parts = F.ceil(F.col("n") / CELL_EDGES)
    # where most documents are alike, a text goes to a row of blocks and not along with each edge
    side = F.ceil(F.col("nodes") / CELL_NODES)
    block = F.xxhash64("label", F.pmod(F.xxhash64("a"), side), F.pmod(F.xxhash64("b"), side))
    crowded = (parts > 1) & (F.col("n") > CROWDED * F.col("nodes"))
    cell = F.when(crowded, block).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("a", "b"), parts))).alias("cell")
    return cut(edges.join(sizes, "label").select(cell, "a", "b", "alike", (parts == 1).alias("alone")))


def confirmed(edges: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Links (a, b) of a spanning forest of the edges of each cell that hold on the full sets.

    Documents that hang together in one cell only, and are still apart after its edges, are compared exhaustively.
    """
    edges = in_cells(edges)
    ends = edges.select("cell", F.col("a").alias("node")).unionByName(edges.select("cell", F.col("b").alias("node")))
    needs = ends.distinct()

    def squeeze(column):
        tool = zstandard.ZstdCompressor(level=3)
        return [[None if t is None else tool.compress(t) for t in texts(column)]]

    own = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    own = map_arrow(own, ["text"], [StructField("data", BinaryType())], squeeze, keep=["name", "mark"])
    wanted = needs.select("node").distinct().join(classes.select("node", "name", "mark"), "node")
    # rows that repeat a document all come; the fingerprint decides, below
    have = cut(own.join(wanted, ["name", "mark"]).select("node", "data"))
    none = F.lit(None).cast("binary")
    rows = needs.join(have, "node").select("cell", F.lit(0).alias("kind"), "node", "data", none.alias("b"), F.lit(0.0).alias("alike"), F.lit(False).alias("alone"))
    asked = edges.select("cell", F.lit(1).alias("kind"), F.col("a").alias("node"), none.alias("data"), "b", "alike", "alone")
    rows = rows.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "kind", F.desc("alike"), "node", "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        cell, sets, root, whole = None, {}, {}, False

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def linked(one, two, links):
            root[top(two)] = top(one)
            links[0].append(one)
            links[1].append(two)

        def rest(links):
            """Compare what an edge has not joined."""
            nodes = list(sets)
            if not whole or len({top(x) for x in nodes}) < 2:
                return
            sizes = np.array([len(sets[x]) for x in nodes])
            flat, starts = np.concatenate([sets[x] for x in nodes]), np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for k, node in enumerate(nodes):
                own = sets[node]
                far = np.array([top(x) != top(node) for x in nodes])
                if not far.any():
                    continue
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                for j in np.flatnonzero(far & (100 * common >= PERCENT * (len(own) + sizes - common))):
                    if top(nodes[j]) != top(node):
                        linked(node, nodes[j], links)

        for batch in batches:
            links = ([], [])
            for here, kind, node, data, b, _, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != cell:
                    rest(links)
                    cell, sets, root, whole = here, {}, {}, False
                if kind == 0:
                    own = shingle_set(tool.decompress(data), words)
                    if fingerprint(own) == node:
                        sets[node] = own
                    continue
                whole = alone
                if top(node) == top(b) or node not in sets or b not in sets:
                    continue
                x, y = sets[node], sets[b]
                common = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    linked(node, b, links)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], names=LINK.names)
        links = ([], [])
        rest(links)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], names=LINK.names)

    return rows.mapInArrow(confirm, LINK)


def rooted(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """The rows with the root of the component that the links (a, b) give to their key."""
    roots = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    roots = roots.select(F.col("id").alias(key), F.col("component").alias("root"))
    return rows.join(roots, key, "left").withColumn("root", F.coalesce("root", key))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, name, mark, n_shingles, node, component_id (least id of the group) and ``stays`` of every row.

    ``stays`` tells the row, or the equal rows, that stand for the group.
    """
    rows = sketched(docs, id_col, text_col, words)
    who = F.struct(F.col("id").isNull().alias("nameless"), "id", "name", "mark")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min(who).alias("who"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("paths").alias("paths"),
        F.first("sketch").alias("sketch"),
    )
    classes = cut(classes.select("node", "who", "who.name", "who.mark", "n_shingles", "paths", "sketch"))
    met, dense = leaves(classes)
    edges = cut(candidates(classes, met))
    links = cut(confirmed(edges, classes, docs, id_col, text_col, words))
    known = cut(rooted(classes.select("node", "who"), "node", links.select("a", "b")))
    if not dense.isEmpty():
        links = cut(between(classes, dense, known, docs, id_col, text_col, words))
        if not links.isEmpty():
            known = cut(rooted(known.withColumnRenamed("root", "old"), "old", links).drop("old"))
    least = cut(known.groupBy("root").agg(F.min("who").alias("least")))
    named = cut(known.join(least, "root").select("node", "least"))
    out = rows.drop("paths", "sketch").join(named, "node", "left")
    empty = F.col("node").isNull()
    return out.select(
        "id",
        "name",
        "mark",
        "n_shingles",
        "node",
        F.when(empty, F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        (empty | ((F.col("name") == F.col("least.name")) & (F.col("mark") == F.col("least.mark")))).alias("stays"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One document of each group, in its own columns: the one with the least id. Documents without words all stay."""
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    told = groups(docs, id_col, text_col, words)
    gone = cut(told.where(~F.col("stays")).select("name", "mark").distinct())
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    rows = rows.select("*", *row_key(named[id_col], named[text_col]))
    rest = rows.join(gone, ["name", "mark"], "left_anti")
    # of equal rows that stand for a group, one stays; they have met already
    blank = ~F.coalesce(F.rlike(F.col(named[text_col]), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    number = F.row_number().over(Window.partitionBy("name", "mark").orderBy(F.xxhash64(*named.values())))
    rest = rest.withColumn("number", number).where(blank | (F.col("number") == 1))
    return rest.select(*(F.col(n).alias(c) for c, n in named.items()))


def near_digest(docs: DataFrame, words: int = 4) -> DataFrame:
    """Digest per document: doc_id, n_shingles, component_id, kept."""
    out = groups(docs, words=words)
    same = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", same.alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM g JOIN comp ON doc_id = a
"""
