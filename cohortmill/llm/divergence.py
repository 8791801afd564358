"""Source divergence audit: chi-squared like distances between the word prices of sources, over a quadtree of the counts.

A group is a source within a language. Each language keeps the terms of at least ``MIN_DOCS`` of its documents. A group gives a term
the price ``1 + floor(SCALE * (count + 1) / (total + kept terms))``; the divergence of a price p from q is ``floor((p - q) ** 2 / q)``.

The matrix of counts (groups by terms) is almost empty. For two groups g and h with prices ``g0`` and ``h0`` of a count of zero, the
divergences of all terms sum up to

* ``V * d(g0, h0)``, as if all quadrants were zero,
* for each count c of g its number of terms times ``d(g(c), h0) - d(g0, h0)``, as if h were zero there, and the same for h,
* for terms that both hold, ``d(g, h) - d(g, h0) - d(g0, h) + d(g0, h0)``.

The first two come from one row per group, and per group and count: uniform quadrants are priced without a look at their terms. For the third,
the matrix is dealt into tiles by hashes of term and source, ``SIDE`` by ``SIDE`` each in the mean, and every tile is a K-squared tree: one bit for each of the
four quadrants of a node, nothing below a zero bit. The trees of two blocks of groups are walked jointly from the root, on to pairs of
quadrants over the same terms that are both not zero, down to pairs of counts. All sums are exact integers.

Defined results: null text, language and source are empty strings; a group without any kept term has a total of zero and prices of its own; a
language without kept terms has pairs of value 0 and no terms; repeated rows are documents of their own; extra columns are not read; an
empty table gives no rows. The pairs of a language are all asked for, so their number is the square of its sources.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.common import only, texts
from cohortmill.scale import bounded_broadcast, cut

#: Documents that a kept term has at least, the price of everything, and the ranks of terms that are reported.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Groups and terms of a tile in the mean, and pairs of nodes that are walked at once.
SIDE, FRONTIER = 512, 1 << 19
#: Different (language, source, term) counts that a task gathers before it hands them on.
GATHERED = 200_000

#: Letters stay, A-Z in lower case, bytes of other scripts stay, all else parts terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term; a row without term for each group."""
    seen: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in seen.items():
            words = [None, *found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([source] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array([0, *(v[0] for v in found.values())], pa.int64()),
                    pa.array([0, *(v[1] for v in found.values())], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        seen.clear()

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, texts(batch.column("text")), strict=True):
            found = seen.setdefault((lang or "", source or ""), {})
            size -= len(found)
            own: dict[bytes, int] = {}
            for t in terms_of(text or b""):
                own[t] = own.get(t, 0) + 1
            for t, n in own.items():
                if t in found:
                    both = found[t]
                    both[0] += n
                    both[1] += 1
                else:
                    found[t] = [n, 1]
            size += len(found)
            if size > GATHERED:
                yield from flush()
                size = 0
    yield from flush()


def counted(docs: DataFrame) -> DataFrame:
    """``COUNTS`` of all documents, not yet summed up over tasks."""
    return only(docs, "lang", "source", "text").mapInArrow(_counted, COUNTS)


def price(n: Column, total: Column) -> Column:
    """Price of a count; ``total`` is the sum of counts and kept terms. Divided in steps, so that no product leaves 64 bits."""
    over, rest = F.expr("0L"), n + 1
    whole = F.call_function("div", rest, total)
    rest = rest % total
    over = whole
    for _ in range(3):
        over = over * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return over + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Written tables of one audit: cells (counts of kept terms by group) and groups (their sums)."""

    def __init__(self, docs: DataFrame):
        by_term = counted(docs).repartition("lang", "term")
        sums = by_term.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # the rows of a term, one per source, are together already
        term = Window.partitionBy("lang", "term")
        sums = sums.withColumns(
            {
                "in_docs": F.sum("docs").over(term),
                "lang_n": F.sum("n").over(term),
                "nth": F.row_number().over(term.orderBy("source")),
            }
        )
        cells = cut(sums.where(F.col("term").isNull() | (F.col("in_docs") >= MIN_DOCS)).drop("docs", "in_docs"))
        self.cells = cells.where(F.col("term").isNotNull())
        group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        lang = cells.groupBy("lang").agg(
            F.sum("n").alias("lang_total"),
            F.count(F.when((F.col("nth") == 1) & F.col("term").isNotNull(), 1)).alias("kept"),
        )
        sizes = group.join(lang, "lang").withColumn("zero", price(F.lit(0), F.greatest(F.col("total") + F.col("kept"), F.lit(1))))
        self.groups = cut(sizes)

    def _sized(self, *columns: str) -> DataFrame:
        """Cells with columns of their group."""
        return self.cells.join(bounded_broadcast(self.groups.select("lang", "source", *columns)), ["lang", "source"])

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, term, value: the terms a group has above its language, at most ``top`` by value."""
        priced = self._sized("total", "lang_total", "kept").select(
            "lang", "source", "term",
            price(F.col("n"), F.col("total") + F.col("kept")).alias("p"),
            price(F.col("lang_n"), F.col("lang_total") + F.col("kept")).alias("q"),
        )
        rows = priced.where("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return rows.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "source", "term", "value", "rank")

    def pairs(self, side: int = SIDE) -> DataFrame:
        """lang, source, other, value: the divergence of every group from each other one of its language."""
        zero = self.groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
        base = (
            self.groups.join(bounded_broadcast(zero), "lang").where("source <> other")
            .select("lang", "source", "other", (F.col("kept") * divergence(F.col("zero"), F.col("other_zero"))).alias("value"))
        )
        return (
            base.unionByName(self._one_sided(zero)).unionByName(self._joint(side))
            .groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        )

    def _one_sided(self, zero: DataFrame) -> DataFrame:
        """What the counts of one group change against another one that is zero everywhere, both ways."""
        counts = self.cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
        own = counts.join(bounded_broadcast(self.groups.select("lang", "source", "total", "kept", "zero")), ["lang", "source"])
        own = own.withColumn("p", price(F.col("n"), F.col("total") + F.col("kept"))).select("lang", "source", "terms", "p", "zero")
        met = own.join(bounded_broadcast(zero), "lang").where("source <> other")
        p, mine, other = F.col("p"), F.col("zero"), F.col("other_zero")
        sums = met.groupBy("lang", "source", "other").agg(
            F.sum(F.col("terms") * (divergence(p, other) - divergence(mine, other))).alias("forth"),
            F.sum(F.col("terms") * (divergence(other, p) - divergence(other, mine))).alias("back"),
        )
        sums = sums.select(
            "lang",
            F.explode(F.array(F.struct("source", "other", F.col("forth").alias("value")),
                              F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))).alias("x"),
        )
        return sums.select("lang", "x.source", "x.other", "x.value")

    def _joint(self, side: int) -> DataFrame:
        """What the terms that two groups share change, from the trees of all tiles."""
        sizes = self.groups.groupBy("lang").agg(
            F.ceil(F.count(F.lit(1)) / side).alias("rows"), F.greatest(F.ceil(F.max("kept") / side), F.lit(1)).alias("bands")
        )
        groups = self.groups.join(sizes, "lang").select("lang", "source", (F.col("total") + F.col("kept")).alias("total"), "rows", "bands")
        tiles = self.cells.join(bounded_broadcast(groups), ["lang", "source"]).select(
            "lang", "source", "term", "n", "total",
            F.pmod(F.xxhash64("term"), F.col("bands")).alias("band"),
            F.pmod(F.xxhash64("source"), F.col("rows")).alias("block"),
            # the tile stands in the pair of its block with each block
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("with"),
        )
        tiles = tiles.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
        found = tiles.groupBy("lang", "band", "low", "high").applyInArrow(_walked, "lang string, source string, other string, value bigint")
        return found


class QuadTree:
    """K-squared tree over the cells of a square of ``2 ** depth`` rows and columns: four bits a node, nothing below a zero."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, depth: int):
        """Cells are kept in the order of their quadrants; ``order`` brings values of the given cells into it."""
        code = np.zeros(len(rows), np.int64)
        for k in range(depth):
            code |= ((rows >> k & 1) << (2 * k + 1)) | ((columns >> k & 1) << (2 * k))
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        self.depth = depth
        #: By level, the number of the child in each quadrant of each node, -1 where the quadrant is all zero.
        self.children: list[np.ndarray] = []
        above = np.zeros(min(1, len(code)), np.int64)
        for level in range(1, depth + 1):
            own = code >> (2 * (depth - level))
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            nodes = own[first]
            links = np.full((len(above), 4), -1, np.int64)
            links[np.searchsorted(above, nodes >> 2), nodes & 3] = np.arange(len(nodes))
            self.children.append(links)
            above = nodes

    def shared(self, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of cells of one column in two rows, the smaller row first, in places of the kept order.

        The walk holds pairs of nodes over the same columns, at most some ``frontier`` of them on each level.
        """
        todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if level == self.depth:
                other = a != b
                yield a[other], b[other]
                continue
            left, right = self.children[level][a], self.children[level][b]
            next_a, next_b = [], []
            same = a == b
            for upper in (0, 1):
                for lower in (0, 1):
                    for column in (0, 1):
                        x, y = left[:, 2 * upper + column], right[:, 2 * lower + column]
                        # within one node the pair of halves comes once
                        both = (x >= 0) & (y >= 0) & ~(same & (upper > lower))
                        next_a.append(x[both])
                        next_b.append(y[both])
            x, y = np.concatenate(next_a), np.concatenate(next_b)
            for low in range(0, len(x), frontier):
                todo.append((level + 1, x[low : low + frontier], y[low : low + frontier]))


def prices(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """:func:`price` of arrays."""
    rest = n + 1
    over = rest // total
    rest = rest % total
    for _ in range(3):
        over = over * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return over + 1


def corrections(g: np.ndarray, h: np.ndarray, g0: np.ndarray, h0: np.ndarray) -> np.ndarray:
    """What a term with prices g and h adds to the sums that take one of both as zero."""
    d = lambda p, q: (p - q) * (p - q) // q
    return d(g, h) - d(g, h0) - d(g0, h) + d(g0, h0)


def _walked(tile: pa.Table) -> pa.Table:
    """Corrections by pair of groups in one tile: both ways, of terms that both groups hold."""
    lang = tile.column("lang")[0].as_py()
    across = tile.column("low")[0].as_py() != tile.column("high")[0].as_py()
    sources = tile.column("source").combine_chunks().dictionary_encode()
    names = sources.dictionary.to_pylist()
    rows = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    columns = tile.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.zeros(len(names), np.int64)
    block[rows] = tile.column("block").to_numpy()
    totals = np.ones(len(names), np.int64)
    totals[rows] = tile.column("total").to_numpy()
    zeros = prices(np.zeros(len(names), np.int64), totals)
    depth = max(1, int(max(rows.max(), columns.max())).bit_length())
    tree = QuadTree(rows, columns, depth)
    rows = rows[tree.order]
    own = prices(tile.column("n").to_numpy()[tree.order], totals[rows])
    size = len(names)
    pairs, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in tree.shared():
        x, y = rows[a], rows[b]
        if across:
            crossing = block[x] != block[y]
            a, b, x, y = a[crossing], b[crossing], x[crossing], y[crossing]
        for one, two, i, k in ((a, b, x, y), (b, a, y, x)):
            _add(pairs, values, i * size + k, corrections(own[one], own[two], zeros[i], zeros[k]))
    _fold(pairs, values)
    return pa.table(
        {
            "lang": pa.array([lang] * len(pairs[0]), pa.string()),
            "source": pa.array([names[k] for k in (pairs[0] // size).tolist()], pa.string()),
            "other": pa.array([names[k] for k in (pairs[0] % size).tolist()], pa.string()),
            "value": pa.array(values[0], pa.int64()),
        }
    )


def _add(pairs: list[np.ndarray], values: list[np.ndarray], key: np.ndarray, value: np.ndarray) -> None:
    pairs.append(key)
    values.append(value)
    if sum(map(len, pairs)) > 4 * FRONTIER:
        _fold(pairs, values)


def _fold(pairs: list[np.ndarray], values: list[np.ndarray]) -> None:
    """Sum up the values of equal pairs."""
    key, place = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, place, np.concatenate(values))
    pairs[:], values[:] = [key], [sums]


def audit(docs: DataFrame, parts: Sequence[str] = ("pair", "term"), top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of the asked parts."""
    tables = Audit(docs)
    out = []
    if "pair" in parts:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
        pairs = cut(tables.pairs()).withColumn("rank", F.row_number().over(order))
        out.append(pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank"))
    if "term" in parts:
        terms = tables.terms(top)
        out.append(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.withColumns({"value": F.col("value").cast("long"), "rank": F.col("rank").cast("int")})


SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS MATERIALIZED (SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(ws) AS term FROM t) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY lang, term HAVING count(*) >= 3),
vs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM t),
cells AS MATERIALIZED (SELECT u.lang, u.source, u.term, CAST(sum(u.n) AS BIGINT) AS n FROM u JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM grp g LEFT JOIN cells c USING (lang, source) GROUP BY ALL),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.total + v.v) AS q
    FROM totals g JOIN kept k USING (lang) JOIN vs v USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
ranked AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS r FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, CAST(r AS INT) FROM ranked WHERE r <= 200
"""
