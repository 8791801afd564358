"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources get a share of the budget by weight. A source whose share exceeds ``max_epochs`` times its
size is clamped there, and what is left is dealt again to the others by weight, until no share is too
large. Every document of a source is then taken a whole number of times; the rest of the target is
filled by one more repetition of the documents that come first in a seeded order, up to the one at
which the rest is reached.

The order is cut into buckets per source. Buckets that lie before the border count as a whole, by sums
that are combined on the map side; only the documents of the one border bucket per source are sorted.

Defined results: null texts have size 0, a null source is a source of its own (the last one). Sources
without words get target 0. Rows that repeat a document are documents of their own; as they are equal,
which of them is the last one taken makes no difference. Extra columns are not read. An empty table gives an
empty result. Only DataFrame functions run on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.scale import cut

#: Contract: weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of all sources.
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "5"
#: Places of the seeded order, and its buckets per source.
PLACES, BUCKETS = 1 << 48, 1 << 14


def size_of(text: Column) -> Column:
    """Number of words between ASCII blanks; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(doc_id: Column, seed: str = SEED) -> Column:
    """Place of a document in the seeded order, below ``PLACES``."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(mark, 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One slim row per document: id, source, size and its place in the seeded order."""
    return docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), seed).alias("place")
    )


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size, weight) by clamping and dealing again.

    Each round is one aggregate over the sources; at least one more source is clamped in each.
    """
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    total = budget * whole
    cap = max_epochs * F.col("source_size")
    level, clamped = 0.0, -1
    free = F.lit(True)
    while True:
        row = sources.agg(
            F.sum(F.when(free, 0).otherwise(F.col("source_size"))),
            F.sum(F.when(free, F.col("weight")).otherwise(0)),
            F.sum(F.when(free, 0).otherwise(1)),
        ).first()
        if row[2] is None or row[2] == clamped:
            break
        clamped = row[2]
        if not row[1]:
            break
        level = (total - max_epochs * row[0]) / row[1]
        free = F.col("weight") * F.lit(level) <= cap
    return sources.withColumn("target", F.when(free, F.col("weight") * F.lit(level)).otherwise(cap).cast("double"))


def targets_of(slim: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Targets by source; weights are dealt to the sources in code point order, null last."""
    sources = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    # one row per source, not per document
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return water_fill(cut(sources.withColumn("weight", weight)), budget, max_epochs)


def bucket_of(place: Column) -> Column:
    return F.floor(place / F.lit(PLACES // BUCKETS))


def aims_of(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: its target, whole epochs, what is left, and the bucket in which that is reached."""
    share = F.col("target") / F.col("source_size")
    aims = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(share)).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = slim.groupBy("source", bucket_of(F.col("place")).alias("bucket")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    borders = sums.join(aims, F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") >= F.col("rest"))
    )
    borders = borders.select(F.col("of").alias("at"), F.col("bucket").alias("border"), "ahead")
    return cut(aims.join(borders, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"))


def drawn(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, place and more) with ``repeats``: whole epochs and perhaps one more.

    Rows beside the border buckets are judged where they are; only those in a border bucket are moved.
    """
    rows = rows.withColumn("bucket", bucket_of(F.col("place")))
    docs = rows.join(aims, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    at_border = F.col("bucket") == F.col("border")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size")
    edge = (
        docs.where(at_border)
        .withColumn("past", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("more", F.col("ahead") + F.coalesce("past", F.lit(0)) + F.col("size") / 2 <= F.col("rest"))
        .drop("past")
    )
    calm = docs.where(~F.coalesce(at_border, F.lit(False))).withColumn(
        "more", F.coalesce(F.col("bucket") < F.col("border"), F.lit(False))
    )
    return calm.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("more").cast("long"))


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and repeats of every document."""
    slim = cut(sized(docs, seed))
    out = drawn(slim, aims_of(slim, targets_of(slim, weights, budget, max_epochs)))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats")


def resampled(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: the columns of the documents and ``epoch``, a row for each repetition from 1 on."""
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in named.items()),
        "doc_id",
        "source",
        size_of(F.col("text")).alias("size"),
        place_of(F.col("doc_id"), seed).alias("place"),
    )
    slim = cut(rows.select("doc_id", "source", "size", "place"))
    out = drawn(rows, aims_of(slim, targets_of(slim, weights, budget, max_epochs))).where("repeats > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return out.select(*(F.col(n).alias(c) for c, n in named.items() if c != "epoch"), "epoch")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Digest per document: doc_id, size, source_size, target, taken."""
    return mixed(docs, **options).select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * F.col("repeats")).alias("taken"),
    )


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(concat('5:', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 12)) AS BIGINT) AS place FROM documents),
src AS (SELECT source, sum(size) AS s FROM sized GROUP BY source),
wts AS (SELECT source, CAST(s AS BIGINT) AS s,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM src),
ranked AS (SELECT *, sum(s) OVER o AS s_done, sum(w) OVER () - sum(w) OVER o AS w_left, sum(s) OVER () AS all_s,
    row_number() OVER o AS k FROM wts WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT 0 AS k, 1.5 * any_value(all_s) / sum(w) AS level FROM ranked
    UNION ALL SELECT k, (1.5 * all_s - 2 * s_done) / nullif(w_left, 0) FROM ranked),
best AS (SELECT max(level) AS level FROM (SELECT l.k, l.level FROM lev l WHERE l.level IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM ranked r WHERE r.k > l.k AND r.w * l.level > 2 * r.s)) WHERE k = (SELECT min(l.k) FROM lev l
    WHERE l.level IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.k > l.k AND r.w * l.level > 2 * r.s))),
aims AS (SELECT source, s, CAST(CASE WHEN w * level <= 2 * s THEN w * level ELSE 2 * s END AS DOUBLE) AS target
    FROM wts, best),
epo AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS e FROM aims),
run AS (SELECT d.doc_id, d.size, a.s, a.target, a.e, a.target - a.e * a.s AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past,
    sum(d.size) OVER (PARTITION BY d.source, d.place // 17179869184) AS bucket_words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place // 17179869184
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS ahead
    FROM sized d JOIN epo a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, s AS source_size, round(target, 6) AS target,
    size * (e + CASE WHEN ahead < rest AND ahead + bucket_words >= rest THEN CAST(past + size / 2 <= rest AS BIGINT)
      ELSE CAST(ahead < rest AND ahead + bucket_words < rest AS BIGINT) END) AS taken FROM run
"""
