"""Validation statistics on concepts, labels and phenotypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import context as cx
from cohortmill.operators.summary import spread

# fixed values: columns of the phenotype performance report
PERFORMANCE = ["posM", "hisM", "negM", "otherM", "wrongM"]


def concept_label_counts(labelled: DataFrame) -> DataFrame:
    """``cui, label, n`` of validated mentions."""
    return labelled.groupBy("cui", "label").agg(F.count("*").alias("n"))


def phenotype_rollup(phenotypes: DataFrame, counts: DataFrame) -> DataFrame:
    """``phenotype, label, n`` over the concepts of each phenotype: ``phenotypes(phenotype, cui)``."""
    pairs = phenotypes.select("phenotype", "cui").distinct()
    return pairs.join(counts, "cui", "left").groupBy("phenotype", "label").agg(F.sum("n").cast("long").alias("n"))


def phenotype_performance(phenotypes: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per phenotype with any validated mention and one column per report label."""
    rolled = phenotype_rollup(phenotypes, counts).where("label IS NOT NULL")
    return spread(rolled, "phenotype", "label", F.col("n"), PERFORMANCE)


def rule_breakdown(outcomes: DataFrame, *, headers: Sequence[str]) -> DataFrame:
    """Per concept the first outcome of each unique span, one column per header.

    ``outcomes(cui, doc_id, start_pos, end_pos, outcome, rank)``; the lowest rank is the first.
    """
    first = outcomes.groupBy("cui", "doc_id", "start_pos", "end_pos").agg(
        F.min(F.struct("rank", "outcome")).alias("o")
    )
    rows = first.select("cui", F.col("o.outcome").alias("outcome"))
    return spread(rows, "cui", "outcome", F.lit(1), headers)


def concept_frequency(parts: Sequence[DataFrame]) -> DataFrame:
    """Frequencies of several corpora added up: each ``(cui, freq)``."""
    rows = parts[0].select("cui", "freq")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("cui", "freq"))
    return rows.groupBy("cui").agg(F.sum("freq").cast("long").alias("freq"))


def phenotype_prevalence(phenotypes: DataFrame, freqs: DataFrame) -> DataFrame:
    """``phenotype, prevalence, n_concepts``."""
    pairs = phenotypes.select("phenotype", "cui").distinct()
    return pairs.join(freqs, "cui", "left").groupBy("phenotype").agg(
        F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("prevalence"), F.count("*").alias("n_concepts")
    )


def phenotype_detail(phenotypes: DataFrame, freqs: DataFrame, phenotype: str) -> DataFrame:
    """Frequency of every concept of one phenotype, zeros included."""
    own = phenotypes.where(F.col("phenotype") == phenotype).select("cui").distinct()
    return own.join(freqs, "cui", "left").select("cui", F.coalesce("freq", F.lit(0)).alias("freq"))


def patient_conditions(labelled: DataFrame, *, labels: Sequence[str] = ("posM", "hisM", "negM")) -> DataFrame:
    """Distinct ``pid, label, condition`` of the labels worth an index."""
    return labelled.where(F.col("label").isin(*labels)).select("pid", "label", "condition").distinct()


def condition_patients(labelled: DataFrame, *, labels: Sequence[str] = ("posM", "hisM")) -> DataFrame:
    """``condition, pid, n`` of the positive labels; flat, as a condition may hold most patients."""
    rows = labelled.where(F.col("label").isin(*labels))
    return rows.groupBy("condition", "pid").agg(F.count("*").alias("n"))


def label_ambiguity(cond: DataFrame, wrong: DataFrame) -> DataFrame:
    """Per concept and label: ambiguity and the label's share of the concept's two scores.

    ``cond(cui, label, num)`` and ``wrong(cui, label, num)``; a share is -1 where the concept's
    score leaves nothing to share.
    """
    both = cond.select("cui", "label", F.col("num").alias("cond")).join(
        wrong.select("cui", "label", F.col("num").alias("wrong")), ["cui", "label"], "full"
    )
    rows = both.fillna(0, ["cond", "wrong"]).withColumn("total", F.col("cond") + F.col("wrong"))
    per = rows.groupBy("cui").agg(F.sum("wrong").alias("cw"), F.sum("total").alias("ct"))
    joined = rows.join(per, "cui")
    score = F.col("wrong") / F.col("total")
    concept_score = F.col("cw") / F.col("ct")
    return joined.select(
        "cui",
        "label",
        "cond",
        "wrong",
        score.alias("ambiguity"),
        F.when(F.col("cw") == 0, -1.0)
        .otherwise(score * F.col("total") / F.col("ct") / concept_score)
        .alias("amb_share"),
        F.when(F.col("cw") == F.col("ct"), -1.0)
        .otherwise((1 - score) * F.col("total") / F.col("ct") / (1 - concept_score))
        .alias("cond_share"),
    )


def concept_ambiguity(labels: DataFrame, *, k: int = 2) -> DataFrame:
    """Per concept: weighted ambiguity and the variation beyond its k most used labels.

    Works on the small (concept, label) table of :func:`label_ambiguity`.
    """
    by_use = Window.partitionBy("cui").orderBy(F.desc("cond"), "label")
    ranked = labels.withColumn("rn", F.row_number().over(by_use))
    sums = ranked.groupBy("cui").agg(
        F.sum("wrong").alias("w"),
        F.sum("cond").alias("c"),
        F.sum(F.when(F.col("rn") <= k, F.col("cond")).otherwise(0)).alias("top"),
    )
    return sums.select(
        "cui",
        (F.col("w") / (F.col("w") + F.col("c"))).alias("ambiguity"),
        F.when(F.col("c") == 0, -1.0).otherwise(1 - F.col("top") / F.col("c")).alias("variation"),
    )


def validation_performance(samples: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of each feedback label in a term's samples, and how many have none.

    ``samples(term, doc_id, start_pos, end_pos)``, ``feedback(doc_id, start_pos, end_pos, label)``.
    """
    joined = samples.join(feedback.select("doc_id", "start_pos", "end_pos", "label"), ["doc_id", "start_pos", "end_pos"], "left")
    size = F.count("*")
    return joined.groupBy("term").agg(
        *[(F.count_if(F.col("label") == n) / size).alias(n) for n in cx.FEEDBACK_LABELS],
        F.count_if(F.coalesce(~F.col("label").isin(*cx.FEEDBACK_LABELS), F.lit(True))).alias("not_validated"),
    )


def study_catalog(studies: DataFrame) -> DataFrame:
    """Study concepts over all studies with the number of studies: ``studies(study, name, cui)``."""
    return studies.select("study", "name").distinct().groupBy("name").agg(F.count("*").alias("freq"))


def merged_concepts(studies: DataFrame) -> DataFrame:
    """All concepts of all studies, listed once per study concept that holds them."""
    return studies.select("name", "cui").distinct()


def sample_per_group(rows: DataFrame, group: str, *, k: int, key: Sequence[str], seed: str = "0") -> DataFrame:
    """k rows per group in the order of a seeded hash of the row key.

    The order does not depend on the partitions. Spark cuts each group to k rows on the map side
    before the exchange, so a group of any size is cheap.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    window = Window.partitionBy(group).orderBy("_h", *key)
    return (
        rows.withColumn("_h", order)
        .withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= k)
        .drop("_h", "_rn")
    )


def latest_document(docs: DataFrame, *, doc_type: str | None = None) -> DataFrame:
    """The latest document per patient, of one type if given; ties go to the larger id."""
    rows = docs if doc_type is None else docs.where(F.col("doc_type") == doc_type)
    newest = F.max(F.struct("doc_date", "doc_id"))
    return rows.groupBy("pid").agg(newest.alias("d")).select(
        "pid", F.col("d.doc_id").alias("doc_id"), F.col("d.doc_date").alias("doc_date")
    )


def first_evidence(rows: DataFrame) -> DataFrame:
    """First document per patient and concept by date, then id."""
    first = F.min(F.struct("doc_date", "doc_id"))
    return rows.groupBy("pid", "concept").agg(first.alias("d")).select(
        "pid", "concept", F.col("d.doc_id").alias("doc_id"), F.col("d.doc_date").alias("doc_date")
    )


def nearest_candidate(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate position nearest to the wanted one per key; ties to the smaller position.

    ``candidates(keys…, wanted, pos)``.
    """
    near = F.min(F.struct(F.abs(F.col("pos") - F.col("wanted")).alias("dist"), F.col("pos")))
    return candidates.groupBy(*keys).agg(near.alias("c")).select(
        *keys, F.col("c.pos").alias("pos"), F.col("c.dist").alias("dist")
    )


def page(rows: DataFrame, order: Sequence[str], *, offset: int = 0, size: int = 20) -> DataFrame:
    """One page of the sorted rows."""
    return rows.orderBy(*order).offset(offset).limit(size)


def numbered_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions numbered from 1 per document by position; safe for documents of any size."""
    order = [F.col(c) for c in ("start_pos", "end_pos", "cui")]
    return scale.numbered(mentions, "doc_id", order, F.floor(F.col("start_pos") / 10_000), "no")
