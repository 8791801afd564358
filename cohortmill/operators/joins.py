"""Joins between mentions, documents, patients and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.operators import rules


def attach_patient(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions with the patient of their document."""
    return scale.skew_join(mentions, docs.select("doc_id", "pid"), "doc_id")


def unmapped_docs(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of mentions that no patient is known for."""
    return mentions.select("doc_id").distinct().join(docs, "doc_id", "left_anti")


def tag_study_concepts(mentions: DataFrame, closure: DataFrame) -> DataFrame:
    """Mentions with the sorted names of all study concepts that hold their concept.

    The names are collected per concept, so every mention row is joined once.
    """
    names = closure.groupBy("cui").agg(F.sort_array(F.collect_set("name")).alias("study_concepts"))
    return mentions.join(scale.bounded_broadcast(names), "cui")


def study_mentions(mentions: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per mention and study concept."""
    pairs = closure.select("cui", F.col("name").alias("concept"))
    return mentions.join(scale.bounded_broadcast(pairs), "cui")


def apart(sections: Column) -> Column:
    """Whether each section of the array, by start, begins where the one before has ended, or behind."""
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.lit(True).alias("ok"))
    step = lambda acc, s: F.struct(
        s["end"].cast("long").alias("last"), (acc["ok"] & F.coalesce(s["start"] >= acc["last"], F.lit(True))).alias("ok")
    )
    return F.aggregate(sections, begin, step, lambda acc: acc["ok"])


def mentions_in_sections(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """Mentions with the section they start in, behind its header.

    ``sections(doc_id, section, header_end, start, end)``. A document has fewer sections than
    characters; they travel as one array per document. Where they do not overlap, as parsed ones never do, the one
    that holds a mention is found by halving.
    """
    item = F.struct("start", "end", "header_end", "section", "original_section")
    per_doc = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("_secs"))
    rows = scale.skew_join(mentions, scale.cut(per_doc.withColumn("_apart", apart(F.col("_secs")))), "doc_id")
    at = F.col("start_pos")
    holds = lambda s: (at >= s["header_end"]) & (at < s["end"])
    # the first that ends behind the start of the mention
    halved = F.get("_secs", rules.first_ending(F.col("_secs"), at + 1))
    one_by_one = F.get(F.filter("_secs", holds), F.lit(0))
    return (
        rows.withColumn("_sec", F.when(F.col("_apart"), halved).otherwise(one_by_one))
        .where(holds(F.col("_sec")))
        .withColumn("section", F.col("_sec.section"))
        .withColumn("sec_start", F.col("_sec.start"))
        .drop("_sec", "_secs", "_apart")
    )


def episode_windows(mentions: DataFrame, episodes: DataFrame, *, names: Sequence[str], days: int = 64) -> DataFrame:
    """Mention counts per episode, window and concept: ``episodes(ep_id, pid, <w>_s, <w>_e …)``.

    ``mentions(pid, doc_date, concept, n)`` is already counted by patient, day and concept, so a
    patient with very many mentions reaches the join as few rows. Both sides meet by patient and stretch of
    ``days`` days, so a patient with very many episodes spreads over many keys.
    """
    stacked = F.expr(
        f"stack({len(names)}, " + ", ".join(f"'{w}', {w}_s, {w}_e" for w in names) + ") AS (win, t0, t1)"
    )
    windows = episodes.select("ep_id", "pid", stacked)
    stretch = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    spread = windows.where("t0 <= t1").withColumn("_b", F.explode(F.sequence(stretch("t0"), stretch("t1"))))
    there = mentions.withColumn("_b", stretch("doc_date"))
    hits = spread.join(there, ["pid", "_b"]).where(F.col("doc_date").between(F.col("t0"), F.col("t1")))
    return hits.groupBy("ep_id", "pid", "win", "concept").agg(F.sum("n").alias("n"))


def feedback_details(feedback: DataFrame, anns: DataFrame, docs: DataFrame) -> DataFrame:
    """Feedback with the annotation at its start offset and the patient of its document.

    ``anns`` holds one row per (doc_id, start_pos).
    """
    return feedback.join(anns, ["doc_id", "start_pos"], "left").join(
        docs.select("doc_id", F.col("pid").alias("patient_id")), "doc_id", "left"
    )


def complete_samples(samples: DataFrame, anns: DataFrame) -> DataFrame:
    """Samples with surface text and confidence by document, span and concept."""
    keys = ["doc_id", "start_pos", "end_pos", "cui"]
    one = anns.groupBy(*keys).agg(F.min("str").alias("str"), F.max("confidence").alias("confidence"))
    return samples.join(one, keys, "left")


def verify_measurements(measures: DataFrame, labs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Correct and incorrect extracted values per measurement name.

    ``measures(pid, name, value)``, ``labs(pid, label, value)``, ``mapping(name, label)``. Only
    measures with any lab value of the mapped label are judged.
    """
    asked = measures.join(scale.bounded_broadcast(mapping), "name")
    values = labs.select("pid", "label", "value").distinct()
    known = values.select("pid", "label").distinct()
    judged = asked.join(known, ["pid", "label"], "left_semi").join(
        values.withColumn("found", F.lit(1)), ["pid", "label", "value"], "left"
    )
    return judged.groupBy("name").agg(
        F.count_if(F.col("found").isNotNull()).alias("correct"),
        F.count_if(F.col("found").isNull()).alias("incorrect"),
    )


def disease_model_match(patient_phenotypes: DataFrame, model: Sequence[tuple[str, str, str]], patients: DataFrame) -> DataFrame:
    """Every phenotype of the disease models with each patient's frequency, null if unmatched.

    ``patient_phenotypes(pid, id, freq)``; ``model`` is configuration, a list of (disease, id,
    label), and enters the plan as one literal array that is unfolded per patient.
    """
    entries = F.array(
        *[F.struct(F.lit(d).alias("disease"), F.lit(i).alias("id"), F.lit(t).alias("label")) for d, i, t in model]
    )
    asked = patients.select("pid", F.inline(entries))
    return asked.join(patient_phenotypes, ["pid", "id"], "left")


def matrix_by_any_concept(section_mentions: DataFrame, sets: DataFrame, patients: DataFrame, *, names: Sequence[str]) -> DataFrame:
    """0/1 per patient and concept set: any mention of the set's concepts.

    ``section_mentions(pid, cui)``, ``sets(name, cui)``.
    """
    present = section_mentions.select("pid", "cui").distinct()
    hits = present.join(scale.bounded_broadcast(sets.select("name", "cui").distinct()), "cui")
    flags = hits.groupBy("pid").agg(
        *[F.max((F.col("name") == n).cast("int")).alias(n) for n in names]
    )
    return patients.select("pid").join(flags, "pid", "left").fillna(0, list(names))
