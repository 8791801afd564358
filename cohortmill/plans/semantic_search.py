"""From a query text to concepts, patients and their typed summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.operators import filters, summary


@dataclass
class SearchResult:
    """Frames of one search."""

    concepts: DataFrame
    hits: DataFrame
    typed_summary: DataFrame
    other_concepts: DataFrame


def query_concepts(query: str, ctx_concepts: DataFrame) -> DataFrame:
    """Concepts of a query: the ids written in it, else the positive ones whose label holds it."""
    from re import findall

    ids = findall(r"C\d{5,}", query)
    if ids:
        return ctx_concepts.where(F.col("cui").isin(*ids)).select("cui").distinct()
    found = filters.search_concepts(ctx_concepts, query)
    positive = found.where("negation = 'Affirmed' AND temporality = 'Recent' AND experiencer = 'Patient'")
    return positive.select("cui").distinct()


def semantic_search(
    query: str,
    mentions: DataFrame,
    docs: DataFrame,
    *,
    cohort: DataFrame | None = None,
    valid_docs: DataFrame | None = None,
) -> SearchResult:
    """Typed summary of the patients that mention a concept of the query."""
    ctx = summary.contexted_concepts(mentions)
    concepts = query_concepts(query, ctx)
    scope = docs if cohort is None else filters.cohort_filter(docs, cohort)
    rows = mentions if valid_docs is None else filters.only_docs(mentions, valid_docs)
    hits = filters.by_closure(rows, concepts)
    table = summary.typed_summary_ui(hits, scope)
    counts = summary.patient_concept_counts(mentions, scope)
    # both tables are read twice below: written, so that the joins behind them run once
    table = scale.cut(table)
    found = counts.join(table.select("pid"), "pid", "left_semi")
    others = summary.other_concept_scores(found, concepts, table.count())
    return SearchResult(concepts, hits, table, others)
