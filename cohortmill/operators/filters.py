"""Row filters on mentions and documents. Big value sets are joins, never long IN lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import context as cx
from cohortmill.functions import text as tx


def skip_terms(mentions: DataFrame, terms: DataFrame, *, case_sensitive: bool = False) -> DataFrame:
    """Mentions whose surface text is not listed in ``terms(term)``."""
    if case_sensitive:
        listed, shown = terms.select(F.col("term").alias("_t")), F.col("str")
    else:
        listed, shown = terms.select(F.lower("term").alias("_t")), F.lower("str")
    return mentions.join(scale.bounded_broadcast(listed.distinct()), shown == F.col("_t"), "left_anti")


def by_semantic_type(mentions: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Affirmed patient mentions that no rule took out, of the given types (None: any type)."""
    kept = mentions.where(cx.positive("lenient") & F.col("ruled_by").isNull())
    return kept if types is None else kept.where(F.col("sty").isin(*types))


def by_closure(mentions: DataFrame, closure: DataFrame) -> DataFrame:
    """Mentions of any concept in the closure."""
    return mentions.join(scale.bounded_broadcast(closure.select("cui").distinct()), "cui", "left_semi")


def document_field_filter(docs: DataFrame, excluded: Mapping[str, Sequence[str]]) -> DataFrame:
    """Documents without any of the excluded field values; a missing value is kept."""
    keep = F.lit(True)
    for name, values in excluded.items():
        keep = keep & F.coalesce(~F.col(name).isin(*values), F.lit(True))
    return docs.where(keep)


def within_patient_window(docs: DataFrame, windows: DataFrame, *, on_missing: str = "drop") -> DataFrame:
    """Documents dated in their patient's window, both ends included.

    A patient without a window keeps all documents. ``on_missing`` says what happens to a
    document without a date.
    """
    missing = F.lit(on_missing == "keep")
    inside = F.coalesce(F.col("doc_date").between(F.col("t0"), F.col("t1")), missing)
    joined = docs.join(windows, "pid", "left")
    return joined.where(F.col("t0").isNull() | inside).drop("t0", "t1")


def within_relative_window(
    docs: DataFrame, index_dates: DataFrame, *, days_before: int = 365, days_after: int = 7, on_missing: str = "keep"
) -> DataFrame:
    """Documents dated around the patient's index date, both ends included."""
    low = F.col("index_date") - F.make_dt_interval(F.lit(days_before))
    high = F.col("index_date") + F.make_dt_interval(F.lit(days_after))
    inside = F.coalesce(F.col("doc_date").between(low, high), F.lit(on_missing == "keep"))
    return docs.join(index_dates, "pid", "left").where(inside).drop("index_date")


def only_docs(mentions: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Mentions of the listed documents."""
    return scale.skew_join(mentions, scale.cut(doc_ids.select("doc_id").distinct()), "doc_id", "left_semi")


def cohort_filter(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of the listed patients."""
    return rows.join(cohort.select("pid").distinct(), "pid", "left_semi")


def route_by_pattern(key: str | Column, routes: Sequence[tuple[str, str]]) -> Column:
    """Target of the first pattern that matches the key from its start."""
    value = F.col(key) if isinstance(key, str) else key
    tests = [F.when(value.rlike(rf"\A(?:{pattern})"), target) for pattern, target in routes]
    return F.coalesce(*tests)


def retain_concepts(closure: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named study concepts."""
    return closure.where(F.col("name").isin(*names))


def remove_concept(closure: DataFrame, name: str) -> DataFrame:
    """All but one study concept."""
    return closure.where(F.col("name") != name)


def skip_if_processed(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the output does not hold yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def search_concepts(ctx_concepts: DataFrame, term: str, *, sty: str | None = None) -> DataFrame:
    """Contexted concepts whose label holds the word, of one semantic type if given."""
    words = F.regexp_extract_all(F.lower("pref"), F.lit(tx.WORD), F.lit(0))
    found = ctx_concepts.where(F.array_contains(words, term.lower()))
    return found if sty is None else found.where(F.col("sty") == sty)
