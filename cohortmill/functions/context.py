"""Context of a mention: negation, temporality and experiencer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: class names in the fixed column order of the reports
SUMMARY_TYPES = ["positive", "historical", "hypothetical", "Negated", "Other"]
UI_TYPES = ["posM", "hisM", "negM", "otherM"]
FEEDBACK_LABELS = ["posM", "hisM", "hypoM", "negM", "otherM", "wrongM"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ctx_id(cui="cui", negation="negation", experiencer="experiencer", temporality="temporality") -> Column:
    """Key of a contexted concept."""
    parts = [_col(c) for c in (cui, negation, experiencer, temporality)]
    return F.upper(F.md5(F.concat_ws("_", *parts)))


def name_id(name: str | Column) -> Column:
    """Entity id of a name."""
    return F.upper(F.md5(_col(name)))


def ctx_class(negation="negation", experiencer="experiencer", temporality="temporality") -> Column:
    """Five-way class; Other beats historical beats hypothetical beats Negated."""
    neg, exp, temp = _col(negation), _col(experiencer), _col(temporality)
    return (
        F.when(exp == "Other", "Other")
        .when(temp == "historical", "historical")
        .when(temp == "hypothetical", "hypothetical")
        .when(neg == "Negated", "Negated")
        .otherwise("positive")
    )


def ctx_class_ui(negation="negation", experiencer="experiencer", temporality="temporality") -> Column:
    """Four-way class; everything that is not recent counts as history."""
    neg, exp, temp = _col(negation), _col(experiencer), _col(temporality)
    return (
        F.when(exp != "Patient", "otherM")
        .when(temp != "Recent", "hisM")
        .when(neg == "Negated", "negM")
        .otherwise("posM")
    )


def positive(mode: str = "strict") -> Column:
    """strict: patient, recent and affirmed; lenient: affirmed and patient."""
    lenient = (F.lower("negation") == "affirmed") & (F.lower("experiencer") == "patient")
    if mode == "lenient":
        return lenient
    if mode == "strict":
        return lenient & (F.lower("temporality") == "recent")
    raise ValueError(f"unknown mode {mode!r}")


def context_label(ruled: Column, pref="pref", cui="cui") -> Column:
    """``Negated_historical_Other_ruled_pref(cui)`` with only the marks that apply."""
    return F.concat(
        F.when(F.col("negation") != "Affirmed", F.concat("negation", F.lit("_"))).otherwise(""),
        F.when(F.col("temporality") != "Recent", F.concat("temporality", F.lit("_"))).otherwise(""),
        F.when(F.col("experiencer") != "Patient", F.concat("experiencer", F.lit("_"))).otherwise(""),
        F.when(ruled, "ruled_").otherwise(""),
        _col(pref),
        F.lit("("),
        _col(cui),
        F.lit(")"),
    )


def simple_context(ruled_by: Column, positive_rule: str, negation_rule: str) -> Column:
    """Negation mark, overruled by the positive or the negation rule file."""
    return (
        F.when(F.array_contains(ruled_by, positive_rule), "")
        .when(F.array_contains(ruled_by, negation_rule), "Negated")
        .when(F.col("negation") != "Affirmed", F.col("negation"))
        .otherwise("")
    )


def simple_type(sty: str | Column = "sty") -> Column:
    """Semantic type as an entity type name."""
    return F.regexp_replace(_col(sty), "[ ,]", "_")


def mention_key(doc="doc_id", start="start_pos", end="end_pos") -> Column:
    """``d<doc>_s<start>_e<end>``"""
    return F.concat(
        F.lit("d"), _col(doc).cast("string"),
        F.lit("_s"), _col(start).cast("string"),
        F.lit("_e"), _col(end).cast("string"),
    )


def parse_mention_key(key: str | Column) -> Column:
    """Struct of doc, start and end from a mention key; nulls where it does not parse."""
    pattern = r"^d([^_]*)_s(\d+)_e(\d+)$"
    k = _col(key)
    ok = k.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(k, pattern, 1)).alias("doc"),
        F.when(ok, F.regexp_extract(k, pattern, 2).cast("int")).alias("start"),
        F.when(ok, F.regexp_extract(k, pattern, 3).cast("int")).alias("end"),
    )


def cell(value: Column, missing: str = "0") -> Column:
    """Text of a table cell."""
    return F.coalesce(value.cast("string"), F.lit(missing))
