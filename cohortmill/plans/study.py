"""A whole study: rules, study table, samples and the log of rejected mentions."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.operators import joins, rules, summary, textmine, validation


@dataclass
class StudyResult:
    """Frames of one study run; all come from one table of verdicts."""

    verdicts: DataFrame
    matrix: DataFrame
    samples: DataFrame
    ruled: DataFrame


@dataclass(frozen=True)
class StudyOptions:
    """What a study narrows down besides its concepts.

    ``skip_terms`` take mentions out by their text, ``constraints`` are SQL conditions on the mentions. All of
    them must hold, together with the rules.
    """

    skip_terms: Sequence[str] = ()
    constraints: Sequence[str] = ()

    def accepts(self) -> Column:
        """Whether a mention passes the constraints."""
        ok = F.lit(True)
        for text in self.constraints:
            ok = ok & F.expr(text)
        return ok


def run_study(
    mentions: DataFrame,
    docs: DataFrame,
    closure: DataFrame,
    patients: DataFrame,
    *,
    names: Sequence[str],
    ruleset: rules.RuleSet | None = None,
    options: StudyOptions | None = None,
    search_terms: Mapping[str, Sequence[str]] | None = None,
    sample_size: int = 20,
    sample_window: int | None = None,
    count: str = "docs",
    seed: str = "0",
) -> StudyResult:
    """Judge the tagged mentions once, then count, sample and log.

    ``docs(doc_id, pid, text)`` needs the text only with a ``ruleset``, ``search_terms`` or a ``sample_window``; without a
    ruleset the mentions bring their own ``ruled_by``. ``search_terms`` adds a column of matching documents for each name.
    With ``sample_window`` samples carry so many characters of text on both sides and the offsets in it. Verdicts are
    written once and read by all three results.
    """
    options = options or StudyOptions()
    wanted = closure.select("cui").distinct()
    tagged = mentions.join(scale.bounded_broadcast(wanted), "cui", "left_semi").where(options.accepts())
    if ruleset is not None:
        both = dataclasses.replace(ruleset, skip_terms=[*ruleset.skip_terms, *options.skip_terms])
        judged = rules.rule_chain(tagged, docs, both)
    else:
        skipped = rules.skip_verdict(options.skip_terms, F.col("str"))["rule"]
        judged = tagged.withColumn("ruled_by", F.coalesce("ruled_by", skipped))
    verdicts = scale.cut(judged)
    kept = verdicts.where("ruled_by IS NULL")
    matrix = summary.study_table(kept, docs, closure, patients, names=names, count=count)
    for name, terms in (search_terms or {}).items():
        found = search_concept_docs(docs, terms).withColumnRenamed("n", name)
        matrix = matrix.join(found, "pid", "left").fillna(0, [name])
    named = joins.study_mentions(kept, closure)
    samples = validation.sample_per_group(
        named, "concept", k=sample_size, key=["doc_id", "start_pos", "end_pos", "cui"], seed=seed
    )
    if sample_window is not None:
        samples = with_evidence(samples, docs, sample_window)
    return StudyResult(verdicts, matrix, samples, summary.ruled_log(verdicts, docs))


def with_evidence(samples: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Samples with the text around them, the offsets in it, and where the document came from.

    Samples are few per group, so they, not the documents, are what is looked up with.
    """
    source = [c for c in ("src_table", "src_col") if c in docs.columns]
    rows = samples.join(docs.select("doc_id", "text", *source), "doc_id")
    first = F.greatest(F.col("start_pos") - window, F.lit(0))
    content = F.substring("text", first + 1, F.col("end_pos") - first + window)
    return rows.withColumns(
        {"content": content, "in_start": F.col("start_pos") - first, "in_end": F.col("end_pos") - first}
    ).drop("text")


def search_concept_docs(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``pid, n`` documents that hold any search term, for study concepts given by search terms."""
    return textmine.text_search(docs, any_of=terms).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
