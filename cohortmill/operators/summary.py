"""Patient level results: study tables, typed summaries and concept statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import context as cx
from cohortmill.operators import joins



def doc_concepts(mentions: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Mentions counted per document, concept and further columns.

    This is what enters the patient joins: a document with very many mentions shrinks to its
    distinct concepts on the map side.
    """
    return mentions.groupBy("doc_id", "cui", *by).agg(F.count("*").alias("n"))


def with_patient(counted: DataFrame, docs: DataFrame) -> DataFrame:
    """Counted rows with the patient of their document."""
    return counted.join(docs.select("doc_id", "pid"), "doc_id")


def spread(rows: DataFrame, key: str | Sequence[str], name: str, value: Column, names: Sequence[str]) -> DataFrame:
    """Wide table: one column per given name, summed; one aggregation, no pass for the names."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(name) == n, value).otherwise(0)).cast("long").alias(n) for n in names]
    )


def for_all_patients(patients: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every patient of the cohort, with zeros where the table has no row."""
    return patients.select("pid").join(table, "pid", "left").fillna(0, list(columns))


def patient_concept_matrix(mentions: DataFrame, docs: DataFrame, patients: DataFrame, labels: DataFrame, *, names: Sequence[str]) -> DataFrame:
    """Documents per patient and concept label, one column per label in sorted order."""
    pairs = doc_concepts(mentions).join(scale.bounded_broadcast(labels.select("cui", "label")), "cui")
    per_doc = pairs.select("doc_id", "label").distinct()
    wide = spread(with_patient(per_doc, docs), "pid", "label", F.lit(1), sorted(names))
    return for_all_patients(patients, wide, sorted(names))


def per_doc_concept(mentions: DataFrame, closure: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Named counts per document and study concept.

    A small closure is broadcast to the mentions, so untagged mentions go away in the scan stage
    and one exchange counts the rest. A large one meets mentions already counted by document and
    concept, so no hot document or concept reaches the join row by row.
    """
    aggs = [value.alias(name) for name, value in counts.items()]
    pairs = closure.select("cui", F.col("name").alias("concept"))
    if scale.is_small(pairs):
        return mentions.join(F.broadcast(pairs), "cui").groupBy("doc_id", "concept").agg(*aggs)
    counted = mentions.groupBy("doc_id", "cui").agg(*aggs)
    sums = [F.sum(name).alias(name) for name in counts]
    return counted.join(pairs, "cui").groupBy("doc_id", "concept").agg(*sums)


def study_rows(mentions: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pid, doc_id, concept, n``: mentions per document and study concept."""
    return with_patient(per_doc_concept(mentions, closure, {"n": F.count("*")}), docs)


def study_counts(mentions: DataFrame, docs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pid, concept, docs, mentions`` of the surviving mentions."""
    return study_rows(mentions, docs, closure).groupBy("pid", "concept").agg(
        F.count("*").alias("docs"), F.sum("n").alias("mentions")
    )


def study_table(
    mentions: DataFrame,
    docs: DataFrame,
    closure: DataFrame,
    patients: DataFrame,
    *,
    names: Sequence[str],
    count: str = "docs",
) -> DataFrame:
    """Wide study table of all patients: documents or mentions per study concept."""
    rows = study_rows(mentions, docs, closure)
    value = F.lit(1) if count == "docs" else F.col("n")
    return for_all_patients(patients, spread(rows, "pid", "concept", value, sorted(names)), sorted(names))


def closure_headers(closure: DataFrame) -> DataFrame:
    """``name, header`` with the closure size in the header."""
    sizes = closure.groupBy("name").agg(F.count_distinct("cui").alias("n"))
    return sizes.select("name", F.concat("name", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("header"))


def ruled_log(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per mention that a rule took out."""
    out = mentions.where("ruled_by IS NOT NULL")
    return joins.attach_patient(out, docs).select(
        "pid", "doc_id", "start_pos", "end_pos", "cui", "str", "ruled_by"
    )


def accepted_or_ruled(mentions: DataFrame, docs: DataFrame, closure: DataFrame, *, group: Column | None = None) -> DataFrame:
    """Accepted (``f``) and rejected (``rf``) counts and documents with an accepted mention.

    ``closure`` holds every concept once. ``group`` is a column of the documents.
    """
    ok = F.col("ruled_by").isNull() & cx.positive("lenient")
    per_doc = per_doc_concept(mentions, closure, {"f": F.count_if(ok), "rf": F.count_if(~ok)})
    grp = F.lit("") if group is None else group
    placed = per_doc.join(docs.select("doc_id", "pid", grp.alias("grp")), "doc_id")
    return placed.groupBy("grp", "pid", "concept").agg(
        F.sum("f").alias("f"), F.sum("rf").alias("rf"), F.count_if(F.col("f") > 0).alias("docs")
    )


def typed_summary(
    mentions: DataFrame,
    docs: DataFrame,
    closure: DataFrame | None = None,
    *,
    patients: DataFrame | None = None,
    predicate: Column | None = None,
    extra_aggs: Sequence[Column] = (),
) -> DataFrame:
    """Per patient ``all`` and the five context classes, and the number of documents.

    ``predicate`` may use document columns; ``extra_aggs`` are more aggregates over rows with
    ``type``, ``n`` and the document columns. With ``patients`` everybody appears, zeros included.
    """
    typed = mentions if closure is None else mentions.join(
        scale.bounded_broadcast(closure.select("cui").distinct()), "cui", "left_semi"
    )
    counted = typed.groupBy("doc_id", cx.ctx_class().alias("type")).agg(F.count("*").alias("n"))
    rows = counted.join(docs, "doc_id")
    if predicate is not None:
        rows = rows.where(predicate)
    sums = [F.sum("n").cast("long").alias("all")]
    sums += [F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0)).cast("long").alias(t) for t in cx.SUMMARY_TYPES]
    table = rows.groupBy("pid").agg(*sums, F.count_distinct("doc_id").alias("docs"), *extra_aggs)
    if patients is None:
        return table
    return for_all_patients(patients, table, ["all", *cx.SUMMARY_TYPES, "docs"])


def distinct_appearances(mentions: DataFrame) -> DataFrame:
    """One row per concept and span; a rule on any copy marks the appearance as ruled."""
    return mentions.groupBy("cui", "doc_id", "start_pos", "end_pos").agg(
        F.min(cx.ctx_class_ui()).alias("type"), F.max("ruled_by").alias("ruled_by")
    )


def typed_summary_ui(mentions: DataFrame, docs: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Per patient ``allM, posM, hisM, negM, otherM`` of appearances and how many were ruled."""
    typed = mentions if closure is None else mentions.join(
        scale.bounded_broadcast(closure.select("cui").distinct()), "cui", "left_semi"
    )
    free = F.col("ruled_by").isNull()
    per_doc = distinct_appearances(typed).groupBy("doc_id").agg(
        F.count("*").alias("allM"),
        *[F.count_if(free & (F.col("type") == t)).alias(t) for t in cx.UI_TYPES],
        F.count_if(~free).alias("ruled"),
    )
    return with_patient(per_doc, docs).groupBy("pid").agg(
        *[F.sum(c).cast("long").alias(c) for c in ["allM", *cx.UI_TYPES, "ruled"]]
    )


def patient_concept_counts(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """``pid, cui, freq``."""
    return with_patient(doc_concepts(mentions), docs).groupBy("pid", "cui").agg(
        F.sum("n").cast("long").alias("freq")
    )


def concept_labels(mentions: DataFrame) -> DataFrame:
    """One label per concept, the smallest."""
    return mentions.groupBy("cui").agg(F.min("pref").alias("pref"))


def bipartite_edges(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``pid, label, freq`` sorted by the lower-case label."""
    return counts.join(labels, "cui").select("pid", F.col("pref").alias("label"), "freq").orderBy(
        F.lower("label"), "label", "pid", "freq"
    )


def bipartite_topk(edges: DataFrame, *, left_k: int, right_k: int, ignore: Sequence[str] = (), rest: str = "others") -> DataFrame:
    """Edges of the right nodes of highest degree; all but the top left nodes become ``rest``.

    Ties go by name. Degrees count edges, as in the graph view.
    """
    # edges are counted once; the tops are bounded by their k
    edges = scale.cut(edges)
    free = edges if not ignore else edges.where(~F.col("label").isin(*ignore))
    right = free.groupBy("label").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "label").limit(right_k)
    kept = edges.join(F.broadcast(right.select("label")), "label", "left_semi")
    left = kept.groupBy("pid").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "pid").limit(left_k)
    marked = kept.join(F.broadcast(left.select("pid", F.lit(1).alias("top"))), "pid", "left")
    return marked.select(
        F.when(F.col("top").isNotNull(), F.col("pid").cast("string")).otherwise(rest).alias("pid"), "label", "freq"
    )


def semantic_type_histogram(mentions: DataFrame, mapped: DataFrame, *, bucket: str = "HPO") -> DataFrame:
    """``sty, cui, n``; concepts that map to the other vocabulary count again in its bucket."""
    own = mentions.groupBy("sty", "cui").agg(F.count("*").alias("n"))
    extra = own.join(mapped.select("cui").distinct(), "cui", "left_semi").groupBy("cui").agg(F.sum("n").alias("n"))
    return own.unionByName(extra.select(F.lit(bucket).alias("sty"), "cui", "n"))


def cohort_concept_list(histogram: DataFrame, sty: str, *, k: int = 20) -> DataFrame:
    """The k most frequent concepts of one semantic type."""
    return histogram.where(F.col("sty") == sty).orderBy(F.desc("n"), "cui").limit(k)


def other_concept_scores(counts: DataFrame, asked: DataFrame, n_patients: int | Column) -> DataFrame:
    """Frequency times log(patients / patients with the concept) of concepts not asked for."""
    total = F.lit(n_patients) if isinstance(n_patients, int) else n_patients
    others = counts.join(scale.bounded_broadcast(asked.select("cui").distinct()), "cui", "left_anti")
    per = others.groupBy("cui").agg(F.sum("freq").alias("freq"), F.count("*").alias("df"))
    return per.select("cui", "freq", "df", (F.col("freq") * F.log(total / F.col("df"))).alias("score"))


def contexted_concepts(mentions: DataFrame) -> DataFrame:
    """One row per contexted concept, with the smallest label and type."""
    keys = ["cui", "negation", "experiencer", "temporality"]
    return mentions.groupBy(*keys).agg(F.min("pref").alias("pref"), F.min("sty").alias("sty")).withColumn(
        "ctx_id", cx.ctx_id()
    )


def first_positive_time(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """First document date with a positive mention per patient."""
    positive = mentions.where(cx.ctx_class() == "positive").select("doc_id").distinct()
    return docs.join(positive, "doc_id", "left_semi").groupBy("pid").agg(F.min("doc_date").alias("first_pos"))


def merge_patient_results(patients: DataFrame, results: dict[str, DataFrame], *, missing: str = "-") -> DataFrame:
    """One row per patient and one text column per named result ``(pid, value)``."""
    parts = [
        df.select("pid", F.lit(name).alias("_r"), F.col("value").cast("string").alias("value"))
        for name, df in results.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    wide = rows.groupBy("pid").agg(*[F.max(F.when(F.col("_r") == n, F.col("value"))).alias(n) for n in results])
    return patients.select("pid").join(wide, "pid", "left").fillna(missing, list(results))


def build_patient_entities(
    mentions: DataFrame,
    docs: DataFrame,
    articles: DataFrame | None = None,
    *,
    part_rows: int = 50_000,
    part_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """Nested annotations and articles per patient, in parts of a bounded size.

    A patient with more than about ``part_rows`` rows or ``part_bytes`` of text gets several
    numbered parts, so no row and no task has to hold one whole patient of any size. All parts
    together are the entity.
    """
    rows = joins.attach_patient(mentions, docs).select(
        "pid",
        F.struct(
            "cui", "pref", "sty", "str", "start_pos", "end_pos", "negation", "temporality",
            "experiencer", "ruled_by", cx.ctx_id().alias("ctx_id"), "doc_id",
        ).alias("ann"),
        F.lit(None).cast("struct<doc_id:bigint,text:string>").alias("article"),
    )
    if articles is not None:
        arts = articles.select("pid", F.struct("doc_id", "text").alias("article"))
        rows = rows.unionByName(arts.withColumn("ann", F.lit(None)), allowMissingColumns=True)
    # counted by document before a patient is looked up
    per_doc = mentions.groupBy("doc_id").agg(F.count("*").alias("_n"))
    counted = joins.attach_patient(scale.cut(per_doc), docs).select("pid", "_n", F.lit(0).cast("long").alias("_bytes"))
    if articles is not None:
        text_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        counted = counted.unionByName(articles.select("pid", F.lit(1).cast("long").alias("_n"), text_bytes.alias("_bytes")))
    sizes = counted.groupBy("pid").agg(F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    parts = F.greatest(F.ceil(F.col("_n") / part_rows), F.ceil(F.col("_bytes") / part_bytes))
    # written, so that the join may split a patient with very many rows
    large = scale.cut(sizes.select("pid", parts.alias("_parts")).where("_parts > 1"))
    salt = F.pmod(F.xxhash64("ann", "article"), F.coalesce("_parts", F.lit(1)))
    return (
        scale.skew_join(rows, large, "pid", "left")
        .withColumn("part", salt)
        .groupBy("pid", "part")
        .agg(
            F.collect_list("ann").alias("anns"),
            F.collect_list("article").alias("articles"),
        )
    )


def doc_flags(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """All documents with a flag whether the search matched them."""
    hit = matched.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.join(hit, "doc_id", "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def doc_summary(docs: DataFrame, matched: DataFrame, *, summary_type: str) -> DataFrame:
    """Per patient: documents, matched documents and the latest document of the summary type."""
    latest = F.max(F.when(F.col("doc_type") == summary_type, F.struct("doc_date", "doc_id")))
    return (
        doc_flags(docs, matched)
        .groupBy("pid")
        .agg(F.count("*").alias("total_docs"), F.count_if("matched").alias("matched_docs"), latest.alias("_s"))
        .select("pid", "total_docs", "matched_docs", F.col("_s.doc_id").alias("summary_doc"))
    )


def feedback_agreement(mentions: DataFrame, docs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per patient and mention type: user labels that agree and that differ."""
    shown = mentions.select("doc_id", "start_pos", "end_pos", cx.ctx_class_ui().alias("type")).distinct()
    judged = shown.join(feedback, ["doc_id", "start_pos", "end_pos"])
    per_doc = judged.groupBy("doc_id", "type").agg(
        F.count_if(F.col("label") == F.col("type")).alias("correct"),
        F.count_if(F.col("label") != F.col("type")).alias("wrong"),
    )
    return with_patient(per_doc, docs).groupBy("pid", "type").agg(
        F.sum("correct").cast("long").alias("correct"), F.sum("wrong").cast("long").alias("wrong")
    )


def curated_concept_matrix(
    mentions: DataFrame, docs: DataFrame, patients: DataFrame, mapping: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Long curated matrix: ``pid, concept, curated, n_docs`` with all non-empty concepts.

    ``mapping(concept, cui)``, ``verdicts(concept, verdict)``.
    """
    pairs = doc_concepts(mentions).join(scale.bounded_broadcast(mapping.select("concept", "cui").distinct()), "cui")
    per_doc = pairs.select("doc_id", "concept").distinct()
    counts = with_patient(per_doc, docs).groupBy("pid", "concept").agg(F.count("*").alias("n_docs"))
    good = verdicts.where("verdict = 'correct'").select("concept").distinct().withColumn("curated", F.lit(1))
    judged = counts.join(scale.bounded_broadcast(good), "concept", "left").fillna(0, ["curated"])
    return judged.join(patients.select("pid"), "pid", "left_semi").select("pid", "concept", "curated", "n_docs")


def curated_totals(matrix: DataFrame, patients: DataFrame) -> DataFrame:
    """Patient attributes with the ``any`` total and the totals of both groups of concepts."""
    sums = matrix.groupBy("pid").agg(
        F.sum("n_docs").alias("any"),
        F.sum(F.when(F.col("curated") == 1, F.col("n_docs")).otherwise(0)).alias("curated"),
        F.sum(F.when(F.col("curated") == 0, F.col("n_docs")).otherwise(0)).alias("not_curated"),
    )
    return patients.join(sums, "pid", "left").fillna(0, ["any", "curated", "not_curated"])


def empty_concepts(mapping: DataFrame, mentions: DataFrame) -> DataFrame:
    """Concept names without a single mention."""
    seen = mentions.select("cui").distinct()
    found = mapping.join(seen, "cui", "left_semi").select("concept").distinct()
    return mapping.select("concept").distinct().join(found, "concept", "left_anti")


def weighted_typed_features(scored: DataFrame, *, threshold: float = 0.7, mode: str = "threshold") -> DataFrame:
    """Typed mention counts per patient at a confidence, or the summed confidences.

    ``scored(pid, type, confidence)``.
    """
    def value(t: str) -> Column:
        is_t = F.col("type") == t
        if mode == "threshold":
            return F.count_if(is_t & (F.col("confidence") >= threshold)).cast("double")
        return F.sum(F.when(is_t, F.col("confidence")).otherwise(0.0))

    table = scored.groupBy("pid").agg(*[value(t).alias(t) for t in cx.UI_TYPES])
    total = F.col(cx.UI_TYPES[0])
    for t in cx.UI_TYPES[1:]:
        total = total + F.col(t)
    return table.withColumn("total", total)
