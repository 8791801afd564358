"""Incremental jobs over the event stream."""

from __future__ import annotations

import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog.base import query
from cohortmill.catalog.notes import CHAIN, RULES
from cohortmill.functions import context as cx
from cohortmill.operators import rules
from cohortmill.sources.tables import Tables
from cohortmill.streaming import incremental
from cohortmill.streaming.processing import Processing
from cohortmill.streaming.store import KeyedStore


BATCHES = 6


def event_stream(t: Tables):
    """The events as a stream of annotations that comes in several batches, one file each."""
    folder = scale.job_folder(t.spark, "events")
    t.raw("events").repartition(BATCHES, "event_id").write.parquet(folder)
    raw = incremental.read_new(t.spark, folder, t.raw("events").schema, files_per_batch=1)
    rows = raw.select(
        "event_id", F.col("user_id").alias("pid"), F.col("event_type").alias("concept"), "ts",
        F.floor("value").cast("long").alias("value"),
    )
    return incremental.event_annotations(rows)


def folders(t: Tables, name: str) -> tuple[str, str]:
    base = scale.job_folder(t.spark, name)
    return f"{base}/sink", f"{base}/checkpoint"


@query(
    "incremental_batch", "ST1 N16",
    "SELECT event_id, pid, concept, value FROM evs WHERE ts > TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20'",
)
def incremental_batch(t: Tables):
    rows = incremental.rows_between(t.events, "ts", datetime.datetime(2024, 1, 8), datetime.datetime(2024, 1, 20))
    return rows.select("event_id", "pid", "concept", "value")


@query("incremental_docs", "ST1 N16", "SELECT event_id, pid, concept, value FROM evs")
def incremental_docs(t: Tables):
    sink, checkpoint = folders(t, "docs")
    stream = event_stream(t)
    incremental.incremental_docs(stream, sink, checkpoint)
    # a second run finds nothing new
    incremental.incremental_docs(stream, sink, checkpoint)
    return t.spark.read.parquet(sink).select("event_id", "pid", "concept", "value")


@query("stream_ctx_concepts", "ST2", "SELECT DISTINCT ctx_id, concept, negation FROM evs")
def stream_ctx_concepts(t: Tables):
    sink, checkpoint = folders(t, "concepts")
    stream = event_stream(t).select("ctx_id", "concept", "negation")
    incremental.stream_ctx_concepts(stream, sink, checkpoint)
    return t.spark.read.parquet(sink).select("ctx_id", "concept", "negation")


def event_summary(rows):
    """Per patient: annotations, affirmed ones and distinct contexted concepts."""
    counted = rows.groupBy("pid", "ctx_id", "negation").agg(F.count("*").alias("n"))
    return counted.groupBy("pid").agg(
        F.sum("n").alias("anns"),
        F.sum(F.when(F.col("negation") == "Affirmed", F.col("n")).otherwise(0)).alias("affirmed"),
        F.count("*").alias("concepts"),
    )


@query(
    "stream_patient_refresh", "ST3",
    """SELECT pid, CAST(count(*) AS BIGINT) AS anns, CAST(count(*) FILTER (WHERE negation = 'Affirmed') AS BIGINT) AS affirmed,
       CAST(count(DISTINCT ctx_id) AS BIGINT) AS concepts FROM evs GROUP BY pid""",
)
def stream_patient_refresh(t: Tables):
    sink, checkpoint = folders(t, "patients")
    stream = event_stream(t)
    store = KeyedStore(t.spark, scale.job_folder(t.spark, "annotations"), stream.schema, "pid")
    incremental.stream_patient_refresh(stream, store, sink, checkpoint, event_summary)
    return incremental.latest_per_key(t.spark.read.parquet(sink), ["pid"])


ANNOTATIONS = "doc_id long, pid string, cui string, start_pos long, ruled_by string"


def annotation_summary(rows):
    """Per patient: annotations, those that no rule took out, concepts and documents."""
    per_doc = rows.groupBy("pid", "doc_id", "cui").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled_by").isNull(), 1)).alias("kept"))
    return per_doc.groupBy("pid").agg(
        F.sum("n").alias("anns"), F.sum("kept").alias("kept"), F.countDistinct("cui").alias("concepts"), F.countDistinct("doc_id").alias("docs")
    )


def new_documents(t: Tables, before_log=None) -> Processing:
    """Documents tagged, judged by the rules and summed up by patient."""
    return Processing(
        path=scale.job_folder(t.spark, "processing"),
        annotate=t.tag,
        judge=lambda mentions, docs: rules.rule_chain(mentions, docs, RULES),
        summarise=annotation_summary,
        schema=t.config([], ANNOTATIONS).schema,
        before_log=before_log,
    )


SUMMARY = f"""WITH ruled AS ({CHAIN}) SELECT d.source AS pid, CAST(count(*) AS BIGINT) AS anns,
       CAST(count(*) FILTER (WHERE ruled_by IS NULL) AS BIGINT) AS kept, CAST(count(DISTINCT cui) AS BIGINT) AS concepts,
       CAST(count(DISTINCT r.doc_id) AS BIGINT) AS docs FROM ruled r JOIN documents d ON d.doc_id = r.doc_id GROUP BY d.source"""


@query("incremental_run", "N16 N3 N4 ST1 ST3", SUMMARY)
def incremental_run(t: Tables):
    """Six batches of documents; the fourth fails after its rows were stored and is repeated by the second run.

    Only that failure is taken; any other ends the query, and so does a document that no batch has logged.
    """
    folder = scale.job_folder(t.spark, "documents")
    t.text_docs.repartition(BATCHES, "doc_id").write.parquet(folder)
    failures = [3]

    def fail_once(n: int) -> None:
        if n in failures:
            failures.remove(n)
            raise RuntimeError(f"batch {n} fails before it is logged")

    job = new_documents(t, fail_once)
    checkpoint = scale.job_folder(t.spark, "checkpoint")

    def run() -> None:
        job.stream(incremental.read_new(t.spark, folder, t.text_docs.schema, files_per_batch=1), checkpoint)

    try:
        run()
    except StreamingQueryException:
        if failures:
            raise
    run()
    there = t.spark.read.schema(t.text_docs.schema).parquet(folder).count()
    logged = job.log(t.spark).entries().agg(F.sum("docs")).first()[0] or 0
    if logged != there:
        raise RuntimeError(f"{logged} of {there} documents were processed")
    return job.summary(t.spark)


@query("incremental_ranges", "N16 ST1 SC14", SUMMARY)
def incremental_ranges(t: Tables):
    """The same in runs over a growing table: each takes what lies behind the mark of the run before."""
    job = new_documents(t)
    docs = scale.cut(t.text_docs)
    highest = docs.agg(F.max("doc_id")).first()[0]
    for share in (0.2, 0.7, 1.0, 1.0):
        job.run(docs.where(F.col("doc_id") <= int(highest * share)))
    return job.summary(t.spark)


@query(
    "append_entity_anns", "ST4",
    "SELECT pid, ctx_id, CAST(count(*) AS BIGINT) AS n FROM evs GROUP BY pid, ctx_id",
)
def append_entity_anns(t: Tables):
    sink, checkpoint = folders(t, "entities")
    incremental.append_entity_anns(event_stream(t).select("pid", "ctx_id"), sink, checkpoint)
    return incremental.latest_per_key(t.spark.read.parquet(sink), ["pid", "ctx_id"])


@query(
    "event_contexts", "SF1",
    "SELECT ctx_id, CAST(count(*) AS BIGINT) AS n FROM evs GROUP BY ctx_id",
)
def event_contexts(t: Tables):
    rows = incremental.event_annotations(t.events)
    again = cx.ctx_id("concept", F.col("negation"), F.lit("Patient"), F.lit("Recent"))
    return rows.groupBy(again.alias("ctx_id")).agg(F.count("*").alias("n"))
