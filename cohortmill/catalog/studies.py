"""Whole studies over running text: concepts and rules from configuration files, options, samples with text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog.base import WORDS_OF, query
from cohortmill.catalog.notes import RULES, WINDOW_VERDICT, WINDOWED
from cohortmill.plans import study
from cohortmill.sources import config
from cohortmill.sources.tables import Tables

CONCEPTS = {
    "course": ["C9000001", "C9000002", "C9000003"],
    "drug": ["C9000004", "C9000005"],
    "other": ["C9000006", "C9000007"],
}
OPTIONS = {"skip_terms": ["thatin"], "constraints": ["start_pos % 10 <> 3", "sty <> 'Sign or Symptom'"]}
SEARCHED = ["was", "und"]


def put(t: Tables, path: str, value) -> None:
    """Write a small configuration file to any store."""
    target = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(json.dumps(value), "utf-8"))
    out.close()


def study_folder(t: Tables) -> str:
    """A study folder with mapped concepts, options and a rule configuration."""
    folder = scale.job_folder(t.spark, "study")
    put(t, f"{folder}/manual_mapped_concepts.json", {name: {"concepts": cuis} for name, cuis in CONCEPTS.items()})
    put(t, f"{folder}/study_options.json", OPTIONS)
    for rule in RULES.rules:
        one = {
            "offset": rule.offset, "regs": list(rule.patterns), "case_sensitive": rule.case_sensitive,
            "containing_pattern": rule.containing, "more_context_sents": [-1] * rule.prev_ctx + [1] * rule.next_ctx,
        }
        put(t, f"{folder}/rules/{rule.name}", [one])
    put(t, f"{folder}/rules/surface_patterns", RULES.surface_patterns)
    put(t, f"{folder}/skip.json", RULES.skip_terms)
    setting = {"rules_folder": "rules", "active_rules": [r.name for r in RULES.rules], "osf_rules": ["surface_patterns"]}
    put(t, f"{folder}/rules.json", setting | {"skip_term_setting": "skip.json"})
    return folder


def run(t: Tables, **more) -> study.StudyResult:
    folder = study_folder(t)
    loaded = config.load_study(t.spark, folder)
    ruleset = config.load_rules(t.spark, f"{folder}/rules.json")
    options = study.StudyOptions(**loaded.options)
    patients = t.text_docs.select("pid").distinct()
    return study.run_study(
        t.text_mentions, t.text_docs, loaded.closure, patients, names=list(CONCEPTS), ruleset=ruleset, options=options, **more
    )


KEPT = f"""{WINDOWED}, v AS (SELECT doc_id, cui, str, start_pos, end_pos, coalesce(CASE WHEN lower(str) IN ('inoran', 'thatin') THEN 'skip-term'
         WHEN regexp_matches(str, '^(?:H[a-z]+)') OR regexp_matches(str, '^(?:Ino)') THEN 'original-string-rule' END, {WINDOW_VERDICT},
         CASE WHEN NOT (experiencer = 'Patient' AND temporality = 'Recent' AND negation = 'Affirmed') THEN 'nlp-label' END) AS ruled_by
         FROM w WHERE start_pos % 10 <> 3 AND sty <> 'Sign or Symptom'),
       con(concept, cui) AS (VALUES {", ".join(f"('{n}', '{c}')" for n, cuis in CONCEPTS.items() for c in cuis)}),
       kept AS (SELECT v.*, con.concept FROM v JOIN con ON con.cui = v.cui WHERE ruled_by IS NULL)"""
COUNTS = ", ".join(f"CAST(count(DISTINCT k.doc_id) FILTER (k.concept = '{n}') AS BIGINT) AS {n}" for n in CONCEPTS)


@query(
    "study_run_ruled", "N14 SC8 SC9 N3",
    f"""WITH {KEPT} SELECT d.source AS pid, {COUNTS} FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.source""",
)
def study_run_ruled(t: Tables):
    return run(t).matrix


@query(
    "study_search_terms", "N14 PF8 SC8",
    f"""WITH {KEPT}, s AS (SELECT source, count(*) AS n FROM documents
         WHERE list_has_any(regexp_extract_all(lower(text), {WORDS_OF}), {SEARCHED}) GROUP BY source)
       SELECT d.source AS pid, {COUNTS}, CAST(coalesce(max(s.n), 0) AS BIGINT) AS searched
       FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN s ON s.source = d.source GROUP BY d.source""",
)
def study_search_terms(t: Tables):
    return run(t, search_terms={"searched": SEARCHED}).matrix


@query(
    "study_samples_text", "N14 W5 SC8 SC9",
    f"""WITH {KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY md5(concat_ws('|', '3', CAST(doc_id AS VARCHAR),
         CAST(start_pos AS VARCHAR), CAST(end_pos AS VARCHAR), cui)), doc_id, start_pos, end_pos, cui) AS rn FROM kept)
       SELECT r.concept, r.doc_id, r.cui, r.str, d.lang AS src_table, CAST(r.start_pos - greatest(r.start_pos - 30, 0) AS BIGINT) AS in_start,
         CAST(r.end_pos - greatest(r.start_pos - 30, 0) AS BIGINT) AS in_end,
         substring(d.text, greatest(r.start_pos - 30, 0) + 1, r.end_pos - greatest(r.start_pos - 30, 0) + 30) AS content
       FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rn <= 15""",
)
def study_samples_text(t: Tables):
    folder = study_folder(t)
    loaded = config.load_study(t.spark, folder)
    docs = t.text_docs.withColumnRenamed("lang", "src_table")
    result = study.run_study(
        t.text_mentions, docs, loaded.closure, docs.select("pid").distinct(), names=list(CONCEPTS),
        ruleset=config.load_rules(t.spark, f"{folder}/rules.json"), options=study.StudyOptions(**loaded.options),
        sample_size=15, sample_window=30, seed="3",
    )
    long = lambda c: F.col(c).cast("long").alias(c)
    return result.samples.select("concept", "doc_id", "cui", "str", "src_table", long("in_start"), long("in_end"), "content")
