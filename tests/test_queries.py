"""Registered queries against their SQL on the smallest data.

All of them run with COHORTMILL_ALL_QUERIES=1; otherwise a selection that touches every module.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SELECTION = [
    "annotation_lines", "standoff_lines", "upsert_concepts", "within_patient_window", "search_concepts_page",
    "transitive_closure", "closure_of_cyclic_graph", "richest_closure", "term_closure", "closure_overlaps", "link_codes",
    "attach_patient", "episode_windows", "study_table_doc_count", "positive_vs_ruled_grouped", "typed_mention_summary",
    "bipartite_topk", "patient_entities", "semantic_search", "label_ambiguity", "study_samples", "turn_neighbours",
    "confidence_cascade", "dictionary_annotate", "context_rules", "rule_chain", "relocate_offsets", "page_sections",
    "extract_measurements", "sensitive_values", "pattern_features", "text_search_near", "stream_patient_refresh",
    "append_entity_anns", "incremental_ranges", "stream_ctx_concepts", "density_clusters", "numbered_mentions",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("COHORTMILL_ALL_QUERIES") else SELECTION)
def test_query_agrees_with_sql(spark, con, name):
    verdict, detail = compare(spark, con, FOLDER, name)
    assert verdict == "ok", detail


def test_entry_has_one_row_per_patient(spark):
    df = entry(spark)
    assert df.columns == ["pid", "S1", "S2", "S3", "S4", "S5"]
    assert df.count() == df.select("pid").distinct().count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
