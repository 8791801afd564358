"""Study folders and rule configurations. These are small driver-side JSON files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cohortmill.operators import ontology
from cohortmill.operators.rules import Rule, RuleSet


@dataclass
class Study:
    """A study: ``closure(name, priority, cui)``, mapped terms and options."""

    name: str
    closure: DataFrame
    terms: DataFrame
    options: dict = field(default_factory=dict)
    rejects: list[str] = field(default_factory=list)


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store that Spark reads, or None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def _json(spark: SparkSession, path: str):
    text = _text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def load_rules(spark: SparkSession, config: str | Path, *, root: str | Path | None = None) -> RuleSet:
    """Rules, original-string patterns and skip terms of a rule configuration file.

    Paths in the file are relative to ``root``, by default the folder of the file.
    """
    config = str(config)
    base = str(root) if root is not None else config.rpartition("/")[0]
    setting = _json(spark, config)
    folder = f"{base}/{setting['rules_folder']}"
    out = RuleSet()
    for name in setting["active_rules"]:
        for r in _json(spark, f"{folder}/{name}"):
            more = r.get("more_context_sents", [])
            out.rules.append(
                Rule(
                    name,
                    r["offset"],
                    tuple(r["regs"]),
                    case_sensitive=r.get("case_sensitive", False),
                    containing=r.get("containing_pattern", False),
                    prev_ctx=-1 in more,
                    next_ctx=1 in more,
                )
            )
    for name in setting.get("osf_rules", []):
        out.surface_patterns += _json(spark, f"{folder}/{name}")
    if "skip_term_setting" in setting:
        out.skip_terms = _json(spark, f"{base}/{setting['skip_term_setting']}")
    return out


def rules_table(spark: SparkSession, ruleset: RuleSet) -> DataFrame:
    """The rules as a small table, for reports."""
    from cohortmill import schemas

    rows = [
        (r.name, i, r.offset, p, r.case_sensitive, r.containing, r.prev_ctx, r.next_ctx)
        for i, r in enumerate(ruleset.rules)
        for p in r.patterns
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def load_study(
    spark: SparkSession,
    folder: str | Path,
    *,
    edges: DataFrame | None = None,
    term_concepts: DataFrame | None = None,
    skip_relations: DataFrame | None = None,
    keep: list[str] | None = None,
    disjoint: bool = True,
) -> Study:
    """Study concepts of a folder, from the first form found.

    In order: ``label2concept.tsv`` (one concept each), ``exact_concepts_mappings.json`` (a concept
    with everything below it), ``manual_mapped_concepts.json`` (ready closures) and
    ``study_concepts.json`` (terms, mapped by ``term_concepts(term, cui)``; ``~~`` takes away). The
    order in the file is the priority: with ``disjoint`` the last study concept keeps a shared one.
    """
    folder = str(folder).rstrip("/")
    rejects: list[str] = []
    labels, exact, manual = (
        _text(spark, f"{folder}/{name}")
        for name in ("label2concept.tsv", "exact_concepts_mappings.json", "manual_mapped_concepts.json")
    )
    pairs: list[tuple[str, str, str]] = []
    expand = minus = False
    order: list[str] = []
    if labels is not None:
        for line in labels.splitlines():
            cells = line.split("\t")
            if len(cells) != 2:
                rejects.append(line)
                continue
            pairs.append((cells[0], cells[0], cells[1]))
            order.append(cells[0])
    elif exact is not None:
        expand = True
        for name, cui in json.loads(exact).items():
            pairs.append((name, name, cui))
            order.append(name)
    elif manual is not None:
        for name, item in json.loads(manual).items():
            pairs += [(name, name, cui) for cui in item["concepts"]]
            order.append(name)
    else:
        minus = True
        for name, terms in _json(spark, f"{folder}/study_concepts.json").items():
            pairs += [(name, term, "") for term in terms]
            order.append(name)

    priorities = spark.createDataFrame(
        [(n, i + 1) for i, n in enumerate(dict.fromkeys(order))], "name string, priority int"
    )
    terms = spark.createDataFrame(pairs, "name string, term string, cui string")
    if minus:
        if term_concepts is None or edges is None:
            raise ValueError("a term list needs term_concepts and edges")
        plain = terms.selectExpr("name", "term")
        asked = plain.selectExpr("regexp_replace(term, '^~~', '') AS term").distinct()
        candidates = term_concepts.join(asked, "term", "left_semi")
        roots = candidates.selectExpr("cui AS root", "cui").distinct()
        reach = ontology.transitive_closure(roots, edges, keys=["root"], skip=skip_relations)
        mapped = ontology.richest_closure(candidates, reach).select("term", "cui")
        closure = ontology.term_closure(plain, mapped, reach)
        rejects += [r["term"] for r in ontology.unmapped_terms(asked, candidates).collect()]
        terms = mapped
    elif expand:
        if edges is None:
            raise ValueError("exact mappings need edges")
        closure = ontology.transitive_closure(terms.select("name", "cui"), edges, keys=["name"], skip=skip_relations)
    else:
        closure = terms.select("name", "cui").distinct()
    closure = closure.join(priorities, "name")
    if keep is not None:
        closure = closure.where(closure["name"].isin(*keep))
    if disjoint:
        closure = ontology.exclusive_concepts(closure)
    options = json.loads(_text(spark, f"{folder}/study_options.json") or "{}")
    return Study(folder.rpartition("/")[2], closure.select("name", "priority", "cui"), terms, options, rejects)
