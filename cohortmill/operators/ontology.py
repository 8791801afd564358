"""Concept graphs, closures and mappings between code systems."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import codes
from cohortmill.streaming.store import KeyedStore

def transitive_closure(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    keys: Sequence[str] = (),
    skip: DataFrame | None = None,
) -> DataFrame:
    """All concepts at or below each seed: ``seeds(keys…, cui)``, ``edges(parent, child)``.

    ``skip(parent, child)`` takes single relations out; cycles end. A graph within the broadcast bounds goes to the tasks as a whole and
    each group of seeds is followed in one pass, however deep. Beyond them it is followed round by round
    (:func:`closure_in_rounds`).
    """
    steps = edges.select("parent", "child").distinct()
    if skip is not None:
        steps = steps.join(skip, ["parent", "child"], "left_anti")
    starts = seeds.select(*keys, "cui").distinct()
    if scale.is_small(steps):
        return scale.cut(_followed(starts, steps, keys))
    return closure_in_rounds(starts, scale.cut(steps), keys=keys)


def _followed(starts: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closure over a graph of a size that was checked: one pass over the groups of seeds.

    Only seeds with something below them enter a group, so a group is no larger than the graph.
    """
    below: dict[str, list[str]] = {}
    for r in steps.where("parent IS NOT NULL AND child IS NOT NULL").collect():
        below.setdefault(r.parent, []).append(r.child)
    graph = steps.sparkSession.sparkContext.broadcast(below)
    schema = starts.schema

    def follow(rows: pa.Table) -> pa.Table:
        children = graph.value
        seen = dict.fromkeys(rows.column("cui").to_pylist())
        todo = list(seen)
        while todo:
            for child in children.get(todo.pop(), ()):
                if child not in seen:
                    seen[child] = None
                    todo.append(child)
        names = pa.array(list(seen), rows.schema.field("cui").type)
        same = [pa.repeat(rows.column(k)[0], len(names)) for k in keys]
        return pa.Table.from_arrays([*same, names], names=[*keys, "cui"])

    parents = steps.select(F.col("parent").alias("cui")).distinct()
    inner = starts.join(F.broadcast(parents), "cui", "left_semi").select(*keys, "cui")
    group = [F.col(k) for k in keys] or [F.lit("all")]
    return starts.unionByName(inner.groupBy(*group).applyInArrow(follow, schema)).distinct()


def closure_in_rounds(
    starts: DataFrame, steps: DataFrame, *, keys: Sequence[str] = (), part_rows: int = 1_000_000, read: list[int] | None = None
) -> DataFrame:
    """Closure over a graph of any size, breadth first, each pair of group and concept expanded once.

    Steps and what was found stand in stores dealt by concept, whose parts keep their size. So a round opens the
    parts of the concepts that its frontier and its children fall into, and not what all rounds before have found.
    Both joins of a round are merge joins by hint: each of their sides grows with the closure, and adaptive execution would
    send it through the driver as a broadcast, round after round. ``read`` collects the rows in the parts that each round opens.
    """
    spark = starts.sparkSession
    by = [*keys, "cui"]
    starts, steps = starts.select(*by), steps.select(F.col("parent").alias("cui"), "child")
    graph = KeyedStore(spark, scale.job_folder(spark, "steps"), steps.schema, "cui", part_rows)
    found = KeyedStore(spark, scale.job_folder(spark, "closure"), starts.schema, "cui", part_rows)
    frontier = scale.cut(starts.distinct())
    graph.commit(0, steps)
    found.commit(0, frontier)
    n = 0
    while True:
        beneath = frontier.join(graph.opened(0, frontier).hint("merge"), "cui").select(*keys, F.col("child").alias("cui"))
        reached = scale.cut(beneath.distinct())
        if read is not None:
            opened = graph.touched(0, frontier).unionByName(found.touched(n, reached))
            read.append(opened.agg(F.sum("rows")).first()[0] or 0)
        # groups may be null
        same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
        known = found.opened(n, reached).select(*(F.col(c).alias(f"_{c}") for c in by))
        frontier = scale.cut(reached.join(known.hint("merge"), same, "left_anti"))
        if frontier.isEmpty():
            return found.read(n)
        n += 1
        found.commit(n, frontier)


def direct_children(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """One step down: ``cui``, ``child``."""
    return concepts.join(edges, F.col("cui") == F.col("parent")).select("cui", "child")


def label_of(concepts: DataFrame, labels: DataFrame, missing: str = "UNKNOWN") -> DataFrame:
    """Concepts with their label from ``labels(cui, label)``."""
    return concepts.join(labels.select("cui", "label"), "cui", "left").withColumn(
        "label", F.coalesce("label", F.lit(missing))
    )


def exclusive_concepts(closure: DataFrame) -> DataFrame:
    """Each concept kept by the study concept of the highest priority that holds it."""
    best = F.max(F.struct("priority", "name"))
    return (
        closure.groupBy("cui")
        .agg(best.alias("best"))
        .select("best.name", "best.priority", "cui")
    )


def exclusion_report(closure: DataFrame) -> DataFrame:
    """How many concepts each study concept lost to which other one: ``name, kept_by, n``."""
    kept = exclusive_concepts(closure).select("cui", F.col("name").alias("kept_by"))
    return (
        closure.join(kept, "cui")
        .where(F.col("name") != F.col("kept_by"))
        .groupBy("name", "kept_by")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def richest_closure(candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """Per term the mapped concept with the largest closure.

    ``candidates(term, cui)``, ``closure(root, cui)``; ties go to the smaller id. Terms without
    any candidate do not appear; see :func:`unmapped_terms`. Both sides may be as large as the vocabulary, so neither is broadcast.
    """
    sizes = closure.groupBy("root").agg(F.count(F.lit(1)).alias("size")).hint("merge")
    # the largest size first, then the smallest id
    best = F.min(F.struct((-F.col("size")).alias("neg"), F.col("cui")))
    return (
        candidates.join(sizes, F.col("cui") == F.col("root"), "left")
        .fillna(0, ["size"])
        .groupBy("term")
        .agg(best.alias("best"))
        .select("term", F.col("best.cui").alias("cui"), (-F.col("best.neg")).alias("size"))
    )


def unmapped_terms(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Terms that no concept was found for."""
    return terms.join(candidates, "term", "left_anti")


def term_closure(terms: DataFrame, mapped: DataFrame, closure: DataFrame) -> DataFrame:
    """Closure of each study concept from its terms: all added, then ``~~`` terms taken away.

    ``terms(name, term)``, ``mapped(term, cui)``, ``closure(root, cui)``; ``mapped`` holds the
    term text without the mark.
    """
    marked = terms.select(
        "name",
        F.regexp_replace("term", "^~~", "").alias("term"),
        F.startswith("term", F.lit("~~")).alias("minus"),
    )
    reach = (
        marked.join(mapped.withColumnRenamed("cui", "root"), "term")
        .join(closure, "root")
        .select("name", "minus", "cui")
        .distinct()
    )
    # a pair is in the result if it was added and never taken away
    return (
        reach.groupBy("name", "cui")
        .agg(F.bool_or("minus").alias("taken"))
        .where(~F.col("taken"))
        .select("name", "cui")
    )


def closure_overlaps(closure: DataFrame) -> DataFrame:
    """Number of shared concepts per pair of study concepts: ``left_name, right_name, n``.

    Concepts are first counted by the set of study concepts that hold them; pairs are made from
    those few distinct sets and not per concept.
    """
    sets = (
        closure.groupBy("cui")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
        .groupBy("names")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = sets.where(F.size("names") > 1).select("names", "n", F.posexplode("names").alias("i", "left_name"))
    rest = F.slice("names", F.col("i") + 2, F.size("names"))
    pairs = first.select("left_name", F.explode(rest).alias("right_name"), "n")
    return pairs.groupBy("left_name", "right_name").agg(F.sum("n").alias("n"))


def select_from_closure(selected: DataFrame, closure: DataFrame) -> DataFrame:
    """Selected concepts that a study concept holds: ``name, cui``."""
    return closure.select("name", "cui").distinct().join(selected.select("cui").distinct(), "cui", "left_semi")


def selected_unmapped(selected: DataFrame, closure: DataFrame) -> DataFrame:
    """Selected concepts that no study concept holds."""
    return selected.select("cui").distinct().join(closure, "cui", "left_anti")


def align_names(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names with their mapped concept, blank where there is none."""
    return names.join(mapping.select("name", "cui"), "name", "left").withColumn(
        "cui", F.coalesce("cui", F.lit(""))
    )


def map_ontology(ids: DataFrame, mapping: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Ids of one vocabulary with their concepts: ``ids(id)``, ``mapping(id, cui)``.

    With ``edges`` the direct children of the mapped concepts are added.
    """
    cleaned = mapping.select("id", F.replace("cui", F.lit("UMLS:"), F.lit("")).alias("cui"))
    direct = ids.select("id").distinct().join(cleaned, "id")
    if edges is None:
        return direct.select("id", "cui").distinct()
    below = direct.join(edges, F.col("cui") == F.col("parent")).select("id", F.col("child").alias("cui"))
    return direct.select("id", "cui").unionByName(below).distinct()


def invert_map(mapping: DataFrame) -> DataFrame:
    """Concept to ids: the mapping read the other way."""
    cleaned = F.replace("cui", F.lit("UMLS:"), F.lit(""))
    return mapping.select(cleaned.alias("cui"), "id").distinct()


def link_codes(codes_in: DataFrame, code_map: DataFrame) -> DataFrame:
    """Concepts of codes, wildcards and ranges: ``codes_in(code)``, ``code_map(icd, cui)``."""
    single = codes_in.select("code", F.explode(codes.expand_range("code")).alias("part"))
    wanted = single.select("code", F.explode(codes.expand_code("part")).alias("icd")).distinct()
    return wanted.join(code_map, "icd").select("code", "cui").distinct()


def flat_mapping(closure: DataFrame) -> DataFrame:
    """One entry per concept, mapped to itself."""
    return closure.select("cui").distinct().select(
        F.col("cui").alias("name"), F.lit(1).alias("closure"), F.col("cui").alias("mapped")
    )


def numbered_mapping(closure: DataFrame) -> DataFrame:
    """``name (i)`` entries, numbered by concept id inside each study concept."""
    sizes = closure.groupBy("name").agg(F.count(F.lit(1)).alias("closure"))
    rows = scale.numbered(closure.select("name", "cui"), "name", [F.col("cui")], F.substring("cui", 1, 6), "i")
    return rows.join(sizes, "name").select(
        F.concat("name", F.lit(" ("), F.col("i").cast("string"), F.lit(")")).alias("entry"),
        "closure",
        F.col("cui").alias("mapped"),
    )


def broken_down_mapping(seeds: DataFrame, closure: DataFrame, labels: DataFrame) -> DataFrame:
    """The study concept with its own concept, and one entry per further concept by its label."""
    own = seeds.select("name", F.col("cui").alias("mapped"))
    further = (
        closure.select("name", "cui")
        .join(seeds.select("name", "cui"), ["name", "cui"], "left_anti")
        .join(labels, "cui", "left")
        .select(F.coalesce("label", F.lit("UNKNOWN")).alias("name"), F.col("cui").alias("mapped"))
    )
    return own.unionByName(further).distinct()


def list_mapping(code_concepts: DataFrame) -> DataFrame:
    """Code to concept list as a study mapping row: size and first concept."""
    return code_concepts.groupBy("code").agg(
        F.count(F.lit(1)).alias("closure"), F.min("cui").alias("mapped")
    )


def approved_mappings(mappings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Concepts of the mappings judged ``correct``, by the general name in brackets.

    ``mappings(name, cui)``, ``verdicts(name, verdict)``; gives distinct ``general, cui``.
    """
    good = mappings.join(verdicts.where("verdict = 'correct'").select("name").distinct(), "name", "left_semi")
    general = F.regexp_extract("name", r"\(([^()]*)\)", 1)
    return good.withColumn("general", general).where("general <> ''").select("general", "cui").distinct()


def unparsable_mappings(mappings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Approved names without a general name in brackets."""
    good = mappings.join(verdicts.where("verdict = 'correct'").select("name").distinct(), "name", "left_semi")
    return good.where(F.regexp_extract("name", r"\(([^()]*)\)", 1) == "").select("name").distinct()


def parse_ontology_dump(lines: DataFrame) -> DataFrame:
    """Id to concept pairs from the term records of an ontology text dump.

    ``lines(record, line)``: the lines of one record (stanza) carry the same record key. Pairs of
    a replaced obsolete id are taken from its replacement.
    """
    fields = lines.select(
        "record",
        F.nullif(F.regexp_extract("line", r"^id: (HP:\d+)", 1), F.lit("")).alias("id"),
        F.nullif(F.regexp_extract("line", r"^xref: (UMLS:C\d+)", 1), F.lit("")).alias("cui"),
        (F.col("line") == "is_obsolete: true").alias("obsolete"),
        F.nullif(F.regexp_extract("line", r"^replaced_by: (HP:\d+)", 1), F.lit("")).alias("by"),
    )
    heads = fields.groupBy("record").agg(
        F.max("id").alias("id"), F.bool_or("obsolete").alias("obsolete"), F.max("by").alias("by")
    )
    pairs = fields.where("cui IS NOT NULL").select("record", "cui").join(heads.select("record", "id"), "record")
    replaced = heads.where("obsolete AND by IS NOT NULL").select(F.col("id").alias("old"), "by")
    kept = pairs.join(replaced, F.col("id") == F.col("old"), "left_anti").select("id", "cui")
    moved = replaced.join(pairs.select("id", "cui"), F.col("by") == F.col("id")).select(
        F.col("old").alias("id"), "cui"
    )
    return kept.unionByName(moved).distinct()


def disease_model(rows: DataFrame) -> DataFrame:
    """Disease to phenotype or test entries from ``rows(disease, hpo_label, hpo_id, test, test_id)``."""
    is_test = F.length(F.trim("test")) > 0
    return rows.select(
        "disease",
        F.when(is_test, "test").otherwise("phenotype").alias("kind"),
        F.when(is_test, F.col("test_id")).otherwise(F.col("hpo_id")).alias("id"),
        F.when(is_test, F.col("test")).otherwise(F.col("hpo_label")).alias("label"),
    ).distinct()


def concept_tree(leaves: DataFrame) -> DataFrame:
    """Tree nodes from ``leaves(folder, name)``: a folder row and a row per leaf, with paths."""
    sep = F.lit("\\")
    folder_path = F.concat(sep, F.col("folder"), sep)
    folders = leaves.select("folder").distinct().select(
        F.col("folder").alias("name"), folder_path.alias("path"), F.lit("FOLDER").alias("kind")
    )
    nodes = leaves.select(
        "name", F.concat(folder_path, F.col("name"), sep).alias("path"), F.lit("LEAF").alias("kind")
    )
    return folders.unionByName(nodes.distinct())
