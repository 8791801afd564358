"""Concept graph, closures and code mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalog.base import query
from cohortmill.functions import codes
from cohortmill.operators import ontology
from cohortmill.sources.tables import Tables, cui_of



@query("transitive_closure", "J15 SC8", "SELECT name, priority, cui FROM closure")
def transitive_closure(t: Tables):
    return t.closure


@query(
    "closure_with_skips", "J15",
    """WITH kept AS (SELECT * FROM edges WHERE NOT (parent = 'C0000001' AND child IN ('C0000012', 'C0000015'))),
       reach AS (SELECT name, cui FROM seeds UNION SELECT r.name, k.child FROM reach r JOIN kept k ON k.parent = r.cui)
       SELECT name, cui FROM reach""",
)
def closure_with_skips(t: Tables):
    skip = t.edges.where("parent = 'C0000001' AND child IN ('C0000012', 'C0000015')")
    return ontology.transitive_closure(t.seeds, t.edges, keys=["name"], skip=skip)


@query(
    "closure_of_cyclic_graph", "J15",
    """WITH cyc AS (SELECT parent, child FROM edges UNION ALL SELECT child, parent FROM edges),
       reach AS (SELECT name, cui FROM seeds UNION SELECT r.name, k.child FROM reach r JOIN cyc k ON k.parent = r.cui)
       SELECT name, CAST(count(*) AS BIGINT) AS n, min(cui) AS low, max(cui) AS high FROM reach GROUP BY name""",
)
def closure_of_cyclic_graph(t: Tables):
    back = t.edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    reach = ontology.transitive_closure(t.seeds, t.edges.unionByName(back), keys=["name"])
    return reach.groupBy("name").agg(F.count("*").alias("n"), F.min("cui").alias("low"), F.max("cui").alias("high"))


@query(
    "direct_children", "J16",
    "SELECT e.parent AS cui, e.child FROM edges e JOIN (SELECT DISTINCT cui FROM mentions) m ON m.cui = e.parent",
)
def direct_children(t: Tables):
    return ontology.direct_children(t.mentions.select("cui").distinct(), t.edges)


@query(
    "label_of", "J17",
    "SELECT c.name, c.cui, coalesce(l.label, 'UNKNOWN') AS label FROM closure c LEFT JOIN labels_dim l ON c.cui = l.cui",
)
def label_of(t: Tables):
    return ontology.label_of(t.closure.select("name", "cui"), t.labels)


@query("exclusive_concepts", "W3", "SELECT name, priority, cui FROM exclusive")
def exclusive_concepts(t: Tables):
    return t.exclusive


@query(
    "exclusion_report", "W3",
    """SELECT c.name, e.name AS kept_by, CAST(count(*) AS BIGINT) AS n FROM closure c JOIN exclusive e ON c.cui = e.cui
       WHERE c.name <> e.name GROUP BY c.name, e.name""",
)
def exclusion_report(t: Tables):
    return ontology.exclusion_report(t.closure)


ROOTS = """roots AS (SELECT DISTINCT cui AS root, cui FROM labels_dim),
       reach AS (SELECT root, cui FROM roots UNION SELECT r.root, e.child FROM reach r JOIN edges e ON e.parent = r.cui)"""


def reach_of_all(t: Tables):
    """Closure of every concept."""
    roots = t.labels.select(F.col("cui").alias("root"), "cui")
    return ontology.transitive_closure(roots, t.edges, keys=["root"])


@query(
    "richest_closure", "W4",
    f"""WITH {ROOTS}, sizes AS (SELECT root, count(*) AS size FROM reach GROUP BY root)
       SELECT label AS term, cui, CAST(size AS BIGINT) AS size FROM (SELECT l.label, l.cui, coalesce(s.size, 0) AS size,
         row_number() OVER (PARTITION BY l.label ORDER BY coalesce(s.size, 0) DESC, l.cui) AS rn
         FROM labels_dim l LEFT JOIN sizes s ON l.cui = s.root) WHERE rn = 1""",
)
def richest_closure(t: Tables):
    candidates = t.labels.select(F.col("label").alias("term"), "cui")
    return ontology.richest_closure(candidates, reach_of_all(t))


TERMS = [("T1", "a"), ("T1", "b"), ("T1", "~~c"), ("T2", "c"), ("T2", "d"), ("T2", "~~a")]
MAPPED = [("a", "C0000001"), ("b", "C0000002"), ("c", "C0000012"), ("d", "C0000001")]


@query(
    "term_closure", "U2 SC8",
    f"""WITH {ROOTS},
       terms(name, term, minus) AS (VALUES ('T1','a',0), ('T1','b',0), ('T1','c',1), ('T2','c',0), ('T2','d',0), ('T2','a',1)),
       mapped(term, root) AS (VALUES ('a','C0000001'), ('b','C0000002'), ('c','C0000012'), ('d','C0000001')),
       r AS (SELECT t.name, t.minus, k.cui FROM terms t JOIN mapped m ON t.term = m.term JOIN reach k ON k.root = m.root)
       SELECT name, cui FROM r WHERE minus = 0 EXCEPT SELECT name, cui FROM r WHERE minus = 1""",
)
def term_closure(t: Tables):
    terms = t.config(TERMS, "name string, term string")
    mapped = t.config(MAPPED, "term string, cui string")
    # only what the terms are mapped to is closed
    roots = mapped.select(F.col("cui").alias("root"), "cui").distinct()
    return ontology.term_closure(terms, mapped, ontology.transitive_closure(roots, t.edges, keys=["root"]))


@query(
    "closure_overlaps", "U3",
    """SELECT a.name AS left_name, b.name AS right_name, CAST(count(*) AS BIGINT) AS n FROM closure a
       JOIN closure b ON a.cui = b.cui AND a.name < b.name GROUP BY a.name, b.name""",
)
def closure_overlaps(t: Tables):
    return ontology.closure_overlaps(t.closure)


@query(
    "select_from_closure", "U4",
    "SELECT DISTINCT c.name, c.cui FROM closure c WHERE c.cui IN (SELECT cui FROM mentions WHERE sty = 'PROMO')",
)
def select_from_closure(t: Tables):
    return ontology.select_from_closure(t.mentions.where("sty = 'PROMO'"), t.closure)


@query(
    "selected_unmapped", "U4",
    "SELECT DISTINCT cui FROM mentions WHERE cui NOT IN (SELECT cui FROM closure)",
)
def selected_unmapped(t: Tables):
    return ontology.selected_unmapped(t.mentions, t.closure)


NAMES = "concat(p_name, ' ', p_type, ' ', CAST(p_partkey AS VARCHAR))"


@query(
    "align_names", "U6",
    f"""SELECT {NAMES} AS name, CASE WHEN p_type = 'SMALL' THEN '' ELSE printf('C%07d', p_partkey) END AS cui FROM part""",
)
def align_names(t: Tables):
    name = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
    names = t.raw("part").select(name.alias("name"))
    mapping = t.raw("part").where("p_type <> 'SMALL'").select(name.alias("name"), cui_of("p_partkey").alias("cui"))
    return ontology.align_names(names, mapping)


def hpo_map(t: Tables):
    """Ids of another vocabulary: the concepts of small size, several per id."""
    k = F.col("p_partkey")
    return t.raw("part").where("p_size < 20").select(
        F.format_string("HP:%07d", F.floor(k / 10).cast("long")).alias("id"),
        F.concat(F.lit("UMLS:"), cui_of("p_partkey")).alias("cui"),
    )


HPO = """hpo AS (SELECT printf('HP:%07d', CAST(floor(p_partkey / 10) AS BIGINT)) AS id,
       printf('C%07d', p_partkey) AS cui FROM part WHERE p_size < 20)"""


@query(
    "map_ontology", "J13",
    f"WITH {HPO} SELECT DISTINCT id, cui FROM hpo UNION SELECT h.id, e.child FROM hpo h JOIN edges e ON e.parent = h.cui",
)
def map_ontology(t: Tables):
    mapping = hpo_map(t)
    return ontology.map_ontology(mapping.select("id"), mapping, t.edges)


@query("invert_map", "J13", f"WITH {HPO} SELECT DISTINCT cui, id FROM hpo")
def invert_map(t: Tables):
    return ontology.invert_map(hpo_map(t))


def icd_map(t: Tables):
    """Three-character codes with a digit behind the dot, by part key."""
    k = F.col("p_partkey")
    code = F.concat(
        F.char((F.lit(65) + k % 5).cast("int")), F.lpad(F.floor(k / 5 % 20).cast("int").cast("string"), 2, "0"),
        F.lit("."), (F.floor(k / 100) % 10).cast("int").cast("string"),
    )
    return t.raw("part").select(code.alias("icd"), cui_of("p_partkey").alias("cui"))


def code_patterns(t: Tables):
    """Short, wildcard, exact and range codes, by supplier key."""
    k = F.col("s_suppkey")
    letter = F.char((F.lit(65) + k % 5).cast("int"))
    two = F.lpad((k % 20).cast("string"), 2, "0")
    return t.raw("supplier").select(
        F.when(k % 4 == 0, F.concat(letter, two))
        .when(k % 4 == 1, F.concat(letter, (k % 2).cast("string"), F.lit("#")))
        .when(k % 4 == 2, F.concat(letter, two, F.lit("3X")))
        .otherwise(F.concat(letter, two, F.lit("-"), letter, F.lpad((k % 20 + 3).cast("string"), 2, "0")))
        .alias("code")
    ).distinct()


ICD = """icd AS (SELECT chr(CAST(65 + p_partkey % 5 AS INT)) || lpad(CAST(CAST(floor(p_partkey / 5) AS BIGINT) % 20 AS VARCHAR), 2, '0')
         || '.' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) % 10 AS VARCHAR) AS icd,
         printf('C%07d', p_partkey) AS cui FROM part),
       pats AS (SELECT DISTINCT CASE s_suppkey % 4
           WHEN 0 THEN chr(CAST(65 + s_suppkey % 5 AS INT)) || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0')
           WHEN 1 THEN chr(CAST(65 + s_suppkey % 5 AS INT)) || CAST(s_suppkey % 2 AS VARCHAR) || '#'
           WHEN 2 THEN chr(CAST(65 + s_suppkey % 5 AS INT)) || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') || '3X'
           ELSE chr(CAST(65 + s_suppkey % 5 AS INT)) || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') || '-'
             || chr(CAST(65 + s_suppkey % 5 AS INT)) || lpad(CAST(s_suppkey % 20 + 3 AS VARCHAR), 2, '0') END AS code FROM supplier)"""


@query(
    "link_codes", "J18 SF14",
    f"""WITH {ICD} SELECT DISTINCT p.code, i.cui FROM pats p JOIN icd i ON
         CASE WHEN p.code LIKE '%-%' THEN i.icd[1] = p.code[1] AND i.icd[2:3] BETWEEN p.code[2:3] AND p.code[6:7]
              WHEN p.code LIKE '%X' THEN i.icd = p.code[1:3] || '.' || p.code[4]
              WHEN p.code LIKE '%#' THEN i.icd[1:2] = p.code[1:2] ELSE i.icd[1:3] = p.code END""",
)
def link_codes(t: Tables):
    return ontology.link_codes(code_patterns(t), icd_map(t))


@query(
    "expanded_codes", "SF14",
    f"""WITH {ICD} SELECT code, CAST(CASE WHEN code LIKE '%-%' THEN CAST(code[6:7] AS INT) - CAST(code[2:3] AS INT) + 1
       ELSE 1 END AS BIGINT) AS parts FROM pats""",
)
def expanded_codes(t: Tables):
    return code_patterns(t).select("code", F.size(codes.expand_range("code")).cast("long").alias("parts"))


@query("flat_mapping", "U7", "SELECT DISTINCT cui AS name, 1 AS closure, cui AS mapped FROM closure")
def flat_mapping(t: Tables):
    return ontology.flat_mapping(t.closure)


@query(
    "numbered_mapping", "U7",
    """SELECT name || ' (' || row_number() OVER (PARTITION BY name ORDER BY cui) || ')' AS entry,
       CAST(count(*) OVER (PARTITION BY name) AS BIGINT) AS closure, cui AS mapped FROM closure""",
)
def numbered_mapping(t: Tables):
    return ontology.numbered_mapping(t.closure)


@query(
    "broken_down_mapping", "U7",
    """SELECT name, cui AS mapped FROM seeds UNION SELECT coalesce(l.label, 'UNKNOWN'), c.cui FROM closure c
       LEFT JOIN labels_dim l ON c.cui = l.cui WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.name = c.name AND s.cui = c.cui)""",
)
def broken_down_mapping(t: Tables):
    return ontology.broken_down_mapping(t.seeds, t.closure, t.labels)


@query(
    "list_mapping", "U7",
    f"WITH {ICD} SELECT icd AS code, CAST(count(*) AS BIGINT) AS closure, min(cui) AS mapped FROM icd GROUP BY icd",
)
def list_mapping(t: Tables):
    return ontology.list_mapping(icd_map(t).withColumnRenamed("icd", "code"))


def judged_names(t: Tables):
    """Mapping names with a general name in brackets (every 13th without), and verdicts."""
    k = F.col("p_partkey")
    name = F.when(k % 13 == 0, F.concat("p_name", F.lit(" "), k.cast("string"))).otherwise(
        F.concat(F.lit("("), F.col("p_name"), F.lit(") "), F.col("p_type"), F.lit(" "), k.cast("string"))
    )
    rows = t.raw("part").select("p_partkey", name.alias("name"), cui_of("p_partkey").alias("cui"))
    verdicts = rows.select("name", F.when(k % 2 == 0, "correct").otherwise("wrong").alias("verdict"))
    return rows.select("name", "cui"), verdicts


@query(
    "approved_mappings", "U8",
    """SELECT DISTINCT p_name AS general, printf('C%07d', p_partkey) AS cui FROM part
       WHERE p_partkey % 2 = 0 AND p_partkey % 13 <> 0""",
)
def approved_mappings(t: Tables):
    return ontology.approved_mappings(*judged_names(t))


@query(
    "unparsable_mappings", "U8",
    "SELECT DISTINCT p_name || ' ' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 13 = 0",
)
def unparsable_mappings(t: Tables):
    return ontology.unparsable_mappings(*judged_names(t))


@query(
    "ontology_dump", "J13",
    f"""WITH {HPO}, heads AS (SELECT DISTINCT id FROM hpo), pairs AS (SELECT DISTINCT id, 'UMLS:' || cui AS cui FROM hpo)
       SELECT id, cui FROM pairs WHERE CAST(id[4:] AS BIGINT) % 9 <> 0 OR printf('HP:%07d', CAST(id[4:] AS BIGINT) + 1) IS NULL
       UNION SELECT h.id, p.cui FROM heads h JOIN pairs p ON p.id = printf('HP:%07d', CAST(h.id[4:] AS BIGINT) + 1)
       WHERE CAST(h.id[4:] AS BIGINT) % 9 = 0""",
)
def ontology_dump(t: Tables):
    # text dump lines of the mapping; every ninth id is obsolete and replaced by the next one
    number = F.substring("id", 4, 20).cast("long")
    rows = hpo_map(t)
    heads = rows.select("id").distinct()
    after = F.format_string("HP:%07d", (number + 1).cast("long"))
    lines = rows.select(F.col("id").alias("record"), F.concat(F.lit("xref: "), F.col("cui")).alias("line"))
    lines = lines.unionByName(heads.select(F.col("id").alias("record"), F.concat(F.lit("id: "), F.col("id")).alias("line")))
    gone = heads.where(number % 9 == 0)
    lines = lines.unionByName(gone.select(F.col("id").alias("record"), F.lit("is_obsolete: true").alias("line")))
    lines = lines.unionByName(gone.select(F.col("id").alias("record"), F.concat(F.lit("replaced_by: "), after).alias("line")))
    return ontology.parse_ontology_dump(lines)


@query(
    "disease_model", "A34",
    """SELECT DISTINCT p_brand AS disease, CASE WHEN p_size % 4 = 0 THEN 'test' ELSE 'phenotype' END AS kind,
       CASE WHEN p_size % 4 = 0 THEN 'T' || p_size ELSE 'HP:' || p_size END AS id,
       CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_name END AS label FROM part""",
)
def disease_model(t: Tables):
    size = F.col("p_size").cast("string")
    rows = t.raw("part").select(
        F.col("p_brand").alias("disease"), F.col("p_name").alias("hpo_label"), F.concat(F.lit("HP:"), size).alias("hpo_id"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise(" ").alias("test"), F.concat(F.lit("T"), size).alias("test_id"),
    )
    return ontology.disease_model(rows)


@query(
    "concept_tree", "SF25",
    r"""SELECT DISTINCT sty AS name, '\' || sty || '\' AS path, 'FOLDER' AS kind FROM labels_dim
       UNION ALL SELECT DISTINCT label, '\' || sty || '\' || label || '\', 'LEAF' FROM labels_dim""",
)
def concept_tree(t: Tables):
    return ontology.concept_tree(t.labels.select(F.col("sty").alias("folder"), F.col("label").alias("name")))
