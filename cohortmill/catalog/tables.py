"""Sources, sinks and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog.base import query
from cohortmill.functions import context as cx
from cohortmill.operators import filters, sections, summary, validation
from cohortmill.sources import readers, sinks
from cohortmill.sources.tables import Tables


def annotation_struct():
    """A mention in the raw annotation format."""
    return F.struct(
        F.lit(readers.CONCEPT_TYPE).alias("type"),
        F.struct(F.col("start_pos").alias("offset")).alias("startNode"),
        F.struct(F.col("end_pos").alias("offset")).alias("endNode"),
        F.struct(
            F.col("cui").alias("inst"), F.col("sty").alias("STY"), F.col("pref").alias("PREF"),
            F.col("negation").alias("Negation"), F.col("temporality").alias("Temporality"),
            F.col("experiencer").alias("Experiencer"), F.col("str").alias("string_orig"),
        ).alias("features"),
    )


def annotation_json(mentions):
    """One JSON line per mention in the raw annotation format."""
    line = F.struct(F.col("doc_id").cast("string").alias("docId"), F.array(F.array(annotation_struct())).alias("annotations"))
    return mentions.select(F.to_json(line).alias("value"))


@query(
    "annotation_lines", "SC2",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, cui, sty, str, start_pos, end_pos, negation, temporality,
       experiencer, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY ALL""",
)
def annotation_lines(t: Tables):
    parsed = readers.parse_annotation_lines(annotation_json(t.mentions))
    cols = ["doc_id", "cui", "sty", "str", "start_pos", "end_pos", "negation", "temporality", "experiencer"]
    return readers.concept_mentions(parsed).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "annotation_files", "SC3",
    """SELECT CAST(floor(doc_id / 500) AS BIGINT) AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(start_pos) AS BIGINT) AS s
       FROM mentions GROUP BY 1""",
)
def annotation_files(t: Tables):
    # one JSON file for the mentions of some hundred documents, named by the folder it stands in
    folder = scale.job_folder(t.spark, "annotations")
    ann = t.mentions.select(F.floor(F.col("doc_id") / 500).alias("file"), annotation_struct().alias("ann"))
    whole = ann.groupBy("file").agg(F.to_json(F.struct(F.array(F.collect_list("ann")).alias("annotations"))).alias("value"))
    # a group is one row and so one file already; the annotation format repeats its names, so files are packed
    whole.write.partitionBy("file").option("compression", "gzip").text(folder)
    parsed = readers.read_annotation_files(t.spark, f"{folder}/*", key=r"file=(\d+)/")
    rows = readers.concept_mentions(parsed)
    counted = rows.groupBy(F.col("doc_id").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("start_pos").alias("s"))
    return counted.select("file", "n", F.col("s").cast("long").alias("s"))


@query(
    "repaired_lines", "SF15",
    """SELECT cui, CAST(count(*) AS BIGINT) AS n, min(concat('a "', str, '" b')) AS str FROM mentions GROUP BY cui""",
)
def repaired_lines(t: Tables):
    quoted = t.mentions.withColumn("str", F.concat(F.lit("a ~"), F.col("str"), F.lit("~ b")))
    broken = annotation_json(quoted).withColumn("value", F.translate("value", "~", '"'))
    rows = readers.concept_mentions(readers.parse_annotation_lines(broken))
    return rows.groupBy("cui").agg(F.count(F.lit(1)).alias("n"), F.min("str").alias("str"))


@query(
    "read_documents", "SC4",
    "SELECT CAST(item_id AS VARCHAR) AS doc_id, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM benchmark",
)
def read_documents(t: Tables):
    # one text file per item; the writer ends it with a line break
    folder = scale.job_folder(t.spark, "texts")
    t.raw("benchmark").repartition("item_id").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(folder)
    docs = readers.read_documents(t.spark, f"{folder}/*", key=r"item_id=(\d+)/")
    text = F.substring("text", F.lit(1), F.length("text") - 1)
    return docs.select("doc_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"))


@query(
    "documents_with_patients", "SC5",
    "SELECT d.doc_id, d.source AS pid, CAST(length(d.text) AS BIGINT) AS chars FROM documents d JOIN labels b ON d.doc_id = b.doc_id",
)
def documents_with_patients(t: Tables):
    d2p = t.raw("documents").select("doc_id", F.col("source").alias("pid")).join(
        t.raw("labels").select("doc_id"), "doc_id"
    )
    docs = t.raw("documents").select("doc_id", "text")
    return readers.load_documents_with_patients(docs, d2p).select(
        "doc_id", "pid", F.length("text").cast("long").alias("chars")
    )


@query(
    "split_records", "SC6",
    "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS rec_id, CAST(length(text) AS BIGINT) AS chars FROM conversations",
)
def split_records(t: Tables):
    # one dump text per turn, records marked by a line with their id
    dumps = t.raw("conversations").select(
        F.concat(F.lit("@@"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit("@@\n"), F.col("text")).alias("text")
    )
    records = sections.split_records(dumps, r"(?m)^@@(\d+)@@\n")
    return records.select("rec_id", F.length("text").cast("long").alias("chars"))


@query(
    "lookup_lines", "SC7",
    """SELECT CASE WHEN src_table = 'P' THEN -1 ELSE pid END AS pid, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY 1""",
)
def lookup_lines(t: Tables):
    # the lines of one document status lack their patient and must end up among the rejects
    lines = t.docs.select(
        F.concat(
            F.col("doc_id").cast("string"),
            F.when(F.col("src_table") != "P", F.concat(F.lit("\t"), F.col("pid").cast("string"))).otherwise(""),
        ).alias("value")
    )
    rows = readers.parse_lookup_lines(lines, ["doc_id", "pid"])
    key = F.when(F.col("bad").isNull(), F.col("pid").cast("long")).otherwise(F.lit(-1).cast("long"))
    return rows.groupBy(key.alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_cohort_docs", "SC10",
    """SELECT doc_id, source AS pid FROM documents WHERE text IS NOT NULL AND source IN
       (SELECT d.source FROM documents d JOIN labels b ON d.doc_id = b.doc_id WHERE b.toxic = 1)""",
)
def extract_cohort_docs(t: Tables):
    toxic = t.raw("labels").where("toxic = 1").select("doc_id")
    cohort = t.text_docs.join(toxic, "doc_id", "left_semi").select("pid")
    return readers.extract_cohort_docs(t.text_docs, cohort).select("doc_id", "pid")


@query(
    "copy_missing", "SC11",
    """SELECT doc_id, pid FROM docs WHERE doc_type <> '5-LOW'
       AND doc_id NOT IN (SELECT doc_id FROM mentions)""",
)
def copy_missing(t: Tables):
    wanted = t.docs.where("doc_type <> '5-LOW'").select("doc_id")
    return readers.copy_missing(t.docs.select("doc_id", "pid"), t.mentions, ["doc_id"], wanted=wanted)


@query(
    "search_scan", "SC12",
    "SELECT doc_id, doc_type FROM docs WHERE src_table = 'F' AND doc_date >= TIMESTAMP '1998-01-01'",
)
def search_scan(t: Tables):
    late = (F.col("src_table") == "F") & (F.col("doc_date") >= F.lit("1998-01-01").cast("timestamp"))
    return readers.search_scan(t.docs, late, ["doc_id", "doc_type"])


@query(
    "upsert_concepts", "SC13",
    """SELECT cui, CAST(max(doc_id) AS BIGINT) AS version, min(pref) AS pref FROM mentions GROUP BY cui""",
)
def upsert_concepts(t: Tables):
    rows = t.mentions.select("cui", F.col("doc_id").alias("version"), "pref", "temporality")
    # the history is the stored dimension, recent mentions come in
    old = rows.where("temporality = 'historical'").groupBy("cui").agg(
        F.max("version").alias("version"), F.max("pref").alias("pref")
    )
    new = rows.where("temporality = 'Recent'").select("cui", "version", "pref")
    return readers.upsert_concepts(old, new, key="cui")


@query(
    "update_doc_attributes", "SC14",
    """SELECT d.doc_id, CASE WHEN b.quality = 1 THEN 'good' ELSE d.doc_type END AS doc_type FROM docs d
       LEFT JOIN labels b ON d.doc_id = b.doc_id""",
)
def update_doc_attributes(t: Tables):
    updates = t.raw("labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("doc_type"))
    return readers.update_doc_attributes(t.docs, updates, ["doc_type"]).select("doc_id", "doc_type")


@query(
    "written_table", "SC15",
    "SELECT CAST(pid AS VARCHAR) AS pid, CAST(count(*) AS VARCHAR) AS n FROM docs GROUP BY pid",
)
def written_table(t: Tables):
    path = scale.job_folder(t.spark, "tsv")
    sinks.write_table(t.docs.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.option("sep", "\t").option("header", True).schema("pid string, n string").csv(path)


@query(
    "patients_by_code", "SC16",
    """SELECT DISTINCT p.pid, p.cohort FROM patients p JOIN docs d ON p.pid = d.pid WHERE d.doc_type = '1-URGENT'""",
)
def patients_by_code(t: Tables):
    diagnoses = t.docs.select("pid", F.col("doc_type").alias("code"))
    return readers.patients_by_code(diagnoses, t.patients, "1-URGENT")


@query(
    "admissions_by_code", "SC16",
    """SELECT DISTINCT d.doc_id AS adm_id, strftime(d.doc_date, '%Y-%m-%d') AS admitted FROM mentions m
       JOIN docs d ON m.doc_id = d.doc_id WHERE m.sty = 'PROMO'""",
)
def admissions_by_code(t: Tables):
    diagnoses = t.mentions.select(F.col("doc_id").alias("adm_id"), F.col("sty").alias("code"))
    admissions = t.docs.select(
        F.col("doc_id").alias("adm_id"), F.date_format("doc_date", "yyyy-MM-dd").alias("admitted")
    )
    return readers.admissions_by_code(diagnoses, admissions, "PROMO")


@query(
    "events_by_admission", "SC16",
    """SELECT l.l_orderkey AS adm_id, l.l_partkey AS item_id, strftime(l.l_shipdate, '%Y-%m-%d') AS event_time,
       p.p_name AS label, p.p_type AS category FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
)
def events_by_admission(t: Tables):
    events = t.raw("lineitem").select(
        F.col("l_orderkey").alias("adm_id"), F.col("l_partkey").alias("item_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("event_time"),
    )
    items = t.raw("part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("label"), F.col("p_type").alias("category")
    )
    return readers.events_by_admission(events, items)


def markup_sql() -> str:
    """The same text steps as nested SQL calls."""
    expr = "html"
    steps = [(rf"(?is)<{tag}\b.*?</{tag}\s*>", "' '") for tag in ("table", "script", "style", "head", "nav")]
    steps += [
        (r"(?s)<!--.*?-->", "' '"),
        (r"(?i)<(?:title|sec|h[1-6])\b[^>]*>", "chr(10)"),
        (r"(?i)</(?:title|sec|h[1-6])\s*>", "'.' || chr(10)"),
        (r"(?i)</(?:p|div|li|article|section|footer)\s*>|<br\s*/?>", "chr(10)"),
        (r"<[^>]*>", "' '"),
    ]
    for pattern, into in steps:
        expr = f"regexp_replace({expr}, '{pattern}', {into}, 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        expr = f"replace({expr}, '{name}', '{char}')"
    expr = rf"regexp_replace({expr}, '[ \t]+', ' ', 'g')"
    expr = rf"regexp_replace({expr}, ' ?\n[ \n]*', chr(10), 'g')"
    return f"SELECT page_id, trim({expr}) AS text FROM pages"


@query("markup_to_text", "SC17", markup_sql())
def markup_to_text(t: Tables):
    return sections.markup_to_text(t.raw("pages")).select("page_id", "text")


@query(
    "standoff_lines", "SC18",
    r"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, cui, ruled_by, negation) AS no
        FROM (SELECT DISTINCT doc_id, cui, sty, str, start_pos, end_pos, negation, ruled_by FROM
              (SELECT doc_id, cui, sty, str, start_pos, end_pos, min(negation) AS negation, min(ruled_by) AS ruled_by
               FROM mentions GROUP BY ALL))),
      marked AS (SELECT *, CASE WHEN ruled_by = 'rule_a' THEN '' WHEN ruled_by = 'rule_b' THEN 'Negated'
        WHEN negation <> 'Affirmed' THEN negation ELSE '' END AS ctx FROM numbered)
      SELECT doc_id, no AS line_no, 'T' || no || chr(9) || sty || ' ' || start_pos || ' ' || end_pos || chr(9) || str AS line
      FROM marked UNION ALL
      SELECT doc_id, no, 'A' || no || chr(9) || ctx || ' T' || no FROM marked WHERE ctx <> ''""",
)
def standoff_lines(t: Tables):
    one = t.mentions.groupBy("doc_id", "cui", "sty", "str", "start_pos", "end_pos").agg(
        F.min("negation").alias("negation"), F.min("ruled_by").alias("ruled_by")
    )
    lines = sinks.standoff_lines(one, positive_rule="rule_a", negation_rule="rule_b")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    "xml_lines", "SC18",
    r"""SELECT doc_id, no AS line_no, '<annotation><mention id="mention-' || doc_id || '-' || no || '" /><span start="' || start_pos
        || '" end="' || end_pos || '" /><spannedText>' || str || '</spannedText></annotation><classMention id="mention-'
        || doc_id || '-' || no || '"><mentionClass id="' || CASE WHEN negation <> 'Affirmed' THEN negation ELSE '' END
        || '_' || sty || '">' || str || '</mentionClass></classMention>' AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, cui) AS no FROM
            (SELECT doc_id, cui, sty, str, start_pos, end_pos, min(negation) AS negation FROM mentions GROUP BY ALL))""",
)
def xml_lines(t: Tables):
    one = t.mentions.groupBy("doc_id", "cui", "sty", "str", "start_pos", "end_pos").agg(F.min("negation").alias("negation"))
    return sinks.xml_lines(one).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "entity_types", "SC18",
    "SELECT DISTINCT replace(replace(sty, ' ', '_'), ',', '_') AS entity_type FROM tmentions",
)
def entity_types(t: Tables):
    return sinks.entity_types(t.text_mentions)


SKIP = ["red ring", "OLD ROD", "Blue Gizmo"]


@query(
    "skip_terms", "PF1",
    """SELECT doc_id, cui, str, CAST(count(*) AS BIGINT) AS n FROM mentions
       WHERE lower(str) NOT IN ('red ring', 'old rod', 'blue gizmo') GROUP BY doc_id, cui, str""",
)
def skip_terms(t: Tables):
    kept = filters.skip_terms(t.mentions, t.config([(s,) for s in SKIP], "term string"))
    return kept.groupBy("doc_id", "cui", "str").agg(F.count(F.lit(1)).alias("n"))


@query(
    "skip_terms_case", "PF1",
    "SELECT str, CAST(count(*) AS BIGINT) AS n FROM mentions WHERE str NOT IN ('red ring', 'OLD ROD', 'Blue Gizmo') GROUP BY str",
)
def skip_terms_case(t: Tables):
    kept = filters.skip_terms(t.mentions, t.config([(s,) for s in SKIP], "term string"), case_sensitive=True)
    return kept.groupBy("str").agg(F.count(F.lit(1)).alias("n"))


@query(
    "positive_context", "PF2",
    """SELECT cui, CAST(count(*) FILTER (WHERE negation = 'Affirmed' AND experiencer = 'Patient' AND temporality = 'Recent') AS BIGINT) AS strict,
       CAST(count(*) FILTER (WHERE negation = 'Affirmed' AND experiencer = 'Patient') AS BIGINT) AS lenient FROM mentions GROUP BY cui""",
)
def positive_context(t: Tables):
    return t.mentions.groupBy("cui").agg(
        F.count_if(cx.positive("strict")).alias("strict"), F.count_if(cx.positive("lenient")).alias("lenient")
    )


@query(
    "by_semantic_type", "PF3 X5",
    """SELECT doc_id, cui, start_pos FROM mentions WHERE sty IN ('PROMO', 'SMALL') AND negation = 'Affirmed'
       AND experiencer = 'Patient' AND ruled_by IS NULL""",
)
def by_semantic_type(t: Tables):
    return filters.by_semantic_type(t.mentions, ["PROMO", "SMALL"]).select("doc_id", "cui", "start_pos")


@query(
    "by_closure", "PF4",
    "SELECT doc_id, cui, start_pos FROM mentions WHERE cui IN (SELECT cui FROM closure WHERE name = 'S2')",
)
def by_closure(t: Tables):
    return filters.by_closure(t.mentions, t.closure.where("name = 'S2'")).select("doc_id", "cui", "start_pos")


@query(
    "document_field_filter", "PF5",
    "SELECT doc_id, pid FROM docs WHERE doc_type NOT IN ('5-LOW', '3-MEDIUM') AND src_table NOT IN ('P')",
)
def document_field_filter(t: Tables):
    excluded = {"doc_type": ["5-LOW", "3-MEDIUM"], "src_table": ["P"]}
    return filters.document_field_filter(t.docs, excluded).select("doc_id", "pid")


@query(
    "within_patient_window", "PF6",
    """SELECT d.doc_id, d.pid FROM docs d LEFT JOIN (SELECT w.* FROM windows w JOIN patients p ON w.pid = p.pid
       WHERE p.cohort <> 'BUILDING') w ON d.pid = w.pid WHERE w.t0 IS NULL OR d.doc_date BETWEEN w.t0 AND w.t1""",
)
def within_patient_window(t: Tables):
    # one cohort has no windows and keeps all documents
    known = t.windows.join(t.patients.where("cohort <> 'BUILDING'"), "pid", "left_semi")
    return filters.within_patient_window(t.docs, known).select("doc_id", "pid")


@query(
    "within_relative_window", "PF7 SF19",
    """SELECT d.doc_id, d.pid FROM docs d LEFT JOIN (SELECT i.* FROM index_dates i JOIN patients p ON i.pid = p.pid
       WHERE p.cohort <> 'BUILDING') i ON d.pid = i.pid WHERE i.index_date IS NULL OR d.doc_date BETWEEN i.index_date + INTERVAL 300 DAY - INTERVAL 365 DAY
             AND i.index_date + INTERVAL 300 DAY + INTERVAL 7 DAY""",
)
def within_relative_window(t: Tables):
    known = t.index_dates.join(t.patients.where("cohort <> 'BUILDING'"), "pid", "left_semi")
    later = known.withColumn("index_date", F.col("index_date") + F.expr("INTERVAL 300 DAYS"))
    return filters.within_relative_window(t.docs, later).select("doc_id", "pid")


@query(
    "only_validated_docs", "PF10",
    "SELECT doc_id, cui, start_pos FROM mentions WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def only_validated_docs(t: Tables):
    good = t.raw("labels").where("quality = 1")
    return filters.only_docs(t.mentions, good).select("doc_id", "cui", "start_pos")


@query(
    "cohort_filter", "PF11 J3 X4",
    """SELECT pid, CAST(count(*) AS BIGINT) AS n FROM docs WHERE pid IN (SELECT pid FROM patients WHERE cohort = 'BUILDING')
       AND src_table <> 'P' GROUP BY pid""",
)
def cohort_filter(t: Tables):
    building = t.patients.where("cohort = 'BUILDING'")
    kept = filters.cohort_filter(t.docs, building).transform(lambda d: d.where("src_table <> 'P'"))
    return kept.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "route_by_pattern", "PF12",
    """SELECT CASE WHEN regexp_matches(p_brand, '^Brand#1[0-4]') THEN 'low' WHEN regexp_matches(p_brand, '^Brand#1') THEN 'mid'
       WHEN regexp_matches(p_brand, '^.*#2.*') THEN 'high' END AS route, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1""",
)
def route_by_pattern(t: Tables):
    routes = [("Brand#1[0-4]", "low"), ("Brand#1", "mid"), (".*#2.*", "high")]
    route = filters.route_by_pattern("p_brand", routes)
    return t.raw("part").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("retain_concepts", "PF13", "SELECT name, cui FROM closure WHERE name IN ('S1', 'S4')")
def retain_concepts(t: Tables):
    return filters.retain_concepts(t.closure, ["S1", "S4"]).select("name", "cui")


@query("remove_concept", "PF13", "SELECT name, cui FROM closure WHERE name <> 'S1'")
def remove_concept(t: Tables):
    return filters.remove_concept(t.closure, "S1").select("name", "cui")


@query("skip_if_processed", "PF14", "SELECT doc_id, pid FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_if_processed(t: Tables):
    return filters.skip_if_processed(t.docs, t.raw("labels"), ["doc_id"]).select("doc_id", "pid")


CONCEPT_SEARCH = r"""SELECT ctx_id, cui, sty FROM (SELECT ctx_id, cui, min(str) AS label, min(sty) AS sty FROM typed GROUP BY ctx_id, cui)
       WHERE list_contains(regexp_extract_all(lower(label), '[\p{L}\p{N}]+'), 'ring') AND sty = 'SMALL'"""


def labelled_contexts(t: Tables):
    return summary.contexted_concepts(t.mentions.withColumn("pref", F.col("str")))


@query("search_concepts", "PF15", CONCEPT_SEARCH)
def search_concepts(t: Tables):
    return filters.search_concepts(labelled_contexts(t), "ring", sty="SMALL").select("ctx_id", "cui", "sty")


@query("search_concepts_page", "PF15 T5", CONCEPT_SEARCH + " ORDER BY ctx_id LIMIT 20 OFFSET 20")
def search_concepts_page(t: Tables):
    found = filters.search_concepts(labelled_contexts(t), "ring", sty="SMALL")
    return validation.page(found, ["ctx_id"], offset=20, size=20).select("ctx_id", "cui", "sty")
