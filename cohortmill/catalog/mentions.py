"""Joins and patient level aggregates over the mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog.base import WORDS_OF, query
from cohortmill.functions import context as cx
from cohortmill.operators import filters, joins, rules, summary, textmine, validation
from cohortmill.plans import semantic_search, study
from cohortmill.sources.tables import STUDY_NAMES, Tables, cui_of

STRICT = "negation = 'Affirmed' AND experiencer = 'Patient' AND temporality = 'Recent'"
LENIENT = "negation = 'Affirmed' AND experiencer = 'Patient'"


def wide(value: str, key: str = "concept", names=STUDY_NAMES) -> str:
    """SQL columns of a wide study table."""
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {key} = '{n}' THEN {value} END), 0) AS BIGINT) AS {n}" for n in names)


@query(
    "attach_patient", "J1",
    "SELECT m.doc_id, m.cui, m.start_pos, d.pid FROM mentions m JOIN docs d ON m.doc_id = d.doc_id",
)
def attach_patient(t: Tables):
    return joins.attach_patient(t.mentions, t.docs).select("doc_id", "cui", "start_pos", "pid")


@query("unmapped_docs", "J4", "SELECT DISTINCT doc_id FROM mentions WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_docs(t: Tables):
    return joins.unmapped_docs(t.mentions, t.raw("labels").select("doc_id"))


@query(
    "tag_study_concepts", "J2",
    """SELECT m.doc_id, m.cui, m.start_pos, c.names AS study_concepts FROM mentions m
       JOIN (SELECT cui, string_agg(name, ',' ORDER BY name) AS names FROM closure GROUP BY cui) c ON m.cui = c.cui""",
)
def tag_study_concepts(t: Tables):
    tagged = joins.tag_study_concepts(t.mentions, t.closure)
    return tagged.select("doc_id", "cui", "start_pos", F.array_join("study_concepts", ",").alias("study_concepts"))


@query(
    "restrict_to_patients", "J3",
    """SELECT d.pid, CAST(count(*) AS BIGINT) AS n FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
       JOIN patients p ON d.pid = p.pid WHERE p.cohort = 'MACHINERY' GROUP BY d.pid""",
)
def restrict_to_patients(t: Tables):
    machinery = t.patients.where("cohort = 'MACHINERY'")
    counts = summary.patient_concept_counts(t.mentions, t.docs)
    return filters.cohort_filter(counts, machinery).groupBy("pid").agg(F.sum("freq").alias("n"))


@query(
    "episode_windows", "J7",
    """SELECT d.pid AS ep_id, d.pid, w.win, m.sty AS concept, CAST(count(*) AS BIGINT) AS n FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
       JOIN index_dates i ON d.pid = i.pid CROSS JOIN (VALUES ('win1', 0, 90), ('win2', 60, 365), ('win3', 366, 800)) AS w(win, a, b)
       WHERE d.doc_date BETWEEN i.index_date + to_days(w.a) AND i.index_date + to_days(w.b) AND m.negation = 'Affirmed'
         AND m.experiencer = 'Patient' AND m.temporality = 'Recent' GROUP BY ALL""",
)
def episode_windows(t: Tables):
    def day(n: int):
        return F.col("index_date") + F.expr(f"INTERVAL {n} DAYS")

    episodes = t.index_dates.select(
        F.col("pid").alias("ep_id"), "pid", day(0).alias("win1_s"), day(90).alias("win1_e"), day(60).alias("win2_s"),
        day(365).alias("win2_e"), day(366).alias("win3_s"), day(800).alias("win3_e"),
    )
    positive = t.mentions.where(cx.positive("strict"))
    per_doc = positive.groupBy("doc_id", F.col("sty").alias("concept")).agg(F.count("*").alias("n"))
    dated = per_doc.join(t.docs, "doc_id").groupBy("pid", "doc_date", "concept").agg(F.sum("n").alias("n"))
    return joins.episode_windows(dated, episodes, names=["win1", "win2", "win3"])


@query(
    "feedback_details", "J9",
    """SELECT f.doc_id, f.start_pos, f.end_pos, f.label, f.annotator, a.cui, d.pid AS patient_id FROM feedback f
       LEFT JOIN (SELECT doc_id, start_pos, min(cui) AS cui FROM mentions WHERE ruled_by IS NULL GROUP BY ALL) a
         ON f.doc_id = a.doc_id AND f.start_pos = a.start_pos
       LEFT JOIN (SELECT * FROM docs WHERE src_table <> 'P') d ON f.doc_id = d.doc_id""",
)
def feedback_details(t: Tables):
    anns = t.mentions.where("ruled_by IS NULL").groupBy("doc_id", "start_pos").agg(F.min("cui").alias("cui"))
    rows = joins.feedback_details(t.feedback, anns, t.docs.where("src_table <> 'P'"))
    return rows.select("doc_id", "start_pos", "end_pos", "label", "annotator", "cui", "patient_id")


@query(
    "complete_samples", "J10",
    """SELECT s.doc_id, s.start_pos, s.end_pos, s.cui, a.str, a.confidence FROM
       (SELECT DISTINCT doc_id, start_pos, end_pos, cui FROM mentions) s
       LEFT JOIN (SELECT doc_id, start_pos, end_pos, cui, min(str) AS str, max(CASE WHEN ruled_by IS NULL THEN 1 ELSE 0 END) AS confidence
                  FROM mentions WHERE sty <> 'SMALL' GROUP BY ALL) a USING (doc_id, start_pos, end_pos, cui)""",
)
def complete_samples(t: Tables):
    samples = t.mentions.select("doc_id", "start_pos", "end_pos", "cui").distinct()
    anns = t.mentions.where("sty <> 'SMALL'").withColumn("confidence", F.col("ruled_by").isNull().cast("int"))
    return joins.complete_samples(samples, anns)


LAB_MAP = [("SMALL", "click"), ("LARGE", "view"), ("PROMO", "error"), ("MEDIUM", "signup"), ("ECONOMY", "none")]


@query(
    "verify_measurements", "J11",
    """WITH measures AS (SELECT d.pid, m.sty AS name, max(CAST(floor(m.start_pos / 20) AS BIGINT)) AS value FROM mentions m
         JOIN docs d ON m.doc_id = d.doc_id GROUP BY d.pid, m.sty),
       map(name, label) AS (VALUES ('SMALL','click'), ('LARGE','view'), ('PROMO','error'), ('MEDIUM','signup'), ('ECONOMY','none')),
       labs AS (SELECT DISTINCT pid, concept AS label, value FROM evs),
       judged AS (SELECT m.name, EXISTS (SELECT 1 FROM labs l WHERE l.pid = m.pid AND l.label = p.label AND l.value = m.value) AS ok
         FROM measures m JOIN map p ON m.name = p.name WHERE EXISTS (SELECT 1 FROM labs l WHERE l.pid = m.pid AND l.label = p.label))
       SELECT name, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS incorrect
       FROM judged GROUP BY name""",
)
def verify_measurements(t: Tables):
    per_doc = t.mentions.groupBy("doc_id", F.col("sty").alias("name")).agg(
        F.max(F.floor(F.col("start_pos") / 20)).alias("value")
    )
    measures = summary.with_patient(per_doc, t.docs).groupBy("pid", "name").agg(F.max("value").alias("value"))
    labs = t.events.select("pid", F.col("concept").alias("label"), "value")
    return joins.verify_measurements(measures, labs, t.config(LAB_MAP, "name string, label string"))


MODEL = [
    ("D1", "HP:1", "thatin"), ("D1", "HP:2", "ononst"), ("D1", "HP:9", "the in"),
    ("D2", "HP:3", "inoran"), ("D2", "HP:8", "wasthe unseen"), ("D2", "HP:7", "and that"),
]
PHENOTYPE_MAP = [("HP:1", "C9000001"), ("HP:2", "C9000002"), ("HP:3", "C9000003")]
FALLBACK = [("HP:9", "the in", 2), ("HP:8", "wasthe unseen", 0), ("HP:7", "and that", 3)]


@query(
    "disease_model_match", "J14",
    r"""WITH model(disease, id, label) AS (VALUES ('D1','HP:1','thatin'), ('D1','HP:2','ononst'), ('D1','HP:9','the in'),
         ('D2','HP:3','inoran'), ('D2','HP:8','wasthe unseen'), ('D2','HP:7','and that')),
       map(id, cui) AS (VALUES ('HP:1','C9000001'), ('HP:2','C9000002'), ('HP:3','C9000003')),
       freq AS (SELECT d.source AS pid, p.id, count(*) AS freq FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id
         JOIN map p ON m.cui = p.cui GROUP BY ALL),
       w AS (SELECT doc_id, source AS pid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w,
             generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM documents),
       near AS (SELECT DISTINCT 'HP:9' AS id, a.pid, a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i - a.i - 1 BETWEEN -2 AND 2
           WHERE a.w = 'the' AND b.w = 'in'
         UNION SELECT DISTINCT 'HP:8', a.pid, a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i - a.i - 1 = 0 WHERE a.w = 'wasthe' AND b.w = 'unseen'
         UNION SELECT DISTINCT 'HP:7', a.pid, a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i - a.i - 1 BETWEEN -3 AND 3
           WHERE a.w = 'and' AND b.w = 'that'),
       found AS (SELECT id, pid, count(*) AS n FROM near GROUP BY id, pid)
       SELECT p.pid, m.disease, m.id, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq,
         CAST(CASE WHEN f.freq IS NULL THEN coalesce(s.n, 0) ELSE 0 END AS BIGINT) AS searched
       FROM (SELECT DISTINCT source AS pid FROM documents) p CROSS JOIN model m
       LEFT JOIN freq f ON f.pid = p.pid AND f.id = m.id LEFT JOIN found s ON s.pid = p.pid AND s.id = m.id""",
)
def disease_model_match(t: Tables):
    counts = summary.patient_concept_counts(t.text_mentions, t.text_docs)
    phen = counts.join(t.config(PHENOTYPE_MAP, "id string, cui string"), "cui").select("pid", "id", "freq")
    table = joins.disease_model_match(phen, MODEL, t.text_docs.select("pid").distinct())
    searched = textmine.phrase_counts(t.text_docs, FALLBACK, key="pid").withColumnRenamed("n", "searched")
    full = table.join(searched, ["pid", "id"], "left")
    return full.select(
        "pid", "disease", "id", F.coalesce("freq", F.lit(0)).alias("freq"),
        F.when(F.col("freq").isNull(), F.coalesce("searched", F.lit(0))).otherwise(0).alias("searched"),
    )


@query(
    "matrix_by_any_concept", "J19",
    f"""SELECT p.pid, {', '.join(f"max(CASE WHEN c.name = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in STUDY_NAMES)}
       FROM patients p LEFT JOIN docs d ON p.pid = d.pid AND d.doc_type IN ('1-URGENT', '2-HIGH')
       LEFT JOIN mentions m ON m.doc_id = d.doc_id LEFT JOIN closure c ON m.cui = c.cui GROUP BY p.pid""",
)
def matrix_by_any_concept(t: Tables):
    part = t.docs.where("doc_type IN ('1-URGENT', '2-HIGH')")
    seen = summary.with_patient(summary.doc_concepts(t.mentions), part).select("pid", "cui")
    return joins.matrix_by_any_concept(seen, t.closure, t.patients, names=STUDY_NAMES)


LABELS = [f"{a} {b}" for a in ("blue", "cold", "hot", "red") for b in ("bolt", "ring")]
LABEL_COLUMNS = [n.replace(" ", "_") for n in LABELS]


@query(
    "patient_concept_matrix", "A1 T1 SF21",
    f"""WITH x AS (SELECT DISTINCT d.pid, m.doc_id, replace(m.str, ' ', '_') AS concept FROM mentions m JOIN docs d ON m.doc_id = d.doc_id)
       SELECT p.pid, {wide('1', names=LABEL_COLUMNS)} FROM patients p LEFT JOIN x ON x.pid = p.pid GROUP BY p.pid""",
)
def patient_concept_matrix(t: Tables):
    labels = t.labels.withColumn("label", F.replace("label", F.lit(" "), F.lit("_")))
    return summary.patient_concept_matrix(t.mentions, t.docs, t.patients, labels, names=LABEL_COLUMNS)


@query(
    "patient_concept_long", "A1",
    "SELECT d.pid, m.cui, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS n_docs FROM mentions m JOIN docs d ON m.doc_id = d.doc_id GROUP BY ALL",
)
def patient_concept_long(t: Tables):
    return summary.with_patient(summary.doc_concepts(t.mentions), t.docs).groupBy("pid", "cui").agg(
        F.count("*").alias("n_docs")
    )


@query(
    "patient_study_matrix", "A2",
    """SELECT d.pid, c.name || '(' || s.n || ')' AS header, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS n_docs
       FROM mentions m JOIN docs d ON m.doc_id = d.doc_id JOIN closure c ON m.cui = c.cui
       JOIN (SELECT name, count(*) AS n FROM closure GROUP BY name) s ON s.name = c.name GROUP BY ALL""",
)
def patient_study_matrix(t: Tables):
    counts = summary.study_counts(t.mentions, t.docs, t.closure)
    headers = summary.closure_headers(t.closure)
    return counts.join(headers, F.col("concept") == F.col("name")).select(
        "pid", "header", F.col("docs").alias("n_docs")
    )


@query(
    "study_table_doc_count", "A3",
    f"""WITH x AS (SELECT DISTINCT d.pid, m.doc_id, c.name AS concept FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
         JOIN exclusive c ON m.cui = c.cui WHERE m.ruled_by IS NULL AND {STRICT})
       SELECT p.pid, {wide('1')} FROM patients p LEFT JOIN x ON x.pid = p.pid GROUP BY p.pid""",
)
def study_table_doc_count(t: Tables):
    kept = t.mentions.where(F.col("ruled_by").isNull() & cx.positive("strict"))
    return summary.study_table(kept, t.docs, t.exclusive, t.patients, names=STUDY_NAMES)


@query(
    "study_table_mention_count", "A4",
    f"""WITH x AS (SELECT d.pid, c.name AS concept FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
         JOIN closure c ON m.cui = c.cui WHERE m.ruled_by IS NULL)
       SELECT p.pid, {wide('1')} FROM patients p LEFT JOIN x ON x.pid = p.pid GROUP BY p.pid""",
)
def study_table_mention_count(t: Tables):
    kept = t.mentions.where("ruled_by IS NULL")
    return summary.study_table(kept, t.docs, t.closure, t.patients, names=STUDY_NAMES, count="mentions")


@query(
    "ruled_breakdown_log", "A5",
    """SELECT d.pid, m.doc_id, m.start_pos, m.end_pos, m.cui, m.str, m.ruled_by FROM mentions m
       JOIN docs d ON m.doc_id = d.doc_id WHERE m.ruled_by IS NOT NULL""",
)
def ruled_breakdown_log(t: Tables):
    return summary.ruled_log(t.mentions, t.docs)


ACCEPTED = f"""SELECT {{grp}} AS grp, d.pid, c.name AS concept,
       CAST(count(*) FILTER (WHERE m.ruled_by IS NULL AND {LENIENT}) AS BIGINT) AS f,
       CAST(count(*) FILTER (WHERE NOT (m.ruled_by IS NULL AND {LENIENT})) AS BIGINT) AS rf,
       CAST(count(DISTINCT CASE WHEN m.ruled_by IS NULL AND {LENIENT} THEN m.doc_id END) AS BIGINT) AS docs
       FROM mentions m JOIN docs d ON m.doc_id = d.doc_id JOIN exclusive c ON m.cui = c.cui GROUP BY ALL"""


@query("positive_vs_ruled", "A6", ACCEPTED.format(grp="''"))
def positive_vs_ruled(t: Tables):
    return summary.accepted_or_ruled(t.mentions, t.docs, t.exclusive)


@query("positive_vs_ruled_grouped", "A6", ACCEPTED.format(grp="d.doc_type"))
def positive_vs_ruled_grouped(t: Tables):
    return summary.accepted_or_ruled(t.mentions, t.docs, t.exclusive, group=F.col("doc_type"))


TYPED = ", ".join(f'CAST(count(*) FILTER (WHERE m.type = \'{n}\') AS BIGINT) AS "{n}"' for n in cx.SUMMARY_TYPES)


@query(
    "typed_mention_summary", "A7",
    f"""SELECT p.pid, CAST(count(m.doc_id) AS BIGINT) AS "all", {TYPED}, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS docs
       FROM patients p LEFT JOIN docs d ON d.pid = p.pid LEFT JOIN (SELECT * FROM typed WHERE cui IN (SELECT cui FROM closure)) m
         ON m.doc_id = d.doc_id GROUP BY p.pid""",
)
def typed_mention_summary(t: Tables):
    return summary.typed_summary(t.mentions, t.docs, t.closure, patients=t.patients)


@query(
    "typed_summary_with_hooks", "A7 X1 X2",
    f"""SELECT d.pid, CAST(count(*) AS BIGINT) AS "all", {TYPED}, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS docs,
       strftime(min(CASE WHEN m.type = 'positive' THEN d.doc_date END), '%Y-%m-%d') AS first_pos
       FROM typed m JOIN docs d ON m.doc_id = d.doc_id WHERE d.doc_type <> '5-LOW' GROUP BY d.pid""",
)
def typed_summary_with_hooks(t: Tables):
    first = F.date_format(F.min(F.when(F.col("type") == "positive", F.col("doc_date"))), "yyyy-MM-dd")
    return summary.typed_summary(
        t.mentions, t.docs, predicate=F.col("doc_type") != "5-LOW", extra_aggs=[first.alias("first_pos")]
    )


APPEARANCES = """apps AS (SELECT cui, doc_id, start_pos, end_pos, min(ui_type) AS ui_type, max(ruled_by) AS ruled_by FROM typed
       {where} GROUP BY cui, doc_id, start_pos, end_pos)"""
UI = ", ".join(
    f"CAST(count(*) FILTER (WHERE a.ruled_by IS NULL AND a.ui_type = '{n}') AS BIGINT) AS \"{n}\"" for n in cx.UI_TYPES
)


@query(
    "typed_mention_summary_ui", "A8 SF3",
    f"""WITH {APPEARANCES.format(where='')} SELECT d.pid, CAST(count(*) AS BIGINT) AS "allM", {UI},
       CAST(count(*) FILTER (WHERE a.ruled_by IS NOT NULL) AS BIGINT) AS ruled FROM apps a JOIN docs d ON a.doc_id = d.doc_id GROUP BY d.pid""",
)
def typed_mention_summary_ui(t: Tables):
    return summary.typed_summary_ui(t.mentions, t.docs)


@query(
    "patient_concept_counts", "A9",
    "SELECT d.pid, m.cui, CAST(count(*) AS BIGINT) AS freq FROM mentions m JOIN docs d ON m.doc_id = d.doc_id GROUP BY ALL",
)
def patient_concept_counts(t: Tables):
    return summary.patient_concept_counts(t.mentions, t.docs)


@query("concept_labels", "A9", "SELECT cui, min(pref) AS pref FROM mentions GROUP BY cui")
def concept_labels(t: Tables):
    return summary.concept_labels(t.mentions)


EDGES = """graph AS (SELECT d.pid, m.cui, count(*) AS freq FROM mentions m JOIN docs d ON m.doc_id = d.doc_id GROUP BY ALL),
       lab AS (SELECT cui, min(str) AS label FROM mentions GROUP BY cui),
       g AS (SELECT pid, label, CAST(freq AS BIGINT) AS freq FROM graph JOIN lab USING (cui))"""


def graph_edges(t: Tables):
    named = t.mentions.withColumn("pref", F.col("str"))
    return summary.bipartite_edges(summary.patient_concept_counts(named, t.docs), summary.concept_labels(named))


@query("bipartite_edges", "A10", f"WITH {EDGES} SELECT pid, label, freq FROM g")
def bipartite_edges(t: Tables):
    return graph_edges(t)


@query(
    "bipartite_topk", "A11",
    f"""WITH {EDGES}, r AS (SELECT label FROM g WHERE label NOT IN ('red ring', 'hot rod') GROUP BY label ORDER BY count(*) DESC, label LIMIT 30),
       k AS (SELECT * FROM g WHERE label IN (SELECT label FROM r)),
       l AS (SELECT pid FROM k GROUP BY pid ORDER BY count(*) DESC, pid LIMIT 20)
       SELECT CASE WHEN pid IN (SELECT pid FROM l) THEN CAST(pid AS VARCHAR) ELSE 'others' END AS pid, label, freq FROM k""",
)
def bipartite_topk(t: Tables):
    return summary.bipartite_topk(graph_edges(t), left_k=20, right_k=30, ignore=["red ring", "hot rod"])


@query(
    "semantic_type_histogram", "A20",
    """WITH own AS (SELECT sty, cui, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY sty, cui)
       SELECT sty, cui, n FROM own UNION ALL SELECT 'HPO', cui, CAST(sum(n) AS BIGINT) FROM own WHERE cui IN
         (SELECT printf('C%07d', p_partkey) FROM part WHERE p_size < 20) GROUP BY cui""",
)
def semantic_type_histogram(t: Tables):
    mapped = t.raw("part").where("p_size < 20").select("p_partkey")
    return summary.semantic_type_histogram(t.mentions, mapped.select(cui_of("p_partkey").alias("cui")))


@query(
    "cohort_concept_list", "A37",
    """SELECT sty, cui, CAST(count(*) AS BIGINT) AS n FROM mentions WHERE sty = 'PROMO' GROUP BY sty, cui ORDER BY n DESC, cui LIMIT 20""",
)
def cohort_concept_list(t: Tables):
    own = t.mentions.groupBy("sty", "cui").agg(F.count("*").alias("n"))
    return summary.cohort_concept_list(own, "PROMO")


TFIDF = """WITH c AS (SELECT d.pid, m.cui, count(*) AS freq FROM mentions m JOIN docs d ON m.doc_id = d.doc_id GROUP BY ALL),
       t AS (SELECT cui, sum(freq) AS freq, count(*) AS df FROM c WHERE cui NOT IN (SELECT cui FROM closure WHERE name = 'S2') GROUP BY cui)
       SELECT cui, CAST(freq AS BIGINT) AS freq, CAST(df AS BIGINT) AS df,
       round(freq * ln((SELECT count(DISTINCT pid) FROM c) / CAST(df AS DOUBLE)), 6) AS score FROM t"""


def other_scores(t: Tables):
    # the heaviest join runs once; the patients are counted on what it wrote
    counts = scale.cut(summary.patient_concept_counts(t.mentions, t.docs))
    n = counts.select("pid").distinct().count()
    scored = summary.other_concept_scores(counts, t.closure.where("name = 'S2'"), n)
    return scored.withColumn("score", F.round("score", 6))


@query("tfidf_other_concepts", "A21", TFIDF)
def tfidf_other_concepts(t: Tables):
    return other_scores(t)


@query("top_other_concepts", "T2", f"SELECT * FROM ({TFIDF}) ORDER BY score DESC, cui LIMIT 10")
def top_other_concepts(t: Tables):
    return other_scores(t).orderBy(F.desc("score"), "cui").limit(10)


@query("patient_page", "T5", "SELECT pid, cohort FROM patients ORDER BY pid LIMIT 25 OFFSET 50")
def patient_page(t: Tables):
    return validation.page(t.patients, ["pid"], offset=50, size=25)


@query(
    "first_positive_time", "A24",
    """SELECT d.pid, strftime(min(d.doc_date), '%Y-%m-%d') AS first_pos FROM docs d
       WHERE d.doc_id IN (SELECT doc_id FROM typed WHERE type = 'positive') GROUP BY d.pid""",
)
def first_positive_time(t: Tables):
    return summary.first_positive_time(t.mentions, t.docs).withColumn("first_pos", F.date_format("first_pos", "yyyy-MM-dd"))


@query(
    "merge_patient_results", "A25 SF21",
    """WITH a AS (SELECT d.pid, count(*) AS v FROM mentions m JOIN docs d ON m.doc_id = d.doc_id WHERE m.cui IN (SELECT cui FROM closure WHERE name = 'S2') GROUP BY d.pid),
       b AS (SELECT d.pid, count(*) AS v FROM mentions m JOIN docs d ON m.doc_id = d.doc_id WHERE m.cui IN (SELECT cui FROM closure WHERE name = 'S5') GROUP BY d.pid)
       SELECT p.pid, coalesce(CAST(a.v AS VARCHAR), '-') AS first_set, coalesce(CAST(b.v AS VARCHAR), '-') AS second_set
       FROM patients p LEFT JOIN a ON a.pid = p.pid LEFT JOIN b ON b.pid = p.pid""",
)
def merge_patient_results(t: Tables):
    def total(name: str):
        hits = filters.by_closure(t.mentions, t.closure.where(F.col("name") == name))
        return summary.patient_concept_counts(hits, t.docs).groupBy("pid").agg(F.sum("freq").alias("value"))

    return summary.merge_patient_results(t.patients, {"first_set": total("S2"), "second_set": total("S5")})


@query(
    "patient_entities", "A26",
    """SELECT d.pid, CAST(count(*) AS BIGINT) AS anns, CAST(count(DISTINCT m.ctx_id) AS BIGINT) AS concepts,
       CAST(count(DISTINCT m.doc_id) AS BIGINT) AS docs FROM typed m JOIN docs d ON m.doc_id = d.doc_id GROUP BY d.pid""",
)
def patient_entities(t: Tables):
    entities = summary.build_patient_entities(t.mentions, t.docs)
    flat = entities.select("pid", F.explode("anns").alias("a"))
    # counted by each key alone, so that no row travels with both
    seen = flat.groupBy("pid", "a.ctx_id").agg(F.count("*").alias("n"))
    per_concept = seen.groupBy("pid").agg(F.sum("n").alias("anns"), F.count("ctx_id").alias("concepts"))
    docs = flat.select("pid", "a.doc_id").distinct().groupBy("pid").agg(F.count("doc_id").alias("docs"))
    return per_concept.join(docs, "pid")


@query(
    "patient_articles", "A26",
    """WITH a AS (SELECT doc_id, count(*) AS n, md5(string_agg(cui || ':' || start_pos || ':' || end_pos, ',' ORDER BY start_pos, end_pos, cui)) AS mark
         FROM tmentions GROUP BY doc_id)
       SELECT d.source AS pid, d.doc_id, md5(d.text) AS article, CAST(coalesce(a.n, 0) AS BIGINT) AS anns, a.mark
       FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
)
def patient_articles(t: Tables):
    """The entities of all patients, unfolded: each article with the annotations of its document."""
    docs = t.text_docs.select("doc_id", "pid")
    mentions = t.text_mentions.withColumn("ruled_by", F.lit(None).cast("string"))
    articles = t.text_docs.select("pid", "doc_id", "text")
    entities = scale.cut(summary.build_patient_entities(mentions, docs, articles))
    texts = entities.select("pid", F.inline("articles")).select("pid", "doc_id", F.md5("text").alias("article"))
    places = F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "cui")))
    anns = entities.select("pid", F.inline("anns")).groupBy("pid", "doc_id").agg(F.count("*").alias("anns"), places.alias("places"))
    mark = F.md5(F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["cui"], p["start_pos"], p["end_pos"])), ","))
    rows = texts.join(anns.withColumn("mark", mark).drop("places"), ["pid", "doc_id"], "left")
    return rows.withColumn("anns", F.coalesce("anns", F.lit(0).cast("long")))


@query(
    "contexted_concept_dim", "A27 SF1",
    "SELECT cui, negation, experiencer, temporality, min(pref) AS pref, min(sty) AS sty, ctx_id FROM typed GROUP BY ALL",
)
def contexted_concept_dim(t: Tables):
    return summary.contexted_concepts(t.mentions)


CURATED = """named AS (SELECT printf('C%07d', p_partkey) AS cui, p_brand AS concept,
         CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INT) % 2 = 0 THEN 'correct' ELSE 'wrong' END AS verdict FROM part
         UNION ALL SELECT 'C9999999', 'Never seen', 'correct'),
       m1 AS (SELECT d.pid, n.concept, max(CASE WHEN n.verdict = 'correct' THEN 1 ELSE 0 END) AS curated, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS n_docs
         FROM mentions m JOIN docs d ON m.doc_id = d.doc_id JOIN named n ON m.cui = n.cui GROUP BY d.pid, n.concept)"""


def curated(t: Tables):
    mapping = t.raw("part").select(F.col("p_brand").alias("concept"), cui_of("p_partkey").alias("cui"))
    mapping = mapping.unionByName(t.config([("Never seen", "C9999999")], "concept string, cui string"))
    number = F.try_to_number(F.replace("concept", F.lit("Brand#"), F.lit("")), F.lit("999")).cast("int")
    verdicts = mapping.select("concept").distinct().withColumn(
        "verdict", F.when(F.coalesce(number % 2, F.lit(0)) == 0, "correct").otherwise("wrong")
    )
    return mapping, summary.curated_concept_matrix(t.mentions, t.docs, t.patients, mapping, verdicts)


@query("curated_concept_matrix", "A28", f"WITH {CURATED} SELECT pid, concept, curated, n_docs FROM m1")
def curated_concept_matrix(t: Tables):
    return curated(t)[1]


@query(
    "curated_totals", "A28",
    f"""WITH {CURATED} SELECT p.pid, p.cohort, CAST(coalesce(sum(m.n_docs), 0) AS BIGINT) AS "any",
       CAST(coalesce(sum(CASE WHEN m.curated = 1 THEN m.n_docs END), 0) AS BIGINT) AS curated,
       CAST(coalesce(sum(CASE WHEN m.curated = 0 THEN m.n_docs END), 0) AS BIGINT) AS not_curated
       FROM patients p LEFT JOIN m1 m ON m.pid = p.pid GROUP BY p.pid, p.cohort""",
)
def curated_totals(t: Tables):
    return summary.curated_totals(curated(t)[1], t.patients)


@query(
    "empty_concepts", "A28",
    f"WITH {CURATED} SELECT DISTINCT concept FROM named EXCEPT SELECT concept FROM m1",
)
def empty_concepts(t: Tables):
    return summary.empty_concepts(curated(t)[0], t.mentions)


@query(
    "weighted_typed_features", "A29",
    """WITH s AS (SELECT d.pid, m.ui_type, (m.start_pos % 100) AS c FROM typed m JOIN docs d ON m.doc_id = d.doc_id)
       SELECT pid, CAST(count(*) FILTER (WHERE ui_type = 'posM' AND c >= 70) AS BIGINT) AS "posM",
       CAST(count(*) FILTER (WHERE ui_type = 'hisM' AND c >= 70) AS BIGINT) AS "hisM",
       CAST(count(*) FILTER (WHERE ui_type = 'negM' AND c >= 70) AS BIGINT) AS "negM",
       CAST(count(*) FILTER (WHERE ui_type = 'otherM' AND c >= 70) AS BIGINT) AS "otherM",
       CAST(count(*) FILTER (WHERE c >= 70) AS BIGINT) AS total FROM s GROUP BY pid""",
)
def weighted_typed_features(t: Tables):
    scored = joins.attach_patient(t.mentions, t.docs).select(
        "pid", cx.ctx_class_ui().alias("type"), (F.col("start_pos") % 100).alias("confidence")
    )
    table = summary.weighted_typed_features(scored, threshold=70)
    return table.select("pid", *[F.col(c).cast("long").alias(c) for c in [*cx.UI_TYPES, "total"]])


@query(
    "weighted_sum_features", "A29",
    """SELECT d.pid, CAST(sum(CASE WHEN m.ui_type = 'posM' THEN m.start_pos % 100 ELSE 0 END) AS BIGINT) AS "posM",
       CAST(sum(CASE WHEN m.ui_type = 'hisM' THEN m.start_pos % 100 ELSE 0 END) AS BIGINT) AS "hisM",
       CAST(sum(m.start_pos % 100) AS BIGINT) AS total FROM typed m JOIN docs d ON m.doc_id = d.doc_id GROUP BY d.pid""",
)
def weighted_sum_features(t: Tables):
    scored = joins.attach_patient(t.mentions, t.docs).select(
        "pid", cx.ctx_class_ui().alias("type"), (F.col("start_pos") % 100).alias("confidence")
    )
    table = summary.weighted_typed_features(scored, mode="weighted_sum")
    return table.select("pid", *[F.col(c).cast("long").alias(c) for c in ["posM", "hisM", "total"]])


@query(
    "doc_flags", "A35",
    "SELECT doc_id, pid, doc_id IN (SELECT doc_id FROM mentions WHERE sty = 'LARGE') AS matched FROM docs",
)
def doc_flags(t: Tables):
    return summary.doc_flags(t.docs, t.mentions.where("sty = 'LARGE'")).select("doc_id", "pid", "matched")


@query(
    "doc_summary_of_patient", "A35",
    """SELECT pid, CAST(count(*) AS BIGINT) AS total_docs,
       CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM mentions WHERE sty = 'LARGE')) AS BIGINT) AS matched_docs,
       arg_max(doc_id, (doc_date, doc_id)) FILTER (WHERE doc_type = '2-HIGH') AS summary_doc FROM docs GROUP BY pid""",
)
def doc_summary_of_patient(t: Tables):
    return summary.doc_summary(t.docs, t.mentions.where("sty = 'LARGE'"), summary_type="2-HIGH")


@query(
    "feedback_agreement", "A36",
    """SELECT d.pid, s.ui_type AS type, CAST(count(*) FILTER (WHERE f.label = s.ui_type) AS BIGINT) AS correct,
       CAST(count(*) FILTER (WHERE f.label <> s.ui_type) AS BIGINT) AS wrong
       FROM (SELECT DISTINCT doc_id, start_pos, end_pos, ui_type FROM typed) s JOIN feedback f USING (doc_id, start_pos, end_pos)
       JOIN docs d ON s.doc_id = d.doc_id GROUP BY d.pid, s.ui_type""",
)
def feedback_agreement(t: Tables):
    return summary.feedback_agreement(t.mentions, t.docs, t.feedback)


@query(
    "union_doc_sources", "U1",
    """SELECT doc_id, pid, strftime(doc_date, '%Y-%m-%d') AS day FROM docs WHERE src_table = 'F'
       UNION ALL SELECT doc_id, pid, strftime(doc_date, '%Y-%m-%d') FROM docs WHERE src_table IN ('O', 'F')""",
)
def union_doc_sources(t: Tables):
    rows = t.docs.select("doc_id", "pid", F.date_format("doc_date", "yyyy-MM-dd").alias("day"), "src_table")
    first, second = rows.where("src_table = 'F'"), rows.where("src_table IN ('O', 'F')")
    return first.unionByName(second).drop("src_table")


@query(
    "distinct_entities", "U5",
    """SELECT 'patients' AS kind, CAST(count(DISTINCT d.pid) AS BIGINT) AS n FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
       UNION ALL SELECT 'docs', CAST(count(DISTINCT doc_id) AS BIGINT) FROM mentions
       UNION ALL SELECT 'concepts', CAST(count(DISTINCT cui) AS BIGINT) FROM mentions""",
)
def distinct_entities(t: Tables):
    seen = t.mentions.select("doc_id").distinct()
    parts = {
        "patients": seen.join(t.docs, "doc_id").select("pid").distinct(),
        "docs": seen,
        "concepts": t.mentions.select("cui").distinct(),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "collected_fields", "X3",
    "SELECT DISTINCT doc_id, cui, type FROM typed WHERE type <> 'Other'",
)
def collected_fields(t: Tables):
    fields = ["doc_id", "cui", cx.ctx_class().alias("type")]
    return t.mentions.where(cx.ctx_class() != "Other").select(*fields).distinct()


@query(
    "study_run", "N14",
    f"""WITH x AS (SELECT DISTINCT d.pid, m.doc_id, c.name AS concept FROM mentions m JOIN docs d ON m.doc_id = d.doc_id
         JOIN exclusive c ON m.cui = c.cui WHERE m.ruled_by IS NULL)
       SELECT p.pid, {wide('1')} FROM patients p LEFT JOIN x ON x.pid = p.pid GROUP BY p.pid""",
)
def study_run(t: Tables):
    return study.run_study(t.mentions, t.docs, t.exclusive, t.patients, names=STUDY_NAMES).matrix


@query(
    "study_samples", "N14 W5",
    """SELECT concept, doc_id, start_pos, end_pos, cui FROM (SELECT c.name AS concept, m.*, row_number() OVER (PARTITION BY c.name
         ORDER BY md5(concat_ws('|', '7', CAST(m.doc_id AS VARCHAR), CAST(m.start_pos AS VARCHAR), CAST(m.end_pos AS VARCHAR), m.cui)),
           m.doc_id, m.start_pos, m.end_pos, m.cui) AS rn
         FROM mentions m JOIN exclusive c ON m.cui = c.cui WHERE m.ruled_by IS NULL) WHERE rn <= 20""",
)
def study_samples(t: Tables):
    result = study.run_study(t.mentions, t.docs, t.exclusive, t.patients, names=STUDY_NAMES, seed="7")
    return result.samples.select("concept", "doc_id", "start_pos", "end_pos", "cui")


SEARCHED = f"""cc AS (SELECT DISTINCT cui FROM typed WHERE list_contains(regexp_extract_all(lower(str), {WORDS_OF}), 'ring') AND {STRICT}),
       {APPEARANCES.format(where='WHERE cui IN (SELECT cui FROM cc)')}"""


@query(
    "semantic_search", "N15",
    f"""WITH {SEARCHED} SELECT d.pid, CAST(count(*) AS BIGINT) AS "allM", {UI},
       CAST(count(*) FILTER (WHERE a.ruled_by IS NOT NULL) AS BIGINT) AS ruled FROM apps a JOIN docs d ON a.doc_id = d.doc_id GROUP BY d.pid""",
)
def semantic_search_summary(t: Tables):
    named = t.mentions.withColumn("pref", F.col("str"))
    return semantic_search.semantic_search("ring", named, t.docs).typed_summary


@query(
    "semantic_search_others", "N15 A21",
    f"""WITH {SEARCHED}, pp AS (SELECT DISTINCT d.pid FROM apps a JOIN docs d ON a.doc_id = d.doc_id),
       c AS (SELECT d.pid, m.cui, count(*) AS freq FROM mentions m JOIN docs d ON m.doc_id = d.doc_id WHERE d.pid IN (SELECT pid FROM pp) GROUP BY ALL)
       SELECT cui, CAST(sum(freq) AS BIGINT) AS freq, CAST(count(*) AS BIGINT) AS df,
         round(sum(freq) * ln((SELECT count(*) FROM pp) / CAST(count(*) AS DOUBLE)), 6) AS score
       FROM c WHERE cui NOT IN (SELECT cui FROM cc) GROUP BY cui""",
)
def semantic_search_others(t: Tables):
    named = t.mentions.withColumn("pref", F.col("str"))
    found = semantic_search.semantic_search("ring", named, t.docs).other_concepts
    return found.withColumn("score", F.round("score", 6))


@query(
    "query_concept_ids", "SF22 N15",
    """SELECT DISTINCT cui FROM mentions WHERE cui IN ('C0000012', 'C0000345')""",
)
def query_concept_ids(t: Tables):
    return semantic_search.query_concepts("C0000012 or C0000345", summary.contexted_concepts(t.mentions))


@query(
    "label_chain", "N3",
    """SELECT doc_id, cui, start_pos, CASE WHEN lower(str) IN ('red ring', 'old rod') THEN 'skip-term'
       WHEN regexp_matches(str, '^(blue|cold) g') THEN 'original-string-rule'
       WHEN NOT (experiencer = 'Patient' AND temporality = 'Recent' AND negation = 'Affirmed') THEN 'nlp-label' END AS ruled_by FROM mentions""",
)
def label_chain(t: Tables):
    verdict = F.coalesce(
        rules.skip_verdict(["Red Ring", "old rod"], F.col("str")),
        rules.surface_verdict(["(blue|cold) g"], F.col("str")),
        rules.label_verdict(),
    )
    return t.mentions.select("doc_id", "cui", "start_pos", verdict["rule"].alias("ruled_by"))
