"""Validation statistics, samples, ranks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog import notes
from cohortmill.catalog.base import query
from cohortmill.functions import context as cx
from cohortmill.operators import joins, patterns, summary, validation
from cohortmill.sources.tables import Tables

LABELLED = """lab AS (SELECT DISTINCT m.cui, m.doc_id, m.start_pos, m.end_pos, f.label FROM mentions m
       JOIN feedback f USING (doc_id, start_pos, end_pos))"""
PHEN = "phen AS (SELECT name AS phenotype, cui FROM closure)"


def labelled(t: Tables):
    """Validated appearances with their label."""
    spans = t.mentions.select("cui", "doc_id", "start_pos", "end_pos").distinct()
    return spans.join(t.feedback.select("doc_id", "start_pos", "end_pos", "label"), ["doc_id", "start_pos", "end_pos"])


def phenotypes(t: Tables):
    return t.closure.select(F.col("name").alias("phenotype"), "cui")


@query("concept_label_counts", "A13", f"WITH {LABELLED} SELECT cui, label, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY cui, label")
def concept_label_counts(t: Tables):
    return validation.concept_label_counts(labelled(t))


@query(
    "phenotype_rollup", "J12",
    f"""WITH {LABELLED}, {PHEN}, c AS (SELECT cui, label, count(*) AS n FROM lab GROUP BY cui, label)
       SELECT p.phenotype, c.label, CAST(sum(c.n) AS BIGINT) AS n FROM phen p LEFT JOIN c ON p.cui = c.cui GROUP BY p.phenotype, c.label""",
)
def phenotype_rollup(t: Tables):
    return validation.phenotype_rollup(phenotypes(t), validation.concept_label_counts(labelled(t)))


PERF = ", ".join(f"CAST(count(*) FILTER (WHERE l.label = '{n}') AS BIGINT) AS \"{n}\"" for n in validation.PERFORMANCE)


@query(
    "phenotype_performance", "A14",
    f"WITH {LABELLED}, {PHEN} SELECT p.phenotype, {PERF} FROM phen p JOIN lab l ON p.cui = l.cui GROUP BY p.phenotype",
)
def phenotype_performance(t: Tables):
    return validation.phenotype_performance(phenotypes(t), validation.concept_label_counts(labelled(t)))


HEADERS = ["rule_a", "rule_b", "skip_term", "nlp_label", "pos"]
OUTCOME = """CASE WHEN lower(str) = 'red ring' THEN 'skip_term' WHEN ruled_by IS NOT NULL THEN ruled_by
       WHEN negation <> 'Affirmed' OR experiencer <> 'Patient' OR temporality <> 'Recent' THEN 'nlp_label' ELSE 'pos' END"""


@query(
    "rule_breakdown_by_concept", "A12",
    f"""WITH o AS (SELECT cui, doc_id, start_pos, end_pos, {OUTCOME} AS outcome FROM mentions),
       f AS (SELECT cui, doc_id, start_pos, end_pos, arg_min(outcome, CASE outcome WHEN 'rule_a' THEN 0 WHEN 'rule_b' THEN 1
         WHEN 'skip_term' THEN 2 WHEN 'nlp_label' THEN 3 ELSE 4 END) AS outcome FROM o GROUP BY ALL)
       SELECT cui, {', '.join(f"CAST(count(*) FILTER (WHERE outcome = '{h}') AS BIGINT) AS {h}" for h in HEADERS)} FROM f GROUP BY cui""",
)
def rule_breakdown_by_concept(t: Tables):
    outcome = (
        F.when(F.lower("str") == "red ring", "skip_term")
        .when(F.col("ruled_by").isNotNull(), F.col("ruled_by"))
        .when(~cx.positive("strict"), "nlp_label")
        .otherwise("pos")
    )
    rank = F.array_position(F.array(*map(F.lit, HEADERS)), F.col("outcome"))
    rows = t.mentions.withColumn("outcome", outcome).withColumn("rank", rank)
    return validation.rule_breakdown(rows, headers=HEADERS)


FREQ = """freq AS (SELECT cui, CAST(count(*) AS BIGINT) AS freq FROM
       (SELECT cui FROM mentions UNION ALL SELECT cui FROM mentions WHERE temporality = 'Recent') GROUP BY cui)"""


def frequencies(t: Tables):
    """Concept frequencies of two corpora: all mentions and the recent ones."""
    one = t.mentions.groupBy("cui").agg(F.count("*").alias("freq"))
    two = t.mentions.where("temporality = 'Recent'").groupBy("cui").agg(F.count("*").alias("freq"))
    return validation.concept_frequency([one, two])


@query("concept_frequency", "A15", f"WITH {FREQ} SELECT cui, freq FROM freq")
def concept_frequency(t: Tables):
    return frequencies(t)


@query(
    "phenotype_prevalence", "A16",
    f"""WITH {FREQ}, {PHEN} SELECT p.phenotype, CAST(coalesce(sum(f.freq), 0) AS BIGINT) AS prevalence, CAST(count(*) AS BIGINT) AS n_concepts
       FROM phen p LEFT JOIN freq f ON p.cui = f.cui GROUP BY p.phenotype""",
)
def phenotype_prevalence(t: Tables):
    return validation.phenotype_prevalence(phenotypes(t), frequencies(t))


@query(
    "phenotype_detail", "A16",
    f"WITH {FREQ}, {PHEN} SELECT p.cui, coalesce(f.freq, 0) AS freq FROM phen p LEFT JOIN freq f ON p.cui = f.cui WHERE p.phenotype = 'S3'",
)
def phenotype_detail(t: Tables):
    return validation.phenotype_detail(phenotypes(t), frequencies(t), "S3")


CONDITION = f"""WITH {LABELLED}, c AS (SELECT d.pid, l.label, x.name AS condition FROM lab l JOIN docs d ON l.doc_id = d.doc_id
       JOIN exclusive x ON l.cui = x.cui)"""


def conditions(t: Tables):
    rows = joins.attach_patient(labelled(t), t.docs)
    return joins.study_mentions(rows, t.exclusive).withColumnRenamed("concept", "condition")


@query("patient_conditions", "A17", f"{CONDITION} SELECT DISTINCT pid, label, condition FROM c WHERE label IN ('posM', 'hisM', 'negM')")
def patient_conditions(t: Tables):
    return validation.patient_conditions(conditions(t))


@query(
    "condition_patients", "A17",
    f"{CONDITION} SELECT condition, pid, CAST(count(*) AS BIGINT) AS n FROM c WHERE label IN ('posM', 'hisM') GROUP BY ALL",
)
def condition_patients(t: Tables):
    return validation.condition_patients(conditions(t))


def label_counts(t: Tables):
    """Surface texts of each semantic type with condition and wrong mentions."""
    rows = t.mentions.select("doc_id", "start_pos", "end_pos", F.col("sty").alias("cui"), "str").distinct()
    judged = rows.join(t.feedback.select("doc_id", "start_pos", "end_pos", F.col("label").alias("f")), ["doc_id", "start_pos", "end_pos"])
    named = judged.groupBy("cui", F.col("str").alias("label"))
    cond = named.agg(F.count_if(F.col("f") != "wrongM").alias("num")).where("num > 0")
    wrong = named.agg(F.count_if(F.col("f") == "wrongM").alias("num")).where("num > 0")
    return cond, wrong


AMBIGUITY = """WITH j AS (SELECT DISTINCT m.doc_id, m.start_pos, m.end_pos, m.sty AS cui, m.str AS label, f.label AS f FROM mentions m
         JOIN feedback f USING (doc_id, start_pos, end_pos)),
       r AS (SELECT cui, label, count(*) FILTER (WHERE f <> 'wrongM') AS c, count(*) FILTER (WHERE f = 'wrongM') AS w FROM j GROUP BY cui, label),
       p AS (SELECT cui, sum(w) AS cw, sum(c + w) AS ct FROM r GROUP BY cui)"""


@query(
    "label_ambiguity", "A18",
    f"""{AMBIGUITY} SELECT r.cui, r.label, CAST(r.c AS BIGINT) AS cond, CAST(r.w AS BIGINT) AS wrong, round(r.w / CAST(r.c + r.w AS DOUBLE), 6) AS ambiguity,
       round(CASE WHEN p.cw = 0 THEN -1 ELSE r.w / CAST(p.cw AS DOUBLE) END, 6) AS amb_share,
       round(CASE WHEN p.cw = p.ct THEN -1 ELSE r.c / CAST(p.ct - p.cw AS DOUBLE) END, 6) AS cond_share FROM r JOIN p ON r.cui = p.cui""",
)
def label_ambiguity(t: Tables):
    rows = validation.label_ambiguity(*label_counts(t))
    return rows.select("cui", "label", "cond", "wrong", *[F.round(c, 6).alias(c) for c in ("ambiguity", "amb_share", "cond_share")])


@query(
    "concept_ambiguity", "A18",
    f"""{AMBIGUITY}, k AS (SELECT cui, c, w, row_number() OVER (PARTITION BY cui ORDER BY c DESC, label) AS rn FROM r)
       SELECT cui, round(sum(w) / CAST(sum(w) + sum(c) AS DOUBLE), 6) AS ambiguity,
       round(CASE WHEN sum(c) = 0 THEN -1 ELSE 1 - sum(CASE WHEN rn <= 2 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) END, 6) AS variation FROM k GROUP BY cui""",
)
def concept_ambiguity(t: Tables):
    rows = validation.concept_ambiguity(validation.label_ambiguity(*label_counts(t)))
    return rows.select("cui", F.round("ambiguity", 6).alias("ambiguity"), F.round("variation", 6).alias("variation"))


@query(
    "validation_performance", "A19",
    f"""WITH s AS (SELECT DISTINCT x.name AS term, m.doc_id, m.start_pos, m.end_pos FROM mentions m JOIN exclusive x ON m.cui = x.cui)
       SELECT s.term, {', '.join(f"round(count(*) FILTER (WHERE f.label = '{n}') / CAST(count(*) AS DOUBLE), 6) AS {n}" for n in cx.FEEDBACK_LABELS)},
       CAST(count(*) FILTER (WHERE f.label IS NULL) AS BIGINT) AS not_validated
       FROM s LEFT JOIN feedback f USING (doc_id, start_pos, end_pos) GROUP BY s.term""",
)
def validation_performance(t: Tables):
    samples = joins.study_mentions(t.mentions, t.exclusive).select(
        F.col("concept").alias("term"), "doc_id", "start_pos", "end_pos"
    ).distinct()
    table = validation.validation_performance(samples, t.feedback)
    return table.select("term", *[F.round(n, 6).alias(n) for n in cx.FEEDBACK_LABELS], "not_validated")


@query(
    "study_catalog", "A33",
    """SELECT name, CAST(count(*) AS BIGINT) AS freq FROM (SELECT DISTINCT m.sty, c.name FROM mentions m JOIN closure c ON m.cui = c.cui) GROUP BY name""",
)
def study_catalog(t: Tables):
    studies = joins.study_mentions(t.mentions, t.closure).select(F.col("sty").alias("study"), F.col("concept").alias("name"), "cui")
    return validation.study_catalog(studies)


@query(
    "merged_concepts", "A33",
    "SELECT DISTINCT c.name, c.cui FROM mentions m JOIN closure c ON m.cui = c.cui",
)
def merged_concepts(t: Tables):
    studies = joins.study_mentions(t.mentions, t.closure).select(F.col("sty").alias("study"), F.col("concept").alias("name"), "cui")
    return validation.merged_concepts(studies)


@query(
    "sample_per_group", "W5",
    """SELECT sty, doc_id, start_pos, cui FROM (SELECT *, row_number() OVER (PARTITION BY sty ORDER BY
         md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR), CAST(start_pos AS VARCHAR), cui)), doc_id, start_pos, cui) AS rn
         FROM (SELECT DISTINCT sty, doc_id, start_pos, cui FROM mentions)) WHERE rn <= 15""",
)
def sample_per_group(t: Tables):
    rows = t.mentions.select("sty", "doc_id", "start_pos", "cui").distinct()
    return validation.sample_per_group(rows, "sty", k=15, key=["doc_id", "start_pos", "cui"])


@query(
    "latest_document", "W2",
    """SELECT pid, doc_id, strftime(doc_date, '%Y-%m-%d') AS doc_date FROM (SELECT *, row_number() OVER (PARTITION BY pid
       ORDER BY doc_date DESC, doc_id DESC) AS rn FROM docs WHERE doc_type = '2-HIGH') WHERE rn = 1""",
)
def latest_document(t: Tables):
    return validation.latest_document(t.docs, doc_type="2-HIGH").withColumn("doc_date", F.date_format("doc_date", "yyyy-MM-dd"))


@query(
    "first_evidence", "W6",
    """SELECT pid, concept, doc_id, strftime(doc_date, '%Y-%m-%d') AS doc_date FROM (SELECT d.pid, x.name AS concept, d.doc_id, d.doc_date,
         row_number() OVER (PARTITION BY d.pid, x.name ORDER BY d.doc_date, d.doc_id) AS rn
         FROM mentions m JOIN docs d ON m.doc_id = d.doc_id JOIN exclusive x ON m.cui = x.cui WHERE m.ruled_by IS NULL) WHERE rn = 1""",
)
def first_evidence(t: Tables):
    rows = summary.study_rows(t.mentions.where("ruled_by IS NULL"), t.docs.select("doc_id", "pid"), t.exclusive)
    dated = rows.join(t.docs.select("doc_id", "doc_date"), "doc_id")
    return validation.first_evidence(dated).withColumn("doc_date", F.date_format("doc_date", "yyyy-MM-dd"))


@query(
    "nearest_candidate", "W8",
    """SELECT doc_id, cui, pos, dist FROM (SELECT m.doc_id, m.cui, m.start_pos AS pos, abs(m.start_pos - 500) AS dist,
         row_number() OVER (PARTITION BY m.doc_id, m.cui ORDER BY abs(m.start_pos - 500), m.start_pos) AS rn FROM mentions m) WHERE rn = 1""",
)
def nearest_candidate(t: Tables):
    rows = t.mentions.select("doc_id", "cui", F.lit(500).alias("wanted"), F.col("start_pos").alias("pos"))
    return validation.nearest_candidate(rows, ["doc_id", "cui"])


@query(
    "numbered_mentions", "W9",
    """SELECT doc_id, start_pos, end_pos, cui, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, cui) AS no
       FROM (SELECT DISTINCT doc_id, start_pos, end_pos, cui FROM mentions)""",
)
def numbered_mentions(t: Tables):
    spans = t.mentions.select("doc_id", "start_pos", "end_pos", "cui").distinct()
    return validation.numbered_mentions(spans).withColumn("no", F.col("no").cast("long"))


@query(
    "turn_neighbours", "W1",
    """SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text,
       lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations""",
)
def turn_neighbours(t: Tables):
    turns = t.raw("conversations").select("conv_id", "turn", "text")
    rows = scale.neighbours(turns, "conv_id", "turn", "text", F.floor(F.col("turn") / 100), "prev_text", "next_text")
    return rows.drop("text")


@query(
    "latest_turn", "W2",
    "SELECT conv_id AS pid, turn AS doc_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1",
)
def latest_turn(t: Tables):
    last = F.max(F.struct("turn", "role"))
    rows = t.raw("conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("pid")).agg(last.alias("d"))
    return rows.select("pid", F.col("d.turn").alias("doc_id"), F.col("d.role").alias("role"))


def labelled_instances(t: Tables):
    """Instances with pattern levels made of the mention's own columns, and two labels."""
    rows = joins.attach_patient(t.mentions, t.docs)
    gt = F.when(F.col("start_pos") % 11 == 0, patterns.UNLABELLED).when(
        F.col("start_pos") % (F.length("pref") + 1) == 0, "negM"
    ).otherwise(cx.ctx_class_ui())
    return rows.select(
        "doc_id", "start_pos", F.col("sty").alias("pattern"), F.col("pref").alias("variant"),
        F.split("str", " ")[1].alias("sent_pattern"), F.split("str", " ")[0].alias("sent_text"),
        cx.ctx_class_ui().alias("signed_label"), gt.alias("gt_label"),
    )


INSTANCES = """inst AS (SELECT doc_id, start_pos, sty AS pattern, pref AS variant, str_split(str, ' ')[2] AS sent_pattern,
         str_split(str, ' ')[1] AS sent_text, ui_type AS signed_label,
         CASE WHEN start_pos % 11 = 0 THEN '-' WHEN start_pos % (length(pref) + 1) = 0 THEN 'negM' ELSE ui_type END AS gt_label FROM typed),
       ok AS (SELECT *, CASE WHEN gt_label <> '-' THEN CASE WHEN gt_label = signed_label THEN 1.0 ELSE 0.0 END END AS good FROM inst)"""


def accuracy_sql(name: str, source: str, keys: str, freq: int) -> str:
    cls = "CASE WHEN avg(good) >= 0.75 THEN 'easy_accurate' WHEN avg(good) <= 0.25 THEN 'easy_inaccurate' ELSE 'hard' END"
    return f"""{name} AS (SELECT {keys}, count(*) AS n, avg(good) AS accuracy, {cls} AS cls FROM {source}
       GROUP BY {keys} HAVING count(*) >= {freq} AND avg(good) IS NOT NULL)"""


@query(
    "pattern_accuracy", "A30",
    f"""WITH {INSTANCES}, {accuracy_sql('v', 'ok', 'pattern, variant', 5)}
       SELECT pattern, variant, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, cls FROM v""",
)
def pattern_accuracy(t: Tables):
    rows = patterns.classified(labelled_instances(t), ["pattern", "variant"], min_freq=5)
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def cascade_sql(instances: str, key: str) -> str:
    """Scores of all levels trained and looked up on the instances ``inst`` and ``ok`` of the given tables."""
    return f"""WITH {instances},
       p AS (SELECT pattern, avg(good) AS a1 FROM ok GROUP BY pattern HAVING count(*) >= 3),
       {accuracy_sql('v', '(SELECT ok.* FROM ok JOIN p USING (pattern))', 'pattern, variant', 5)},
       b AS (SELECT ok.* FROM ok JOIN v USING (pattern, variant) WHERE v.cls = 'hard'),
       {accuracy_sql('s', 'b', 'pattern, variant, sent_pattern', 6)},
       l AS (SELECT b.* FROM b JOIN s USING (pattern, variant, sent_pattern) WHERE s.cls = 'hard'),
       {accuracy_sql('k', 'l', 'pattern, variant, sent_pattern, sent_text', 3)}
       SELECT {key}, i.pattern, i.variant, i.sent_pattern, i.sent_text, round(CASE WHEN p.a1 IS NULL THEN -1
         WHEN p.a1 >= 0.75 OR p.a1 <= 0.25 THEN p.a1 WHEN v.cls IS NULL THEN p.a1 WHEN v.cls <> 'hard' THEN v.accuracy
         WHEN s.cls IS NULL THEN p.a1 WHEN s.cls <> 'hard' THEN s.accuracy ELSE coalesce(k.accuracy, s.accuracy) END, 6) AS confidence
       FROM inst i LEFT JOIN p ON p.pattern = i.pattern LEFT JOIN v ON v.pattern = i.pattern AND v.variant = i.variant
       LEFT JOIN s ON s.pattern = i.pattern AND s.variant = i.variant AND s.sent_pattern = i.sent_pattern
       LEFT JOIN k ON k.pattern = i.pattern AND k.variant = i.variant AND k.sent_pattern = i.sent_pattern AND k.sent_text = i.sent_text"""


@query("confidence_cascade", "J20 N10", cascade_sql(INSTANCES, "i.doc_id, i.start_pos"))
def confidence_cascade(t: Tables):
    instances = scale.cut(labelled_instances(t))
    scored = patterns.confidence_cascade(instances, patterns.train_pattern_model(instances))
    return scored.select(
        "doc_id", "start_pos", "pattern", "variant", "sent_pattern", "sent_text", F.round("confidence", 6).alias("confidence")
    )


def judged_instances(t: Tables):
    """Mentions in the running text with the pattern levels around them, and the labels of their documents as ground truth."""
    label = cx.ctx_class_ui()
    gt = F.when(F.col("toxic").isNull(), patterns.UNLABELLED).when(F.col("toxic") == 1, "wrongM").when(F.col("quality") == 0, "hypoM").otherwise(label)
    rows = notes.instances(t).join(t.raw("labels"), "doc_id", "left")
    return rows.withColumns({"signed_label": label, "gt_label": gt}).drop("quality", "toxic")


JUDGED = f"""{notes.LEVELS}, inst AS (SELECT l.*, CASE WHEN experiencer <> 'Patient' THEN 'otherM' WHEN temporality <> 'Recent' THEN 'hisM'
           WHEN negation = 'Negated' THEN 'negM' ELSE 'posM' END AS signed_label, b.toxic, b.quality FROM levels l LEFT JOIN labels b ON b.doc_id = l.doc_id),
       ok AS (SELECT *, CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 OR quality = 0 THEN 0.0 ELSE 1.0 END AS good FROM inst)"""


@query("pattern_confidence", "N9 N10 J20", cascade_sql(JUDGED, "i.doc_id, i.cui, i.start_pos"))
def pattern_confidence(t: Tables):
    """The cascade trained on, and scoring, what the sentences around the mentions give."""
    instances = scale.cut(judged_instances(t))
    scored = patterns.confidence_cascade(instances, patterns.train_pattern_model(instances))
    return scored.select(
        "doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"), "pattern", "variant", "sent_pattern", "sent_text",
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "pattern_back_off", "N10 J20",
    f"""WITH {JUDGED}, paths AS (SELECT doc_id, cui, start_pos, pattern, good, list_filter(string_split(sent_pattern, '<-'), lambda x: x <> '')[1:6] AS path FROM ok),
       pre AS (SELECT * EXCLUDE (path), d AS depth, array_to_string(path[1:d], '<-') AS prefix FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
       tree AS (SELECT pattern, depth, prefix, avg(good) AS accuracy FROM pre GROUP BY ALL HAVING count(*) >= 3 AND avg(good) IS NOT NULL),
       best AS (SELECT p.doc_id, p.cui, p.start_pos, max(t.depth) AS depth, arg_max(t.accuracy, t.depth) AS accuracy FROM pre p LEFT JOIN tree t
         ON t.pattern = p.pattern AND t.depth = p.depth AND t.prefix = p.prefix GROUP BY ALL)
       SELECT doc_id, cui, start_pos, CAST(coalesce(depth, -1) AS BIGINT) AS depth, round(coalesce(accuracy, -1), 6) AS confidence FROM best""",
)
def pattern_back_off(t: Tables):
    """Accuracy of the deepest frequent node that a mention's tag path reaches in the prefix tree below its pattern."""
    instances = scale.cut(judged_instances(t))
    out = patterns.back_off(instances, patterns.pattern_tree(instances), key=["doc_id", "cui", "start_pos"])
    return out.select(
        "doc_id", "cui", *(F.col(c).cast("long").alias(c) for c in ("start_pos", "depth")), F.round("confidence", 6).alias("confidence")
    )
