"""Running text: sentences, tagging, rules, sections, search and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog.base import WORDS_OF, query
from cohortmill.functions import text as tx
from cohortmill.operators import deident, joins, patterns, rules, sections, textmine
from cohortmill.operators.rules import Rule, RuleSet
from cohortmill.sources.tables import Tables

NUMBER = r"\d+(?:[.,/]\d+)*%?"



def long(name: str):
    return F.col(name).cast("long").alias(name)


@query(
    "sentence_spans", "W9",
    """SELECT doc_id, sent_no, CAST(sent_start AS BIGINT) AS sent_start, CAST(sent_end AS BIGINT) AS sent_end, sent_text FROM sents""",
)
def sentence_spans(t: Tables):
    rows = textmine.sentences(t.text_docs)
    return rows.select("doc_id", long("sent_no"), long("sent_start"), long("sent_end"), "sent_text")


@query(
    "adjacent_sentences", "W1",
    """SELECT doc_id, sent_no, md5(lag(sent_text) OVER w) AS prev_text, md5(lead(sent_text) OVER w) AS next_text FROM sents
       WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no)""",
)
def adjacent_sentences(t: Tables):
    rows = textmine.adjacent_sentences(t.text_docs)
    return rows.select("doc_id", long("sent_no"), F.md5("prev_text").alias("prev_text"), F.md5("next_text").alias("next_text"))


@query(
    "dictionary_annotate", "N4",
    "SELECT doc_id, cui, sty, pref, str, start_pos, end_pos FROM tmentions",
)
def dictionary_annotate(t: Tables):
    return t.tag(t.text_docs).select("doc_id", "cui", "sty", "pref", "str", long("start_pos"), long("end_pos"))


INDEXED = """idx AS (SELECT m.doc_id, m.cui, m.str, m.start_pos, m.end_pos, m.negation, m.temporality, m.experiencer, min(s.sent_no) AS i
       FROM tmentions m JOIN sents s ON s.doc_id = m.doc_id AND (m.start_pos BETWEEN s.sent_start AND s.sent_end
         OR m.end_pos BETWEEN s.sent_start AND s.sent_end) GROUP BY ALL)"""


@query(
    "sentence_of", "J5",
    f"""WITH {INDEXED} SELECT x.doc_id, x.cui, x.start_pos, CAST(s.sent_start AS BIGINT) AS sent_start, CAST(s.sent_end AS BIGINT) AS sent_end
       FROM idx x JOIN sents s ON s.doc_id = x.doc_id AND s.sent_no = x.i""",
)
def sentence_of(t: Tables):
    table = textmine.sentences(t.text_docs).select("doc_id", "sent_start", "sent_end")
    rows = rules.sentence_of(t.text_mentions, table)
    return rows.select("doc_id", "cui", long("start_pos"), long("sent_start"), long("sent_end"))


RULES = RuleSet(
    rules=[
        Rule("document", 0, ["^ist "]),
        Rule("negation", -1, [" was "], containing=True),
        Rule("context", -1, [" by "], containing=True, prev_ctx=True),
        Rule("hypothetical", 1, ["^ (with|for) ", "^ from"]),
        Rule("next", 1, ["the", "und"], containing=True, next_ctx=True, case_sensitive=True),
        Rule("surface", 100, ["o[a-z]+st"]),
        Rule("cut", -100, ["That is", "nach "]),
    ],
    surface_patterns=["H[a-z]+", "Ino"],
    skip_terms=["INORAN"],
)


CONTEXT = rf"""WITH {INDEXED},
       c AS (SELECT x.*, s0.sent_text AS here, p1.sent_text AS p, n1.sent_text AS n, s0.sent_start AS ss, d.text,
           p1.sent_text IS NOT NULL AND (p1.sent_text LIKE '%?' OR lower(p1.sent_text) LIKE '%e.g.') AS q,
           p1.sent_text IS NOT NULL AND s0.sent_text LIKE 's %' AS sp, n1.sent_text IS NOT NULL AND s0.sent_text LIKE '%?' AS asks
         FROM idx x JOIN documents d ON d.doc_id = x.doc_id JOIN sents s0 ON s0.doc_id = x.doc_id AND s0.sent_no = x.i
         LEFT JOIN sents p1 ON p1.doc_id = x.doc_id AND p1.sent_no = x.i - 1 LEFT JOIN sents n1 ON n1.doc_id = x.doc_id AND n1.sent_no = x.i + 1),
       e AS (SELECT *, concat(CASE WHEN sp THEN p ELSE '' END, CASE WHEN q THEN p ELSE '' END, substring(here, 1, CAST(start_pos - ss AS BIGINT))) AS bef,
           concat(substring(here, CAST(end_pos - ss + 1 AS BIGINT)), CASE WHEN asks THEN n ELSE '' END) AS aft,
           CASE WHEN asks THEN i + 1 WHEN q OR sp THEN i - 1 ELSE i END AS anchor FROM c),
       f AS (SELECT e.*, concat(coalesce(a.sent_text || ' ', ''), bef) AS pbef, concat(aft, coalesce(' ' || b.sent_text, '')) AS naft
         FROM e LEFT JOIN sents a ON a.doc_id = e.doc_id AND a.sent_no = e.anchor - 1 LEFT JOIN sents b ON b.doc_id = e.doc_id AND b.sent_no = e.anchor + 1)
       SELECT doc_id, cui, start_pos, CASE WHEN regexp_matches(str, '^(?:H[a-z]+)') OR regexp_matches(str, '^(?:Ino)') THEN 'original-string-rule'
         WHEN lower(str) = 'inoran' THEN 'skip-term'
         WHEN (instr(lower(text), 'that is') - 1 > 0 AND start_pos >= instr(lower(text), 'that is') - 1)
           OR (instr(lower(text), 'nach ') - 1 > 0 AND start_pos >= instr(lower(text), 'nach ') - 1) THEN 'cut'
         WHEN regexp_matches(str, '(?i)^o[a-z]+st$') THEN 'surface'
         WHEN regexp_matches(naft, '^.*the.*') OR regexp_matches(naft, '^.*und.*') THEN 'next'
         WHEN regexp_matches(aft, '(?i)^ (with|for) ') OR regexp_matches(aft, '(?i)^ from') THEN 'hypothetical'
         WHEN regexp_matches(pbef, '(?i)^.* by .*') THEN 'context' WHEN regexp_matches(bef, '(?i)^.* was .*') THEN 'negation'
         WHEN regexp_matches(substring(text, 1, 200), '(?i)^ist ') THEN 'document' END AS ruled_by FROM f"""


@query("context_rules", "N1 SF8 SF17 SF18 PF1", CONTEXT)
def context_rules(t: Tables):
    docs = rules.with_sentences(t.text_docs)
    rows = rules.apply_context_rules(t.text_mentions, docs, RULES)
    return rows.select("doc_id", "cui", long("start_pos"), "ruled_by")


# sentences of a note per event, with all the neighbours that move a context: a question, an abbreviation, a split-off s
TEMPLATE = [
    "It was {e} or not?", "{e} in part.", "now by day e.g.", "{e} so far.", "He was ill", "s {e} more.", "so {e} here?",
    "under it.", "ok.",
]
NEIGHBOURS = f"""nsents AS (SELECT doc_id, et, k - 1 AS sent_no, tpl, replace(tpl, '{{e}}', et) AS sent_text,
         CAST(coalesce(sum(length(replace(tpl, '{{e}}', et)) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_start
         FROM (SELECT event_id AS doc_id, event_type AS et, unnest({TEMPLATE}) AS tpl, unnest(range(1, {len(TEMPLATE) + 1})) AS k FROM events)),
       nspans AS (SELECT *, sent_start + length(sent_text) AS sent_end FROM nsents),
       ndocs AS (SELECT doc_id, string_agg(sent_text, ' ' ORDER BY sent_no) AS text FROM nsents GROUP BY doc_id),
       nments AS (SELECT doc_id, 'E' AS cui, et AS str, sent_start + instr(tpl, '{{e}}') - 1 AS start_pos, sent_start + instr(tpl, '{{e}}') - 1 + length(et) AS end_pos,
         'Affirmed' AS negation, 'Recent' AS temporality, 'Patient' AS experiencer FROM nsents WHERE contains(tpl, '{{e}}'))"""
OVER_NOTES = CONTEXT.replace("WITH idx", f"WITH {NEIGHBOURS}, idx").replace("tmentions", "nments").replace(" sents ", " nspans ").replace("JOIN documents", "JOIN ndocs")


@query("context_rules_neighbours", "N1 W1", OVER_NOTES)
def context_rules_neighbours(t: Tables):
    event = F.col("event_type")
    parts = [F.replace(F.lit(tpl), F.lit("{e}"), event) for tpl in TEMPLATE]
    starts, at = [], F.lit(0)
    for part in parts:
        starts.append(at)
        at = at + F.length(part) + 1
    spans = [F.struct(s.alias("sent_start"), (s + F.length(p)).alias("sent_end")) for s, p in zip(starts, parts, strict=True)]
    places = [s + tpl.index("{e}") for s, tpl in zip(starts, TEMPLATE, strict=True) if "{e}" in tpl]
    notes = t.raw("events").select(
        F.col("event_id").alias("doc_id"), event, F.concat_ws(" ", *parts).alias("text"),
        F.array(*spans).alias("spans"), F.array(*places).alias("places"),
    )
    docs = rules.with_sentences(notes.select("doc_id", "text"), notes.select("doc_id", F.inline("spans")))
    found = notes.select("doc_id", F.lit("E").alias("cui"), event.alias("str"), F.explode("places").alias("start_pos"))
    found = found.withColumn("end_pos", F.col("start_pos") + F.length("str"))
    rows = rules.apply_context_rules(found, docs, RULES)
    return rows.select("doc_id", "cui", long("start_pos"), "ruled_by")


WINDOWED = """w AS (SELECT m.*, substring(d.text, greatest(m.start_pos - 150, 0) + 1, m.start_pos - greatest(m.start_pos - 150, 0)) AS bef,
         substring(d.text, m.end_pos + 1, 150) AS aft, substring(d.text, 1, 200) AS head FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id)"""
WINDOW_VERDICT = """CASE WHEN regexp_matches(str, '(?i)^o[a-z]+st$') THEN 'surface'
         WHEN regexp_matches(aft, '^.*the.*') OR regexp_matches(aft, '^.*und.*') THEN 'next'
         WHEN regexp_matches(aft, '(?i)^ (with|for) ') OR regexp_matches(aft, '(?i)^ from') THEN 'hypothetical'
         WHEN regexp_matches(bef, '(?i)^.* by .*') THEN 'context' WHEN regexp_matches(bef, '(?i)^.* was .*') THEN 'negation'
         WHEN regexp_matches(head, '(?i)^ist ') THEN 'document' END"""


@query("window_rules", "N2 SF8", f"WITH {WINDOWED} SELECT doc_id, cui, start_pos, {WINDOW_VERDICT} AS ruled_by FROM w")
def window_rules(t: Tables):
    rows = rules.apply_window_rules(t.text_mentions, t.text_docs, RULES.rules)
    return rows.select("doc_id", "cui", long("start_pos"), "ruled_by")


CHAIN = f"""WITH {WINDOWED} SELECT doc_id, cui, start_pos, coalesce(CASE WHEN lower(str) = 'inoran' THEN 'skip-term'
         WHEN regexp_matches(str, '^(?:H[a-z]+)') OR regexp_matches(str, '^(?:Ino)') THEN 'original-string-rule' END, {WINDOW_VERDICT},
         CASE WHEN NOT (experiencer = 'Patient' AND temporality = 'Recent' AND negation = 'Affirmed') THEN 'nlp-label' END) AS ruled_by FROM w"""


@query("rule_chain", "N3 SF18", CHAIN)
def rule_chain(t: Tables):
    rows = rules.rule_chain(t.text_mentions, t.text_docs, RULES)
    return rows.select("doc_id", "cui", long("start_pos"), "ruled_by")


@query(
    "relocate_offsets", "J8",
    """WITH m AS (SELECT x.doc_id, x.cui, x.str, x.start_pos AS orig, x.start_pos + 5 AS s, substring(d.text, x.start_pos + 6, length(x.str)) AS shown
         FROM tmentions x JOIN documents d ON d.doc_id = x.doc_id),
       k AS (SELECT g.doc_id, g.start_pos, lower(substring(d.text, CAST(g.start_pos AS BIGINT) + 1, CAST(g.end_pos - g.start_pos AS BIGINT))) AS shown
         FROM grams g JOIN documents d ON d.doc_id = g.doc_id WHERE g.term IN (SELECT term FROM gaz)),
       c AS (SELECT m.doc_id, m.cui, m.orig, m.s, m.str, m.shown, k.start_pos AS p FROM m JOIN k ON k.doc_id = m.doc_id AND k.shown = lower(m.str))
       SELECT doc_id, cui, orig, CAST(CASE WHEN shown = str THEN s ELSE arg_min(p, (abs(p - s), p)) END AS BIGINT) AS start_pos FROM c GROUP BY doc_id, cui, orig, s, str, shown""",
)
def relocate_offsets(t: Tables):
    moved = t.text_mentions.withColumn("orig", long("start_pos"))
    moved = moved.withColumn("start_pos", F.col("start_pos") + 5).withColumn("end_pos", F.col("end_pos") + 5)
    return textmine.relocate_offsets(moved, t.text_docs).select("doc_id", "cui", "orig", long("start_pos"))


WORDS = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w,
         generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM documents)"""


@query(
    "text_search_any", "PF8",
    f"WITH {WORDS} SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM w WHERE w IN ('thatin', 'hehely', 'ononst') GROUP BY doc_id",
)
def text_search_any(t: Tables):
    return t.text_index.search(any_of=["thatin", "hehely", "ononst"]).select("doc_id", long("hits"))


@query(
    "text_search_all", "PF8",
    f"""WITH {WORDS} SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM w WHERE w IN ('that', 'inoran') GROUP BY doc_id HAVING count(DISTINCT w) = 2""",
)
def text_search_all(t: Tables):
    return t.text_index.search(all_of=["that", "inoran"]).select("doc_id", long("hits"))


@query(
    "text_search_near", "PF8",
    f"""WITH {WORDS}, n AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(b.i - 1 - a.i) <= 3 WHERE a.w = 'was' AND b.w = 'from')
       SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM w WHERE w IN ('was', 'from') AND doc_id IN (SELECT doc_id FROM n) GROUP BY doc_id""",
)
def text_search_near(t: Tables):
    return t.text_index.search(phrases=[("was from", 3)]).select("doc_id", long("hits"))


@query(
    "text_search_accented", "PF8",
    f"""WITH {WORDS}, n AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(b.i - 1 - a.i) <= 2 WHERE a.w = 'für' AND b.w = 'der'),
       k AS (SELECT doc_id FROM w WHERE w IN ('der', 'über', 'für') GROUP BY doc_id HAVING bool_or(w = 'der') AND bool_or(w = 'für'))
       SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM w WHERE w IN ('der', 'über', 'für') AND doc_id IN (SELECT doc_id FROM n)
         AND doc_id IN (SELECT doc_id FROM k) GROUP BY doc_id""",
)
def text_search_accented(t: Tables):
    found = t.text_index.search(any_of=["über", "für"], all_of=["der"], phrases=[("für der", 2)])
    return found.select("doc_id", long("hits"))


@query(
    "text_search_scan", "PF8 SC12",
    f"""WITH {WORDS}, n AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(b.i - 1 - a.i) <= 3 WHERE a.w = 'was' AND b.w = 'from')
       SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM w WHERE w IN ('was', 'from', 'éque') AND doc_id IN (SELECT doc_id FROM n) GROUP BY doc_id""",
)
def text_search_scan(t: Tables):
    """The same search over texts without an index."""
    return textmine.text_search(t.text_docs, any_of=["was", "éque"], phrases=[("was from", 3)]).select("doc_id", long("hits"))


def event_notes(t: Tables):
    """A short note per event: a measurement section and a course section."""
    cents = F.round(F.col("value") * 100).cast("long")
    amount = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    text = F.concat(
        F.lit("Note of the day\nVital Signs:\n"), F.col("event_type"), F.lit(": "), amount, F.lit(" units, "), F.col("event_type"),
        F.lit(" unknown\nOther remarks:\nnone\nHospital course:\nno "), F.col("event_type"), F.lit(" "), amount, F.lit("\n"),
    )
    # notes are parsed row by row, and events may stand in few row groups
    events = scale.spread_small_input(t.raw("events").select("event_id", "user_id", "event_type", "value"), by_file=True)
    return events.select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("pid"), text.alias("text"))


NOTES = """note AS (SELECT event_id AS doc_id, user_id AS pid, event_type AS et, length(event_type) AS n,
         CAST(CAST(floor(CAST(round(value * 100) AS BIGINT) / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS amount FROM events),
       txt AS (SELECT *, 'Note of the day' || chr(10) || 'Vital Signs:' || chr(10) || et || ': ' || amount || ' units, ' || et || ' unknown' || chr(10)
         || 'Other remarks:' || chr(10) || 'none' || chr(10) || 'Hospital course:' || chr(10) || 'no ' || et || ' ' || amount || chr(10) AS text FROM note)"""
EVENT_TERMS = [("click", "E1"), ("view", "E2"), ("signup", "E3"), ("purchase", "E4"), ("error", "E5")]
SECTION_MAP = {"vital signs": "Vital Signs", "hospital course": "Hospital course"}


def event_gazetteer(t: Tables):
    rows = [(term, cui, "Laboratory Procedure", term.title()) for term, cui in EVENT_TERMS]
    return t.config(rows, "term string, cui string, sty string, pref string")


def section_hits(t: Tables):
    """Dictionary mentions of the event notes in their sections."""
    notes = event_notes(t)
    mentions = textmine.dictionary_annotate(notes, event_gazetteer(t))
    secs = sections.parse_sections(notes.select("doc_id", "text"), SECTION_MAP)
    return notes, joins.mentions_in_sections(mentions, secs)


@query(
    "numeric_search", "PF9",
    f"""WITH {NOTES} SELECT doc_id, CAST(CASE WHEN CAST(amount AS DOUBLE) BETWEEN 10 AND 40 THEN 2 ELSE 0 END AS BIGINT) AS n_in,
       CAST(CASE WHEN CAST(amount AS DOUBLE) BETWEEN 10 AND 40 THEN 0 ELSE 2 END AS BIGINT) AS n_out, CAST(1 AS BIGINT) AS n_unknown,
       CAST(CASE WHEN CAST(amount AS DOUBLE) BETWEEN 10 AND 40 THEN 1 ELSE -1 END AS BIGINT) AS verdict FROM note WHERE et = 'click'""",
)
def numeric_search(t: Tables):
    rows = textmine.numeric_search(event_notes(t), anchor="click", low=10, high=40, number=r"[\s:=]{0,5}(\d+[.]\d+)")
    return rows.select("doc_id", long("n_in"), long("n_out"), long("n_unknown"), long("verdict"))


@query(
    "parse_sections", "N6 W7",
    f"""WITH {NOTES} SELECT doc_id, section, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
         SELECT doc_id, '' AS section, 0 AS s, 16 AS e FROM txt
         UNION ALL SELECT doc_id, 'Vital Signs', 16, instr(text, 'Hospital course:') - 1 FROM txt
         UNION ALL SELECT doc_id, 'Hospital course', instr(text, 'Hospital course:') - 1, length(text) FROM txt)""",
)
def parse_sections(t: Tables):
    rows = sections.parse_sections(event_notes(t), SECTION_MAP)
    return rows.select("doc_id", "section", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


PAGE_PATTERN = r"<(title|nav|article|footer|b)>"
PAGE_MAP = {"title": "Head", "article": "Body", "footer": "Foot"}
PAGES = r"""pp AS (SELECT page_id, x, n, sum(length(x)) OVER (PARTITION BY page_id ORDER BY n) - length(x) AS s FROM
         (SELECT page_id, unnest(regexp_extract_all(html, '<(?:title|nav|article|footer|b)>|[^<]+|<')) AS x,
          generate_subscripts(regexp_extract_all(html, '<(?:title|nav|article|footer|b)>|[^<]+|<'), 1) AS n FROM pages)),
       hd AS (SELECT page_id, s, s + length(x) AS he, CASE x WHEN '<title>' THEN 'Head' WHEN '<article>' THEN 'Body' ELSE 'Foot' END AS section
         FROM pp WHERE x IN ('<title>', '<article>', '<footer>')),
       hs AS (SELECT page_id, 0 AS s, 0 AS he, '' AS section FROM (SELECT DISTINCT page_id FROM pp WHERE regexp_matches(x, '^<(title|nav|article|footer|b)>$')) UNION ALL SELECT page_id, s, he, section FROM hd),
       secs AS (SELECT h.page_id, h.section, h.s, h.he, row_number() OVER (PARTITION BY h.page_id ORDER BY h.s, h.he) AS no,
         coalesce(lead(h.s) OVER (PARTITION BY h.page_id ORDER BY h.s, h.he), length(p.html)) AS e, p.html FROM hs h JOIN pages p ON p.page_id = h.page_id)"""


def page_docs(t: Tables):
    """Pages as dated documents of the host they come from."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("page_id").cast("int"))
    return t.raw("pages").select(
        F.col("page_id").alias("doc_id"), host.alias("pid"), day.alias("doc_date"), F.col("html").alias("text")
    )


@query(
    "page_sections", "N6",
    f"""WITH {PAGES} SELECT page_id AS doc_id, section, CAST(s AS BIGINT) AS s, CAST(he AS BIGINT) AS he, CAST(e AS BIGINT) AS e,
       md5(substring(html, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT))) AS text FROM secs""",
)
def page_sections(t: Tables):
    rows = sections.parse_sections(page_docs(t), PAGE_MAP, pattern=PAGE_PATTERN)
    return rows.select(
        "doc_id", "section", F.col("start").cast("long").alias("s"), F.col("header_end").cast("long").alias("he"),
        F.col("end").cast("long").alias("e"), F.md5("text").alias("text"),
    )


@query(
    "medical_profile", "N7",
    rf"""WITH {PAGES}, l AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS pid, max(page_id) AS doc_id FROM pages GROUP BY 1)
       SELECT l.pid, l.doc_id, CASE WHEN section = '' THEN 'basic' ELSE section END AS name,
       md5(arg_max(substring(html, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), no)) AS text FROM secs JOIN l ON l.doc_id = secs.page_id GROUP BY 1, 2, 3""",
)
def medical_profile(t: Tables):
    rows = sections.medical_profile(page_docs(t), PAGE_MAP, pattern=PAGE_PATTERN)
    return rows.select("pid", "doc_id", F.explode("profile").alias("name", "text")).withColumn("text", F.md5("text"))


@query(
    "section_heading_frequency", "A22",
    r"""SELECT lower(tag) AS title, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM pages) GROUP BY 1""",
)
def section_heading_frequency(t: Tables):
    heads = sections.section_headings(page_docs(t), pattern=r"<([A-Za-z][a-z0-9]*)[^>]*>")
    return sections.merged_headings(heads)


@query(
    "top_headings", "T3",
    r"""SELECT lower(tag) AS title, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM pages)
       GROUP BY 1 ORDER BY freq DESC, title LIMIT 8""",
)
def top_headings(t: Tables):
    heads = sections.section_headings(page_docs(t), pattern=r"<([A-Za-z][a-z0-9]*)[^>]*>")
    return sections.merged_headings(heads, k=8)


SECTIONED = """secs AS (SELECT doc_id, 'Intro' AS section, 0 AS s, 0 AS he, 300 + doc_id % 50 AS e FROM docs
         UNION ALL SELECT doc_id, 'Plan', 300 + doc_id % 50, 330 + doc_id % 50, 700 FROM docs UNION ALL SELECT doc_id, 'Labs', 700, 710, 100000 FROM docs),
       ms AS (SELECT m.*, x.section FROM mentions m JOIN secs x ON m.doc_id = x.doc_id AND m.start_pos >= x.he AND m.start_pos < x.e)"""


def placed_mentions(t: Tables):
    """Mentions in three sections per document, with borders that differ by document."""
    border = F.lit(300) + F.col("doc_id") % 50
    items = F.array(
        F.struct(F.lit("Intro").alias("section"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("header_end"), border.alias("end")),
        F.struct(F.lit("Plan").alias("section"), border.alias("start"), (border + 30).alias("header_end"), F.lit(700).cast("long").alias("end")),
        F.struct(F.lit("Labs").alias("section"), F.lit(700).cast("long").alias("start"), F.lit(710).cast("long").alias("header_end"), F.lit(100000).cast("long").alias("end")),
    )
    secs = t.docs.select("doc_id", F.inline(items)).withColumn("original_section", F.col("section"))
    return joins.mentions_in_sections(t.mentions, secs)


@query("mentions_in_sections", "J6", f"WITH {SECTIONED} SELECT doc_id, cui, start_pos, section FROM ms")
def mentions_in_sections(t: Tables):
    return placed_mentions(t).select("doc_id", "cui", "start_pos", "section")


@query(
    "section_type_counts", "A23",
    f"""WITH {SECTIONED} SELECT section, sty, CAST(count(*) AS BIGINT) AS n FROM ms WHERE section IN ('Plan', 'Labs') GROUP BY section, sty
       UNION ALL SELECT section, '', CAST(count(*) AS BIGINT) FROM ms WHERE section IN ('Plan', 'Labs') GROUP BY section""",
)
def section_type_counts(t: Tables):
    return sections.section_type_counts(placed_mentions(t), ["Plan", "Labs"])


@query(
    "section_extents", "W7",
    """SELECT doc_id, start_pos AS s, CAST(coalesce(lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 100000) AS BIGINT) AS e
       FROM (SELECT DISTINCT doc_id, start_pos FROM mentions WHERE sty = 'PROMO')""",
)
def section_extents(t: Tables):
    heads = t.mentions.where("sty = 'PROMO'").select("doc_id", F.col("start_pos").alias("start")).distinct()
    rows = sections.section_extents(heads.withColumn("text_length", F.lit(100000)))
    return rows.select("doc_id", F.col("start").alias("s"), F.col("end").cast("long").alias("e"))


@query(
    "extract_measurements", "N8 SF16",
    f"""WITH {NOTES} SELECT doc_id, pid, cui, value, CAST(s AS BIGINT) AS start_pos FROM (
         SELECT doc_id, pid, et, amount AS value, 29 AS s FROM txt UNION ALL SELECT doc_id, pid, et, amount, instr(text, 'no ' || et) + 2 FROM txt) x
       JOIN (VALUES ('click','E1'), ('view','E2'), ('signup','E3'), ('purchase','E4'), ('error','E5')) AS g(term, cui) ON g.term = x.et""",
)
def extract_measurements(t: Tables):
    notes, hits = section_hits(t)
    found = sections.extract_measurements(hits, notes, sections=list(SECTION_MAP.values()), types=["Laboratory Procedure"], number=NUMBER)
    return found.join(notes.select("doc_id", "pid"), "doc_id").select("doc_id", "pid", "cui", "value", long("start_pos"))


@query(
    "last_measurements", "N8",
    f"""WITH {NOTES} SELECT pid, upper(et[1]) || et[2:] AS pref, arg_max(amount, doc_id) AS value FROM note GROUP BY ALL""",
)
def last_measurements(t: Tables):
    notes, hits = section_hits(t)
    found = sections.extract_measurements(hits, notes, sections=list(SECTION_MAP.values()), types=["Laboratory Procedure"], number=NUMBER)
    return sections.last_measurement(found.join(notes.select("doc_id", "pid"), "doc_id"))


MASKS = [
    deident.MaskRule("phone", r"\+1 (\(\d+\) \d{3}-\d{4})", ["number"]),
    deident.MaskRule("email", r"([a-z]+\.\d+@mail\d+\.example\.com)", ["name"]),
    deident.MaskRule("address", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", ["name"]),
    deident.MaskRule("title", r"\b(und|the) ([a-z]+th)\b", ["title", "name"]),
]


@query(
    "deidentify", "N5",
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '\+1 (\(\d+\) \d{3}-\d{4})'))
       + len(regexp_extract_all(text, '(?i)([a-z]+\.\d+@mail\d+\.example\.com)')) + len(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b'))
       + len(regexp_extract_all(text, '(?i)\b(?:und|the) ([a-z]+th)\b')) AS BIGINT) AS n FROM documents""",
)
def deidentify(t: Tables):
    rows = deident.deidentify(t.text_docs, MASKS)
    return rows.select("doc_id", F.length("masked").cast("long").alias("chars"), F.size("found").cast("long").alias("n"))


@query(
    "sensitive_values", "A32 N5",
    r"""SELECT DISTINCT 'phone' AS type, unnest(regexp_extract_all(text, '\+1 (\(\d+\) \d{3}-\d{4})', 1)) AS value FROM documents
       UNION SELECT 'email', unnest(regexp_extract_all(text, '(?i)([a-z]+\.\d+@mail\d+\.example\.com)', 1)) FROM documents
       UNION SELECT 'address', unnest(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1)) FROM documents
       UNION SELECT 'title', unnest(regexp_extract_all(text, '(?i)\b(?:und|the) ([a-z]+th)\b', 1)) FROM documents""",
)
def sensitive_values(t: Tables):
    return deident.sensitive_values(deident.deidentify(t.text_docs, MASKS))


# fixed offsets of the masked group in the match of each rule
MASKED_PARTS = [
    (r"\+1 \(\d+\) \d{3}-\d{4}", 3), (r"(?i)[a-z]+\.\d+@mail\d+\.example\.com", 0),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0), (r"(?i)\b(?:und|the) [a-z]+th\b", 4),
]
MASKED = ", ".join(
    f"""m{k} AS (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS n,
       unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap FROM documents),
       s{k} AS (SELECT doc_id, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS e, length(m) - {skip} AS len FROM m{k})"""
    for k, (p, skip) in enumerate(MASKED_PARTS)
)


@query(
    "masked_documents", "N5",
    f"""WITH {MASKED}, hid AS (SELECT DISTINCT doc_id, unnest(range(e - len + 1, e + 1)) AS i FROM
         ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(MASKED_PARTS)))}) WHERE len >= 2),
       chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents
         WHERE doc_id IN (SELECT doc_id FROM hid)),
       made AS (SELECT c.doc_id, string_agg(CASE WHEN h.i IS NOT NULL AND c.c NOT IN (' ', chr(9), chr(10), chr(13)) THEN 'x' ELSE c.c END, '' ORDER BY c.i) AS masked
         FROM chars c LEFT JOIN hid h ON h.doc_id = c.doc_id AND h.i = c.i GROUP BY c.doc_id)
       SELECT d.doc_id, md5(coalesce(m.masked, d.text)) AS masked, CAST(length(d.text) AS BIGINT) AS chars FROM documents d LEFT JOIN made m ON m.doc_id = d.doc_id""",
)
def masked_documents(t: Tables):
    rows = deident.deidentify(t.text_docs, MASKS)
    return rows.select("doc_id", F.md5("masked").alias("masked"), F.length("masked").cast("long").alias("chars"))


VOCAB = f"""{WORDS}, voc AS (SELECT w AS token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS idx FROM w GROUP BY w
         ORDER BY count(*) DESC, w LIMIT 500)"""


@query("vocabulary", "A31", f"WITH {VOCAB} SELECT token, CAST(n AS BIGINT) AS n, CAST(idx AS BIGINT) AS idx FROM voc")
def vocabulary(t: Tables):
    return textmine.vocabulary(t.text_docs, top=500).select("token", "n", long("idx"))


@query(
    "encode_windows", "SF24",
    f"""WITH {VOCAB}, m AS (SELECT x.doc_id || '-' || x.start_pos || '-' || x.cui AS id,
           regexp_extract_all(lower(substring(d.text, 1, x.start_pos)), {WORDS_OF}) AS a,
           regexp_extract_all(lower(substring(d.text, x.end_pos + 1)), {WORDS_OF}) AS b FROM tmentions x JOIN documents d ON d.doc_id = x.doc_id),
       l AS (SELECT id, list_concat(a[greatest(len(a) - 3, 1):], b[1:4]) AS ws FROM m),
       u AS (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM l),
       c AS (SELECT u.id, string_agg(CAST(v.idx + 1 AS VARCHAR), ' ' ORDER BY u.i) AS s, count(v.idx) AS k FROM u LEFT JOIN voc v ON u.token = v.token GROUP BY u.id)
       SELECT l.id, trim(coalesce(c.s, '') || repeat(' 0', CAST(8 - coalesce(c.k, 0) AS BIGINT))) AS codes FROM l LEFT JOIN c ON l.id = c.id""",
)
def encode_windows(t: Tables):
    ids = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("start_pos").cast("string"), "cui")
    rows = t.text_mentions.withColumn("id", ids)
    vocab = textmine.vocabulary(t.text_docs, top=500)
    codes = textmine.encode_windows(rows, t.text_docs, vocab, side=4, size=8)
    return codes.select("id", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"))


TAGS = [("was", "VERB"), ("and", "CCONJ"), ("of", "ADP"), ("from", "ADP"), ("by", "ADP"), ("the", "DET"), ("in", "ADP"), ("that", "PRON")]
TAGGED = """tag(token, tag) AS (VALUES ('was','VERB'), ('and','CCONJ'), ('of','ADP'), ('from','ADP'), ('by','ADP'), ('the','DET'), ('in','ADP'), ('that','PRON')),
       seq AS (SELECT m.doc_id, m.cui, m.start_pos, k.tok_no, CASE WHEN k.start_pos >= m.start_pos AND k.end_pos <= m.end_pos THEN 'KCL'
           ELSE coalesce(g.tag, 'NOUN') END AS tag FROM tmentions m JOIN toks k ON k.doc_id = m.doc_id AND k.sent_no = m.sent_no
         LEFT JOIN tag g ON g.token = lower(k.token)),
       runs AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id, cui, start_pos ORDER BY tok_no) AS p FROM seq),
       fp AS (SELECT doc_id, cui, start_pos, string_agg(tag, '->' ORDER BY tok_no) AS full_pattern FROM runs WHERE p IS NULL OR p <> tag GROUP BY ALL)"""


def instances(t: Tables):
    mentions = t.text_mentions.drop("sty", "pref")
    return patterns.pattern_features(mentions, t.text_docs, t.config(TAGS, "token string, tag string"))


@query("pattern_features", "N9", f"WITH {TAGGED} SELECT doc_id, cui, start_pos, full_pattern FROM fp")
def pattern_features(t: Tables):
    return instances(t).select("doc_id", "cui", long("start_pos"), "full_pattern")


LEVELS = """tag(token, tag) AS (VALUES ('was','VERB'), ('and','CCONJ'), ('of','ADP'), ('from','ADP'), ('by','ADP'), ('the','DET'), ('in','ADP'), ('that','PRON')),
       held AS (SELECT DISTINCT doc_id, sent_no FROM tmentions),
       sent AS MATERIALIZED (SELECT k.doc_id, k.sent_no, list(coalesce(g.tag, 'NOUN') ORDER BY k.tok_no) AS tags, list(k.token ORDER BY k.tok_no) AS words,
           list(k.start_pos ORDER BY k.tok_no) AS starts, list(k.end_pos ORDER BY k.tok_no) AS ends
         FROM toks k JOIN held h ON h.doc_id = k.doc_id AND h.sent_no = k.sent_no LEFT JOIN tag g ON g.token = lower(k.token) GROUP BY ALL),
       placed AS (SELECT m.*, s.tags, s.words, len(s.tags) AS size, len(list_filter(s.starts, lambda x: x < m.start_pos)) AS f,
           len(list_filter(s.ends, lambda x: x <= m.end_pos)) AS nx FROM tmentions m JOIN sent s ON s.doc_id = m.doc_id AND s.sent_no = m.sent_no),
       cutoff AS (SELECT *, coalesce(list_max(list_filter(range(size), lambda i: i < f AND tags[i + 1] IN ('VERB', 'CCONJ', 'ADP'))), -1) + 1 AS lo,
           coalesce(list_min(list_filter(range(size), lambda i: i >= nx AND tags[i + 1] IN ('VERB', 'CCONJ', 'ADP'))), size) AS hi,
           coalesce(list_max(list_filter(range(size), lambda i: i < f AND tags[i + 1] = 'VERB')), 0) AS verb FROM placed WHERE nx > f),
       around AS (SELECT *, list_concat(tags[lo + 1:f], ['KCL'], tags[nx + 1:hi]) AS st,
           list_filter(list_reverse(range(verb, f)), lambda i: tags[i + 1] IN ('VERB', 'NOUN', 'PROPN')) AS content FROM cutoff),
       levels AS (SELECT doc_id, cui, start_pos, negation, temporality, experiencer,
           array_to_string(list_filter(st, lambda x, i: i = 1 OR st[i - 1] <> x), '->') AS pattern,
           concat_ws(' =#= ', nullif(array_to_string(words[lo + 1:f], ' '), ''), nullif(array_to_string(words[nx + 1:hi], ' '), '')) AS variant,
           array_to_string(list_reverse(tags[verb + 1:f]), '<-') AS sent_pattern,
           array_to_string(list_transform(content, lambda i: words[i + 1]), ' ') AS sent_text FROM around)"""


@query(
    "pattern_levels", "N9",
    f"WITH {LEVELS} SELECT doc_id, cui, start_pos, pattern, variant, sent_pattern, sent_text FROM levels",
)
def pattern_levels(t: Tables):
    return instances(t).select("doc_id", "cui", long("start_pos"), "pattern", "variant", "sent_pattern", "sent_text")


@query(
    "top_patterns", "T4",
    f"WITH {TAGGED} SELECT full_pattern, CAST(count(*) AS BIGINT) AS n FROM fp GROUP BY full_pattern ORDER BY n DESC, full_pattern LIMIT 10",
)
def top_patterns(t: Tables):
    return patterns.top_patterns(instances(t))


@query(
    "short_patterns", "T6",
    f"WITH {TAGGED} SELECT DISTINCT full_pattern FROM fp WHERE len(string_split(full_pattern, '->')) <= 5",
)
def short_patterns(t: Tables):
    return patterns.short_patterns(instances(t))
