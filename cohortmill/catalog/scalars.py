"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalog.base import query
from cohortmill.functions import codes
from cohortmill.functions import context as cx
from cohortmill.functions import text as tx
from cohortmill.sources.tables import Tables

NUMBER = r"\d+(?:[.,/]\d+)*%?"


@query("context_classes", "SF1 SF2 SF3", "SELECT ctx_id, type, ui_type, CAST(count(*) AS BIGINT) AS n FROM typed GROUP BY ALL")
def context_classes(t: Tables):
    return t.mentions.groupBy(
        cx.ctx_id().alias("ctx_id"), cx.ctx_class().alias("type"), cx.ctx_class_ui().alias("ui_type")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "collapsed_spaces", "SF4 SF5",
    r"""SELECT doc_id, md5(regexp_replace(text, '\s{2,}', ' ', 'g')) AS one, md5(regexp_replace(text, '\s{2,}', chr(10), 'g')) AS lines,
       md5(regexp_replace(regexp_replace(text, '[ \t\f\r]+\n\s*|\n\s+', chr(10), 'g'), '[ \t\f\r]{2,}', ' ', 'g')) AS kept FROM documents""",
)
def collapsed_spaces(t: Tables):
    return t.text_docs.select(
        "doc_id",
        F.md5(tx.collapse_spaces("text")).alias("one"),
        F.md5(tx.collapse_to_newline("text")).alias("lines"),
        F.md5(tx.collapse_keep_newline("text")).alias("kept"),
    )


@query(
    "normalised_titles", "SF6",
    r"""SELECT doc_id, sent_no, lower(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^\d\.\s+.*', '')) AS whole,
       lower(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^\d\.\s+', '')) AS number_only
       FROM (SELECT doc_id, sent_no, CASE WHEN sent_no % 3 = 0 THEN concat(sent_no % 10, '. ', regexp_replace(sent_text, '[^A-Za-z0-9 ]', '', 'g'))
         ELSE concat(' ', regexp_replace(sent_text, '[^A-Za-z0-9 ]', '', 'g'), '  ') END AS raw FROM sents)""",
)
def normalised_titles(t: Tables):
    from cohortmill.operators import textmine

    plain = F.regexp_replace("sent_text", "[^A-Za-z0-9 ]", "")
    raw = F.when(
        F.col("sent_no") % 3 == 0, F.concat((F.col("sent_no") % 10).cast("string"), F.lit(". "), plain)
    ).otherwise(F.concat(F.lit(" "), plain, F.lit("  ")))
    rows = textmine.sentences(t.text_docs).select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), raw.alias("raw"))
    return rows.select(
        "doc_id", "sent_no", tx.normalise_title("raw").alias("whole"), tx.normalise_title("raw", True).alias("number_only")
    )


@query(
    "clean_tokens", "SF7",
    r"""SELECT doc_id, tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(w, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g') AS tok
       FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents))
       WHERE tok NOT IN ('', 'the', 'a', 'an', 'these', 'that') GROUP BY doc_id, tok""",
)
def clean_tokens(t: Tables):
    rows = t.text_docs.select("doc_id", F.explode(tx.clean_tokens("text")).alias("tok"))
    return rows.groupBy("doc_id", "tok").agg(F.count(F.lit(1)).alias("n"))


@query(
    "char_windows", "SF8",
    """SELECT m.doc_id, m.cui, m.start_pos, md5(substring(d.text, greatest(m.start_pos - 150, 0) + 1, m.start_pos - greatest(m.start_pos - 150, 0))) AS before_text,
       md5(substring(d.text, m.end_pos + 1, 150)) AS after_text, md5(substring(d.text, 1, 200)) AS head FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id""",
)
def char_windows(t: Tables):
    rows = t.text_mentions.join(t.text_docs.select("doc_id", "text"), "doc_id")
    return rows.select(
        "doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"),
        F.md5(tx.before("text", F.col("start_pos"))).alias("before_text"),
        F.md5(tx.after("text", F.col("end_pos"))).alias("after_text"),
        F.md5(F.substring("text", 1, tx.HEAD_WINDOW)).alias("head"),
    )


@query(
    "token_windows", "SF9",
    r"""WITH w AS (SELECT m.doc_id, m.cui, m.start_pos,
         list_filter(regexp_split_to_array(substring(d.text, 1, m.start_pos), '\s+'), lambda x: x <> '') AS a,
         list_filter(regexp_split_to_array(substring(d.text, m.end_pos + 1), '\s+'), lambda x: x <> '') AS b
         FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id)
       SELECT doc_id, cui, start_pos, array_to_string(a[greatest(len(a) - 2, 1):], ' ') AS prev_words, array_to_string(b[1:3], ' ') AS next_words FROM w""",
)
def token_windows(t: Tables):
    rows = t.text_mentions.join(t.text_docs.select("doc_id", "text"), "doc_id")
    return rows.select(
        "doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"),
        F.array_join(tx.tokens_before("text", F.col("start_pos"), 3), " ").alias("prev_words"),
        F.array_join(tx.tokens_after("text", F.col("end_pos"), 3), " ").alias("next_words"),
    )


@query(
    "context_labels", "SF10",
    """SELECT doc_id, start_pos, cui, concat(CASE WHEN negation <> 'Affirmed' THEN negation || '_' ELSE '' END,
         CASE WHEN temporality <> 'Recent' THEN temporality || '_' ELSE '' END, CASE WHEN experiencer <> 'Patient' THEN experiencer || '_' ELSE '' END,
         CASE WHEN ruled_by IS NOT NULL THEN 'ruled_' ELSE '' END, pref, '(', cui, ')') AS label,
       CASE WHEN ruled_by = 'rule_a' THEN '' WHEN ruled_by = 'rule_b' THEN 'Negated' WHEN negation <> 'Affirmed' THEN negation ELSE '' END AS simple FROM mentions""",
)
def context_labels(t: Tables):
    ruled = F.array_compact(F.array("ruled_by"))
    return t.mentions.select(
        "doc_id", "start_pos", "cui", cx.context_label(F.col("ruled_by").isNotNull()).alias("label"),
        cx.simple_context(ruled, "rule_a", "rule_b").alias("simple"),
    )


@query(
    "mention_keys", "SF11",
    """SELECT DISTINCT 'd' || doc_id || '_s' || start_pos || '_e' || end_pos AS key, CAST(doc_id AS VARCHAR) AS doc, start_pos, end_pos FROM mentions""",
)
def mention_keys(t: Tables):
    keys = t.mentions.select(cx.mention_key().alias("key")).distinct()
    parsed = cx.parse_mention_key("key")
    return keys.select("key", parsed["doc"].alias("doc"), parsed["start"].alias("start_pos"), parsed["end"].alias("end_pos"))


@query(
    "snippets", "SF12",
    """SELECT m.doc_id, m.cui, m.start_pos, concat(CASE WHEN m.start_pos > 20 OR (m.start_pos <= 20 AND m.start_pos > 0) THEN '...' ELSE '' END,
         substring(d.text, CASE WHEN m.start_pos > 20 THEN m.start_pos - 20 ELSE m.start_pos END + 1, CASE WHEN m.start_pos > 20 THEN 20 ELSE 0 END),
         '<em>', substring(d.text, m.start_pos + 1, m.end_pos - m.start_pos), '</em>', substring(d.text, m.end_pos + 1, 20),
         CASE WHEN m.end_pos + 20 < length(d.text) THEN '...' ELSE '' END) AS snippet
       FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id""",
)
def snippets(t: Tables):
    rows = t.text_mentions.join(t.text_docs.select("doc_id", "text"), "doc_id")
    shown = tx.snippet("text", F.col("start_pos"), F.col("end_pos"))
    return rows.select("doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"), shown.alias("snippet"))


@query(
    "highlighted_text", "SF12",
    r"""SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9]+tion', '<em>\0</em>', 'g')) AS shown,
       md5(regexp_replace(text, '([A-Za-z0-9]+tion)', ' posM \1', 'g')) AS marked FROM documents""",
)
def highlighted_text(t: Tables):
    rows = t.text_docs.withColumn("spans", tx.find_spans("text", "[A-Za-z0-9]+tion"))
    marks = F.transform("spans", lambda s: F.struct(s["start"].alias("pos"), F.lit(" posM ").alias("mark")))
    return rows.select(
        "doc_id", F.md5(tx.highlight("text", F.col("spans"))).alias("shown"), F.md5(tx.insert_marks("text", marks)).alias("marked")
    )


@query(
    "stripped_namespaces", "SF13",
    "SELECT p_partkey, 'C' || p_partkey AS a, 'HP_' || p_partkey AS b FROM part",
)
def stripped_namespaces(t: Tables):
    key = F.col("p_partkey").cast("string")
    return t.raw("part").select(
        "p_partkey",
        tx.strip_namespace(F.concat(F.lit("UMLS:C"), key)).alias("a"),
        tx.strip_namespace(F.concat(F.lit("http://example.org/onto/HP_"), key)).alias("b"),
    )


@query(
    "first_numbers", "SF16",
    r"""SELECT doc_id, sent_no, nullif(regexp_extract(sent_text, '^[A-Za-z]+([^*\d]{1,15})(\d+(?:[.,/]\d+)*%?)', 2), '') AS number FROM sents
       WHERE regexp_matches(sent_text, '^[A-Za-z]+')""",
)
def first_numbers(t: Tables):
    from cohortmill.operators import textmine

    # the number behind the first word of each sentence
    rows = textmine.sentences(t.text_docs).where(F.col("sent_text").rlike("^[A-Za-z]+"))
    end = F.length(F.regexp_extract("sent_text", "^[A-Za-z]+", 0))
    return rows.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), tx.first_number("sent_text", end, NUMBER).alias("number"))


@query(
    "cut_off_positions", "SF17",
    """SELECT m.doc_id, m.cui, m.start_pos, instr(lower(d.text), 'with') - 1 > 0 AND m.start_pos >= instr(lower(d.text), 'with') - 1 AS behind
       FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id""",
)
def cut_off_positions(t: Tables):
    # the anchor is looked for once per text, and no text is joined to mentions
    anchors = t.text_docs.select("doc_id", tx.anchor_position("text", "With").alias("anchor"))
    rows = t.text_mentions.join(anchors, "doc_id")
    behind = tx.at_or_after("anchor", F.col("start_pos"))
    return rows.select("doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"), behind.alias("behind"))


@query(
    "original_string_rule", "SF18",
    "SELECT str, regexp_matches(str, '^(?:[bc]l?o?[ul][ed]? )') OR regexp_matches(str, '^(?:old r.*)') AS hit, CAST(count(*) AS BIGINT) AS n FROM mentions GROUP BY ALL",
)
def original_string_rule(t: Tables):
    hit = tx.original_string_match("str", ["[bc]l?o?[ul][ed]? ", "old r.*"])
    return t.mentions.groupBy("str", hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_helpers", "SF19",
    """SELECT doc_id, strftime(CAST(doc_date AS DATE) - 73000, '%Y-%m-%d') AS shifted, CAST(epoch(doc_date) AS BIGINT) AS seconds,
       strftime(doc_date, '%Y-%m-%d') AS parsed FROM docs""",
)
def date_helpers(t: Tables):
    text = F.when(F.col("doc_id") % 2 == 0, F.date_format("doc_date", "dd/MM/yyyy HH:mm")).otherwise(
        F.date_format("doc_date", "yyyy-MM-dd HH:mm:ss.SSS")
    )
    parsed = codes.parse_time(text, "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss.SSS")
    return t.docs.select(
        "doc_id",
        F.date_format(codes.shift_back(F.to_date("doc_date")), "yyyy-MM-dd").alias("shifted"),
        codes.epoch("doc_date").alias("seconds"),
        F.date_format(parsed, "yyyy-MM-dd").alias("parsed"),
    )


@query(
    "masked_spans", "SF20",
    r"""SELECT m.doc_id, m.cui, m.start_pos, md5(concat(substring(d.text, 1, m.start_pos),
         regexp_replace(substring(d.text, m.start_pos + 1, m.end_pos - m.start_pos), '[^\n\s]', 'x', 'g'), substring(d.text, m.end_pos + 1))) AS masked
       FROM tmentions m JOIN documents d ON m.doc_id = d.doc_id""",
)
def masked_spans(t: Tables):
    rows = t.text_mentions.join(t.text_docs.select("doc_id", "text"), "doc_id")
    masked = tx.mask_span("text", F.col("start_pos"), F.col("end_pos"))
    return rows.select("doc_id", "cui", F.col("start_pos").cast("long").alias("start_pos"), F.md5(masked).alias("masked"))


@query(
    "table_cells", "SF21",
    """SELECT p.pid, coalesce(CAST(x.n AS VARCHAR), '0') AS zero, coalesce(CAST(x.n AS VARCHAR), '-') AS dash FROM patients p
       LEFT JOIN (SELECT pid, count(*) AS n FROM docs WHERE doc_type = '1-URGENT' GROUP BY pid) x ON x.pid = p.pid""",
)
def table_cells(t: Tables):
    n = t.docs.where("doc_type = '1-URGENT'").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return t.patients.join(n, "pid", "left").select("pid", cx.cell(F.col("n")).alias("zero"), cx.cell(F.col("n"), "-").alias("dash"))


@query(
    "cuis_in_query", "SF22",
    "SELECT p_partkey, printf('C%07d', p_partkey) AS first_id, CAST(2 AS BIGINT) AS n FROM part",
)
def cuis_in_query(t: Tables):
    key = F.format_string("%07d", F.col("p_partkey").cast("long"))
    text = F.concat(F.lit("patients with C"), key, F.lit(" or C99"), key, F.lit(", not C12"))
    found = tx.cuis_in(text)
    return t.raw("part").select("p_partkey", found[0].alias("first_id"), F.size(found).cast("long").alias("n"))


@query("hashed_names", "SF23", "SELECT c_name AS name, upper(md5(c_name)) AS id FROM customer")
def hashed_names(t: Tables):
    return t.raw("customer").select(F.col("c_name").alias("name"), cx.name_id("c_name").alias("id"))


@query(
    "collapsed_runs", "W10",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w,
         generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM documents),
       g AS (SELECT doc_id, i, w, CASE WHEN length(w) <= 3 THEN 'S' WHEN length(w) <= 6 THEN 'M' ELSE 'L' END AS tag FROM w),
       r AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g)
       SELECT doc_id, md5(string_agg(tag, '->' ORDER BY i)) AS runs FROM r WHERE p IS NULL OR p <> tag GROUP BY doc_id""",
)
def collapsed_runs(t: Tables):
    tags = F.transform(tx.words("text"), lambda w: F.when(F.length(w) <= 3, "S").when(F.length(w) <= 6, "M").otherwise("L"))
    rows = t.text_docs.select("doc_id", tx.collapse_runs(tags).alias("runs")).where(F.size("runs") > 0)
    return rows.select("doc_id", F.md5(F.array_join("runs", "->")).alias("runs"))
