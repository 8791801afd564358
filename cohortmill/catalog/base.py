"""Registry of queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortmill.session import tune
from cohortmill.sources.tables import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    """One query: what it covers, how Spark builds it and the SQL to compare with."""

    name: str
    covers: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# words of letters and digits of any script, as an SQL literal
WORDS_OF = r"'[\p{L}\p{N}]+'"

# Common table expressions of the SQL side, in order; a query takes the ones it mentions.
VIEWS: dict[str, str] = {
    "patients": "SELECT c_custkey AS pid, c_mktsegment AS cohort FROM customer",
    "docs": """SELECT o_orderkey AS doc_id, o_custkey AS pid, o_orderdate AS doc_date,
        o_orderpriority AS doc_type, o_orderstatus AS src_table FROM orders""",
    "mentions": """SELECT l.l_orderkey AS doc_id, l.l_partkey AS cui_num,
        printf('C%07d', l.l_partkey) AS cui,
        p.p_name AS str, p.p_type AS sty, p.p_brand AS pref,
        CAST(l.l_quantity AS INT) * 20 + l.l_linenumber AS start_pos,
        CAST(l.l_quantity AS INT) * 20 + l.l_linenumber + CAST(length(p.p_name) AS INT) AS end_pos,
        CASE WHEN l.l_returnflag = 'N' THEN 'Negated' ELSE 'Affirmed' END AS negation,
        CASE WHEN l.l_linestatus = 'F' THEN 'historical' ELSE 'Recent' END AS temporality,
        CASE WHEN l.l_suppkey % 10 = 0 THEN 'Other' ELSE 'Patient' END AS experiencer,
        CASE WHEN l.l_tax >= 0.07 THEN 'rule_a' WHEN l.l_discount >= 0.09 THEN 'rule_b' END AS ruled_by
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "typed": """SELECT *, CASE WHEN experiencer = 'Other' THEN 'Other'
        WHEN temporality = 'historical' THEN 'historical' WHEN temporality = 'hypothetical' THEN 'hypothetical'
        WHEN negation = 'Negated' THEN 'Negated' ELSE 'positive' END AS type,
        CASE WHEN experiencer <> 'Patient' THEN 'otherM' WHEN temporality <> 'Recent' THEN 'hisM'
        WHEN negation = 'Negated' THEN 'negM' ELSE 'posM' END AS ui_type,
        upper(md5(concat_ws('_', cui, negation, experiencer, temporality))) AS ctx_id FROM mentions""",
    "edges": """SELECT printf('C%07d', CAST(floor(p_partkey / 10) AS BIGINT)) AS parent,
        printf('C%07d', p_partkey) AS child FROM part WHERE p_partkey >= 10""",
    "labels_dim": """SELECT printf('C%07d', p_partkey) AS cui, p_name AS label,
        p_type AS sty FROM part""",
    "seeds": """SELECT name, priority, printf('C%07d', seed) AS cui FROM (VALUES
        ('S1', 1, 1), ('S2', 2, 12), ('S3', 3, 2), ('S4', 4, 3), ('S5', 5, 4)) AS t(name, priority, seed)""",
    "closure": """SELECT name, priority, cui FROM seeds UNION
        SELECT c.name, c.priority, e.child FROM closure c JOIN edges e ON e.parent = c.cui""",
    "exclusive": "SELECT arg_max(name, priority) AS name, max(priority) AS priority, cui FROM closure GROUP BY cui",
    "index_dates": "SELECT pid, min(doc_date) AS index_date FROM docs GROUP BY pid",
    "windows": """SELECT pid, index_date - INTERVAL 180 DAY AS t0, index_date + INTERVAL 180 DAY AS t1
        FROM index_dates""",
    "feedback": """SELECT m.doc_id, m.start_pos, m.end_pos,
        min(CASE WHEN b.toxic = 1 THEN 'wrongM' WHEN b.quality = 0 AND m.start_pos % 2 = 0 THEN 'hypoM'
            ELSE m.ui_type END) AS label, concat('team_', CAST(m.doc_id % 3 AS VARCHAR)) AS annotator
        FROM typed m JOIN labels b ON m.doc_id = b.doc_id GROUP BY m.doc_id, m.start_pos, m.end_pos""",
    "pieces": r"""SELECT doc_id, n, txt, sum(length(txt)) OVER (PARTITION BY doc_id ORDER BY n) - length(txt) AS s
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.\n]+\.?|[.\n]')) AS txt,
              generate_subscripts(regexp_extract_all(text, '[^.\n]+\.?|[.\n]'), 1) AS n FROM documents)""",
    "sents": r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sent_no,
        s + length(txt) - length(regexp_replace(txt, '^\s+', '')) AS sent_start, s + length(txt) AS sent_end,
        regexp_replace(txt, '^\s+', '') AS sent_text FROM pieces WHERE regexp_matches(txt, '[^\s.]')""",
    "toks": r"""SELECT doc_id, sent_no, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY n) - 1 AS tok_no,
        sent_start + s AS start_pos, sent_start + s + length(w) AS end_pos, w AS token
        FROM (SELECT doc_id, sent_no, sent_start, n, w,
                sum(length(w)) OVER (PARTITION BY doc_id, sent_no ORDER BY n) - length(w) AS s
              FROM (SELECT doc_id, sent_no, sent_start,
                      unnest(regexp_extract_all(sent_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) AS w,
                      generate_subscripts(regexp_extract_all(sent_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), 1) AS n
                    FROM sents)) WHERE regexp_matches(w, '^[\p{L}\p{N}]')""",
    "gaz": """SELECT * FROM (VALUES ('thatin','C9000001','Disease or Syndrome','Thatin'),
        ('ononst','C9000002','Disease or Syndrome','Ononst'), ('inoran','C9000003','Sign or Symptom','Inoran'),
        ('hehely','C9000004','Laboratory Procedure','Hehely'),
        ('orantion','C9000005','Pharmacologic Substance','Orantion'), ('of','C9000006','Finding','Of'),
        ('of the','C9000007','Body Part, Organ','Of The')) AS t(term, cui, sty, pref)""",
    "grams": """SELECT doc_id, sent_no, start_pos, end_pos, lower(token) AS term FROM toks UNION ALL
        SELECT a.doc_id, a.sent_no, a.start_pos, b.end_pos, lower(a.token) || ' ' || lower(b.token)
        FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND b.tok_no = a.tok_no + 1""",
    "hits": """SELECT g.doc_id, g.sent_no, z.cui, z.sty, z.pref, g.start_pos, g.end_pos FROM grams g
        JOIN gaz z ON g.term = z.term""",
    "tmentions": """SELECT h.doc_id, h.sent_no, h.cui, h.sty, h.pref,
        substring(d.text, CAST(h.start_pos AS BIGINT) + 1, CAST(h.end_pos - h.start_pos AS BIGINT)) AS str,
        CAST(h.start_pos AS BIGINT) AS start_pos, CAST(h.end_pos AS BIGINT) AS end_pos,
        CASE WHEN h.start_pos % 4 = 0 THEN 'Negated' ELSE 'Affirmed' END AS negation,
        CASE WHEN (h.doc_id + h.start_pos) % 5 = 0 THEN 'historical'
             WHEN (h.doc_id + h.start_pos) % 7 = 0 THEN 'hypothetical' ELSE 'Recent' END AS temporality,
        CASE WHEN h.start_pos % 11 = 0 THEN 'Other' ELSE 'Patient' END AS experiencer
        FROM hits h JOIN documents d ON h.doc_id = d.doc_id WHERE NOT EXISTS (SELECT 1 FROM hits o
          WHERE o.doc_id = h.doc_id AND o.sent_no = h.sent_no AND o.start_pos <= h.start_pos
          AND o.end_pos >= h.end_pos AND o.end_pos - o.start_pos > h.end_pos - h.start_pos)""",
    "evs": """SELECT event_id, user_id AS pid, event_type AS concept, ts, CAST(floor(value) AS BIGINT) AS value,
        CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'Negated' ELSE 'Affirmed' END AS negation,
        upper(md5(concat_ws('_', event_type, CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'Negated'
            ELSE 'Affirmed' END, 'Patient', 'Recent'))) AS ctx_id FROM events""",
}


def with_views(body: str) -> str:
    """The SQL with the views that it needs, in their order, in front."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(sql)
    if not needed:
        return re.sub(r"^WITH\b", "WITH RECURSIVE", body.strip())
    parts = [f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query builder."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(name, covers, build, None if sql is None else with_views(sql))
        return build

    return add


def runnable(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of a session and a data folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Tables(tune(spark), sf_dir))

    run.__name__ = entry.name
    return run
