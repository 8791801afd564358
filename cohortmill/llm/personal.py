"""Personal data: expressions propose spans, checksums confirm them, and words nearby adjust their score.

Every kind has an expression whose leftmost matches that do not overlap are its proposals, and a check: parts of at most 255 for
addresses of machines, the Luhn sum for cards, a number of digits for phones, the remainder by 97 for bank accounts, the
ranges in use for social security numbers. Where a proposal for a card fails, groups of digits inside it are proposed again. What passes
gets a score in percent from its kind, its check and the words up to ``BEFORE`` characters before and ``AFTER`` behind it (not
beyond the next proposal of the kind). Spans of the four basic kinds always stay; all others need ``THRESHOLD``.

The offsets of proposals are the summed lengths of the gaps and proposals before them, so the work is linear in the text. The expressions are
written so that no start inside a run is tried again: a run that fails from its first character fails from all of them. Only DataFrame
functions run on the rows; nothing is shuffled.

Defined results: a null text counts as empty and has no spans; repeated rows are judged on their own; extra columns are not read by
the digest and kept by :func:`masked`; an empty table gives no rows. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import text as tx

#: Characters of context, and the score in percent that spans beyond the basic ones need.
BEFORE, AFTER, THRESHOLD = 40, 24, 60

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lengths of account numbers by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI", 20: "AT EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB IE", 24: "CZ ES RO SE SK",
    25: "PT", 26: "IS", 27: "FR GR IT MC", 28: "CY HU PL", 31: "MT",
}
ACCOUNT = "|".join(
    f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:[\\x20-]?[A-Z0-9]){{{n - 4}}}" for n, countries in ACCOUNT_LENGTHS.items()
)
#: Digit groups proposed again inside a proposal for a card that fails.
CARD_GROUP = r"[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19}"
#: A number of at most 255, with zeros in front.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

SPAN = "struct<start:int,rank:int,end:int,kind:string,str:string,score:int,basic:boolean>"


@dataclass(frozen=True)
class Kind:
    """What proposes, confirms and scores one kind of spans."""

    name: str
    #: Expression for Spark, and the plain one that finds the same in engines whose matching is linear.
    pattern: str
    plain: str
    #: Score without context, words that raise it and words that lower it, each by ``step``.
    score: int
    raised: str
    lowered: str
    basic: bool = True
    #: A text without a match of this cheap expression has no proposal.
    guard: str | None = None
    step: int = 20


KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        70, "mail|contact|write|reply|kontakt|correo|courriel", "package|import", guard="@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        60, "ip|host|server|login|address|adresse", "version|release|section|chapter",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9])+",
        70, "card|visa|credit|debit|karte|tarjeta|carte", "order|invoice|isbn|serial", guard=r"[0-9](?:[\x20-]?[0-9]){12}",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        70, "phone|call|tel|mobile|fax|whatsapp", "score|points", guard=r"\+[0-9]",
    ),
    Kind(
        "iban", ACCOUNT, ACCOUNT, 80, "iban|account|bank|konto|cuenta|compte", "serial|key",
        basic=False, guard=r"[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]",
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, "ssn|social|security|taxpayer|tax id",
        "order|part|model", basic=False,
    ),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits has a Luhn sum that ends in zero; false for all other lengths."""

    def total(back: Column) -> Column:
        def worth(k: Column) -> Column:
            digit = back.substr(k, F.lit(1))
            return F.when(k % 2 == 1, digit).otherwise(F.translate(digit, "0123456789", "0246813579")).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda n, k: n + worth(k))

    return F.when(F.length(digits).between(13, 19), tx.let(F.reverse(digits), total) % 10 == 0).otherwise(False)


def remainder_97(account: Column) -> Column:
    """Remainder by 97 of an account number of A-Z and 0-9, its first four characters moved to the end, letters from 10 on."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return tx.let(turned, lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: t.substr(k, F.lit(1))), F.lit(0), step))


def confirmed(kind: Kind, hit: Column) -> Column:
    """Whether a proposal ``struct<start, end, str, before, after>`` passes the check of its kind."""
    found = hit["str"]
    if kind.name == "ip":
        return F.forall(F.split(found, r"\."), lambda part: part.rlike(f"^{PART}$"))
    if kind.name == "card":
        return tx.let(digits_of(found), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind.name == "phone":
        return F.length(digits_of(found)).between(10, 15)
    if kind.name == "iban":
        alone = ~hit["before"].rlike(r"[A-Za-z0-9]\z") & ~hit["after"].rlike("^[A-Za-z0-9]")
        return alone & (remainder_97(F.regexp_replace(found, r"[\x20-]", "")) == 1)
    if kind.name == "ssn":
        alone = ~hit["before"].rlike(r"[0-9-]\z") & ~hit["after"].rlike("^[0-9-]")
        return alone & ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def proposals(text: Column, kind: Kind) -> Column:
    """Proposals of a kind with their context: ``array<struct<start, end, str, before, after>>``."""

    def with_context(gaps: Column) -> Column:
        return F.transform(
            tx.find_spans(text, kind.pattern),
            lambda s, k: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["str"].alias("str"),
                F.substring(gaps[k], -BEFORE, BEFORE).alias("before"),
                F.substring(gaps[k + 1], 1, AFTER).alias("after"),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,str:string,before:string,after:string>>")
    found = tx.let(F.split(text, kind.pattern, -1), with_context)
    guard = kind.guard or kind.pattern
    return F.when(text.contains(guard) if guard == "@" else text.rlike(guard), found).otherwise(none)


def score_of(kind: Kind, hit: Column) -> Column:
    """Score in percent of a confirmed proposal by the words around it."""
    around = tx.let(lowered(F.concat(hit["before"], F.lit(" "), hit["after"])), lambda near: (
        F.when(near.rlike(kind.raised), kind.step).otherwise(0) - F.when(near.rlike(kind.lowered), kind.step).otherwise(0)
    ))
    return (around + kind.score).cast("int")


def span(kind: Kind, hit: Column, start: Column, end: Column, found: Column, basic: bool) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        end.cast("int").alias("end"),
        F.lit(kind.name).alias("kind"),
        found.alias("str"),
        score_of(kind, hit).alias("score"),
        F.lit(basic).alias("basic"),
    )


def alone_card(hit: Column, s: Column) -> Column:
    """Whether a group of digits inside a proposal stands alone there and has a right Luhn sum."""
    beside = F.concat(
        F.when(s["start"] > 0, hit["str"].substr(s["start"], F.lit(1))).otherwise(""),
        F.lit("|"),
        hit["str"].substr(s["end"] + 1, F.lit(1)),
    )
    return ~beside.rlike("[0-9]") & luhn(digits_of(s["str"]))


def inner_cards(kind: Kind, hit: Column) -> Column:
    """Cards among the digit groups of a proposal that failed as a whole."""
    inside = F.filter(tx.find_spans(hit["str"], CARD_GROUP), lambda s: alone_card(hit, s))
    return F.transform(inside, lambda s: span(kind, hit, hit["start"] + s["start"], hit["start"] + s["end"], s["str"], False))


def without_inner_cards(kind: Kind, hit: Column) -> Column:
    """The text of a failed proposal with the cards inside it replaced."""

    def rebuilt(gaps: Column) -> Column:
        pieces = F.transform(
            tx.find_spans(hit["str"], CARD_GROUP),
            lambda s, k: F.concat(gaps[k], F.when(alone_card(hit, s), f"[{kind.name}]").otherwise(s["str"])),
        )
        return F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))

    return tx.let(F.split(hit["str"], CARD_GROUP, -1), rebuilt)


def spans_of_kind(text: Column, kind: Kind, threshold: int) -> Column:
    """Confirmed spans of a kind as an array of ``SPAN``."""

    def judged(hits: Column) -> Column:
        passed = F.transform(F.filter(hits, lambda h: confirmed(kind, h)), lambda h: span(kind, h, h["start"], h["end"], h["str"], kind.basic))
        if not kind.basic:
            passed = F.filter(passed, lambda s: s["score"] >= threshold)
        if kind.name != "card":
            return passed
        again = F.flatten(F.transform(F.filter(hits, lambda h: ~confirmed(kind, h)), lambda h: inner_cards(kind, h)))
        return F.concat(passed, F.filter(again, lambda s: s["score"] >= threshold))

    return tx.let(proposals(text, kind), judged).cast(f"array<{SPAN}>")


def personal_spans(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The key and ``spans``: start, rank, end, kind, str, score and basic of each, by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(key), text)
    rows = rows.select(key, *(spans_of_kind(F.col("text"), k, threshold).alias(f"_{k.name}") for k in KINDS))
    return rows.select(key, F.array_sort(F.concat(*(F.col(f"_{k.name}") for k in KINDS))).alias("spans"))


def masked(docs: DataFrame, *, text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; kind by kind, so a later kind sees the masks before it."""

    def one(kind: Kind) -> Callable[[Column], Column]:
        def rebuilt(gaps: Column, text: Column) -> Column:
            hits = proposals(text, kind)
            pieces = F.transform(hits, lambda h, k: F.concat(gaps[k], replaced(h)))
            return F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))

        def replaced(hit: Column) -> Column:
            good, high = confirmed(kind, hit), score_of(kind, hit) >= threshold
            mask = F.when(good if kind.basic else good & high, f"[{kind.name}]")
            if kind.name == "card":
                mask = mask.when(~good & high, without_inner_cards(kind, hit))
            return mask.otherwise(hit["str"])

        return lambda text: tx.let(F.split(text, kind.pattern, -1), lambda gaps: rebuilt(gaps, text))

    out = docs
    for kind in KINDS:
        text = F.col(f"`{text_col}`")
        guard = text.contains("@") if kind.guard == "@" else text.rlike(kind.guard or kind.pattern)
        out = out.withColumn(text_col, F.when(guard, one(kind)(text)).otherwise(text))
    return out


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["basic"] & (s["kind"] == kind))).cast("long")


def personal_digest(docs: DataFrame) -> DataFrame:
    """Digest per document: counts of the basic kinds, digest of the basic spans, all spans and the highest score."""
    found = personal_spans(docs)
    basic = F.filter("spans", lambda s: s["basic"])
    return found.select(
        "doc_id",
        *(count_of(k.name).alias(f"n_{k.name}") for k in KINDS if k.basic),
        F.sha2(joined(basic), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).cast("long").alias("top_score"),
    )


def _sql() -> str:
    """The same in SQL; expressions of the linear kind, contexts from the gaps between proposals."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # doubled digits of the Luhn sum, from the last digit on
    luhn_sql = (
        "(list_sum(list_transform(range(1, len({d}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({d})[k] AS INT) "
        "ELSE CAST(translate(reverse({d})[k], '0123456789', '0246813579') AS INT) END)) % 10 = 0)"
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    turned = "regexp_replace(m, '[ -]', '', 'g')"
    turned = f"({turned}[5:] || {turned}[1:4])"
    mod97 = (
        f"(list_reduce(list_concat([0], list_transform(range(1, len({turned}) + 1), lambda k: ord({turned}[k]))), "
        "lambda rest, c: CASE WHEN c >= 65 THEN (rest * 100 + c - 55) % 97 ELSE (rest * 10 + c - 48) % 97 END) = 1)"
    )
    checks = {
        "email": "true",
        "ip": f"len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, {quoted(PART)}))) = 0",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn_sql.format(d=digits)}",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]') AND {mod97}",
        "ssn": "NOT regexp_matches(b, '[0-9-]$') AND NOT regexp_matches(a, '^[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    }
    ctes = ["t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"]
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern = quoted(kind.plain)
        ctes.append(
            f"""g{rank} AS (SELECT rid, regexp_extract_all(text, {pattern}) AS ms, regexp_split_to_array(text, {pattern}) AS gaps
            FROM t WHERE regexp_matches(text, {pattern}))"""
        )
        ctes.append(
            f"""u{rank} AS (SELECT rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(gaps[2:]) AS next,
            generate_subscripts(ms, 1) AS k FROM g{rank})"""
        )
        ctes.append(
            f"""p{rank} AS (SELECT rid, m, right(gap, {BEFORE}) AS b, left(next, {AFTER}) AS a,
            CAST(sum(len(gap) + len(m)) OVER (PARTITION BY rid ORDER BY k) - len(m) AS BIGINT) AS s FROM u{rank})"""
        )
        near = f"translate(b || ' ' || a, '{UPPER}', '{LOWER}')"
        ctes.append(
            f"""c{rank} AS (SELECT rid, m, s, s + len(m) AS e, coalesce({checks[kind.name]}, false) AS ok,
            {kind.score} + CASE WHEN regexp_matches({near}, '{kind.raised}') THEN {kind.step} ELSE 0 END
            - CASE WHEN regexp_matches({near}, '{kind.lowered}') THEN {kind.step} ELSE 0 END AS score FROM p{rank})"""
        )
        wanted = "" if kind.basic else f" AND score >= {THRESHOLD}"
        parts.append(f"SELECT rid, s, {rank} AS rank, e, '{kind.name}' AS kind, score, {kind.basic} AS basic FROM c{rank} WHERE ok{wanted}")
    inner = quoted(CARD_GROUP)
    ctes.append(
        f"""again AS (SELECT rid, s AS base, m AS whole, score, unnest(regexp_extract_all(m, {inner})) AS d,
        unnest(regexp_split_to_array(m, {inner})[1:len(regexp_extract_all(m, {inner}))]) AS gap,
        generate_subscripts(regexp_extract_all(m, {inner}), 1) AS k FROM c2 WHERE NOT ok)"""
    )
    ctes.append(
        """inner_cards AS (SELECT rid, base, whole, score, regexp_replace(d, '[^0-9]', '', 'g') AS m, len(d) AS n,
        CAST(sum(len(gap) + len(d)) OVER (PARTITION BY rid, base ORDER BY k) - len(d) AS BIGINT) AS s FROM again)"""
    )
    parts.append(
        f"""SELECT rid, base + s, 2, base + s + n, 'card', score, false FROM inner_cards WHERE score >= {THRESHOLD}
        AND NOT regexp_matches(CASE WHEN s > 0 THEN whole[s] ELSE '' END || '|' || whole[s + n + 1], '[0-9]') AND {luhn_sql.format(d='m')}"""
    )
    ctes.append("found AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(
        """told AS (SELECT rid, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
        count(*) FILTER (WHERE kind = 'card' AND basic) AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
        string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank, e) FILTER (WHERE basic) AS base,
        string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank, e) AS spans, max(score) AS top FROM found GROUP BY rid)"""
    )
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, "
        "coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, "
        "CAST(coalesce(top, 0) AS BIGINT) AS top_score FROM t LEFT JOIN told USING (rid)"
    )


SQL = _sql()
