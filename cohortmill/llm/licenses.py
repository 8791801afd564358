"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a sentence or line. It meets a template if it holds at least ``CONTAINMENT`` of the template's distinct
words. The words of the templates are put into one global order, from the rarest in all documents to the most
frequent. A block and a template that meet share one of the first ``|T| - o + 1`` words of the template and one of the
first ``|B| - o + 1`` words of the block (o: the overlap needed); so a document without any such prefix word is left after one look,
a block is tried only with templates whose prefix it touches, is long enough and, by the places of the first common
word, can still reach o; what is left is counted exactly. The join is exact: filters only spare work.

The templates are a parameter of bounded size (``MAX_TEMPLATES`` entries of ``MAX_WORDS`` words) and stand in the plan as literals, so nothing is
shuffled but the word counts of the templates' vocabulary. Only DataFrame functions run on the rows.

Defined results: a null or wordless text has 0 words, no places, null first and last word, empty labels and
score 0. Repeated rows are judged on their own. Extra columns are not read. An empty table gives no rows; its word
order is alphabetical.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences by which licenses are named or granted, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license": "gpl",
    "this library is free software under the terms of the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under the creative commons attribution license": "cc-by",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "licensed under the bsd license": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "copyright all rights reserved": "reserved",
}
CONTAINMENT = 0.8
MAX_TEMPLATES, MAX_WORDS = 1000, 400

#: What parts words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts blocks: line breaks, and marks before a blank.
BLOCK_GAP = r"[\n\r]+|[.!?;|]+[ \t\n\r]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. The Kelvin sign and the dotted I, whose lower case has an ASCII letter, are masked."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9"))
    return F.lower(F.replace(plain, F.lit("\u0130"), F.lit("\u00e9")))


def spaced(text: Column) -> Column:
    """The words of a lowered text, parted by single blanks."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def word_list(text: Column) -> Column:
    """Array of the words of a lowered text."""
    words = spaced(text)
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


class Templates:
    """Templates as ranks in a global word order, with their prefixes."""

    def __init__(self, templates: Mapping[str, str], order: Sequence[str], containment: float):
        rank = {w: k for k, w in enumerate(order)}
        self.rank = rank
        self.rows = []
        for text, label in templates.items():
            ranks = sorted({rank[w] for w in text.split(" ")})
            need = math.ceil(round(containment * len(ranks), 9))
            self.rows.append((label, ranks, need, ranks[: len(ranks) - need + 1]))
        self.prefix_words = sorted({order[r] for _, _, _, prefix in self.rows for r in prefix})


def checked(templates: Mapping[str, str]) -> Mapping[str, str]:
    """The templates, if they keep the bounds that allow them to stand in the plan."""
    if len(templates) > MAX_TEMPLATES or any(len(t.split(" ")) > MAX_WORDS for t in templates):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of {MAX_WORDS} words")
    return templates


def word_order(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> list[str]:
    """The vocabulary from the rarest word in all documents to the most frequent, ties by name."""
    own = F.array_intersect(word_list(lowered(F.col(text_col))), F.array(*(F.lit(w) for w in vocabulary)))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
    seen = {r.word: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def block_scores(blocks: Column, templates: Templates) -> Column:
    """Array of (label, containment) of the blocks and templates that meet."""
    ranks = F.create_map(*(F.lit(x) for w, r in templates.rank.items() for x in (w, r)))
    known = F.array(*(F.lit(w) for w in templates.rank))

    def met(block: Column) -> Column:
        own = F.array_sort(F.transform(F.array_intersect(word_list(block), known), lambda w: ranks[w]))
        return F.transform(F.array(own), met_ranks)[0]

    def met_ranks(own: Column) -> Column:
        found = []
        for label, theirs, need, prefix in templates.rows:
            all_ranks = F.array(*(F.lit(r) for r in theirs))
            own_prefix = F.slice(own, F.lit(1), F.greatest(F.size(own) - need + 1, F.lit(0)))
            common = F.array_intersect(own_prefix, F.array(*(F.lit(r) for r in prefix)))
            first = F.element_at(common, 1)
            reach = F.least(
                F.size(own) - F.array_position(own, first), F.lit(len(theirs)) - F.array_position(all_ranks, first)
            )
            share = F.size(F.array_intersect(own, all_ranks)) / F.lit(len(theirs))
            candidate = (F.size(own) >= need) & (F.size(common) > 0) & (1 + reach >= need)
            share = F.when(candidate, share).otherwise(0.0)
            found.append(F.struct(F.lit(label).alias("label"), share.alias("share"), F.lit(need / len(theirs)).alias("least")))
        return F.filter(F.array(*found), lambda x: x.share >= x.least - 1e-9)

    return F.flatten(F.transform(blocks, met))


def license_columns(
    docs: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = (),
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the blocks' ``matches``."""
    vocabulary = sorted({w for t in checked(templates) for w in t.split(" ")})
    index = Templates(templates, word_order(docs, vocabulary, text_col), containment)
    # each word stands between two blanks of its own, so that places of phrases may touch
    low = docs.select(*keep, lowered(F.col(text_col)).alias("_low"))
    base = low.withColumn("_words", spaced(F.col("_low")))
    base = base.withColumn("_wide", F.concat(F.lit(" "), F.replace("_words", F.lit(" "), F.lit("  ")), F.lit(" ")))
    wide = F.col("_wide")
    blanks = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    n_words = F.when(F.col("_words") == "", 0).otherwise(blanks(F.col("_words")) + 1)
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        words = phrase.split(" ")
        mark = f" {'  '.join(words)} "
        there = wide.contains(mark)
        head = F.substring(wide, F.lit(1), F.locate(mark, wide) - 1)
        tail = F.substring(F.reverse(wide), F.lit(1), F.locate(mark[::-1], F.reverse(wide)) - 1)
        places.append(F.when(there, F.regexp_count(wide, F.lit(f"(?={mark})"))).otherwise(0))
        firsts.append(F.when(there, blanks(head) / 2))
        lasts.append(F.when(there, F.col("n_words") - blanks(tail) / 2 - len(words)))
        labels.append(F.when(there, F.lit(label)))
    prefix = F.lit(rf"(?<![0-9a-z])({'|'.join(index.prefix_words)})(?![0-9a-z])")
    with_prefix = F.filter(F.split("_low", BLOCK_GAP), lambda b: F.rlike(b, prefix))
    no_match = F.array().cast("array<struct<label:string,share:double,least:double>>")
    pick = lambda func, xs: func(*xs) if len(xs) > 1 else xs[0]
    out = (
        base.withColumn("n_words", n_words.cast("long"))
        .withColumn("n_base", sum(places[1:], places[0]).cast("long"))
        .withColumn("first_word", pick(F.least, firsts).cast("long"))
        .withColumn("last_word", pick(F.greatest, lasts).cast("long"))
        .withColumn("_base", F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))))
        .withColumn(
            "matches", F.when(F.rlike("_low", prefix), block_scores(with_prefix, index)).otherwise(no_match)
        )
    )
    every = F.array_sort(F.array_union("_base", F.transform("matches", lambda m: m.label)))
    best = F.array_max(F.transform("matches", lambda m: m.share))
    return out.select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        "matches",
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return license_columns(docs.select("doc_id", "text"), keep=["doc_id"]).drop("matches")


def _sql() -> str:
    templates = ", ".join(
        f"('{label}', [{', '.join(repr(w) for w in sorted(set(text.split(' '))))}])" for text, label in TEMPLATES.items()
    )
    phrases = ", ".join(f"('{label}', {p.split(' ')!r})" for p, label in PHRASES.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, {word}) AS w FROM d),
tpl(label, words) AS (VALUES {templates}),
phr(label, words) AS (VALUES {phrases}),
places AS (SELECT r, label, p - 1 AS p FROM (SELECT r, w, label, words, unnest(list_positions) AS p FROM
    (SELECT r, w, label, words, list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(words) - 1] = words) AS list_positions
     FROM w, phr WHERE contains(low, words[1])))),
base AS (SELECT r, count(*) AS n, min(p) AS f, max(p) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM places GROUP BY r),
blocks AS (SELECT r, regexp_extract_all(b, {word}) AS w FROM
    (SELECT r, unnest(regexp_split_to_array(low, '[\n\r]+|[.!?;|]+[ \t\n\r]+')) AS b FROM d)),
met AS (SELECT r, label, len(list_intersect(list_distinct(w), words)) / len(words) AS share FROM blocks, tpl
    WHERE len(list_intersect(list_distinct(w), words)) >= ceil(round({CONTAINMENT} * len(words), 9))),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
    (SELECT r, label FROM met UNION ALL SELECT r, label FROM places) GROUP BY r),
top AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word,
    CAST(l AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
    CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN top USING (r)
"""


SQL = _sql()
