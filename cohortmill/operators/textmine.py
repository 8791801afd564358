"""Sentences, tokens, dictionary tagging and text search over whole documents."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import text as tx
from cohortmill.operators import search


def sentences(docs: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sentence with its number, offsets and text."""
    # an inner explode would make Spark test the array for emptiness first and build it twice
    spans = docs.select("doc_id", *keep, F.posexplode_outer(tx.sentence_spans("text")).alias("sent_no", "span"))
    return spans.where("span IS NOT NULL").select(
        "doc_id",
        *keep,
        "sent_no",
        F.col("span.start").alias("sent_start"),
        F.col("span.end").alias("sent_end"),
        F.col("span.str").alias("sent_text"),
    )


def adjacent_sentences(docs: DataFrame) -> DataFrame:
    """Sentences with the text before and after; taken from the row, so nothing is shuffled."""
    rows = docs.select("doc_id", tx.sentence_spans("text").alias("spans"))
    one = rows.select("doc_id", "spans", F.posexplode_outer("spans").alias("sent_no", "span")).where("span IS NOT NULL")

    def at(shift: int) -> Column:
        return F.get("spans", F.col("sent_no") + shift)["str"]

    return one.select(
        "doc_id",
        "sent_no",
        F.col("span.start").alias("sent_start"),
        F.col("span.end").alias("sent_end"),
        F.col("span.str").alias("sent_text"),
        at(-1).alias("prev_text"),
        at(1).alias("next_text"),
    )


# words per stretch; a sentence without any full stop can hold a whole document
STRETCH_WORDS = 32


# first words of terms that enter a plan as a literal
LITERAL_WORDS = 1_000
# first words that are looked for in a sentence before its words are taken apart
SOUGHT_WORDS = 32
# characters of a text that is a stretch as a whole
SHORT_TEXT = 512


def _stretches(text: Column, size: int = STRETCH_WORDS) -> Column:
    """Runs of words with their offsets: a short text as a whole, others in runs of ``size`` words, the last with the rest."""
    runs = tx.find_spans(text, rf"{tx.WORD}+(?:{tx.NO_WORD}+{tx.WORD}+){{0,{size - 1}}}+")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("str")))
    return F.when(F.length(text) <= SHORT_TEXT, whole).otherwise(runs)


def sentence_tokens(sents: DataFrame) -> DataFrame:
    """One row per word of the sentences with its offsets in the document."""
    runs = sents.select("doc_id", "sent_no", "sent_start", F.posexplode_outer(_stretches(F.col("sent_text"))).alias("r", "run"))
    runs = runs.where("run IS NOT NULL")
    one = runs.select("doc_id", "sent_no", "sent_start", "r", "run", F.posexplode_outer(tx.word_spans(F.col("run.str"))).alias("i", "w"))
    one = one.where("w IS NOT NULL")
    base = F.col("sent_start") + F.col("run.start")
    return one.select(
        "doc_id",
        "sent_no",
        (F.col("r") * STRETCH_WORDS + F.col("i")).alias("tok_no"),
        (base + F.col("w.start")).alias("start_pos"),
        (base + F.col("w.end")).alias("end_pos"),
        F.col("w.str").alias("token"),
    )


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word of the documents."""
    return sentence_tokens(sentences(docs))


def place_in_sentences(mentions: DataFrame, docs: DataFrame, *, bucket: int = 256) -> DataFrame:
    """Mentions with the number of the sentence that holds them whole; others are dropped.

    Both sides meet by document and a short stretch of text, so a mention sees the few sentences
    around it and a document with very many mentions spreads over many keys.
    """
    spans = sentences(docs).select("doc_id", "sent_no", "sent_start", "sent_end")
    low, high = F.floor(F.col("sent_start") / bucket), F.floor(F.col("sent_end") / bucket)
    spread = spans.withColumn("_b", F.explode(F.sequence(low, high)))
    there = mentions.drop("sent_no").withColumn("_b", F.floor(F.col("start_pos") / bucket))
    joined = there.join(spread, ["doc_id", "_b"])
    inside = (F.col("start_pos") >= F.col("sent_start")) & (F.col("end_pos") <= F.col("sent_end"))
    return joined.where(inside).drop("_b", "sent_start", "sent_end")


def _word_start(gaps: Column, wordlist: Column, at: Column) -> Column:
    """Offset of one word from the lengths of the gaps and words before it."""
    add = lambda acc, part: acc + F.length(part)
    before = F.aggregate(F.slice(gaps, F.lit(1), at + 1), F.lit(0), add)
    return F.aggregate(F.slice(wordlist, F.lit(1), at), before, add)


def term_runs(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Runs of words that may be a term: where its first word starts some, and only as many words as a term with that first word has.

    So a word that starts no term gives no row, and a long term gives rows for its own first word only.
    """
    longest = gazetteer.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    # as long as the longest term, so that a term reaches into one more stretch at most
    size = max(STRETCH_WORDS, longest)
    split = gazetteer.select(F.split("term", " ").alias("ws"))
    first_words = split.groupBy(F.col("ws")[0].alias("word")).agg(F.collect_set(F.size("ws")).alias("sizes"))
    few = [r.word for r in first_words.select("word").limit(LITERAL_WORDS + 1).collect()]
    known = [w for w in few if w is not None]
    sents = sentences(docs)
    # other letters may change their case by what stands around them
    if len(few) <= SOUGHT_WORDS and all(w.isascii() for w in known):
        lowered = F.lower("sent_text")
        sents = sents.where(functools.reduce(operator.or_, (lowered.contains(w) for w in known), F.lit(False)))
    parts = sents.withColumn("runs", _stretches(F.col("sent_text"), size))
    parts = parts.select("doc_id", "sent_no", "sent_start", "sent_text", "runs", F.posexplode_outer("runs").alias("r", "run"))
    parts = parts.where("run IS NOT NULL")
    # a run of words may reach into the next stretch, so its first words are added
    following = F.get("runs", F.col("r") + 1)
    lead = F.regexp_extract(following["str"], rf"^{tx.WORD}(?:{tx.NO_WORD}{tx.WORD}){{0,{max(longest - 2, 0)}}}", 0)
    reach = F.coalesce(following["start"] + F.length(lead), F.col("run.end")) if longest > 1 else F.col("run.end")
    rows = parts.select(
        "doc_id",
        "sent_no",
        (F.col("sent_start") + F.col("run.start")).alias("part_start"),
        tx.slice_text("sent_text", F.col("run.start"), reach).alias("part"),
        following.isNull().alias("last"),
    ).withColumn("words", F.regexp_extract_all("part", F.lit(tx.WORD), F.lit(0)))
    places = F.transform("words", lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("word")))
    if len(few) <= LITERAL_WORDS:
        # other words give no row before the join either
        places = F.filter(places, lambda p: p["word"].isin(known))
    one = rows.select("doc_id", "sent_no", "part_start", "part", "last", "words", F.explode_outer(places).alias("p"))
    # words behind the stretch start their terms in the next one
    one = one.where("p IS NOT NULL").where((F.col("p.at") < size) | F.col("last")).select(
        "doc_id", "sent_no", "part_start", "part", "words", "p.at", "p.word"
    )
    begin = one.join(scale.bounded_broadcast(first_words), "word")
    fitting = F.filter("sizes", lambda n: n <= F.size("words") - F.col("at"))
    runs = begin.withColumn("n", F.explode(fitting)).drop("sizes")
    return runs.withColumn("term", F.lower(F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")))


def dictionary_annotate(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Tag dictionary terms in the text; a match inside a longer one is dropped.

    ``gazetteer(term, cui, sty, pref)`` with lower-case terms, words separated by one space.
    Runs of words (:func:`term_runs`) are looked up by equality, so
    the work grows with the text and not with text times terms. Offsets are worked out for the
    matches only.
    """
    hits = term_runs(docs, gazetteer).join(scale.bounded_broadcast(gazetteer), "term")
    gaps = F.split("part", tx.WORD, -1)
    last = F.col("at") + F.col("n") - 1
    hits = hits.withColumn("s", _word_start(gaps, F.col("words"), F.col("at"))).withColumn(
        "e", _word_start(gaps, F.col("words"), last) + F.length(F.get("words", last))
    )
    hits = hits.select(
        "doc_id",
        "sent_no",
        "cui",
        "sty",
        "pref",
        tx.slice_text("part", F.col("s"), F.col("e")).alias("str"),
        (F.col("part_start") + F.col("s")).alias("start_pos"),
        (F.col("part_start") + F.col("e")).alias("end_pos"),
    )
    # a match lies inside another one if one with its start, or an earlier one, ends as late
    same = F.max("end_pos").over(Window.partitionBy("doc_id", "sent_no", "start_pos"))
    earlier = F.max("end_pos").over(
        Window.partitionBy("doc_id", "sent_no").orderBy("start_pos").rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        hits.withColumn("_same", same)
        .withColumn("_earlier", earlier)
        .where((F.col("end_pos") == F.col("_same")) & (F.coalesce("_earlier", F.lit(-1)) < F.col("end_pos")))
        .drop("_same", "_earlier")
    )


def _positions(wordlist: Column, words: Sequence[str]) -> dict[str, Column]:
    """Sorted positions of some words among the words of a text."""

    def places(word: str) -> Column:
        at = F.transform(wordlist, lambda w, i: F.when(w == word, i))
        return F.filter(at, lambda i: i.isNotNull())

    return {w: places(w) for w in words}


def _found(wordlist: Column, words: Sequence[str], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the positions of some words, each worked out once."""
    named = {w: f"p{i}" for i, w in enumerate(words)}
    both = F.struct(*(p.alias(named[w]) for w, p in _positions(wordlist, words).items()))
    return tx.let(both, lambda s: body({w: s[n] for w, n in named.items()}))


def text_search(
    docs: DataFrame,
    *,
    any_of: Sequence[str] = (),
    all_of: Sequence[str] = (),
    phrases: Sequence[tuple[str, int]] = (),
) -> DataFrame:
    """Documents with any of the words, all of the words, and any of the (phrase, slop) pairs.

    ``hits`` counts the occurrences of the asked words. All texts are read; for many searches write a :class:`search.TextIndex`.
    """
    asked = search.asked_words(any_of, all_of, phrases)
    if not asked:
        return docs.withColumn("hits", F.lit(0))
    rows = docs.withColumn("_words", tx.words("text"))
    match = _found(F.col("_words"), asked, lambda at: search.matches(at, any_of, all_of, phrases))
    hits = F.size(F.filter("_words", lambda w: w.isin(*asked)))
    return rows.where(match).withColumn("hits", hits).drop("_words")


def phrase_counts(docs: DataFrame, phrases: Sequence[tuple[str, str, int]], *, key: str) -> DataFrame:
    """``key, id, n`` documents that hold each of the phrases ``(id, phrase, slop)``; the texts are read once."""
    asked = search.asked_words((), (), [(phrase, slop) for _, phrase, slop in phrases])

    def ids(at: dict[str, Column]) -> Column:
        found = [F.when(search.matches(at, (), (), [(phrase, slop)]), F.lit(name)) for name, phrase, slop in phrases]
        return F.array_compact(F.array(*found))

    rows = docs.select(key, F.explode(tx.let(tx.words("text"), lambda words: _found(words, asked, ids))).alias("id"))
    return rows.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))


def numeric_search(
    docs: DataFrame,
    *,
    anchor: str,
    low: float,
    high: float,
    number: str,
) -> DataFrame:
    """Number right behind each anchor word: counts in range, out of range and unknown.

    ``number`` is the expression of what follows the anchor, with the number as its group.

    A document matches if any anchor is followed by a number; ``verdict`` is 1 if one is in
    range, else -1.
    """
    word = rf"(?i)(?<![A-Za-z0-9_]){anchor}(?![A-Za-z0-9_])"
    found = F.regexp_extract_all("text", F.lit(word + f"(?:{number})?"), F.lit(1))
    values = F.transform(found, lambda v: F.when(v != "", v.try_cast("double")))
    inside = F.size(F.filter(values, lambda v: v.between(low, high)))
    outside = F.size(F.filter(values, lambda v: v.isNotNull() & ~v.between(low, high)))
    unknown = F.size(F.filter(values, lambda v: v.isNull()))
    return (
        docs.withColumn("n_in", inside)
        .withColumn("n_out", outside)
        .withColumn("n_unknown", unknown)
        .where("n_in + n_out > 0")
        .withColumn("verdict", F.when(F.col("n_in") > 0, 1).otherwise(-1))
    )


def relocate_offsets(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions with offsets moved to the nearest occurrence of their surface text.

    Spans that show their text stay. For the others each distinct text of a document is looked
    for once, however many mentions show it.
    """
    texts = docs.select("doc_id", "text")
    shown = tx.slice_text("text", F.col("start_pos"), F.col("end_pos")) == F.col("str")
    checked = scale.skew_join(mentions, texts, "doc_id").withColumn("_ok", shown).drop("text")
    rows = checked.withColumn("_key", F.when(~F.col("_ok"), F.lower("str")))
    wanted = rows.where("_key IS NOT NULL").groupBy("doc_id", "_key").agg(F.min("str").alias("_str"))
    places = wanted.join(texts, "doc_id").select("doc_id", "_key", tx.occurrences("text", "_str").alias("_at"))
    near = tx.nearest(F.col("_at"), F.col("start_pos"))
    moved = rows.join(places, ["doc_id", "_key"], "left").withColumn("_near", near)
    start = F.coalesce("_near", "start_pos")
    end = F.when(F.col("_near").isNotNull(), F.col("_near") + F.length("str")).otherwise(F.col("end_pos"))
    return moved.withColumns({"start_pos": start, "end_pos": end}).select(*mentions.columns)


def vocabulary(docs: DataFrame, *, top: int) -> DataFrame:
    """The most common words with their index: ``token, n, idx`` (ties by the word)."""
    counts = docs.select(F.explode_outer(tx.words("text")).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.desc("n"), "token").limit(top)
    return ranked.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1)


def encode_windows(mentions: DataFrame, docs: DataFrame, vocab: DataFrame, *, side: int, size: int) -> DataFrame:
    """Vocabulary indexes (plus one) of the words around each mention, cut or filled to ``size``.

    ``side`` words before and after; words outside the vocabulary are left out, zero fills.
    Mentions need an ``id``.
    """
    text = scale.skew_join(mentions.select("id", "doc_id", "start_pos", "end_pos"), docs.select("doc_id", "text"), "doc_id")
    around = text.select(
        "id",
        F.concat(
            tx.last_items(tx.words, "text", F.col("start_pos"), side),
            tx.first_items(tx.words, "text", F.col("end_pos"), side),
        ).alias("words"),
    )
    exploded = around.select("id", F.posexplode_outer("words").alias("pos", "token"))
    coded = exploded.join(scale.bounded_broadcast(vocab.select("token", "idx")), "token", "left")
    # at most 2 * side words per mention
    items = F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("pos", (F.col("idx") + 1).alias("code"))))
    codes = F.transform(F.array_sort("items"), lambda x: x["code"].cast("int"))
    return coded.groupBy("id").agg(items.alias("items")).select("id", tx.padded_window(codes, size).alias("codes"))
