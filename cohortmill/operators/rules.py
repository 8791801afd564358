"""Context rules that take unwanted mentions out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import text as tx

# fixed values: where a rule looks
BEFORE, HEAD, AFTER, SURFACE, CUT_OFF = -1, 0, 1, 100, -100


@dataclass(frozen=True)
class Rule:
    """Patterns of one rule and where they look.

    ``offset`` below zero is the text before the mention, above zero the text after it; zero is
    the head of the document, 100 the surface text and -100 a cut-off anchor. ``prev_ctx`` and
    ``next_ctx`` add the sentence before or after to the compared text.
    """

    name: str
    offset: int
    patterns: Sequence[str]
    case_sensitive: bool = False
    containing: bool = False
    prev_ctx: bool = False
    next_ctx: bool = False

    def regex(self) -> str:
        """One Java expression for all patterns, matched from the start of the text."""
        parts = []
        for p in self.patterns:
            if self.containing:
                parts.append(f".*{p}.*")
            elif not p.startswith("^") and not p.endswith("$"):
                parts.append(f"^{p}$")
            else:
                parts.append(p)
        flags = "(?d)" if self.case_sensitive else "(?di)"
        return flags + r"\A(?:" + "|".join(f"(?:{p})" for p in parts) + ")"


@dataclass
class RuleSet:
    """Ordered rules, original-string patterns and skip terms."""

    rules: list[Rule] = field(default_factory=list)
    surface_patterns: list[str] = field(default_factory=list)
    skip_terms: list[str] = field(default_factory=list)


def _compared(rule: Rule, contexts: dict[str, Column]) -> Column:
    if rule.offset == HEAD:
        base = contexts["head"]
    elif rule.offset == SURFACE:
        base = contexts["surface"]
    else:
        base = contexts["after"] if rule.offset > 0 else contexts["before"]
    if rule.prev_ctx and "prev" in contexts:
        p = contexts["prev"]
        base = F.when(p.isNotNull(), F.concat(p, F.lit(" "), base)).otherwise(base)
    if rule.next_ctx and "next" in contexts:
        n = contexts["next"]
        base = F.when(n.isNotNull(), F.concat(base, F.lit(" "), n)).otherwise(base)
    return base


def _verdict(name: str | Column, matched: Column) -> Column:
    rule = F.lit(name) if isinstance(name, str) else name
    return F.struct(rule.alias("rule"), matched.alias("matched"))


def regex_verdict(rules: Sequence[Rule], contexts: dict[str, Column]) -> Column:
    """Struct of rule and matched text of the last matching rule; null if none matches.

    Every rule is one literal expression, tried from the last to the first, so nothing is joined
    and the search stops at the verdict.
    """
    tests = []
    for rule in reversed([r for r in rules if r.offset != CUT_OFF]):
        text, regex = _compared(rule, contexts), rule.regex()
        tests.append(F.when(text.rlike(regex), _verdict(rule.name, F.regexp_extract(text, regex, 0))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,matched:string>")


def cut_off_anchors(rules: Sequence[Rule]) -> list[str]:
    """Anchors of the cut-off rules, each once."""
    return list(dict.fromkeys(p for rule in rules if rule.offset == CUT_OFF for p in rule.patterns))


def cut_off_verdict(rules: Sequence[Rule], places: Column, start: Column) -> Column:
    """Verdict of the first cut-off rule with an anchor at or before the mention.

    ``places`` are the first positions of :func:`cut_off_anchors` in the text, found once per document.
    """
    order = {anchor: k for k, anchor in enumerate(cut_off_anchors(rules))}
    tests = []
    for rule in rules:
        if rule.offset == CUT_OFF:
            hit = F.lit(False)
            for anchor in rule.patterns:
                place = F.get(places, F.lit(order[anchor]))
                hit = hit | ((place > 0) & (start >= place))
            tests.append(F.when(hit, _verdict(rule.name, F.lit(f"CUTOFF: {rule.name}"))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,matched:string>")


def skip_verdict(terms: Sequence[str], surface: Column) -> Column:
    """Verdict of the skip-term list, ignoring case."""
    listed = [t.lower() for t in terms]
    if not listed:
        return F.lit(None).cast("struct<rule:string,matched:string>")
    return F.when(F.lower(surface).isin(*listed), _verdict("skip-term", surface))


def surface_verdict(patterns: Sequence[str], surface: Column) -> Column:
    """Verdict of the first original-string pattern."""
    tests = []
    for p in patterns:
        regex = rf"(?d)\A(?:{p})"
        tests.append(F.when(surface.rlike(regex), _verdict("original-string-rule", F.regexp_extract(surface, regex, 0))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,matched:string>")


def label_verdict() -> Column:
    """Verdict of the labels that came with the mention."""
    ok = (
        (F.lower("experiencer") == "patient")
        & (F.lower("temporality") == "recent")
        & (F.lower("negation") == "affirmed")
    )
    return F.when(~ok, _verdict("nlp-label", F.concat_ws("\t", "experiencer", "temporality", "negation")))


def _name_verdict(df: DataFrame, verdict: Column) -> DataFrame:
    rows = df.withColumn("_verdict", verdict)
    return (
        rows.withColumn("ruled_by", F.col("_verdict.rule"))
        .withColumn("matched", F.col("_verdict.matched"))
        .drop("_verdict")
    )


def apply_window_rules(mentions: DataFrame, docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules on fixed character windows around each mention; cut-off rules do not apply here.

    The text is joined once per document and leaves the row again with the windows.
    """
    rows = scale.skew_join(mentions.drop("ruled_by", "matched"), docs.select("doc_id", "text"), "doc_id")
    contexts = {
        "before": tx.before("text", F.col("start_pos")),
        "after": tx.after("text", F.col("end_pos")),
        "head": F.substring("text", 1, tx.HEAD_WINDOW),
        "surface": tx.slice_text("text", F.col("start_pos"), F.col("end_pos")),
    }
    return _name_verdict(rows, regex_verdict(rules, contexts)).drop("text")


def rule_chain(mentions: DataFrame, docs: DataFrame, ruleset: RuleSet, *, repair: bool = True) -> DataFrame:
    """First verdict of: skip terms, original string, window rules, labels of the mention."""
    rows = scale.skew_join(mentions.drop("ruled_by", "matched"), docs.select("doc_id", "text"), "doc_id")
    at = (
        tx.relocate("text", F.col("start_pos"), F.col("end_pos"), "str")
        if repair
        else F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    )
    rows = rows.withColumn("_at", at)
    contexts = {
        "before": tx.before("text", F.col("_at.start")),
        "after": tx.after("text", F.col("_at.end")),
        "head": F.substring("text", 1, tx.HEAD_WINDOW),
        "surface": F.col("str"),
    }
    verdict = F.coalesce(
        skip_verdict(ruleset.skip_terms, F.col("str")),
        surface_verdict(ruleset.surface_patterns, F.col("str")),
        regex_verdict(ruleset.rules, contexts),
        label_verdict(),
    )
    return _name_verdict(rows, verdict).drop("text", "_at")


def with_sentences(docs: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """Documents with their sentence spans in start order as an array.

    Spans come from ``sentences(doc_id, sent_start, sent_end)`` or, without it, from the text. A
    document has no more sentences than characters, so the array is bounded by its own row.
    """
    if sentences is None:
        spans = F.transform(
            tx.sentence_spans("text"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
        )
        return docs.withColumn("sents", spans)
    span = F.struct(F.col("sent_start").alias("start"), F.col("sent_end").alias("end"))
    per_doc = sentences.select("doc_id", span.alias("s")).distinct().groupBy("doc_id").agg(
        F.sort_array(F.collect_list("s")).alias("sents")
    )
    return docs.join(per_doc, "doc_id", "left")


def _overlap(span: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends; a mention that strictly contains the span does not count."""
    return ((start >= span["start"]) & (start <= span["end"])) | ((end >= span["start"]) & (end <= span["end"]))


def ends_in_order(sents: Column) -> Column:
    """Whether no sentence ends before the one in front of it."""
    begin = F.struct(F.lit(-1).alias("last"), F.lit(True).alias("ok"))
    step = lambda acc, s: F.struct(
        s["end"].cast("int").alias("last"), (acc["ok"] & (s["end"] >= acc["last"])).alias("ok")
    )
    return F.aggregate(sents, begin, step, lambda acc: acc["ok"])


def first_ending(sents: Column, at: Column) -> Column:
    """Number of the first sentence that ends at or after a position, by halving."""
    begin = F.struct(F.lit(0).alias("low"), F.size(sents).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        late = F.get(sents, middle)["end"] >= at
        halved = F.struct(
            F.when(late, acc["low"]).otherwise(middle + 1).alias("low"), F.when(late, middle).otherwise(acc["high"]).alias("high")
        )
        return F.when(acc["low"] < acc["high"], halved).otherwise(acc)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sents) + 1)).cast("int"))
    return F.aggregate(steps, begin, halve, lambda acc: acc["low"])


def sentence_index(sents: Column, start: Column, end: Column, in_order: Column) -> Column:
    """Number of the first sentence that overlaps the mention, null if none does.

    Where ends are in order, the first that ends behind the start overlaps, or else the first that ends behind the end
    does, if any; both are found by halving. Nested spans are gone through one by one.
    """
    every = F.transform(sents, lambda s, i: F.when(_overlap(s, start, end), i))
    one_by_one = F.get(F.filter(every, lambda i: i.isNotNull()), F.lit(0))
    near = F.array(first_ending(sents, start), first_ending(sents, end))
    halved = F.get(F.filter(near, lambda i: F.coalesce(_overlap(F.get(sents, i), start, end), F.lit(False))), F.lit(0))
    return F.when(in_order, halved).otherwise(one_by_one)


def sentence_of(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions with the first sentence that overlaps them: ``sent_start``, ``sent_end``."""
    span = F.struct(F.col("sent_start").alias("start"), F.col("sent_end").alias("end"))
    per_doc = sentences.select("doc_id", span.alias("s")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("s")).alias("sents")
    )
    per_doc = scale.cut(per_doc.withColumn("_even", ends_in_order(F.col("sents"))))
    rows = scale.skew_join(mentions, per_doc, "doc_id", "left")
    first = F.get(F.col("sents"), sentence_index(F.col("sents"), F.col("start_pos"), F.col("end_pos"), F.col("_even")))
    return (
        rows.withColumn("_s", first)
        .withColumn("sent_start", F.col("_s.start"))
        .withColumn("sent_end", F.col("_s.end"))
        .drop("_s", "sents", "_even")
    )


def apply_context_rules(
    mentions: DataFrame,
    docs: DataFrame,
    ruleset: RuleSet,
    *,
    closure: DataFrame | None = None,
) -> DataFrame:
    """Sentence rules on mentions: ``mentions(doc_id, cui, str, start_pos, end_pos)``.

    ``docs(doc_id, text, sents)`` comes from :func:`with_sentences`. With ``closure`` only
    mentions of a study concept are looked at. The text is joined once; every context is cut
    inside the joined row and the text is dropped again.

    Verdict order: original string, skip terms, cut-off, last matching rule.
    """
    rows = mentions.drop("ruled_by", "matched")
    if closure is not None:
        wanted = closure.select("cui").distinct()
        rows = rows.join(scale.bounded_broadcast(wanted), "cui", "left_semi")
    low = F.lower("text")
    cuts = [F.instr(low, a.lower()) - 1 for a in cut_off_anchors(ruleset.rules)]
    # what depends on the document only is worked out once for all its mentions
    per_doc = docs.select(
        "doc_id", "text", "sents", ends_in_order(F.col("sents")).alias("_even"), F.array(*cuts).cast("array<int>").alias("_cuts")
    )
    rows = scale.skew_join(rows, per_doc, "doc_id")
    text, start, end, surface = F.col("text"), F.col("start_pos"), F.col("end_pos"), F.col("str")
    rows = rows.withColumn("_i", sentence_index(F.col("sents"), start, end, F.col("_even")))
    rows = rows.withColumn("_sent", F.get(F.col("sents"), F.col("_i")))
    sent, i = F.col("_sent"), F.col("_i")

    # a span that does not show the surface text moves the whole context along
    shown = F.lower(tx.slice_text(text, start, F.least(end, sent["end"]))) == F.lower(surface)
    moved = tx.relocate(text, start, end, surface)["start"] - start
    rows = rows.withColumn("_shift", F.when(sent.isNotNull() & ~shown, moved).otherwise(F.lit(0)))
    shift = F.col("_shift")

    def sentence(number: Column) -> Column:
        s = F.get(F.col("sents"), number)
        return F.when(number >= 0, tx.slice_text(text, s["start"] + shift, s["end"] + shift))

    rows = (
        rows.withColumn("_here", sentence(i))
        .withColumn("_p", sentence(i - 1))
        .withColumn("_n", sentence(i + 1))
    )
    here, before_s, next_s = F.col("_here"), F.col("_p"), F.col("_n")
    question = before_s.isNotNull() & (F.endswith(before_s, F.lit("?")) | F.endswith(F.lower(before_s), F.lit("e.g.")))
    split_s = F.startswith(here, F.lit("s ")) & before_s.isNotNull()
    asks = F.endswith(here, F.lit("?")) & next_s.isNotNull()

    lead = F.when(start > sent["start"], F.substring(here, F.lit(1), start - sent["start"])).otherwise("")
    tail = F.substring(here, end - sent["start"] + 1, F.length(here))
    lead = F.when(question, F.concat(before_s, lead)).otherwise(lead)
    lead = F.when(split_s, F.concat(before_s, lead)).otherwise(lead)
    tail = F.when(asks, F.concat(tail, next_s)).otherwise(tail)
    # the extra context hangs on the sentence that the context was last extended to
    anchor = F.when(asks, i + 1).when(question | split_s, i - 1).otherwise(i)
    rows = rows.withColumn("_before", lead).withColumn("_after", tail).withColumn("_anchor", anchor)
    now = tx.slice_text("_here", start - sent["start"], end - sent["start"])
    rows = rows.withColumn("_surface", F.when(F.lower(now) == F.lower(surface), now).otherwise(surface))
    rows = rows.withColumn("_prev", sentence(F.col("_anchor") - 1)).withColumn(
        "_next", sentence(F.col("_anchor") + 1)
    )
    contexts = {
        "before": F.col("_before"),
        "after": F.col("_after"),
        "head": F.substring(text, 1, tx.HEAD_WINDOW),
        "surface": F.col("_surface"),
        "prev": F.col("_prev"),
        "next": F.col("_next"),
    }
    verdict = F.coalesce(
        surface_verdict(ruleset.surface_patterns, F.col("_surface")),
        skip_verdict(ruleset.skip_terms, F.col("_surface")),
        cut_off_verdict(ruleset.rules, F.col("_cuts"), start + shift),
        regex_verdict(ruleset.rules, contexts),
    )
    # without a sentence there is no context to judge by
    rows = _name_verdict(rows, F.when(sent.isNotNull(), verdict))
    return rows.withColumn("has_sentence", sent.isNotNull()).drop(
        "text", "sents", "_even", "_cuts", "_i", "_sent", "_shift", "_here", "_p", "_n", "_before", "_after",
        "_anchor", "_surface", "_prev", "_next",
    )


def literal(text: str) -> str:
    """A pattern that matches the given text only."""
    return re.escape(text)
