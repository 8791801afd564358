"""Rule semantics with verdicts worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import text as tx
from cohortmill.operators import rules, textmine
from cohortmill.operators.rules import Rule, RuleSet

MENTION = "doc_id long, cui string, str string, start_pos int, end_pos int, negation string, temporality string, experiencer string"


def mention(text, word, doc=1, nth=0, shift=0, labels=("Affirmed", "Recent", "Patient")):
    at = -1
    for _ in range(nth + 1):
        at = text.index(word, at + 1)
    return (doc, "C1", word, at + shift, at + shift + len(word), *labels)


@pytest.fixture
def judge(frame):
    def run(text, mentions, ruleset, sentences=None):
        docs = frame([(1, text)], "doc_id long, text string")
        table = None if sentences is None else frame([(1, s, e) for s, e in sentences], "doc_id long, sent_start int, sent_end int")
        out = rules.apply_context_rules(frame(mentions, MENTION), rules.with_sentences(docs, table), ruleset)
        return [(r["ruled_by"], r["matched"]) for r in out.orderBy("start_pos").collect()]

    return run


def test_last_matching_rule_names_the_verdict(judge):
    text = "no sign of asthma today."
    both = RuleSet([Rule("first", -1, [".*no sign.*"]), Rule("second", -1, [".*sign of.*"])])
    assert judge(text, [mention(text, "asthma")], both)[0][0] == "second"


def test_skip_term_beats_rules_and_original_string_beats_skip_term(judge):
    text = "no sign of Asthma today."
    rule = Rule("neg", -1, [".*no.*"])
    assert judge(text, [mention(text, "Asthma")], RuleSet([rule], skip_terms=["ASTHMA"]))[0][0] == "skip-term"
    full = RuleSet([rule], surface_patterns=["A[a-z]+"], skip_terms=["asthma"])
    assert judge(text, [mention(text, "Asthma")], full)[0][0] == "original-string-rule"


def test_skip_term_works_without_any_rule(judge):
    text = "has asthma."
    assert judge(text, [mention(text, "asthma")], RuleSet(skip_terms=["asthma"]))[0][0] == "skip-term"


def test_cut_off_beats_later_rules(judge):
    text = "Seen. Family History asthma is not here."
    ruleset = RuleSet([Rule("cut", -100, ["family history"]), Rule("neg", 1, [".*not.*"])])
    assert judge(text, [mention(text, "asthma")], ruleset)[0] == ("cut", "CUTOFF: cut")
    early = "family history asthma is not here."
    # the anchor at the very start of the text does not cut
    assert judge(early, [mention(early, "asthma")], ruleset)[0][0] == "neg"


@pytest.mark.parametrize(
    ("patterns", "containing", "text", "hit"),
    [
        (["no"], False, "no", True),
        (["no"], False, "no way", False),
        (["^no"], False, "no way", True),
        (["way$"], False, "no way", False),
        ([".*way$"], False, "no way", True),
        (["wa"], True, "no way", True),
        (["b.c"], True, "a b\rc", True),
        (["b.c"], True, "a b\nc", False),
        (["c"], True, "a\nc", False),
        (["NO"], False, "no", True),
    ],
)
def test_patterns_are_anchored_like_a_match_from_the_start(frame, patterns, containing, text, hit):
    regex = Rule("r", 1, patterns, containing=containing).regex()
    assert frame([(text,)], "t string").select(F.col("t").rlike(regex)).first()[0] is hit


def test_case_sensitive_rule(frame):
    regex = Rule("r", 1, ["NO"], case_sensitive=True).regex()
    assert frame([("no",)], "t string").select(F.col("t").rlike(regex)).first()[0] is False


def spans_of(text, *parts):
    out = []
    for part in parts:
        at = text.index(part)
        out.append((at, at + len(part)))
    return out


def test_question_mark_brings_the_previous_sentence_in(judge):
    text = "possibly ? asthma now. next one."
    sents = spans_of(text, "possibly ?", "asthma now.", "next one.")
    ruleset = RuleSet([Rule("hyp", -1, [".*possibly.*"])])
    assert judge(text, [mention(text, "asthma")], ruleset, sents)[0] == ("hyp", "possibly ?")
    text = "possibly yes asthma now."
    sents = spans_of(text, "possibly yes", "asthma now.")
    assert judge(text, [mention(text, "asthma")], ruleset, sents)[0][0] is None


def test_possessive_start_and_question_at_the_end(judge):
    text = "denied it for the mother s asthma is it? maybe later"
    sents = spans_of(text, "denied it for the mother", "s asthma is it?", "maybe later")
    ruleset = RuleSet([Rule("neg", -1, [".*denied.*"]), Rule("later", 1, [".*maybe.*"])])
    assert judge(text, [mention(text, "asthma")], ruleset, sents)[0][0] == "later"
    assert judge(text, [mention(text, "asthma")], RuleSet(ruleset.rules[:1]), sents)[0][0] == "neg"


def test_extra_context_sentences(judge):
    text = "Denied. He said. Has asthma here. Tomorrow."
    sents = spans_of(text, "Denied.", "He said.", "Has asthma here.", "Tomorrow.")
    rows = [mention(text, "asthma")]
    assert judge(text, rows, RuleSet([Rule("p", -1, ["^He said. Has "], prev_ctx=True)]), sents)[0][0] == "p"
    assert judge(text, rows, RuleSet([Rule("n", 1, ["^ here. Tomorrow."], next_ctx=True)]), sents)[0][0] == "n"
    assert judge(text, rows, RuleSet([Rule("p", -1, ["^He said. Has "])]), sents)[0][0] is None


def test_shifted_offsets_move_the_context(judge):
    text = "No asthma was found. Other things."
    ruleset = RuleSet([Rule("neg", -1, ["^No "]), Rule("after", 1, ["^ was found"])])
    sents = [(4, 24), (25, 38)]
    # all offsets came out four characters too far
    assert judge(text, [mention(text, "asthma", shift=4)], ruleset, sents)[0][0] == "after"


def test_relocation_picks_the_nearest_whole_word(frame):
    text = "flu and influenza, Flu; flu-like"
    rows = [(text, s, s + 3, "flu") for s in (0, 5, 18, 20, 30)]
    df = frame(rows, "text string, s int, e int, str string")
    got = [r[0] for r in df.select(tx.relocate("text", F.col("s"), F.col("e"), "str")["start"]).collect()]
    assert got == [0, 0, 19, 19, 24]
    none = frame([("nothing here", 2, 5, "flu")], "text string, s int, e int, str string")
    assert none.select(tx.relocate("text", F.col("s"), F.col("e"), "str")).first()[0].asDict() == {"start": 2, "end": 5}


def test_relocate_operator_agrees_with_the_function(frame):
    text = "Flu. some flu (FLU) é😀 flu."
    docs = frame([(1, text)], "doc_id long, text string")
    rows = frame([(1, i, i + 3, "flu") for i in range(0, 24, 3)], "doc_id long, start_pos int, end_pos int, str string")
    by_function = rows.join(docs, "doc_id").select("start_pos", tx.relocate("text", F.col("start_pos"), F.col("end_pos"), "str")["start"].alias("to"))
    by_operator = textmine.relocate_offsets(rows.withColumn("orig", F.col("start_pos")), docs).select("orig", "start_pos")
    assert sorted(map(tuple, by_function.collect())) == sorted(map(tuple, by_operator.collect()))


def test_overlap_is_inclusive_and_misses_a_longer_mention(frame):
    mentions = frame(
        [(1, "a", 10, 12), (1, "b", 5, 30), (1, "c", 3, 5), (1, "d", 40, 50)],
        "doc_id long, cui string, start_pos int, end_pos int",
    )
    sents = frame([(1, 0, 4), (1, 5, 10), (1, 11, 20)], "doc_id long, sent_start int, sent_end int")
    got = {r["cui"]: r["sent_start"] for r in rules.sentence_of(mentions, sents).collect()}
    # 10 touches the end of the second sentence, which comes first; 40..50 overlaps none
    assert got == {"a": 5, "b": 5, "c": 0, "d": None}
    longer = frame([(1, "e", 4, 30)], "doc_id long, cui string, start_pos int, end_pos int")
    only = frame([(1, 5, 10)], "doc_id long, sent_start int, sent_end int")
    assert rules.sentence_of(longer, only).first()["sent_start"] is None


def test_chain_order_and_labels(frame):
    text = "no asthma, flu and cold"
    docs = frame([(1, text)], "doc_id long, text string")
    rows = [
        mention(text, "asthma"),
        mention(text, "flu"),
        mention(text, "cold", labels=("Negated", "Recent", "Patient")),
    ]
    ruleset = RuleSet([Rule("neg", -1, ["no"], containing=True), Rule("cut", -100, ["asthma"])], skip_terms=["Flu"])
    out = rules.rule_chain(frame(rows, MENTION), docs, ruleset).orderBy("start_pos")
    assert [r["ruled_by"] for r in out.collect()] == ["neg", "skip-term", "neg"]
    out = rules.rule_chain(frame(rows, MENTION), docs, RuleSet()).orderBy("start_pos")
    assert [r["ruled_by"] for r in out.collect()] == [None, None, "nlp-label"]
