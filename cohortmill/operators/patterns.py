"""Sentence patterns around mentions and the confidence model built on them."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import text as tx
from cohortmill.operators import textmine

# fixed values: the mark of a mention in a pattern, separators, accuracy classes, tags
MARK = "KCL"
STEP = "->"
BACK_STEP = "<-"
GAP = "=#="
HIGH, LOW = 0.75, 0.25
UNSEEN = -1.0
UNLABELLED = "-"
STOP_TAGS = ["SPACE", "VERB", "PUNCT", "CCONJ", "ADP"]
TAIL_TAGS = ["PUNCT", "SPACE"]
CONTENT_TAGS = ["VERB", "NOUN", "PROPN"]
# rows of a tag table that enters a plan as a literal
LITERAL_TAGS = 64


def tagged_sentences(docs: DataFrame, tags: DataFrame, *, only: DataFrame | None = None, default: str = "NOUN") -> DataFrame:
    """Sentences with their words, tags and offsets as arrays, and the positions of stops, verbs and runs.

    ``tags(token, tag)`` is any token to tag table; words it lacks get the default. ``only`` names
    the sentences to tag, by ``(doc_id, sent_no)``. The array of
    one sentence is collected, never that of a document.
    """
    sents = textmine.sentences(docs)
    if only is not None:
        sents = sents.join(only, ["doc_id", "sent_no"], "left_semi")
    few = tags.select("token", "tag").limit(LITERAL_TAGS + 1).collect()
    known = [r for r in few if r.token is not None]
    if len(few) <= LITERAL_TAGS and len({r.token for r in known}) == len(known):
        # a short table enters as a literal, and a sentence stays one row; copies of a sentence are put together as below
        tag_of = F.create_map(*(F.lit(x) for r in known for x in r)) if known else F.lit(None).cast("map<string,string>")
        item = lambda w, i: F.struct(
            i.alias("tok_no"), (F.col("sent_start") + w["start"]).alias("start_pos"), (F.col("sent_start") + w["end"]).alias("end_pos"),
            w["str"].alias("token"), F.coalesce(F.try_element_at(tag_of, F.lower(w["str"])), F.lit(default)).alias("tag"),
        )
        # asked of the text: a filter on the words would be moved before the join and work them out for all sentences
        one = sents.where(F.col("sent_text").rlike(tx.WORD)).select("doc_id", "sent_no", F.transform(tx.word_spans("sent_text"), item).alias("words"))
        copies = one.groupBy("doc_id", "sent_no").agg(F.collect_list("words").alias("copies"))
        # the words of one copy are in order
        words = F.when(F.size("copies") == 1, F.col("copies")[0]).otherwise(F.sort_array(F.flatten("copies")))
        rows = copies.select("doc_id", "sent_no", words.alias("words"))
    else:
        words = textmine.sentence_tokens(sents)
        named = words.join(
            scale.bounded_broadcast(tags.select(F.col("token").alias("_t"), "tag")), F.lower("token") == F.col("_t"), "left"
        )
        item = F.struct("tok_no", "start_pos", "end_pos", "token", F.coalesce("tag", F.lit(default)).alias("tag"))
        rows = named.groupBy("doc_id", "sent_no").agg(F.sort_array(F.collect_list(item)).alias("words"))
    listed = rows.select(
        "doc_id",
        "sent_no",
        F.transform("words", lambda w: w["tag"]).alias("tags"),
        F.transform("words", lambda w: w["token"]).alias("toks"),
        F.transform("words", lambda w: w["start_pos"]).alias("starts"),
        F.transform("words", lambda w: w["end_pos"]).alias("ends"),
    )
    # a run starts where the tag differs from the one before
    first = lambda i: (i == 0) | (F.get("tags", i) != F.get("tags", i - 1))
    runs = listed.withColumn("run_starts", F.filter(F.sequence(F.lit(0), F.size("tags") - 1), first))
    return runs.select(
        "doc_id",
        "sent_no",
        "tags",
        "toks",
        "starts",
        "ends",
        _positions(F.transform("tags", lambda t: t.isin(*STOP_TAGS))).alias("stops"),
        _positions(F.transform("tags", lambda t: t == "VERB")).alias("verbs"),
        F.transform("run_starts", lambda i: F.get("tags", i)).alias("run_tags"),
        "run_starts",
    )


def _positions(flags: Column) -> Column:
    """Indexes of the true items."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def _count_below(values: Column | str, limit: Column) -> Column:
    return F.size(F.filter(values, lambda v: v < limit))


def pattern_features(mentions: DataFrame, docs: DataFrame, tags: DataFrame) -> DataFrame:
    """One instance per mention with its four pattern levels.

    ``pattern`` is the collapsed tag sequence of the words around the mention up to the next stop
    tag on both sides, ``variant`` the other words of that stretch, ``sent_pattern`` the tags
    before the mention back to the verb and ``sent_text`` the content words among them.
    ``full_pattern`` is the collapsed tag sequence of the whole sentence. What belongs to the
    sentence alone is worked out once per sentence and not per mention.
    """
    # used twice
    placed = scale.cut(textmine.place_in_sentences(mentions, docs))
    held = placed.select("doc_id", "sent_no").distinct()
    rows = placed.join(tagged_sentences(docs, tags, only=held), ["doc_id", "sent_no"])
    size = F.size("tags")
    rows = rows.withColumn("_first", _count_below("starts", F.col("start_pos")))
    rows = rows.withColumn("_next", _count_below("ends", F.col("end_pos") + 1)).where("_next > _first")
    first, follow = F.col("_first"), F.col("_next")
    rows = rows.withColumn(
        "_from", F.coalesce(F.array_max(F.filter("stops", lambda p: p < first)), F.lit(-1)) + 1
    ).withColumn("_to", F.coalesce(F.array_min(F.filter("stops", lambda p: p >= follow)), size))
    begin, stop = F.col("_from"), F.col("_to")

    mark = F.array(F.lit(MARK))
    left, right = (begin, first - begin), (follow, stop - follow)
    stretch = F.concat(F.slice("tags", left[0] + 1, left[1]), mark, F.slice("tags", right[0] + 1, right[1]))
    left_text = F.array_join(F.slice("toks", left[0] + 1, left[1]), " ")
    right_text = F.array_join(F.slice("toks", right[0] + 1, right[1]), " ")
    variant = F.concat_ws(f" {GAP} ", F.nullif(left_text, F.lit("")), F.nullif(right_text, F.lit("")))

    # words before the mention, nearest first, up to and with the first verb
    verb = F.coalesce(F.array_max(F.filter("verbs", lambda p: p < first)), F.lit(0))
    path_tags = F.reverse(F.slice("tags", verb + 1, first - verb))
    path_toks = F.reverse(F.slice("toks", verb + 1, first - verb))
    content = F.filter(
        F.zip_with(path_toks, path_tags, lambda w, t: F.when(t.isin(*CONTENT_TAGS), w)), lambda w: w.isNotNull()
    )

    # runs that start before the mention, and runs that end behind it
    n_before = _count_below("run_starts", first)
    n_gone = _count_below("run_starts", follow + 1)
    # the run that holds the word behind the mention is kept
    rest = F.when(follow < size, F.slice("run_tags", F.greatest(n_gone, F.lit(1)), F.size("run_tags"))).otherwise(
        F.array().cast("array<string>")
    )
    whole = F.array_join(F.concat(F.slice("run_tags", F.lit(1), n_before), mark, rest), STEP)
    tail = "|".join(TAIL_TAGS)
    return rows.select(
        *[c for c in mentions.columns if c != "sent_no"],
        "sent_no",
        F.array_join(tx.collapse_runs(stretch), STEP).alias("pattern"),
        variant.alias("variant"),
        F.array_join(path_tags, BACK_STEP).alias("sent_pattern"),
        F.array_join(content, " ").alias("sent_text"),
        F.regexp_replace(whole, rf"(?:{STEP}(?:{tail}))+$", "").alias("full_pattern"),
    )


def accuracy(instances: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, n, accuracy``; instances without a ground truth count for n only."""
    return summed_accuracy(judged_counts(instances, keys), keys)


def judged_counts(instances: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, n, known, right``: instances, those with a ground truth, and those that agree with it."""
    right = F.when(F.col("gt_label") != UNLABELLED, (F.col("gt_label") == F.col("signed_label")).cast("int"))
    return instances.groupBy(*keys).agg(F.count("*").alias("n"), F.count(right).alias("known"), F.sum(right).alias("right"))


def summed_accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, n, accuracy`` of counts by these keys or more."""
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("right").alias("right"))
    return sums.select(*keys, "n", (F.col("right") / F.nullif("known", F.lit(0))).alias("accuracy"))


def accuracy_class(acc: Column) -> Column:
    """easy_accurate, easy_inaccurate or hard."""
    return F.when(acc >= HIGH, "easy_accurate").when(acc <= LOW, "easy_inaccurate").when(acc.isNotNull(), "hard")


def classified(instances: DataFrame, keys: list[str], *, min_freq: int) -> DataFrame:
    """Frequent keys with their accuracy class; keys without any ground truth are left out."""
    return classified_counts(judged_counts(instances, keys), keys, min_freq=min_freq)


def classified_counts(counts: DataFrame, keys: list[str], *, min_freq: int) -> DataFrame:
    """The same from counts (:func:`judged_counts`)."""
    scored = summed_accuracy(counts, keys).where(F.col("n") >= min_freq)
    return scored.withColumn("cls", accuracy_class(F.col("accuracy"))).where("cls IS NOT NULL")


@dataclass
class PatternModel:
    """The four levels as tables."""

    patterns: DataFrame
    variants: DataFrame
    sent_patterns: DataFrame
    clusters: DataFrame
    cluster_names: DataFrame | None = None


def train_pattern_model(
    instances: DataFrame,
    *,
    cluster_names: DataFrame | None = None,
    pattern_freq: int = 3,
    variant_freq: int = 5,
    sent_freq: int = 6,
    cluster_freq: int = 3,
) -> PatternModel:
    """Model from labelled instances; each level looks only below the hard keys of the one above.

    ``cluster_names(sent_text, cluster)`` groups similar sentence texts; a text it lacks is its
    own cluster. The instances are read once, into counts by all four keys; levels are written, as each is read several times.
    """
    counts = scale.cut(judged_counts(instances, ["pattern", "variant", "sent_pattern", "sent_text"]))
    patterns = scale.cut(summed_accuracy(counts, ["pattern"]).where(F.col("n") >= pattern_freq))
    inside = counts.join(patterns.select("pattern"), "pattern", "left_semi")
    variants = scale.cut(classified_counts(inside, ["pattern", "variant"], min_freq=variant_freq))
    hard = variants.where("cls = 'hard'").select("pattern", "variant")
    below = inside.join(hard, ["pattern", "variant"], "left_semi")
    sent_patterns = scale.cut(classified_counts(below, ["pattern", "variant", "sent_pattern"], min_freq=sent_freq))
    hard = sent_patterns.where("cls = 'hard'").select("pattern", "variant", "sent_pattern")
    leaves = with_cluster(below.join(hard, ["pattern", "variant", "sent_pattern"], "left_semi"), cluster_names)
    clusters = scale.cut(classified_counts(leaves, ["pattern", "variant", "sent_pattern", "cluster"], min_freq=cluster_freq))
    return PatternModel(patterns, variants, sent_patterns, clusters, cluster_names)


def with_cluster(instances: DataFrame, cluster_names: DataFrame | None) -> DataFrame:
    """Instances with the cluster of their sentence text."""
    if cluster_names is None:
        return instances.withColumn("cluster", F.col("sent_text"))
    named = instances.join(scale.bounded_broadcast(cluster_names), "sent_text", "left")
    return named.withColumn("cluster", F.coalesce("cluster", "sent_text"))


def confidence_cascade(instances: DataFrame, model: PatternModel) -> DataFrame:
    """Confidence per instance: the deepest level that decides, with a fallback per level.

    A pattern never seen gives -1. An easy pattern or variant decides at once; a hard one asks
    the sentence pattern and then the cluster. Levels are looked up once for equal keys, and the instances are joined to the result.
    """
    k2, k3 = ["pattern", "variant"], ["pattern", "variant", "sent_pattern"]
    k4 = [*k3, "cluster"]
    named = with_cluster(instances, model.cluster_names)
    rows = named.select(*k4).distinct()
    rows = rows.join(
        scale.bounded_broadcast(model.patterns.select("pattern", F.col("accuracy").alias("_a1"))), "pattern", "left"
    )
    rows = rows.join(
        scale.bounded_broadcast(model.variants.select(*k2, F.col("accuracy").alias("_a2"), F.col("cls").alias("_c2"))), k2, "left"
    )
    rows = rows.join(
        scale.bounded_broadcast(model.sent_patterns.select(*k3, F.col("accuracy").alias("_a3"), F.col("cls").alias("_c3"))), k3, "left"
    )
    rows = rows.join(scale.bounded_broadcast(model.clusters.select(*k4, F.col("accuracy").alias("_a4"))), k4, "left")
    a1 = F.col("_a1")
    score = (
        F.when(a1.isNull(), UNSEEN)
        .when((a1 >= HIGH) | (a1 <= LOW), a1)
        .when(F.col("_c2").isNull(), a1)
        .when(F.col("_c2") != "hard", F.col("_a2"))
        .when(F.col("_c3").isNull(), a1)
        .when(F.col("_c3") != "hard", F.col("_a3"))
        .otherwise(F.coalesce("_a4", "_a3"))
    )
    scored = scale.bounded_broadcast(scale.cut(rows.select(*(F.col(c).alias(f"_{c}") for c in k4), score.alias("confidence"))))
    # keys may be null
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k4))
    return named.join(scored, same).select(*named.columns, "confidence")


def top_patterns(instances: DataFrame, *, k: int = 10) -> DataFrame:
    """The most frequent sentence patterns."""
    return instances.groupBy("full_pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "full_pattern").limit(k)


def short_patterns(instances: DataFrame, *, steps: int = 5) -> DataFrame:
    """Distinct sentence patterns of at most the given number of steps."""
    return instances.select("full_pattern").distinct().where(F.size(F.split("full_pattern", STEP)) <= steps)


def prefixes(instances: DataFrame, *, steps: int) -> DataFrame:
    """Instances with one row for each prefix of their tag path, from the mention outwards, of at most ``steps`` tags.

    The empty prefix stands for the pattern alone, so there is always one to fall back on.
    """
    path = F.slice(F.filter(F.split("sent_pattern", BACK_STEP), lambda t: t != ""), 1, steps)
    one = F.transform(F.sequence(F.lit(0), F.size("_path")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("_path", F.lit(1), n), BACK_STEP).alias("prefix")))
    rows = instances.withColumn("_path", path)
    return rows.select(*instances.columns, F.inline(one))


def pattern_tree(instances: DataFrame, *, min_freq: int = 3, steps: int = 6) -> DataFrame:
    """Prefix tree of the tag paths below each pattern as a table: ``pattern, depth, prefix, n, accuracy`` of its frequent nodes.

    A node counts all instances that pass through it, so a frequent node has frequent nodes above it.
    """
    nodes = accuracy(prefixes(instances, steps=steps), ["pattern", "depth", "prefix"])
    return nodes.where((F.col("n") >= min_freq) & F.col("accuracy").isNotNull())


def back_off(instances: DataFrame, tree: DataFrame, *, key: list[str], steps: int = 6) -> DataFrame:
    """``key…, depth, confidence``: accuracy of the deepest node of the tree that an instance reaches.

    An instance whose pattern is not in the tree has depth -1 and the confidence of an unseen one.
    """
    found = prefixes(instances.select(*key, "pattern", "sent_pattern"), steps=steps).join(
        scale.bounded_broadcast(tree.select("pattern", "depth", "prefix", F.col("accuracy").alias("_acc"))), ["pattern", "depth", "prefix"], "left"
    )
    deepest = F.max(F.when(F.col("_acc").isNotNull(), F.struct("depth", "_acc")))
    rows = found.groupBy(*key).agg(deepest.alias("_node"))
    return rows.select(*key, F.coalesce("_node.depth", F.lit(-1)).alias("depth"), F.coalesce("_node._acc", F.lit(UNSEEN)).alias("confidence"))
