"""What a task holds must not grow with the rows of a batch, a cell or a file."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import text as tx
from cohortmill.operators import clusters, learn, ontology, patterns, search


def test_postings_of_a_batch_come_in_slices(monkeypatch):
    monkeypatch.setattr(search, "SLICE_WORDS", 4)
    words = [["b", "a", "b"], None, [], ["a"], ["c"] * 6, ["a", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 16)), pa.array(words, pa.list_(pa.string()))], names=["doc", "words"])
    out = list(search._postings([batch]))
    assert len(out) == 3
    got = sorted((r["doc"], r["token"], r["positions"]) for b in out for r in b.to_pylist())
    assert got == [(10, "a", [1]), (10, "b", [0, 2]), (13, "a", [0]), (14, "c", [0, 1, 2, 3, 4, 5]), (15, "a", [0]), (15, "c", [1])]


def test_a_point_stands_in_one_block(frame):
    draw = np.random.default_rng(5)
    points = frame([(k, draw.normal(size=8).tolist()) for k in range(100)], "id long, vec array<double>")
    blocks = clusters._blocks(points, clusters.choose_pivots(points, 100), 100, 30).collect()
    ids = [i for b in blocks for i in np.frombuffer(b.ids, np.int64)]
    assert sorted(ids) == list(range(100)) and max(b.n for b in blocks) <= 30


def test_offsets_of_few_and_of_many_matches(frame):
    texts = [" ".join("ab" for _ in range(n)) + end for n in (1, tx.FEW - 1, tx.FEW, 3 * tx.FOLD) for end in ("", " .")]
    for r in frame([(t,) for t in texts], "t string").select("t", tx.word_spans("t").alias("s")).collect():
        assert [(s.start, s.end, s.str) for s in r.s] == [(3 * k, 3 * k + 2, "ab") for k in range(r.t.count("ab"))]


def test_tags_as_a_literal_and_as_a_table(frame, monkeypatch):
    docs = frame([(1, "She was ill. He left Was"), (2, None), (3, "- -. ok")], "doc_id long, text string")
    tags = frame([("was", "VERB"), (None, "X"), ("ill", None)], "token string, tag string")
    literal = sorted(map(str, patterns.tagged_sentences(docs, tags).collect()))
    monkeypatch.setattr(patterns, "LITERAL_TAGS", 0)
    assert literal == sorted(map(str, patterns.tagged_sentences(docs, tags).collect())) and len(literal) == 3


def test_the_model_reads_the_instances_once(frame, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(patterns, "judged_counts", lambda rows, keys, real=patterns.judged_counts: seen.append(keys) or real(rows, keys))
    rows = [("p", "v", "s", "t", "x", "x" if k % 2 else "y") for k in range(8)] + [("p", None, None, None, "x", "-")]
    model = patterns.train_pattern_model(frame(rows, "pattern string, variant string, sent_pattern string, sent_text string, signed_label string, gt_label string"))
    assert len(seen) == 1
    assert [(r.n, r.accuracy) for r in model.patterns.collect()] == [(9, 0.5)] and [(r.n, r.cls) for r in model.clusters.collect()] == [(8, "hard")]


def test_one_file_is_spread_over_the_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    with_splits = one.select("id")
    assert scale.spread_small_input(with_splits, by_file=True).rdd.getNumPartitions() >= cores


def test_rows_are_weighed_before_the_rounds(frame):
    rows = frame([(0, "a", [3, 1, 3]), (1, "b", []), (2, None, None)], "fold int, label string, slots array<int>")
    got = learn.weighted_rows(rows).orderBy("fold").collect()
    assert [r.places for r in got] == [[1, 3], [], []] and np.isclose(sum(w * w for w in got[0].weights), 1)
    assert learn.weighted_rows(rows).select(F.size("weights").alias("n")).agg(F.sum("n")).first()[0] == 2


def test_no_round_of_a_closure_is_broadcast(frame, monkeypatch):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plans = []
    monkeypatch.setattr(scale, "cut", lambda df, real=scale.cut: plans.append(plan(df)) or real(df))
    # two ways to d, and a cycle
    edges = frame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b")], "parent string, child string")
    reach = ontology.closure_in_rounds(frame([(c, c) for c in "abe"], "root string, cui string"), edges, keys=["root"])
    best = ontology.richest_closure(frame([("s", "b"), ("s", "a"), ("t", "e"), ("t", "x")], "term string, cui string"), reach)
    assert len(plans) > 4 and not [p for p in [*plans, plan(best)] if "Broadcast" in p]
    assert sorted("".join(r) for r in reach.collect()) == ["aa", "ab", "ac", "ad", "bb", "bd", "ee"]
    assert sorted(map(tuple, best.collect())) == [("s", "a", 4), ("t", "e", 1)]
