"""Small fixtures for the operators that SQL does not check, and for edge cases."""

import datetime
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import codes
from cohortmill.functions import text as tx
from cohortmill.operators import clusters, deident, filters, joins, learn, ontology, patterns, rules, search, sections, summary, textmine, validation
from cohortmill.sources import config, readers, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# --- plans that must hold for keys of any size


def test_hot_keys_are_split_without_a_look_ahead(spark, frame):
    left = spark.range(60_000).select((F.when(F.col("id") < 50_000, 1).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = scale.cut(spark.range(60_000).select(F.col("id").alias("k"), F.concat(F.lit("r"), "id").alias("w")))
    want = left.count()
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        joined = scale.skew_join(left.repartition(8), right, "k")
        assert len(joined.collect()) == want
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_broadcast_only_below_the_bound(frame):
    df = frame([(i,) for i in range(10)], "k long")
    has_hint = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert has_hint(scale.bounded_broadcast(df, 10))
    assert not has_hint(scale.bounded_broadcast(df, 9))
    assert scale.is_small(df, 10, max_bytes=1000) and not scale.is_small(df, 10, max_bytes=20)


def test_numbering_and_neighbours_across_buckets(frame):
    df = frame([(k, p, f"{k}{p}") for k in "ab" for p in (1, 7, 12, 30, 31, 95)], "k string, p int, v string")
    out = scale.numbered(df, "k", [F.col("p")], F.floor(F.col("p") / 10), "no")
    assert rows(out.where("k = 'a'"), "p", "no") == [(1, 1), (7, 2), (12, 3), (30, 4), (31, 5), (95, 6)]
    near = scale.neighbours(df, "k", "p", "v", F.floor(F.col("p") / 10))
    got = {r["p"]: (r["prev"], r["next"]) for r in near.where("k = 'b'").collect()}
    assert got == {1: (None, "b7"), 7: ("b1", "b12"), 12: ("b7", "b30"), 30: ("b12", "b31"), 31: ("b30", "b95"), 95: ("b31", None)}


def test_sample_is_stable_and_cut_before_the_exchange(frame):
    df = frame([(i % 3, i) for i in range(300)], "g long, i long")
    one = validation.sample_per_group(df, "g", k=5, key=["i"])
    two = validation.sample_per_group(df.repartition(7), "g", k=5, key=["i"])
    assert rows(one) == rows(two) and one.count() == 15
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_large_patient_comes_in_bounded_parts(frame):
    schema = "doc_id long, cui string, pref string, sty string, str string, start_pos int, end_pos int, negation string, temporality string, experiencer string, ruled_by string"
    data = [(i % 5, f"C{i}", "p", "s", "x", i, i + 1, "Affirmed", "Recent", "Patient", None) for i in range(100)]
    docs = frame([(d, 1 if d < 4 else 2) for d in range(5)], "doc_id long, pid long")
    out = summary.build_patient_entities(frame(data, schema), docs, part_rows=10).cache()
    assert out.where("pid = 1").count() > 4
    assert out.agg(F.sum(F.size("anns"))).first()[0] == 100
    assert out.where("pid = 2").agg(F.sum(F.size("anns"))).first()[0] == 20
    texts = frame([(2, 1000 + i, "x" * 50) for i in range(40)], "pid long, doc_id long, text string")
    out = summary.build_patient_entities(frame(data, schema), docs, texts, part_bytes=200)
    assert out.where("pid = 2").count() > 4 and out.where("pid = 1").count() == 1
    assert out.agg(F.sum(F.size("articles")), F.sum(F.size("anns"))).first()[:] == (40, 100)


# --- ontology


def test_closure_with_cycle_diamond_and_skip(frame):
    edges = frame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "parent string, child string")
    seeds = frame([("s", "b"), ("t", "e"), ("u", "x")], "name string, cui string")
    out = ontology.transitive_closure(seeds, edges, keys=["name"])
    assert rows(out) == [("s", c) for c in "abcde"] + [("t", "e"), ("u", "x")]
    skip = frame([("d", "a")], "parent string, child string")
    assert rows(ontology.transitive_closure(seeds, edges, keys=["name"], skip=skip)) == [("s", "b"), ("s", "d"), ("s", "e"), ("t", "e"), ("u", "x")]


def plain_closure(starts, edges):
    found = set(starts)
    todo = list(starts)
    while todo:
        name, at = todo.pop()
        new = {(name, c) for p, c in edges if p == at} - found
        found |= new
        todo += new
    return found


def test_closures_of_any_graph(frame):
    draw = random.Random(15)
    edges = [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(50)] + [(None, "n1"), ("n2", None)] * 2
    starts = [(draw.choice(["s", "t", None]), f"n{draw.randrange(45)}") for _ in range(12)]
    want = plain_closure(starts, [e for e in edges if None not in e])
    steps = frame(edges[:-4], "parent string, child string").distinct()
    seeds = frame(starts, "name string, cui string")
    assert set(map(tuple, ontology.transitive_closure(seeds, frame(edges, "parent string, child string"), keys=["name"]).collect())) == want
    got = ontology.closure_in_rounds(seeds, steps, keys=["name"], part_rows=7).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    only = {(c,) for _, c in want}
    assert set(map(tuple, ontology.transitive_closure(seeds.drop("name"), steps).collect())) == only


def test_a_deep_path_takes_one_pass(frame):
    edges = frame([(k, k + 1) for k in range(5000)], "parent long, child long")
    out = ontology.transitive_closure(frame([(1,), (4000,)], "cui long"), edges)
    assert out.agg(F.min("cui"), F.max("cui"), F.count("*")).first()[:] == (1, 5000, 5000)


def test_a_round_reads_the_parts_of_its_frontier(frame):
    edges = frame([(k, k + 1) for k in range(120)], "parent long, child long")
    read = []
    out = ontology.closure_in_rounds(frame([(112,)], "cui long"), edges, part_rows=10, read=read)
    assert sorted(r.cui for r in out.collect()) == list(range(112, 121)) and len(read) == 9
    # one part of the steps and one of what was found, also when the closure has grown
    assert max(read) <= 60 and max(read[5:]) <= max(read[:5]) + 20


def test_exclusive_three_way_overlap_is_disjoint(frame):
    closure = frame([("A", 1, "x"), ("B", 2, "x"), ("C", 3, "x"), ("A", 1, "y"), ("B", 2, "y"), ("A", 1, "z")], "name string, priority int, cui string")
    assert rows(ontology.exclusive_concepts(closure), "name", "cui") == [("A", "z"), ("B", "y"), ("C", "x")]
    assert rows(ontology.exclusion_report(closure)) == [("A", "B", 1), ("A", "C", 1), ("B", "C", 1)]


def test_code_expansion(frame):
    df = frame([("A1",), ("B20",), ("C123",), ("D45X",)], "c string")
    got = {r["c"]: r["x"] for r in df.select("c", codes.expand_code("c").alias("x")).collect()}
    assert got["C123"] == ["C12.3"] and got["D45X"][:2] == ["D45", "D45.0"] and len(got["B20"]) == 11
    assert set(got["A1"]) >= {"A10", "A10.0", "A19.9"} and len(got["A1"]) == 110
    ranges = frame([("A10-A12",), ("b08-10",), ("K5",), ("A100-A102",)], "c string").select(codes.expand_range("c")).collect()
    assert [r[0] for r in ranges] == [["A10", "A11", "A12"], ["B08", "B09", "B10"], ["K5"], ["A100", "A101", "A102"]]


# --- sections and measurements


def test_sections_with_unmapped_header_and_mention_in_header(frame):
    text = "intro\nPast History:\nasthma\nNote:\nflu\nPlan:\nrest"
    docs = frame([(1, text), (2, "no headers at all")], "doc_id long, text string")
    out = sections.parse_sections(docs, {"past history": "History", "plan": "Plan"}).orderBy("start").collect()
    assert [(r["section"], r["text"]) for r in out] == [
        ("", "intro\n"), ("History", "Past History:\nasthma\nNote:\nflu\n"), ("Plan", "Plan:\nrest")
    ]
    from cohortmill.operators import joins

    spans = [("header", "History"), ("inside", "asthma"), ("unmapped", "flu"), ("last", "rest")]
    mentions = frame([(1, n, text.index(w)) for n, w in spans], "doc_id long, cui string, start_pos int")
    placed = joins.mentions_in_sections(mentions, sections.parse_sections(docs, {"past history": "History", "plan": "Plan"}))
    assert rows(placed, "cui", "section") == [("inside", "History"), ("last", "Plan"), ("unmapped", "History")]


def test_titles_numbers_and_markup(frame):
    df = frame([("1. Plan",), (" Past History ",)], "t string")
    assert [r[0] for r in df.select(tx.normalise_title("t")).collect()] == ["", "past history"]
    assert [r[0] for r in df.select(tx.normalise_title("t", True)).collect()] == ["plan", "past history"]
    number, long = r"\d+(?:[.,/]\d+)*%?", "1234567890" * 6
    near = frame([("K: 4.5 mmol", 1), ("Hb 98%", 2), ("x" * 30 + "77", 0), ("Na *123", 2), ("a 12/08", 1), (f"b{' ' * 9}{long} x", 1)], "t string, e int")
    assert [r[0] for r in near.select(tx.first_number("t", F.col("e"), number)).collect()] == ["4.5", "98%", None, None, "12/08", long]
    page = frame([("<html><head><title>t</title></head><table><tr>gone</tr></table><h1>Top &amp; more</h1><p>one<br>two</p></html>",)], "html string")
    assert sections.markup_to_text(page).first()["text"].strip() == "Top & more.\none\ntwo"


def test_records_of_a_dump(frame):
    dump = frame([('head\n12,"first\ntext"\n7,"second"',)], "text string")
    out = sections.split_records(dump, r'(?m)^(\d+),"')
    assert rows(out) == [("12", 'first\ntext"\n'), ("7", 'second"')]


# --- de-identification


def test_masking_keeps_length_and_letter_areas(frame):
    text = "Dr. Strange of Ward 9\nTo: Mr Ford\nDr. Inner stays\n-- the end --\nDr. Tail 0207 11"
    docs = frame([(1, text), (2, "Dr. Who")], "doc_id long, text string")
    name_rule = deident.MaskRule("doctor", r"(Dr)[.] (\w+)", ["title", "name"])
    off = deident.MaskRule("phone", r"(\d{4})", ["number"], disabled=True)
    full = {r["doc_id"]: r for r in deident.deidentify(docs, [name_rule, off]).collect()}
    assert full[1]["masked"] == re.sub("Strange|Inner|Tail", lambda m: "x" * len(m.group()), text)
    assert [f["value"] for f in full[2]["found"]] == ["Who"]
    letter = deident.LetterRules("^To: .*$", "^-- the end --$")
    part = {r["doc_id"]: r for r in deident.deidentify(docs, [name_rule], letter=letter).collect()}
    assert part[1]["masked"] == re.sub("Strange|Tail", lambda m: "x" * len(m.group()), text)
    assert part[2]["masked"] is None


# --- text search


def test_sloppy_phrases_and_dictionary(frame):
    docs = frame([(1, "enlarged left kidney"), (2, "kidney is enlarged"), (3, "enlarged a b c d e f kidney")], "doc_id long, text string")
    near = lambda slop: rows(textmine.text_search(docs, phrases=[("enlarged kidney", slop)]), "doc_id")
    assert near(0) == [] and near(1) == [(1,)] and near(3) == [(1,), (2,)] and near(6) == [(1,), (2,), (3,)]
    gaz = frame([("lung cancer", "C1", "s", "p"), ("cancer", "C2", "s", "p"), ("small cell lung cancer", "C3", "s", "p")], "term string, cui string, sty string, pref string")
    words = " ".join(f"w{i}" for i in range(30))
    text = f"{words} Small cell Lung cancer, cancer. {words} xx lung cancer"
    hits = textmine.dictionary_annotate(frame([(1, text)], "doc_id long, text string"), gaz)
    got = [(r["cui"], text[r["start_pos"]:r["end_pos"]], r["str"]) for r in hits.orderBy("start_pos").collect()]
    assert got == [("C3",) + ("Small cell Lung cancer",) * 2, ("C2", "cancer", "cancer"), ("C1", "lung cancer", "lung cancer")]


def test_long_terms_reach_over_stretches(frame):
    words = [f"w{k}" for k in range(120)]
    rows_of = [(" ".join(words[a:b]), c, "s", "p") for a, b, c in ((31, 71, "C1"), (0, 40, "C2"), (70, 110, "C3"))]
    gaz = frame([*rows_of, ("pré", "C4", "s", "p"), ("of", "C5", "s", "p")], "term string, cui string, sty string, pref string")
    text = " ".join(words)
    docs = frame([(1, text), (2, "le pré est caféof x"), (3, " ".join(words[31:71]))], "doc_id long, text string")
    hits = rows(textmine.dictionary_annotate(docs, gaz), "doc_id", "cui", "str")
    assert [h[:2] for h in hits] == [(1, "C1"), (1, "C2"), (1, "C3"), (2, "C4"), (3, "C1")]
    assert hits[0][2] == rows_of[0][0]


def test_numbers_of_any_length(frame):
    docs = frame([(1, "glucose 1234567890123.5 and more"), (2, "glucose none")], "doc_id long, text string")
    out = textmine.numeric_search(docs, anchor="glucose", low=1, high=1e15, number=r" (\d+[.]\d+)")
    assert rows(out, "doc_id", "n_in", "verdict") == [(1, 1, 1)]


def test_wide_ids_stay_apart(frame):
    from cohortmill.sources.tables import cui_of

    ids = frame([(12,), (10_000_000,), (100_000_001,)], "n long").select(cui_of(F.col("n")).alias("c"))
    assert rows(ids) == [("C0000012",), ("C10000000",), ("C100000001",)]


def test_sentence_search_by_halving(frame):
    import random

    draw = random.Random(5)
    for _ in range(3):
        cuts = sorted(draw.sample(range(400), 40))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        points = [(p, p + draw.randint(0, 30)) for p in range(0, 410, 7)]
        df = frame([(1, spans, s, e) for s, e in points], "id int, sents array<struct<start:int,end:int>>, s int, e int")
        fast = rules.sentence_index(F.col("sents"), F.col("s"), F.col("e"), rules.ends_in_order(F.col("sents")))
        slow = rules.sentence_index(F.col("sents"), F.col("s"), F.col("e"), F.lit(False))
        assert df.where(~fast.eqNullSafe(slow)).count() == 0


def test_pairs_of_vectors_meet_once():
    draw = np.random.default_rng(3)
    flat = draw.normal(size=(600, 64))
    clustered = draw.normal(size=(40, 64))[draw.integers(0, 40, 4000)] * 20 + draw.normal(size=(4000, 64)) * 0.01
    for x, eps, most in ((flat, 2.0, 1.0), (clustered, 1.0, 0.1)):
        pivots = x[draw.choice(len(x), len(x) // clusters.CELL_POINTS, replace=False)]
        row, cell, home = clusters.cells_of(x, pivots, eps, "lower")
        met, pairs = 0, set()
        for c in np.unique(cell):
            own, guests = row[(cell == c) & home], row[(cell == c) & ~home]
            met += len(own) * (len(own) - 1) // 2 + len(own) * len(guests)
            if len(x) < 1000:
                mine = [tuple(sorted((a, b))) for a in own for b in (*own, *guests) if a != b]
                assert not pairs & set(mine)
                pairs |= set(mine)
        assert met <= most * len(x) * (len(x) - 1) / 2


def test_windows_around_a_mention(frame):
    text = "one two, three " + "-" * 500 + " four five"
    df = frame([(text, text.index("four"), len(text))], "t string, s int, e int")
    out = df.select(tx.tokens_before("t", F.col("s"), 2), tx.tokens_after("t", 0, 2), tx.last_items(tx.words, "t", F.col("s"), 2)).first()
    assert out[0] == ["three", "-" * 500] and out[1] == ["one", "two,"] and out[2] == ["two", "three"]


# --- windows of patients


def test_window_edges_and_missing_dates(frame):
    day = lambda d: datetime.datetime(2020, 1, d)
    docs = frame([(i, 1, day(d) if d else None) for i, d in enumerate([1, 5, 10, 11, 0])] + [(9, 2, day(30))], "doc_id long, pid long, doc_date timestamp")
    windows = frame([(1, day(5), day(10))], "pid long, t0 timestamp, t1 timestamp")
    assert rows(filters.within_patient_window(docs, windows), "doc_id") == [(1,), (2,), (9,)]
    assert rows(filters.within_patient_window(docs, windows, on_missing="keep"), "doc_id") == [(1,), (2,), (4,), (9,)]
    index = frame([(1, day(10))], "pid long, index_date timestamp")
    kept = filters.within_relative_window(docs, index, days_before=5, days_after=0)
    assert rows(kept, "doc_id") == [(1,), (2,), (4,), (9,)]


# --- confidence model


def test_cascade_falls_back_level_by_level(frame):
    model = patterns.PatternModel(
        frame([("easy", 9, 0.9), ("mid", 9, 0.5)], "pattern string, n long, accuracy double"),
        frame([("mid", "good", 9, 0.8, "easy_accurate"), ("mid", "bad", 9, 0.1, "easy_inaccurate"), ("mid", "hard", 9, 0.6, "hard")], "pattern string, variant string, n long, accuracy double, cls string"),
        frame([("mid", "hard", "P1", 9, 1.0, "easy_accurate"), ("mid", "hard", "P2", 9, 0.55, "hard")], "pattern string, variant string, sent_pattern string, n long, accuracy double, cls string"),
        frame([("mid", "hard", "P2", "verbs", 9, 0.4, "hard")], "pattern string, variant string, sent_pattern string, cluster string, n long, accuracy double, cls string"),
        frame([("denies", "verbs")], "sent_text string, cluster string"),
    )
    data = [
        ("a", "unseen", "x", "x", "x"), ("b", "easy", "x", "x", "x"), ("c", "mid", "other", "x", "x"), ("d", "mid", "good", "x", "x"),
        ("e", "mid", "bad", "x", "x"), ("f", "mid", "hard", "P9", "x"), ("g", "mid", "hard", "P1", "x"), ("h", "mid", "hard", "P2", "denies"),
        ("i", "mid", "hard", "P2", "new"),
    ]
    out = patterns.confidence_cascade(frame(data, "id string, pattern string, variant string, sent_pattern string, sent_text string"), model)
    assert dict(rows(out, "id", "confidence")) == {"a": -1.0, "b": 0.9, "c": 0.5, "d": 0.8, "e": 0.1, "f": 0.5, "g": 1.0, "h": 0.4, "i": 0.55}


def test_pattern_levels(frame):
    text = "she was treated for severe asthma attacks and left."
    at = text.index("asthma")
    mentions = frame([(1, at, at + 6)], "doc_id long, start_pos int, end_pos int")
    tags = frame([("was", "VERB"), ("treated", "VERB"), ("for", "ADP"), ("severe", "ADJ"), ("and", "CCONJ"), ("left", "VERB")], "token string, tag string")
    r = patterns.pattern_features(mentions, frame([(1, text)], "doc_id long, text string"), tags).first()
    assert r["pattern"] == "ADJ->KCL->NOUN" and r["variant"] == "severe =#= attacks"
    assert r["sent_pattern"] == "ADJ<-ADP<-VERB" and r["sent_text"] == "treated"
    assert r["full_pattern"] == "NOUN->VERB->ADP->ADJ->KCL->NOUN->CCONJ->VERB"


# --- clusters


def brute_clusters(points, eps):
    import numpy as np

    ids = sorted(points)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and np.linalg.norm(np.array(points[i]) - np.array(points[j])) <= eps:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    size = {}
    for i in ids:
        size[root(i)] = size.get(root(i), 0) + 1
    return {i: root(i) if size[root(i)] > 1 else None for i in ids}


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_clusters_agree_with_brute_force(frame, monkeypatch, block_rows):
    import numpy as np

    monkeypatch.setattr(clusters, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    data = np.round(rng.normal(size=(90, 3)), 2)
    data[60:80] = data[0]
    points = {i: [float(x) for x in v] for i, v in enumerate(data)}
    df = frame(list(points.items()), "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, 0.6, block_rows=block_rows).collect()}
    assert got == brute_clusters(points, 0.6)
    cores = df.join(frame([k for k in got.items() if k[1] is not None], "id long, cluster long"), "id")
    new = {i + 1000: [x + 0.05 for x in v] for i, v in points.items()}
    out = clusters.assign_clusters(frame(list(new.items()), "id long, vec array<double>"), cores, 0.4, block_rows=block_rows)
    for r in out.collect():
        dist = [(float(np.linalg.norm(np.array(points[i]) - np.array(new[r["id"]]))), i) for i, c in got.items() if c is not None]
        best = min(dist)
        assert r["cluster"] == (got[best[1]] if best[0] < 0.4 else None)


def test_components_of_a_long_chain_and_a_star(frame):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    out = dict(rows(clusters.connected_components(frame(edges, "src long, dst long"))))
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30))


# --- sources and sinks


def test_annotation_files_and_lines(spark, frame, tmp_path):
    def ann(kind, s, e, **features):
        return {"type": kind, "startNode": {"offset": s}, "endNode": {"offset": e}, "features": features}

    doc = {"annotations": [[ann("Mention", 3, 6, inst="C1", string_orig="flu", Negation="Affirmed"), ann("Sentence", 0, 9)], [ann("Phenotype", 1, 2, majorType="m", minorType="n")]]}
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "doc7.json").write_text(json.dumps(doc, indent=1))
    parsed = readers.read_annotation_files(spark, str(folder))
    assert rows(readers.concept_mentions(parsed), "doc_id", "cui", "str", "start_pos") == [("doc7", "C1", "flu", 3)]
    assert rows(readers.phenotype_mentions(parsed), "major_type") == [("m",)]
    assert rows(readers.sentence_table(parsed), "sent_start", "sent_end") == [(0, 9)]
    lines = tmp_path / "lines.jsonl"
    good = json.dumps({"docId": "d1", **doc}, separators=(",", ":"))
    bad = good.replace('"flu"', '"the "old" flu"').replace("d1", "d2")
    lines.write_text("\n".join([good, bad, "{broken"]))
    parsed = readers.read_annotation_lines(spark, str(lines))
    assert rows(readers.concept_mentions(parsed), "doc_id", "str") == [("d1", "flu"), ("d2", 'the "old" flu')]
    assert [r["bad"] for r in parsed.where("bad IS NOT NULL").collect()] == ["{broken"]


def test_text_files_lookup_and_episodes(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_bytes("caf\xe9".encode("cp1252"))
    docs = readers.read_documents(spark, str(tmp_path / "docs"), encoding="windows-1252")
    assert rows(docs) == [("a.txt", "café")]
    (tmp_path / "d2p.tsv").write_text("a.txt\tp1\nbroken line\nb.txt\tp2\n")
    table = readers.read_lookup_tsv(spark, str(tmp_path / "d2p.tsv"), ["doc_id", "pid"])
    assert [r["bad"] for r in table.where("bad IS NOT NULL").collect()] == ["broken line"]
    assert rows(readers.load_documents_with_patients(docs, table), "doc_id", "pid") == [("a.txt", "p1")]
    (tmp_path / "eps.tsv").write_text("\t".join(["p1"] + ["01/02/2020 10:00"] * 6) + "\n")
    ep = readers.read_episodes(spark, str(tmp_path / "eps.tsv")).first()
    assert ep["win3_e"] == datetime.datetime(2020, 2, 1, 10, 0)


def test_study_folders(spark, frame, tmp_path):
    edges = frame([("C1", "C2"), ("C2", "C3"), ("C5", "C3")], "parent string, child string")

    def study(**files):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name, content in files.items():
            stem, _, ext = name.rpartition("_")
            (folder / f"{stem}.{ext}").write_text(content if isinstance(content, str) else json.dumps(content))
        return folder

    s = config.load_study(spark, study(label2concept_tsv="flu\tC1\nbroken\ncold\tC1\n"))
    assert rows(s.closure, "name", "cui") == [("cold", "C1")] and s.rejects == ["broken"]
    s = config.load_study(spark, study(exact_concepts_mappings_json={"x": "C1", "y": "C5"}), edges=edges)
    assert rows(s.closure, "name", "cui") == [("x", "C1"), ("x", "C2"), ("y", "C3"), ("y", "C5")]
    manual = {"m": {"tc": {"closure": 2, "mapped": "C8"}, "concepts": ["C8", "C9"]}}
    s = config.load_study(spark, study(manual_mapped_concepts_json=manual, study_options_json={"sample_non_hits": True}))
    assert rows(s.closure, "name", "cui") == [("m", "C8"), ("m", "C9")] and s.options == {"sample_non_hits": True}
    term_concepts = frame([("flu", "C1"), ("flu", "C5"), ("late", "C2")], "term string, cui string")
    folder = study(study_concepts_json={"a": ["flu", "~~late", "unknown"]})
    s = config.load_study(spark, folder, edges=edges, term_concepts=term_concepts)
    assert rows(s.closure, "name", "cui") == [("a", "C1")] and s.rejects == ["unknown"]


def test_rule_configuration(spark, tmp_path):
    folder = tmp_path / "rules"
    folder.mkdir()
    (folder / "neg.json").write_text(json.dumps([{"offset": -1, "regs": ["no"], "containing_pattern": True, "more_context_sents": [-1]}]))
    (folder / "osf.json").write_text(json.dumps(["[A-Z]+$"]))
    (tmp_path / "skip.json").write_text(json.dumps(["flu"]))
    (tmp_path / "conf.json").write_text(json.dumps({"rules_folder": "rules", "active_rules": ["neg.json"], "osf_rules": ["osf.json"], "skip_term_setting": "skip.json"}))
    ruleset = config.load_rules(spark, tmp_path / "conf.json")
    assert ruleset.rules[0].name == "neg.json" and ruleset.rules[0].prev_ctx and not ruleset.rules[0].next_ctx
    assert ruleset.surface_patterns == ["[A-Z]+$"] and ruleset.skip_terms == ["flu"]
    assert config.rules_table(spark, ruleset).count() == 1


def test_standoff_files(spark, frame, tmp_path):
    schema = "doc_id long, cui string, sty string, str string, start_pos int, end_pos int, negation string, ruled_by string"
    data = [(1, "C1", "Disease or Syndrome", "flu", 5, 8, "Negated", None), (1, "C2", "Sign", "ill", 1, 4, "Affirmed", None)]
    sinks.write_standoff(sinks.standoff_lines(frame(data, schema)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["1\tT1\tSign 1 4\till", "1\tT2\tDisease_or_Syndrome 5 8\tflu", "1\tA2\tNegated T2"]


def test_study_counts_agree_with_and_without_broadcast(frame, monkeypatch):
    mentions = frame([(d, f"C{c}") for d in range(6) for c in range(d)] + [(1, "C0")] * 5, "doc_id long, cui string")
    docs = frame([(d, d % 2) for d in range(6)], "doc_id long, pid long")
    closure = frame([("A", "C0"), ("A", "C1"), ("B", "C1"), ("B", "C4")], "name string, cui string")
    small = rows(summary.study_counts(mentions, docs, closure))
    monkeypatch.setattr(scale, "is_small", lambda df, *bounds: False)
    assert rows(summary.study_counts(mentions, docs, closure)) == small
    assert (1, "A", 3, 10) in small


# --- search


def test_index_finds_what_a_scan_finds(spark, frame):
    draw = random.Random(11)
    words = ["café", "caf", "über", "was", "from", "x1", "Ünder", "der"]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([0, 4, 30])))) for k in range(80)] + [(90, None), (91, "was! " * 3000 + "from")]
    df = frame(docs, "doc_id long, text string")
    index = search.TextIndex(spark, scale.job_folder(spark, "index"), buckets=7).write(df)
    cases = [
        {"any_of": ["caf", "x1"]}, {"all_of": ["café", "ünder"]}, {"phrases": [("was from", 0), ("der über x1", 2)]},
        {"any_of": ["caf"], "all_of": ["was"], "phrases": [("was was", 1)]}, {"any_of": ["nowhere"]},
    ]
    for case in cases:
        scanned = textmine.text_search(df, **case).select("doc_id", "hits").collect()
        assert sorted(map(tuple, index.search(**case).collect())) == sorted(map(tuple, scanned)), case
    assert 91 in {r.doc_id for r in index.search(phrases=[("was from", 0)]).collect()}
    # "café" does not hold the word "caf"
    only = frame([(1, "café"), (2, "caf é")], "doc_id long, text string")
    assert [r.doc_id for r in textmine.text_search(only, any_of=["caf"]).collect()] == [2]


def test_slop_against_plain_windows(frame):
    draw = random.Random(4)
    rows = [[sorted(draw.sample(range(30), draw.choice([0, 1, 5]))) for _ in range(3)] for _ in range(60)]
    df = frame([(k, *r) for k, r in enumerate(rows)], "k int, a array<int>, b array<int>, c array<int>")
    for slop in (0, 2, 7):
        got = {r.k: r.x for r in df.select("k", search.within_slop([F.col("a"), F.col("b"), F.col("c")], slop).alias("x")).collect()}
        for k, (a, b, c) in enumerate(rows):
            want = any(max(x, y - 1, z - 2) - min(x, y - 1, z - 2) <= slop for x in a for y in b for z in c)
            assert got[k] == want, (rows[k], slop)


def test_only_buckets_of_the_words_are_opened(spark, frame):
    df = frame([(k, f"word{k} common") for k in range(300)], "doc_id long, text string")
    index = search.TextIndex(spark, scale.job_folder(spark, "index")).write(df)
    plan = index.search(any_of=["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert [tuple(r) for r in index.search(any_of=["word7"]).collect()] == [(7, 1)]
    files = index.postings(["word7"]).select(F.input_file_name().alias("file")).distinct()
    assert files.count() == 1


def test_occurrences_end_at_letters_of_any_script(frame):
    df = frame([("pré pr Pr. prx épr", "pr")], "t string, s string")
    assert df.select(tx.occurrences("t", "s")).first()[0] == [4, 7]


def test_a_long_term_gives_rows_for_its_own_first_word_only(frame):
    docs = frame([(1, "of the sea and of the land. zeta eta " + "word " * 60)], "doc_id long, text string")
    short = [("of the", "C1", "s", "p"), ("of", "C2", "s", "p"), ("zeta eta", "C4", "s", "p")]
    long = short + [("zeta " + "word " * 38 + "word", "C3", "s", "p")]
    schema = "term string, cui string, sty string, pref string"
    few, more = (textmine.term_runs(docs, frame(g, schema)).count() for g in (short, long))
    # the two of "of" twice, one of "zeta", and one more for the long term
    assert (few, more) == (5, 6)
    found = textmine.dictionary_annotate(docs, frame(long, schema)).select("cui", "start_pos").collect()
    assert sorted(map(tuple, found)) == [("C1", 0), ("C1", 15), ("C4", 28)]


def test_masks_of_overlapping_spans():
    text = "ab cd ef gh"
    assert deident.masked(text, [(3, 5), (0, 4), (4, 8), (9, 11), (9, 10)]) == "xx xx xx xx"
    assert deident.masked(text, []) == text and deident.masked("a" * 9, [(2, 4), (2, 7), (3, 5)]) == "aaxxxxxaa"


def test_back_off_takes_the_deepest_frequent_node(frame):
    schema = "id int, pattern string, sent_pattern string, signed_label string, gt_label string"
    rows = [(k, "p", "A<-B<-C", "x", "x") for k in range(3)] + [(3, "p", "A<-B<-D", "x", "y"), (4, "p", "A", "x", "-"), (5, "q", "A", "x", "x")]
    instances = frame(rows, schema)
    tree = patterns.pattern_tree(instances, min_freq=3)
    nodes = {(r.depth, r.prefix): (r.n, r.accuracy) for r in tree.collect()}
    assert nodes == {(0, ""): (5, 0.75), (1, "A"): (5, 0.75), (2, "A<-B"): (4, 0.75), (3, "A<-B<-C"): (3, 1.0)}
    asked = frame([(10, "p", "A<-B<-C<-E"), (11, "p", "A<-X"), (12, "p", ""), (13, "q", "A"), (14, "r", "A")], "id int, pattern string, sent_pattern string")
    got = {r.id: (r.depth, r.confidence) for r in patterns.back_off(asked, tree, key=["id"]).collect()}
    assert got == {10: (3, 1.0), 11: (1, 0.75), 12: (0, 0.75), 13: (-1, -1.0), 14: (-1, -1.0)}


def test_all_folds_fitted_at_once_as_one_by_one(frame):
    draw = random.Random(17)
    rows = []
    for k in range(120):
        label = draw.choice(["posM", "negM", "hisM"])
        common = {"posM": "has", "negM": "denies", "hisM": "had"}[label]
        rows.append((k, [common] * draw.randint(0, 2) + [draw.choice("abcdef") for _ in range(draw.randint(0, 5))], label))
    contexts = frame(rows, "id long, tokens array<string>, label string")
    hashed = scale.cut(learn.hashed_contexts(contexts, folds=4, slots=32).repartition(5))
    classes = ["hisM", "negM", "posM"]
    got = learn.fit_folds(hashed, classes, folds=4, slots=32, rounds=6)
    assert np.allclose(got, learn.fit_folds(hashed.coalesce(2), classes, folds=4, slots=32, rounds=6), atol=1e-6)
    # one model after the other, on a dense matrix
    local = hashed.collect()
    x = np.zeros((len(local), 33))
    x[:, -1] = 1
    for k, r in enumerate(local):
        place, count = np.unique(r.slots, return_counts=True)
        place = place.astype(int)
        x[k, place] = 1 + np.log(count)
        x[k, :-1] /= np.linalg.norm(x[k, :-1]) or 1
    y = np.eye(3)[[classes.index(r.label) for r in local]]
    for fold in range(4):
        seen = np.array([r.fold != fold for r in local])
        w, v = np.zeros((3, 33)), 0.0
        for _ in range(6):
            p = np.exp(x[seen] @ w.T)
            p /= p.sum(axis=1, keepdims=True)
            v = 0.8 * v - 4.0 * ((p - y[seen]).T @ x[seen]) / seen.sum()
            w = w + v
        assert np.allclose(got[fold], w, atol=1e-6)
    table = learn.cross_validate(contexts, folds=4, slots=64).collect()
    assert sum(r.n for r in table) == 120 and all(r.accuracy > 0.5 for r in table)
    assert learn.cross_validate(frame([], "id long, tokens array<string>, label string")).count() == 0


def test_sections_of_mentions_by_halving_and_one_by_one(frame):
    draw = random.Random(6)
    apart, at = [], 0
    for k in range(40):
        start = at + draw.randint(0, 3)
        header = start + draw.randint(0, 4)
        at = header + draw.randint(1, 6)
        apart.append((1, f"s{k}", f"S{k}", header, start, at))
    nested = [(2, "a", "A", 2, 0, 50), (2, "b", "B", 12, 10, 20), (2, "c", "C", 22, 20, 90)]
    schema = "doc_id long, section string, original_section string, header_end long, start long, end long"
    mentions = [(doc, pos) for doc in (1, 2, 3) for pos in range(0, at + 5)]
    got = joins.mentions_in_sections(frame(mentions, "doc_id long, start_pos long"), frame(apart + nested, schema))
    want = []
    for doc, pos in mentions:
        held = [x[1] for x in sorted(apart + nested, key=lambda x: x[4]) if x[0] == doc and x[3] <= pos < x[5]]
        want += [(doc, pos, held[0])] if held else []
    assert sorted(tuple(r) for r in got.select("doc_id", "start_pos", "section").collect()) == sorted(want)


def test_sentences_of_odd_texts_keep_their_offsets(spark, frame):
    draw = random.Random(3)
    texts = ["", "...", " \n\t.", "ab. " * 127, "ab. " * 128 + " . ", "ab. " * 300, "a " * 200 + "\n" * 500]
    texts += ["".join(draw.choice("aé日 .\n\t\x0b\x0c\r\x1c\x85\xa0") for _ in range(draw.randrange(60))) for _ in range(300)]
    got = frame(list(enumerate(texts)) + [(-1, None)], "id int, text string").select("id", tx.sentence_spans("text").alias("s"), tx.word_spans("text").alias("w"))
    for r in got.collect():
        text = texts[r.id] if r.id >= 0 else ""
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^.\n \t\x0b\x0c\r][^.\n]*\.?", text)]
        assert [tuple(x) for x in r.s] == want
        assert [tuple(x) for x in r.w] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", text)]


def test_words_are_worked_out_for_the_asked_sentences_only(spark, frame):
    docs = frame([(1, "One of two. - . Three of four."), (2, "Five"), (1, "One of two")], "doc_id long, text string")
    tags = frame([("of", "ADP")], "token string, tag string")
    only = frame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, sent_no int")
    tagged = patterns.tagged_sentences(docs, tags, only=only)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    # not in a filter, which stands before the join
    filters_of_plan = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter ")]
    assert filters_of_plan and not any("split(" in line for line in filters_of_plan)
    got = {(r.doc_id, r.sent_no): (r.toks, r.tags, r.run_tags, r.run_starts) for r in tagged.collect()}
    n, a = "NOUN", "ADP"
    assert got == {
        (1, 0): (["One", "One", "of", "of", "two", "two"], [n, n, a, a, n, n], [n, a, n], [0, 2, 4]),
        (2, 0): (["Five"], [n], [n], [0]),
    }


def test_a_sentence_without_a_first_word_is_not_taken_apart(frame):
    docs = frame([(1, "Soft OF THE. Nothing here. Kelvin of"), (2, None)], "doc_id long, text string")
    schema = "term string, cui string, sty string, pref string"
    hits = textmine.dictionary_annotate(docs, frame([("of the", "C1", "", ""), ("of", "C2", "", ""), ("kelvin", "C3", "", "")], schema))
    assert sorted((r.cui, r.start_pos) for r in hits.collect()) == [("C1", 5), ("C2", 34), ("C3", 27)]
    runs = textmine.term_runs(docs, frame([("of", "C2", "", "")], schema))
    assert "Contains(lower(" in runs._jdf.queryExecution().optimizedPlan().toString()
