"""The divergence audit against the SQL and plain integers, and its tree on its own."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortmill.llm import divergence


def documents():
    draw = random.Random(13)
    rows = []
    for k in range(260):
        lang = draw.choice(["en", "de", None, ""])
        source = draw.choice([f"s{j}" for j in range(11)] + [None, "ü"])
        words = [draw.choice(["a", "B", "cc", "é", "É", "d1x", "k_y", "K"]) + draw.choice("xyz") * draw.randint(0, 3) for _ in range(draw.choice([0, 3, 60]))]
        rows.append((k, draw.choice([None, "", " ".join(words), "-".join(words)]), lang, source))
    # a language without kept terms, one with a single source, and equal rows
    rows += [(900, "rare words", "xx", "s1"), (901, "other ones", "xx", "s2"), (902, "b b b", "yy", "s1")] + [(903, "b c", "zz", "s1")] * 3
    return rows


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            c = c.lower()
        if "a" <= c <= "z" or ord(c) >= 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain(rows):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = set()
    for lang, source in groups:
        kept = [t for t, c in docs[lang].items() if c >= 3]
        price = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        whole = sum((n[g] for g in groups if g[0] == lang), Counter())
        p, q = price(n[lang, source]), price(whole)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            r = price(n[lang, other])
            pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def test_audit_against_plain_version_and_sql(frame):
    rows = documents()
    df = frame(rows, "doc_id int, text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS term", "3 AS total")
    got = divergence.audit(df).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len(plain(rows))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    assert sorted(map(tuple, got)) == sorted(con.execute(divergence.SQL).fetchall())


def test_small_tiles_give_the_same_pairs(frame):
    df = frame(documents(), "doc_id int, text string, lang string, source string")
    tables = divergence.Audit(df)
    assert sorted(map(tuple, tables.pairs().collect())) == sorted(map(tuple, tables.pairs(side=3).collect()))


def test_empty_table(frame):
    assert divergence.audit(frame([], "doc_id int, text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("frontier", [1, 7, 1 << 19])
def test_tree_meets_all_pairs_of_a_column(frontier):
    draw = np.random.default_rng(1)
    for depth in (1, 3, 6):
        cells = np.unique(draw.integers(0, 2**depth, (40 * depth, 2)), axis=0)
        tree = divergence.QuadTree(cells[:, 0], cells[:, 1], depth)
        rows, columns = cells[tree.order, 0], cells[tree.order, 1]
        got = [(min(rows[x], rows[y]), max(rows[x], rows[y]), columns[x]) for a, b in tree.shared(frontier) for x, y in zip(a, b, strict=True)]
        assert all(columns[x] == columns[y] for a, b in tree.shared(frontier) for x, y in zip(a, b, strict=True))
        by_column = defaultdict(list)
        for r, c in cells:
            by_column[c].append(r)
        want = [(a, b, c) for c, rs in by_column.items() for a in rs for b in rs if a < b]
        assert sorted(got) == sorted(want)
        # nothing stands below an all-zero quadrant
        assert [len(x) for x in tree.children] == [1, *((level >= 0).sum() for level in tree.children[:-1])]


def test_prices_of_large_counts_are_exact():
    n, total = np.array([0, 3 * 10**14, 9 * 10**15 - 2]), np.array([7, 10**15 + 3, 9 * 10**15])
    assert divergence.prices(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]
