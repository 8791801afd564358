"""Periodic runs against a plain search, the SQL, and the transform against plain correlation."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from cohortmill.llm import periods


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(draw):
    letters = draw.choice(["a", "ab", "abcde", "abcdefghijklmnopqrstuvwxyz"])
    out = []
    while len(out) < draw.choice([0, 5, 40, 300]):
        root = [draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 5, 9, 33]))]
        out += root * draw.choice([1, 2, 4, 7]) + root[: draw.randint(0, len(root))]
    return [w.encode() for w in out]


@pytest.mark.parametrize("size", [2, 4, 16, 256])
def test_transform_gives_correlations(size):
    draw = np.random.default_rng(size)
    a = draw.integers(0, periods.PRIME, (3, size // 2))
    b = draw.integers(0, periods.PRIME, (3, size))
    t = periods.Transform(size)
    own = periods.folded(periods.folded(t.padded(a)))[:, t.mirror]
    whole = t.padded(b[:, : size // 2]) + 0
    rest = t.padded(b[:, size // 2 :])
    half = size // 2
    window = np.concatenate([whole[:, :half] + rest[:, :half], whole[:, half:] - rest[:, half:]], axis=1)
    got = t.back(own * periods.folded(periods.folded(window)))[:, :half] % periods.PRIME
    want = [[sum(int(x) * int(y) for x, y in zip(a[r], b[r, k:], strict=False)) % periods.PRIME for k in range(half)] for r in range(3)]
    assert got.tolist() == want


@pytest.mark.parametrize("widest", [4, 1 << 15])
def test_runs_against_plain_search(monkeypatch, widest):
    monkeypatch.setattr(periods, "WIDEST", widest)
    draw = random.Random(12)
    for _ in range(30):
        batch = [words_of(draw) for _ in range(draw.randint(1, 12))]
        for words, (runs, places) in zip(batch, periods.runs_of(batch), strict=True):
            assert runs == plain_runs(words)
            assert places.tolist() == list(range(len(words)))


def test_neighbouring_texts_do_not_share_a_run():
    assert [r for r, _ in periods.runs_of([[b"a"] * 5, [b"a"] * 5, [b"a"] * 6])] == [[], [], [(0, 6, 1)]]


def test_long_texts(monkeypatch):
    draw = random.Random(5)
    root = [str(draw.randrange(50)).encode() for _ in range(9000)]
    words = [b"x"] * 20000 + root * 4 + [b"y"] + [b"a", b"b"] * 9000
    (runs, _), = periods.runs_of([words])
    assert {(s, n) for s, n, q in runs if q in (1, 9000)} >= {(0, 20000)}
    assert any(q == 9000 and n >= 36000 for _, n, q in runs) and (56001, 18000, 2) in runs


def test_digest_against_sql_and_plain_version(frame):
    draw = random.Random(7)
    docs = [(k, " ".join(w.decode() for w in words_of(draw))) for k in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a\x0ba\x0ca a\u00a0b a a a a a a"), (-5, "na " * 40), (2**62, "b c " * 9)]
    df = frame(docs, "doc_id long, text string")
    rows = sorted(map(tuple, periods.period_digest(df).collect()))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    names = ["doc_id", *(f.name for f in periods.FIELDS)]
    assert rows == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({periods.SQL})").fetchall())
    n_planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n_planted += 1
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        row = next(r for r in rows if r[0] == doc_id)
        assert row[1] == len(runs)
        assert row[6] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row[7] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert n_planted > 5


def test_general_forms_and_awkward_tables(frame):
    df = frame([(1, "x a b a b a b a b y", 1), (None, None, 2), (2, "c  d", 3), (2, "c  d", 3)], "doc_id int, text string, runs int")
    assert {(r.doc_id, r.text, r.runs) for r in periods.collapsed(df).collect()} == {(1, "x a b y", 1), (None, None, 2), (2, "c  d", 3)}
    rows = periods.periodic_runs(df).collect()
    assert [[tuple(x) for x in r.runs] for r in rows if r.doc_id == 1] == [[(1, 8, 2)]] and len(rows) == 4
    assert periods.period_digest(df).count() == 4
    assert periods.period_digest(frame([], "doc_id int, text string")).count() == 0
