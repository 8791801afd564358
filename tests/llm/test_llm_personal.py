"""Personal data against a plain version, the SQL and texts worked out by hand."""

import hashlib
import random
import re

import duckdb
import pandas as pd

from cohortmill.llm import personal

TEXTS = [
    "", "x" * 30000, "1" * 30000, "a.b@c.d%e@f.g.h@i.j-k",
    "iban DE89 3704 0044 0532 0130 00 GB29NWBK60161331926819 ok",
    "1.2.3.4.5.6.7.8 0.0.0.256 007.1.1.1 1..2.3.4",
    "ssn 123-45-6789 and 1123-45-6789 \u00e9 4111 1111 1111 1111 +49 (30) 1234-567",
    "7536784127813050 4845168114407329", "x 5\nDE89370400440532013000", "\U0001f600 a@b.c +", None,
]
FRAGMENTS = [
    "a@b.c", "@", ".", "+1 ", "4111111111111111", " ", "-", "192.168.0.1", "5", "x", "\u00e9", "378282246310005", "\n", "(", ")", "%",
    "mail", "DE89370400440532013000", "123-45-6789", "ssn",
]


def plain(text):
    def luhn(d):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return [
        f"{kind}:{start}:{end}"
        for start, _, end, kind in sorted(
            (m.start(), rank, m.end(), kind)
            for rank, (kind, pattern, good) in enumerate(kinds)
            for m in re.finditer(pattern, text)
            if good(m[0])
        )
    ]


def cases():
    draw = random.Random(3)
    return TEXTS + ["".join(draw.choice(FRAGMENTS) for _ in range(draw.randint(1, 25))) for _ in range(400)]


def test_basic_spans_against_plain_version_and_sql(frame):
    texts = cases()
    df = frame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in personal.personal_digest(df).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        want = plain(text or "")
        assert rows[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(rows[k].spans.split(","))
        assert rows[k].n_email + rows[k].n_ip + rows[k].n_card + rows[k].n_phone == len(want)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    said = con.execute(personal.SQL).fetchall()
    assert sorted(map(tuple, rows.values())) == sorted(said)


def test_checksums_and_context_decide_on_added_spans(frame):
    df = frame(list(enumerate(TEXTS)), "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in personal.personal_digest(df).collect()}
    assert spans[4] == "iban:5:32,iban:33:55"
    # the social security number needs a word that says so; its longer neighbour is none
    assert spans[6] == "ssn:4:15,card:35:54,phone:55:72"
    # two cards that a single proposal joined
    assert spans[7] == "card:0:16,card:17:33"
    no_word = frame([(1, "see 123-45-6789"), (2, "DE88370400440532013000")], "doc_id int, text string")
    assert [r.spans for r in personal.personal_digest(no_word).collect()] == ["", ""]


def test_masked_texts(frame):
    df = frame([(k, t, 7) for k, t in enumerate(TEXTS)], "doc_id int, text string, spans int")
    rows = {r.doc_id: r for r in personal.masked(df).collect()}
    assert rows[4].text == "iban [iban] [iban] ok" and rows[4].spans == 7
    assert rows[6].text == "ssn [ssn] and 1123-45-6789 \u00e9 [card] [phone]"
    assert rows[7].text == "[card] [card]"
    assert rows[10].text is None and rows[1].text == TEXTS[1]


def test_awkward_tables(frame):
    empty = frame([], "doc_id int, text string")
    assert personal.personal_digest(empty).count() == 0 and personal.masked(empty).count() == 0
    clash = frame([(None, "a@b.c", 1, "x"), (None, "a@b.c", 1, "x"), (1, None, 2, "y")], "doc_id int, text string, n_email int, _ip string")
    rows = personal.personal_digest(clash).collect()
    assert sorted(r.n_email for r in rows) == [0, 1, 1]


def test_many_spans_in_a_long_text(frame):
    text = "a@b.c 1.2.3.4 " * 20000
    row = personal.personal_digest(frame([(1, text)], "doc_id int, text string")).first()
    assert (row.n_email, row.n_ip) == (20000, 20000)
    assert row.base_sha256 == hashlib.sha256(",".join(plain(text)).encode()).hexdigest()
