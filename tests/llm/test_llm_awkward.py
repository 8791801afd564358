"""Every operator and stage over awkward rows: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import pytest

import corpus_pipeline
from cohortmill.llm import chat, decontaminate, language, licenses, mixing, nearcopies, neighbours, quality, repeats, secrets

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean, "
    "component_id long, size long, place long, target double, mark string, `odd name` string"
)
EXTRA = (1, 0.5, True, 2, 3, 4, 5.0, "m", "o")
LONG = "der lange text mit vielen worten " * 20_000
PROSE = "the quick brown fox jumps over the lazy dog and runs into the deep wood near the old mill"


def rows():
    plain = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, " \n\t ", "de", "b"),
        (6, "12 34 !!", "de", "b"),
        (7, LONG, "de", "c"),
        (None, "ein text ohne nummer aber mit worten", "de", "c"),
        (None, "ein text ohne nummer aber mit worten", "de", "c"),
        (8, "ünïcode ſ K İ 😀 password = 'abcdefghijkl😀'", None, "😀"),
        (9, "le chat est sur la table", "fr", None),
        (None, None, None, None),
    ]
    return [(i, t, g, s, None if t is None else len(t), *EXTRA) for i, t, g, s in plain]


@pytest.fixture
def docs(frame):
    return frame(rows(), SCHEMA)


@pytest.fixture
def none(frame):
    return frame([], SCHEMA)


BENCH = "item_id long, text string, extra string"
DIGESTS = {
    "secrets": lambda d, b: secrets.secrets(d),
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "quality": lambda d, b: quality.quality(d),
    "repeats": lambda d, b: repeats.repeat_digest(d),
    "mixing": lambda d, b: mixing.mixture(d),
    "nearcopies": lambda d, b: nearcopies.near_digest(d),
    "licenses": lambda d, b: licenses.license_digest(d),
    "language": lambda d, b: language.languages(d),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_one_row_per_row(docs, none, frame, name):
    bench = frame([(1, "jumps over the lazy dog", "x"), (None, None, None), (2, "", "x")], BENCH)
    out = DIGESTS[name](docs, bench)
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids == sorted((r[0] for r in rows()), key=str)
    empty = DIGESTS[name](none, frame([], BENCH))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, docs, none, tmp_path, frame, k):
    frame([(1, "nothing of this stands there", "x")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    last = k == len(corpus_pipeline.STAGES) - 1
    assert out.columns == docs.columns + ["epoch"] * last
    assert out.count() > 0
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_equal_rows_leave_one(docs):
    out = [(r.doc_id, r.text) for r in nearcopies.deduplicated(docs).collect()]
    assert out.count((1, PROSE)) == 1 and (2, PROSE) not in out
    assert sum(t == "ein text ohne nummer aber mit worten" for _, t in out) == 1
    assert sum(t is None or not t.strip() for _, t in out) == 4


def test_defined_values(docs):
    said = {r.doc_id: r for r in language.languages(docs).collect()}
    assert said[3].lang_pred == said[4].lang_pred == said[6].lang_pred == "und" and said[3].score == 0
    words = {r.doc_id: r for r in licenses.license_digest(docs).collect()}
    assert words[3].n_words == words[5].n_words == 0 and words[3].first_word is None and words[3].labels == ""
    sizes = {r.doc_id: r for r in mixing.mixture(docs).collect()}
    assert sizes[3].size == 0 and sizes[3].taken == 0 and sizes[7].size == 120_000
    near = {r.doc_id: r for r in nearcopies.near_digest(docs).collect() if r.doc_id}
    assert near[3].n_shingles == near[5].n_shingles == 0 and near[5].component_id == 5 and near[2].component_id == 1


def test_vectors(frame, none):
    schema = "vec_id long, embedding array<float>, rank int, score double"
    good = [(k, [float(k % 7), 1.0, float(k)], 1, 1.0) for k in range(50)]
    bad = [
        (60, None, 1, 1.0),
        (80, [0.0, 0.0, 0.0], 1, 1.0),
        (61, [1.0, None, 1.0], 1, 1.0),
        (62, [1.0, float("nan"), 1.0], 1, 1.0),
        (63, [1.0, float("inf"), 1.0], 1, 1.0),
        (64, [1.0], 1, 1.0),
        (None, [1.0, 1.0, 1.0], 1, 1.0),
    ]
    out = neighbours.search(frame(good + bad + good[:3], schema)).collect()
    assert {r.query_id for r in out} == {0, 20, 40}
    assert all(r.vec_id < 50 and r.vec_id != r.query_id for r in out)
    first = sorted(r.rank for r in out if r.query_id == 20)
    assert first == list(range(1, 21))
    few = neighbours.search(frame(good[:3], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(frame([], schema)).count() == 0
    assert neighbours.search(frame(bad, schema)).count() == 0


def test_chat_rows(frame):
    schema = "conv_id long, turn int, role string, text string, n_turns long"
    rows = [
        (1, 0, "user", None, 1),
        (1, 1, "assistant", "a<|im_end|>\n\\<|x|>", 1),
        (1, 1, "assistant", "a<|im_end|>\n\\<|x|>", 1),
        (None, None, None, None, None),
        (2, None, "ro\nle", "", 1),
    ]
    out = {r.conv_id: r for r in chat.chat_digest(frame(rows, schema)).collect()}
    assert set(out) == {1, 2, None, -1}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 * len(rows[1][3])
    assert [r.conv_id for r in chat.chat_digest(frame([], schema)).collect()] == [-1]


def test_records_that_are_no_conversation(frame):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, "x"]}',
        '{"messages": [{"role": ["user"], "content": {"k": 1}}]}',
        '{"messages": [{"role": "user", "content": ' + "[" * 100_000 + "]" * 100_000 + "}]}",
        "[[1]]", "5", "no json", None, '{"messages": []}',
    ]
    rows = chat.json_turns(frame(list(enumerate(records)), "k int, record string"), "k", "record").collect()
    turns = {k: [(r.turn, r.role, r.text) for r in rows if r.k == k] for k in range(len(records))}
    assert turns[0] == [(None, None, None)] and turns[2] == [(None, None, None)]
    assert all(turns[k] == [(None, None, None)] for k in (3, 4, 5, 6, 7))
    assert turns[1] in ([(0, '["user"]', '{"k": 1}')], [(None, None, None)])
