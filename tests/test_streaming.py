"""The keyed store, the processing of new documents, and streams that keep their state."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.catalog import events
from cohortmill.sources.tables import Tables
from cohortmill.streaming import incremental
from cohortmill.streaming.processing import Processing
from cohortmill.streaming.store import KeyedStore, part_of, sources_of

SCHEMA = "pid long, value long"


def test_parts_split_one_by_one(frame):
    rows = frame([(k, k) for k in range(500)], SCHEMA)
    before = None
    for parts in range(1, 20):
        now = {r.pid: r.part for r in rows.select("pid", part_of("pid", parts).alias("part")).collect()}
        assert set(now.values()) <= set(range(parts))
        if before:
            left = {before[k] for k in now if now[k] != before[k]}
            assert left <= sources_of(parts - 1, parts) and {now[k] for k in now if now[k] != before[k]} <= {parts - 1}
        before = now
    assert sources_of(1, 8) == {0} and sources_of(4, 6) == {0, 1} and sources_of(5, 5) == set()


@pytest.fixture
def store(spark, frame):
    return KeyedStore(spark, scale.job_folder(spark, "store"), frame([], SCHEMA).schema, "pid", part_rows=100, max_files=4)


def test_rows_read_stay_flat_while_the_store_grows(store, frame):
    draw = random.Random(1)
    everything, read = [], []
    for n in range(20):
        # fifteen new keys and five old ones
        keys = [100 * n + k for k in range(15)] + [100 * draw.randrange(n + 1) + draw.randrange(15) for _ in range(5)]
        batch = [(k, draw.randrange(1000)) for k in keys for _ in range(4)]
        everything += batch
        store.commit(n, frame(batch, SCHEMA))
        wanted = frame([(k,) for k in set(keys[-6:])], "pid long")
        read.append(store.touched(n, wanted).agg(F.sum("rows")).first()[0])
        if n % 5 == 4:
            got = sorted(map(tuple, store.read(n, wanted).collect()))
            assert got == sorted(r for r in everything if r[0] in set(keys[-6:]))
    assert sorted(map(tuple, store.read(19).collect())) == sorted(everything)
    listed = store.listed(19).collect()
    assert listed[0].parts == 16 and max(sum(r.rows for r in listed if r.part == p) for p in range(16)) < 400
    per_part = store.listed(19).groupBy("part").count().agg(F.max("count")).first()[0]
    assert per_part <= store.max_files + 1
    # six keys: at most so many parts of their usual size, however long the history
    assert max(read[10:]) <= 6 * 250 and sum(read[15:]) < 1.6 * sum(read[5:10])
    assert store.drop_old(19) > 0
    assert sorted(map(tuple, store.read(19).collect())) == sorted(everything)


def test_a_repeated_batch_replaces_itself(store, frame):
    store.commit(0, frame([(k, 0) for k in range(150)], SCHEMA))
    store.commit(1, frame([(1, 99)], SCHEMA))
    store.commit(1, frame([(1, 1), (2, 2)], SCHEMA))
    store.commit(2, frame([], SCHEMA))
    assert store.read(2).count() == 152 and store.read(2, frame([(1,)], "pid long")).count() == 2


def test_a_hot_key_does_not_stop_the_others(store, frame):
    store.commit(0, frame([(7, k) for k in range(3000)] + [(k, 0) for k in range(100)], SCHEMA))
    assert store.read(0, frame([(7,)], "pid long")).count() == 3001
    assert store.touched(0, frame([(3,), (4,)], "pid long")).count() <= 2


def job(spark, frame, before_log=None):
    return Processing(
        path=scale.job_folder(spark, "job"),
        annotate=lambda docs: docs.select("doc_id", "pid", F.explode(F.split("text", " ")).alias("word")),
        judge=lambda mentions, docs: mentions.withColumn("ruled_by", F.when(F.length("word") > 1, "long")),
        summarise=lambda rows: rows.groupBy("pid").agg(F.count("*").alias("n"), F.count("ruled_by").alias("out")),
        schema=frame([], "pid long, doc_id long, word string, ruled_by string").schema,
        part_rows=3,
        before_log=before_log,
    )


def test_ranges_go_on_behind_the_last_mark(spark, frame):
    docs = frame([(k, k % 3, "a bb" if k % 2 else "c") for k in range(12)], "doc_id long, pid long, text string")
    work = job(spark, frame)
    assert work.log(spark).last() == (-1, None)
    for high in (4, 4, 9, 11, 11):
        work.run(docs.where(F.col("doc_id") <= high))
    entries = sorted(map(tuple, work.log(spark).entries().collect()))
    assert entries == [(0, "4", 5, 7, 3), (1, "9", 5, 8, 3), (2, "11", 2, 3, 2)]
    want = {(p, sum(1 + k % 2 for k in range(12) if k % 3 == p), sum(k % 2 for k in range(12) if k % 3 == p)) for p in range(3)}
    assert {tuple(r) for r in work.summary(spark).collect()} == want


def test_a_failed_range_is_taken_again(spark, frame):
    broken = [1]

    def refuse(n):
        if n in broken:
            broken.remove(n)
            raise RuntimeError("lost")

    docs = frame([(k, k % 2, "a bb") for k in range(6)], "doc_id long, pid long, text string")
    work = job(spark, frame, refuse)
    work.run(docs.where("doc_id < 3"))
    with pytest.raises(RuntimeError):
        work.run(docs)
    assert work.log(spark).last() == (0, "2")
    assert work.run(docs) and not work.run(docs)
    assert {tuple(r) for r in work.summary(spark).collect()} == {(0, 6, 3), (1, 6, 3)}
    # a batch that is in the log already is not processed again
    work.batch(docs, 1)
    assert work.log(spark).entries().count() == 2


def test_known_concepts_are_state_of_the_stream(spark, frame):
    folder, sink, checkpoint = (scale.job_folder(spark, name) for name in ("in", "out", "check"))
    schema = "ctx_id string, n long"
    for k in range(3):
        frame([("a", k), ("b", k), (f"c{k}", k)], schema).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        stream = incremental.read_new(spark, folder, frame([], schema).schema, files_per_batch=1)
        incremental.stream_ctx_concepts(stream, sink, checkpoint)
    assert sorted(r.ctx_id for r in spark.read.parquet(sink).collect()) == ["a", "b", "c0", "c1", "c2"]
    state = spark.read.format("statestore").load(checkpoint)
    assert state.count() == 5


@pytest.fixture
def few_documents(spark, frame, tmp_path, monkeypatch):
    """Tables of documents that are dealt to all batches, which are logged but not annotated here; ``Processing.lost`` are not logged."""

    def batch(self, docs, n):
        if n in self.broken:
            raise OSError(f"batch {n} is lost")
        if n > self.log(spark).last()[0]:
            self.before_log(n)
            counted = docs.groupBy("pid").agg(F.count("*").alias("docs"))
            counted.write.mode("overwrite").parquet(incremental.batch_folder(f"{self.path}/summary", n))
            if n not in self.lost:
                self.log(spark).add((n, str(n), docs.count(), 0, 0))

    monkeypatch.setattr(Processing, "batch", batch)
    monkeypatch.setattr(Processing, "broken", (), raising=False)
    monkeypatch.setattr(Processing, "lost", (), raising=False)
    rows = [(k, f"s{k}", "en", "of the thatin", 13) for k in range(40)]
    frame(rows, "doc_id long, source string, lang string, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return Tables(spark, str(tmp_path))


def test_the_planned_failure_leaves_a_whole_summary(few_documents):
    assert sorted(r.pid for r in events.incremental_run(few_documents).collect()) == sorted(f"s{k}" for k in range(40))


@pytest.mark.parametrize("at", [1, 4])
def test_another_failure_is_no_result(few_documents, monkeypatch, at):
    # batch 4 comes in the second run, behind the planned failure
    monkeypatch.setattr(Processing, "broken", (at,))
    with pytest.raises(StreamingQueryException, match=f"batch {at} is lost"):
        events.incremental_run(few_documents)


def test_documents_that_no_batch_has_logged_are_no_result(few_documents, monkeypatch):
    monkeypatch.setattr(Processing, "lost", (5,))
    with pytest.raises(RuntimeError, match="documents were processed"):
        events.incremental_run(few_documents)
