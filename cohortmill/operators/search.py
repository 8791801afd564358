"""A positional inverted index over texts: searches read the postings of their words and no text.

A posting holds the sorted positions of one word in one document. Postings are dealt into ``buckets`` folders by the hash of the word, and
within a bucket sorted by word, so a search opens the folders of its words only and skips the row groups of others. The writer splits a
bucket with a very frequent word over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cohortmill.functions import text as tx


def within_slop(positions: Sequence[Column], slop: int) -> Column:
    """Whether the sorted position arrays of the words of a phrase have one position each, less its place in the phrase, within ``slop``.

    The arrays are merged and walked once from the end, with the next position of each word as state.
    """
    if not positions:
        return F.lit(False)

    def marks(places: Column, word: int) -> Column:
        return F.transform(places, lambda x: F.struct((x.cast("int") - word).alias("at"), F.lit(word).alias("word")))

    marked = [marks(p, i) for i, p in enumerate(positions)]
    none = F.array(*(F.lit(None).cast("int") for _ in positions))
    # equal positions share a window whichever comes first, so the greater words are taken first
    order = F.reverse(F.array_sort(F.concat(*marked)))

    def step(state: Column, mark: Column) -> Column:
        following = F.transform(state["following"], lambda x, i: F.when(i == mark["word"], mark["at"]).otherwise(x))
        return tx.let(
            following,
            lambda now: F.struct(
                now.alias("following"),
                (state["found"] | (F.forall(now, lambda x: F.coalesce(x <= mark["at"] + slop, F.lit(False))))).alias("found"),
            ),
        )

    walked = F.aggregate(order, F.struct(none.alias("following"), F.lit(False).alias("found")), step, lambda s: s["found"])
    # a document without one of the words is not walked at all
    every = F.lit(True)
    for p in positions:
        every = every & (F.size(p) > 0)
    return F.when(every, walked).otherwise(False)


def asked_words(any_of: Sequence[str], all_of: Sequence[str], phrases: Sequence[tuple[str, int]]) -> list[str]:
    """All words of a search, in lower case, each once."""
    split = [w for phrase, _ in phrases for w in phrase.lower().split()]
    return sorted({*any_of, *all_of, *split})


def matches(
    positions: dict[str, Column], any_of: Sequence[str], all_of: Sequence[str], phrases: Sequence[tuple[str, int]]
) -> Column:
    """Whether a document with these positions has any of the words, all of the words, and any of the phrases."""
    match = F.lit(True)
    if any_of:
        match = match & F.exists(F.array(*(F.size(positions[w]) for w in any_of)), lambda n: n > 0)
    for word in all_of:
        match = match & (F.size(positions[word]) > 0)
    if phrases:
        near = F.lit(False)
        for phrase, slop in phrases:
            near = near | within_slop([positions[w] for w in phrase.lower().split()], slop)
        match = match & near
    return match


@dataclass(frozen=True)
class TextIndex:
    """Postings ``token, doc, positions`` below ``path``; ``doc`` has the type of the key it was written with."""

    spark: SparkSession
    path: str
    buckets: int = 256

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> TextIndex:
        """Index the words of all texts, of any script, in lower case."""
        rows = docs.select(F.col(key).alias("doc"), tx.words(text_col).alias("words"))
        postings = rows.mapInArrow(_postings, StructType([
            rows.schema["doc"], StructField("token", StringType()), StructField("positions", ArrayType(IntegerType())),
        ]))
        dealt = postings.withColumn("bucket", self._bucket(F.col("token"))).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        return self

    def postings(self, words: Sequence[str]) -> DataFrame:
        """Postings of some words; only their buckets are opened."""
        found = self.spark.read.parquet(self.path)
        if not words:
            return found.where("false").drop("bucket")
        buckets = F.col("bucket").isin(*(self._bucket(F.lit(w)) for w in words))
        return found.where(buckets & F.col("token").isin(*words)).drop("bucket")

    def search(
        self, *, any_of: Sequence[str] = (), all_of: Sequence[str] = (), phrases: Sequence[tuple[str, int]] = (), key: str = "doc_id"
    ) -> DataFrame:
        """``key, hits``: documents with any of the words, all of the words, and any of the (phrase, slop) pairs.

        ``hits`` counts the occurrences of the asked words. A document has one posting a word, so its group is as small as the search.
        """
        words = asked_words(any_of, all_of, phrases)
        per_doc = self.postings(words).groupBy(F.col("doc").alias(key)).agg(
            F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("found")
        )
        empty = F.array().cast("array<int>")
        per_doc = per_doc.withColumns({f"_{i}": F.coalesce(F.try_element_at("found", F.lit(w)), empty) for i, w in enumerate(words)})
        positions = {w: F.col(f"_{i}") for i, w in enumerate(words)}
        hits = sum((F.size(p) for p in positions.values()), F.lit(0))
        return per_doc.where(matches(positions, any_of, all_of, phrases)).select(key, hits.alias("hits"))


# words worked on at once
SLICE_WORDS = 500_000


def _slices(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """First and next row of stretches of at most SLICE_WORDS words, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        stop = max(int(np.searchsorted(ends, done + SLICE_WORDS, side="right")), first + 1)
        yield first, stop
        first = stop


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and word with its positions.

    Words stay in Arrow: they are numbered, and one sort by row and number brings the positions of a posting together. What a task
    holds is bounded by SLICE_WORDS and the longest text, not by the rows of a batch.
    """
    for batch in batches:
        every = batch.column("words")
        for first, stop in _slices(every):
            words = every.slice(first, stop - first)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            coded = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pair = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(pair, kind="stable")
            begins = np.flatnonzero(np.diff(pair[order], prepend=-1))
            heads = order[begins]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(row[heads] + first)),
                    coded.dictionary.take(pa.array(coded.indices.to_numpy()[heads])),
                    pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), pa.array(place[order], pa.int32())),
                ],
                names=["doc", "token", "positions"],
            )
