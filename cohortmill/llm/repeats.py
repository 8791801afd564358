"""Suffix-array deduplication: byte strings of a length L that start more than once, over all documents.

In suffix order, the suffixes that share their first L bytes stand in one run. The longest previous factor of a position
reaches L if and only if the previous or next smaller position in suffix order lies in its run, that is, if the position is not
the smallest of the run. Those positions are later copies, the smallest one is the first copy. As only factors of L bytes and more count,
the order between runs does not matter, and runs are told apart by 128-bit fingerprints of L bytes.

No suffix array of everything is built. Every L-byte window picks an anchor, the k-gram in it with the least hash; equal
windows pick equal anchors at equal places. The windows of one anchor in a row are a unit. Documents travel in packets of bounded size, and two rounds of requests
settle all windows:

1. Units ask by anchor and by fingerprint of all the bytes they cover. A unit whose bytes stand elsewhere, too, is a copy as a whole.
   A unit whose anchor stands nowhere else has no copies at all.
2. What is left, units that share an anchor but not all bytes (one for each class of equal units), asks window by window.

A packet asks once for each distinct key, so a string that stands in a third of all documents is one row per packet; for an anchor
with many surroundings in a packet only ``SURROUNDINGS`` of them ask in the first round, the others go to the second. Nothing is capped: what
is not settled in the first round is settled in the second.

Defined results: null and empty texts have no bytes and no removed runs. Texts shorter than L have no windows. A repeated row is a document
of its own, so it is a copy. Matches never cross documents. Positions are ordered by packet, then by place. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from cohortmill.llm.hashing import U64, Hashes, mixed
from cohortmill.scale import cut

LENGTH = 200
#: Bytes of the k-grams that may be anchors.
ANCHOR = 64
#: Window starts that are worked on at once.
PIECE = 1 << 19
#: Surroundings of one anchor for which a packet asks in the first round; two or more show that there are several.
SURROUNDINGS = 8
#: Bytes of text for each bucket of the two rounds, some 400,000 keys.
BUCKET_BYTES = (24 << 20, 8 << 20)

COPY, LATER, MIXED = 1, 2, 4


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, from minima up to and from block borders."""
    count = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, 2**64 - 1, U64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


class Packet:
    """The units of a packet of documents: window starts [start, end), anchor and fingerprint of all their bytes."""

    def __init__(self, data: bytes, sizes: Sequence[int], length: int):
        self.data = np.frombuffer(data, np.uint8)
        self.length = length
        self.ends = np.cumsum(np.asarray(sizes, np.int64))
        found = [self._units(at) for at in range(0, max(0, len(self.data) - length + 1), PIECE)]
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        self.start, self.end, self.anchor, self.bytes = (
            np.concatenate(x) for x in (zip(*found, strict=True) if found else ((e,) for e in empty))
        )

    def piece(self, at: int) -> np.ndarray:
        return self.data[at : at + PIECE + self.length - 1]

    def _units(self, at: int) -> tuple[np.ndarray, ...]:
        data, length = self.piece(at), self.length
        k = min(ANCHOR, length)
        hashes = Hashes(data, 0)
        places = np.arange(len(data) - k + 1)
        grams = hashes.of(places, places + k)
        # the place decides between equal hashes, in equal windows alike
        keys = (grams & U64(0xFFFFFFFF00000000)) | places.astype(U64)
        anchors = (least(keys, length - k + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        starts = np.arange(len(anchors))
        document = np.searchsorted(self.ends, starts + at, side="right")
        inside = starts + at + length <= self.ends[np.minimum(document, len(self.ends) - 1)]
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (document[1:] != document[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchors))
        first, last = first[inside[first]], last[inside[first]]
        shape = mixed((anchors[first] - first).astype(U64) * U64(1 << 20) + (last - first).astype(U64))
        whole = mixed(hashes.of(first, last - 1 + length) + shape)
        return first + at, last + at, grams[anchors[first]], whole

    def windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows of the units and their fingerprints in two parts."""
        counts = self.end[units] - self.start[units]
        starts = np.repeat(self.start[units] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        parts = np.empty((2, len(starts)), U64)
        order = np.argsort(starts // PIECE, kind="stable")
        edges = np.searchsorted(starts[order] // PIECE, np.arange(len(self.data) // PIECE + 2))
        for p, (a, b) in enumerate(itertools.pairwise(edges)):
            if a < b:
                rows, at = order[a:b], p * PIECE
                for which in (0, 1):
                    own = starts[rows] - at
                    parts[which, rows] = Hashes(self.piece(at), which).of(own, own + self.length)
        return starts, parts[0], parts[1]


class Keys:
    """Distinct pairs of a packet in bucket order, and for each row its pair and whether it is the first of it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, buckets: int):
        bucket = (a % U64(buckets)).astype(np.int64)
        order = np.lexsort((b, a, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        reps = order[new]
        self.a, self.b, self.bucket = a[reps], b[reps], bucket[reps]
        counts = np.bincount(self.of, minlength=len(reps))
        self.several = counts[self.of] > 1
        self.first = np.zeros(len(order), bool)
        self.first[reps] = True  # a stable sort: the representative is the first row

    def asking(self, most: int) -> np.ndarray:
        """Which pairs ask: at most so many for each first part."""
        new = np.ones(len(self.a), bool)
        new[1:] = self.a[1:] != self.a[:-1]
        place = np.arange(len(self.a)) - np.maximum.accumulate(np.where(new, np.arange(len(self.a)), 0))
        return place < most

    def requests(self, asks: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, pairs) of the pairs that ask."""
        a, b, bucket = self.a[asks], self.b[asks], self.bucket[asks]
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else []
        for s, e in itertools.pairwise(edges):
            yield int(bucket[s]), np.concatenate((a[s:e], b[s:e])).tobytes()


def answers(packets: Sequence[int], blobs: Sequence[bytes]) -> list[bytes]:
    """States of the pairs of one bucket, by packet.

    In the order of the pairs, equal ones are a run; the packet with the least number holds its first copy.
    """
    pairs = [np.frombuffer(x, U64).reshape(2, -1) for x in blobs]
    a, b = np.concatenate(pairs, axis=1)
    sender = np.repeat(np.asarray(packets, np.int64), [p.shape[1] for p in pairs])
    order = np.lexsort((sender, b, a))
    new_a = np.ones(len(order), bool)
    new_a[1:] = a[order][1:] != a[order][:-1]
    new = new_a.copy()
    new[1:] |= b[order][1:] != b[order][:-1]
    run, group = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    state = np.where(np.bincount(run)[run] > 1, COPY, 0) | np.where(new, 0, LATER)
    state |= np.where(np.bincount(group, weights=new)[group] > 1, MIXED, 0)
    out = np.empty(len(order), np.uint8)
    out[order] = state
    return [x.tobytes() for x in np.split(out, np.cumsum([p.shape[1] for p in pairs])[:-1])]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in packets, written once: their order and numbers are fixed from then on."""
    schema = StructType(
        [
            StructField("packet", LongType()),
            StructField("ids", ArrayType(docs.schema[id_col].dataType)),
            StructField("sizes", ArrayType(LongType())),
            StructField("data", BinaryType()),
        ]
    )
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, squeeze = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for number, batch in enumerate(batches):
            values = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            row = [(part << 32) + number], [batch.column(0).to_pylist()], [[len(x) for x in values]]
            data = [squeeze.compress(b"".join(values))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((*row, data), types, strict=True)], names=schema.names
            )

    return cut(docs.select(id_col, text_col).mapInArrow(pack, schema))


REQUEST = StructType(
    [StructField("packet", LongType()), StructField("bucket", IntegerType()), StructField("pairs", BinaryType())]
)
ANSWER = StructType(
    [StructField("packet", LongType()), StructField("bucket", IntegerType()), StructField("states", BinaryType())]
)


def answered(requests: DataFrame) -> DataFrame:
    """One row per packet with the states of its pairs, in bucket order."""
    dealt = requests.repartition("bucket").sortWithinPartitions("bucket", "packet")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(bucket, packets, blobs):
            rows = [packets, [bucket] * len(packets), answers(packets, blobs)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(rows, ANSWER.fields, strict=True)], names=ANSWER.names
            )

        bucket, packets, blobs = None, [], []
        for batch in batches:
            for p, k, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != bucket and packets:
                    yield said(bucket, packets, blobs)
                    packets, blobs = [], []
                bucket = k
                packets.append(p)
                blobs.append(x)
        if packets:
            yield said(bucket, packets, blobs)

    states = dealt.mapInArrow(settle, ANSWER)
    # at most one row for each bucket that a packet of bounded size has asked
    rows = states.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct("bucket", "states"))).alias("said"))
    return cut(rows.select("packet", F.transform("said", lambda x: x.states).alias("said")))


class Settled:
    """A packet with what the first round, and perhaps the second, said about it."""

    def __init__(self, data: bytes, sizes: Sequence[int], length: int, buckets: Sequence[int], first=None):
        self.packet = Packet(zstandard.ZstdDecompressor().decompress(data), sizes, length)
        self.units = Keys(self.packet.anchor, self.packet.bytes, buckets[0])
        self.asks = self.units.asking(SURROUNDINGS)
        self.buckets = buckets
        if first is not None:
            self._first(b"".join(first))

    def _first(self, states: bytes) -> None:
        keys = self.units
        state = np.full(len(keys.a), MIXED, np.uint8)
        state[self.asks] = np.frombuffer(states, np.uint8)
        own = state[keys.of]
        self.whole = (own & COPY > 0) | keys.several
        self.whole_later = (own & LATER > 0) | ~keys.first
        self.open = np.flatnonzero((own & MIXED > 0) & ~self.whole_later)
        self.starts, a, b = self.packet.windows(self.open)
        self.pairs = Keys(a, b, self.buckets[1])

    def removed(self, second: Sequence[bytes] | None, keep_first: bool) -> np.ndarray:
        """Whether each byte lies in a window that is a copy (a later copy, if first ones are kept)."""
        states = np.frombuffer(b"".join(second or ()), np.uint8)[self.pairs.of] if len(self.starts) else np.zeros(0, np.uint8)
        if keep_first:
            units, windows = self.whole_later, (states & LATER > 0) | ~self.pairs.first
        else:
            units, windows = self.whole, (states & COPY > 0) | self.pairs.several
        p, length = self.packet, self.packet.length
        depth = np.zeros(len(p.data) + 1, np.int32)
        for start, end in (
            (p.start[units], p.end[units] - 1 + length),
            (self.starts[windows], self.starts[windows] + length),
        ):
            np.add.at(depth, start, 1)
            np.add.at(depth, end, -1)
        return np.cumsum(depth[:-1], dtype=np.int32) > 0


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    keep_first: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document.

    ``keep_first`` leaves the first copy of every repeated string; otherwise all copies go.
    """
    packets = packed(docs, id_col, text_col)
    total = packets.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    least_parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = tuple(max(least_parts, -(-total // size)) for size in BUCKET_BYTES)

    def ask(rows: DataFrame, reads: Sequence[str], pairs) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packet, *row in zip(*(batch.column(c).to_pylist() for c in ("packet", *reads)), strict=True):
                    made = list(pairs(*row))
                    if made:
                        columns = [[packet] * len(made), *map(list, zip(*made, strict=True))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(columns, REQUEST.fields, strict=True)],
                            names=REQUEST.names,
                        )

        return rows.select("packet", *reads).mapInArrow(run, REQUEST)

    def ask_units(sizes, data):
        settled = Settled(data, sizes, length, buckets)
        return settled.units.requests(settled.asks)

    def ask_windows(sizes, data, said):
        settled = Settled(data, sizes, length, buckets, said or [])
        return settled.pairs.requests(np.ones(len(settled.pairs.a), bool))

    first = answered(ask(packets, ["sizes", "data"], ask_units)).withColumnRenamed("said", "said_1")
    known = packets.join(first, "packet", "left")
    second = answered(ask(known, ["sizes", "data", "said_1"], ask_windows)).withColumnRenamed("said", "said_2")
    known = known.join(second, "packet", "left")

    fields = [
        StructField(id_col, docs.schema[id_col].dataType),
        StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()),
        StructField("n_spans", LongType()),
        StructField("kept_sha256", StringType()),
        *([StructField("kept", BinaryType())] if with_text else []),
    ]
    types = [to_arrow_type(f.dataType) for f in fields]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, data, one, two in zip(
                *(batch.column(c).to_pylist() for c in ("ids", "sizes", "data", "said_1", "said_2")), strict=True
            ):
                settled = Settled(data, sizes, length, buckets, one or [])
                gone, own, out = settled.removed(two, keep_first), settled.packet.data, []
                for key, size, end in zip(ids, sizes, settled.packet.ends.tolist(), strict=True):
                    cut_out = gone[end - size : end]
                    kept = own[end - size : end][~cut_out].tobytes()
                    runs = int(cut_out[:1].sum() + (cut_out[1:] & ~cut_out[:-1]).sum())
                    row = (key, size, size - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)
                    out.append(row[: len(fields)])
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=[f.name for f in fields]
                    )

    return known.select("ids", "sizes", "data", "said_1", "said_2").mapInArrow(remove, StructType(fields))


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; all copies are removed."""
    return repeats(docs, keep_first=False, with_text=False)
