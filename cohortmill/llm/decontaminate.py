"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over every document.

The benchmark is cut into blocks of at most ``block_words`` words. Each block is broadcast on
its own and scanned by a narrow pass over the documents, so nothing that is broadcast grows
beyond that bound and the documents are never shuffled; a larger benchmark takes more passes.

Defined results: a null or wordless document has no words, no hits and is clean. Null or wordless
benchmark texts have no windows. A null item id counts as the item ``null``. Repeated document rows
are judged one by one, repeated benchmark rows count as one item. An empty benchmark leaves every
document clean. Extra columns are ignored or, in :func:`decontaminate`, handed on; columns of the
documents that carry a name of the result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from cohortmill.llm.common import map_arrow, texts
from cohortmill.scale import cut

#: Words of the contract, on ASCII-lowered UTF-8: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Words of benchmark text in one broadcast block; a window takes some 500 bytes in each Python worker.
BLOCK_WORDS = 200_000
#: A long item is cut into pieces of so many window starts.
PIECE_WORDS = 50_000

PIECES = ArrayType(StringType())
SPANS = ArrayType(IntegerType())


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return WORD.findall(text.lower()) if text else []


class WindowSet:
    """The windows of one block: their hashes by length, and the items that hold them."""

    def __init__(self, rows: list[tuple[str, list[str]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, piece in rows:
            ids = tuple(self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in piece)
            length = min(window, len(ids))
            for p in range(len(ids) - length + 1):
                items[ids[p : p + length]].add(item)
        self.items = dict(items)
        self.weights = np.cumprod(np.full(window, 0x9E3779B97F4A7C15, np.uint64))
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for key in self.items:
            by_length[len(key)].append(key)
        self.hashes = {
            n: np.unique((np.array(keys, np.uint64) * self.weights[:n]).sum(axis=1)) for n, keys in by_length.items()
        }

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of the windows found, verified word by word, and their items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        spans, found = [], set()
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            windows = ids[starts[:, None] + np.arange(n)]
            keys = (windows * self.weights[:n]).sum(axis=1)
            near = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for k in np.flatnonzero(hashes[near] == keys):
                if hit := self.items.get(tuple(windows[k].tolist())):
                    spans.append((int(starts[k]), int(starts[k]) + n))
                    found |= hit
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that meet or overlap joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Items as rows (item, words); a long item comes in pieces that share ``window - 1`` words."""
    size = PIECE_WORDS

    def split(items, column):
        pieces = []
        for text in texts(column):
            words = [w.decode() for w in words_of(text)]
            last = max(1, len(words) - window + 1)
            pieces.append([" ".join(words[p : p + size + window - 1]) for p in range(0, last, size)] if words else [])
        return [items, pieces]

    rows = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")
    )
    fields = [StructField("item", StringType()), StructField("pieces", PIECES)]
    pieces = map_arrow(rows, ["item", "text"], fields, split)
    return pieces.select("item", F.explode("pieces").alias("piece")).distinct().withColumn(
        "words", F.size(F.split("piece", " "))
    )


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, start and end in turn) and hit_items.

    A window is ``window`` consecutive words of an item, or a whole item that has fewer.
    """
    spark = docs.sparkSession
    pieces = cut(benchmark_pieces(benchmark, item_col, item_text_col, window))
    total = pieces.agg(F.sum("words")).first()[0] or 0
    blocks = -(-total // block_words) or 1
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)))
    kept = list(docs.columns if keep is None else keep)
    fields = [
        StructField("n_words", IntegerType()),
        StructField("hit_spans", SPANS),
        StructField("hit_items", PIECES),
    ]
    out = docs.select(*dict.fromkeys([*kept, text_col]))
    state = [f.name for f in fields[1:]]
    for block in range(blocks):
        rows = [(r.item, r.piece.split(" ")) for r in pieces.where(F.col("block") == block).toLocalIterator()]
        shared = spark.sparkContext.broadcast(WindowSet(rows, window))

        def scan(column, *before, shared=shared):
            windows, result = shared.value, ([], [], [])
            for k, text in enumerate(texts(column)):
                words = words_of(text)
                spans, items = windows.find(words)
                if before:
                    old = before[0][k].as_py()
                    spans += list(zip(old[::2], old[1::2], strict=True))
                    items = items | set(before[1][k].as_py())
                result[0].append(len(words))
                result[1].append([x for span in merged(spans) for x in span])
                result[2].append(sorted(items))
            return result

        last = block == blocks - 1
        out = map_arrow(
            out, [text_col, *(state if block else [])], fields, scan, keep=kept if last else [*kept, text_col]
        )
    return out


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """Counts and the verdict: at least one word in ``share`` lies in a window."""
    spans = F.col("hit_spans")
    signed = F.transform(spans, lambda place, k: F.when(k % 2 == 1, place).otherwise(-place))
    n_hit = F.aggregate(signed, F.lit(0), lambda total, place: total + place)
    return (
        hits.withColumn("n_words", F.col("n_words").cast("long"))
        .withColumn("n_hit", n_hit.cast("long"))
        .withColumn("n_items", F.size("hit_items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("hit_items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **options
) -> DataFrame:
    """The documents without benchmark text, in their own columns.

    ``remove='documents'`` leaves out contaminated documents and hands on all others untouched;
    ``remove='spans'`` keeps every document and cuts the hit windows out of its text.
    """
    columns = docs.columns
    named = {c: f"in_{k}" for k, c in enumerate(columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    text = named[text_col]
    out = judged(marked(rows, benchmark, text_col=text, **options))
    if remove == "documents":
        out = out.where(~F.col("contaminated"))
    elif remove == "spans":
        def clean(column, spans):
            return [
                [
                    t if not s else without_spans(t, s)
                    for t, s in zip(texts(column), spans.to_pylist(), strict=True)
                ]
            ]

        kept = [n for n in named.values() if n != text]
        out = map_arrow(out, [text, "hit_spans"], [StructField(text, StringType())], clean, keep=kept)
    else:
        raise ValueError("remove must be 'documents' or 'spans'")
    return out.select(*(F.col(n).alias(c) for c, n in named.items()))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = marked(docs.select("doc_id", "text"), benchmark, keep=["doc_id"], **options)
    return judged(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
bw AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT d.r, d.p, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.g = b.g),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
