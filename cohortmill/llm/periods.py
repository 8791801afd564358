"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(6, 4 * q)`` words, as long as it can be. At the scale
``B`` (1, 2, 4, ...) all periods from ``B`` to ``2 * B - 1`` are looked for: a run with such a period holds three whole blocks of
``B`` words that begin at multiples of ``B``, and each of the first two occurs again ``q`` words later, so inside the ``2 * B`` words
behind it. For all distances at once, the sum of squared differences between a block and its later places is the sum of both squares
less twice a correlation, which an exact integer transform modulo 65537 gives. A sum of zero modulo 65537 is a candidate, so none
is missed; both ends of a candidate are then moved outwards word by word, which also refutes false ones.

Blocks in which a run of a smaller scale already explains the distance are skipped: a run of period ``q`` that holds both places makes
every multiple of ``q`` no smallest period. Blocks longer than ``WIDEST`` words are looked up by their first ``WIDEST`` words, in
windows of that length, so a transform has a bounded size. Work is ``n * log(n) ** 2`` words, memory a constant number of arrays of
the words of one Arrow batch (``BATCH_BYTES``, or a single longer text).

Defined results: a null or wordless text has no runs and no words; a null document id leaves the text as it is; repeated rows are judged
on their own; extra columns are not read by the digest and kept by :func:`collapsed`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cohortmill.llm.common import map_arrow, texts

#: A run has at least so many words, and so many periods.
LEAST, REPEATS = 6, 4
#: The prime of the transform; 3 generates its units, whose number is a power of two.
PRIME, ROOT = 65537, 3
#: Longest part of a block that is transformed; twice as many words are the order of the largest transform.
WIDEST = 1 << 15
#: Words that are transformed at once.
CHUNK = 1 << 16


def folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder: 2 ** 16 is -1 modulo the prime."""
    return (x & 0xFFFF) - (x >> 16)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base modulo the prime."""
    out = np.ones(n, np.int64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[:k] * pow(base, k, PRIME) % PRIME
        k *= 2
    return out


class Transform:
    """Number-theoretic transform of rows of ``size`` values; spectra are in bit-reversed order."""

    def __init__(self, size: int):
        self.size = size
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        self.twiddles = {}
        m = size
        while m > 1:
            self.twiddles[m] = powers(pow(root, size // m, PRIME), m // 2)
            m //= 2
        self.inverse = {m: powers(pow(pow(root, size // m, PRIME), -1, PRIME), m // 2) for m in self.twiddles}
        self.scale = pow(size, -1, PRIME)
        order = np.zeros(size, np.int64)
        k = 1
        while k < size:
            order[:k] *= 2
            order[k : 2 * k] = order[:k] + 1
            k *= 2
        # place of the spectrum of the mirrored row
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        self.mirror = place[-order % size]

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """Spectra of rows of half the size, with zeros behind; the first pass has nothing to add."""
        half = self.size // 2
        out = np.empty((len(rows), self.size), np.int64)
        out[:, :half] = rows
        out[:, half:] = folded(rows * self.twiddles[self.size])
        return self._down(out, half)

    def _down(self, x: np.ndarray, m: int) -> np.ndarray:
        while m > 1:
            parts = x.reshape(-1, m)
            a, b = parts[:, : m // 2], parts[:, m // 2 :]
            rest = a - b
            a += b
            b[...] = folded(rest * self.twiddles[m])
            m //= 2
        return x

    def back(self, x: np.ndarray) -> np.ndarray:
        """Rows of spectra, up to multiples of the prime."""
        m = 2
        while m <= self.size:
            parts = x.reshape(-1, m)
            a, b = parts[:, : m // 2], parts[:, m // 2 :]
            t = folded(b * self.inverse[m])
            b[...] = a - t
            a += t
            m *= 2
        return folded(folded(x)) * self.scale


def windows(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` values from each start on, zeros beyond the end."""
    at = first[:, None] + np.arange(width)
    return np.where(at < len(values), values[np.minimum(at, len(values) - 1)], 0)


def agreements(values: np.ndarray, squares: np.ndarray, block: int, width: int, transform: Transform) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and distances from ``block`` to ``2 * block - 1`` at which ``width`` words of an aligned block may occur again.

    ``squares`` are the running sums of the squared values. All aligned blocks of the values are taken.
    """
    starts = np.arange(0, len(values), block, dtype=np.int64)
    step = max(1, CHUNK // (2 * width))
    for low in range(0, len(starts), step):
        part = starts[low : low + step]
        own = transform.padded(windows(values, part, width))
        mirrored = folded(folded(own))[:, transform.mirror]
        for ahead in range(block, 2 * block, width):
            if block == width:
                # the window behind a block is the next two blocks; its spectrum is the sum of theirs, the odd half with its sign turned
                more = transform.padded(windows(values, part[-1] + block * np.arange(1, 3), width))
                spectra = np.concatenate([own, more])
                near, far = spectra[1:-1], spectra[2:]
                window = np.concatenate([near[:, :width] + far[:, :width], near[:, width:] - far[:, width:]], axis=1)
            else:
                near, far = (transform.padded(windows(values, part + ahead + k * width, width)) for k in (0, 1))
                window = np.concatenate([near[:, :width] + far[:, :width], near[:, width:] - far[:, width:]], axis=1)
            products = transform.back(mirrored * folded(folded(window)))[:, :width]
            places = np.minimum(part[:, None] + ahead + np.arange(width), len(values))
            their = squares[np.minimum(places + width, len(values))] - squares[places]
            ours = squares[np.minimum(part + width, len(values))] - squares[part]
            row, shift = np.nonzero((ours[:, None] + their - 2 * products) % PRIME == 0)
            found, distance = part[row], shift + ahead
            inside = found + distance + width <= len(values)
            yield found[inside], distance[inside]


def stretch(ids: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The longest stretch around ``start`` whose words a distance apart are the same; empty if those at ``start`` differ."""
    n = len(ids) - distance
    low = high = start
    reach = 64
    while high < n:
        stop = min(n, high + reach)
        other = np.flatnonzero(ids[high:stop] != ids[high + distance : stop + distance])
        if len(other):
            high += int(other[0])
            break
        high, reach = stop, reach * 2
    if high == start:
        return start, start
    reach = 64
    while low > 0:
        stop = max(0, low - reach)
        other = np.flatnonzero(ids[stop:low] != ids[stop + distance : low + distance])
        if len(other):
            low = stop + int(other[-1]) + 1
            break
        low, reach = stop, reach * 2
    return low, high + distance


def smallest(ids: np.ndarray, low: int, high: int, period: int) -> bool:
    """Whether no part of the period is a period of the stretch; only its divisors can be."""
    word = ids[low : low + period]
    rest, k = period, 2
    while rest > 1:
        if k * k > rest:
            k = rest
        if rest % k == 0:
            part = period // k
            if np.array_equal(word[part:], word[:-part]):
                return False
            while rest % k == 0:
                rest //= k
        k += 1
    return True


class Runs:
    """Runs of an array of word numbers; several texts may stand in it, parted by numbers that occur once."""

    def __init__(self, ids: np.ndarray, longest: int):
        """``longest`` is the number of words of the longest text."""
        self.ids = ids
        self.found: list[tuple[int, int, int]] = []
        # residues of the word numbers; equal words have equal ones
        values = (ids.astype(np.int64) + 1) * 40503 % PRIME
        squares = np.concatenate([[0], np.cumsum(values * values % PRIME)])
        block = 1
        while REPEATS * block <= longest:
            width = min(block, WIDEST)
            self._at_scale(values, squares, block, width)
            block *= 2
        self.found = sorted(set(self.found), key=lambda r: (r[0], r[2]))

    def _at_scale(self, values: np.ndarray, squares: np.ndarray, block: int, width: int) -> None:
        pairs = list(agreements(values, squares, block, width, Transform(2 * width)))
        start = np.concatenate([p[0] for p in pairs])
        distance = np.concatenate([p[1] for p in pairs])
        # a run holds two neighbouring blocks that both agree at its period
        key = np.sort(distance * (len(self.ids) + 1) + start)
        key = key[np.isin(key + block, key)]
        start, distance = key % (len(self.ids) + 1), key // (len(self.ids) + 1)
        keep = ~self._explained(start, start + distance + width, distance, block)
        done = (-1, -1, -1)
        for s, d in zip(start[keep].tolist(), distance[keep].tolist(), strict=True):
            if d == done[0] and done[1] <= s and s + d + width <= done[2]:
                continue
            low, high = stretch(self.ids, s, d)
            done = (d, low, high)
            if high - low >= max(LEAST, REPEATS * d) and smallest(self.ids, low, high, d):
                self.found.append((low, high, d))

    def _explained(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray, block: int) -> np.ndarray:
        """Whether a run with a smaller period that divides the distance holds both places.

        Two runs whose periods are below ``block`` share less than ``2 * block`` words, so at most one, the last that begins
        early enough, holds a stretch of that length.
        """
        long = sorted((low, high, q) for low, high, q in self.found if q < block and high - low >= 2 * block)
        if not long or not len(start):
            return np.zeros(len(start), bool)
        lows, highs, periods = (np.array(x, np.int64) for x in zip(*long, strict=True))
        k = np.searchsorted(lows, start, side="right") - 1
        held = (k >= 0) & (highs[k] >= end)
        return held & (distance % periods[k] == 0)


def numbered_words(batch: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts in one array, a number of its own behind each text, and where each text begins."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in batch], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.empty(int(starts[-1]), np.int64)
    for words, at in zip(batch, starts, strict=False):
        for w in dict.fromkeys(words):
            numbers.setdefault(w, len(numbers))
        ids[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    ids[starts[1:] - 1] = len(numbers) + np.arange(len(batch))
    return ids, starts


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The contract's repetition: in one of ten documents all words from some place on repeat the first of them.

    Returns the numbers of the original words.
    """
    n = len(ids)
    places = np.arange(n)
    if doc_id is None or n == 0:
        return places
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return places
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % period
    return places


def runs_of(batch: list[list[bytes]], doc_ids: list[int | None] | None = None) -> list[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Runs (start, length, period) of each text by start and period, and the word numbers that its text consists of.

    With ``doc_ids`` the contract's repetitions come first.
    """
    ids, starts = numbered_words(batch)
    made = []
    for k, words in enumerate(batch):
        at = starts[k]
        own = planted(ids[at : at + len(words)], doc_ids[k] if doc_ids is not None else None)
        ids[at : at + len(words)] = ids[at : at + len(words)][own]
        made.append(own)
    # texts of like length go together, so that a scale sees only those that can hold one of its runs
    longest = sorted(range(len(batch)), key=lambda k: -len(batch[k]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    low = 0
    while low < len(longest) and len(batch[longest[low]]) >= LEAST:
        size = len(batch[longest[low]])
        high = low
        while high < len(longest) and 2 * len(batch[longest[high]]) >= size and len(batch[longest[high]]) >= LEAST:
            high += 1
        group = longest[low:high]
        joined = np.concatenate([ids[starts[k] : starts[k + 1]] for k in group])
        begins = np.concatenate([[0], np.cumsum([len(batch[k]) + 1 for k in group])])
        for start, end, period in Runs(joined, size).found:
            place = int(np.searchsorted(begins, start, side="right")) - 1
            found[group[place]].append((start - int(begins[place]), end - start, period))
        low = high
    return list(zip(found, made, strict=True))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if each run is cut to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def split_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks."""
    return text.split() if text else []


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, *, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and ``runs`` of each text: start (word number), length and period in words."""

    def work(column: pa.Array) -> list:
        batch = [split_words(t) for t in texts(column)]
        return [[[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in runs_of(batch)]]

    return map_arrow(docs, [text_col], [StructField("runs", ArrayType(RUN))], work, keep=[key])


def collapsed(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with each run cut to its first period; only texts with a run change, their words parted by one blank."""

    def work(column: pa.Array) -> list:
        raw = texts(column)
        batch = [split_words(t) for t in raw]
        out = []
        for text, words, (runs, _) in zip(raw, batch, runs_of(batch), strict=True):
            if runs:
                text = b" ".join(w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k)
            out.append(None if text is None else text.decode())
        return [out]

    made = map_arrow(docs, [text_col], [StructField(text_col, StringType())], work, keep=docs.columns)
    return made.select(*(f"`{c}`" for c in docs.columns))


def digest(words: list[bytes], runs: list[tuple[int, int, int]], places: np.ndarray) -> tuple:
    """Digest of one text: the runs, and the kept words of ``words`` at ``places``."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    keep = kept_words(len(words), runs)
    text = b" ".join(map(words.__getitem__, places[keep].tolist())) if runs or len(places) and places[-1] != len(places) - 1 else b" ".join(words)
    best: tuple | None = None
    for run in runs:
        # the greater exponent, compared without division; runs come by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


FIELDS = [
    *(StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
    *(StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256")),
]


def period_digest(docs: DataFrame) -> DataFrame:
    """Digest per document, after the contract's repetitions."""

    def work(ids: pa.Array, column: pa.Array) -> list:
        batch = [split_words(t) for t in texts(column)]
        rows = [digest(words, *found) for words, found in zip(batch, runs_of(batch, ids.to_pylist()), strict=True)]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]

    return map_arrow(docs, ["doc_id", "text"], FIELDS, work, keep=["doc_id"])


#: A run of period q of at least four periods has equal words at three multiples of q in a row, which gives n * log(n) candidates.
SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents),
bytes AS (SELECT DISTINCT doc_id, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ord(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)) AS b
    FROM t WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x:
    list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda v, z:
      CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)), CAST(4294967295 AS BIGINT)) AS h FROM bytes),
aim AS (SELECT t.rid, t.doc_id, ws, len(ws) AS n, h, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM t LEFT JOIN crc USING (doc_id)),
aim2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM aim),
w AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE
    list_concat(ws[1:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) END AS ws FROM aim2),
one AS MATERIALIZED (SELECT rid, n, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i, rid * 1000000000 + generate_subscripts(ws, 1) - 1 AS k FROM w),
same AS (SELECT rid, n, unnest(range(1, n // 4 + 1)) AS q FROM w WHERE n >= 6),
marks AS MATERIALIZED (SELECT rid, q, rid * 1000000000 + unnest(range(0, n - 2 * q, q)) AS k FROM same),
first AS MATERIALIZED (SELECT m.rid, m.q, m.k, a.x FROM marks m JOIN one a ON a.k = m.k),
second AS MATERIALIZED (SELECT m.rid, m.q, m.k, m.x FROM first m JOIN one b ON b.k = m.k + m.q AND b.x = m.x),
cand AS MATERIALIZED (SELECT DISTINCT m.rid, m.q FROM second m JOIN one c ON c.k = m.k + 2 * m.q AND c.x = m.x),
all_words AS MATERIALIZED (SELECT c.rid, c.q, a.i, a.k, a.x FROM cand c JOIN one a ON a.rid = c.rid),
eq AS (SELECT a.rid, a.q, a.i, a.i - row_number() OVER (PARTITION BY a.rid, a.q ORDER BY a.i) AS island FROM all_words a
    JOIN one b ON b.k = a.k + a.q AND b.x = a.x),
st AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM eq GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT rid, min(q) AS q, s, len FROM st GROUP BY rid, s, len),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT o.rid, string_agg(o.x, ' ' ORDER BY o.i) AS text FROM one o ANTI JOIN gone g ON o.rid = g.rid AND o.i = g.i GROUP BY o.rid),
best AS (SELECT rid, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM runs GROUP BY rid),
top AS (SELECT DISTINCT ON (rid) rid, s, len, q FROM runs ORDER BY rid, CAST(len AS DOUBLE) / q DESC, s, q)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(top.len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
    CAST(1000 * top.len // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)
"""
