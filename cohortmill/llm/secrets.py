"""Secret scans: fixed rules, and probabilistic automata inferred from what the rules label.

The credentials that the rules find in a bounded sample of documents are the labelled strings. For each
kind a prefix tree of their character classes is built, and states whose outgoing frequencies are
statistically compatible (Hoeffding bound) are merged into a probabilistic automaton. A further automaton
is inferred from long ordinary words. Every run of credential characters in every text is then scored: it
is a secret of kind ``format`` if some credential automaton likes its format as well as it likes its own
examples, and far better than the automaton of ordinary words does.

Defined results: a null or empty text has no spans. A repeated row is scanned on its own. With no labelled
strings (an empty table, too) there is no automaton and only the rules apply. Extra columns are ignored, or
handed on by :func:`masked`.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortmill.llm.common import map_arrow, texts
from cohortmill.scale import cut

#: Fixed rules of the contract, on UTF-8 bytes. Kinds in the order of ties.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "format")

#: Shortest run that is scored.
MIN_RUN = 16
#: About so many documents give the labelled strings, and so many strings of a kind are used.
SAMPLE_DOCS = 20_000
SAMPLE_STRINGS = 600
#: Labelled strings are learned from their first so many characters; candidates are scored whole.
LEARN_CHARS = 64
#: Confidence of a merge, and the number of strings below which a state merges with any other.
ALPHA, FEW = 0.05, 8
#: Advantage over ordinary words that a secret needs: in all, and per character.
ADVANTAGE, ADVANTAGE_PER_CHAR = 8.0, 0.35
#: Share of the labelled strings of a kind that its own automaton may find unlikely.
UNLIKELY = 0.05

#: Character classes of the automata: digit, a-f, g-z, A-F, G-Z, sign.
CLASSES = "dhlHLs"
_CLASS_OF = bytes(
    ord("d") if 48 <= c <= 57
    else ord("h") if 97 <= c <= 102
    else ord("l") if 103 <= c <= 122
    else ord("H") if 65 <= c <= 70
    else ord("L") if 71 <= c <= 90
    else ord("s") if chr(c) in "+/_=-"
    else ord(".")
    for c in range(256)
)
RUN = re.compile(rb"[^.]{%d,}" % MIN_RUN)
HEX_RUN = re.compile(rb"[dh]{%d,}" % MIN_HEX)

Span = tuple[int, int, int]


def base_spans(text: bytes, classes: bytes) -> list[Span]:
    """Matches of the fixed rules as (start, kind, end) in bytes."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(classes)]
    return out


def other_runs(classes: bytes, spans: list[Span]) -> Iterable[re.Match]:
    """Runs of credential characters that no span touches."""
    spans = sorted(spans)
    starts = [s for s, _, _ in spans]
    ends = list(itertools.accumulate((e for _, _, e in spans), max))
    for m in RUN.finditer(classes):
        before = bisect.bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            yield m


def labelled(text: bytes) -> Iterable[tuple[int, bytes]]:
    """(kind, classes) of the credentials that the rules find; kind 3 are runs of ordinary words."""
    classes = text.translate(_CLASS_OF)
    spans = base_spans(text, classes)
    for start, kind, end in spans:
        value = classes[end - len(ASSIGN.match(text, start)[2]) : end] if kind == 0 else classes[start:end]
        yield kind, value.replace(b".", b"s")
    for m in other_runs(classes, spans):
        yield 3, m[0]


class Automaton:
    """A probabilistic deterministic automaton, inferred by merging compatible prefix-tree states."""

    def __init__(self, strings: Sequence[str], alpha: float = ALPHA, few: int = FEW):
        self.seen, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for text in strings:
            state = 0
            for symbol in text[:LEARN_CHARS]:
                self.seen[state] += 1
                self.count[state][symbol] += 1
                state = self.next[state].get(symbol) or self._grow(state, symbol)
            self.seen[state] += 1
            self.ends[state] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._few = few
        self._merge_all()
        self.log = [self._logs(s) for s in range(len(self.seen))]

    def _grow(self, state: int, symbol: str) -> int:
        self.seen.append(0)
        self.ends.append(0)
        self.next.append({})
        self.count.append(defaultdict(int))
        self.next[state][symbol] = len(self.seen) - 1
        return len(self.seen) - 1

    def _alike(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) < self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if min(n, m) < self._few:
                continue
            if not self._alike(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                if not self._alike(self.count[a][symbol], n, self.count[b][symbol], m):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for symbol, child in self.next[b].items():
                self.count[a][symbol] += self.count[b][symbol]
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child

    def _merge_all(self) -> None:
        kept = [0]
        while True:
            border = [(self.seen[c], s, x, c) for s in kept for x, c in self.next[s].items() if c not in kept]
            if not border:
                return
            _, state, symbol, child = max(border)
            for other in kept:
                if self._compatible(other, child):
                    self.next[state][symbol] = other
                    self._fold(other, child)
                    break
            else:
                kept.append(child)

    def _logs(self, state: int) -> dict[str, float]:
        whole = self.seen[state] + 0.5 * (len(CLASSES) + 1)
        logs = {x: math.log((self.count[state].get(x, 0) + 0.5) / whole) for x in CLASSES}
        return logs | {"": math.log((self.ends[state] + 0.5) / whole)}

    def likelihood(self, text: str) -> float:
        """Log likelihood of a class string; a step that was never seen starts again."""
        state, total = 0, 0.0
        for symbol in text:
            total += self.log[state][symbol]
            state = self.next[state].get(symbol, 0)
        return total + self.log[state][""]


class Scorer:
    """Automata of the credential kinds, each with its lowest likelihood per character, and of words."""

    def __init__(self, strings: dict[int, list[str]]):
        self.words = Automaton(strings.get(3, []))
        self.kinds: list[tuple[Automaton, float]] = []
        for kind in (0, 1, 2):
            known = strings.get(kind, [])
            if not known:
                continue
            automaton = Automaton(known)
            own = sorted(automaton.likelihood(x) / (len(x) + 1) for x in known)
            self.kinds.append((automaton, own[int(UNLIKELY * len(own))]))

    def secret(self, classes: str) -> bool:
        if not self.kinds or "d" not in classes:
            return False
        n = len(classes) + 1
        best = max((a.likelihood(classes) for a, low in self.kinds if a.likelihood(classes) / n >= low), default=None)
        if best is None:
            return False
        gain = best - self.words.likelihood(classes)
        return gain >= ADVANTAGE and gain / n >= ADVANTAGE_PER_CHAR


def learned(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Automata from the labelled strings of a bounded sample of documents, chosen by hash."""
    share = max(1, docs.count() // sample_docs)
    sample = docs.select(text_col).where(F.pmod(F.xxhash64(text_col, F.lit("sample")), F.lit(share)) == 0)
    pairs = ArrayType(StructType([StructField("kind", IntegerType()), StructField("value", StringType())]))

    def collect(column):
        return [
            [
                [{"kind": k, "value": v.decode()[: 4 * LEARN_CHARS]} for k, v in labelled(t)] if t else []
                for t in texts(column)
            ]
        ]

    found = map_arrow(sample, [text_col], [StructField("found", pairs)], collect)
    # written: the strings of each kind are chosen by a job of their own
    found = cut(found.select(F.inline("found")).distinct())
    strings = {}
    for kind in range(4):
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_STRINGS).collect()
        strings[kind] = [r.value for r in rows]
    return Scorer(strings)


def spans_of(text: bytes | None, scorer: Scorer) -> list[Span]:
    """All spans as (start, kind, end) in code points, by start, then kind."""
    if not text:
        return []
    classes = text.translate(_CLASS_OF)
    spans = base_spans(text, classes)
    spans += [(m.start(), 3, m.end()) for m in other_runs(classes, spans) if scorer.secret(m[0].decode())]
    if spans and not text.isascii():
        at, count, place = 0, 0, {}
        for b in sorted({x for s, _, e in spans for x in (s, e)}):
            count += len(text[at:b].decode())
            at, place[b] = b, count
        spans = [(place[s], k, place[e]) for s, k, e in spans]
    return sorted(spans)


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = (), scorer: Scorer | None = None) -> DataFrame:
    """Counts of the rules, ``base`` and ``spans`` of every document."""
    if scorer is None:
        scorer = learned(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    counts = [f"n_{k}" for k in KINDS]
    fields = [StructField(c, LongType()) for c in counts]
    fields += [StructField("base", StringType()), StructField("spans", StringType())]

    def scan(column):
        out = [[] for _ in fields]
        for text in texts(column):
            spans = spans_of(text, shared.value)
            for kind in range(4):
                out[kind].append(sum(k == kind for _, k, _ in spans))
            out[4].append(joined(x for x in spans if x[1] < 3))
            out[5].append(joined(spans))
        return out

    return map_arrow(docs, [text_col], fields, scan, keep=keep)


def hide(text: str, spans: Iterable[Span], mark: str) -> str:
    """The text with each run of spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents in their own columns, with every secret of the text replaced by the mark."""
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    text = named[text_col]
    shared = docs.sparkSession.sparkContext.broadcast(learned(rows, text))

    def mask(column):
        out = []
        for value in texts(column):
            spans = spans_of(value, shared.value)
            out.append(hide(value.decode(), spans, mark) if spans else value if value is None else value.decode())
        return [out]

    kept = [n for n in named.values() if n != text]
    out = map_arrow(rows, [text], [StructField(text, StringType())], mask, keep=kept)
    return out.select(*(F.col(n).alias(c) for c, n in named.items()))


def secrets(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, counts by rule, base_sha256, spans, n_format."""
    out = scanned(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_format"
    )
