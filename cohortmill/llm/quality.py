"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document. How often each pattern of votes occurs is
counted over all documents; expectation-maximisation on these counts estimates how reliable each labeller is in either class, and so
the chance of every pattern to be bad. These posteriors, not the votes, are what a logistic scorer over hashed
features learns from, on a bounded sample of documents. It then scores every whole text. There are two such tasks: ``poor`` (markup debris, repetition,
shouting, no prose) and ``toxic`` (insults). A document is kept if neither is likely.

Defined results: a null text counts as empty; an empty text is poor by its labellers. Repeated rows are scored alike.
A pattern without votes has the share of bad documents. An empty table gives no rows. Extra columns are not
read, or handed on by :func:`kept`.
"""

from __future__ import annotations

import itertools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField

from cohortmill.llm.common import map_arrow, texts
from cohortmill.scale import cut

#: Votes.
NONE, GOOD, BAD = 0, 1, 2
#: Slots of the hashed features.
SLOTS = 1 << 18
#: About so many documents are learned from.
SAMPLE = 8000
EM_ROUNDS = 200
STEPS, RATE, DECAY = 150, 0.5, 1e-6

#: Common words that prose of the four main languages cannot do without.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on are as with be by at from this a en de la el que los las del un una "
    "por con para se le les des et est une dans qui pour au sur pas der die und das von zu den mit ist nicht ein eine sich auch".encode().split()
)
#: Stems of insults.
INSULTS = tuple(
    "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown imbecile cretin scumbag jerk "
    "vermin filth bastard bitch asshole fuck shit retard dummkopf arschloch scheisse abschaum schwachkopf connard salaud "
    "imbécile abruti merde idiota estúpido gilipollas imbécil basura escoria mierda".encode().split()
)
ORDINARY = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\n.,;:'\"?!()-" + bytes(range(128, 256))
SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\r\n\f\v" else c
    for c in range(256)
)
MARKS = bytes(32 if c in b" \t\r\n\f\v" else 97 if c in ORDINARY else 120 for c in range(256))
SPACES = b" \t\r\n\f\v"
#: Marks that may stand around a word.
AROUND = b".,;:'\"?!()-*#$%&|"
ODD = re.compile(rb"x[^ ]*")
#: Whether a byte is a mark that may come in pairs.
PAIRED = np.array([re.fullmatch(rb"[^\s\w\x80-\xff.]", bytes([c])) is not None for c in range(256)])
#: The checksum goes on from what stands before the name of a shape.
SHAPE_CRC = zlib.crc32(b"shape:")
#: Beginnings of insults, tried first.
HEAD = min(map(len, INSULTS))
HEADS = frozenset(w[:HEAD] for w in INSULTS)
LETTERS_UP, LETTERS_LOW = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


class Facts:
    """What labellers and features are made from, of one text. Steps over all words or bytes run outside of the interpreter's loops."""

    def __init__(self, text: bytes | None):
        text = text or b""
        self.text = text
        self.words = text.lower().split()
        self.n = len(self.words)
        self.counts = Counter(map(bytes.strip, self.words, itertools.repeat(AROUND)))
        self.counts.pop(b"", None)
        insults = [w for w in self.counts if w[:HEAD] in HEADS and w.startswith(INSULTS)]
        self.insults = sum(self.counts[w] for w in insults)
        self.insult_kinds = len(insults)
        size = max(1, len(text))
        odd = len(text.translate(None, ORDINARY))
        self.symbols = odd / size
        # a word counts from its first odd character on, once
        self.odd = len(ODD.findall(text.translate(MARKS))) / max(1, self.n) if odd else 0.0
        self.doubled = doubled(text) / max(1, self.n)
        same = list(map(operator.eq, self.words, itertools.islice(self.words, 1, None)))
        stutter = sum(same)
        self.stutter = stutter / max(1, self.n)
        self.triple = sum(map(operator.and_, same, itertools.islice(same, 1, None))) / max(1, self.n) if stutter > 1 else 0.0
        up = len(text) - len(text.translate(None, LETTERS_UP))
        low = len(text) - len(text.translate(None, LETTERS_LOW))
        self.upper = up / max(1, up + low)
        self.top = max(self.counts.values(), default=0) / max(1, self.n)
        self.distinct = len(self.counts) / max(1, self.n)
        lines = [x for x in text.split(b"\n") if x.strip()]
        self.repeated = 1 - len(set(lines)) / max(1, len(lines))
        self.function = sum(self.counts[w] for w in FUNCTION_WORDS & self.counts.keys()) / max(1, self.n)
        self.mean = len(text.translate(None, SPACES)) / max(1, self.n)


def doubled(text: bytes) -> int:
    """Number of disjoint pairs of an equal mark: half of the length of each of its runs."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((data[1:] == data[:-1]) & PAIRED[data[1:]])
    if not len(at):
        return 0
    # pairs that overlap stand in one run, one after the other
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return int(((np.diff(starts, append=len(at)) + 1) // 2).sum())


def vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: The labellers of each task.
LABELLERS = {
    "poor": (
        lambda f: vote(f.symbols > 0.05, f.symbols < 0.01),
        lambda f: vote(f.odd > 0.3, f.odd < 0.1),
        lambda f: vote(f.doubled > 0.2, f.doubled < 0.05),
        lambda f: vote(f.n >= 20 and f.stutter > 0.2, f.n >= 20 and f.stutter < 0.05),
        lambda f: vote(f.n >= 20 and f.triple > 0.1, f.n >= 20 and f.triple < 0.02),
        lambda f: vote(f.upper > 0.5, f.upper < 0.15),
        lambda f: vote(f.n >= 20 and f.top > 0.25, f.n >= 20 and f.top < 0.15),
        lambda f: vote(f.n >= 50 and f.distinct < 0.15, f.n >= 50 and f.distinct > 0.3),
        lambda f: vote(f.repeated > 0.3, f.repeated < 0.1 and f.n >= 20),
        lambda f: vote(f.n >= 20 and f.function < 0.03, f.n >= 20 and f.function > 0.1),
        lambda f: vote(f.n == 0 or f.mean > 14 or f.mean < 2, 3 <= f.mean <= 9),
    ),
    "toxic": (
        lambda f: vote(f.insults >= 1, f.insults == 0),
        lambda f: vote(f.insult_kinds >= 2, f.insult_kinds == 0),
        lambda f: vote(f.insults > 0.002 * f.n, f.insults == 0),
    ),
}
TASKS = tuple(LABELLERS)


def votes_of(facts: Facts, task: str) -> int:
    """The votes of a task's labellers as one number, base 3."""
    code = 0
    for labeller in LABELLERS[task]:
        code = 3 * code + labeller(facts)
    return code


def features(facts: Facts, task: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's hashed features."""
    if task == "toxic":
        # presence of words, so that length does not thin them out
        slots = set((np.fromiter(map(zlib.crc32, facts.counts), np.int64, len(facts.counts)) % SLOTS).tolist())
        return np.fromiter(slots, np.int32, len(slots)), np.ones(len(slots), np.float32)
    shapes = np.frombuffer(facts.text.translate(SHAPE), np.uint8)
    if len(shapes):
        shapes = shapes[np.concatenate(([True], shapes[1:] != shapes[:-1]))]
    found = Counter(shapes.tobytes().split())
    whole = max(1, sum(found.values()))
    bins = {
        "symbols": facts.symbols * 50, "upper": facts.upper * 10, "top": facts.top * 20, "distinct": facts.distinct * 20,
        "repeated": facts.repeated * 10, "stutter": facts.stutter * 20, "function": facts.function * 20, "mean": facts.mean, "size": np.log2(1 + facts.n),
    }
    slots = [zlib.crc32(s, SHAPE_CRC) % SLOTS for s in found]
    slots += [zlib.crc32(f"bin:{k}:{int(min(v, 40))}".encode()) % SLOTS for k, v in bins.items()]
    values = np.ones(len(slots), np.float32)
    values[: len(found)] = 4 * np.fromiter(found.values(), np.int64, len(found)) / whole
    return np.array(slots, np.int32), values


def posteriors(counts: dict[int, int], labellers: int) -> dict[int, float]:
    """Chance of each pattern of votes to be bad, by expectation-maximisation on the pattern counts."""
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    votes = np.stack([codes // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)], axis=1)
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    cast = bad + good > 0
    # one bad vote is the start of a bad document, as it is bad in few respects
    chance = np.where(bad > 0, 0.9, 0.05)
    for _ in range(EM_ROUNDS):
        share = np.stack((1 - chance, chance)) * weight * cast
        prior = (share.sum(axis=1) + 1) / (share.sum() + 2)
        logs = np.log(prior)[:, None] + np.zeros_like(share)
        for k in range(labellers):
            # a vote that is not cast says nothing
            table = np.stack([(share * (votes[:, k] == v)).sum(axis=1) for v in (GOOD, BAD)], axis=1) + 0.5
            table /= table.sum(axis=1, keepdims=True)
            # a labeller may be useless, but not wrong on purpose
            table[1, 1] = max(table[1, 1], table[0, 1])
            table[1, 0] = 1 - table[1, 1]
            said = np.log(np.column_stack((np.ones(2), table)))
            logs += said[:, votes[:, k]]
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return dict(zip(codes.tolist(), chance.tolist(), strict=True))


class Scorer:
    """Logistic scorer over hashed features, one per task."""

    def __init__(self) -> None:
        self.weights = {t: np.zeros(SLOTS, np.float32) for t in TASKS}
        self.bias = dict.fromkeys(TASKS, 0.0)

    def learn(self, task: str, slots: list[np.ndarray], values: list[np.ndarray], wanted: np.ndarray) -> None:
        """Fit to soft labels; steps shrink by slot as its gradients add up."""
        if not len(wanted):
            return
        rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        cols, vals = np.concatenate(slots), np.concatenate(values)
        used, cols = np.unique(cols, return_inverse=True)
        w, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
        # both classes weigh the same
        share = np.clip(wanted.mean(), 0.02, 0.98)
        weight = np.where(wanted > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(wanted)
        b, seen_b = 0.0, 1e-8
        for _ in range(STEPS):
            margin = np.bincount(rows, w[cols] * vals, len(wanted)) + b
            error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - wanted)
            slope = np.bincount(cols, vals * error[rows], len(used)) + DECAY * w
            seen += slope**2
            seen_b += error.sum() ** 2
            w -= RATE * slope / np.sqrt(seen)
            b -= RATE * error.sum() / np.sqrt(seen_b)
        self.weights[task][used] = w
        self.bias[task] = float(b)

    def score(self, facts: Facts, task: str) -> float:
        slots, values = features(facts, task)
        margin = float((self.weights[task][slots] * values).sum()) + self.bias[task]
        return 1 / (1 + float(np.exp(-np.clip(margin, -30, 30))))


def trained(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """A scorer: votes are counted over all documents, features come from a bounded sample by hash."""
    share = max(1, docs.count() // sample)
    fields = [StructField(f"votes_{t}", IntegerType()) for t in TASKS]
    fields += [StructField(f"slots_{t}", ArrayType(IntegerType())) for t in TASKS]
    fields += [StructField(f"values_{t}", ArrayType(FloatType())) for t in TASKS]
    fields.append(StructField("chosen", IntegerType()))

    def label(column):
        out = [[] for _ in fields]
        for text in texts(column):
            facts = Facts(text)
            chosen = zlib.crc32(facts.text, 3) % share == 0
            for k, task in enumerate(TASKS):
                slots, values = features(facts, task) if chosen else ([], [])
                out[k].append(votes_of(facts, task))
                out[k + 2].append(list(slots))
                out[k + 4].append(list(values))
            out[6].append(int(chosen))
        return out

    seen = cut(map_arrow(docs, [text_col], fields, label))
    scorer = Scorer()
    # copies share their place in the sample; the limit keeps its bound
    rows = seen.where("chosen = 1").drop("chosen").limit(3 * sample).collect()
    for task in TASKS:
        patterns = seen.groupBy(F.col(f"votes_{task}").alias("v")).count().collect()
        chance = posteriors({r.v: r["count"] for r in patterns}, len(LABELLERS[task]))
        slots = [np.array(r[f"slots_{task}"], np.int32) for r in rows]
        values = [np.array(r[f"values_{task}"], np.float32) for r in rows]
        scorer.learn(task, slots, values, np.array([chance[r[f"votes_{task}"]] for r in rows]))
    return scorer


def scored(docs: DataFrame, scorer: Scorer, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with the chances ``poor`` and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(column):
        facts = [Facts(t) for t in texts(column)]
        return [[shared.value.score(f, task) for f in facts] for task in TASKS]

    return map_arrow(docs, [text_col], [StructField(t, DoubleType()) for t in TASKS], score, keep=keep)


def quality(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, score (of quality), toxic, kept."""
    docs = docs.select("doc_id", "text")
    out = scored(docs, trained(docs), ["doc_id"])
    return out.select(
        "doc_id",
        (1 - F.col("poor")).alias("score"),
        "toxic",
        ((F.col("poor") < 0.5) & (F.col("toxic") < 0.5)).alias("kept"),
    )


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, that are neither poor nor toxic."""
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    out = scored(rows, trained(docs, text_col), list(named.values()), named[text_col])
    out = out.where((F.col("poor") < 0.5) & (F.col("toxic") < 0.5))
    return out.select(*(F.col(n).alias(c) for c, n in named.items()))
