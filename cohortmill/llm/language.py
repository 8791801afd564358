"""Language identification by error-correcting output codes over hashed character n-grams.

Every language gets a codeword. For each bit of the code a linear classifier is trained on a bounded sample
of labelled documents; its features are the hashed 2- and 3-grams of letters of the whole text. A text is given
to the language whose codeword has the least loss, where the loss of a bit counts by how well that bit's
classifier knows the language. A text for which two codewords are about as near is flagged as ambiguous.

Defined results: a text that is null or has no letter is ``und`` with score 0 and not ambiguous. Without
labelled rows (an empty table, too) every text is ``und``. A null doc_id is in no fold: it is neither held out nor learned from.
Repeated rows are predicted alike. Extra columns are ignored, or handed on by :func:`identified`.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from cohortmill.llm.common import map_arrow, texts

#: Hash slots of 2-grams and of 3-grams.
SLOTS = 1 << 11
#: About so many labelled documents of a language are learned from.
PER_CLASS = 750
#: Up to so many languages the code has every split of them; beyond, about ``DENSE`` bits per doubling.
EXHAUSTIVE, DENSE = 6, 12
STEPS, RATE, DECAY = 150, 4.0, 1e-4
#: Codewords whose probabilities differ by less are about as near.
AMBIGUOUS = 0.1
UNKNOWN = "und"
CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Unit vector of the hashed n-grams of the whole text; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    inner = codes[letter | np.concatenate(([True], letter[:-1]))]
    codes = np.concatenate((np.uint32([32]), inner, np.uint32([32])))
    counts = np.zeros(2 * SLOTS)
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + 2]
        two = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + part[2:] * np.uint32(0x27D4EB2F)
        counts[:SLOTS] += np.bincount(((two[:CHUNK] ^ (two[:CHUNK] >> 15)) * np.uint32(0x2C1B3C6D)) >> 21, minlength=SLOTS)
        counts[SLOTS:] += np.bincount(((three[:CHUNK] ^ (three[:CHUNK] >> 15)) * np.uint32(0x297A2D39)) >> 21, minlength=SLOTS)
    weights = np.sqrt(counts)
    return (weights / np.linalg.norm(weights)).astype(np.float32)


def codewords(classes: int, seed: int = 10) -> np.ndarray:
    """Codewords of +1 and -1, one row per class, with no constant and no repeated or inverse bits."""
    if classes < 2:
        return np.zeros((classes, 0), np.int8)
    if classes <= EXHAUSTIVE:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(bits, np.int8).T
    length = int(DENSE * np.ceil(np.log2(classes)))
    draw = np.random.default_rng(seed)
    best, width = None, -1
    for _ in range(200):
        code = np.where(draw.random((classes, length)) < 0.5, 1, -1).astype(np.int8)
        near = code.astype(int) @ code.T.astype(int) - 2 * length * np.eye(classes, dtype=int)
        apart = (length - near.max()) // 2
        if apart > width and (np.abs(code.sum(axis=0)) < classes).all():
            best, width = code, apart
    return best


class Model:
    """Bit classifiers, codewords and their weights."""

    def __init__(self, rows: Sequence[tuple[str, str]]):
        seen = [(x, lang) for text, lang in rows if (x := grams(text)) is not None]
        self.classes = sorted({lang for _, lang in seen})
        self.code = codewords(len(self.classes)).astype(np.float32)
        k, bits = self.code.shape
        self.weights = np.zeros((2 * SLOTS, bits), np.float32)
        self.bias = np.zeros(bits, np.float32)
        self.trust = np.ones((k, bits), np.float32)
        if not bits:
            return
        x = np.stack([v for v, _ in seen])
        own = np.array([self.classes.index(lang) for _, lang in seen])
        share = (1.0 / (k * np.bincount(own, minlength=k)))[own].astype(np.float32)[:, None]
        wanted = self.code[own]
        ahead, ahead_bias = self.weights.copy(), self.bias.copy()
        for step in range(STEPS):
            margin = wanted * (x @ ahead + ahead_bias)
            pull = share * wanted / (1 + np.exp(np.clip(margin, -30, 30)))
            weights = ahead + RATE * (x.T @ pull - DECAY * ahead)
            bias = ahead_bias + RATE * pull.sum(axis=0)
            speed = step / (step + 3)
            ahead = weights + speed * (weights - self.weights)
            ahead_bias = bias + speed * (bias - self.bias)
            self.weights, self.bias = weights, bias
        right = (wanted * (x @ self.weights + self.bias)) > 0
        for c in range(k):
            self.trust[c] = np.maximum(right[own == c].mean(axis=0), 0.01)
        self.trust /= self.trust.sum(axis=1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability and whether the next codeword is about as near."""
        x = grams(text) if self.classes else None
        if x is None:
            return UNKNOWN, 0.0, False
        margin = self.code * (x @ self.weights + self.bias)
        loss = (self.trust * np.logaddexp(0, -margin)).sum(axis=1) * max(1, self.code.shape[1])
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        close = len(order) > 1 and chance[order[0]] - chance[order[1]] < AMBIGUOUS
        return self.classes[order[0]], float(min(1.0, chance[order[0]])), bool(close)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from about ``per_class`` labelled documents of each language, chosen by a hash of their id."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    whole = 1 << 30
    limits = itertools.chain.from_iterable((F.lit(c), F.lit(min(whole, whole * per_class // n))) for c, n in counts.items())
    chosen = rows.where(
        F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(whole)) < F.create_map(*limits)[F.col("lang")]
    )
    # repeated ids share their place; the limit keeps the bound whatever the ids are
    sample = chosen.select("text", "lang").limit(3 * per_class * len(counts)).collect()
    return Model(sorted((r.text, r.lang) for r in sample))


def identified(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("ambiguous", BooleanType()),
    ]

    def predict(column):
        said = [shared.value.predict(None if t is None else t.decode()) for t in texts(column)]
        return [[x[k] for x in said] for k in range(3)]

    return map_arrow(docs, [text_col], fields, predict, keep=keep)


def known_language(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, whose text is in some language: all but ``und``. Without a model, those with a letter."""
    named = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    model = trained(docs)
    if model.classes:
        out = identified(rows, model, list(named.values()), named["text"]).where(F.col("lang_pred") != UNKNOWN)
    else:
        lettered = lambda column: [[t is not None and grams(t.decode()) is not None for t in texts(column)]]
        fields = [StructField("lettered", BooleanType())]
        out = map_arrow(rows, [named["text"]], fields, lettered, keep=list(named.values())).where("lettered")
    return out.select(*(F.col(n).alias(c) for c, n in named.items()))


def languages(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, held_out, lang_pred, score, ambiguous."""
    model = trained(docs)
    out = identified(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
