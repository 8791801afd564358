"""De-identification by typed patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RESULT = "masked string, found array<struct<type:string,value:string>>"


@dataclass(frozen=True)
class MaskRule:
    """A pattern whose ``name`` or ``number`` group is taken out.

    ``labels`` name the groups in order. A whole-pattern rule labels its only group.
    """

    data_type: str
    pattern: str
    labels: Sequence[str]
    multiline: bool = True
    ignore_case: bool = True
    disabled: bool = False

    def compiled(self) -> re.Pattern:
        flags = (re.MULTILINE if self.multiline else 0) | (re.IGNORECASE if self.ignore_case else 0)
        return re.compile(self.pattern, flags | re.ASCII)


@dataclass(frozen=True)
class LetterRules:
    """Where the head of a letter ends and its tail starts."""

    header: str
    tail: str
    rules: Sequence[MaskRule] = field(default_factory=tuple)


def _mask_text(text: str, rules: list[tuple[MaskRule, re.Pattern]], areas: list[tuple[int, int]]):
    found, spans = [], []
    for rule, pattern in rules:
        for begin, stop in areas:
            for m in pattern.finditer(text, begin, stop):
                for group, label in enumerate(rule.labels, start=1):
                    value = m.group(group)
                    if label not in ("name", "number") or value is None:
                        continue
                    found.append({"type": rule.data_type, "value": value})
                    if len(value) >= 2:
                        spans.append(m.span(group))
    return masked(text, spans), found


def masked(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The text with every letter of the spans replaced; blanks stay. Spans may overlap, and each part of the text is copied once."""
    pieces, done = [], 0
    for start, end in sorted(spans):
        if end <= done:
            continue
        start = max(start, done)
        pieces += [text[done:start], re.sub(r"\S", "x", text[start:end])]
        done = end
    return "".join([*pieces, text[done:]])


def deidentify(docs: DataFrame, rules: Sequence[MaskRule], *, letter: LetterRules | None = None) -> DataFrame:
    """Documents with masked text and the values taken out (``found``).

    Masking keeps the length of the text, so offsets of annotations stay right. With ``letter``
    only the text before the salutation and behind the closing line is treated; a document
    without both gets no masked text and ``found`` is null.
    """
    active = [r for r in rules if not r.disabled]

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [(r, r.compiled()) for r in active]
        head = re.compile(letter.header, re.MULTILINE) if letter else None
        tail = re.compile(letter.tail, re.MULTILINE | re.IGNORECASE) if letter else None
        for batch in batches:
            out = []
            for text in batch:
                if text is None:
                    out.append((None, None))
                    continue
                areas = [(0, len(text))]
                if letter:
                    h, t = head.search(text), tail.search(text)
                    if h is None or t is None:
                        out.append((None, None))
                        continue
                    areas = [(0, h.start()), (t.end(), len(text))]
                out.append(_mask_text(text, compiled, areas))
            yield pd.DataFrame(out, columns=["masked", "found"])

    rows = docs.withColumn("_r", run("text"))
    return rows.withColumn("masked", F.col("_r.masked")).withColumn("found", F.col("_r.found")).drop("_r", "text")


def sensitive_values(deidentified: DataFrame) -> DataFrame:
    """Distinct removed values per type, as flat rows."""
    return deidentified.select(F.explode_outer("found").alias("f")).where("f IS NOT NULL").select("f.type", "f.value").distinct()
