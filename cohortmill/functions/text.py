"""Text functions. Offsets count characters: start inclusive, end exclusive, from zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortmill import schemas

# fixed values: words left out of word-vector training
STOP_WORDS = ["", "the", "a", "an", "these", "that"]
# fixed values: window sizes in characters
TEXT_WINDOW = 150
HEAD_WINDOW = 200
SNIPPET_WINDOW = 20

# characters looked at per token before the whole text is read
TOKEN_REACH = 30

SENTENCE = r"[^.\n\s][^.\n]*+\.?"
# full stops and the blanks of \s, none of which starts a sentence
NO_SENTENCE = ". \t\n\x0b\f\r"
# letters and digits of any script
WORD = r"[\p{L}\p{N}]+"
NO_WORD = r"[^\p{L}\p{N}]+"

# matches of a stretch, those that need no stretches, and the bits of a block of matches
FOLD, FEW, BLOCK_BITS = 128, 64, 3


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int(value: int | Column) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    An expression used inside a lambda would otherwise be worked out again for every element.
    """
    return F.transform(F.array(value), body)[0]


def slice_text(text: str | Column, start: int | Column, end: int | Column) -> Column:
    """Characters start..end of the text."""
    s = F.greatest(_int(start), F.lit(0))
    return F.substring(_col(text), s + 1, F.greatest(_int(end) - s, F.lit(0)))


def before(text: str | Column, start: int | Column, window: int = TEXT_WINDOW) -> Column:
    """Up to ``window`` characters before a position."""
    return slice_text(text, _int(start) - window, start)


def after(text: str | Column, end: int | Column, window: int = TEXT_WINDOW) -> Column:
    """Up to ``window`` characters from a position on."""
    return F.substring(_col(text), _int(end) + 1, F.lit(window))


def find_spans(text: str | Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as ``array<struct<start, end, str>>``.

    The gaps between the matches and the matches themselves rebuild the text, so their
    lengths give the character offsets without leaving the JVM. ``str`` is the given group.
    """
    t = _col(text)
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    shown = whole if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    gaps = F.split(t, pattern, -1)
    # one gap more than matches: the last pair has no match
    if group == 0:
        parts = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("str")))
    else:
        parts = F.arrays_zip(
            F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), shown.alias("str")
        )
    return _placed(parts)


def _placed(parts: Column) -> Column:
    """Spans from ``array<struct<gap, len, str>>``; a part without length is left out.

    The offset of a part is the sum of the lengths before it: those of the whole blocks before its own, and those in its block. Of more
    than FEW parts, whole stretches of FOLD come first. No array grows while it is built.
    """
    block = 1 << BLOCK_BITS
    added = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
    length = lambda p: p["gap"] + F.coalesce(p["len"], F.lit(0))
    ahead = lambda sums, k: added(F.slice(sums, F.lit(1), k))

    def starts(lengths: Column, begin: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.shiftright(F.size(lengths) - 1, BLOCK_BITS))
        blocks = F.transform(numbers, lambda k: added(F.slice(lengths, k * block + 1, F.lit(block))))

        def start(i: Column, sums: Column) -> Column:
            inner = i.bitwiseAND(block - 1)
            return begin + ahead(sums, F.shiftright(i, BLOCK_BITS)) + added(F.slice(lengths, i - inner + 1, inner))

        return let(blocks, lambda sums: F.transform(lengths, lambda _, i: start(i, sums)))

    def spans(stretch: Column, begin: Column) -> Column:
        at = let(F.transform(stretch, length), lambda lengths: starts(lengths, begin))

        def span(part: Column, start: Column) -> Column:
            s = start + part["gap"]
            return F.when(part["len"].isNotNull(), F.struct(s.alias("start"), (s + part["len"]).alias("end"), part["str"].alias("str")))

        return F.filter(F.zip_with(stretch, at, span), lambda x: x.isNotNull())

    def cut_up(all_parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / FOLD).cast("int"))
        stretches = F.transform(numbers, lambda k: F.slice(all_parts, k * FOLD + 1, F.lit(FOLD)))
        return F.when(F.size(all_parts) > 0, stretches).otherwise(F.array().cast("array<array<struct<gap:int,len:int,str:string>>>"))

    def place(stretches: Column) -> Column:
        lengths = F.transform(stretches, lambda x: F.aggregate(x, F.lit(0), lambda n, p: n + length(p)))

        def placed(sums: Column) -> Column:
            return F.flatten(F.transform(stretches, lambda x, k: let(ahead(sums, k), lambda begin: spans(x, begin))))

        return let(lengths, placed)

    return let(parts, lambda p: F.when(F.size(p).between(1, FEW), spans(p, F.lit(0))).otherwise(let(cut_up(p), place)))


def sentence_spans(text: str | Column = "text") -> Column:
    """Sentences: runs up to a full stop or a line break, without leading blanks.

    A piece is a sentence with the marks and blanks before it, so the text is gone through once; what is left of a piece without
    a sentence is empty, which only the last ones are.
    """
    pieces = F.regexp_extract_all(_col(text), F.lit(rf"[{NO_SENTENCE}]*+(?:{SENTENCE})?"), F.lit(0))

    def part(piece: Column) -> Column:
        return let(
            F.ltrim(piece, F.lit(NO_SENTENCE)),
            lambda s: F.struct((F.length(piece) - F.length(s)).alias("gap"), F.nullif(F.length(s), F.lit(0)).alias("len"), s.alias("str")),
        )

    return _placed(F.transform(pieces, part))


def word_spans(text: str | Column) -> Column:
    """Words of letters and digits with their offsets."""
    return find_spans(text, WORD)


def words(text: str | Column) -> Column:
    """Lower-case words of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def collapse_spaces(text: str | Column) -> Column:
    """Two or more blanks become one space."""
    return F.regexp_replace(_col(text), r"\s{2,}", " ")


def collapse_to_newline(text: str | Column) -> Column:
    """Two or more blanks become a line break."""
    return F.regexp_replace(_col(text), r"\s{2,}", "\n")


def collapse_keep_newline(text: str | Column) -> Column:
    """Two or more blanks become a line break if one is among them, else a space."""
    kept = F.regexp_replace(_col(text), r"[ \t\f\r]+\n\s*|\n\s+", "\n")
    return F.regexp_replace(kept, r"[ \t\f\r]{2,}", " ")


def normalise_title(title: str | Column, number_only: bool = False) -> Column:
    """Lower-case section title; a numbered title goes away whole, or only its number."""
    pattern = r"^\d\.\s+" if number_only else r"^\d\.\s+.*"
    return F.lower(F.regexp_replace(F.regexp_replace(_col(title), r"^\s+|\s+$", ""), pattern, ""))


def clean_token(token: str | Column) -> Column:
    """Token without the non-alphanumeric characters at both ends."""
    return F.regexp_replace(_col(token), r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")


def clean_tokens(text: str | Column) -> Column:
    """Cleaned blank-separated tokens without the stop words."""
    tokens = F.transform(F.split(_col(text), r"\s+"), clean_token)
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def _blank_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def last_items(tokenize: Callable[[Column], Column], text: str | Column, start: int | Column, n: int) -> Column:
    """The last n tokens before a position.

    A short stretch is looked at first. It settles the answer if it holds one token more than
    asked for, as only its first token can be cut; otherwise the whole text before is read.
    """
    reach = TOKEN_REACH * (n + 1)
    tail = lambda items: let(items, lambda a: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n)))
    return let(
        tokenize(before(text, start, reach)),
        lambda near: F.when((F.size(near) > n) | (_int(start) <= reach), tail(near)).otherwise(tail(tokenize(slice_text(text, 0, start)))),
    )


def first_items(tokenize: Callable[[Column], Column], text: str | Column, end: int | Column, n: int) -> Column:
    """The first n tokens from a position on, by the same way as :func:`last_items`."""
    reach = TOKEN_REACH * (n + 1)
    whole = tokenize(F.substring(_col(text), _int(end) + 1, F.length(_col(text))))
    return let(
        tokenize(after(text, end, reach)),
        lambda near: F.when(F.size(near) > n, F.slice(near, 1, n)).otherwise(F.slice(whole, 1, n)),
    )


def tokens_before(text: str | Column, start: int | Column, n: int) -> Column:
    """The last n blank-separated tokens before a position."""
    return last_items(_blank_tokens, text, start, n)


def tokens_after(text: str | Column, end: int | Column, n: int) -> Column:
    """The first n blank-separated tokens from a position on."""
    return first_items(_blank_tokens, text, end, n)


def first_number(text: str | Column, end: int | Column, number: str, max_distance: int = 15) -> Column:
    """First number after a position that starts within ``max_distance`` characters, at full length.

    ``number`` is the expression of a number. Digits glued to an asterisk or to other digits do not start one.
    """
    t, at = _col(text), _int(end) + 1
    pattern = rf"^[^*\d]{{1,{max_distance}}}({number})"
    reach = max_distance + 40

    def found(rest: Column) -> Column:
        return F.regexp_extract(rest, pattern, 1)

    near = F.substring(t, at, F.lit(reach))
    # a number that may go on beyond the stretch is read from the whole rest
    cut_off = F.length(F.regexp_extract(near, pattern, 0)) == reach
    return F.nullif(F.when(cut_off, found(F.substring(t, at, F.length(t)))).otherwise(found(near)), F.lit(""))


def mask(value: str | Column, char: str = "x") -> Column:
    """Every visible character replaced; blanks and length kept."""
    return F.regexp_replace(_col(value), r"[^\n\s]", char)


def mask_span(text: str | Column, start: int | Column, end: int | Column) -> Column:
    """Text with one span masked."""
    t = _col(text)
    tail = F.substring(t, _int(end) + 1, F.length(t))
    return F.concat(slice_text(t, 0, start), mask(slice_text(t, start, end)), tail)


def at_or_after_anchor(text: str | Column, start: int | Column, anchor: str) -> Column:
    """True where the position is at or after the first anchor, if that is past the start."""
    return at_or_after(anchor_position(text, anchor), start)


def anchor_position(text: str | Column, anchor: str) -> Column:
    """Position of the first anchor in any case, -1 for none; worked out once per text."""
    return F.instr(F.lower(_col(text)), anchor.lower()) - 1


def at_or_after(anchor: str | Column, start: int | Column) -> Column:
    """True where the position is at or after that of an anchor (:func:`anchor_position`), if that is past the start."""
    pos = _col(anchor)
    return (pos > 0) & (_int(start) >= pos)


def original_string_match(surface: str | Column, patterns: list[str]) -> Column:
    """True where the surface text matches one of the patterns from its start."""
    s = _col(surface)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | s.rlike(rf"(?d)\A(?:{p})")
    return hit


def _joined(text: Column, spans: Column, show: Callable[[Column], Column], start: str, end: str) -> Column:
    """Text with ``show`` of each span in place of it; pieces are joined once."""

    def build(ordered: Column) -> Column:
        since = lambda k: F.when(k > 0, F.get(ordered, k - 1)[end]).otherwise(0)
        pieces = F.transform(ordered, lambda x, k: F.concat(slice_text(text, since(k), x[start]), show(x)))
        last = F.coalesce(F.get(ordered, F.size(ordered) - 1)[end], F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    return let(F.array_sort(spans), build)


def highlight(text: str | Column, spans: Column, open_tag: str = "<em>", close_tag: str = "</em>") -> Column:
    """Text with every span of ``array<struct<start, end>>`` put into tags, in start order."""
    t = _col(text)
    tagged = lambda x: F.concat(F.lit(open_tag), slice_text(t, x["start"], x["end"]), F.lit(close_tag))
    return _joined(t, spans, tagged, "start", "end")


def snippet(text: str | Column, start: int | Column, end: int | Column, window: int = SNIPPET_WINDOW) -> Column:
    """One span in tags with a little text around it and ``...`` where text was left out."""
    t, s, e = _col(text), _int(start), _int(end)
    first = F.when(s > window, s - window).otherwise(s)
    last = F.least(e + window, F.length(t))
    return F.concat(
        F.when(first > 0, "...").otherwise(""),
        slice_text(t, first, s),
        F.lit("<em>"),
        slice_text(t, s, e),
        F.lit("</em>"),
        slice_text(t, e, last),
        F.when(last < F.length(t), "...").otherwise(""),
    )


def insert_marks(text: str | Column, marks: Column) -> Column:
    """Text with ``array<struct<pos, mark>>`` put in at their positions."""
    return _joined(_col(text), marks, lambda m: m["mark"], "pos", "pos")


def occurrences(text: str | Column, surface: str | Column) -> Column:
    """Start offsets of the surface text as whole words of any script, ignoring ASCII case."""
    t, s = _col(text), _col(surface)
    # a border is where word and non-word characters meet, so it depends on the end letters
    left = F.when(s.rlike(r"\A[\p{L}\p{N}_]"), r"(?<![\p{L}\p{N}_])").otherwise(r"(?<=[\p{L}\p{N}_])")
    right = F.when(s.rlike(r"[\p{L}\p{N}_]\z"), r"(?![\p{L}\p{N}_])").otherwise(r"(?=[\p{L}\p{N}_])")
    quoted = F.regexp_replace(s, r"([^A-Za-z0-9\s])", r"\\$1")
    gaps = F.split(t, F.concat(F.lit("(?i)"), left, quoted, right), -1)
    parts = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.length(s).alias("len"), s.alias("str")))
    every = F.transform(_placed(parts), lambda x: x["start"])
    # the piece behind the last match is not followed by one
    return let(every, lambda found: F.slice(found, F.lit(1), F.size(found) - 1))


def nearest(positions: Column, wanted: Column) -> Column:
    """The position nearest to the wanted one, the smaller of two; null for no positions."""
    return F.array_min(
        F.transform(positions, lambda p: F.struct(F.abs(p - wanted).alias("dist"), p.alias("pos")))
    )["pos"]


def relocate(text: str | Column, start: int | Column, end: int | Column, surface: str | Column) -> Column:
    """Struct of start and end, moved to the nearest whole-word occurrence of the surface.

    Nothing moves if the span already shows the surface text, or if it does not occur. Of two
    occurrences at the same distance the first is taken.
    """
    t, s, e, surf = _col(text), _int(start), _int(end), _col(surface)
    stay = F.struct(s.alias("start"), e.alias("end"))
    to = let(
        nearest(occurrences(t, surf), s),
        lambda p: F.struct(F.coalesce(p, s).alias("start"), F.when(p.isNull(), e).otherwise(p + F.length(surf)).alias("end")),
    )
    return F.when(slice_text(t, s, e) == surf, stay).otherwise(to)


def repair_quotes(json_text: str | Column) -> Column:
    """Escape bare double quotes inside the string features of an annotation JSON line.

    A value runs from behind its feature name to the quote behind which the next name or the end of the object
    stands. Names are those of :data:`schemas.RAW_ANNOTATION`.
    """
    t = _col(json_text)
    names = "|".join(schemas.RAW_ANNOTATION["features"].dataType.names)
    opened = rf'"(?:{names})"\s*:\s*"'
    closed = r'"\s*(?:,\s*"\w+"\s*:|\})'
    pattern = f"({opened})(.*?)(?={closed})"
    gaps = F.split(t, pattern, -1)
    heads = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    # quotes that are escaped already count as bare ones
    escaped = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("")), F.lit('"'), F.lit('\\"'))
    bare = lambda v: F.when(v.contains('"'), escaped(v)).otherwise(v)
    fixed = F.zip_with(heads, values, lambda h, v: F.concat(h, bare(v)))
    pairs = F.zip_with(gaps, fixed, lambda g, f: F.concat(g, F.coalesce(f, F.lit(""))))
    return F.array_join(pairs, "")


def cuis_in(text: str | Column) -> Column:
    """Concept ids written in a query string."""
    return F.regexp_extract_all(_col(text), F.lit(r"C\d{5,}"), F.lit(0))


def strip_namespace(uri: str | Column) -> Column:
    """Text after the last slash, without the vocabulary prefix."""
    return F.replace(F.substring_index(_col(uri), "/", -1), F.lit("UMLS:"), F.lit(""))


def padded_window(codes: Column, size: int, pad: int = 0) -> Column:
    """Array cut or filled to a fixed size."""
    return F.slice(F.concat(codes, F.array_repeat(F.lit(pad), size)), 1, size)


def collapse_runs(tags: Column) -> Column:
    """Array with repeated neighbours taken once."""
    before = F.concat(F.array(F.lit(None).cast("string")), tags)
    marked = F.zip_with(tags, before, lambda tag, prev: F.when(prev.isNull() | (tag != prev), tag))
    return F.filter(marked, lambda tag: tag.isNotNull())
