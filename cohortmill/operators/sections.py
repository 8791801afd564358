"""Sections of clinical summaries, their mentions and the measurements in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import text as tx
from cohortmill.operators.validation import latest_document

# a line that holds only a title and a colon
HEADER = r"(?md)^([^\n:]+):$"


def section_headings(docs: DataFrame, *, pattern: str = HEADER) -> DataFrame:
    """How often each heading occurs, title as written."""
    titles = docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("title"))
    return titles.where("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("freq"))


def merged_headings(headings: DataFrame, *, k: int | None = None, number_only: bool = False) -> DataFrame:
    """Headings merged by normalised title, most frequent first."""
    merged = headings.groupBy(tx.normalise_title("title", number_only).alias("title")).agg(
        F.sum("freq").cast("long").alias("freq")
    )
    ranked = merged.orderBy(F.desc("freq"), "title")
    return ranked if k is None else ranked.limit(k)


def parse_sections(
    docs: DataFrame,
    section_map: dict[str, str],
    *,
    pattern: str = HEADER,
    number_only: bool = False,
) -> DataFrame:
    """One row per section: from a mapped header to the next mapped one or the end of the text.

    ``section_map`` maps normalised titles to section names. Text before the first mapped header
    is a section with a blank name; a document without any header has no sections. Headers that
    are not mapped stay inside their section.
    """
    # the map is configuration of a few dozen titles and enters as a literal
    pairs = [F.lit(x) for item in section_map.items() for x in item]
    names = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    heads = tx.find_spans("text", pattern, 1)

    def name_of(h: Column) -> Column:
        return names[tx.normalise_title(h["str"], number_only)]

    mapped = F.transform(
        F.filter(heads, lambda h: name_of(h).isNotNull()),
        lambda h: F.struct(
            h["start"].alias("start"), h["end"].alias("header_end"),
            name_of(h).alias("section"), h["str"].alias("original_section"),
        ),
    )
    none = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("header_end"),
        F.lit("").alias("section"), F.lit("").alias("original_section"),
    )
    # headers are found on the line before the list is used, so the text is scanned once
    rows = docs.withColumn("_heads", F.when(F.size(heads) > 0, F.concat(F.array(none), mapped)))
    one = rows.select("*", F.posexplode_outer("_heads").alias("sec_no", "h")).where("h IS NOT NULL")
    following = F.get("_heads", F.col("sec_no") + 1)["start"]
    return one.select(
        *[c for c in docs.columns if c != "text"],
        "sec_no",
        F.col("h.section").alias("section"),
        F.col("h.original_section").alias("original_section"),
        F.col("h.start").alias("start"),
        F.col("h.header_end").alias("header_end"),
        F.coalesce(following, F.length("text")).alias("end"),
        tx.slice_text("text", F.col("h.start"), F.coalesce(following, F.length("text"))).alias("text"),
    )


def section_extents(headers: DataFrame) -> DataFrame:
    """Extents from a header table ``(doc_id, start, text_length)``: up to the next header or the end.

    Headers of one document are bounded by its text and travel as one sorted array.
    """
    per_doc = headers.groupBy("doc_id").agg(
        F.sort_array(F.collect_list("start")).alias("starts"), F.max("text_length").alias("len")
    )
    one = per_doc.select("doc_id", "starts", "len", F.posexplode("starts").alias("i", "start"))
    return one.select("doc_id", "start", F.coalesce(F.get("starts", F.col("i") + 1), F.col("len")).alias("end"))


def section_type_counts(section_mentions: DataFrame, sections: Sequence[str]) -> DataFrame:
    """``section, sty, n`` of the chosen sections; the blank type is the section total."""
    chosen = section_mentions.where(F.col("section").isin(*sections))
    by_type = chosen.groupBy("section", "sty").agg(F.count("*").alias("n"))
    total = by_type.groupBy("section").agg(F.sum("n").alias("n"))
    return by_type.unionByName(total.select("section", F.lit("").alias("sty"), "n"))


def extract_measurements(
    section_mentions: DataFrame,
    docs: DataFrame,
    *,
    sections: Sequence[str],
    types: Sequence[str],
    number: str,
    max_distance: int = 15,
) -> DataFrame:
    """Mentions of the chosen sections and types with the first number (an expression) close behind them."""
    chosen = section_mentions.where(F.col("section").isin(*sections) & F.col("sty").isin(*types))
    rows = scale.skew_join(chosen, docs.select("doc_id", "text"), "doc_id")
    value = tx.first_number("text", F.col("end_pos"), number, max_distance)
    return rows.withColumn("value", value).drop("text").where("value IS NOT NULL")


def last_measurement(measurements: DataFrame) -> DataFrame:
    """One value per patient and concept name: the last one in the text."""
    last = F.max_by("value", F.struct("doc_id", "start_pos"))
    return measurements.groupBy("pid", "pref").agg(last.alias("value"))


def medical_profile(docs: DataFrame, section_map: dict[str, str], *, doc_type: str | None = None, pattern: str = HEADER) -> DataFrame:
    """Sections of each patient's latest summary as one map; blank names become ``basic``.

    One document per patient, so the map is bounded by that document.
    """
    newest = latest_document(docs, doc_type=doc_type).select("pid", "doc_id")
    summaries = docs.select("doc_id", "text").join(newest, "doc_id")
    secs = parse_sections(summaries, section_map, pattern=pattern)
    key = F.when(F.col("section") == "", "basic").otherwise(F.regexp_replace("section", " ", "_"))
    # a section name that occurs twice keeps its last text
    per_name = secs.groupBy("pid", "doc_id", key.alias("name")).agg(F.max_by("text", "sec_no").alias("text"))
    return per_name.groupBy("pid", "doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("profile")
    )


def markup_to_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Readable text of markup: tables and code dropped, block ends turned into line breaks.

    Title and section heads get a line break before and a full stop behind.
    """
    t = F.col(column)
    for tag in ("table", "script", "style", "head", "nav"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:title|sec|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:title|sec|h[1-6])\s*>", ".\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|li|article|section|footer)\s*>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return pages.withColumn("text", F.trim(t))


def split_records(texts: DataFrame, separator: str, *, id_group: int = 1) -> DataFrame:
    """Records of a combined dump: ``rec_id, text`` from ``text`` and a separator with the id.

    The separator starts a record and holds its id in the given group; text before the first
    separator is no record.
    """
    ids = F.regexp_extract_all("text", F.lit(separator), F.lit(id_group))
    bodies = F.split("text", separator, -1)
    pairs = F.arrays_zip(ids.alias("rec_id"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("text"))
    return texts.select(F.inline(pairs))
