"""Writers for results and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import context as cx
from cohortmill.operators.validation import numbered_mentions


def write_table(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Write as tsv (with header), json or parquet; one file per partition."""
    if fmt == "tsv":
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def sample_lines(samples: DataFrame, key: str) -> DataFrame:
    """Samples as JSON lines ``key, value`` for the validation pages."""
    return samples.select(key, F.to_json(F.struct(*[c for c in samples.columns if c != key])).alias("value"))


def standoff_lines(mentions: DataFrame, *, positive_rule: str = "", negation_rule: str = "") -> DataFrame:
    """Stand-off lines ``doc_id, line_no, kind, line``: terms ``T…`` and contexts ``A…``.

    One row per line and not one string per document, so that a document of any size is written
    in order by its task without being held whole.
    """
    rows = numbered_mentions(mentions)
    ruled = F.array_compact(F.array("ruled_by"))
    ctx = cx.simple_context(ruled, positive_rule, negation_rule)
    rows = rows.withColumn("_ctx", ctx).withColumn("_type", cx.simple_type())
    no = F.col("no").cast("string")
    term = F.concat(
        F.lit("T"), no, F.lit("\t"), "_type", F.lit(" "), F.col("start_pos").cast("string"), F.lit(" "),
        F.col("end_pos").cast("string"), F.lit("\t"), "str",
    )
    mark = F.concat(F.lit("A"), no, F.lit("\t"), "_ctx", F.lit(" T"), no)
    items = F.array(
        F.struct(F.lit("T").alias("kind"), term.alias("line")),
        F.struct(F.lit("A").alias("kind"), F.when(F.col("_ctx") != "", mark).alias("line")),
    )
    lines = rows.select("doc_id", F.col("no").alias("line_no"), F.inline(items))
    return lines.where("line IS NOT NULL")


def xml_lines(mentions: DataFrame, *, id_prefix: str = "mention") -> DataFrame:
    """Annotation elements ``doc_id, line_no, line``, one per mention, for the XML tool format."""
    rows = numbered_mentions(mentions)
    mention_id = F.concat(F.lit(f"{id_prefix}-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("no").cast("string"))

    def esc(c: str):
        text = F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.replace(F.replace(text, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    ctx = F.when(F.col("negation") != "Affirmed", F.col("negation")).otherwise("")
    line = F.concat(
        F.lit('<annotation><mention id="'), mention_id, F.lit('" /><span start="'), F.col("start_pos").cast("string"),
        F.lit('" end="'), F.col("end_pos").cast("string"), F.lit('" /><spannedText>'), esc("str"),
        F.lit('</spannedText></annotation><classMention id="'), mention_id, F.lit('"><mentionClass id="'),
        ctx, F.lit("_"), cx.simple_type(), F.lit('">'), esc("str"), F.lit("</mentionClass></classMention>"),
    )
    return rows.select("doc_id", F.col("no").alias("line_no"), line.alias("line"))


def write_standoff(lines: DataFrame, path: str) -> None:
    """Write lines ``doc_id<tab>line`` as text, documents and lines in order over all files.

    Ranges of (document, line) go to the tasks, so the lines of a very large document come from
    several tasks, and the number of files does not grow with the number of documents.
    """
    order = [F.col("doc_id")]
    if "kind" in lines.columns:
        order.append(F.desc("kind"))
    order.append(F.col("line_no"))
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line")).write.mode("overwrite").text(path)


def entity_types(mentions: DataFrame) -> DataFrame:
    """Distinct entity types."""
    return mentions.select(cx.simple_type().alias("entity_type")).distinct()
