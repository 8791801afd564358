"""Readers for documents, annotations, lookup tables and database queries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill import scale, schemas
from cohortmill.functions import codes
from cohortmill.functions import text as tx


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Result of a SQL text on a database.

    For big results give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` (then the query goes in as a derived table), so that it is read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if "partitionColumn" in options:
        return reader.option("dbtable", f"({query}) q").load()
    return reader.option("query", query).load()


def parse_annotation_lines(lines: DataFrame, column: str = "value", *, repair: bool = True) -> DataFrame:
    """Parsed annotation lines ``docId, annotations`` with the raw line in ``bad`` if it fails.

    With ``repair`` lines that do not parse get one more try with their bare quotes escaped.
    """
    text = F.col(column)
    schema = schemas.ANNOTATION_LINE

    def checked(parsed: Column) -> Column:
        again = F.from_json(tx.repair_quotes(text), schema)
        return F.when(parsed["docId"].isNull(), again).otherwise(parsed) if repair else parsed

    # unfolding a one-item array keeps Spark from parsing the line again for every field
    rows = lines.select(text, F.explode_outer(F.transform(F.array(F.from_json(text, schema)), checked)).alias("_j"))
    return rows.select(
        F.col("_j.docId").alias("docId"),
        F.col("_j.annotations").alias("annotations"),
        F.when(F.col("_j.docId").isNull(), text).alias("bad"),
    )


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line."""
    return parse_annotation_lines(spark.read.text(path))


def read_annotation_files(spark: SparkSession, folder: str, *, key: str = r"([^/]+)\.json$") -> DataFrame:
    """One JSON document per file; the document id comes from the file name."""
    files = spark.read.schema(schemas.ANNOTATION_LINE).option("multiLine", True).json(folder)
    return files.select(F.regexp_extract(F.input_file_name(), key, 1).alias("docId"), "annotations")


def _spans(parsed: DataFrame) -> DataFrame:
    flat = parsed.where("bad IS NULL") if "bad" in parsed.columns else parsed
    # an inner explode would make Spark parse the line again to test for emptiness
    spans = flat.select(
        F.col("docId").alias("doc_id"), F.posexplode_outer(F.flatten("annotations")).alias("input_no", "a")
    )
    return spans.where("a IS NOT NULL")


# fixed values: annotation types of the input format
CONCEPT_TYPE, PHENOTYPE_TYPE, SENTENCE_TYPE = "Mention", "Phenotype", "Sentence"


def concept_mentions(parsed: DataFrame) -> DataFrame:
    """Concept mentions with ids ``cui-N`` in input order."""
    rows = _spans(parsed).where(F.col("a.type") == CONCEPT_TYPE)
    return rows.select(
        "doc_id",
        "input_no",
        F.col("a.startNode.offset").alias("start_pos"),
        F.col("a.endNode.offset").alias("end_pos"),
        F.col("a.features.string_orig").alias("str"),
        F.col("a.features.inst").alias("cui"),
        F.col("a.features.STY").alias("sty"),
        F.col("a.features.PREF").alias("pref"),
        F.col("a.features.Negation").alias("negation"),
        F.col("a.features.Temporality").alias("temporality"),
        F.col("a.features.Experiencer").alias("experiencer"),
    )


def phenotype_mentions(parsed: DataFrame) -> DataFrame:
    """Phenotype mentions with their major and minor type."""
    rows = _spans(parsed).where(F.col("a.type") == PHENOTYPE_TYPE)
    return rows.select(
        "doc_id",
        "input_no",
        F.col("a.startNode.offset").alias("start_pos"),
        F.col("a.endNode.offset").alias("end_pos"),
        F.col("a.features.string_orig").alias("str"),
        F.col("a.features.majorType").alias("major_type"),
        F.col("a.features.minorType").alias("minor_type"),
        F.col("a.features.Negation").alias("negation"),
        F.col("a.features.Temporality").alias("temporality"),
        F.col("a.features.Experiencer").alias("experiencer"),
    )


def sentence_table(parsed: DataFrame) -> DataFrame:
    """Sentence spans."""
    rows = _spans(parsed).where(F.col("a.type") == SENTENCE_TYPE)
    return rows.select(
        "doc_id",
        "input_no",
        F.col("a.startNode.offset").alias("sent_start"),
        F.col("a.endNode.offset").alias("sent_end"),
    )


# fixed values: the character sets that Spark decodes itself
JVM_CHARSETS = {"us-ascii", "iso-8859-1", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32"}


def decoded(content: str, encoding: str) -> Column:
    """Text of a binary column; other character sets go through an Arrow batch function."""
    if encoding.lower() in JVM_CHARSETS:
        return F.decode(content, encoding)

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode(encoding))

    return decode(content)


def read_documents(spark: SparkSession, folder: str, *, key: str = r"([^/]+)$", encoding: str = "utf-8") -> DataFrame:
    """Text files of a folder: ``doc_id`` from the file name and the whole text, decoded once."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        F.regexp_extract("path", key, 1).alias("doc_id"), decoded("content", encoding).alias("text")
    )


def load_documents_with_patients(docs: DataFrame, doc_to_patient: DataFrame) -> DataFrame:
    """Documents that the ``(doc_id, pid)`` table knows, with their patient."""
    return docs.join(doc_to_patient.select("doc_id", "pid"), "doc_id")


def read_lookup_tsv(
    spark: SparkSession, path: str, columns: Sequence[str], *, sep: str = "\t", header: bool = False
) -> DataFrame:
    """Lookup table with string columns; the raw line stays in ``bad`` if its width is wrong."""
    lines = spark.read.text(path)
    return parse_lookup_lines(lines, columns, sep=sep, header=header)


def parse_lookup_lines(
    lines: DataFrame, columns: Sequence[str], *, column: str = "value", sep: str = "\t", header: bool = False
) -> DataFrame:
    """Columns of separated lines; see :func:`read_lookup_tsv`."""
    parts = F.split(F.col(column), "\\Q" + sep + "\\E", -1)
    good = F.size(parts) == len(columns)
    rows = lines.select(
        *[F.when(good, parts[i]).alias(c) for i, c in enumerate(columns)],
        F.when(~good, F.col(column)).alias("bad"),
    )
    if header:
        rows = rows.where(F.coalesce(F.col(columns[0]) != columns[0], F.lit(True)))
    return rows


def read_episodes(spark: SparkSession, path: str, *, fmt: str = "dd/MM/yyyy HH:mm") -> DataFrame:
    """Episode file: patient and start and end of three windows."""
    names = ["pid", "win1_s", "win1_e", "win2_s", "win2_e", "win3_s", "win3_e"]
    rows = read_lookup_tsv(spark, path, names).where("bad IS NULL")
    times = [codes.parse_time(n, fmt).alias(n) for n in names[1:]]
    # the id depends on the line alone, not on how the file is split
    return rows.select(F.xxhash64(*names).alias("ep_id"), "pid", *times)


def extract_cohort_docs(docs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Documents with text of the listed patients."""
    return docs.where("text IS NOT NULL").join(scale.bounded_broadcast(cohort.select("pid").distinct()), "pid", "left_semi")


def copy_missing(src: DataFrame, dest: DataFrame, keys: Sequence[str], *, wanted: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Rows to append to ``dest``: the wanted ones it does not hold (all wanted with overwrite)."""
    rows = src if wanted is None else src.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return rows if overwrite else rows.join(dest.select(*keys).distinct(), list(keys), "left_anti")


def search_scan(docs: DataFrame, predicate, fields: Sequence[str]) -> DataFrame:
    """Fields of the rows that satisfy the predicate; both reach the scan."""
    return docs.where(predicate).select(*fields)


def upsert_concepts(dim: DataFrame, incoming: DataFrame, *, key: str = "ctx_id", version: str = "version") -> DataFrame:
    """Dimension with the latest version of every key."""
    rows = dim.unionByName(incoming)
    latest = F.max(F.struct(version, *[c for c in dim.columns if c not in (key, version)]))
    return rows.groupBy(key).agg(latest.alias("r")).select(key, "r.*")


def update_doc_attributes(docs: DataFrame, updates: DataFrame, columns: Sequence[str], *, key: str = "doc_id") -> DataFrame:
    """Documents with the new values of the given columns where an update has one."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = docs.join(new, key, "left")
    changed = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    return joined.withColumns(changed).drop(*[f"_new_{c}" for c in columns])


def patients_by_code(diagnoses: DataFrame, patients: DataFrame, code: str) -> DataFrame:
    """Distinct patients with a diagnosis code."""
    hit = diagnoses.where(F.col("code") == code).select("pid").distinct()
    return patients.join(hit, "pid", "left_semi").distinct()


def admissions_by_code(diagnoses: DataFrame, admissions: DataFrame, code: str) -> DataFrame:
    """Distinct admissions with a diagnosis code."""
    hit = diagnoses.where(F.col("code") == code).select("adm_id").distinct()
    return admissions.join(hit, "adm_id", "left_semi").distinct()


def events_by_admission(events: DataFrame, items: DataFrame, adm_id=None) -> DataFrame:
    """Events with their item's label, in item and time order, of one admission if given."""
    rows = events if adm_id is None else events.where(F.col("adm_id") == adm_id)
    return rows.join(scale.bounded_broadcast(items), "item_id").orderBy("item_id", "event_time")
