"""Clinical-shaped frames derived from the driver's parquet tables.

The driver has no clinical tables. Orders act as documents, customers as patients, line items
as concept mentions, parts as concepts; ``documents`` and ``pages`` give the running text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill import scale
from cohortmill.functions import context as cx
from cohortmill.operators import ontology, search, textmine

# study concepts of the fixture: name, priority, seed concept
SEEDS = [("S1", 1, 1), ("S2", 2, 12), ("S3", 3, 2), ("S4", 4, 3), ("S5", 5, 4)]
STUDY_NAMES = [name for name, _, _ in SEEDS]

# dictionary of the text fixture: term, concept, semantic type, preferred label
GAZETTEER = [
    ("thatin", "C9000001", "Disease or Syndrome", "Thatin"),
    ("ononst", "C9000002", "Disease or Syndrome", "Ononst"),
    ("inoran", "C9000003", "Sign or Symptom", "Inoran"),
    ("hehely", "C9000004", "Laboratory Procedure", "Hehely"),
    ("orantion", "C9000005", "Pharmacologic Substance", "Orantion"),
    ("of", "C9000006", "Finding", "Of"),
    ("of the", "C9000007", "Body Part, Organ", "Of The"),
]

# tables written once per application and folder, as an earlier stage of a real job would
_written: dict[tuple[str, str, str], DataFrame] = {}


def cui_of(number: str | Column) -> Column:
    """Concept id of a part key."""
    n = F.col(number) if isinstance(number, str) else number
    return F.format_string("C%07d", n.cast("long"))


class Tables:
    """Access to the raw tables of one folder and to the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def config(self, rows: list, schema: str) -> DataFrame:
        """A frame of fixed configuration rows."""
        return self.spark.createDataFrame(rows, schema)

    def state(self) -> str:
        """Names, sizes and times of the tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return str(hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame written to the shared folder the first time it is asked for, and again when the tables change."""
        key = (self.spark.sparkContext.applicationId, f"{self.folder} {self.state()}", name)
        if key not in _written:
            _written[key] = scale.cut(build())
        return _written[key]

    @cached_property
    def patients(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("cohort")
        )

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_custkey").alias("pid"),
            F.col("o_orderdate").alias("doc_date"),
            F.col("o_orderpriority").alias("doc_type"),
            F.col("o_orderstatus").alias("src_table"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        start = (F.col("l_quantity").cast("int") * 20 + F.col("l_linenumber")).cast("int")
        return (
            self.raw("lineitem")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("doc_id"),
                F.col("l_partkey").alias("cui_num"),
                cui_of("l_partkey").alias("cui"),
                F.col("p_name").alias("str"),
                F.col("p_type").alias("sty"),
                F.col("p_brand").alias("pref"),
                start.alias("start_pos"),
                (start + F.length("p_name")).alias("end_pos"),
                F.when(F.col("l_returnflag") == "N", "Negated").otherwise("Affirmed").alias("negation"),
                F.when(F.col("l_linestatus") == "F", "historical").otherwise("Recent").alias("temporality"),
                F.when(F.col("l_suppkey") % 10 == 0, "Other").otherwise("Patient").alias("experiencer"),
                F.when(F.col("l_tax") >= 0.07, "rule_a")
                .when(F.col("l_discount") >= 0.09, "rule_b")
                .alias("ruled_by"),
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Ten-ary concept tree: the parent is the key without its last digit."""
        return self.raw("part").where("p_partkey >= 10").select(
            cui_of(F.floor(F.col("p_partkey") / 10).cast("long")).alias("parent"),
            cui_of("p_partkey").alias("child"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Concept dimension: one label per concept."""
        return self.raw("part").select(
            cui_of("p_partkey").alias("cui"),
            F.col("p_name").alias("label"),
            F.col("p_type").alias("sty"),
        )

    @cached_property
    def seeds(self) -> DataFrame:
        return self.config(SEEDS, "name string, priority int, seed int").select(
            "name", "priority", cui_of("seed").alias("cui")
        )

    @property
    def closure(self) -> DataFrame:
        """Study concepts with all concepts below their seeds; written once per folder."""
        return self.written(
            "closure", lambda: ontology.transitive_closure(self.seeds, self.edges, keys=["name", "priority"])
        )

    @property
    def exclusive(self) -> DataFrame:
        """Closure in which every concept belongs to its last study concept only."""
        return ontology.exclusive_concepts(self.closure)

    @cached_property
    def index_dates(self) -> DataFrame:
        """First document date of each patient."""
        return self.docs.groupBy("pid").agg(F.min("doc_date").alias("index_date"))

    @cached_property
    def windows(self) -> DataFrame:
        """180 days around the first document."""
        return self.index_dates.select(
            "pid",
            (F.col("index_date") - F.expr("INTERVAL 180 DAYS")).alias("t0"),
            (F.col("index_date") + F.expr("INTERVAL 180 DAYS")).alias("t1"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """One validation label per annotated span of the documents in ``labels``."""
        label = (
            F.when(F.col("toxic") == 1, "wrongM")
            .when((F.col("quality") == 0) & (F.col("start_pos") % 2 == 0), "hypoM")
            .otherwise(cx.ctx_class_ui())
        )
        return (
            self.mentions.join(self.raw("labels"), "doc_id")
            .withColumn("label", label)
            .groupBy("doc_id", "start_pos", "end_pos")
            .agg(F.min("label").alias("label"))
            .withColumn("annotator", F.concat(F.lit("team_"), (F.col("doc_id") % 3).cast("string")))
        )

    @cached_property
    def gazetteer(self) -> DataFrame:
        return self.config(GAZETTEER, "term string, cui string, sty string, pref string")

    @cached_property
    def text_docs(self) -> DataFrame:
        """Running text; the source acts as the patient."""
        docs = self.raw("documents").select("doc_id", F.col("source").alias("pid"), "lang", "text")
        return scale.spread_small_input(docs)

    @cached_property
    def text_mentions(self) -> DataFrame:
        """Dictionary mentions in the running text, with a context class by position."""
        return self.written("text_mentions", lambda: self.tag(self.text_docs))

    def tag(self, docs: DataFrame) -> DataFrame:
        """Tag documents."""
        s, d = F.col("start_pos"), F.col("doc_id")
        return textmine.dictionary_annotate(docs, self.gazetteer).select(
            "doc_id",
            "cui",
            "sty",
            "pref",
            "str",
            "start_pos",
            "end_pos",
            F.when(s % 4 == 0, "Negated").otherwise("Affirmed").alias("negation"),
            F.when((d + s) % 5 == 0, "historical")
            .when((d + s) % 7 == 0, "hypothetical")
            .otherwise("Recent")
            .alias("temporality"),
            F.when(s % 11 == 0, "Other").otherwise("Patient").alias("experiencer"),
        )

    @property
    def text_index(self) -> search.TextIndex:
        """Index of the words of the running text; written once per folder."""
        place = self.written("text_index", self._index_text)
        return search.TextIndex(self.spark, place.first()["path"])

    def _index_text(self) -> DataFrame:
        index = search.TextIndex(self.spark, scale.job_folder(self.spark, "text_index")).write(self.text_docs)
        return self.config([(index.path,)], "path string")

    @cached_property
    def events(self) -> DataFrame:
        """Event stream rows as dated annotations."""
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("pid"),
            F.col("event_type").alias("concept"),
            "ts",
            F.floor("value").cast("long").alias("value"),
        )
