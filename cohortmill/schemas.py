"""Explicit types at every boundary; unknown input features are dropped."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("doc_date", T.TimestampType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("src_table", T.StringType()),
        T.StructField("src_col", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

_NODE = T.StructType([T.StructField("offset", T.IntegerType())])

# one annotation as an NLP tool writes it; the feature names are fixed by the format
RAW_ANNOTATION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("startNode", _NODE),
        T.StructField("endNode", _NODE),
        T.StructField(
            "features",
            T.StructType(
                [
                    T.StructField(name, T.StringType())
                    for name in (
                        "inst",
                        "STY",
                        "PREF",
                        "Negation",
                        "Temporality",
                        "Experiencer",
                        "string_orig",
                        "majorType",
                        "minorType",
                    )
                ]
            ),
        ),
    ]
)

ANNOTATION_LINE = T.StructType(
    [
        T.StructField("docId", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.ArrayType(RAW_ANNOTATION))),
    ]
)

CLOSURE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("cui", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_file", T.StringType()),
        T.StructField("rule_idx", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("case_sensitive", T.BooleanType()),
        T.StructField("containing", T.BooleanType()),
        T.StructField("prev_ctx", T.BooleanType()),
        T.StructField("next_ctx", T.BooleanType()),
    ]
)
