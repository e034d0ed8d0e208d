"""Row schemas.  Order is never implied: every ordered table has an ordinal column."""

from pyspark.sql import types as T

_texts = T.ArrayType(T.StringType())

CARD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("course", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("keywords", _texts),
        T.StructField("prerequisites", _texts),
        T.StructField("applicability", T.StringType()),
        T.StructField("steps", _texts),
        T.StructField("core_formula_latex", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("worked_example", T.StringType()),
        T.StructField("error_notes", _texts),
        T.StructField("source_page", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("reference_only", T.BooleanType()),
    ]
)
CARD_COLUMNS = CARD.fieldNames()
REQUIRED = ("id", "course", "chapter", "topic", "kind")
LIST_FIELDS = ("keywords", "prerequisites", "steps", "error_notes")
TEXT_FIELDS = (
    "applicability",
    "core_formula_latex",
    "technique",
    "worked_example",
    "source_page",
    "source_url",
)

QUESTION = T.StructType(
    [
        T.StructField("course", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expect_topics", _texts),
    ]
)

SUBTITLES = T.StructType(
    [
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tStartMs", T.LongType()),
                        T.StructField("dDurationMs", T.LongType()),
                        T.StructField(
                            "segs",
                            T.ArrayType(T.StructType([T.StructField("utf8", T.StringType())])),
                        ),
                    ]
                )
            ),
        )
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

TURN = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("sid", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
