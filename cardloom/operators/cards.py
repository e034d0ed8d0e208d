"""Card records: validation of raw JSON, first-wins dedup with numbering, flags and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom import fixed_values as fixed
from cardloom.functions.text import strip
from cardloom.scale import running, sized_block
from cardloom.schema import CARD, CARD_COLUMNS, LIST_FIELDS, REQUIRED, TEXT_FIELDS

_PARSED = T.StructType([*CARD.fields, T.StructField("_corrupt", T.StringType())])


def strip_code_fence(text: Column) -> Column:
    """Content of the first code fence, else the text; trimmed."""
    fenced = F.regexp_extract(text, r"(?Us)```(?:json)?\s*(.*?)\s*```", 1)
    return strip(F.when(text.rlike(r"(?Us)```(?:json)?\s*(.*?)\s*```"), fenced).otherwise(text))


def parse_cards(
    df: DataFrame, raw: str = "raw_json", course: Column | None = None, chapter: Column | None = None
) -> DataFrame:
    """Adds ``card`` (struct) and ``error`` (null for a valid record).

    ``course``/``chapter`` fill these two fields where the record lacks them.
    Other missing optional fields get their defaults; an explicit null does not.
    """
    parsed = df.withColumn(
        "_p",
        F.from_json(raw, _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    ).withColumn("_keys", F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))

    def present(name: str) -> Column:
        return F.array_contains("_keys", name)

    def filled(name: str) -> Column:
        value = F.col(f"_p.{name}")
        given = {"course": course, "chapter": chapter}.get(name)
        if given is not None:
            return F.when(present(name), value).otherwise(given)
        if name in LIST_FIELDS:
            return F.when(present(name), value).otherwise(F.array().cast("array<string>"))
        if name in TEXT_FIELDS:
            return F.when(present(name), value).otherwise(F.lit(""))
        if name == "reference_only":
            return F.when(present(name), value).otherwise(F.lit(False))
        return value

    built = parsed.withColumn("card", F.struct(*[filled(n).alias(n) for n in CARD_COLUMNS]))
    error = F.when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), F.lit("malformed"))
    for name in REQUIRED:
        error = error.when(F.col(f"card.{name}").isNull(), F.lit(f"missing {name}"))
    error = error.when(~F.col("card.kind").isin(*fixed.KINDS), F.lit("unknown kind"))
    for name in (*TEXT_FIELDS, "reference_only"):
        error = error.when(F.col(f"card.{name}").isNull(), F.lit(f"null {name}"))
    for name in LIST_FIELDS:
        null_item = F.exists(F.col(f"card.{name}"), lambda x: x.isNull())
        error = error.when(F.col(f"card.{name}").isNull() | null_item, F.lit(f"bad {name}"))
    return built.withColumn("error", error).drop("_p", "_keys")


def valid_cards(parsed: DataFrame, *keep: str | Column) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).select("card.*", *keep)


def rejects(parsed: DataFrame) -> DataFrame:
    """Records that failed, with the reason; a side output instead of a silent loss."""
    return parsed.filter(F.col("error").isNotNull()).drop("card")


def dedup_cards(cards: DataFrame, order: list[str]) -> DataFrame:
    """First card per (course, chapter, topic, kind).  Copies are reduced map-side before the shuffle."""
    keys = ["course", "chapter", "topic", "kind"]
    rest = [c for c in cards.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return cards.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*cards.columns)


def number_cards(cards: DataFrame, order: list[str], block: Column | None = None) -> DataFrame:
    """Ids ``course|chapter|NNN`` in order within (course, chapter); ``block`` spreads a hot chapter."""
    counted = running(cards, ["course", "chapter"], order, {"_n": ("sum", F.lit(1).cast("bigint"))}, block)
    number = F.concat_ws("|", "course", "chapter", F.format_string("%03d", "_n"))
    return counted.withColumn("id", number).drop("_n")


def dedup_and_number(cards: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Dedup, then ids.  The chapter sizes before dedup decide whether numbering is blocked."""
    block = sized_block(cards, ["course", "chapter"], F.col(ordinal).cast("double"))
    return number_cards(dedup_cards(cards, [ordinal]), [ordinal], block)


def is_reference_noise() -> Column:
    """Already flagged, or wording about the book itself in topic, applicability, technique or steps."""
    text = F.concat_ws(" ", "topic", "applicability", "technique", F.concat_ws(" ", "steps"))
    return F.coalesce("reference_only", F.lit(False)) | text.rlike(fixed.REFERENCE_NOISE)


def flag_reference(cards: DataFrame) -> DataFrame:
    return cards.withColumn("reference_only", is_reference_noise())


def flag_preview(cards: DataFrame, show: int | None = None) -> DataFrame:
    """Cards that flagging would change; ``show`` lists only so many (20 on screen)."""
    found = cards.filter(~F.coalesce("reference_only", F.lit(False)) & is_reference_noise())
    return found.limit(show) if show else found


def summary_line() -> Column:
    return F.format_string("[%s] %s（%s）", "kind", "topic", "chapter")


# ---- upsert -----------------------------------------------------------------

_KEY = ["course", "id"]


def last_per_id(incoming: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Last record per id, at the position of the first one."""
    rest = [c for c in incoming.columns if c not in (*_KEY, ordinal)]
    return (
        incoming.groupBy(*_KEY)
        .agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_last"), F.min(ordinal).alias(ordinal))
        .select(*_KEY, "_last.*", ordinal)
    )


def upsert(existing: DataFrame, incoming: DataFrame, ordinal: str = "ord", end: int | None = None) -> DataFrame:
    """Union by (course, id): incoming wins, first-seen position is kept, new cards go to the end.

    ``end`` is the last position taken, for callers that pass a part of the table.

    One full outer join of two sides with unique keys; the result carries ``is_new``.
    """
    end = existing.agg(F.max(ordinal)).first()[0] if end is None else end
    offset = 0 if end is None else end + 1
    rest = [c for c in existing.columns if c not in (*_KEY, ordinal)]
    old = existing.select(*_KEY, F.struct(*rest).alias("_old"), F.col(ordinal).alias("_old_ord"))
    new = last_per_id(incoming.select(*existing.columns), ordinal).select(
        *_KEY, F.struct(*rest).alias("_new"), F.col(ordinal).alias("_new_ord")
    )
    joined = old.join(new, _KEY, "full_outer")
    return joined.select(
        *_KEY,
        F.coalesce("_new", "_old").alias("_row"),
        F.coalesce("_old_ord", F.col("_new_ord") + F.lit(offset)).alias(ordinal),
        F.col("_old_ord").isNull().alias("is_new"),
    ).select(*_KEY, "_row.*", ordinal, "is_new")


def new_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids not seen before, per course; copies in the batch count once."""
    fresh = incoming.select(*_KEY).distinct().join(existing.select(*_KEY), _KEY, "left_anti")
    return fresh.groupBy("course").agg(F.count("*").alias("n_new"))


def course_counts(cards: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Cards per course; ``names`` (column course) keeps listed courses without cards."""
    counted = cards.groupBy("course").agg(F.count("*").alias("n_cards"))
    if names is None:
        return counted
    return names.join(counted, "course", "left").withColumn("n_cards", F.coalesce("n_cards", F.lit(0).cast("bigint")))


def find_cards(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookup of many ids (course, id)."""
    return cards.join(wanted.select(*_KEY).distinct(), _KEY, "left_semi")
