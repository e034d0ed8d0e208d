"""Text output: method blocks, prompts, previews, mind map and review notes.

Blocks are built per card row; only the few hits of one question are ever
joined into one string.  Course-sized documents stay ordered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.functions.text import cut, exact_round, squash


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _labelled(label: str, text: Column, shown: Column | None = None, tail: str = "") -> Column:
    return F.when(_given(text), F.concat(F.lit(label), text if shown is None else shown, F.lit(tail)))


def _numbered(items: Column, pattern: str) -> Column:
    return F.transform(items, lambda s, i: F.format_string(pattern, (i + 1).cast("int"), s))


def method_block(rank: Column, example_max: int = fixed.RENDER_EXAMPLE_CHARS) -> Column:
    """One hit as text; empty fields leave no line."""
    c = F.col
    return F.concat_ws(
        "\n",
        F.format_string(fixed.METHOD_HEAD, rank, F.format_number("score", 2), "chapter", "topic"),
        F.concat(F.lit(fixed.METHOD_KIND), "kind"),
        _labelled(fixed.METHOD_APPLIES, c("applicability")),
        F.when(
            F.size("steps") > 0,
            F.concat(F.lit(fixed.METHOD_STEPS), F.array_join(_numbered(c("steps"), "   %d. %s"), "\n")),
        ),
        _labelled(fixed.METHOD_FORMULA, c("core_formula_latex"), tail="$"),
        _labelled(fixed.METHOD_TECHNIQUE, c("technique")),
        _labelled(fixed.METHOD_EXAMPLE, c("worked_example"), cut(c("worked_example"), example_max, " ……")),
        F.when(F.size("error_notes") > 0, F.concat(F.lit(fixed.METHOD_PITFALLS), F.array_join("error_notes", "；"))),
    )


def render_methods(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """``hits`` with card payload, rank-numbered per qid  ->  qid, methods_text, n_methods, top_score."""
    shown = hits if limit is None else hits.filter(F.col("rank") <= limit)
    blocks = shown.withColumn("_block", method_block(F.col("rank").cast("int")))
    return blocks.groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "_block"))), lambda b: b["_block"]), "\n"
        ).alias("methods_text"),
        F.count("*").alias("n_methods"),
        F.max("score").alias("top_score"),
    )


def _filled(template: str, course: Column) -> Column:
    """Template text with every ``{course}`` replaced."""
    parts = template.split("{course}")
    pieces: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [course, F.lit(part)]
    return F.concat(*pieces)


def ask_prompt(course: Column, question: Column, methods_text: Column) -> tuple[Column, Column]:
    """System and user text; without hits the user text says so."""
    user = F.when(
        _given(methods_text),
        F.concat(F.lit(fixed.ASK_HITS), methods_text, F.lit(fixed.ASK_QUESTION), question),
    ).otherwise(F.concat(F.lit(fixed.ASK_NO_HITS), question))
    return _filled(fixed.ASK_SYSTEM, course), user


def teach_prompt() -> tuple[Column, Column]:
    """System and user text of a turn.

    Columns: mode, intent, course, question, context, preamble, methods_text,
    soft_text (at most four methods), memory_text, turn_count.
    """
    course = F.when(_given(F.col("course")), F.col("course")).otherwise(F.lit(fixed.COURSE_FALLBACK))
    ask_system, ask_user = ask_prompt(course, F.col("question"), F.col("methods_text"))
    context = F.when(_given(F.col("context")), F.concat("context", F.lit("\n\n"))).otherwise(F.lit(""))
    end = F.lit("\n\n" + fixed.OUTPUT_DISCIPLINE)
    remembered = _given(F.col("memory_text")) & (F.col("intent") == fixed.ANSWER) & (F.col("turn_count") > 0)
    memory = F.when(remembered, F.concat(F.lit(fixed.MEMORY_HITS), "memory_text", F.lit("\n\n"))).otherwise(F.lit(""))
    system = (
        F.when(F.col("mode") == "general", _filled(fixed.GENERAL_SYSTEM, course))
        .when(F.col("mode") == "hard", F.concat("preamble", F.lit("\n\n"), ask_system, end))
        .otherwise(F.concat("preamble", F.lit("\n\n"), _filled(fixed.SOFT_SYSTEM, course), end))
    )
    user = (
        F.when(F.col("mode") == "general", F.concat(context, "question"))
        .when(F.col("mode") == "hard", F.concat(context, memory, ask_user))
        .otherwise(F.concat(context, F.lit(fixed.SOFT_HITS), "soft_text", F.lit(fixed.ASK_QUESTION), "question"))
    )
    return system, user


def offline_answer(methods_text: Column) -> Column:
    return F.when(_given(methods_text), F.concat(F.lit(fixed.OFFLINE_HITS), methods_text)).otherwise(
        F.lit(fixed.OFFLINE_NONE)
    )


# ---- JSON views of cards ----------------------------------------------------


def preview_item() -> Column:
    """Short view of a hit for the search tool."""
    return F.struct(
        F.col("card_id").alias("id"),
        "topic",
        "kind",
        "chapter",
        exact_round(F.col("score"), 3).alias("score"),
        F.substring(F.coalesce("applicability", F.lit("")), 1, fixed.PREVIEW_APPLICABILITY_CHARS).alias("applicability"),
    )


def previews(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``{"hits": [...]}`` per key, in rank order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", preview_item().alias("p")))), lambda x: x["p"])
    return hits.groupBy(*keys).agg(F.to_json(F.struct(ordered.alias("hits"))).alias("preview"))


def card_json() -> Column:
    """Whole card for the read tool."""
    return F.to_json(
        F.struct(
            "id",
            "topic",
            "kind",
            "chapter",
            "keywords",
            "prerequisites",
            "applicability",
            "steps",
            "core_formula_latex",
            "technique",
            cut(F.coalesce("worked_example", F.lit("")), fixed.CARD_EXAMPLE_CHARS, "……").alias("worked_example"),
            "error_notes",
            "source_page",
        )
    )


def method_brief() -> Column:
    return F.struct("topic", "kind", "chapter", exact_round(F.col("score"), 4).alias("score"))


def method_view() -> Column:
    """Card view of the answer interface."""
    return F.struct(
        "topic",
        "kind",
        "chapter",
        exact_round(F.col("score"), 4).alias("score"),
        "keywords",
        "applicability",
        "steps",
        F.col("core_formula_latex").alias("formula"),
        "error_notes",
    )


# ---- mind map and notes as ordered rows -------------------------------------


def badge(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.KIND_BADGES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[kind], kind)


def card_number(card_id: Column) -> Column:
    """Numeric tail of an id, so that card 1000 follows card 999."""
    return F.regexp_extract(card_id, r"(\d+)$", 1).try_cast("bigint")


def _card_rows(cards: DataFrame, text: Column) -> DataFrame:
    return cards.select(
        "course",
        "chapter",
        F.lit(1).alias("level"),
        F.coalesce(card_number(F.col("id")), F.lit(0)).alias("card_no"),
        "id",
        text.alias("text"),
    )


def _heading_rows(cards: DataFrame, text: Column) -> DataFrame:
    counted = cards.groupBy("course", "chapter").agg(F.count("*").alias("n"))
    return counted.select(
        "course", "chapter", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("card_no"), F.lit("").alias("id"), text.alias("text")
    )


ROW_ORDER = ["course", "chapter", "level", "card_no", "id"]


def mindmap_rows(cards: DataFrame) -> DataFrame:
    """Mind map Markdown: a heading row per chapter (level 0), a block per card (level 1), an end row (level 2)."""
    short = lambda text: squash(text, 60)
    block = F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("### "), "topic", F.lit("｜"), badge(F.col("kind"))),
            _labelled("- 适用：", F.col("applicability"), short(F.col("applicability"))),
            _joined(_numbered(F.transform(F.slice("steps", 1, 4), short), "- %d. %s")),
            _labelled("- 公式：", F.col("core_formula_latex"), short(F.col("core_formula_latex"))),
            _joined(F.transform(F.slice("error_notes", 1, 2), lambda e: F.concat(F.lit("- ⚠ "), short(e)))),
        ),
        F.lit("\n"),
    )
    heads = _heading_rows(cards, F.concat(F.lit("## "), F.col("chapter")))
    ends = heads.withColumn("level", F.lit(2)).withColumn("text", F.lit(""))
    return _card_rows(cards, block).unionByName(heads).unionByName(ends)


def _joined(items: Column) -> Column:
    """Lines of an array, or null when it is empty (``concat_ws`` then leaves no line)."""
    return F.when(F.size(items) > 0, F.array_join(items, "\n"))


def notes_rows(cards: DataFrame) -> DataFrame:
    """Review notes Markdown in the same row form."""
    c = F.col
    source = F.when(
        _given(c("source_url")), F.concat(c("source_page"), F.lit(" · [▶ 跳回视频原时刻]("), c("source_url"), F.lit(")"))
    ).otherwise(c("source_page"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), badge(c("kind")), F.lit("｜"), c("topic"), F.lit("\n")),
        _labelled("**适用条件**：", c("applicability"), tail="\n"),
        F.when(
            F.size("steps") > 0,
            F.concat(F.lit("**标准步骤**\n"), F.array_join(_numbered(c("steps"), "%d. %s"), "\n"), F.lit("\n")),
        ),
        _labelled("**核心公式**\n\n$$ ", c("core_formula_latex"), tail=" $$\n"),
        _labelled("**技巧**：", c("technique"), tail="\n"),
        _labelled("**代表例题**\n\n", c("worked_example"), tail="\n"),
        F.when(
            F.size("error_notes") > 0,
            F.concat(
                F.lit("**易错点**\n"),
                F.array_join(F.transform("error_notes", lambda e: F.concat(F.lit("- "), e)), "\n"),
                F.lit("\n"),
            ),
        ),
        F.when(_given(c("source_page")), F.concat(F.lit("**溯源**："), source, F.lit("\n"))),
    )
    heads = _heading_rows(cards, F.concat(F.lit("## "), c("chapter"), F.format_string("（%d 卡）\n", "n")))
    return _card_rows(cards, block).unionByName(heads)


def notes_head(cards: DataFrame) -> DataFrame:
    """Head text of the notes per course, with card and video card counts."""
    counted = cards.groupBy("course").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("source_url", F.lit("")) != "").alias("v")
    )
    video = F.when(F.col("v") > 0, F.format_string("（含 %d 张视频卡）", "v")).otherwise(F.lit(""))
    return counted.select(
        "course",
        F.concat(
            F.format_string("# %s 复习笔记\n\n> 自动生成：%d 张方法卡片", "course", "n"),
            video,
            F.lit("。\n> 视频卡溯源格式：P2 12:35 = 第 2 分P 第 12 分 35 秒，点击可跳回视频原时刻。\n"),
        ).alias("text"),
    )


def kind_list(kinds: str) -> list[str]:
    """Kind names of an option value; ASCII and full-width commas both separate."""
    return [k.strip() for k in kinds.replace("，", ",").split(",") if k.strip()]


def of_kinds(cards: DataFrame, kinds: str | None) -> DataFrame:
    return cards.filter(F.col("kind").isin(*kind_list(kinds))) if kinds else cards
