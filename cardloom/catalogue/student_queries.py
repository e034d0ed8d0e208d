"""Registered queries on study logs, reviews, profiles and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.catalogue import tables as t
from cardloom.operators import draw
from cardloom.operators import profiles as pf
from cardloom.operators import progress as pg
from cardloom.operators import sessions as ss
from cardloom.plans.documents import progress_documents as progress_docs
from cardloom.scale import sized_block, time_block

UNITS = 10_000


def chapter_progress(spark: SparkSession, folder: str) -> DataFrame:
    return pg.chapter_progress(t.study_log(spark, folder)).select(
        "user_id", "chapter", "questions", "depth_sum_units", "depth_max_units", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts")
    )


def course_percent(spark: SparkSession, folder: str) -> DataFrame:
    return pg.course_percent(t.study_log(spark, folder), UNITS).drop("course")


def _curve(spark, folder):
    log = t.study_log(spark, folder)
    return pg.progress_curve(log, time_block(log, ["user_id", "course"], "ts"), UNITS)


def progress_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _curve(spark, folder).select("user_id", "seq", "q", "pct")


def _course_log(spark, folder):
    """The study log with events spread over three courses per student."""
    k = F.get_json_object("props", "$.k").cast("int")
    course = t.table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("course "), (k % 3).cast("string")).alias("course")
    )
    return t.study_log(spark, folder).drop("course").join(course, "seq")


def _course_curve(spark, folder):
    log = _course_log(spark, folder)
    return pg.progress_curve(log, time_block(log, ["user_id", "course"], "ts"), UNITS)


def course_percent_courses(spark: SparkSession, folder: str) -> DataFrame:
    return pg.course_percent(_course_log(spark, folder), UNITS)


def progress_curve_courses(spark: SparkSession, folder: str) -> DataFrame:
    return _course_curve(spark, folder).select("user_id", "course", "seq", "q", "pct")


def daily_rollup_courses(spark: SparkSession, folder: str) -> DataFrame:
    return pg.daily_rollup(_course_curve(spark, folder))


def curve_tail(spark: SparkSession, folder: str) -> DataFrame:
    return pg.curve_tail(_curve(spark, folder), 30).select("user_id", "seq", "q", "pct")


def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return pg.daily_rollup(_curve(spark, folder)).drop("course")


def today_questions(spark: SparkSession, folder: str) -> DataFrame:
    return pg.today_questions(_curve(spark, folder), "2024-01-15").drop("course")


def radar_topn(spark: SparkSession, folder: str) -> DataFrame:
    log = t.study_log(spark, folder).withColumn(
        "chapter", F.concat("chapter", F.lit("·"), (F.col("seq") % 3 + 1).cast("string"))
    )
    top = pg.radar_chapters(pg.chapter_progress(log), 3)
    return top.select("user_id", F.col("rank").cast("bigint").alias("rank"), "name", "depth_units")


def progress_documents(spark: SparkSession, folder: str) -> DataFrame:
    log = t.study_log(spark, folder)
    docs = progress_docs(log, "2024-01-15", time_block(log, ["user_id", "course"], "ts"), UNITS)
    last = F.element_at("curve", -1)
    return docs.select(
        "user_id",
        "percent",
        "questions",
        F.size("chapters").cast("bigint").alias("n_chapters"),
        F.size("curve").cast("bigint").alias("n_curve"),
        last["pct"].alias("last_pct"),
        last["ts"].alias("last_ts"),
        F.size("daily").cast("bigint").alias("n_days"),
        F.aggregate("daily", F.lit(0).cast("bigint"), lambda a, d: a + d["questions"]).alias("questions_in_days"),
        "today_questions",
    )


def _boxed(spark, folder):
    answers = t.reviews(spark, folder)
    return pg.review_boxes(answers, time_block(answers, ["user_id", "card_id"], "ts"))


def review_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _boxed(spark, folder).select("user_id", "card_id", "seq", "box")


def current_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return pg.current_boxes(_boxed(spark, folder))


def review_stats(spark: SparkSession, folder: str) -> DataFrame:
    return pg.review_stats(t.reviews(spark, folder))


def review_stats_recent(spark: SparkSession, folder: str) -> DataFrame:
    return pg.review_stats(t.reviews(spark, folder), 50)


def weak_topics(spark: SparkSession, folder: str) -> DataFrame:
    items = t.table(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.lit(0).alias("pos"),
        F.concat(F.lit("topic "), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("item"),
    )
    return pf.capped_list(items, fixed.TOPICS_CAP)


def expression_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that repeat, some of them ending in the separator."""
    k = F.get_json_object("props", "$.k")
    notes = t.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" "), k, F.when(k.endswith("3"), F.lit("；")).otherwise(F.lit(""))).alias("note")
    )
    return pf.expression_notes(notes)


def memory_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant messages written back as memory cards of five buckets."""
    said = t.table(spark, folder, "conversations")
    entries = said.filter("role = 'assistant'").select(
        (F.col("conv_id") % 10).alias("user_id"),
        t._pick((*fixed.BUCKETS, fixed.GENERAL_BUCKET), F.col("turn")).alias("bucket"),
        F.col("text").alias("topic"),
        F.col("text").alias("content"),
        F.array(F.col("text"), F.lit("")).alias("examples"),
        F.array(F.lit("k")).alias("keywords"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ord"),
    )
    cards = pf.memory_cards(entries)
    return cards.select("ord", "id", "course", "kind", F.md5(F.col("topic").cast("binary")).alias("topic_md5"), F.md5(F.array_join("keywords", "|").cast("binary")).alias("keywords_md5"))


def memory_counts(spark: SparkSession, folder: str) -> DataFrame:
    users = t.turns(spark, folder).select("user_id").distinct()
    return pf.memory_counts(users, memory_cards(spark, folder).select("course", "id").distinct())


def _chat_actions(spark, folder):
    """Actions on the chat sessions, fixed by their number: opened with a name, cleared, deleted, opened and never used."""
    c = F.col("conv_id")
    own = c.cast("string")
    kinds = [
        (c % 5 == 0, "new", own, F.concat(F.lit("Named "), own), -1),
        (c % 7 == 0, "clear", own, None, 2),
        (c % 11 == 0, "delete", own, None, 100),
        (c % 13 == 0, "new", F.concat(F.lit("e"), own), F.when(c % 2 == 0, "会话 1").otherwise("Empty"), 1),
        (c % 17 == 0, "delete", F.lit(fixed.DEFAULT_SESSION), None, 3),
    ]
    made = [
        F.when(
            when,
            F.struct(
                (c % 10).alias("user_id"),
                (c * 10 + i).alias("seq"),
                F.lit(action).alias("action"),
                sid.alias("sid"),
                (F.lit(None).cast("string") if title is None else title).alias("title"),
                F.timestamp_seconds(c * 3600 + seconds).alias("ts"),
            ),
        )
        for i, (when, action, sid, title, seconds) in enumerate(kinds)
    ]
    convs = t.table(spark, folder, "conversations").select("conv_id").distinct()
    return convs.select(F.explode(F.array_compact(F.array(*made))).alias("a")).select("a.*")


def chat_context_acted(spark: SparkSession, folder: str) -> DataFrame:
    text = ss.chat_context(t.turns(spark, folder), actions=_chat_actions(spark, folder))
    return text.select("user_id", "sid", F.length("context").cast("bigint").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def chat_history_acted(spark: SparkSession, folder: str) -> DataFrame:
    return ss.history(t.turns(spark, folder), actions=_chat_actions(spark, folder)).select("user_id", "sid", "turn")


def session_list_acted(spark: SparkSession, folder: str) -> DataFrame:
    listed = ss.session_list(t.turns(spark, folder), actions=_chat_actions(spark, folder))
    return listed.select(
        "user_id", "sid", "title", "count", F.unix_timestamp("created").alias("created"), F.unix_timestamp("updated").alias("updated")
    )


def chat_context(spark: SparkSession, folder: str) -> DataFrame:
    text = ss.chat_context(t.turns(spark, folder))
    return text.select("user_id", "sid", F.length("context").cast("bigint").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    kept = ss.history(t.turns(spark, folder), 2, shorten=True)
    return kept.select("user_id", "sid", "turn", F.length("question").cast("bigint").alias("n_question"), F.length("answer").cast("bigint").alias("n_answer"))


def session_titles(spark: SparkSession, folder: str) -> DataFrame:
    return ss.session_titles(t.turns(spark, folder))


def session_list(spark: SparkSession, folder: str) -> DataFrame:
    listed = ss.session_list(t.turns(spark, folder))
    return listed.select(
        "user_id", "sid", "title", "count", F.unix_timestamp("created").alias("created"), F.unix_timestamp("updated").alias("updated")
    )


def _actions(spark, folder):
    """Events as session actions of six possible sessions per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    sid = F.when(k % 6 == 0, F.lit("default")).otherwise(F.concat(F.lit("s"), (k % 6).cast("string")))
    action = (
        F.when(F.col("event_type").isin("view", "click"), F.lit("switch"))
        .when(F.col("event_type") == "purchase", F.lit("clear"))
        .when(F.col("event_type") == "signup", F.lit("new"))
        .otherwise(F.lit("delete"))
    )
    return t.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("seq"), action.alias("action"), sid.alias("sid"), F.lit("会话").alias("title"), "ts"
    ).filter(~((F.col("action") == "new") & (F.col("sid") == "default")))


def session_state(spark: SparkSession, folder: str) -> DataFrame:
    return ss.session_state(_actions(spark, folder)).select("user_id", "sid", "cleared_seq")


def current_sessions(spark: SparkSession, folder: str) -> DataFrame:
    actions = _actions(spark, folder)
    return ss.current_sessions(actions, sized_block(actions, ["user_id", "sid"], F.col("seq").cast("double")))


def daily_draw(spark: SparkSession, folder: str) -> DataFrame:
    pool = draw.draw_pool(t.cards(spark, folder))
    drawn = draw.daily_draw(pool, ["course"], 5, seed="2024-01-15")
    return drawn.select("course", F.col("rank").cast("bigint").alias("rank"), "id", "kind")


_LOG = """
lg AS (
  SELECT user_id, event_type AS chapter, CAST(least(10000, round(value * 100)) AS BIGINT) AS d, ts, event_id AS seq FROM events
)"""
_CURVE = (
    _LOG
    + """,
m AS (SELECT *, coalesce(max(d) OVER (PARTITION BY user_id, chapter ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM lg),
cv AS (
  SELECT user_id, ts, seq, count(*) OVER w AS q,
    CAST(round_even(least(sum(greatest(d - greatest(prev, 0), 0)) OVER w::DOUBLE / sum((prev = -1)::INT) OVER w::DOUBLE / 10000.0::DOUBLE, 1.0) * 100, 0) AS BIGINT) AS pct
  FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
)"""
)
_REVIEWS = """
rv AS (SELECT user_id, event_type AS card_id, value >= 20 AS ok, ts, event_id AS seq FROM events),
g AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, card_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS grp FROM rv),
bx AS (SELECT *, least(5, 1 + sum(ok::INT) OVER (PARTITION BY user_id, card_id, grp ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS box FROM g)
"""
_TURNS = """
tn AS (
  SELECT u.conv_id % 10 AS user_id, CAST(u.conv_id AS VARCHAR) AS sid, u.turn, u.text AS question, a.text AS answer,
    u.conv_id * 3600 + u.turn AS ts
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""
_TITLE = """
tt AS (
  SELECT user_id, sid, arg_min(replace(trim(question, ' ' || chr(9) || chr(10)), chr(10), ' '), turn)
    FILTER (trim(question, ' ' || chr(9) || chr(10)) <> '') AS q1 FROM tn GROUP BY ALL
),
ti AS (SELECT user_id, sid, CASE WHEN q1 IS NULL THEN '新会话' ELSE substr(q1, 1, 14) || CASE WHEN length(q1) > 14 THEN '…' ELSE '' END END AS title FROM tt)
"""
_CHAT_ACTIONS = """
cv AS (SELECT DISTINCT conv_id AS c FROM conversations),
ac AS (
  SELECT c % 10 AS user_id, c * 10 AS seq, 'new' AS action, CAST(c AS VARCHAR) AS sid, 'Named ' || c AS title, c * 3600 - 1 AS ts FROM cv WHERE c % 5 = 0
  UNION ALL SELECT c % 10, c * 10 + 1, 'clear', CAST(c AS VARCHAR), NULL, c * 3600 + 2 FROM cv WHERE c % 7 = 0
  UNION ALL SELECT c % 10, c * 10 + 2, 'delete', CAST(c AS VARCHAR), NULL, c * 3600 + 100 FROM cv WHERE c % 11 = 0
  UNION ALL SELECT c % 10, c * 10 + 3, 'new', 'e' || c, CASE WHEN c % 2 = 0 THEN '会话 1' ELSE 'Empty' END, c * 3600 + 1 FROM cv WHERE c % 13 = 0
  UNION ALL SELECT c % 10, c * 10 + 4, 'delete', 'default', NULL, c * 3600 + 3 FROM cv WHERE c % 17 = 0
),
ed AS (SELECT user_id, sid, max(ts) AS ended FROM ac WHERE action = 'clear' OR (action = 'delete' AND sid <> 'default') GROUP BY ALL),
sv AS (SELECT tn.* FROM tn LEFT JOIN ed ON ed.user_id = tn.user_id AND ed.sid = tn.sid WHERE ended IS NULL OR tn.ts > ended)
"""
_MEMORY = """
en AS (
  SELECT conv_id % 10 AS user_id, ['知识','思维习惯','技巧选择','语义表意','通识'][(turn % 5 + 1)::INT] AS bucket,
    substr(text, 1, 80) AS topic, text AS content, text AS ex, conv_id * 100 + turn AS ord
  FROM conversations WHERE role = 'assistant'
),
mc AS (
  SELECT ord, user_id, bucket, '记忆|' || bucket || '|' || substr(sha256(bucket || '|' || CASE WHEN topic = '' THEN '未命名' ELSE topic END || '|' || content || '|' || ex), 1, 10) AS id,
    '用户·' || user_id || '·' || bucket AS course,
    CASE WHEN bucket IN ('思维习惯', '技巧选择') THEN '方法' ELSE '概念' END AS kind,
    md5(CASE WHEN topic = '' THEN '未命名' ELSE topic END) AS topic_md5,
    md5(CASE WHEN bucket = '语义表意' THEN ex ELSE 'k' END) AS keywords_md5 FROM en
)"""
_ACTIONS = """
ac AS (
  SELECT * FROM (
    SELECT user_id, event_id AS seq,
      CASE WHEN event_type IN ('view', 'click') THEN 'switch' WHEN event_type = 'purchase' THEN 'clear' WHEN event_type = 'signup' THEN 'new' ELSE 'delete' END AS action,
      CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 6 = 0 THEN 'default' ELSE 's' || CAST(json_extract_string(props, '$.k') AS INT) % 6 END AS sid
    FROM events) WHERE NOT (action = 'new' AND sid = 'default')
)"""

_COURSE_LOG = _LOG.replace("SELECT user_id,", "SELECT user_id, 'course ' || CAST(json_extract_string(props, '$.k') AS INT) % 3 AS course,")
_COURSE_CURVE = _COURSE_LOG + _CURVE[len(_LOG) :].replace("PARTITION BY user_id", "PARTITION BY user_id, course").replace(
    "SELECT user_id, ts", "SELECT user_id, course, ts"
)

ORACLE = {
    "course_percent_courses": "WITH"
    + _COURSE_LOG
    + """
SELECT user_id, course, CAST(sum(n) AS BIGINT) AS questions, count(*) AS chapters,
  CAST(round_even(least(sum(m)::DOUBLE / count(*) / 10000.0::DOUBLE, 1.0) * 100, 0) AS BIGINT) AS percent
FROM (SELECT user_id, course, chapter, count(*) AS n, max(d) AS m FROM lg GROUP BY ALL) GROUP BY user_id, course""",
    "progress_curve_courses": "WITH" + _COURSE_CURVE + " SELECT user_id, course, seq, q, pct FROM cv",
    "daily_rollup_courses": "WITH"
    + _COURSE_CURVE
    + """,
dy AS (SELECT user_id, course, strftime(ts, '%Y-%m-%d') AS day, count(*) AS questions, coalesce(arg_max(pct, q) FILTER (pct <> 0), 0) AS pct
  FROM cv GROUP BY ALL)
SELECT user_id, course, day, questions, pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, course ORDER BY day DESC) AS r FROM dy) WHERE r <= 14""",
    "chapter_progress": "WITH"
    + _LOG
    + """
SELECT user_id, chapter, count(*) AS questions, CAST(sum(d) AS BIGINT) AS depth_sum_units, max(d) AS depth_max_units,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM lg GROUP BY ALL""",
    "course_percent": "WITH"
    + _LOG
    + """
SELECT user_id, CAST(sum(n) AS BIGINT) AS questions, count(*) AS chapters,
  CAST(round_even(least(sum(m)::DOUBLE / count(*) / 10000.0::DOUBLE, 1.0) * 100, 0) AS BIGINT) AS percent
FROM (SELECT user_id, chapter, count(*) AS n, max(d) AS m FROM lg GROUP BY ALL) GROUP BY user_id""",
    "progress_curve": "WITH" + _CURVE + " SELECT user_id, seq, q, pct FROM cv",
    "curve_tail": "WITH"
    + _CURVE
    + " SELECT user_id, seq, q, pct FROM (SELECT *, max(q) OVER (PARTITION BY user_id) AS mq FROM cv) WHERE q > mq - 30",
    "daily_rollup": "WITH"
    + _CURVE
    + """,
dy AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS questions, coalesce(arg_max(pct, q) FILTER (pct <> 0), 0) AS pct
  FROM cv GROUP BY ALL)
SELECT user_id, day, questions, pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM dy) WHERE r <= 14""",
    "today_questions": """
SELECT user_id, count(*) FILTER (strftime(ts, '%Y-%m-%d') = '2024-01-15') AS today_questions FROM events GROUP BY user_id""",
    "radar_topn": "WITH"
    + _LOG
    + """
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, chapter) AS rank, chapter AS name, m AS depth_units
  FROM (SELECT user_id, chapter, max(d) AS m FROM lg GROUP BY ALL)) WHERE rank <= 3""",
    "progress_documents": "WITH"
    + _CURVE
    + """,
tl AS (SELECT *, max(q) OVER (PARTITION BY user_id) AS mq FROM cv),
dy AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM tl GROUP BY ALL),
dd AS (SELECT user_id, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS questions_in_days FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM dy) WHERE r <= 14 GROUP BY user_id),
cc AS (SELECT user_id, count(DISTINCT chapter) AS n_chapters FROM lg GROUP BY user_id)
SELECT tl.user_id, arg_max(pct, q) AS percent, max(q) AS questions, max(n_chapters) AS n_chapters,
  count(*) FILTER (q > mq - 300) AS n_curve, arg_max(pct, q) AS last_pct, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_ts,
  max(n_days) AS n_days, max(questions_in_days) AS questions_in_days,
  count(*) FILTER (strftime(ts, '%Y-%m-%d') = '2024-01-15') AS today_questions
FROM tl JOIN dd USING (user_id) JOIN cc USING (user_id) GROUP BY tl.user_id""",
    "review_boxes": "WITH" + _REVIEWS + "SELECT user_id, card_id, seq, CAST(box AS BIGINT) AS box FROM bx",
    "current_boxes": "WITH"
    + _REVIEWS
    + "SELECT user_id, card_id, CAST(arg_max(box, seq) AS BIGINT) AS box FROM bx GROUP BY ALL",
    "review_stats": "WITH"
    + _REVIEWS
    + """,
bc AS (SELECT user_id, count(DISTINCT card_id) AS boxes FROM rv GROUP BY user_id)
SELECT user_id, count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong,
  CAST(printf('%.2f', count(*) FILTER (ok)::DOUBLE / count(*)) AS DOUBLE) AS accuracy, max(boxes) AS boxes FROM rv JOIN bc USING (user_id) GROUP BY user_id""",
    "review_stats_recent": "WITH"
    + _REVIEWS
    + """,
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS r FROM rv) WHERE r <= 50),
bc AS (SELECT user_id, count(DISTINCT card_id) AS boxes FROM rv GROUP BY user_id)
SELECT user_id, count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong,
  CAST(printf('%.2f', count(*) FILTER (ok)::DOUBLE / count(*)) AS DOUBLE) AS accuracy, max(boxes) AS boxes FROM la JOIN bc USING (user_id) GROUP BY user_id""",
    "weak_topics": """
WITH it AS (SELECT user_id, list(['topic ' || CAST(json_extract_string(props, '$.k') AS INT) % 20] ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x)[-12:] END) AS kept FROM it)
SELECT user_id, generate_subscripts(kept, 1) AS place, unnest(kept) AS item FROM f""",
    "expression_notes": """
WITH nt AS (SELECT user_id, event_id, event_type || ' ' || json_extract_string(props, '$.k') || CASE WHEN json_extract_string(props, '$.k') LIKE '%3' THEN '；' ELSE '' END AS note FROM events),
it AS (SELECT user_id, list_prepend('', list(note ORDER BY event_id)) AS l FROM nt GROUP BY user_id)
SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE substr(trim(acc || '；' || x, '；'), 1, 200) END) AS expression_notes FROM it""",
    "memory_cards": "WITH" + _MEMORY + " SELECT ord, id, course, kind, topic_md5, keywords_md5 FROM mc",
    "memory_counts": "WITH"
    + _MEMORY
    + """,
us AS (SELECT DISTINCT conv_id % 10 AS user_id FROM conversations WHERE role = 'user'),
bk AS (SELECT user_id, unnest(['知识','思维习惯','技巧选择','语义表意','通识']) AS bucket FROM us)
SELECT bk.user_id, bk.bucket, count(DISTINCT id) AS n_cards FROM bk LEFT JOIN mc ON mc.user_id = bk.user_id AND mc.bucket = bk.bucket GROUP BY ALL""",
    "chat_context": "WITH"
    + _TURNS
    + """,
la AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY turn DESC) AS r FROM tn),
cx AS (SELECT user_id, sid, '【近期对话 · 仅供衔接上下文，切勿把其中内容当作本次新提问】' || chr(10) || string_agg('学生问：' || substr(question, 1, 300) || chr(10) || '助教答：' || substr(coalesce(answer, ''), 1, 500), chr(10) || chr(10) ORDER BY turn) AS c
  FROM la WHERE r <= 5 GROUP BY ALL)
SELECT user_id, sid, length(c) AS n_chars, md5(c) AS context_md5 FROM cx""",
    "chat_history": "WITH"
    + _TURNS
    + """
SELECT user_id, sid, turn, least(length(question), 2000) AS n_question, least(length(coalesce(answer, '')), 8000) AS n_answer
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY turn DESC) AS r FROM tn) WHERE r <= 2""",
    "chat_context_acted": "WITH"
    + _TURNS
    + ","
    + _CHAT_ACTIONS
    + """,
la AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY turn DESC) AS r FROM sv),
cx AS (SELECT user_id, sid, '【近期对话 · 仅供衔接上下文，切勿把其中内容当作本次新提问】' || chr(10) || string_agg('学生问：' || substr(question, 1, 300) || chr(10) || '助教答：' || substr(coalesce(answer, ''), 1, 500), chr(10) || chr(10) ORDER BY turn) AS c
  FROM la WHERE r <= 5 GROUP BY ALL)
SELECT user_id, sid, length(c) AS n_chars, md5(c) AS context_md5 FROM cx""",
    "chat_history_acted": "WITH"
    + _TURNS
    + ","
    + _CHAT_ACTIONS
    + """
SELECT user_id, sid, turn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY turn DESC) AS r FROM sv) WHERE r <= 12""",
    "session_list_acted": "WITH"
    + _TURNS
    + ","
    + _CHAT_ACTIONS
    + """,
tt AS (SELECT user_id, sid, arg_min(replace(trim(question, ' ' || chr(9) || chr(10)), chr(10), ' '), turn)
    FILTER (trim(question, ' ' || chr(9) || chr(10)) <> '') AS q1, count(*) AS n, min(ts) AS first, max(ts) AS last FROM sv GROUP BY ALL),
st AS (SELECT user_id, sid, max(seq) FILTER (action = 'new') AS made, max(seq) FILTER (action = 'delete') AS gone,
  max(ts) FILTER (action = 'new') AS opened, arg_max(title, seq) FILTER (action = 'new') AS title FROM ac GROUP BY ALL),
op AS (SELECT user_id, sid, opened, title FROM st WHERE sid <> 'default' AND coalesce(made, -1) > coalesce(gone, -1)
  UNION ALL SELECT DISTINCT user_id, 'default', NULL::BIGINT, '默认会话' FROM (SELECT user_id FROM tn UNION SELECT user_id FROM ac))
SELECT coalesce(tt.user_id, op.user_id) AS user_id, coalesce(tt.sid, op.sid) AS sid,
  coalesce(CASE WHEN op.title LIKE '会话 %' OR op.title = '默认会话' OR op.title IS NULL THEN coalesce(CASE WHEN tt.sid IS NULL THEN NULL
      WHEN q1 IS NULL THEN '新会话' ELSE substr(q1, 1, 14) || CASE WHEN length(q1) > 14 THEN '…' ELSE '' END END, op.title) ELSE op.title END, '新会话') AS title,
  coalesce(n, 0) AS count, coalesce(opened, first) AS created, coalesce(last, opened) AS updated
FROM tt FULL JOIN op ON op.user_id = tt.user_id AND op.sid = tt.sid""",
    "session_titles": "WITH" + _TURNS + "," + _TITLE + "SELECT user_id, sid, title FROM ti",
    "session_list": "WITH"
    + _TURNS
    + ","
    + _TITLE
    + """
SELECT tn.user_id, tn.sid, title, count(*) AS count, min(ts) AS created, max(ts) AS updated
FROM tn JOIN ti ON ti.user_id = tn.user_id AND ti.sid = tn.sid GROUP BY ALL""",
    "session_state": "WITH"
    + _ACTIONS
    + """,
st AS (SELECT user_id, sid, max(seq) FILTER (action = 'new') AS made, max(seq) FILTER (action = 'delete') AS gone,
  max(seq) FILTER (action = 'clear') AS cleared_seq FROM ac GROUP BY ALL)
SELECT user_id, sid, cleared_seq FROM st WHERE sid = 'default' OR coalesce(made, -1) > coalesce(gone, -1)
UNION ALL SELECT DISTINCT user_id, 'default', NULL::BIGINT FROM ac WHERE user_id NOT IN (SELECT user_id FROM st WHERE sid = 'default')""",
    "current_sessions": "WITH"
    + _ACTIONS
    + """,
sn AS (SELECT *, coalesce(max(CASE WHEN action = 'new' THEN seq END) OVER w, -1) AS made, coalesce(max(CASE WHEN action = 'delete' THEN seq END) OVER w, -1) AS gone
  FROM ac WINDOW w AS (PARTITION BY user_id, sid ORDER BY seq)),
va AS (SELECT user_id, arg_max(sid, seq) AS sid, max(seq) AS at FROM sn
  WHERE action = 'new' OR (action = 'switch' AND (sid = 'default' OR made > gone)) GROUP BY user_id),
us AS (SELECT DISTINCT user_id FROM ac)
SELECT us.user_id, CASE WHEN va.sid IS NULL THEN 'default'
  WHEN va.sid <> 'default' AND EXISTS (SELECT 1 FROM ac d WHERE d.user_id = va.user_id AND d.sid = va.sid AND d.action = 'delete' AND d.seq > va.at) THEN 'default'
  ELSE va.sid END AS current_session FROM us LEFT JOIN va ON va.user_id = us.user_id""",
    "daily_draw": """
SELECT course, rank, id, kind FROM (
  SELECT lang AS course, CAST(doc_id AS VARCHAR) AS id, ['概念','定理','方法','例题','易错点'][(doc_id % 5 + 1)::INT] AS kind,
    row_number() OVER (PARTITION BY lang ORDER BY md5('2024-01-15' || doc_id), CAST(doc_id AS VARCHAR)) AS rank
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE rank <= 5""",
}

QUERIES = {
    f.__name__: f
    for f in (
        chapter_progress,
        course_percent,
        progress_curve,
        course_percent_courses,
        progress_curve_courses,
        daily_rollup_courses,
        curve_tail,
        daily_rollup,
        today_questions,
        radar_topn,
        progress_documents,
        review_boxes,
        current_boxes,
        review_stats,
        review_stats_recent,
        weak_topics,
        expression_notes,
        memory_cards,
        memory_counts,
        chat_context,
        chat_history,
        chat_context_acted,
        chat_history_acted,
        session_list_acted,
        session_titles,
        session_list,
        session_state,
        current_sessions,
        daily_draw,
    )
}
