"""Registered queries on flows: preambles, notes lists, draws, files, job logs, videos and card views, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.catalogue import retrieval_queries as rq
from cardloom.catalogue import student_queries as sq
from cardloom.catalogue import tables as t
from cardloom.functions.text import exact_round
from cardloom.operators import draw
from cardloom.operators import jobs
from cardloom.operators import profiles as pf
from cardloom.operators import render
from cardloom.operators import replies
from cardloom.operators import transcripts as tr
from cardloom.plans import agent_rounds, ingest
from cardloom.plans.ask import PAYLOAD
from cardloom.session import shared_table
from cardloom.sources import documents as src


def _md5(name):
    return F.md5(F.col(name).cast("binary"))


def _numbered(spark, folder):
    return t.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type"
    )


def general_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Everyday topics with blanks around them and more than 30 characters, more of them than the list holds."""
    item = F.concat(F.lit("  everyday matter number "), (F.col("k") % 40).cast("string"), F.lit(" "), F.col("event_type"))
    return pf.general_notes(_numbered(spark, folder).withColumn("item", item))


def mistake_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = _numbered(spark, folder).withColumn("item", F.concat(F.lit("slip "), (F.col("k") % 15).cast("string")))
    return pf.as_list(pf.capped_list(rows, fixed.MISTAKES_CAP), "mistakes").select(
        "user_id", F.array_join("mistakes", "、").alias("mistakes")
    )


def preambles(spark: SparkSession, folder: str) -> DataFrame:
    """Teaching hints of every user from derived lists and wording notes."""
    users = t.table(spark, folder, "events").select("user_id").distinct()
    lists = {
        "weak_topics": sq.weak_topics(spark, folder),
        "common_mistakes": pf.capped_list(
            _numbered(spark, folder).withColumn("item", F.concat(F.lit("slip "), (F.col("k") % 15).cast("string"))), fixed.MISTAKES_CAP
        ),
    }
    turns = _numbered(spark, folder).select("user_id", "seq")
    people = pf.profiles(users, turns, lists, sq.expression_notes(spark, folder))
    return people.select("user_id", "turn_count", pf.preamble().alias("preamble"))


def draw_with_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Five cards for each student out of one pool: the course of the student and the student's own memory."""
    students = t.turns(spark, folder).select("user_id").distinct()
    studies = students.select("user_id", t._pick(t.COURSES, F.col("user_id")).alias("course"))
    memory = sq.memory_cards(spark, folder).select(
        F.split("course", "·")[1].cast("bigint").alias("user_id"), "course", "id", "kind"
    ).distinct()
    pool = draw.draw_pool(t.cards(spark, folder)).select("course", "id", "kind")
    drawn = draw.student_draw(studies, pool, memory, 5, "2024-01-15")
    return drawn.select("user_id", F.col("rank").cast("bigint").alias("rank"), "course", "id", "kind")


def log_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log lines of 40 jobs."""
    lines = t.table(spark, folder, "events").select(
        (F.col("user_id") % 40).alias("jid"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line")
    )
    return jobs.log_tail(lines).select("jid", "line_no", "line")


def cached_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as parts, labelled ones with a stored transcript."""
    parts = t.table(spark, folder, "documents").select("doc_id", "source")
    return tr.without_cached(parts, t.table(spark, folder, "labels"), ["doc_id"])


def text_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages written as one text file each and read back as chapters named by their first line."""
    path = shared_table(spark, "texts")
    head = F.concat(F.lit("# 第"), (F.col("item_id") % 9 + 1).cast("string"), F.lit("章 Item "), F.col("item_id").cast("string"), F.lit("\n"))
    t.table(spark, folder, "benchmark").select(F.concat(head, "text").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\n"
    ).text(path)
    return src.read_texts(spark, path, "bench").select(
        "course", "chapter", F.length("text").cast("bigint").alias("n_chars"), _md5("text").alias("text_md5")
    )


def video_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as parts of two videos with equal part titles; one card for each part that is long enough."""
    said = t.table(spark, folder, "conversations")
    where = [
        F.lit("talks").alias("course"),
        F.concat(F.lit("BV"), (F.col("conv_id") % 2).cast("string")).alias("video"),
        F.floor(F.col("conv_id") / 2).cast("int").alias("part_no"),
    ]
    segments = said.select(
        *where, F.col("turn").alias("seq"), (F.col("turn") * 20.0).alias("start"), (F.col("turn") * 20.0 + 19).alias("end"), "text"
    )
    parts = said.select(*where, F.lit("talk").alias("title")).distinct()
    chapters = ingest.video_chapters(segments, parts)
    cards = chapters.select(
        "course", "video", "chapter", F.format_string("%s-%d", "video", "part_no").alias("id"), F.lit("[01:05]").alias("source_page"), _md5("text").alias("text_md5")
    )
    return ingest.video_cards(cards, chapters).select("id", "chapter", "source_page", "source_url", "text_md5")


def card_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views of the hits as the answer interface shows them."""
    view = render.method_view()
    return rq._hybrid(spark, folder, 5, tuple(PAYLOAD)).withColumn("v", view).select(
        "qid",
        F.col("rank").cast("bigint").alias("rank"),
        F.md5(F.col("v.topic").cast("binary")).alias("topic_md5"),
        F.col("v.kind").alias("kind"),
        F.col("v.chapter").alias("chapter"),
        exact_round(F.col("v.score"), 4).alias("score"),
        F.size("v.keywords").cast("bigint").alias("n_keywords"),
        F.size("v.steps").cast("bigint").alias("n_steps"),
    )


def _searching_model(row: dict) -> str:
    """Searches for its own question once, then answers; every seventh question meets a broken model."""
    messages = json.loads(row["messages"])
    if row["qid"] % 7 == 0:
        raise RuntimeError("model is down")
    told = [m for m in messages if m["role"] == "tool"]
    if told:
        return json.dumps({"answer": f"after {len(told)} results"})
    question = messages[0]["content"].split(fixed.LOOP_PREFETCH)[0].split(fixed.LOOP_NO_PREFETCH)[0]
    return json.dumps({"calls": [{"name": fixed.TOOL_SEARCH, "arguments": {"query": question}}]}, ensure_ascii=False)


def tool_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Tool rounds of all questions with a fixed model: one search, one answer, or the plain answer after a failure."""
    done = agent_rounds.run(t.questions(spark, folder), t.cards(spark, folder), _searching_model)
    failed = F.col("failed").isNotNull()
    return done.select(
        "qid",
        F.when(~failed, F.col("answer")).alias("answer"),
        failed.alias("failed"),
        F.col("rounds").cast("bigint").alias("rounds"),
        F.col("tool_calls").cast("bigint").alias("tool_calls"),
        F.size("trace").cast("bigint").alias("n_trace"),
        F.md5(F.array_join("seen_topics", "|").cast("binary")).alias("seen_md5"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_LIST = "list_reduce(l, lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x)[-{cap}:] END)"
_MISTAKES = (
    f"ml AS (SELECT user_id, list(['slip ' || {_K} % 15] ORDER BY event_id) AS l FROM events GROUP BY user_id),\n"
    f"mk AS (SELECT user_id, {_LIST.format(cap=12)} AS kept FROM ml)"
)

def reply_events(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as streamed fragments of seven characters; those of every third conversation as two interleaved tool calls."""
    said = t.table(spark, folder, "conversations").filter("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("reply"),
        (F.col("conv_id") % 3 == 0).alias("called"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    n = F.ceil(F.length("said") / 7).cast("int")
    each = said.withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    piece = F.substring("said", F.col("i") * 7 + 1, F.lit(7))
    done = F.col("i") == n
    none = F.lit(None).cast("string")
    text = each.filter("NOT called").select(
        "reply", F.col("i").cast("bigint").alias("seq"), piece.alias("text"), F.lit(None).cast("int").alias("call_index"),
        none.alias("call_id"), none.alias("name"), none.alias("arguments"), done.alias("done"),
    )
    side = F.explode(F.array(F.lit(1), F.lit(0)))
    first = F.col("i") == 0
    calls = each.filter("called").withColumn("side", side).select(
        "reply",
        (F.col("i") * 2 + 1 - F.col("side")).cast("bigint").alias("seq"),
        none.alias("text"),
        F.col("side").alias("call_index"),
        F.when(first, F.concat(F.lit("call-"), F.col("side").cast("string"))).alias("call_id"),
        F.when(first, F.when(F.col("side") == 0, "search_methods").otherwise("read_card")).alias("name"),
        piece.alias("arguments"),
        (done & (F.col("side") == 0)).alias("done"),
    )
    return text.unionByName(calls)


def assembled_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The turns again, put together from their fragments."""
    call = lambda c: F.concat_ws("|", c["call_index"].cast("string"), c["call_id"], c["name"], c["arguments"])
    return replies.assembled(reply_events(spark, folder)).select(
        "reply", "kind", "text", F.array_join(F.transform("calls", call), "\n").alias("calls")
    )


ORACLE = {
    "general_notes": f"""
WITH it AS (SELECT user_id, list([substr(trim('everyday matter number ' || {_K} % 40 || ' ' || event_type), 1, 30)] ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, {_LIST.format(cap=20)} AS kept FROM it)
SELECT user_id, generate_subscripts(kept, 1) AS place, unnest(kept) AS item FROM f""",
    "mistake_lists": f"WITH {_MISTAKES} SELECT user_id, array_to_string(kept, '、') AS mistakes FROM mk",
    "preambles": f"""
WITH {_MISTAKES},
wl AS (SELECT user_id, list(['topic ' || {_K} % 20] ORDER BY event_id) AS l FROM events GROUP BY user_id),
wk AS (SELECT user_id, {_LIST.format(cap=12)} AS kept FROM wl),
ex AS ({sq.ORACLE["expression_notes"].strip()}),
n AS (SELECT user_id, count(*) AS turn_count FROM events GROUP BY user_id)
SELECT n.user_id, turn_count, '你是面对一位初级水平学生的一对一助教。 该生历史表现：'
  || '在『' || array_to_string(wk.kept[1:6], '、') || '』上易卡壳，讲解时可放慢节奏、多给直观对照；'
  || '曾犯『' || array_to_string(mk.kept[1:6], '、') || '』类错误，讲解时注意绕开这些坑。'
  || '以上信息只用于调节讲解方式，**不要专门复述或点名学生的这些历史**。 讲解风格：推导、易错点。 措辞上他习惯：' || expression_notes || '；讲解时可自然顺应，不必特意提及。' AS preamble
FROM n JOIN wk USING (user_id) JOIN mk USING (user_id) JOIN ex USING (user_id)""",
    "draw_with_memory": "WITH"
    + sq._MEMORY
    + """,
us AS (SELECT DISTINCT conv_id % 10 AS user_id FROM conversations WHERE role = 'user'),
pool AS (
  SELECT us.user_id, lang AS course, CAST(doc_id AS VARCHAR) AS id, ['概念','定理','方法','例题','易错点'][(doc_id % 5 + 1)::INT] AS kind
  FROM us JOIN documents ON lang = ['en','fr','de','es'][(us.user_id % 4 + 1)::INT] WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT DISTINCT user_id, course, id, kind FROM mc WHERE user_id IN (SELECT user_id FROM us)
)
SELECT user_id, rank, course, id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('2024-01-15' || id), id) AS rank FROM pool) WHERE rank <= 5""",
    "log_tails": f"""
SELECT jid, line_no, line FROM (SELECT user_id % 40 AS jid, event_id AS line_no, event_type AS line,
  row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id DESC) AS r FROM events) WHERE r <= {fixed.JOB_LOG_TAIL}""",
    "cached_parts": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "text_chapters": """
WITH f AS (SELECT item_id, '# 第' || (item_id % 9 + 1) || '章 Item ' || item_id || chr(10) || text || chr(10) AS body FROM benchmark)
SELECT 'bench' AS course, 'Item ' || item_id AS chapter, length(body) AS n_chars, md5(body) AS text_md5 FROM f""",
    "video_cards": """
WITH sg AS (
  SELECT conv_id, turn, turn * 20 AS start, text FROM conversations
), ls AS (
  SELECT conv_id, list_reduce(list([start] ORDER BY start), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 45 THEN list_concat(acc, x) ELSE acc END) AS openings
  FROM sg GROUP BY conv_id
), pg AS (
  SELECT sg.conv_id, list_max(list_filter(openings, lambda o: o <= sg.start)) AS opening, turn, text FROM sg JOIN ls ON ls.conv_id = sg.conv_id
), pa AS (
  SELECT conv_id, opening, '[' || printf('%02d:%02d', opening // 60, opening % 60) || '] ' || string_agg(text, '' ORDER BY turn) AS text FROM pg GROUP BY conv_id, opening
), ch AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY opening) AS text FROM pa GROUP BY conv_id)
SELECT 'BV' || conv_id % 2 || '-' || conv_id // 2 AS id, 'P' || conv_id // 2 || ' talk' AS chapter, 'P' || conv_id // 2 || ' 01:05' AS source_page,
  'https://www.bilibili.com/video/BV' || conv_id % 2 || '?p=' || conv_id // 2 || '&t=65' AS source_url, md5(text) AS text_md5
FROM ch WHERE length(text) >= 400""",
    "card_views": rq.ORACLE["hybrid_topk"].rstrip().rstrip(";"),
}
ORACLE["card_views"] = f"""
SELECT h.qid, h.rank, h.topic_md5, h.kind, h.chapter, h.score, len(list_distinct(regexp_extract_all(string_split(d.text, chr(10))[1], '[A-Za-z]{{4,}}'))) AS n_keywords,
  greatest(len(string_split(d.text, chr(10))) - 2, 0) AS n_steps
FROM ({ORACLE["card_views"]}) h JOIN documents d ON CAST(d.doc_id AS VARCHAR) = h.card_id"""

ORACLE["tool_rounds"] = f"""
WITH tp AS (  -- found first, and by a search that looks at twice as many and shows the first five
  SELECT qid, topic FROM (WITH {rq.fused_sql(5, 15)} SELECT qid, topic FROM hit)
  UNION SELECT qid, topic FROM (WITH {rq.fused_sql(10, 30)} SELECT qid, topic FROM hit WHERE rank <= 5 AND qid % 7 <> 0)),
se AS (SELECT qid, md5(string_agg(topic, '|' ORDER BY topic)) AS seen_md5 FROM tp GROUP BY qid)
SELECT item_id AS qid, CASE WHEN item_id % 7 <> 0 THEN 'after 1 results' END AS answer, item_id % 7 = 0 AS failed,
  CASE WHEN item_id % 7 = 0 THEN 1 ELSE 2 END::BIGINT AS rounds, (item_id % 7 <> 0)::BIGINT AS tool_calls, (item_id % 7 <> 0)::BIGINT AS n_trace,
  coalesce(seen_md5, md5('')) AS seen_md5
FROM benchmark LEFT JOIN se ON se.qid = item_id"""

ORACLE["assembled_replies"] = """
WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS said FROM conversations WHERE role = 'assistant')
SELECT conv_id || '-' || turn AS reply, CASE WHEN conv_id % 3 = 0 THEN 'tool_calls' ELSE 'text' END AS kind,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE said END AS text,
  CASE WHEN conv_id % 3 = 0 THEN '0|call-0|search_methods|' || said || chr(10) || '1|call-1|read_card|' || said ELSE '' END AS calls
FROM said"""

QUERIES = {
    f.__name__: f
    for f in (
        assembled_replies,
        general_notes,
        mistake_lists,
        preambles,
        draw_with_memory,
        log_tails,
        cached_parts,
        text_chapters,
        video_cards,
        card_views,
        tool_rounds,
    )
}
