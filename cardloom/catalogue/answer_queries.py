"""Registered queries on evaluation, intents, transcripts, rendering and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import fixed_values as fixed
from cardloom.catalogue import tables as t
from cardloom.catalogue.card_queries import _part_cards
from cardloom.catalogue.retrieval_queries import _hybrid, fused_sql
from cardloom.catalogue.text_queries import CLEAN_SQL
from cardloom.functions import text as tx
from cardloom.operators import evaluation as ev
from cardloom.operators import external as ex
from cardloom.operators import intents
from cardloom.operators import jobs
from cardloom.operators import render
from cardloom.operators import transcripts as tr
from cardloom.plans import ingest
from cardloom.plans.ask import PAYLOAD, prompts
from cardloom.scale import spread
from cardloom.session import checkpointed


def _md5(text):
    return F.md5(F.col(text).cast("binary"))


# ---- evaluation -------------------------------------------------------------


def _recall(spark, folder) -> DataFrame:
    """Expected topics of a question: its distinct words of at least seven letters."""
    questions = t.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.concat(F.lit("tag"), (F.col("item_id") % 3).cast("string")).alias("tag"),
        F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"), F.lit(1))).alias("expect_topics"),
    )
    return ev.recall(questions, ev.topics_in_rank_order(_hybrid(spark, folder, 5, ("topic",))))


def recall_eval(spark: SparkSession, folder: str) -> DataFrame:
    return _recall(spark, folder).select(
        "qid",
        "tag",
        F.size("expect_topics").cast("bigint").alias("n_expected"),
        F.size("hits").cast("bigint").alias("n_hits"),
        "recall",
    )


def recall_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    return ev.recall_by_tag(_recall(spark, folder)).select("tag", "questions", F.bround("recall", 6).alias("recall"))


def quiz_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return ev.quiz_coverage(t.questions(spark, folder), _hybrid(spark, folder, 3, ("chapter",)))


def best_chapters(spark: SparkSession, folder: str) -> DataFrame:
    return ev.best_chapters(_hybrid(spark, folder, 3, ("chapter",)))


# ---- intents ----------------------------------------------------------------

_LEADS = ("什么是 ", "请复习 ", "出几道题 ", "hello ", "今天天气 ", "证明 ", "", "推荐一部好看的电影 ")


def _asked(spark, folder) -> DataFrame:
    """User messages behind eight lead-ins."""
    said = t.table(spark, folder, "conversations").filter("role = 'user'")
    return said.select(
        "conv_id",
        "turn",
        F.concat(t._pick(_LEADS, F.col("conv_id") + F.col("turn")), F.col("text")).alias("question"),
    )


def rule_intent(spark: SparkSession, folder: str) -> DataFrame:
    intent = intents.rule_intent(F.col("question"))
    return _asked(spark, folder).select("conv_id", "turn", intent.alias("intent"), intents.wants_memory(intent).alias("wants_memory"))


def question_depth(spark: SparkSession, folder: str) -> DataFrame:
    rows = _asked(spark, folder).withColumn("intent", intents.rule_intent(F.col("question")))
    depth = intents.question_depth(F.col("question"), F.col("intent"), (F.col("turn") % 3) / 4.0)
    return rows.select("conv_id", "turn", tx.exact_round(depth, 6).alias("depth"))


def turn_mode(spark: SparkSession, folder: str) -> DataFrame:
    rows = _asked(spark, folder).withColumn("intent", intents.rule_intent(F.col("question")))
    mode = intents.turn_mode(F.col("intent"), F.col("turn") % 4, (F.col("turn") % 5) / 5.0)
    return rows.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


# ---- transcripts ------------------------------------------------------------


def _event_segments(spark, folder) -> DataFrame:
    """A user's events as transcript segments, in seconds since the first of January 2024."""
    start = F.col("ts").cast("timestamp").cast("double") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.table(spark, folder, "events").select(
        "user_id", F.floor(start).cast("double").alias("start"), F.col("event_id").alias("seq"), F.col("event_type").alias("text")
    )


def time_anchors(spark: SparkSession, folder: str) -> DataFrame:
    opened = tr.paragraph_starts(_event_segments(spark, folder), ["user_id"], gap=86_400.0, block_seconds=400_000.0)
    return tr.paragraphs(opened, ["user_id"])


def music_filter(spark: SparkSession, folder: str) -> DataFrame:
    said = t.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(F.when(F.col("turn") == 2, F.lit("作曲 ")).otherwise(F.lit("")), F.col("text")).alias("text")
    )
    return tr.drop_music(said).groupBy("conv_id").agg(F.count("*").alias("n_segments"))


def caption_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation messages as caption files with one event per line; two files per part compete."""
    said = t.table(spark, folder, "conversations")
    events = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            (i * 2500).cast("bigint").alias("tStartMs"),
            F.length(line).cast("bigint").alias("dDurationMs"),
            F.array(F.struct(line.alias("utf8")), F.struct(F.lit("\n").alias("utf8"))).alias("segs"),
        ),
    )
    files = said.select(
        F.col("conv_id").alias("part"),
        F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit(".ai-zh")).otherwise(F.lit(".zh")), F.col("turn").cast("string"), F.lit(".json3")).alias("name"),
        F.to_json(F.struct(events.alias("events"))).alias("raw"),
    )
    found = tr.caption_segments(tr.choose_captions(files, ["part"]), ["part"])
    return found.select("part", "seq", "start", "end", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


def transcript_totals(spark: SparkSession, folder: str) -> DataFrame:
    segments = _event_segments(spark, folder).withColumn("end", F.col("start") + F.length("text")).withColumn("duration", F.lit(2_600_000.0))
    return tr.transcript_totals(segments, ["user_id"], "duration").select(
        "user_id", "segments", "chars", "last_end", F.bround("coverage", 6).alias("coverage"), "low_coverage"
    )


def attach_source(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("o_orderkey") % 5000
    cards = t.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("["), tx.clock(seconds), F.lit("]"))).alias("source_page"),
    )
    return tr.attach_source(cards, F.lit("BV1xx411c7mD"), (F.col("o_orderkey") % 9 + 1).cast("int"))


def chosen_parts(spark: SparkSession, folder: str) -> DataFrame:
    spec = F.concat_ws(
        ",", F.concat((F.col("l_linenumber")).cast("string"), F.lit("-"), (F.col("l_linenumber") + F.col("l_orderkey") % 4).cast("string")), F.lit(" 2 "), (F.col("l_orderkey") % 20 + 1).cast("string")
    )
    parts = t.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.explode(tr.chosen_parts(spec, F.lit(9))).alias("part_no")
    )
    return parts.groupBy("part_no").agg(F.count("*").alias("n"))


def video_names(spark: SparkSession, folder: str) -> DataFrame:
    url = F.concat(F.lit("https://v.example/BV"), F.substring(F.md5(F.col("url").cast("binary")), 1, 10), F.lit("?p=1"))
    title = F.concat(F.col("url"), F.lit(" p12 Part: "), F.col("page_id").cast("string"))
    return t.table(spark, folder, "pages").select(
        "page_id",
        tr.video_id(url).alias("video"),
        tr.part_chapter(F.col("page_id"), tr.part_name(title)).alias("chapter"),
        tr.part_chapter(F.col("page_id"), F.col("url")).alias("url_chapter"),
    )


# ---- jobs -------------------------------------------------------------------


def job_history(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as stored jobs; customers with the same key as live jobs."""
    orders = t.table(spark, folder, "orders")
    stored = orders.select(
        F.col("o_orderkey").alias("jid"),
        F.col("o_orderpriority").alias("filename"),
        F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
        F.lit(None).cast("bigint").alias("cards"),
    )
    live = t.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("jid"), F.lit("running").alias("status"), F.col("c_nationkey").cast("bigint").alias("cards")
    )
    finished = stored.withColumn("finished_at", F.lit(None).cast("string"))
    return jobs.job_history(finished, live).select("jid", "filename", "status", "started_at", "cards")


# ---- rendering --------------------------------------------------------------


def method_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt of every question with its rendered hits."""
    hits = _hybrid(spark, folder, 5, tuple(PAYLOAD))
    return prompts(t.questions(spark, folder), hits).select(
        "qid", _md5("system").alias("system_md5"), _md5("user").alias("user_md5"), F.length("user").cast("bigint").alias("n_chars")
    )


def mindmap_rows(spark: SparkSession, folder: str) -> DataFrame:
    return render.mindmap_rows(_part_cards(spark, folder)).select("chapter", F.col("level").cast("bigint").alias("level"), "id", _md5("text").alias("text_md5"))


def notes_rows(spark: SparkSession, folder: str) -> DataFrame:
    return render.notes_rows(_part_cards(spark, folder)).select("chapter", F.col("level").cast("bigint").alias("level"), "id", _md5("text").alias("text_md5"))


def notes_outline(spark: SparkSession, folder: str) -> DataFrame:
    kept = render.of_kinds(_part_cards(spark, folder), "方法，例题")
    return kept.groupBy("chapter").agg(F.count("*").alias("n_cards"), F.countDistinct("topic").alias("n_topics"))


def squashed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "documents").select("doc_id", tx.squash(F.col("text"), 70).alias("line"))


# ---- extraction -------------------------------------------------------------


def extracted_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that the stand-in model draws from every cleaned chunk, validated, deduplicated and numbered."""
    chapters = spread(t.table(spark, folder, "documents")).select(
        F.col("lang").alias("course"), F.col("source").alias("chapter"), F.col("doc_id").alias("chapter_ord"), "text"
    )
    parsed = checkpointed(ingest.extract(ingest.chapter_chunks(ingest.prepared(chapters)), ex.sample_cards))
    return ingest.to_cards(parsed).select("id", "course", "chapter", "topic", "kind", "reference_only")


def _some_fail(row: dict) -> str:
    if row["chapter_ord"] % 10 == 3:
        return "no JSON"
    return ex.sample_cards(row)


def extraction_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a model which answers some documents with nonsense leaves behind; the job goes on."""
    chapters = spread(t.table(spark, folder, "documents")).select(
        F.col("lang").alias("course"), F.col("source").alias("chapter"), F.col("doc_id").alias("chapter_ord"), "text"
    )
    told = checkpointed(ingest.answers(ingest.chapter_chunks(ingest.prepared(chapters)), _some_fail))
    failed = ingest.failed_chunks(told).select(F.col("chapter_ord").alias("doc_id"), "chunk_no", F.lit("failed").alias("state"))
    items = ingest.parsed_items(told).groupBy(F.col("chapter_ord").alias("doc_id"), "chunk_no")
    return failed.unionByName(items.agg(F.lit("answered").alias("state")))


_CHUNKS = """,
ch AS (
  SELECT doc_id, source, text, unnest(range(0, greatest(CAST(ceil((length(text) - 8000) / 7400.0) AS BIGINT), 0) + 1)) AS i
  FROM cleaned WHERE length(text) >= 400
),
ck AS (SELECT doc_id, source, i + 1 AS chunk_no, substr(text, i * 7400 + 1, 8000) AS chunk FROM ch),
se AS (
  SELECT doc_id, source, chunk_no, trim(unnest(regexp_split_to_array(chunk, '[.!?\\n]+')), ' ' || chr(9) || chr(10)) AS s FROM ck
),
md AS (SELECT *, md5(s) AS h FROM se WHERE length(s) >= 8),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY h) AS item FROM md)"""

_ASKED = """
qs AS (
  SELECT conv_id, turn, ['什么是 ', '请复习 ', '出几道题 ', 'hello ', '今天天气 ', '证明 ', '', '推荐一部好看的电影 '][((conv_id + turn) % 8 + 1)::INT] || text AS question
  FROM conversations WHERE role = 'user'
),
it AS (
  SELECT *, CASE
    WHEN regexp_matches(question, '(?i)^(你好|您好|嗨|hi|hello|谢谢|再见|哈喽)') THEN '闲聊'
    WHEN regexp_matches(question, '天气|气温|预报|推荐.{0,6}(电影|游戏|餐厅|书|歌)') THEN '通识'
    WHEN regexp_matches(question, '(?i)复习|回顾|总结(一下|今天)|\\breview\\b') THEN '复习'
    WHEN regexp_matches(question, '(出|来|练).{0,4}(几道|一道|十道|题|打卡)|模拟题|随机出') THEN '出题'
    WHEN regexp_matches(question, '什么是|是什么|定义|概念') THEN '概念'
    ELSE '答疑' END AS intent FROM qs
)"""
_RECALL = """,
ex AS (SELECT item_id AS qid, 'tag' || item_id % 3 AS tag, list_distinct(regexp_extract_all(text, '[A-Za-z]{7,}')) AS e FROM benchmark),
tp AS (SELECT qid, lower(string_agg(topic, ' ' ORDER BY rank)) AS joined FROM hit GROUP BY qid),
rc AS (SELECT ex.qid, tag, len(e) AS n_expected, len(list_filter(e, lambda x: contains(coalesce(joined, ''), lower(x)))) AS n_hits FROM ex LEFT JOIN tp USING (qid)),
rr AS (SELECT *, CAST(printf('%.3f', n_hits::DOUBLE / greatest(n_expected, 1)) AS DOUBLE) AS recall FROM rc)"""
_SEG = """
sg AS (SELECT user_id, floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS start, event_id AS seq, event_type AS text FROM events)"""
_BLOCK = """
pc AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS chapter, p_name AS topic,
    ['概念','定理','方法','例题','易错点'][p_size % 5 + 1] AS kind,
    ['📘 概念','📐 定理','🛠 方法','📝 例题','⚠️ 易错'][p_size % 5 + 1] AS badge,
    CASE p_brand WHEN 'Brand#3' THEN '教材编排建议' WHEN 'Brand#7' THEN '先学第3章' ELSE p_brand END AS app,
    CASE WHEN p_size = 7 THEN '建议先看附录' ELSE p_type END AS step FROM part
)"""

ORACLE = {
    "extracted_cards": "WITH"
    + CLEAN_SQL
    + _CHUNKS
    + """,
it AS (
  SELECT r.doc_id, d.lang AS course, r.source AS chapter, r.chunk_no, item, s AS topic,
    ['概念','定理','方法','例题','易错点'][(list_sum(list_transform(string_split(h, ''), lambda c: strpos('0123456789abcdef', c) - 1)) % 5 + 1)::INT] AS kind
  FROM rk r JOIN documents d ON d.doc_id = r.doc_id WHERE item <= 3
),
fi AS (SELECT *, row_number() OVER (PARTITION BY course, chapter, topic, kind ORDER BY doc_id, chunk_no, item) AS nth FROM it),
nu AS (SELECT *, row_number() OVER (PARTITION BY course, chapter ORDER BY doc_id, chunk_no, item) AS n FROM fi WHERE nth = 1)
SELECT course || '|' || chapter || '|' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id,
  course, chapter, topic, kind, regexp_matches(topic, '编排|建议(先|按|顺便|跳过)|先.{0,4}第?\\d+章') AS reference_only FROM nu""",
    "extraction_failures": "WITH"
    + CLEAN_SQL
    + _CHUNKS
    + """
SELECT doc_id, chunk_no, 'failed' AS state FROM ck WHERE doc_id % 10 = 3
UNION ALL SELECT DISTINCT doc_id, chunk_no, 'answered' FROM rk WHERE doc_id % 10 <> 3""",
    "recall_eval": "WITH"
    + fused_sql(5, 15)
    + _RECALL
    + " SELECT qid, tag, CAST(n_expected AS BIGINT) AS n_expected, CAST(n_hits AS BIGINT) AS n_hits, recall FROM rr",
    "recall_by_tag": "WITH"
    + fused_sql(5, 15)
    + _RECALL
    + " SELECT tag, count(*) AS questions, round_even(avg(recall), 6) AS recall FROM rr GROUP BY ROLLUP (tag)",
    "quiz_coverage": "WITH"
    + fused_sql(3, 10)
    + """
SELECT count(*) AS questions, count(*) FILTER (s > 0) AS covered FROM asked
LEFT JOIN (SELECT qid, CAST(printf('%.4f', raw) AS DOUBLE) AS s FROM hit WHERE rank = 1) b USING (qid)""",
    "best_chapters": "WITH"
    + fused_sql(3, 10)
    + " SELECT chapter, count(*) AS questions FROM hit WHERE rank = 1 GROUP BY chapter",
    "rule_intent": "WITH" + _ASKED + " SELECT conv_id, turn, intent, intent NOT IN ('通识', '闲聊') AS wants_memory FROM it",
    "question_depth": "WITH"
    + _ASKED
    + """
SELECT conv_id, turn, CAST(printf('%.6f', least(CASE intent WHEN '答疑' THEN 0.55 WHEN '概念' THEN 0.35 WHEN '复习' THEN 0.30 WHEN '出题' THEN 0.50 ELSE 0.30 END::DOUBLE
  + CASE WHEN length(trim(question)) >= 20 THEN 0.1 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(question, '证明|推导|为什么|原理') THEN 0.15 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(question, '[\\\\$_]|(^|[^A-Za-z0-9_À-ÿ])[A-Za-z]{2,}([^A-Za-z0-9_À-ÿ]|$)|frac|[0-9]{2,}|方程|定理') THEN 0.1 ELSE 0 END::DOUBLE
  + least((turn % 3) / 4.0::DOUBLE, 1.0::DOUBLE) * 0.1::DOUBLE, 1.0::DOUBLE)) AS DOUBLE) AS depth FROM it""",
    "turn_mode": "WITH"
    + _ASKED
    + """
SELECT CASE WHEN intent IN ('通识', '闲聊') OR turn % 4 = 0 THEN 'general'
  WHEN intent IN ('答疑', '出题') AND (turn % 5) / 5.0::DOUBLE >= 0.40::DOUBLE THEN 'hard' ELSE 'soft' END AS mode, count(*) AS n FROM it GROUP BY 1""",
    "time_anchors": "WITH RECURSIVE"
    + _SEG
    + """,
op AS (
  SELECT user_id, min(start) AS opened FROM sg GROUP BY user_id
  UNION ALL
  SELECT op.user_id, (SELECT min(s.start) FROM sg s WHERE s.user_id = op.user_id AND s.start - op.opened >= 86400) AS opened
  FROM op WHERE EXISTS (SELECT 1 FROM sg s WHERE s.user_id = op.user_id AND s.start - op.opened >= 86400)
),
nx AS (SELECT user_id, opened, lead(opened) OVER (PARTITION BY user_id ORDER BY opened) AS upto FROM op)
SELECT nx.user_id, CAST(opened AS DOUBLE) AS para_start,
  '[' || CASE WHEN opened >= 3600 THEN printf('%d:%02d:%02d', opened::BIGINT // 3600, (opened::BIGINT % 3600) // 60, opened::BIGINT % 60) ELSE printf('%02d:%02d', (opened::BIGINT % 3600) // 60, opened::BIGINT % 60) END || '] ' || string_agg(text, '' ORDER BY start, seq) AS text,
  count(*) AS segments
FROM nx JOIN sg ON sg.user_id = nx.user_id AND sg.start >= nx.opened AND (nx.upto IS NULL OR sg.start < nx.upto) GROUP BY nx.user_id, opened""",
    "music_filter": """
SELECT conv_id, count(*) AS n_segments FROM conversations WHERE turn <> 2
  AND NOT regexp_matches(text, '(?i)subtitle|zither|harp') GROUP BY conv_id""",
    "caption_segments": """
WITH f AS (
  SELECT conv_id AS part, text, turn % 2 = 0 AS machine,
    'p' || conv_id || CASE WHEN turn % 2 = 0 THEN '.ai-zh' ELSE '.zh' END || turn || '.json3' AS name FROM conversations
),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY machine, name) AS r FROM f) WHERE r = 1),
l AS (SELECT part, machine, name, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM c)
SELECT part, seq, seq * 2500 / 1000::DOUBLE AS start, seq * 2500 / 1000::DOUBLE + length(raw) / 1000::DOUBLE AS end,
  md5(trim(raw, ' ' || chr(9))) AS text_md5, string_split(name, '.')[2] AS lang, CASE WHEN machine THEN 'ai' ELSE 'cc' END AS source
FROM l WHERE trim(raw, ' ' || chr(9)) <> ''""",
    "transcript_totals": "WITH"
    + _SEG
    + """,
tt AS (SELECT user_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(arg_max(start + length(text), (start, seq)) AS DOUBLE) AS last_end FROM sg GROUP BY user_id)
SELECT *, round_even(last_end / 2600000.0::DOUBLE, 6) AS coverage, last_end / 2600000.0::DOUBLE < 0.85::DOUBLE AS low_coverage FROM tt""",
    "attach_source": """
WITH o AS (SELECT o_orderkey, o_orderkey % 5000 AS s, o_orderkey % 9 + 1 AS p FROM orders),
c AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS stamp FROM o)
SELECT o_orderkey, CASE WHEN stamp = '' THEN 'P' || p ELSE 'P' || p || ' ' || stamp END AS source_page,
  'https://www.bilibili.com/video/BV1xx411c7mD?p=' || p || CASE WHEN stamp = '' THEN '' ELSE '&t=' || s END AS source_url FROM c""",
    "chosen_parts": """
WITH l AS (SELECT l_orderkey, l_linenumber, list_distinct(list_concat(range(l_linenumber, l_linenumber + l_orderkey % 4 + 1), [2, l_orderkey % 20 + 1])) AS ps FROM lineitem),
u AS (SELECT unnest(ps) AS part_no FROM l)
SELECT part_no, count(*) AS n FROM u WHERE part_no BETWEEN 1 AND 9 GROUP BY part_no""",
    "video_names": """
SELECT page_id, 'BV' || substr(md5(url), 1, 10) AS video, substr('P' || page_id || ' Part  ' || page_id, 1, 80) AS chapter,
  substr('P' || page_id || ' ' || trim(regexp_replace(url, '[\\\\/:*?"<>|]', ' ', 'g')), 1, 80) AS url_chapter FROM pages""",
    "job_history": """
SELECT o_orderkey AS jid, o_orderpriority AS filename, CASE WHEN c_custkey IS NOT NULL THEN 'running' ELSE o_orderstatus END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS started_at, CAST(c_nationkey AS BIGINT) AS cards
FROM orders LEFT JOIN customer ON o_orderkey = c_custkey""",
    "method_prompts": "WITH"
    + fused_sql(5, 15)
    + """,
bl AS (
  SELECT h.qid, h.rank, '〔方法' || h.rank || '·相关度 ' || printf('%.2f', CAST(printf('%.4f', h.raw) AS DOUBLE)) || ' · ' || h.chapter || ' / ' || h.topic || '〕'
    || chr(10) || '- 种类：' || h.kind
    || CASE WHEN len(ls) > 2 THEN chr(10) || '- 标准步骤：' || chr(10) || array_to_string(list_transform(ls[2:len(ls)-1], lambda x, i: '   ' || i || '. ' || x), chr(10)) ELSE '' END
    || CASE WHEN len(ls) > 1 AND ls[len(ls)] <> '' THEN chr(10) || '- 代表例题：' || CASE WHEN length(ls[len(ls)]) > 600 THEN substr(ls[len(ls)], 1, 600) || ' ……' ELSE ls[len(ls)] END ELSE '' END AS b
  FROM hit h JOIN card c ON c.ord = h.ord
),
mt AS (SELECT qid, string_agg(b, chr(10) ORDER BY rank) AS m FROM bl GROUP BY qid),
us AS (SELECT a.qid, a.course, CASE WHEN m IS NULL THEN '【未命中任何教材方法（数据库为空或均不适用）】' || chr(10) || chr(10) || '【学生题目】' || chr(10) || question
  ELSE '【优先参考的教材方法】' || chr(10) || m || chr(10) || chr(10) || '【学生题目】' || chr(10) || question END AS u FROM asked a LEFT JOIN mt USING (qid))
SELECT qid, md5('"""
    + fixed.ASK_SYSTEM.replace("'", "''").replace("{course}", "' || course || '").replace("\n", "' || chr(10) || '")
    + """') AS system_md5, md5(u) AS user_md5, length(u) AS n_chars FROM us""",
    "mindmap_rows": "WITH"
    + _BLOCK
    + """
SELECT chapter, 1::BIGINT AS level, id, md5('### ' || topic || '｜' || badge || chr(10) || '- 适用：' || app || chr(10) || '- 1. ' || step || chr(10)) AS text_md5 FROM pc
UNION ALL SELECT DISTINCT chapter, 0, '', md5('## ' || chapter) FROM pc
UNION ALL SELECT DISTINCT chapter, 2, '', md5('') FROM pc""",
    "notes_rows": "WITH"
    + _BLOCK
    + """
SELECT chapter, 1::BIGINT AS level, id, md5('### ' || badge || '｜' || topic || chr(10) || chr(10) || '**适用条件**：' || app || chr(10) || chr(10) || '**标准步骤**' || chr(10) || '1. ' || step || chr(10)) AS text_md5 FROM pc
UNION ALL SELECT chapter, 0, '', md5('## ' || chapter || '（' || count(*) || ' 卡）' || chr(10)) FROM pc GROUP BY chapter""",
    "notes_outline": "WITH"
    + _BLOCK
    + " SELECT chapter, count(*) AS n_cards, count(DISTINCT topic) AS n_topics FROM pc WHERE kind IN ('方法', '例题') GROUP BY chapter",
    "squashed_lines": """
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) > 70 THEN substr(f, 1, 69) || '…' ELSE f END AS line FROM s""",
}

QUERIES = {
    f.__name__: f
    for f in (
        recall_eval,
        recall_by_tag,
        quiz_coverage,
        best_chapters,
        rule_intent,
        question_depth,
        turn_mode,
        time_anchors,
        music_filter,
        caption_segments,
        transcript_totals,
        attach_source,
        chosen_parts,
        video_names,
        job_history,
        method_prompts,
        mindmap_rows,
        notes_rows,
        notes_outline,
        squashed_lines,
        extracted_cards,
        extraction_failures,
    )
}
