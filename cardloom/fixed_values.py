"""FIXED VALUES: word lists, patterns, limits and text formats.

Everything in this module is a value that decides results, so it is stated
here plainly and nowhere else.  Patterns are Java regular expressions.
``(?U)`` makes ``\\s \\w \\b \\d`` Unicode aware, ``(?d)`` limits line ends to
``\\n``; both are needed for the same matches on CJK text.
"""

# --- card kinds (concept, theorem, method, example, pitfall) ---------------
CONCEPT, THEOREM, METHOD, EXAMPLE, PITFALL = "概念", "定理", "方法", "例题", "易错点"
KINDS = (CONCEPT, THEOREM, METHOD, EXAMPLE, PITFALL)
BOOSTED_KINDS = (METHOD, EXAMPLE)
KIND_BADGES = {
    METHOD: "🛠 方法",
    EXAMPLE: "📝 例题",
    CONCEPT: "📘 概念",
    THEOREM: "📐 定理",
    PITFALL: "⚠️ 易错",
}

# --- vectors and scoring ----------------------------------------------------
VECTOR_DIM = 256
KEYWORD_WEIGHT = 0.6
COSINE_WEIGHT = 0.35
KIND_BOOST = 0.15
BIAS_BOOST = 0.25
DEFAULT_TOP_K = 5
MIN_VECTOR_HITS = 10
VECTOR_OVERFETCH = 3
RELEVANCE_GATE = 0.40
BIAS_BALANCED, BIAS_CONCEPT = "均衡", "概念"
BIAS_KINDS = {"概念": (CONCEPT, THEOREM), "方法": (METHOD, EXAMPLE)}

# --- sizes -------------------------------------------------------------------
MAX_CHAPTER_CHARS = 50_000
MIN_CHAPTER_CHARS = 400
CHUNK_CHARS = 8_000
CHUNK_OVERLAP = 600
ANCHOR_SECONDS = 45.0
COVERAGE_WARN_RATIO = 0.85
COVERAGE_MIN_SECONDS = 60
CURVE_CAP, CURVE_API_CAP = 500, 300
REVIEW_LOG_CAP = 1000
HISTORY_CAP = 12
CONTEXT_TURNS, CONTEXT_QUESTION_CHARS, CONTEXT_ANSWER_CHARS = 5, 300, 500
STORED_QUESTION_CHARS, STORED_ANSWER_CHARS = 2000, 8000
TITLE_CHARS = 14
TOPICS_CAP, MISTAKES_CAP, GENERAL_NOTES_CAP, GENERAL_NOTE_CHARS = 12, 12, 20, 30
EXPRESSION_CHARS, EXPRESSION_TIP_CHARS = 200, 120
MEMORY_TOPIC_CHARS, MEMORY_HASH_CHARS = 80, 10
DAILY_DAYS = 14
RADAR_CHAPTERS, RADAR_LABEL_CHARS = 8, 9
TOP_BOX = 5
JOB_LOG_TAIL = 40
PREVIEW_APPLICABILITY_CHARS = 80
CARD_EXAMPLE_CHARS = 500
RENDER_EXAMPLE_CHARS = 600
SOFT_METHODS, MEMORY_METHODS = 4, 2
PREAMBLE_TOPICS = 6
MAX_AGENT_ROUNDS = 6
CONVERT_SLICE_PAGES, CONVERT_BATCH_FILES = 30, 8
PART_TITLE_CHARS, FILE_NAME_CHARS, COLLECTION_CHARS = 80, 60, 40
TRANSIENT_STATUS = (429, 500, 502, 503, 504)
RETRY_ATTEMPTS, RETRY_MAX_SECONDS = 4, 30

# --- text segmentation -------------------------------------------------------
LINE_BREAK = "\r\n|[\n\r\u000B\f\u001C\u001D\u001E\u0085  ]"
OTHER_BREAK = "[\r\u000B\f\u001C\u001D\u001E\u0085  ]"
WHITE_SPACE = (
    "\t\n\u000B\f\r\u001C\u001D\u001E\u001F \u0085          "
    "       　"
)
CJK = "[一-鿿]"
PAGE_MARK = r"(?U)<!--\s*page\s+(\d+)\s*-->"
CHAPTER_HEADING = (
    r"(?iUd)^\s*(?:#{1,6}\s*)?(?:"
    r"第\s*[0-9一二三四五六七八九十百零]+(?:章|篇|讲|节)\s*[:\s]*"
    r"|(?:CHAPTER|CH\.|UNIT|MODULE)\s+[A-Z0-9]+\s*[:\s]*"
    r")(.*)$"
)
TOC_ENTRY_END = r"(?Ud)\s[0-9]{1,4}\s*$"
UNTITLED_CHAPTER = "(未分章)"
PAGE_CHAPTER_FORMAT = "第%d页章节"
PAGE_MARK_FORMAT = "<!-- page %d -->"
PART_SEPARATOR = "·"
OFFICE_SUFFIXES = (".pptx", ".ppt", ".docx", ".doc")
PDF_BACKENDS = ("auto", "mineru", "mineru-http")
LOCAL_BACKEND, CLOUD_BACKEND = "mineru", "mineru-http"

# --- line cleaning -----------------------------------------------------------
KEEP_ANCHOR = r"(?Ud)^\s*<!--\s*page\s+\d+\s*-->\s*$"
KEEP_HEADING = r"(?Ud)^\s*(#{1,6}\b|[-=*_]{3,}\s*$)"
KEEP_LIST = r"(?Ud)^\s*\d{1,3}\s*[、．.)]"
KEEP_MATH = r"[\\$=^]"
TECH_WORDS = (
    r"(?Ud)方程|定理|定律|效应|公式|推导|证明|求解|定义|性质|方法|步骤|例题|"
    r"实验|波函数|概率|算符|本征|能级|谱线|原子|电子|粒子|电荷|电流|电压|电阻|"
    r"能量|动量|角动量|自旋|量子|场强|磁场|电场|函数|矩阵|变换|守恒|"
    r"如图|由图|如下|表\s*\d"
)
DECORATION = r"(?Ud)^\s*[·•\-—=_*~]{1,4}\s*$"
PLACEHOLDER = (
    r"单击此处|双击此处|添加(文本|标题|正文)|在此(输入|添加)|输入文本|键入文本|"
    r"占位符|双击打开|插入图片|插入文本|替换为图片"
)
CLOSING_WORDS = (
    r"谢谢(大家|聆听|观看|欣赏|配合)?|感谢(观看|聆听|大家|配合|收看)|敬请指正|"
    r"请批评指正|欢迎(指导|批评|交流|提问)|完$"
)
CLOSING_LINE = r"(?iUd)^\s*(?:thank\s*you(?:\s*very\s*much)?|thanks|the\s*end|that'?s\s*all)\s*$"
NAVIGATION_LINE = (
    r"(?iUd)^\s*(?:目录|目\s*录|内容提要|主要内容|本讲目录|提纲|大纲|返回(?:目录|首页)|"
    r"contents|table\s*of\s*contents|index|outline|next|previous)\s*$"
)
ADDRESS_START = r"(?iUd)^\s*(https?://|www\.|[\w.\-]+@[\w.\-]+\.(com|cn|edu|org))"
PUBLISHER = (
    r"(?iUd)all rights reserved|permission of the publisher|without .*written permission|"
    r"access code|scratch off|student access|premium content|redeem|"
    r"pearson|published by|printed in|isbn\s*[:0-9xX-]|"
    r"^\s*(copyright|©|\(c\))\b"
)
# every PUBLISHER match holds one of these in lower case, or a letter whose case folding leaves ASCII
PUBLISHER_HINTS = (
    "reserved", "permission", "access", "scratch", "premium", "redeem", "pearson", "published", "printed", "isbn",
    "copyright", "©", "(c)", "ſ", "ı", "\u0130", "\u212A",
)
PAGE_NUMBER = r"(?Ud)^\s*[-–—]?\s*[0-9]{1,4}\s*[-–—]?\s*$"
PAGE_NUMBER_ZH = r"(?Ud)^\s*第\s*[0-9]{1,4}\s*页\s*$"
READABLE = r"[一-鿿A-Za-z0-9]"
BIOGRAPHY = (
    r"(?iUd)个人简介|人物简介|生平|简历|履历|代表作品|主要成就|教育经历|工作经历|"
    r"出生于|卒于|毕业(于|自)|任教于|留学|诺贝尔|诺奖|院士|"
    r"被誉为|被称为|著名(科学家|物理学家|数学家|工程师|发明家)?|发明家|奠基(人|者)|先驱|"
    r"先后(在|任|获|主持|领导|创立)|曾获|历任|荣获"
)
BIOGRAPHY_YEAR = (
    r"(?Ud)(出生|生于|创立|创建|毕业于|获得|荣获|发表|出任|留学|任教)\s*(于)?\s*[0-9]{3,4}\s*年?"
)
STORY_MAX_CHARS = 180
SYMBOL_MAX_CHARS = 2

# --- reference-only cards ----------------------------------------------------
REFERENCE_NOISE = (
    r"(?Ud)阅读顺序|阅读计划|学习顺序|推荐.{0,6}(顺序|阅读|章节|内容)|如何使用(本书|这本|教材)|"
    r"建议(先|按|顺便|跳过)|任选|可选.{0,2}章|关于(本书|这本|教材)|编排|进度安排|"
    r"^参考(书目|文献)|^致谢|^目录$|导读|先.{0,4}第?\d+章"
)

# --- intents -----------------------------------------------------------------
ANSWER, CONCEPT_ASK, QUIZ, REVIEW, CHAT, GENERAL = "答疑", "概念", "出题", "复习", "闲聊", "通识"
INTENTS = (ANSWER, CONCEPT_ASK, QUIZ, REVIEW, CHAT, GENERAL)
GREETING = r"(?iU)^(你好|您好|嗨|hi|hello|谢谢|再见|哈喽)"
DAILY_LIFE = (
    r"(?Ud)天气|气温|预报|新闻|热点|热搜|股票|股市|大盘|行情|汇率|彩票|几点|星期几|几号|外卖|淘宝|京东|抖音|"
    r"微博|打车|导航|票价|多少钱|哪个(好|看)|推荐.{0,6}(电影|游戏|餐厅|书|歌)|怎么样$"
)
REVIEW_ASK = r"(?iU)复习|回顾|总结(一下|今天)|\breview\b"
QUIZ_ASK = r"(?Ud)(出|来|练).{0,4}(几道|一道|十道|题|打卡)|模拟题|随机出"
CONCEPT_WORDS = (
    r"什么是|是什么|定义|概念|区别|辨析|到底是|做什么|用来(做什么|干嘛|干什么)|干嘛|干什么|整体|概述|怎么理解|"
    r"通俗|简单说|大概|为什么"
)
DEPTH_BASE = {ANSWER: 0.55, CONCEPT_ASK: 0.35, REVIEW: 0.30, QUIZ: 0.50}
DEPTH_OTHER = 0.30
DEPTH_LONG_CHARS = 20
DEPTH_LONG, DEPTH_REASON, DEPTH_TERM, DEPTH_HIT = 0.10, 0.15, 0.10, 0.10
DEPTH_REASON_WORDS = r"证明|推导|为什么|原理|机制|本质|区别|比较|公式|计算|深入|如何实现|算法"
DEPTH_TERM_WORDS = r"(?U)[\\$_]|\b[A-Za-z]{2,}\b|_[A-Za-z]|frac|\d{2,}|方程|定理"

# --- transcripts -------------------------------------------------------------
MUSIC_CREDIT = (
    r"(?iU)(詞曲|词曲|作词|作詞|作曲|编曲|編曲|演唱|演奏|混音|和声|字幕\s*by|"
    r"subtitle|zither|harp|[♪♫])"
)
TIMESTAMP = r"(?U)(?:(\d{1,2}):)?(\d{1,3}):(\d{2})"
VIDEO_ID = r"(BV[0-9A-Za-z]{10})"
SERIES_PREFIX = r"(?Ud)\s+p\d+\s+(.+)$"
VIDEO_URL_FORMAT = "https://www.bilibili.com/video/%s?p=%d"
TITLE_UNSAFE = r"[\\/:*?\"<>|\r\n]"
FILE_UNSAFE = r"[\\/:*?\"<>|]"
NAME_UNSAFE = r"(?U)[^\w.\- ]"
COLLECTION_UNSAFE = r"[^0-9A-Za-z_.-]"
MACHINE_CAPTION = ".ai-"

# --- memory ------------------------------------------------------------------
BUCKETS = ("知识", "思维习惯", "技巧选择", "语义表意")
GENERAL_BUCKET = "通识"
WORDING_BUCKET = "语义表意"
BUCKET_KINDS = {
    "知识": CONCEPT,
    "思维习惯": METHOD,
    "技巧选择": METHOD,
    "语义表意": CONCEPT,
    "通识": CONCEPT,
}
BUCKET_COURSE_FORMAT = "用户·%s·%s"
MEMORY_ID_FORMAT = "记忆|%s|%s"
MEMORY_CHAPTER = "问答"
MEMORY_UNNAMED = "未命名"
WORDING_APPLICABILITY = "该生措辞习惯"
MEMORY_APPLICABILITY = "该生相关历史问答"
DEFAULT_SESSION, DEFAULT_SESSION_TITLE, NEW_SESSION_TITLE = "default", "默认会话", "新会话"
PLACEHOLDER_TITLES = ("新会话", "会话 ", "默认会话")
DEFAULT_STYLE = {"直观比喻": False, "例题": False, "推导": True, "易错点": True}
DEFAULT_LEVEL = "初级"

# --- text formats of rendered output -----------------------------------------
METHOD_HEAD = "〔方法%d·相关度 %s · %s / %s〕"
METHOD_KIND = "- 种类："
METHOD_APPLIES = "- 适用条件："
METHOD_STEPS = "- 标准步骤：\n"
METHOD_FORMULA = "- 核心公式：$"
METHOD_TECHNIQUE = "- 技巧："
METHOD_EXAMPLE = "- 代表例题："
METHOD_PITFALLS = "- 易错点："
ASK_SYSTEM = (
    "你是一名严谨的大学「{course}」答题助手。下面是从《{course}》教材中蒸馏出的"
    "方法卡片集（按与题目相关度降序，卡片内容源自教材原逻辑）。答用户题目时：\n"
    "1) 【优先采用课本方法】先判断题目属于哪张卡片的『适用条件』，点名方法名；\n"
    "2) 严格按卡片『标准步骤』一步步推导；代入公式计算时引用『核心公式』；\n"
    "3) 若该方法标注了『易错点』，作答时主动提醒；\n"
    "4) 步骤完整、推导清晰，公式用 LaTeX 呈现；\n"
    "5) 最后用通用知识交叉校验结果，并一句话说明教材方法与通用解法是否一致。\n"
    "若检索出的方法都不适用，请明确指出，再给出通用解法。"
)
ASK_HITS, ASK_QUESTION = "【优先参考的教材方法】\n", "\n\n【学生题目】\n"
ASK_NO_HITS = "【未命中任何教材方法（数据库为空或均不适用）】\n\n【学生题目】\n"
SOFT_SYSTEM = """你是一位大学「{course}」课程助教。学生这次的诉求是【整体认识/概念理解】，请：
1) 先用你自己的话把问题讲清楚（先给总体框架与直觉，再展开要点），条理清晰、语言平实；
2) 下方【教材方法】是从课本蒸馏出的相关内容卡片——只有当其中某张与本题【确实相关】时才引用它佐证/补充课本说法；
3) 相关度不高就**不要**强行套用卡片里的步骤或公式，正常用自己的话作答；
4) 该生历史弱点仅供你调节讲解方式（放慢节奏、多给对照、绕开已犯过的坑），**不要**在回答中复述或点名这些历史，也不要写“根据你以前/根据你过往记忆”这类话。
不要机械复述卡片；目标是把“它到底是什么/用来做什么”讲得让人真正理解。"""
GENERAL_SYSTEM = (
    "你是学生「{course}」学习助教背后的通用AI助手。学生在课程之外也会问常识性问题，请：\n"
    "1) 用你的一般知识正常、友好地回答即可，**不要虚构课本/课程资料**；\n"
    "2) 不需要强调“只能教这门课”或“无法搜索”；能用一般知识答就答；\n"
    "3) 只有需要实时数据（如当前天气/新闻）且你确实没有实时渠道时，才简短说明“没有实时信息渠道”，"
    "但仍尽量补充一般性背景知识；\n"
    "4) 这是日常对话，风格自然亲切，不必套用教学步骤。"
)
OUTPUT_DISCIPLINE = (
    "【输出纪律】该生的历史问答/易错点仅供你调节讲解深度与方向，"
    "切勿在回答中复述或逐条罗列，也不要用“根据你之前…”之类开头；请自然地融入讲解。"
)
COURSE_FALLBACK = "课程"
SOFT_HITS = "【教材方法（仅供对照，相关才引用）】\n"
MEMORY_HITS = "【该生过往相关问答（背景参考：不要当作本次提问来回答，也不要在回复中点名或复述这些历史）】\n"
CONTEXT_HEAD = "【近期对话 · 仅供衔接上下文，切勿把其中内容当作本次新提问】\n"
CONTEXT_QUESTION, CONTEXT_ANSWER = "学生问：", "\n助教答："
OFFLINE_HITS = "（离线降级：未检测到模型 API Key，以下为检索到的课本方法预览）\n\n"
OFFLINE_NONE = "（离线且未命中任何教材方法）"
PREAMBLE_LEVEL = "你是面对一位%s水平学生的一对一助教。"
PREAMBLE_PAST = "该生历史表现："
PREAMBLE_TOPIC_TEXT = "在『%s』上易卡壳，讲解时可放慢节奏、多给直观对照；"
PREAMBLE_MISTAKE_TEXT = "曾犯『%s』类错误，讲解时注意绕开这些坑。"
PREAMBLE_QUIET = "以上信息只用于调节讲解方式，**不要专门复述或点名学生的这些历史**。"
PREAMBLE_STYLE = "讲解风格：%s。"
PREAMBLE_WORDING = "措辞上他习惯：%s；讲解时可自然顺应，不必特意提及。"
TOOL_SEARCH, TOOL_READ = "search_methods", "read_card"
TOOL_NO_HIT = "无命中。建议更换为教材中文术语后重试"
TOOL_MISSING_CARD = "卡片不存在：%s。请使用 search_methods 返回的 id"
TOOL_UNKNOWN = "未知工具：%s"
LOOP_PREFETCH = (
    "\n\n【系统预检索】已用你的原问题检索过一次，候选卡片摘要如下；"
    "相关卡片可直接 read_card 读全文，不够再自行 search_methods"
    "（换教材中文术语 / 按概念拆分检索）：\n"
)
LOOP_NO_PREFETCH = (
    "\n\n【系统预检索】原问题未命中任何卡片，请自行 search_methods"
    "（建议换教材中文术语重试）。"
)
LOOP_FORCE_ANSWER = (
    "【系统】已达到工具调用轮数上限。请立即基于已获取的卡片信息作答；"
    "信息不足的部分用通用知识补足并注明。"
)
LOOP_NO_TEXT = "(agent 未返回文本)"

# ---- mind-map page (fixed values: what the page's script reads) --------------

MINDMAP_SCRIPT = "https://cdn.jsdelivr.net/npm/markmap-autoloader@0.18.10/dist/index.js"
MINDMAP_CLASS = "markmap"
MINDMAP_LANG = "zh"
MINDMAP_TITLE = "%s · 思维导图"
MINDMAP_OPTIONS = """---
markmap:
  maxWidth: 320
  initialExpandLevel: 2
  spacingVertical: 8
---"""
