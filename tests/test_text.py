import pytest
from pyspark.sql import functions as F

import helpers as h
from cardloom.functions import text as tx
from cardloom.functions import vectors as vec
from cardloom.operators import chapters as ch
from cardloom.operators import denoise as dn
from cardloom.sources import documents as src

# own lines for every rule
CHROME = ["谢谢", "感谢聆听", "点击此处添加标题", "目录", "www.courses.example.org/week3", "— 47 —", "•", "第 112 页", "Thank you", "Outline"]
STORY = ["排队论的先驱是一位电话工程师。", "履历：先在电话局，后来历任三所研究所的所长。", "她出任 1975 年度的评委。", "他的两个学生后来都当选院士。"]
TECHNICAL = [
    "## 第七章 排队模型", "<!-- page 118 -->", "4、到达率：单位时间内到达的顾客数", "利用率：U = L / M", "$P_n = (1 - r) r^n$",
    "缓存命中率决定平均访问时间", "银行家算法避免死锁", "误差界：$|e_k| \\le C h^2$",
]
PUBLISHER = [
    "This edition: all rights reserved by the authors.", "Published by Harbour Books", "Copyright 2021 Harbour Books",
    "Scratch off to see your student access code", "ISBN: 0-00-000000-0",
]
PROSE = [
    "A queue is stable while work arrives more slowly than it is served.", "MODULE B Waiting Lines",
    "Each server takes the next job from the head of its list.", "Caches are no cure for a slow disk.",
    "With two servers the mean delay falls by more than half.",
]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "\n", "a\nb", "a\nb\n", "a\n\n", "a\r\nb\rc", "x y", "a\x0bb\x1cc", "\r\n", "a\u0085"])
def test_lines_like_splitlines(spark, text):
    assert one(spark, tx.lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(
    "text", ["Hello World 42", "极限与连续 lim", "法", "ＡＢＣ１２ 全角", "ﬁne ½ ①", "naïve Ünïcode é", "é İstanbul K", "", "中a文b字词典"]
)
def test_tokens(spark, text):
    want = h.tokens(text)
    assert one(spark, tx.tokens(F.lit(text))) == want
    assert vec.token_list(text) == want


def test_vectors_agree(spark):
    texts = ["分子分母都趋于零 L'Hopital rule", "x", "", "the the the cat"]
    got = vec.count_matrix(texts, vec.TokenCodes())
    for row, text in zip(got, texts):
        assert row.tolist() == h.vector(text)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("t", tx.tokens(F.col("text")))
    sparse = {(r["id"], r["bucket"]): r["weight"] for r in vec.sparse_vectors(df, "id", "t").collect()}
    assert sparse == {(i, b): w for i, text in enumerate(texts) for b, w in enumerate(h.vector(text)) if w}


def test_clock(spark):
    assert one(spark, tx.clock(F.lit(755.9))) == "12:35"
    assert one(spark, tx.clock(F.lit(3753.0))) == "1:02:33"
    for text, seconds in [("12:35", 755), ("1:02:33", 3753), ("[03:10] P2", 190), ("none", None)]:
        assert one(spark, tx.clock_seconds(F.lit(text))) == seconds


def test_rounding_is_exact_half_even(spark):
    for value, places in [(0.125, 2), (2.675, 2), (0.545, 2), (1.005, 2), (0.00005, 4), (-0.375, 2)]:
        assert one(spark, tx.exact_round(F.lit(value), places)) == round(value, places)


def test_squash(spark):
    assert one(spark, tx.squash(F.lit(" a \n\t b　c "), 70)) == "a b c"
    assert one(spark, tx.squash(F.lit("x" * 80), 70)) == "x" * 69 + "…"


def category(spark, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r["c"] for r in df.select("i", dn.line_category(F.col("x")).alias("c")).orderBy("i").collect()]


def test_line_categories(spark):
    assert all(c for c in category(spark, CHROME))
    assert category(spark, STORY) == ["story"] * len(STORY)
    assert category(spark, TECHNICAL) == [""] * 8
    assert category(spark, PUBLISHER) == ["chrome"] * 5
    assert category(spark, PROSE) == [""] * 5


def test_line_quirks(spark):
    rows = ["pearson wrote a=b", "about Pearson", "做完", "# Pearson", "#Pearson", "　目录　", "----", "", "  ", "…!", "题目"]
    assert category(spark, rows) == ["", "chrome", "chrome", "chrome", "", "chrome", "", "noise", "noise", "chrome", ""]


def test_denoise_stats_and_fallback(spark):
    text = "他出生于1957年，被誉为著名物理学家。\n真·内容：公式 $x=1$ 和结论。\n谢谢\n第二行内容。"
    df = spark.createDataFrame([("a", text), ("b", "谢谢观看\n目录\n·"), ("c", "")], "id string, text string")
    rows = {r["id"]: r for r in dn.denoise(df).collect()}
    a = rows["a"]
    assert a["text"] == "真·内容：公式 $x=1$ 和结论。\n第二行内容。"
    assert (a["removed_lines"], a["story_removed"], a["chrome_removed"]) == (2, 1, 1)
    assert a["removed_chars"] == len("他出生于1957年，被誉为著名物理学家。") + 2 and 0 < a["removed_ratio"] < 1
    assert rows["b"]["text"] == "谢谢观看\n目录\n·" and rows["b"]["removed_lines"] == 0
    assert rows["c"]["kept_chars"] == 0 and rows["c"]["removed_ratio"] == 0
    pure = {r["id"]: r for r in dn.denoise(df, fall_back=False).collect()}
    assert pure["b"]["text"] == "" and pure["b"]["removed_lines"] == 3


def pages(spark, rows, source="s"):
    return spark.createDataFrame(
        [(source, i, n, x) for i, (n, x) in enumerate(rows)], "source string, page_ord long, page_no int, text string"
    )


def chapters(spark, rows, **more):
    found = ch.split_chapters(pages(spark, rows), **more).orderBy("chapter_no", "part").collect()
    return [(r["chapter"], r["text"], list(r["pages"])) for r in found]


def brute_chapters(rows, heading, limit=50_000):
    """Line-by-line reading of the rule."""
    done, name, buf, listed = [], "(未分章)", [], []
    for no, text in rows:
        for line in text.splitlines():
            title = heading(line)
            if title is not None:
                if buf:
                    done.append((name, "\n".join(buf), listed))
                name, buf, listed = title or f"第{no}页章节", [f"<!-- page {no} -->"], [no]
            else:
                buf.append(line)
        if not listed or listed[-1] != no:
            listed = listed + [no]
    if buf:
        done.append((name, "\n".join(buf), listed))
    out = []
    for name, text, listed in done:
        n = -(-len(text) // limit)
        if n <= 1:
            out.append((name, text, listed))
        else:
            size = -(-len(text) // n)
            out += [(f"{name}·{i + 1}", text[i * size : (i + 1) * size], []) for i in range(n)]
    return out


def simple_heading(line):
    if line == "第三章":
        return ""
    # "CHAPTER 1 " alone ends like a table-of-contents entry and stays in the text
    return line[len("CHAPTER 1 ") :].strip() or None if line.startswith("CHAPTER 1 ") else None


def test_chapter_names(spark):
    names = lambda *pages: [c[0] for c in chapters(spark, list(enumerate(pages, 1)))]
    assert names("第3章 队列与窗口\n到达过程", "服务时间\n第4章 缓存的替换\n命中") == ["队列与窗口", "缓存的替换"]
    # a part heading opens nothing; a chapter heading inside a page does
    assert names("# CHAPTER 5 Waiting Lines\nqueues", "# PART B\nstill queues", "# CHAPTER 6 Slow Disks\nseek") == ["Waiting Lines", "Slow Disks"]
    # contents lines end in a page number and open nothing, on a page of their own or before the chapter they name
    contents = "# Chapter 5 Waiting Lines 88\n# Chapter 6 Slow Disks 131"
    assert names(contents, "# CHAPTER 5 Waiting Lines\nqueues") == ["(未分章)", "Waiting Lines"]
    assert names("# CHAPTER 5 Waiting Lines\nqueues", contents, "# CHAPTER 6 Slow Disks\nseek") == ["Waiting Lines", "Slow Disks"]


def test_chapters_match_line_reading(spark):
    rows = [(1, "intro"), (1, ""), (2, "CHAPTER 1 A\nx\n\ny"), (3, "z\nCHAPTER 1 \n第三章\nq"), (3, "CHAPTER 1 B\nCHAPTER 1 C"), (9, "w\n"), (9, "v")]
    want = brute_chapters(rows, simple_heading)
    assert chapters(spark, rows) == want
    assert chapters(spark, rows, pages_per_block=2) == want


def test_oversized_chapter_in_blocks(spark):
    rows = [(1, "CHAPTER 1 Big\n" + "\n".join(["内容行内容行"] * 37))] + [(i, f"page {i} " + "字" * (i * 7 % 50) + "\n尾") for i in range(2, 40)]
    want = brute_chapters(rows, simple_heading, 100)
    got = chapters(spark, rows, max_chars=100, pages_per_block=5)
    assert got == want and len(got) > 5
    assert all(len(t) <= 100 for _, t, _ in got)


def test_page_markers(spark):
    df = spark.createDataFrame(
        [("a", "lost <!-- page 4 --> one <!--page 5--><!-- page 5 --> <!-- page 7 -->\ntwo\n"), ("b", "plain"), ("c", "<!-- page 3 -->  ")],
        "id string, text string",
    )
    got = [(r["id"], r["page_no"], r["text"]) for r in ch.split_pages(df, ["id"]).orderBy("id", "page_ord").collect()]
    assert got == [("a", 4, "one <!--page 5-->"), ("a", 7, "two"), ("b", 1, "plain"), ("c", 1, "<!-- page 3 -->  ")] or got == [
        ("a", 4, "one"), ("a", 7, "two"), ("b", 1, "plain"), ("c", 1, "<!-- page 3 -->  ")
    ]


def test_chunks_match_loop(spark):
    def loop(text, size, overlap):
        if len(text) <= size:
            return [text]
        out, start = [], 0
        while True:
            out.append(text[start : start + size])
            if start + size >= len(text):
                return out
            start += size - overlap

    texts = ["", "a" * 10, "b" * 11, "".join(chr(97 + i % 26) for i in range(1000)), "字" * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in ch.chunks(df, size=10, overlap=3).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {i: loop(t, 10, 3) for i, t in enumerate(texts)}


def test_slices(spark):
    df = spark.createDataFrame([("a", 234), ("b", 0)], "stem string, total long")
    plan = lambda size: [(r["first_page"], r["last_page"]) for r in src.slice_plan(df, "total", size).orderBy("slice_no").collect()]
    assert plan(80) == [(0, 79), (80, 159), (160, 233)]
    assert plan(0) == []
    slices = src.batches(src.slice_plan(df, "total", 20), 8)
    assert sorted({r["batch_no"] for r in slices.collect()}) == [1, 2]
    done = slices.filter("slice_no <= 3")
    assert src.remaining(slices, done, ["stem", "slice_no"]).count() == 9


def test_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.md").write_text("<!-- page 1 -->\n第1章 极限\n甲", encoding="utf-8")
    (tmp_path / "b" / "c.md").write_text("<!-- page 2 -->\n乙\n第2章 导数\n丙", encoding="utf-8")
    stream = src.read_markdown_tree(spark, str(tmp_path), "课")
    got = [(r["chapter"], list(r["pages"])) for r in ch.split_chapters(stream).orderBy("chapter_no").collect()]
    assert got == [("极限", [1]), ("导数", [2])]
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        src.read_markdown_tree(spark, str(tmp_path / "empty"), "课")
    (tmp_path / "note one.txt").write_text("第3章 级数\n内容", encoding="utf-8")
    (tmp_path / "plain.txt").write_text("无标题", encoding="utf-8")
    names = {r["chapter"] for r in src.read_texts(spark, str(tmp_path / "*.txt"), "课").collect()}
    assert names == {"级数", "plain"}


def test_reader_choice():
    assert src.choose_backend("auto") == "mineru"
    assert src.choose_backend("auto", cloud_key=True) == "mineru-http"
    assert src.choose_backend("auto", cloud_key=True, local_tool=True) == "mineru"
    assert src.choose_backend("auto", default="mineru-http") == "mineru-http"
    assert src.reader_for("x.md") == "text" and src.reader_for("x.PPTX") == "mineru-http"
    for path, backend in [("x.pdf", "pypdf"), ("x.docx", "mineru")]:
        with pytest.raises(ValueError):
            src.reader_for(path, backend)
