"""Fixed vectors of scalar functions."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from loomspark.functions import html as H
from loomspark.functions import text as T
from loomspark.functions import urls as U
from loomspark.operators import chunking as K
from loomspark.operators import skills as S


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values) or (1,)], ", ".join(f"c{i} string" for i in range(max(1, len(values)))) if values else "c0 int")
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("$1,234.56", 1234.56), ("about 40 dollars", 40), ("-5", 5), ("-5.0", -5), ("n/a", 0)])
def test_first_number(spark, text, want):
    assert one(spark, T.first_number("c0"), text) == want


@pytest.mark.parametrize("text,want", [("2.5 Pounds", 2.5), ("12 ounces", 0.75), ("3 hundredths pounds", 0.03), ("5 stone", 0), (None, 0), ("heavy", 0)])
def test_weight(spark, text, want):
    assert one(spark, T.weight_in_pounds("c0"), text) == pytest.approx(want)


def test_part_numbers(spark):
    x = F.regexp_replace("c0", T.PART_NUMBER, "")
    assert one(spark, x, "STAINLESS steel 5 pack AB12345X 1234567 end") == " steel 5 pack  1234567 end"


def test_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,)], "p double")
    assert [r[0] for r in df.select(T.price_text("p")).collect()] == ["2.00", "4.00"]


def test_tokenize(spark):
    assert one(spark, T.tokenize("c0"), "Sign a pe-file via v1.2_x") == ["sign", "pe-file", "pe", "file", "via", "v1.2_x", "v1", "2", "x"]


def test_chunk_id(spark):
    assert one(spark, T.chunk_id(F.lit("text"), "c0"), "x") == "d1ea8e5dbfa28e2e7a6e9d43"


@pytest.mark.parametrize("n,chunks", [(0, 0), (100, 1), (500, 1), (501, 2), (900, 2), (901, 3)])
def test_word_windows(spark, n, chunks):
    assert len(one(spark, K.word_windows("c0"), " ".join(["w"] * n))) == chunks


def test_skill_boundaries(spark):
    assert one(spark, S.extract_skills("c0"), "c++, github actions, node.js") == ["c++", "github actions", "node.js"]


def test_urls(spark):
    c = lambda u: one(spark, U.canonical("c0"), u)
    assert c("http://a.com/x/index.html?q=1#f") == "https://a.com/x"
    assert c("https://a.com") == "https://a.com/"
    assert c("https://a.com/x.PNG") is None and c("mailto:x@y") is None and c("https://a.com/feeds/x") is None
    j = lambda b, h: one(spark, U.absolute("c0", "c1"), b, h)
    assert j("https://a.com/x/y?q", "z") == "https://a.com/x/z"
    assert j("https://a.com/x/y", "/z") == "https://a.com/z" and j("https://a.com/x", "//b.org/z") == "https://b.org/z"
    assert j("https://a.com/x#f", "#g") == "https://a.com/x#g"


def test_html():
    page = "<html><head><title>T</title><script>x</script></head><body><nav>n</nav><main><h1 id=a>One</h1><p>p1</p><h2>Two</h2><ul><li>a<li>b</ul><pre><code class='language-py'>x = 1</code></pre><table><tr><th>c<th>d</tr><tr><td>1<td>2</td></tr></table><img src=i.png alt=I></main></body></html>"
    s = H.sections_of(page)
    assert [x["path"] for x in s] == [["One"], ["One", "Two"]] and s[0]["anchor"] == "a"
    assert "```py\nx = 1\n```" in s[1]["text"] and "| c | d |" in s[1]["text"] and s[1]["images"] == [{"src": "i.png", "alt": "I"}]
    assert H.visible_text(page).startswith("T\n\n") and "x = 1" in H.visible_text(page)
    assert H.visible_text(None) == "No title found\n\n" and H.sections_of("") == []


def test_chunks(spark):
    text = "intro\n\n```py\n" + "x = 1\n" * 10 + "```\n\n| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | v{i} |" for i in range(6))
    section = {"path": ["A", "B"], "anchor": "z", "text": text, "images": [{"src": "i", "alt": ""}, {"src": "", "alt": "none"}]}
    empty = {"path": ["A"], "anchor": None, "text": None, "images": None}
    pages = spark.createDataFrame([(1, "u", "P", "s", 2, [section, empty])], "page_id long, url string, title string, source string, page_no long, sections array<struct<path:array<string>,anchor:string,text:string,images:array<struct<src:string,alt:string>>>>")
    rows = K.build_chunks(pages).collect()
    kinds = [r.type for r in rows]
    assert kinds.count("table-row") == 6 and kinds.count("code") == 1 and kinds.count("image") == 1 and kinds.count("text") == 1
    by = {r.type: r for r in rows}
    head = "Source: s\nPage: P\nSection: A > B\nURL: u#z\n\n"
    assert by["image"].text == head + "Image: screenshot\nShown in section: A > B\n\n" + K.FENCE.sub("", text).strip()
    assert by["code"].text == head + "Example (py):\nintro\n\n```py\n" + ("x = 1\n" * 10)[:-1] + "\n```" and by["code"].lang == "py"
    assert by["text"].text.endswith("\n\n(Table with one entry per row: a | b)") and by["text"].position == 2000
    assert by["table-row"].text.startswith(head + "Table row:\n- a: ")
    assert all(len(p) <= 60 for p in K.packed("\n\n".join(["word " * 5] * 10), 60))
    big = "```\n" + "\n".join(["y" * 30] * 30) + "\n```"
    assert all(p.startswith("```\n") and p.endswith("\n```") for p in K.packed(big, 100)) and len(K.packed(big, 100)) > 1
    assert all(len(x) <= 100 for x in K.recursive_split("alpha beta " * 100, 100, 20))


def slow_blocks(text):
    """Blocks line by line, another way: every empty line outside a fence ends a block."""
    lines = text.splitlines()
    marks = [x.lstrip().startswith("```") for x in lines]
    empty = [not x.strip() and sum(marks[: i + 1]) % 2 == 0 for i, x in enumerate(lines)]
    return ["\n".join(x for x, _ in g) for is_empty, g in groupby(zip(lines, empty, strict=True), lambda p: p[1]) if not is_empty]


def slow_fill(sizes, gap, limit):
    runs, room = [], -1
    for n in sizes:
        if runs and n + gap <= room:
            runs[-1] += 1
            room -= n + gap
        else:
            runs.append(1)
            room = limit - n
    return runs


def test_blocks_and_packing():
    r = random.Random(3)
    for _ in range(300):
        text = "\n".join(r.choice(["a", "bb cc", "", " ", "```", "```py", "  ```", "| x"]) for _ in range(r.randrange(0, 25)))
        assert K.blocks(text) == slow_blocks(text), text
        parts = ["x" * r.randrange(0, 40) for _ in range(r.randrange(0, 20))]
        gap, limit = r.randrange(0, 3), r.randrange(1, 90)
        assert [len(x) for x in K.fill(parts, gap, limit)] == slow_fill([len(p) for p in parts], gap, limit)


def test_misc(spark):
    assert one(spark, T.judge_score("c0"), "Score= 9") == 5 and one(spark, T.judge_score("c0"), "none") == 3
    assert one(spark, T.citations("c0"), "[3] [1] [3]") == [1, 3]
    assert one(spark, T.strip_fence("c0"), "```cpp\nint x;\n```") == "int x;"
    assert one(spark, T.slugify("c0", "company"), "!!") == "company"
    assert one(spark, T.drop_boilerplate("c0"), "Next page\nkeep\nOn this page") == "keep"
