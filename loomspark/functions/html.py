"""HTML functions. Parsing is structural, so these are Arrow pandas UDFs over the standard library's parser."""

from __future__ import annotations

import difflib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

HIDDEN = {"script", "style", "img", "input", "noscript", "svg", "head"}
VOID = {"img", "input", "br", "hr", "meta", "link", "source", "area", "base", "col", "embed", "wbr", "track"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "main", "header", "footer", "nav", "aside", "figure"}


class _Visible(HTMLParser):
    """Title and text that a reader sees."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.hidden, self.in_title = "", [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in HIDDEN and tag not in VOID:
            self.hidden += 1
        if tag in BLOCKS or tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in HIDDEN and tag not in VOID and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None, most: int = 2000) -> str:
    """Title, empty line, visible lines; cut."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    return ((p.title.strip() or "No title found") + "\n\n" + "\n".join(x for x in lines if x))[:most]


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, tables, code and images as markdown; sections by heading with their path."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self.path: list[tuple[int, str]] = []
        self.anchor, self.out, self.images = "", [], []
        self.skip, self.pre, self.lang, self.heading, self.lists = 0, None, "", None, []
        self.row, self.table, self.cell, self.link = None, None, None, None

    def flush(self):
        text = re.sub(r"\n{3,}", "\n\n", "".join(self.out)).strip()
        if text or self.images:
            self.sections.append({"path": [h for _, h in self.path], "anchor": self.anchor, "text": text, "images": self.images})
        self.out, self.images = [], []

    def put(self, s):
        if self.cell is not None:
            self.cell.append(s)
        elif self.heading is not None:
            self.heading[2].append(s)
        else:
            self.out.append(s)

    def end_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def end_row(self):
        self.end_cell()
        if self.row and self.table is not None:
            self.table.append(self.row)
        self.row = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style", "nav", "footer", "noscript", "svg", "head"):
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.heading = (int(tag[1]), a.get("id", ""), [])
        elif tag == "pre":
            self.pre, self.lang = [], ""
        elif tag == "code":
            if self.pre is not None:
                m = re.search(r"language-(\w+)", a.get("class", ""))
                self.lang = m[1] if m else ""
            else:
                self.put("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
            self.put("\n" + "  " * (len(self.lists) - 1) + mark)
        elif tag == "table":
            self.table = []
        elif tag == "tr":
            self.end_row()
            self.row = []
        elif tag in ("td", "th"):
            self.end_cell()
            self.cell = []
        elif tag == "img" and a.get("src"):
            self.images.append({"src": a["src"], "alt": a.get("alt", "")})
        elif tag == "a":
            self.link = a.get("href", "")
        elif tag == "br":
            self.put("\n")
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag in ("p", "div", "section"):
            self.put("\n\n")
        elif tag in ("b", "strong"):
            self.put("**")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav", "footer", "noscript", "svg", "head"):
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag) and self.heading:
            level, anchor, words = self.heading
            self.heading = None
            self.flush()
            self.path = [p for p in self.path if p[0] < level] + [(level, " ".join("".join(words).split()))]
            self.anchor = anchor
        elif tag == "pre" and self.pre is not None:
            code, self.pre = "".join(self.pre).strip("\n"), None
            self.put(f"\n\n```{self.lang}\n{code}\n```\n\n")
        elif tag == "code" and self.pre is None:
            self.put("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n")
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table" and self.table is not None:
            self.end_row()
            if self.table:
                lines = ["| " + " | ".join(r) + " |" for r in self.table]
                lines.insert(1, "|" + " --- |" * len(self.table[0]))
                self.put("\n\n" + "\n".join(lines) + "\n\n")
            self.table = None
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("p", "div", "section"):
            self.put("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.pre is not None:
            self.pre.append(data)
        else:
            self.put(re.sub(r"\s+", " ", data))


def sections_of(html: str | None) -> list[dict]:
    """Sections (path, anchor, text, images) of a page; equal (path, text) once, an image source once with its last text."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    p.flush()
    out, seen = [], set()
    for s in p.sections:
        key = (tuple(s["path"]), s["text"])
        if key in seen:
            continue
        seen.add(key)
        s["images"] = [{"src": k, "alt": v} for k, v in {i["src"]: i["alt"] for i in s["images"]}.items()]
        out.append(s)
    return out


def main_html(html: str | None) -> str:
    """The inside of the first main, article or content element, else of body, else the page."""
    h = html or ""
    for tag in ("main", "article", "body"):
        m = re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", h)
        if m:
            return m[1]
    return h


SECTIONS = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("anchor", T.StringType()), T.StructField("text", T.StringType()), T.StructField("images", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("alt", T.StringType())])))]))


def html_text(html: Column | str) -> Column:
    """``visible_text`` as a column."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(visible_text)

    return f(col(html))


def html_sections(html: Column | str) -> Column:
    """``sections_of`` as a column."""

    @F.pandas_udf(SECTIONS)
    def f(s: pd.Series) -> pd.Series:
        return s.map(sections_of)

    return f(col(html))


def html_main(html: Column | str) -> Column:
    """``main_html`` as a column."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(main_html)

    return f(col(html))


def simple_text(html: Column | str) -> Column:
    """Visible text by built-in expressions alone: hidden elements and tags out, common entities decoded, blanks collapsed."""
    x = F.regexp_replace(col(html), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(x, r"[ \n\t\r]+", " "))


def links(html: Column | str) -> Column:
    """href values in order."""
    return F.regexp_extract_all(col(html), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching runs of characters, 0 to 100 with one decimal."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, p or "", q or "").ratio() * 100, 1) for p, q in zip(x, y, strict=True)])

    return f(col(a), col(b))
