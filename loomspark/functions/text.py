"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Detail keys that say nothing about a product, left out of its text.
IGNORED_DETAILS = ("Part Number", "Best Sellers Rank", "Batteries Included?", "Batteries Required?", "Item model number")
# Pounds per unit of weight, as divisors and factors.
OUNCES, GRAMS, MILLIGRAMS, KILOGRAMS, HUNDREDTHS = 16.0, 453.592, 453592.0, 0.453592, 100.0
# Fixed value: what counts as a part number (the lookaheads see the rest of the line, which is kept as it is).
PART_NUMBER = r"\b(?=[A-Z0-9]{7,}\b)(?=.*[A-Z])(?=.*\d)[A-Z0-9]+\b"
# Fixed value: a number in a predicted price.
FIRST_NUMBER = r"[-+]?\d*\.\d+|\d+"
# Words that the keyword index leaves out.
STOPWORDS = "a an and are as at be by can do does for from how i in is it its me my of on or should so that the this to use using what when where which who why will with you your".split()


def col(c: Column | str) -> Column:
    """A column by name, or itself."""
    return F.col(c) if isinstance(c, str) else c


def try_number(c: Column | str) -> Column:
    """The number a text spells, or null."""
    return col(c).cast("string").try_cast("double")


def simplify(c: Column | str, limit: int = 3000) -> Column:
    """Line breaks to blanks, no carriage returns or tabs, double blanks halved once, trimmed, cut."""
    x = F.replace(F.replace(F.replace(col(c), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(""))
    return F.substring(F.trim(F.replace(x, F.lit("  "), F.lit(" "))), 1, limit)


def scrub(title: Column | str, description: Column | str, features: Column | str, details: Column | str, limit: int = 4000) -> Column:
    """One text of a product without the ignored details and without part numbers. ``details`` is map<string,string>."""
    kept = F.map_filter(col(details), lambda k, v: ~k.isin(*IGNORED_DETAILS))
    text = F.concat_ws("\n", col(title), simplify(F.array_join(col(description), " ")), simplify(F.array_join(col(features), " ")), F.to_json(kept))
    return F.substring(F.trim(F.regexp_replace(text, PART_NUMBER, "")), 1, limit)


def weight_in_pounds(c: Column | str) -> Column:
    """'2.5 Pounds', '12 ounces', '3 hundredths pounds' ... in pounds; 0 for anything else."""
    parts = F.split(col(c), " ")
    amount, unit = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.lower(F.try_element_at(parts, F.lit(2)))
    third = F.lower(F.try_element_at(parts, F.lit(3)))
    out = (
        F.when(unit == "pounds", amount)
        .when(unit == "ounces", amount / OUNCES)
        .when(unit == "grams", amount / GRAMS)
        .when(unit == "milligrams", amount / MILLIGRAMS)
        .when(unit == "kilograms", amount / KILOGRAMS)
        .when((unit == "hundredths") & (third == "pounds"), amount / HUNDREDTHS)
    )
    return F.coalesce(out, F.lit(0.0))


def price_text(price: Column | str) -> Column:
    """A price rounded half to even, as '12.00'."""
    return F.concat(F.bround(col(price), 0).cast("bigint").cast("string"), F.lit(".00"))


# The wording of prompts.
QUESTION = "What does this cost to the nearest dollar?"
PREFIX = "Price is $"


def cut_to_tokens(text: Column | str, most: int, encode: Callable[[str], list[int]] | None = None, decode: Callable[[list[int]], str] | None = None) -> Column:
    """A text's first ``most`` tokens, by any tokenizer's two functions; without them tokens are what blanks part."""
    if encode is None:
        return F.array_join(F.slice(F.split(col(text), " "), 1, most), " ")

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(encode(x)[:most]))

    return cut(col(text))


def made_prompt(text: Column | str, price: Column | str, most: int, do_round: bool, encode: Callable[[str], list[int]] | None = None, decode: Callable[[list[int]], str] | None = None) -> Column:
    """struct(prompt, completion): the text cut to ``most`` tokens; the price rounded half to even, or exact."""
    answer = price_text(price) if do_round else col(price).cast("string")
    prompt = F.concat(F.lit(QUESTION + "\n\n"), cut_to_tokens(text, most, encode, decode), F.lit("\n\n" + PREFIX))
    return F.struct(prompt.alias("prompt"), answer.alias("completion"))


def price_prompt(text: Column | str, price: Column | str) -> Column:
    """Training prompt: question, text and price."""
    return F.concat(F.lit(QUESTION + "\n\n"), col(text), F.lit("\n\n" + PREFIX), price_text(price))


def question_prompt(prompt: Column | str) -> Column:
    """A training prompt without its answer."""
    return F.concat(F.substring_index(col(prompt), PREFIX, 1), F.lit(PREFIX))


def first_number(c: Column | str) -> Column:
    """The first number in a text without dollar signs and commas; 0 if there is none."""
    bare = F.replace(F.replace(col(c), F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(F.regexp_extract(bare, FIRST_NUMBER, 0).try_cast("double"), F.lit(0.0))


def name_as_title(c: Column | str) -> Column:
    """A function's name as a heading: two underscores to a dot, one to a blank, title case, GPT in capitals."""
    return F.replace(F.initcap(F.replace(F.replace(col(c), F.lit("__"), F.lit(".")), F.lit("_"), F.lit(" "))), F.lit("Gpt"), F.lit("GPT"))


def ellipsis(c: Column | str, most: int = 40) -> Column:
    """A text cut to ``most`` characters and dots."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def tokenize(c: Column | str, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case ASCII words; compounds by - _ or . also give their parts; stop words go."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([a-z0-9]+(?:[-_.][a-z0-9]+)*)"), F.lit(1))
    parts = lambda t: F.when(t.rlike("[-_.]"), F.concat(F.array(t), F.split(t, "[-_.]"))).otherwise(F.array(t))
    return F.filter(F.flatten(F.transform(found, parts)), lambda t: ~t.isin(*stopwords))


def slugify(c: Column | str, default: str = "") -> Column:
    """Lower case, other signs to single dashes, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def clean_markdown(c: Column | str) -> Column:
    """No blanks at line ends, at most one empty line in a row, trimmed."""
    x = F.regexp_replace(F.regexp_replace(col(c), "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n")
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


# Lines of navigation that a page's text does not need.
BOILERPLATE = (r"^\s*Skip to main content\s*$", r"^\s*On this page\s*$", r"^\s*Edit this page.*$", r"^\s*Next.*$", r"^\s*Previous.*$", r"^\s*Table of contents\s*$")


def drop_boilerplate(c: Column | str, patterns: Sequence[str] = BOILERPLATE) -> Column:
    """Lines that match no boilerplate pattern."""
    keep = lambda line: ~F.coalesce(line.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return F.array_join(F.filter(F.split(col(c), "\n"), keep), "\n")


def clean_words(c: Column | str) -> Column:
    """White space collapsed, signs other than word characters and . , + # / - to blanks."""
    x = F.regexp_replace(col(c), r"\s+", " ")
    return F.trim(F.regexp_replace(x, r"(?U)[^\w\s.,+#/-]", " "))


def snippet(html: Column | str, most: int = 100) -> Column:
    """Tags out, on one line, cut."""
    return F.substring(F.replace(F.trim(F.regexp_replace(col(html), "<[^<]+?>", "")), F.lit("\n"), F.lit(" ")), 1, most)


def strip_fence(c: Column | str) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```[a-zA-Z+]*\n?", ""), r"\n?```$", ""))


def judge_score(c: Column | str, default: int = 3) -> Column:
    """The number after 'score=' clamped to 1..5."""
    n = F.regexp_extract(F.lower(col(c)), r"score\s*=\s*(\d+)", 1).try_cast("int")
    return F.when(n.isNull(), default).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(5)))


def citations(c: Column | str) -> Column:
    """Distinct numbers in square brackets, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def code_blocks(c: Column | str) -> Column:
    """Array of (language, body) of the fenced blocks."""
    pattern = r"(?s)```(\w*)\n(.*?)\n```"
    return F.arrays_zip(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1)).alias("language"), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(2)).alias("body"))


def chunk_id(kind: Column | str, body: Column | str) -> Column:
    """The content's identity: 24 hex digits of the sha1 of kind and text."""
    return F.substring(F.sha1(F.concat(col(kind), F.lit("\n"), col(body))), 1, 24)


# Colour codes of log lines and the colours they are shown in.
ANSI = {
    "\x1b[40m\x1b[31m": "#dd0000",
    "\x1b[40m\x1b[32m": "#00dd00",
    "\x1b[40m\x1b[33m": "#dddd00",
    "\x1b[40m\x1b[34m": "#0000ee",
    "\x1b[40m\x1b[35m": "#aa00dd",
    "\x1b[40m\x1b[36m": "#00dddd",
    "\x1b[40m\x1b[37m": "#87CEEB",
    "\x1b[44m\x1b[37m": "#ff7800",
}


def ansi_to_html(c: Column | str) -> Column:
    """Colour codes as spans."""
    x = col(c)
    for code, colour in ANSI.items():
        x = F.replace(x, F.lit(code), F.lit(f'<span style="color: {colour}">'))
    return F.replace(x, F.lit("\x1b[0m"), F.lit("</span>"))


def score_label(c: Column | str) -> Column:
    """Match strength of a percentage."""
    x = col(c)
    return F.when(x >= 80, "strong").when(x >= 60, "good").when(x >= 40, "partial").otherwise("weak")


def traffic_light(c: Column | str, good: float, fair: float) -> Column:
    """green, orange or red by two thresholds."""
    return F.when(col(c) >= good, "green").when(col(c) >= fair, "orange").otherwise("red")


def minutes_text(c: Column | str) -> Column:
    """Minutes as '24h 20m'."""
    return F.format_string("%dh %02dm", F.floor(col(c) / 60).cast("int"), (col(c) % 60).cast("int"))


def message_text(content: Column | str) -> Column:
    """A chat message's text: the text itself, or the text parts of a JSON list joined by blanks."""
    parts = F.from_json(F.when(F.trim(col(content)).startswith("["), col(content)), "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), " "), col(content))
