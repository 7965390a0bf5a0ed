"""Scans: Parquet by split, CSV with header sniffing, JSON lines, text and binary folders, XML feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import before_each, running_sums
from ..scratch import written

ITEM = "title string, category string, price double, full string, weight double, summary string, prompt string, completion string, id bigint"


def read_split(spark: SparkSession, path: str, split: str | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet dataset or one of its splits; the filter prunes the split's folder."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.filter(F.col("split") == split) if split else df


def read_splits(spark: SparkSession, path: str, config: str | None = None, schema: str = ITEM, names: tuple[str, ...] = ("train", "validation", "test")) -> tuple[DataFrame, ...]:
    """The splits of a named configuration of a dataset as typed rows, in order.

    A dataset is a folder, partitioned by ``config`` (where it has several) and ``split``; both filters prune folders.
    """
    parts = ", config string" * (config is not None) + ", split string"
    df = spark.read.schema(schema + parts).parquet(path)
    df = df.filter(F.col("config") == config).drop("config") if config is not None else df
    return tuple(df.filter(F.col("split") == n).drop("split") for n in names)


def read_csv_plain(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True)


def suspicious(name: str) -> bool:
    """A column name that looks like data."""
    return "\n" in name or len(name) > 80 or name.isdigit() or ":" in name


def read_csv_pair(spark: SparkSession, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Two CSV files; both without a header (columns col_0, col_1 ...) if their names share nothing, or one name and two look like data."""
    x, y = read_csv_plain(spark, a), read_csv_plain(spark, b)
    bare = lambda n: re.sub(r"(?<=.)\d+$", "", n) if n.startswith("_c") else n
    names = [bare(n) for n in x.columns + y.columns]
    shared = set(x.columns) & set(y.columns)
    if not shared or (len(shared) <= 1 and sum(map(suspicious, names)) >= 2):
        x, y = (spark.read.csv(p, header=False, inferSchema=True) for p in (a, b))
        x, y = (d.toDF(*[f"col_{i}" for i in range(len(d.columns))]) for d in (x, y))
    return x, y


def read_csv_positions(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """(pos, value): one column of a headerless CSV by its number, rows numbered from 0 as they stand in the file."""
    df = spark.read.csv(path, header=False)
    rows = df.select(F.monotonically_increasing_id().alias("_m"), F.col(df.columns[column]).try_cast("double").alias("value"))
    rows = written(rows.withColumns({"_p": F.shiftright("_m", 33).cast("int"), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}), "positions")
    before = before_each(rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_b")), ["_b"])
    return rows.join(before, "_p").select((F.col("_i") + F.col("_b")).alias("pos"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones fail or give nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def batch_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, content) of batch result lines."""
    content = F.get_json_object(value, "$.response.body.choices[0].message.content")
    return lines.select(F.get_json_object(value, "$.custom_id").try_cast("bigint").alias("id"), content.alias("content"))


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document, an array of rows or a single row."""
    return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)


def read_folder(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("*.md",)) -> DataFrame:
    """(type, source, text) of text files below a folder; type is the first folder, blank files go, unreadable ones are skipped."""
    glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    root = re.escape("/" + path.split("://")[-1].strip("/").lstrip("/"))
    rel = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), f"^.*?{root}/", "")
    return df.select(F.substring_index(rel, "/", 1).alias("type"), rel.alias("source"), F.col("value").alias("text")).filter(F.trim("text") != "")


def read_code(spark: SparkSession, path: str, endings: tuple[str, ...], skip: tuple[str, ...], most: int = 50_000) -> DataFrame:
    """(source, text) of code files by ending, outside skipped folders, up to ``most`` bytes; bytes that are no UTF-8 are replaced."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= most)
    ok = F.lower("path").rlike("(?:" + "|".join(re.escape(e) for e in endings) + ")$") & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip]))
    return df.filter(ok).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))


def key_from_stem(path: Column) -> Column:
    """Last word of a file's stem, lower case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.lower(F.element_at(F.split(stem, " "), -1))


def sitemap(xml: Column) -> Column:
    """Array of (url, lastmod day) of a sitemap's entries in order."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"(?s)<loc>(.*?)</loc>", 1)).alias("url"), F.substring(F.trim(F.regexp_extract(b, r"(?s)<lastmod>(.*?)</lastmod>", 1)), 1, 10).alias("lastmod")))


def feed_entries(feeds: DataFrame, key: str, xml: str, most: int = 10) -> DataFrame:
    """(key, n, title, link) of the first ``most`` entries of every feed, in their order, read from its XML."""
    items = F.slice(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1)), 1, most)
    inside = lambda x, tag: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    return feeds.select(key, F.posexplode(items).alias("n", "_x")).select(key, "n", inside(F.col("_x"), "title").alias("title"), inside(F.col("_x"), "link").alias("link"))


def feed_titles(xml: Column) -> Column:
    """Titles of a feed's items that are not empty."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<item>.*?<title>(.*?)</title>.*?</item>"), F.lit(1)), lambda t: F.trim(t)), lambda t: t != "")


def scan_records(lines: DataFrame, order: str = "line_no", value: str = "value") -> DataFrame:
    """(ssid, auth, enc, bssid, channel, signal) of a network scan's lines: the header fields hold until the next ones."""
    field = lambda p: F.nullif(F.trim(F.regexp_extract(F.col(value), p, 1)), F.lit(""))
    x = lines.select(order, field(r"^SSID \d+\s*:(.*)$").alias("s"), field(r"Authentication\s*:(.*)$").alias("a"), field(r"Encryption\s*:(.*)$").alias("e"), field(r"BSSID \d+\s*:(.*)$").alias("b"), field(r"Channel\s*:(.*)$").alias("c"), field(r"Signal\s*:(.*)$").alias("g"), F.col(value).rlike(r"^SSID \d+\s*:").alias("new"))
    x = running_sums(x, [F.col(order)], {"net": F.col("new").cast("int"), "cell": F.col("b").isNotNull().cast("int")})
    net = x.groupBy("net").agg(F.max("s").alias("ssid"), F.max("a").alias("auth"), F.max("e").alias("enc"))
    cell = x.filter("cell > 0").groupBy("net", "cell").agg(F.max("b").alias("bssid"), F.max("c").alias("channel"), F.max("g").alias("signal")).filter("bssid is not null")
    return cell.join(net, "net").select("ssid", "auth", "enc", "bssid", "channel", "signal")
