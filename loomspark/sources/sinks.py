"""Sinks: split datasets, request files, chat lines, listings, upserts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """One dataset with a folder per split; what was there goes."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def prompts_only(df: DataFrame) -> DataFrame:
    """prompt, completion and split."""
    return df.select("prompt", "completion", "split")


def request_lines(df: DataFrame, model: str, key: str = "id", text: str = "full", size: int = 1000) -> DataFrame:
    """(batch, name, line): batch requests in files of ``size`` ids named first_end.jsonl."""
    batch = F.floor(F.col(key) / size).cast("long")
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(text).alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return df.select(batch.alias("batch"), F.concat((batch * size).cast("string"), F.lit("_"), ((batch + 1) * size).cast("string"), F.lit(".jsonl")).alias("name"), line.alias("line"))


def write_request_files(df: DataFrame, path: str) -> None:
    """One folder of text lines per file name."""
    df.select("name", F.col("line").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def chat_line(user: Column, assistant: Column) -> Column:
    """A fine-tuning line of one exchange."""
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(turn("user", user), turn("assistant", assistant)).alias("messages")))


def listing(df: DataFrame, group: str, name: str) -> DataFrame:
    """(group, listing): a markdown heading and sorted bullet points per group."""
    items = F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col(name))))
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n"), F.array_join(items, "\n")).alias("listing"))


def save_json(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document saved whole or not at all: written beside the old one, then renamed over it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    files = to.getFileSystem(conf)
    out = files.create(part, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(part, to, over)


def page_files(pages: DataFrame, file_name: Column) -> DataFrame:
    """Pages (url, text and their own columns) with the file_path and url_sha1 they are saved under, one row each: pages may share a url."""
    return pages.withColumns({"file_path": file_name, "url_sha1": F.sha1("url")})


def labelling_sheet(df: DataFrame, text: str, order: str, most: int = 100) -> DataFrame:
    """(text, 0) of the first rows, for labelling by hand."""
    return df.orderBy(order).limit(most).select(F.col(text).alias("summary"), F.lit(0).alias("guess"))
