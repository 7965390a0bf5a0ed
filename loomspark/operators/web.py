"""Link graphs and crawl operators over tables of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import html as H
from ..functions import urls as U
from ..scratch import scratch


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, pos, dst): every link of every page, made absolute."""
    rows = pages.select("page_id", F.col("url").alias("src"), F.posexplode(H.links("html")).alias("pos", "href"))
    return rows.select("page_id", "src", "pos", U.absolute("src", "href").alias("dst"))


def longest_anchor(links: DataFrame, url: str, text: str, pos: str) -> DataFrame:
    """Per URL the link with the longest text, the first of equals; links without text go."""
    w = W.partitionBy(url).orderBy(F.length(text).desc(), pos)
    return links.filter(F.length(text) > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int, budget: int | None = None, carry: str | None = None, expand: Callable[[int], Column] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(node, depth) reached from ``seeds(node)`` over ``edges(src, dst)`` within ``depth`` steps.

    A level is one join with the edges and one anti join with what was seen, written before the next begins, so the plan
    does not grow with the depth. ``budget`` keeps the nodes first in order of depth and name. ``carry`` names a column
    of ``seeds`` that reached nodes inherit from their parent (the smallest of several). ``expand`` gives, for a depth, the
    condition on nodes of that depth whose links are followed. ``redirects(node, target)``: a link to a node that redirects
    reaches its target instead, so the target is what is seen and kept.
    """
    spark = edges.sparkSession
    extra = [carry] if carry else []
    folder = scratch(spark, "crawl")
    if redirects is not None:
        to = redirects.select(F.col("node").alias("dst"), "target")
        edges = edges.join(to, "dst", "left").select("src", F.coalesce("target", "dst").alias("dst"))
    level = seeds.select("node", F.lit(0).alias("depth"), *extra).dropDuplicates(["node"])
    level.write.parquet(f"{folder}/level=0")
    schema = level.schema
    for d in range(1, depth + 1):
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        last = spark.read.schema(schema).parquet(f"{folder}/level={d - 1}")
        last = last.filter(expand(d - 1)) if expand else last
        reached = last.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.lit(d).alias("depth"), *[F.min(c).alias(c) for c in extra])
        reached.join(seen.select("node"), "node", "left_anti").select(*schema.names).write.parquet(f"{folder}/level={d}")
        if spark.read.schema(schema).parquet(f"{folder}/level={d}").isEmpty():
            break
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return out.orderBy("depth", "node").limit(budget) if budget is not None else out


def first_by_hash(pages: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """Pages with different content; of equal ones the first in order."""
    return pages.withColumn("hash", F.sha1(content)).withColumn("_n", F.row_number().over(W.partitionBy("hash").orderBy(*order))).filter("_n = 1").drop("_n")


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed``: the longest rule prefix (host, prefix, allow) of a URL's path decides, allow wins ties, none allows."""
    x = urls.withColumn("_h", U.host(url)).withColumn("_p", F.when(U.path(url) == "", "/").otherwise(U.path(url)))
    r = rules.groupBy(F.col("host").alias("_rh")).agg(F.collect_set(F.struct("prefix", "allow")).alias("_rules"))
    joined = x.join(r, F.col("_h") == F.col("_rh"), "left")
    fit = F.filter("_rules", lambda q: F.col("_p").startswith(q["prefix"]))
    best = F.array_max(F.transform(fit, lambda q: F.struct(F.length(q["prefix"]).alias("n"), q["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_h", "_p", "_rh", "_rules")


