"""Record curation: parse and filter, dedup in sequence, weighted sampling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..scratch import written

MIN_PRICE, MAX_PRICE, MIN_CHARS = 0.5, 999.49, 600


def hash_uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from an md5 of the parts: the same on every run, partitioning and engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def parse_items(raw: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Items of raw product rows: numeric price in range, cleaned text long enough, weight in pounds.

    The price filter comes before any text work, and everything stays in one stage. Lists are joined with blanks and
    details are rendered as compact JSON, so lengths can differ a little from a Python rendering.
    """
    rows = raw.withColumn("price", T.try_number("price")).filter(F.col("price").between(MIN_PRICE, MAX_PRICE))
    details = F.coalesce(F.from_json("details", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("_details", details).withColumn("full", T.scrub("title", "description", "features", "_details"))
    rows = rows.filter(F.length("full") >= min_chars).withColumn("weight", T.weight_in_pounds(F.try_element_at("_details", F.lit("Item Weight"))))
    return rows.drop("_details")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def dedup_in_sequence(items: DataFrame, order: list[Column], keys: tuple[str, ...] = ("title", "full")) -> DataFrame:
    """By title, then by text on the survivors: the second pass sees only what the first one kept."""
    for k in keys:
        items = keep_first(items, [k], order)
    return items


def sample_weights(items: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Adds ``weight_of``: squared normalised price times the category's factor. One pre-aggregated row carries the range."""
    ends = items.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    factor = F.lit(1.0)
    for category, f in factors.items():
        factor = F.when(F.col("category") == category, f).otherwise(factor)
    return items.crossJoin(F.broadcast(ends)).withColumn("weight_of", F.pow((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), 2.0) * factor).drop("lo", "hi")


def weighted_sample(items: DataFrame, n: int, factors: dict[str, float], seed: int = 42, key: str = "id") -> DataFrame:
    """n rows without replacement, chances by weight: the n largest ln(u)/w with u hashed from the key (Efraimidis and Spirakis).

    Rows of weight zero are never chosen; too few others raise. The top n come from a bounded heap per task.
    """
    rows = sample_weights(items, factors).filter("weight_of > 0")
    if rows.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows have a weight above zero")
    return rows.withColumn("_k", F.ln(hash_uniform(str(seed), F.col(key))) / F.col("weight_of")).orderBy(F.col("_k").desc(), key).limit(n).drop("_k", "weight_of")


def shuffled(df: DataFrame, key: str, seed: int) -> list[Column]:
    """Sort columns of a global order by hash."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in a global order: adds ``_p``, the partition in order, and ``_i``, the place in it from 0.

    Written once, since a range partitioning that is computed again may draw other bounds.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return written(rows.withColumns({"_p": F.shiftright("_m", 33).cast("int"), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "ranged")


def before_each(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Of one row per partition ``_p``, the sums over the partitions before it; no more rows than there are partitions."""
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(parts.select("_p", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums]))


def numbered(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Rows numbered from 0 in a global order, without one task seeing them all.

    Rows are range-partitioned and sorted; each partition's offset is the sum of the counts before it, and only those
    counts meet in one place.
    """
    rows = ranged(df, order)
    before = before_each(rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_b")), ["_b"])
    return rows.join(before, "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def running_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds running sums in a global order, without one task seeing all rows: sums inside a partition and of the ones before it."""
    names = list(values)
    rows = ranged(df.withColumns(values), order)
    before = before_each(rows.groupBy("_p").agg(*[F.sum(c).alias(f"_{c}") for c in names]), [f"_{c}" for c in names])
    w = W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({c: F.sum(c).over(w) for c in names}).join(before, "_p").withColumns({c: F.col(c) + F.col(f"_{c}") for c in names}).drop("_p", "_i", *[f"_{c}" for c in names])


def split_prefixes(df: DataFrame, sizes: dict[str, int], seq: str = "seq") -> DataFrame:
    """Consecutive splits of given sizes by running number; what is left goes."""
    case, at = None, 0
    for name, n in sizes.items():
        cond = (F.col(seq) >= at) & (F.col(seq) < at + n)
        case = F.when(cond, name) if case is None else case.when(cond, name)
        at += n
    return df.withColumn("split", case).filter("split is not null")


def histogram(df: DataFrame, value: str, edges_to: int, width: int) -> DataFrame:
    """Counts of fixed-width bins from 0; the last bin includes its upper edge, values outside go."""
    last = edges_to // width - 1
    v = F.col(value)
    return df.filter((v >= 0) & (v <= (last + 1) * width)).groupBy(F.least(F.floor(v / width), F.lit(last)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
