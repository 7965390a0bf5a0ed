"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source s with n_s of N rows and target weight w_s (normalised over all sources) has the mean repetition rate
lambda_s = w_s * N / n_s. A document's count is the inverse of the Poisson distribution at a uniform number hashed
from (seed, doc_id), so it needs no state and is the same on every run, partitioning and engine. Documents are
exploded by their count and dealt to a global random order by a hash of (seed, doc_id, copy).

Nulls: a null source is a source of its own, a null id hashes as the word null. Rows that repeat an id get the same
count. A source with weight 0 (or not named in given weights) is dropped, which is what a weight of 0 asks for.
Empty tables give empty results; extra columns are carried through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Without given weights, w_s is proportional to n_s ** TEMPERATURE: large sources are damped, small ones repeated.
TEMPERATURE = 0.5
#: Rates of at most this many sources are broadcast (under 10 MB); more are joined by key.
MAX_BROADCAST_SOURCES = 20_000


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits from an md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_first(rate: Column) -> Column:
    """The count that poisson_cdf starts from: 0, or for high rates one below which lies no 52-bit uniform number."""
    return F.when(rate <= 500, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """Array of the cumulative probabilities of poisson_first, and one more ...; long enough for any 52-bit uniform number."""
    first, last = poisson_first(rate), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # exp(-rate) is 0 for rates above 745; there the first term comes from logarithms, k! by Stirling's series
    k = F.greatest(first, F.lit(1)).cast("double")
    high = F.exp(k * F.log1p((rate - k) / k) - (rate - k) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
    p = F.when(first == 0, F.exp(-rate)).otherwise(high)
    start = F.struct(p.alias("p"), F.array(p).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate, first, cdf) for every source, from counts over all rows."""
    by = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        by = by.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        by = by.withColumn("w", F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0))
    total = by.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))  # one row
    out = by.crossJoin(F.broadcast(total)).filter("w > 0").select("source", "n", (F.col("w") / F.col("tw") * F.col("tn") / F.col("n")).alias("rate"))
    return out.withColumn("first", poisson_first(F.col("rate"))).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Documents repeated to the target mix, globally shuffled; adds ``copy`` (from 1) and ``shuffle_key``."""
    r = rates(docs, weights, temperature).select(F.col("source").alias("_s"), F.col("first").alias("_first"), F.col("cdf").alias("_cdf"))
    few = r.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    joined = docs.join(F.broadcast(r) if few else r, F.col("source").eqNullSafe(F.col("_s")), "inner")
    u = hash_uniform(str(seed), F.col("doc_id"))
    count = F.col("_first") + F.size(F.filter(F.col("_cdf"), lambda c: c <= F.col("_u")))
    out = joined.withColumn("_u", u).withColumn("_n", count).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    out = out.drop("_s", "_first", "_cdf", "_u", "_n").withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    # hash dealing then a sort inside each partition: file after file this is one global random order, without a sampling pass
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
