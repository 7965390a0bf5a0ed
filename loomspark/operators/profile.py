"""Profiles of one table and drift between two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_pct, unique_pct): one pass; null counts as a value of its own, NaN as missing."""
    aggs = [F.count(F.lit(1)).alias("n")]
    kinds = dict(df.dtypes)
    for i, c in enumerate(columns):
        v = F.when(F.isnan(c), None).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), (F.count_distinct(v) + F.coalesce(F.max(v.isNull().cast("int")), F.lit(0))).alias(f"u{i}")]
    row = df.agg(*aggs)
    pct = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("n")), F.lit(0.0)) * 100
    parts = F.array(*[F.struct(F.lit(c).alias("column"), pct(f"m{i}").alias("missing_pct"), pct(f"u{i}").alias("unique_pct")) for i, c in enumerate(columns)])
    return row.select(F.explode(parts).alias("r")).select("r.*")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): population deviation over values that are there; 0 for none."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).cast("double"))
    aggs = [x for i, c in enumerate(columns) for x in (F.coalesce(F.avg(clean(c)), F.lit(0.0)).alias(f"a{i}"), F.coalesce(F.stddev_pop(clean(c)), F.lit(0.0)).alias(f"s{i}"))]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(parts).alias("r")).select("r.*")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """(value, share), null as a value. The total comes from the counts, so the table is read once."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("share"))


def total_variation(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: half the sum of absolute differences of the two distributions, nulls aligned."""
    p, q = distribution(a, value).withColumnsRenamed({"value": "v", "share": "p"}), distribution(b, value).withColumnsRenamed({"value": "w", "share": "q"})
    both = p.join(q, F.col("v").eqNullSafe(F.col("w")), "full_outer")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) * 0.5).alias("tvd"))


def schema_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status): shared, missing (only in a) or extra (only in b), sorted. Schemas alone are read."""
    x, y = set(a.columns), set(b.columns)
    rows = [(c, "shared" if c in x & y else "missing" if c in x else "extra") for c in sorted(x | y)]
    return a.sparkSession.createDataFrame(rows, "column string, status string")


def audit(a: DataFrame, b: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(metric, column, value): mean and deviation shifts of numeric columns, drift of the others."""
    m, n = numeric_summary(a, numeric), numeric_summary(b, numeric)
    both = m.join(n.withColumnsRenamed({"mean": "mean2", "std": "std2"}), "column")
    out = both.select(F.lit("mean_delta").alias("metric"), "column", F.abs(F.col("mean") - F.col("mean2")).alias("value")).union(both.select(F.lit("std_delta"), "column", F.abs(F.col("std") - F.col("std2"))))
    for c in categorical:
        out = out.union(total_variation(a, b, c).select(F.lit("tvd"), F.lit(c), "tvd"))
    return out


def markdown_report(metrics: DataFrame, title: str) -> DataFrame:
    """One row ``report``: an audit (metric, column, value) as a markdown table, by column and metric. The audit has a few rows a column."""
    line = F.format_string("| %s | %s | %.4f |", "column", "metric", "value")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("column", "metric", line.alias("x")))), lambda s: s["x"])
    head = f"# {title}\n\n| column | metric | value |\n| --- | --- | --- |\n"
    return metrics.agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("report"))
