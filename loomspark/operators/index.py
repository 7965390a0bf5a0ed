"""Incremental index maintenance by content ids, versions and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op): added, removed, changed or same, by a null-safe comparison of ``value``."""
    o = old.select(F.col(key).alias("_ok"), F.col(value).alias("_ov"))
    n = new.select(F.col(key).alias("_nk"), F.col(value).alias("_nv"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    op = F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed").when(~F.col("_ov").eqNullSafe(F.col("_nv")), "changed").otherwise("same")
    return both.select(F.coalesce("_ok", "_nk").alias(key), op.alias("op"))


def sync_plan(index: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """(key, op): add what the index lacks, keep what both have, delete what no chunk has any more."""
    i, c = index.select(F.col(key).alias("_i")).distinct(), chunks.select(F.col(key).alias("_c")).distinct()
    both = i.join(c, F.col("_i") == F.col("_c"), "full_outer")
    op = F.when(F.col("_i").isNull(), "add").when(F.col("_c").isNull(), "delete").otherwise("keep")
    return both.select(F.coalesce("_i", "_c").alias(key), op.alias("op"))


def full_rebuild(index: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """The plan after a change of the embedding model: everything old goes, everything new is embedded."""
    return index.select(key).distinct().withColumn("op", F.lit("delete")).unionByName(chunks.select(key).distinct().withColumn("op", F.lit("add")))


def planned(index: DataFrame, chunks: DataFrame, key: str, index_model: str, model: str) -> DataFrame:
    """``sync_plan`` while the model stays, ``full_rebuild`` when it changed."""
    return sync_plan(index, chunks, key) if index_model == model else full_rebuild(index, chunks, key)


def merge(index: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """The next version: chunks that stay keep the index's computed columns, new ones come without them, stale ones go."""
    extra = [c for c in index.columns if c not in chunks.columns]
    return chunks.join(index.select(key, *extra), key, "left")


def may_shrink(old: DataFrame, new: DataFrame, share: float = 0.8) -> bool:
    """False if the new version has fewer than ``share`` of the old one's rows."""
    return new.count() >= share * old.count()


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``base`` with updates put over them; of several updates for a key the last by ``order`` counts."""
    cols = [c for c in base.columns if c != key]
    if order:
        updates = updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_u")).select(key, "_u.*")
    b = base.select(F.col(key).alias("_bk"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    u = updates.select(F.col(key).alias("_uk"), *[F.col(c).alias(f"_u_{c}") for c in cols])
    both = b.join(u, F.col("_bk") == F.col("_uk"), "full_outer")
    return both.select(F.coalesce("_uk", "_bk").alias(key), *[F.when(F.col("_uk").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in cols])


def keep_last_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of the last row in order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a version beside the others and point to it; readers use one version whole."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], "version long, path string").write.mode("append").parquet(f"{folder.rstrip('/')}/pointer")
    return path


def read_current(spark, folder: str) -> DataFrame:
    """The version last pointed to."""
    row = spark.read.parquet(f"{folder.rstrip('/')}/pointer").orderBy(F.desc("version")).first()
    return spark.read.parquet(row["path"])
