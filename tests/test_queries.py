"""Every query of the inventory runs; where it has SQL, both give the same rows."""

import pytest
from compare import TABLES, spark_rows, sql_rows

from loomspark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLE_SQL:
        assert (names, rows) == sql_rows(catalog.ORACLE_SQL[name], sf_dir)
    else:
        assert rows


def test_saved_files_of_pages_that_share_a_url(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t != "pages":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    rows = [(1, "https://a.example.com/x-y/one.html", "p"), (2, "https://a.example.com/x-y/one.html", "q"), (3, "https://a.example.com/x-y/one.html", None), (4, "https://a.example.com/", ""), (5, None, "r"), (6, "https://a.example.com/x y/o|ne two", "s")]
    spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").schema).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    names, found = spark_rows(catalog.QUERIES["saved_files"](spark, str(tmp_path)))
    assert len(found) == len(rows) and (names, found) == sql_rows(catalog.ORACLE_SQL["saved_files"], str(tmp_path))
