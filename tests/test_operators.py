"""Invariants and fixed results of table operators."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import curation as C
from loomspark.operators import index as I
from loomspark.operators import metrics as M
from loomspark.operators import profile as P
from loomspark.operators import retrieval as R
from loomspark.operators import web as O
from loomspark.sources import tables as S
from loomspark.streaming import streams as ST


def test_ranking_scores(spark):
    df = spark.createDataFrame([(1, 1, False, 2), (1, 2, True, 2), (1, 3, True, 2), (2, 1, False, 2)], "qid int, pos int, rel boolean, total int")
    r = {x.qid: x for x in M.ranking_scores(df, 3, "total").collect()}
    assert r[1].rr == 0.5 and r[1].ndcg_index == pytest.approx(0.693426, abs=1e-6) and r[1].ndcg_list == pytest.approx(0.693426, abs=1e-6) and r[1].precision == pytest.approx(2 / 3)
    assert r[2].rr == 0 and r[2].ndcg_list == 0


def test_running_interval(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "i int, e double")
    r = M.running_interval(df, "e", [F.col("i")]).orderBy("i").collect()
    assert [x["mean"] for x in r] == pytest.approx([1, 1.5, 7 / 3]) and [x["std"] for x in r] == pytest.approx([0, 0.5, 1.247219], abs=1e-6)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "qid int, doc string, rank int")
    b = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "qid int, doc string, rank int")
    assert [x.doc for x in R.reciprocal_rank_fusion(a, b).orderBy("fused_rank").collect()] == ["b", "a", "c"]


def test_greedy_context(spark):
    rows = [(1, "d1", 1, "text", "see code1", "", "u"), (1, "d2", 2, "code", "code1", "code1", "u"), (1, "d3", 3, "image", "i", "", "u"), (1, "d4", 4, "image", "i", "", "v")]
    df = spark.createDataFrame(rows, "qid int, doc string, position int, type string, text string, code string, url string")
    assert [r.doc for r in R.greedy_context(df).orderBy("position").collect()] == ["d1", "d4"]


def test_total_variation_and_health(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "v string"), spark.createDataFrame([("x",), ("x",)], "v string")
    assert P.total_variation(a, b, "v").first()["tvd"] == 0.5
    h = P.column_health(spark.createDataFrame([(1,), (1,), (None,), (2,)], "v int"), ["v"]).first()
    assert h["unique_pct"] == 75 and h["missing_pct"] == 25
    assert P.numeric_summary(spark.createDataFrame([], "v double"), ["v"]).first()["std"] == 0


def test_sequential_dedup(spark):
    df = spark.createDataFrame([(1, "t1", "x"), (2, "t1", "y"), (3, "t2", "y")], "i int, title string, full string")
    assert sorted(r.i for r in C.dedup_in_sequence(df, [F.col("i")]).collect()) == [1, 3]


def test_index_diff_merge_upsert(spark):
    o, n = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("n", None)], "u string, h int"), spark.createDataFrame([("b", 2), ("c", 9), ("d", 4), ("n", None)], "u string, h int")
    assert {r.u: r.op for r in I.diff(o, n, "u", "h").collect()} == {"a": "removed", "b": "same", "c": "changed", "d": "added", "n": "same"}
    plan = I.sync_plan(o.withColumnRenamed("u", "id"), n.withColumnRenamed("u", "id"))
    assert {r.op for r in I.sync_plan(n.withColumnRenamed("u", "id"), n.withColumnRenamed("u", "id")).collect()} == {"keep"} and plan.count() == 5
    u = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("z", 7, 1)], "u string, h int, seq int")
    assert {r.u: r.h for r in I.upsert(o, u, "u", "seq").collect()} == {"a": 6, "b": 2, "c": 3, "n": None, "z": 7}
    assert not I.may_shrink(o, o.limit(3)) and I.may_shrink(o, o)


def test_weighted_sample(spark):
    df = spark.range(1, 201).select("id", F.lit("c").alias("category"), F.col("id").cast("double").alias("price"))
    s = C.weighted_sample(df, 50, {"c": 0.5}).collect()
    assert len({r.id for r in s}) == 50 and 1 not in {r.id for r in s} and sum(r.price for r in s) / 50 > 100.5
    with pytest.raises(ValueError):
        C.weighted_sample(df, 200, {})


def test_numbered_and_splits(spark):
    df = C.numbered(spark.range(0, 1000).repartition(7), [F.col("id").desc()])
    assert df.filter("seq <> 999 - id").count() == 0
    s = C.split_prefixes(df, {"a": 10, "b": 5})
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"a": 10, "b": 5}


def test_histogram(spark):
    df = spark.createDataFrame([(989.0,), (990.0,), (995.0,)], "p double")
    assert [(r.bin, r.n) for r in C.histogram(df, "p", 990, 10).collect()] == [(98, 2)]


def test_breadth_first(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    r = O.breadth_first(e, spark.createDataFrame([("a", "k")], "node string, cat string"), 9, carry="cat")
    assert {(x.node, x.depth, x.cat) for x in r.collect()} == {("a", 0, "k"), ("b", 1, "k"), ("c", 2, "k"), ("d", 3, "k")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("5,6\n7,8\n")
    x, y = S.read_csv_pair(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert x.columns == ["col_0", "col_1"] and x.count() == 2 and y.count() == 2
    (tmp_path / "h.csv").write_text("n,v\n1,2\n")
    x, y = S.read_csv_pair(spark, str(tmp_path / "h.csv"), str(tmp_path / "h.csv"))
    assert x.columns == ["n", "v"] and x.count() == 1
    (tmp_path / "kb" / "t1").mkdir(parents=True)
    (tmp_path / "kb" / "t1" / "x.md").write_text("# X")
    (tmp_path / "kb" / "t1" / "blank.md").write_text("  ")
    assert [(r.type, r.text) for r in S.read_folder(spark, str(tmp_path / "kb")).collect()] == [("t1", "# X")]
    assert S.read_csv_positions(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()[1]["value"] == 4
    (tmp_path / "code" / "node_modules").mkdir(parents=True)
    (tmp_path / "code" / "m.py").write_bytes(b"x = 1")
    (tmp_path / "code" / "node_modules" / "n.py").write_bytes(b"y")
    assert [r.text for r in S.read_code(spark, str(tmp_path / "code"), (".py",), ("node_modules",)).collect()] == ["x = 1"]
    k = spark.createDataFrame([("/d/Ann Lee.md",)], "p string").select(S.key_from_stem(F.col("p")).alias("k")).first()["k"]
    assert k == "lee"
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert S.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").count() == 2
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert S.read_json_document(spark, str(tmp_path / "d.json")).count() == 2


def test_stream_memory(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = []
    for n, rows in enumerate((["a", "b", "a"], ["b", "c"])):
        (src / f"{n}.json").write_text("\n".join(f'{{"k": "{r}"}}' for r in rows))
        ST.poll(spark, str(src), "k string", str(tmp_path / "mem"), "k", str(tmp_path / "cp"), lambda df, i: seen.append(sorted(r.k for r in df.collect()))).awaitTermination()
    assert seen == [["a", "b"], ["c"]]


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_tiles_equal_broadcast(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.5, 1.0, 2.0]) for _ in range(4)] if i % 9 else [1.0, 2.0]) for i in range(60)] + [(60, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = v.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    want = sorted(map(tuple, R.vector_search(ask, v, "qid", "vec_id", k=5).collect()), key=repr)
    for name, n in (("BROADCAST_VECTORS", 3), ("TILE_QUERIES", 4), ("TILE_ROWS", 7)):
        monkeypatch.setattr(R, name, n)
    assert sorted(map(tuple, R.vector_search(ask, v, "qid", "vec_id", k=5).collect()), key=repr) == want and len(want) > 60


def test_running_sums_and_numbers(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(-50, 50)) for i in r.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = [(x.k, x.s) for x in C.running_sums(df, [F.col("k")], {"s": F.col("v")}).orderBy("k").collect()]
    total, want = 0, []
    for k, v in sorted(rows):
        total += v
        want.append((k, total))
    assert got == want and [x.seq for x in C.numbered(df, [F.col("k")]).orderBy("k").collect()] == list(range(900))


def test_small_sinks_and_tools(spark, tmp_path):
    import json

    from loomspark.functions import text as T
    from loomspark.operators import learning as L
    from loomspark.sources import sinks

    path = tmp_path / "state.json"
    for value in ({"a": 1}, {"a": [2, "é"]}):
        sinks.save_json(spark, value, f"file://{path}")
        assert json.loads(path.read_text()) == value
    assert [x.name for x in tmp_path.iterdir() if x.suffix == ".tmp"] == []
    tools = L.Tools()
    tools.register("size", {"text": "string"}, lambda a: F.length(a["text"]))
    with pytest.raises(ValueError):
        tools.register("size", {}, lambda a: F.lit(1))
    assert tools.declared()[0]["function"]["parameters"]["properties"] == {"text": {"type": "string"}}
    cut = spark.createDataFrame([("a b c d",), (None,), ("",)], "t string").select(T.cut_to_tokens("t", 2, lambda x: list(x.encode()), lambda ids: bytes(ids).decode()).alias("c"), T.cut_to_tokens("t", 2).alias("b")).collect()
    assert [tuple(x) for x in cut] == [("a ", "a b"), (None, None), ("", "")]
