"""Index maintenance queries: two days of documents play two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..operators import index as I
from ..scratch import scratch
from ..registry import query

VERSIONS = """
old AS (SELECT doc_id AS url, sha1(text) AS hash FROM documents WHERE doc_id % 10 <> 3),
new AS (SELECT doc_id AS url, CASE WHEN doc_id % 7 = 0 THEN sha1(text || '!') ELSE sha1(text) END AS hash FROM documents WHERE doc_id % 10 <> 5)
"""


def versions(t):
    old = t.documents.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("url"), F.sha1("text").alias("hash"))
    new = t.documents.filter("doc_id % 10 <> 5").select(F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 7 == 0, F.sha1(F.concat("text", F.lit("!")))).otherwise(F.sha1("text")).alias("hash"))
    return old, new


@query("J4", f"WITH {VERSIONS} SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' ELSE 'same' END AS op FROM old o FULL JOIN new n ON o.url = n.url")
def index_diff(spark, t):
    """Pages added, removed and changed."""
    return I.diff(*versions(t), "url", "hash")


@query("J2 J3 IX1", f"WITH {VERSIONS} SELECT coalesce(o.hash, n.hash) AS id, CASE WHEN o.hash IS NULL THEN 'add' WHEN n.hash IS NULL THEN 'delete' ELSE 'keep' END AS op FROM (SELECT DISTINCT hash FROM old) o FULL JOIN (SELECT DISTINCT hash FROM new) n ON o.hash = n.hash")
def sync_plan(spark, t):
    """Chunks to add, keep and delete by content id."""
    old, new = versions(t)
    return I.sync_plan(old.withColumnRenamed("hash", "id"), new.withColumnRenamed("hash", "id"))


@query("IX1", f"WITH {VERSIONS} SELECT hash AS id, 'delete' AS op FROM old GROUP BY hash UNION ALL SELECT hash, 'add' FROM new GROUP BY hash")
def rebuild_plan(spark, t):
    """A changed embedding model: every chunk goes and comes again."""
    old, new = versions(t)
    return I.planned(old.withColumnRenamed("hash", "id"), new.withColumnRenamed("hash", "id"), "id", "small", "large")


@query("SK7", """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) SELECT item_id, count(*)::DOUBLE AS words, 100 >= 1 AS small FROM w GROUP BY item_id""")
def embedded_in_batches(spark, t):
    """Texts through an embedder that takes at most a hundred at a time."""
    import re

    from ..operators.retrieval import embed

    def embedder(texts):
        assert len(texts) <= 100
        return [[float(len(re.findall("[a-z0-9]+", x.lower()))), float(len(texts))] for x in texts]

    e = embed(t.benchmark.select("item_id", "text"), "item_id", "text", embedder)
    return e.select("item_id", F.get("embedding", F.lit(0)).alias("words"), (F.get("embedding", F.lit(1)) <= 100).alias("small"))


@query("IX1 SK7", f"WITH {VERSIONS} SELECT n.url, n.hash, o.n AS embedded FROM (SELECT DISTINCT url, hash FROM new) n LEFT JOIN (SELECT hash, length(hash) + max(url % 5) AS n FROM old GROUP BY hash) o USING (hash)")
def merged_index(spark, t):
    """The next version: computed columns of unchanged chunks are kept."""
    old, new = versions(t)
    index = old.groupBy("hash").agg((F.length("hash") + F.max(F.col("url") % 5)).alias("embedded"))
    return I.merge(index, new, "hash").select("url", "hash", "embedded")


@query("IX2 IX4", f"WITH {VERSIONS} SELECT (SELECT count(*) FROM new) >= 0.8 * (SELECT count(*) FROM old) AS accepted, true AS changed")
def shrink_guard(spark, t):
    """Whether a crawl may replace the one before, and whether anything changed."""
    old, new = versions(t)
    changed = I.diff(old, new, "url", "hash").filter("op <> 'same'").limit(1).count() > 0
    return spark.createDataFrame([(I.may_shrink(old, new), changed)], "accepted boolean, changed boolean")


@query("A34 IX4", "SELECT coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), '') AS newest, (SELECT coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), '') FROM orders WHERE o_orderkey < 0) AS none FROM orders")
def newest_update(spark, t):
    """The newest day, empty if there is none."""
    day = lambda d: d.agg(F.coalesce(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("")).alias("d"))
    return day(t.orders).withColumnRenamed("d", "newest").crossJoin(day(t.orders.filter("o_orderkey < 0")).withColumnRenamed("d", "none"))


@query("SK7 IX3 SK5", "SELECT doc_id, left(sha1('text' || chr(10) || text), 24) AS id FROM documents WHERE doc_id % 2 = 0")
def versioned_index(spark, t):
    """Two versions written; readers follow the pointer to the second."""
    folder = scratch(spark)
    d = t.documents.select("doc_id", chunk_id(F.lit("text"), "text").alias("id"))
    I.write_version(d, folder, 1)
    I.write_version(d.filter("doc_id % 2 = 0"), folder, 2)
    return I.read_current(spark, folder)


@query("SK11 SC19", """WITH u AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey + 1000000, o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 50 = 0),
last AS (SELECT k, max_by(v, seq) AS v FROM u GROUP BY k)
SELECT coalesce(last.k, c_custkey) AS c_custkey, CASE WHEN last.k IS NOT NULL THEN last.v ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN last ON last.k = c_custkey""")
def upsert_merge(spark, t):
    """Balances with updates put over them; the last of several counts."""
    o = t.orders
    u = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    u = u.union(o.filter("o_orderkey % 50 = 0").select(F.col("o_custkey") + 1_000_000, "o_totalprice", "o_orderkey"))
    return I.upsert(t.customer.select("c_custkey", "c_acctbal"), u, "c_custkey", "seq")


@query("J1 SC7", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'done ' || o_orderpriority END AS content FROM orders""")
def batch_join(spark, t):
    """Batch results joined to their rows by id."""
    from ..sources.tables import batch_results

    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("done "), "o_orderpriority").alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    lines = t.orders.filter("o_orderkey % 4 = 0").select(body.alias("value"))
    r = batch_results(lines)
    return t.orders.select("o_orderkey").join(r, F.col("o_orderkey") == F.col("id"), "left").select("o_orderkey", "content")


@query("J5 STR2", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 200)")
def memory_antijoin(spark, t):
    """Events of users that the memory lacks."""
    e = t.events
    return e.join(e.filter("event_id < 200").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@query("J8", """WITH c AS (SELECT DISTINCT p_type || ' > ' || p_brand AS section FROM part), l AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT DISTINCT p_type || ' > ' || p_brand FROM part WHERE p_size > 25)
SELECT section, label FROM c JOIN l ON section = label OR starts_with(section, label || ' > ')""")
def prefix_labels(spark, t):
    """Sections under labels: each section's ancestors are equi-joined with the labels."""
    c = t.part.select(F.concat_ws(" > ", "p_type", "p_brand").alias("section")).distinct()
    labels = t.part.select(F.col("p_type").alias("label")).union(t.part.filter("p_size > 25").select(F.concat_ws(" > ", "p_type", "p_brand"))).distinct()
    parts = F.split("section", " > ")
    up = c.select("section", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " > "))).alias("label"))
    return up.join(labels, "label").select("section", "label")


@query("DD14", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unreferenced(spark, t):
    """Files that nothing refers to."""
    p = t.pages
    return p.select("page_id", "url").join(p.filter("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id")


@query("SK10", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 2")
def memory_head(spark, t):
    """A memory cut to its first two entries."""
    return t.events.orderBy("event_id").limit(2).select("event_id", "value")


@query("J11 SC5", """WITH g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT p_partkey, (pos * 2)::DOUBLE AS guess FROM g""")
def zipped(spark, t):
    """Guesses joined to items by position."""
    from ..operators.curation import numbered

    items = numbered(t.part.select("p_partkey"), [F.col("p_partkey")], "pos")
    guesses = spark.range(t.part.count()).select(F.col("id").alias("pos"), (F.col("id") * 2).cast("double").alias("guess"))
    return items.join(guesses, "pos").select("p_partkey", "guess")
