"""Metric queries: rankings of vectors by label, price guesses, running errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import profile as P
from ..registry import query

GUESSES = """
g AS (SELECT p_partkey AS id, p_retailprice AS truth, p_retailprice + (p_partkey * 37 % 401 - 200)::DOUBLE AS guess FROM part)
"""


def guesses(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("truth"), (F.col("p_retailprice") + (F.col("p_partkey") * 37 % 401 - 200).cast("double")).alias("guess"))


FLAGS = """
flags AS (SELECT p_partkey % 50 AS qid, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS pos, (p_partkey * 7919 % 5 = 0) AS rel, 12 AS total FROM part)
"""


def flags(t):
    from pyspark.sql.window import Window as W

    x = t.part.select((F.col("p_partkey") % 50).alias("qid"), "p_partkey")
    return x.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("p_partkey")).alias("pos"), (F.col("p_partkey") * 7919 % 5 == 0).alias("rel"), F.lit(12).alias("total"))


@query("A24", f"WITH {GUESSES} SELECT round(avg(abs(guess - truth)), 6) AS mae, round(avg((guess - truth) * (guess - truth)), 4) AS mse, round((1 - sum((guess - truth) * (guess - truth)) / (var_pop(truth) * count(truth))) * 100, 4) AS r2, count(*) AS n FROM g")
def regression_metrics(spark, t):
    """Errors of the guesses."""
    return M.regression(guesses(t), "guess", "truth").select(F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"), F.round("r2", 4).alias("r2"), "n")


@query("A25", f"WITH {GUESSES} SELECT CASE WHEN abs(guess - truth) < 40 OR abs(guess - truth) / truth < 0.2 THEN 'green' WHEN abs(guess - truth) < 80 OR abs(guess - truth) / truth < 0.4 THEN 'orange' ELSE 'red' END AS band, count(*) AS n FROM g GROUP BY 1")
def error_bands(spark, t):
    """Counts by error band."""
    return guesses(t).groupBy(M.error_band("guess", "truth").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("W1 W2 W3", f"""WITH {GUESSES}, e AS (SELECT id, abs(guess - truth) AS e FROM g),
r AS (SELECT id, count(e) OVER w AS n, avg(e) OVER w AS mean, sqrt(greatest(avg(e * e) OVER w - (avg(e) OVER w) * (avg(e) OVER w), 0)) AS std FROM e WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING))
SELECT id, round(mean, 5) AS mean, round(std, 4) AS std, round(mean - 1.96 * std / sqrt(n), 4) AS lower, round(mean + 1.96 * std / sqrt(n), 4) AS upper FROM r""")
def running_ci(spark, t):
    """Running error with its interval."""
    e = guesses(t).select("id", F.abs(F.col("guess") - F.col("truth")).alias("e"))
    r = M.running_interval(e, "e", [F.col("id")])
    return r.select("id", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"), F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


_IDEAL = "list_sum(list_transform(range(1, {n} + 1), lambda i: 1 / log2(i + 1)))"


@query("A16 A17 A18 A20", f"""WITH {FLAGS}, s AS (SELECT qid, coalesce(1.0 / min(pos) FILTER (WHERE rel), 0) AS rr, coalesce(sum(1 / log2(pos + 1)) FILTER (WHERE rel AND pos <= 10), 0) AS dcg,
count(*) FILTER (WHERE rel AND pos <= 10) AS hits, count(*) FILTER (WHERE pos <= 10) AS returned FROM flags GROUP BY qid)
SELECT qid, round(rr, 6) AS rr, round(CASE WHEN hits = 0 THEN 0 ELSE dcg / {_IDEAL.format(n='hits')} END, 6) AS ndcg_list, round(dcg / {_IDEAL.format(n='10')}, 6) AS ndcg_index, round(hits / returned, 6) AS precision FROM s""")
def ndcg_and_mrr(spark, t):
    """Reciprocal rank, both gains and precision per query."""
    s = M.ranking_scores(flags(t), 10, "total")
    return s.select("qid", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg_list", "ndcg_index", "precision")])


@query("A22 T8", f"""WITH {FLAGS}, s AS (SELECT qid, coalesce(1.0 / min(pos) FILTER (WHERE rel), 0) AS rr FROM flags GROUP BY qid)
SELECT qid % 5 AS category, round(avg(rr), 6) AS mrr, count(*) FILTER (WHERE rr < 1) AS misses FROM s GROUP BY 1""")
def mrr_by_category(spark, t):
    """Averages and misses by category."""
    s = M.ranking_scores(flags(t), 10)
    return s.groupBy((F.col("qid") % 5).alias("category")).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(F.col("rr") < 1).alias("misses"))


@query("A19", """WITH l AS (SELECT c.conv_id AS qid, c.role AS label, min(c.turn) AS pos FROM conversations c GROUP BY ALL)
SELECT qid, round(avg((pos <= 2)::INT), 6) AS recall FROM l GROUP BY qid""")
def label_recall(spark, t):
    """Share of a conversation's roles that speak in the first two turns."""
    return M.label_recall(t.conversations.select(F.col("conv_id").alias("qid"), F.col("role").alias("label"), F.col("turn").alias("pos")), 2).select("qid", F.round("recall", 6).alias("recall"))


@query("A23", f"""WITH {FLAGS}, s AS (SELECT qid, max(rel::INT) AS rel FROM flags WHERE pos <= 3 GROUP BY qid)
SELECT round((count(*) FILTER (WHERE qid % 4 = 0 AND rel = 0) + count(*) FILTER (WHERE qid % 4 <> 0) - count(*) FILTER (WHERE qid % 4 <> 0 AND rel = 0)) / count(*), 6) AS gate_score FROM s""")
def gate_score(spark, t):
    """Rejections that were right and answers that were not rejected, over all."""
    s = flags(t).filter("pos <= 3").groupBy("qid").agg(F.max(F.col("rel").cast("int")).alias("rel"))
    out_of_scope, rejected = F.col("qid") % 4 == 0, F.col("rel") == 0
    return s.agg(F.round((F.count_if(out_of_scope & rejected) + F.count_if(~out_of_scope) - F.count_if(~out_of_scope & rejected)) / F.count(F.lit(1)), 6).alias("gate_score"))


@query("A21 J9", """WITH k AS (SELECT item_id, word FROM (SELECT item_id, unnest(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')))[1:3]) AS word FROM benchmark)),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos, lower(text) AS text FROM documents),
f AS (SELECT item_id, word, min(pos) AS pos FROM k LEFT JOIN d ON contains(text, word) GROUP BY ALL)
SELECT item_id, round(avg(coalesce(1.0 / pos, 0)), 6) AS mrr, round(avg((pos IS NOT NULL)::INT) * 100, 6) AS coverage FROM f GROUP BY item_id""", name="keyword_coverage")
def keyword_coverage(spark, t):
    """Keywords found in a ranking of documents: the stated keywords are few and go to every document."""
    from ..operators.curation import numbered
    from ..operators.retrieval import small

    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), F.lit(1))))
    k = t.benchmark.select("item_id", F.explode(F.slice(words, 1, 3)).alias("word"))
    d = numbered(t.documents.select("doc_id", F.lower("text").alias("text")), [F.col("doc_id")], "pos").withColumn("pos", F.col("pos") + 1)
    hit = d.join(small(k), F.contains("text", "word")).groupBy("item_id", "word").agg(F.min("pos").alias("pos"))
    f = k.join(hit, ["item_id", "word"], "left")
    return f.groupBy("item_id").agg(F.round(F.avg(F.coalesce(1 / F.col("pos"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("pos").isNotNull().cast("int")) * 100, 6).alias("coverage"))


@query("ST30", f"WITH {FLAGS}, s AS (SELECT qid, coalesce(1.0 / min(pos) FILTER (WHERE rel), 0) AS rr FROM flags GROUP BY qid) SELECT qid, CASE WHEN rr >= 0.9 THEN 'green' WHEN rr >= 0.75 THEN 'orange' ELSE 'red' END AS colour FROM s")
def metric_colours(spark, t):
    """Traffic lights of a metric."""
    from ..functions.text import traffic_light

    return M.ranking_scores(flags(t), 10).select("qid", traffic_light("rr", 0.9, 0.75).alias("colour"))


@query("A7", """SELECT 'quality' AS "column", round(count(*) FILTER (WHERE quality IS NULL) * 100.0 / count(*), 6) AS missing_pct, round((count(DISTINCT quality) + max((quality IS NULL)::INT)) * 100.0 / count(*), 6) AS unique_pct FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', round(count(*) FILTER (WHERE lang IS NULL) * 100.0 / count(*), 6), round((count(DISTINCT lang) + max((lang IS NULL)::INT)) * 100.0 / count(*), 6) FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_unique_pct(spark, t):
    """Missing and unique percentages; null is a value."""
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return P.column_health(d, ["quality", "lang"]).select("column", F.round("missing_pct", 6).alias("missing_pct"), F.round("unique_pct", 6).alias("unique_pct"))


@query("A8", """SELECT 'p_size' AS "column", round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std FROM part UNION ALL SELECT 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_pop(p_retailprice), 6) FROM part""")
def numeric_summary(spark, t):
    """Means and population deviations."""
    return P.numeric_summary(t.part, ["p_size", "p_retailprice"]).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("A9", "SELECT source AS value, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source")
def source_distribution(spark, t):
    """Shares of the sources."""
    return P.distribution(t.documents, "source").select("value", F.round("share", 9).alias("share"))


@query("A10 J16", """WITH p AS (SELECT quality AS v, count(*) / sum(count(*)) OVER () AS p FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY 1),
q AS (SELECT quality AS v, count(*) / sum(count(*)) OVER () AS q FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY 1)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) * 0.5, 9) AS tvd FROM p FULL JOIN q ON p.v IS NOT DISTINCT FROM q.v""")
def tvd_by_language(spark, t):
    """Total variation of quality labels, unlabelled ones included, between English and the rest."""
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return P.total_variation(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), "quality").select(F.round("tvd", 9).alias("tvd"))


@query("A11", """SELECT * FROM (VALUES ('doc_id', 'shared'), ('lang', 'missing'), ('n_chars', 'missing'), ('quality', 'extra'), ('source', 'missing'), ('text', 'missing'), ('toxic', 'extra')) AS v("column", status)""")
def schema_overlap(spark, t):
    """Columns of two tables side by side."""
    return P.schema_overlap(t.documents, t.labels)


@query("SK9 A8 A10", """WITH a AS (SELECT * FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT p_type AS v, count(*) / sum(count(*)) OVER () AS p FROM a GROUP BY 1), q AS (SELECT p_type AS v, count(*) / sum(count(*)) OVER () AS q FROM b GROUP BY 1)
SELECT 'mean_delta' AS metric, 'p_size' AS "column", round(abs((SELECT avg(p_size) FROM a) - (SELECT avg(p_size) FROM b)), 6) AS value
UNION ALL SELECT 'std_delta', 'p_size', round(abs((SELECT stddev_pop(p_size) FROM a) - (SELECT stddev_pop(p_size) FROM b)), 6)
UNION ALL SELECT 'tvd', 'p_type', round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) * 0.5, 6) FROM p FULL JOIN q ON p.v = q.v""")
def drift_audit(spark, t):
    """Shifts between two halves of a table."""
    a, b = t.part.filter("p_partkey % 2 = 0"), t.part.filter("p_partkey % 2 = 1")
    return P.audit(a, b, ["p_size"], ["p_type"]).select("metric", "column", F.round("value", 6).alias("value"))


@query("A32", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cost FROM orders")
def running_cost(spark, t):
    """Running totals of a call log."""
    from ..operators.curation import running_sums

    x = running_sums(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], {"cost": F.col("o_totalprice")})
    return x.select("o_orderkey", F.round("cost", 2).alias("cost"))


ANSWERS = """
answers AS (SELECT item_id AS qid, item_id % 4 <> 0 AS in_scope, item_id % 3 = 0 AS rejected, item_id % 9 AS excerpts, item_id % 5 AS labels_found, 1.0::DOUBLE / (1 + item_id % 6) AS rr, item_id % 7 AS category FROM benchmark)
"""


def answers(t):
    i = F.col("item_id")
    return t.benchmark.select(i.alias("qid"), (i % 4 != 0).alias("in_scope"), (i % 3 == 0).alias("rejected"), (i % 9).alias("excerpts"), (i % 5).alias("labels_found"), (1.0 / (1 + i % 6)).alias("rr"), (i % 7).alias("category"))


@query("A22", f"WITH {ANSWERS} SELECT count(*) FILTER (WHERE NOT in_scope) AS out_of_scope, count(*) FILTER (WHERE NOT in_scope AND rejected) AS rejected_oos, count(*) FILTER (WHERE in_scope AND rejected) AS false_rejections, round(avg(excerpts) FILTER (WHERE NOT rejected), 6) AS avg_excerpts, count(*) FILTER (WHERE in_scope AND labels_found = 0) AS bad_labels FROM answers")
def gate_report(spark, t):
    """Rejections right and false, average excerpts and labels that name nothing."""
    return M.gate_report(answers(t)).withColumn("avg_excerpts", F.round("avg_excerpts", 6))


@query("A22 T8", f"WITH {ANSWERS} SELECT category AS stage, round(avg(rr), 6) AS rr, round(avg(excerpts), 6) AS excerpts, count(*) AS n FROM answers GROUP BY category")
def stage_averages(spark, t):
    """Averages of scores by stage."""
    a = M.stage_averages(answers(t), "category", ["rr", "excerpts"])
    return a.select(F.col("category").alias("stage"), F.round("rr", 6).alias("rr"), F.round("excerpts", 6).alias("excerpts"), "n")


@query("SK9", """WITH a AS (SELECT * FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT p_type AS v, count(*) / sum(count(*)) OVER () AS p FROM a GROUP BY 1), q AS (SELECT p_type AS v, count(*) / sum(count(*)) OVER () AS q FROM b GROUP BY 1),
m AS (SELECT 'mean_delta' AS metric, 'p_size' AS c, abs((SELECT avg(p_size) FROM a) - (SELECT avg(p_size) FROM b)) AS value
UNION ALL SELECT 'std_delta', 'p_size', abs((SELECT stddev_pop(p_size) FROM a) - (SELECT stddev_pop(p_size) FROM b))
UNION ALL SELECT 'tvd', 'p_type', sum(abs(coalesce(p, 0) - coalesce(q, 0))) * 0.5 FROM p FULL JOIN q ON p.v = q.v)
SELECT '# Audit' || chr(10) || chr(10) || '| column | metric | value |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c || ' | ' || metric || ' | ' || printf('%.4f', value) || ' |', chr(10) ORDER BY c, metric) AS report FROM m""")
def audit_report(spark, t):
    """The audit as a markdown report; it has a row per column and metric, however large the tables are."""
    a, b = t.part.filter("p_partkey % 2 = 0"), t.part.filter("p_partkey % 2 = 1")
    return P.markdown_report(P.audit(a, b, ["p_size"], ["p_type"]), "Audit")
