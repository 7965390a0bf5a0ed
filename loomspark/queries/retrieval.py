"""Retrieval queries: benchmark texts ask, documents answer; vectors ask vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import retrieval as R
from ..registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"""
qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')) AS term FROM benchmark),
dt AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')) AS term FROM documents),
qx AS (SELECT qid, term FROM qt UNION ALL SELECT qid, unnest(regexp_split_to_array(term, '[-_.]')) FROM qt WHERE regexp_matches(term, '[-_.]')),
dx AS (SELECT doc, term FROM dt UNION ALL SELECT doc, unnest(regexp_split_to_array(term, '[-_.]')) FROM dt WHERE regexp_matches(term, '[-_.]')),
q AS (SELECT qid, term, count(*) AS qf FROM qx WHERE term NOT IN ({STOP}) GROUP BY ALL),
tf AS (SELECT doc, term, count(*) AS tf FROM dx WHERE term NOT IN ({STOP}) GROUP BY ALL),
len AS (SELECT doc, sum(tf) AS len FROM tf GROUP BY doc),
stats AS (SELECT count(*) AS n, (SELECT sum(len) FROM len) / count(*) AS avg_len FROM documents),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
scored AS (SELECT qid, tf.doc, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len ON len.doc = tf.doc, stats GROUP BY ALL),
bm AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc DESC) - 1 AS rank FROM scored WHERE score > 0)
"""


def _bm25(t, k=R.KEYWORD_K):
    return R.bm25(t.benchmark, t.documents, "item_id", "text", "doc_id", "text", k)


@query("ST9", f"WITH {TOKENS} SELECT qid, count(*) AS n, count(DISTINCT term) AS different FROM qx WHERE term NOT IN ({STOP}) GROUP BY qid")
def tokenized_questions(spark, t):
    """Tokens of the questions."""
    return t.benchmark.select(F.col("item_id").alias("qid"), F.explode(T.tokenize("text")).alias("term")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("different"))


@query("A12 A13", f"WITH {TOKENS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(any_value(idf), 6) AS idf FROM tf JOIN idf USING (term) GROUP BY term")
def term_statistics(spark, t):
    """Frequencies and inverse document frequencies of all terms."""
    return R.term_statistics(t.documents, "doc_id", "text").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query("A14 J6 T1 R3", f"WITH {TOKENS} SELECT qid, doc, round(score, 5) AS score FROM bm WHERE rank < 25")
def bm25_topk(spark, t):
    """The 25 best documents of every question."""
    return _bm25(t).select("qid", "doc", F.round("score", 5).alias("score"))


@query("A16 ST9 A12 A13 A14 J6 T1 J9 W4", f"""WITH {TOKENS}, rel AS (SELECT item_id AS qid, min(rank) AS rank FROM benchmark LEFT JOIN (SELECT bm.qid, rank, d.text AS dtext FROM bm JOIN documents d ON d.doc_id = bm.doc WHERE rank < 25) x ON x.qid = item_id AND contains(dtext, text) GROUP BY 1)
SELECT qid, round(coalesce(1.0 / (rank + 1), 0), 6) AS rr FROM rel""")
def bm25_mrr(spark, t):
    """Reciprocal rank of the first document that holds the question's passage."""
    hits = _bm25(t).join(R.small(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("q"))), "qid").join(t.documents.select(F.col("doc_id").alias("doc"), "text"), "doc")
    first = hits.filter(F.contains("text", "q")).groupBy("qid").agg(F.min("rank").alias("rank"))
    return t.benchmark.select(F.col("item_id").alias("qid")).join(first, "qid", "left").select("qid", F.round(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0)), 6).alias("rr"))


VECS = """
ask AS (SELECT vec_id AS qid, embedding AS q, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
sims AS (SELECT qid, vec_id AS doc, ql, label, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS similarity FROM ask, embeddings),
knn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc) - 1 AS rank FROM sims)
"""


def _ask(t):
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query("MA1 J7 T3", f"WITH {VECS} SELECT qid, doc, round(similarity, 6) AS similarity FROM knn WHERE rank < 5")
def vector_topk(spark, t):
    """Exact nearest neighbours of every 20th vector."""
    return R.vector_search(_ask(t), t.embeddings, "qid", "vec_id", k=5).select("qid", "doc", F.round("similarity", 6).alias("similarity"))


@query("R2", f"""WITH {VECS} SELECT qid, doc, rank FROM knn WHERE rank < 25 AND doc % 7 <> 0""")
def snapshot_hits(spark, t):
    """Hits of an index that knows more vectors than the snapshot: the others go and are not filled up."""
    known = t.embeddings.filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("doc"))
    return R.vector_search(_ask(t), t.embeddings, "qid", "vec_id", known=known).select("qid", "doc", "rank")


@query("A17 A18 A20", f"""WITH {VECS}, s AS (SELECT qid, sum(1 / log2(rank + 2)) FILTER (WHERE label = ql AND rank < 5) AS dcg, count(*) FILTER (WHERE label = ql AND rank < 5) AS hits FROM knn GROUP BY qid)
SELECT qid, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, 6), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM s""")
def ndcg_at_5(spark, t):
    """Gain of vectors with the asking vector's label."""
    hits = R.vector_search(_ask(t), t.embeddings, "qid", "vec_id", k=5)
    lab = t.embeddings.select(F.col("vec_id").alias("doc"), "label")
    ql = R.small(t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")))
    f = hits.join(lab, "doc").join(ql, "qid").select("qid", (F.col("rank") + 1).alias("pos"), (F.col("label") == F.col("ql")).alias("rel"), F.lit(5).alias("total"))
    return M.ranking_scores(f, 5, "total").select("qid", F.round("ndcg_index", 6).alias("ndcg"))


#: The second ranking: the same texts as hashed vectors, by cosine.
PLAIN = """
qw AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8000]) AS w FROM benchmark),
dw AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8000]) AS w FROM documents),
qe AS (SELECT qid, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n FROM qw GROUP BY ALL),
de AS (SELECT doc, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n FROM dw GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(n * n)) AS l FROM qe GROUP BY qid), dn AS (SELECT doc, sqrt(sum(n * n)) AS l FROM de GROUP BY doc),
dots AS (SELECT qid, doc, sum(qe.n * de.n) AS dot FROM qe JOIN de USING (i) GROUP BY ALL),
vs AS (SELECT qid, doc_id AS doc, CASE WHEN dn.l IS NULL THEN NULL ELSE round(coalesce(dot, 0) / (qn.l * dn.l), 9) END AS similarity FROM documents CROSS JOIN qn LEFT JOIN dn ON dn.doc = doc_id LEFT JOIN dots USING (qid, doc)),
plain AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC NULLS LAST, doc) - 1 AS rank FROM vs QUALIFY rank < 25)
"""


def _plain(t):
    ask = R.embed(t.benchmark.select(F.col("item_id").alias("qid"), "text"), "qid", "text")
    return R.vector_search(ask, R.embed(t.documents.select("doc_id", "text"), "doc_id", "text"), "qid", "doc_id").select("qid", "doc", "rank")


FUSED = f"""{TOKENS}, {PLAIN},
two AS (SELECT qid, doc, rank, 0 AS l FROM bm WHERE rank < 25 UNION ALL SELECT qid, doc, rank, 1 FROM plain),
rrf AS (SELECT qid, doc, round(sum(1.0 / (60 + rank)), 12) AS rrf, min((l, rank)) AS seen FROM two GROUP BY ALL),
fused AS (SELECT qid, doc, rrf, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, seen) - 1 AS fused_rank FROM rrf QUALIFY fused_rank < 30)"""


def _fused(t):
    return R.reciprocal_rank_fusion(_bm25(t).select("qid", "doc", "rank"), _plain(t))


@query("A15 T2 R4 W4", f"WITH {FUSED} SELECT qid, doc, round(rrf, 9) AS rrf, fused_rank FROM fused")
def rrf_fused(spark, t):
    """Two rankings fused."""
    return _fused(t).select("qid", "doc", F.round("rrf", 9).alias("rrf"), "fused_rank")


@query("R5 PF14", f"""WITH {FUSED} SELECT qid, doc, fused_rank FROM fused JOIN benchmark ON item_id = qid JOIN documents d ON d.doc_id = doc
WHERE regexp_matches(lower(benchmark.text), '\\b(release|version|update|the)\\b') OR NOT starts_with(d.source, 'src1')""")
def section_filter(spark, t):
    """Hits of one kind of source only for questions that ask for it; ranks keep their gaps."""
    x = _fused(t).join(R.small(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("q"))), "qid").join(t.documents.select(F.col("doc_id").alias("doc"), "source"), "doc")
    return x.filter(F.lower("q").rlike(r"\b(release|version|update|the)\b") | ~F.col("source").startswith("src1")).select("qid", "doc", "fused_rank")


HITS = f"""{FUSED},
scored2 AS (SELECT qid, doc, fused_rank, round(len(list_intersect(qs, ds)) / len(qs) * 20 - 10, 9) AS rerank FROM (SELECT qid, doc, fused_rank,
  list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS qs, list_distinct(regexp_extract_all(lower(left(d.text, 2500)), '[a-z0-9]+')) AS ds
  FROM fused JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = doc)),
gated AS (SELECT * FROM (SELECT *, max(rerank) OVER (PARTITION BY qid) AS best FROM scored2) WHERE best >= -4)"""


def _hits(t):
    questions = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return R.gate(R.rerank(_fused(t), questions, t.documents.select(F.col("doc_id").alias("doc"), "text")), "rerank", -4.0)


@query("R6 R7 R8 U3", f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, fused_rank) - 1 AS rr FROM gated),
b AS (SELECT qid, doc, rr, round(1.0 / (10 + rr) + 1.0 / (10 + fused_rank), 12) AS blended FROM r WHERE rerank >= greatest(-8, best - 3))
SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY blended DESC, rr) AS position FROM b""")
def blend_cutoff(spark, t):
    """Rerank, gate, blend and adaptive cut."""
    return R.blend(_hits(t)).select("qid", "doc", "position")


@query("R9 J15")
def greedy_context(spark, t):
    """At most eight hits a question; code and images that a chosen hit has already go."""
    h = R.blend(_hits(t)).join(t.documents.select(F.col("doc_id").alias("doc"), "text", "source"), "doc")
    kind = F.when(F.col("doc") % 5 == 0, "code").when(F.col("doc") % 5 == 1, "image").otherwise("text")
    return R.greedy_context(h.select("qid", "doc", "position", kind.alias("type"), "text", F.substring("text", 1, 60).alias("code"), F.col("source").alias("url")))


@query("R10", f"""WITH {VECS}, g AS (SELECT *, max(similarity) OVER (PARTITION BY qid) AS best FROM knn WHERE rank < 8 AND doc <> qid) SELECT qid, doc, round(similarity, 6) AS similarity FROM g WHERE best >= 0.3""")
def similarity_gate(spark, t):
    """Without a reranker: by similarity, all hits of the questions that pass the gate."""
    h = R.vector_search(_ask(t), t.embeddings, "qid", "vec_id", k=8).filter("doc <> qid")
    return R.gate(h, "similarity", 0.3).select("qid", "doc", F.round("similarity", 6).alias("similarity"))


@query("DD7 DD8", f"""WITH {TOKENS}, {PLAIN}, a AS (SELECT qid, doc, rank, 1 AS list FROM bm WHERE rank < 10), b AS (SELECT qid, doc, rank, 2 AS list FROM plain WHERE rank < 10)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE (qid, doc) NOT IN (SELECT (qid, doc) FROM a)""")
def merged_lists(spark, t):
    """Two lists of hits merged; the first wins."""
    return R.merge_rankings(_bm25(t, 10).select("qid", "doc", "rank"), _plain(t).filter("rank < 10"), "doc")


REWRITTEN = TOKENS.replace("FROM benchmark)", "FROM (SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(regexp_extract_all(lower(text), '[a-z]{6,}'), ' ') FROM benchmark))", 1)


@query("R11", f"""WITH {REWRITTEN}, a AS (SELECT qid // 2 AS qid, doc, rank FROM bm WHERE qid % 2 = 0 AND rank < 10), b AS (SELECT qid // 2 AS qid, doc, rank FROM bm WHERE qid % 2 = 1 AND rank < 10),
m AS (SELECT qid, doc, rank, 1 AS list FROM a UNION ALL SELECT qid, doc, rank, 2 FROM b WHERE (qid, doc) NOT IN (SELECT (qid, doc) FROM a)),
s AS (SELECT qid, doc, rank, list, round(len(list_intersect(qs, ds)) / len(qs) * 20 - 10, 9) AS rerank FROM (SELECT m.*, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS qs, list_distinct(regexp_extract_all(lower(left(d.text, 2500)), '[a-z0-9]+')) AS ds FROM m JOIN benchmark q ON q.item_id = qid JOIN documents d ON d.doc_id = doc))
SELECT qid, doc, list, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, list, rank) AS position FROM s""")
def rewritten_search(spark, t):
    """A question and its rewriting (its longer words) both searched, the lists merged and reranked."""
    long = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)), " ")
    asked = t.benchmark.select((F.col("item_id") * 2).alias("item_id"), "text").union(t.benchmark.select(F.col("item_id") * 2 + 1, long))
    hits = R.bm25(asked, t.documents, "item_id", "text", "doc_id", "text", 10).select(F.expr("qid div 2").alias("qid"), (F.col("qid") % 2).alias("l"), "doc", "rank")
    merged = R.merge_rankings(hits.filter("l = 0").drop("l"), hits.filter("l = 1").drop("l"), "doc")
    questions = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    s = R.rerank(merged, questions, t.documents.select(F.col("doc_id").alias("doc"), "text"))
    return s.select("qid", "doc", "list", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rerank"), "list", "rank")).alias("position"))


@query("T14 W4", f"WITH {FUSED}, x AS (SELECT * FROM fused WHERE fused_rank < 8) SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc) AS n FROM x QUALIFY n <= 6")
def context_in_order(spark, t):
    """The eight best hits, six of them in document order."""
    x = _fused(t).filter("fused_rank < 8")
    return x.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("doc"))).filter("n <= 6").select("qid", "doc", "n")


@query("R12", f"""WITH {VECS} SELECT qid, string_agg('item ' || doc || ': ' || printf('%.3f', similarity), chr(10) ORDER BY rank) AS context FROM knn WHERE rank < 3 GROUP BY qid""")
def similar_context(spark, t):
    """Neighbours written out as a text block."""
    h = R.vector_search(_ask(t), t.embeddings, "qid", "vec_id", k=3)
    line = F.format_string("item %d: %.3f", "doc", "similarity")
    return h.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda s: s["x"]), "\n").alias("context"))


@query("T16", f"""WITH {TOKENS}, o AS (SELECT qid, [3, 1, 99, 2] AS o FROM (SELECT DISTINCT qid FROM bm)), e AS (SELECT qid, unnest(o) AS n, generate_subscripts(o, 1) AS place FROM o)
SELECT e.qid, doc, row_number() OVER (PARTITION BY e.qid ORDER BY place) AS position FROM e JOIN bm ON bm.qid = e.qid AND bm.rank = n - 1 AND rank < 10 QUALIFY position <= 10""")
def listwise_order(spark, t):
    """Hits in an order given as a list of numbers; numbers out of range go."""
    b = _bm25(t, 10)
    e = b.select("qid").distinct().select("qid", F.posexplode(F.array(*[F.lit(x) for x in (3, 1, 99, 2)])).alias("at", "n"))
    j = e.join(b, (e.qid == b.qid) & (F.col("rank") == F.col("n") - 1)).select(e.qid, "doc", "at")
    return j.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("at"))).filter("position <= 10").select("qid", "doc", "position")


@query("T17", f"""WITH {TOKENS}, s AS (SELECT bm.*, coalesce(TRY_CAST(string_split('7,x,9,3', ',')[rank + 1] AS DOUBLE), 0) AS s FROM bm WHERE rank < 6)
SELECT qid, doc, s AS points, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS position FROM s QUALIFY position <= 4""")
def pointwise_order(spark, t):
    """Hits by a list of points; what is no number or missing counts 0."""
    s = _bm25(t, 6).withColumn("points", F.coalesce(F.get(F.split(F.lit("7,x,9,3"), ","), F.col("rank")).try_cast("double"), F.lit(0.0)))
    return s.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("points"), "rank"))).filter("position <= 4").select("qid", "doc", "points", "position")


@query("J10", r"""WITH w AS (SELECT conv_id, turn, pos, word FROM (SELECT conv_id, turn, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')) AS word, generate_subscripts(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), 1) AS pos FROM conversations)),
k AS (SELECT lower(n_name) AS word, n_nationkey AS id FROM nation UNION ALL SELECT 'the', 100 UNION ALL SELECT 'of', 101)
SELECT conv_id, turn, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM w JOIN k USING (word) GROUP BY ALL""")
def word_lookup(spark, t):
    """Words of a message looked up in a small dictionary, repeats kept, in order."""
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ")
    k = t.nation.select(F.lower("n_name").alias("word"), F.col("n_nationkey").alias("id")).union(spark.createDataFrame([("the", 100), ("of", 101)], "word string, id int"))
    w = t.conversations.select("conv_id", "turn", F.posexplode(words).alias("pos", "word")).join(R.small(k), "word")
    return w.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"].cast("string")), ",").alias("ids"))


@query("R1", f"""WITH {PLAIN} SELECT doc AS doc_id, round(l, 6) AS norm FROM dn""")
def hashed_embeddings(spark, t):
    """Texts cut to 8,000 tokens as hashed vectors, the stand-in for an embedder."""
    v = R.embed(t.documents.select("doc_id", "text"), "doc_id", "text").select("doc_id", F.round(V.norm("embedding"), 6).alias("norm"))
    return v.filter("norm > 0")


@query("SC20", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def collection_scan(spark, t):
    """Two columns of the first hundred vectors; the embedding is not read."""
    return t.embeddings.orderBy("vec_id").limit(100).select("vec_id", "label")
