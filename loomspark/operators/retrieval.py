"""Keyword and vector retrieval, fusion, gates and context selection. A batch of queries is a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import vectors as V

K1, B = 1.5, 0.75
RRF_K, BLEND_K = 60, 10
KEYWORD_K, VECTOR_K, FUSED_K, CONTEXT_K = 25, 25, 30, 8
#: Queries up to this many are broadcast; more are joined by term.
MAX_BROADCAST_QUERIES = 10_000


def small(df: DataFrame, most: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """The table with a broadcast hint if it has at most ``most`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term): a row per term, exploded as soon as words are found so that the rest runs in generated code. A text without terms gives one row with a null."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([a-z0-9]+(?:[-_.][a-z0-9]+)*)"), F.lit(1))
    x = docs.select(F.col(id_col).alias("doc"), F.explode_outer(words).alias("w"))
    parts = F.when(F.col("w").rlike("[-_.]"), F.concat(F.array("w"), F.split("w", "[-_.]"))).otherwise(F.array("w"))
    x = x.select("doc", F.explode(parts).alias("w"))
    return x.select("doc", F.when(~F.col("w").isin(*T.STOPWORDS), F.col("w")).alias("term"))


def _counted(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, term, n): how often each document has each wanted term; all else is counted under a null term.

    Every use of this table needs all three columns, so its one scan and shuffle serve them all.
    """
    x = terms(docs, id_col, text_col)
    x = x.withColumn("is", F.col("term").isNotNull().cast("int"))
    if wanted is not None:
        x = x.join(wanted.select(F.col("term").alias("_w")), F.col("term") == F.col("_w"), "left").select("doc", F.col("_w").alias("term"), "is")
    return x.groupBy("doc", "term").agg(F.sum("is").alias("n"))


def _stats(counted: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len) of counted terms."""
    lengths = counted.groupBy("doc").agg(F.sum("n").alias("len"))
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("len"), F.lit(1e-9)).alias("avg_len"))


def _idf(counted: DataFrame) -> DataFrame:
    """(term, df, cf, idf, avg_len) of counted terms."""
    df = counted.filter("term is not null").groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"), F.sum("n").alias("cf"))
    value = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(_stats(counted))).select("term", "df", "cf", value.alias("idf"), "avg_len")


def term_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df, cf, idf) of all terms."""
    return _idf(_counted(docs, id_col, text_col)).select("term", "df", "cf", "idf")


def bm25(queries: DataFrame, docs: DataFrame, qid: str, qtext: str, did: str, dtext: str, k: int | None = KEYWORD_K) -> DataFrame:
    """(qid, doc, score, rank): rank from 0; equal scores put the larger document id first. Query terms count as often as they occur.

    Documents are scanned and cut into terms once. Terms that no query has are folded into one row a document before
    anything is shuffled; document frequencies, lengths and their average all come from that one table. The sides of joins
    are broadcast where their statistics say they are small, and shuffled by term otherwise; no job runs while the plan is built.
    """
    q = terms(queries, qid, qtext).filter("term is not null").withColumnRenamed("doc", "qid")
    q = q.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    counted = _counted(docs, did, dtext, q.select("term").distinct())
    tf = counted.withColumn("len", F.sum("n").over(W.partitionBy("doc"))).filter("term is not null").withColumnRenamed("n", "tf")
    scored = tf.join(q.join(_idf(counted), "term"), "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("qid", "doc").agg(F.sum(part).alias("score")).filter("score > 0")
    out = out.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc"))) - 1)
    return out.filter(F.col("rank") < k) if k else out


#: Tokens of a text that are embedded, texts in one call of an embedder, and the size of the stand-in's vectors.
EMBED_TOKENS, EMBED_BATCH, HASHED_SIZE = 8000, 100, 64


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, most: int = EMBED_TOKENS, batch: int = EMBED_BATCH, size: int = HASHED_SIZE) -> DataFrame:
    """(key, embedding) of texts cut to their first ``most`` tokens.

    ``embedder`` takes up to ``batch`` texts a call. Without one, texts become counts of their words in ``size`` hashed
    places: a stand-in that any engine can compute again.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    if embedder is None:
        words = rows.select(key, F.explode_outer(F.slice(found, 1, most)).alias("w"))
        at = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % size
        counts = words.groupBy(key).agg(*[F.count_if(at == i).cast("double").alias(f"e{i}") for i in range(size)])
        return counts.select(key, F.array(*[f"e{i}" for i in range(size)]).alias("embedding"))
    kind = rows.schema[key].dataType.simpleString()
    cut = F.regexp_extract(F.col(text), rf"^(?s)((?:\S+\s*){{0,{most}}})", 1)

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "embedding": list(embedder([x or "" for x in part["_text"]]))})

    return rows.select(key, cut.alias("_text")).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


#: Queries that one broadcast holds, and rows of a tile beyond that.
BROADCAST_VECTORS, TILE_QUERIES, TILE_ROWS = 2_000, 2_000, 50_000


def _tiled(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """(qid, doc, similarity) of the best k of every tile: queries in blocks against rows in blocks, each tile a matrix product.

    A row travels once for every block of queries and a query once for every block of rows, so the rows that move are the
    pairs divided by a tile's side.
    """
    nq, nv = max(1, -(-q.count() // TILE_QUERIES)), max(1, -(-v.count() // TILE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("qid", F.col("_q").cast("array<double>").alias("_q"), block("qid", nq).alias("a"), every(nv).alias("b"))
    right = v.select("doc", F.col("_v").cast("array<double>").alias("_v"), block("doc", nv).alias("b"), every(nq).alias("a"))

    def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for size in set(x["_q"].map(len)) & set(y["_v"].map(len)) if len(x) and len(y) else ():
            p, r = x[x["_q"].map(len) == size], y[y["_v"].map(len) == size].sort_values("doc")
            m, n = np.vstack(p["_q"].to_list()), np.vstack(r["_v"].to_list())
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = np.round((m @ n.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(n, axis=1)), 9)
            order = np.argsort(-np.nan_to_num(sims, nan=-np.inf), axis=1, kind="stable")[:, :k]
            docs = r["doc"].to_numpy()
            for i, qid in enumerate(p["qid"]):
                rows += [(qid, docs[j], None if np.isnan(sims[i, j]) else sims[i, j]) for j in order[i]]
        return pd.DataFrame(rows, columns=["qid", "doc", "similarity"])

    out = f"qid {q.schema['qid'].dataType.simpleString()}, doc {v.schema['doc'].dataType.simpleString()}, similarity double"
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(tile, out)


def vector_search(queries: DataFrame, vectors: DataFrame, qid: str, vid: str, embedding: str = "embedding", k: int = VECTOR_K, known: DataFrame | None = None) -> DataFrame:
    """(qid, doc, similarity, rank): exact cosine top-k, the stated queries against all rows; top-k is cut per task before the shuffle.

    Up to BROADCAST_VECTORS queries are broadcast; more are searched in tiles. Hits whose id ``known(doc)`` lacks are
    dropped after the cut and not filled up: the index may be older than the snapshot.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col(embedding).alias("_q"))
    v = vectors.select(F.col(vid).alias("doc"), F.col(embedding).alias("_v"))
    if q.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS:
        scored = v.join(F.broadcast(q), F.size("_q") == F.size("_v")).select("qid", "doc", F.round(V.cosine("_q", "_v"), 9).alias("similarity"))
    else:
        scored = _tiled(q, v, k)
    w = W.partitionBy("qid").orderBy(F.desc_nulls_last("similarity"), "doc")
    out = scored.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    return out if known is None else out.join(known.select("doc"), "doc", "left_semi").select("qid", "doc", "similarity", "rank")


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = FUSED_K) -> DataFrame:
    """(qid, doc, rrf, fused_rank) of two rankings (qid, doc, rank); ties keep first-seen order, the first list before the second."""
    both = first.select("qid", "doc", "rank", F.lit(0).alias("_l")).unionByName(second.select("qid", "doc", "rank", F.lit(1).alias("_l")))
    seen = F.min(F.struct("_l", "rank"))
    out = both.groupBy("qid", "doc").agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 12).alias("rrf"), seen.alias("_seen"))
    w = W.partitionBy("qid").orderBy(F.desc("rrf"), "_seen")
    return out.withColumn("fused_rank", F.row_number().over(w) - 1).filter(F.col("fused_rank") < k).drop("_seen")


#: Characters of a hit's text that a reranker reads.
RERANK_CHARS = 2500


def overlap_score(question: Column, text: Column) -> Column:
    """A stand-in cross score from -10 to 10: the share of the question's different words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    q = words(question)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0)) * 20 - 10, 9)


def rerank(hits: DataFrame, questions: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, chars: int = RERANK_CHARS) -> DataFrame:
    """Hits with ``rerank``, the score of (question, beginning of the text) by any function of two columns.

    ``questions``: qid, question; ``texts``: doc, text. Only the texts of hits are joined.
    """
    x = hits.join(questions, "qid").join(texts.select("doc", F.substring("text", 1, chars).alias("_text")), "doc")
    return x.withColumn("rerank", scorer(F.col("question"), F.col("_text"))).select(*hits.columns, "rerank")


def gate(hits: DataFrame, score: str, least: float) -> DataFrame:
    """Hits of the queries whose best score reaches ``least``."""
    return hits.withColumn("_best", F.max(score).over(W.partitionBy("qid"))).filter(F.col("_best") >= least).drop("_best")


def blend(hits: DataFrame, rerank: str = "rerank", floor: float = -8.0, spread: float = 3.0) -> DataFrame:
    """Rerank order blended with the fused order, then hits well below the best go. Adds rerank_rank, blended, position."""
    w = W.partitionBy("qid")
    x = hits.withColumn("rerank_rank", F.row_number().over(w.orderBy(F.desc(rerank), "fused_rank")) - 1)
    x = x.withColumn("blended", F.round(1 / (F.lit(BLEND_K) + F.col("rerank_rank")) + 1 / (F.lit(BLEND_K) + F.col("fused_rank")), 12))
    x = x.withColumn("_cut", F.greatest(F.lit(floor), F.max(rerank).over(w) - spread)).filter(F.col(rerank) >= F.col("_cut")).drop("_cut")
    return x.withColumn("position", F.row_number().over(w.orderBy(F.desc("blended"), "rerank_rank")))


def greedy_context(hits: DataFrame, most: int = CONTEXT_K) -> DataFrame:
    """Best hits first, at most ``most`` per query; a code hit whose code, or an image hit whose place, a chosen hit has already goes.

    ``hits``: qid, doc, position, type, text, code, url. The fold runs over a query's ranking, which the top-k before it bounds.
    """
    one = F.struct("position", "doc", "type", "text", "code", "url")
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("h"))

    def step(acc, h):
        seen_code = (h["type"] == "code") & F.exists(acc, lambda c: F.contains(c["text"], h["code"]))
        seen_image = (h["type"] == "image") & F.exists(acc, lambda c: (c["type"] != "code") & (c["url"] == h["url"]))
        take = (F.size(acc) < most) & ~F.coalesce(seen_code, F.lit(False)) & ~F.coalesce(seen_image, F.lit(False))
        return F.when(take, F.concat(acc, F.array(h))).otherwise(acc)

    start = F.slice("h", 1, 0)
    return lists.select("qid", F.explode(F.aggregate("h", start, step)).alias("h")).select("qid", "h.doc", "h.type", "h.position")


def merge_rankings(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first list, then what of the second has a key the first lacks."""
    rest = second.join(first.select("qid", key).distinct(), ["qid", key], "left_anti")
    return first.withColumn("list", F.lit(1)).unionByName(rest.withColumn("list", F.lit(2)))
