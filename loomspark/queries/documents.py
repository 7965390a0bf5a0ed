"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import chunking as K
from ..registry import query


@query("G1", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - 101) + 1, 400)) AS a FROM w WHERE len(ws) > 0)
SELECT doc_id, (a // 400)::INT AS n, array_to_string(ws[a + 1 : a + 500], ' ') AS chunk FROM c""")
def word_chunks(spark, t):
    """Windows of 500 words with 100 in common."""
    return t.documents.select("doc_id", F.posexplode(K.word_windows("text")).alias("n", "chunk"))


@query("G2", "SELECT doc_id, (a // 480)::INT AS n, substr(text, a + 1, 512) AS slice FROM (SELECT doc_id, text, unnest(range(0, length(text), 480)) AS a FROM documents)")
def char_slices(spark, t):
    """Slices of 512 characters every 480."""
    return t.documents.select("doc_id", F.posexplode(K.char_slices("text")).alias("n", "slice"))


@query("G7", "SELECT doc_id, n_chars // 100 + 1 AS expected FROM documents")
def expected_chunks(spark, t):
    """How many chunks a model is asked for."""
    return t.documents.select("doc_id", F.expr("n_chars div 100 + 1").alias("expected"))


@query("DD4 HA1 W5", """WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
i AS (SELECT left(sha1('text' || chr(10) || line), 24) AS id, doc_id, pos FROM c)
SELECT id, doc_id, pos - 1 AS pos FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id, pos) = 1""")
def chunk_hash_dedup(spark, t):
    """Equal chunks once, the first by position."""
    from ..functions.text import chunk_id

    c = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(chunk_id(F.lit("text"), "line").alias("id"), "doc_id", "pos")
    first = c.groupBy("id").agg(F.min(F.struct("doc_id", "pos")).alias("m"))
    return first.select("id", "m.doc_id", "m.pos")


def sectioned(t):
    return t.pages.select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.lit("site").alias("source"), F.col("page_id").alias("page_no"), H.html_sections("html").alias("sections"))


@query("G5 G3 G4 W8 W12 ST21 ST31 U3 U4 U5 U7 DD5 DD6 SC13")
def page_chunks(spark, t):
    """Pages to sections to chunks, with content ids."""
    return K.build_chunks(sectioned(t)).select("id", "page_id", "section", "position", "type", F.length("text").alias("n"))


@query("A33")
def chunk_types(spark, t):
    """Chunks by type."""
    return K.build_chunks(sectioned(t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("G6")
def recursive_chunks(spark, t):
    """Recursive character splits of 1000 with 200 in common."""
    return t.documents.select("doc_id", F.posexplode(K.python_pieces(K.recursive_split, "text")).alias("n", "piece")).select("doc_id", "n", F.length("piece").alias("size"), F.sha1("piece").alias("hash"))


@query("G3 G4 W14")
def packed_blocks(spark, t):
    """Blocks packed to 1800 characters."""
    x = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.documents.select("doc_id", F.posexplode(K.python_pieces(K.packed, x)).alias("n", "chunk")).select("doc_id", "n", F.length("chunk").alias("size"), F.sha1("chunk").alias("hash"))


@query("PF13", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 40")
def long_enough(spark, t):
    """Texts of more than forty words."""
    return t.documents.filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 40).select("doc_id")
