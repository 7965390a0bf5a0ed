"""Scalar function queries over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import skills as S
from ..registry import query


@query("ST6 Q5", r"""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '$1,' || p_size || '.50' WHEN 1 THEN 'about ' || p_size || ' dollars' WHEN 2 THEN '-' || p_size WHEN 3 THEN '-' || p_size || '.5' WHEN 4 THEN 'n/a' ELSE p_size || ' or 7' END AS t FROM part)
SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(replace(replace(t, '$', ''), ',', ''), '[-+]?\d*\.\d+|\d+', 0), '') AS DOUBLE), 0) AS n FROM x""")
def first_number(spark, t):
    """Numbers out of predicted prices."""
    s = F.col("p_size").cast("string")
    x = F.element_at(F.array(F.concat(F.lit("$1,"), s, F.lit(".50")), F.concat(F.lit("about "), s, F.lit(" dollars")), F.concat(F.lit("-"), s), F.concat(F.lit("-"), s, F.lit(".5")), F.lit("n/a"), F.concat(s, F.lit(" or 7"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), T.first_number(x).alias("n"))


@query("ST7", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'GPT 4.1 Nano' WHEN 1 THEN 'Random Pricer' ELSE 'Xgboost' END AS title FROM nation")
def function_titles(spark, t):
    """Headings from function names."""
    n = F.element_at(F.array(F.lit("gpt_4__1_nano"), F.lit("random_pricer"), F.lit("xgboost")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return t.nation.select("n_nationkey", T.name_as_title(n).alias("title"))


@query("ST8", "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS title FROM documents")
def ellipsis_titles(spark, t):
    """Titles of at most forty characters."""
    return t.documents.select("doc_id", T.ellipsis("text").alias("title"))


@query("ST1", r"SELECT doc_id, left(trim(replace(replace(replace(replace(text, chr(10), ' '), chr(13), ''), chr(9), ''), '  ', ' '), ' '), 3000) AS simple FROM documents")
def simplified_texts(spark, t):
    """Texts on one line."""
    return t.documents.select("doc_id", T.simplify("text").alias("simple"))


@query("ST2 Q1")
def scrubbed_texts(spark, t):
    """Part numbers out; the lookaheads see the rest of the line, which RE2 cannot say."""
    x = F.concat_ws(" ", F.upper("p_name"), F.lit("AB12345X"), F.col("p_partkey").cast("string"), F.lit("1234567 end"))
    return t.part.select("p_partkey", F.trim(F.regexp_replace(x, T.PART_NUMBER, "")).alias("text"))


@query("ST15", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, t):
    """Slugs of names."""
    return t.part.select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("ST17", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('  ' || replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS md FROM documents""")
def cleaned_markdown(spark, t):
    """No trailing blanks, no runs of empty lines."""
    x = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".  \n\n\n")))
    return t.documents.select("doc_id", T.clean_markdown(x).alias("md"))


@query("ST18 Q15", r"""WITH x AS (SELECT doc_id, string_split('Next: more' || chr(10) || text || chr(10) || 'On this page ' || chr(10) || 'Edit this page now', chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda s: NOT regexp_matches(s, '(?i)^\s*Skip to main content\s*$|^\s*On this page\s*$|^\s*Edit this page.*$|^\s*Next.*$|^\s*Previous.*$|^\s*Table of contents\s*$')), chr(10)) AS body FROM x""")
def boilerplate_lines(spark, t):
    """Navigation lines out."""
    x = F.concat(F.lit("Next: more\n"), F.col("text"), F.lit("\nOn this page \nEdit this page now"))
    return t.documents.select("doc_id", T.drop_boilerplate(x).alias("body"))


@query("ST25", "SELECT page_id, left(replace(trim(regexp_replace(html, '<[^<]+?>', '', 'g'), ' '), chr(10), ' '), 100) AS snippet FROM pages")
def snippets(spark, t):
    """Short texts of pages."""
    return t.pages.select("page_id", T.snippet("html").alias("snippet"))


@query("ST26", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s.,+#/-]', ' ', 'g'), ' ') AS clean FROM conversations")
def clean_words(spark, t):
    """Messages with word characters and a few signs."""
    return t.conversations.select("conv_id", "turn", T.clean_words("text").alias("clean"))


_SKILLS = "concat('Knows ', CASE WHEN doc_id % 2 = 0 THEN 'C++, GitHub Actions' ELSE 'git and Node.js' END, CASE WHEN doc_id % 3 = 0 THEN '; SQL, Docker' ELSE '' END)"


@query("ST27")
def skills_found(spark, t):
    """Skills in a text, longer names first."""
    return t.documents.select("doc_id", F.array_join(S.extract_skills(F.expr(_SKILLS)), ",").alias("skills"))


@query("DD12 T5", """WITH s AS (SELECT doc_id, list_sort(CASE WHEN doc_id % 2 = 0 THEN ['c++', 'github actions'] ELSE ['git', 'node.js'] END || CASE WHEN doc_id % 3 = 0 THEN ['sql', 'docker'] ELSE [] END) AS have, ['docker', 'git', 'sql'] AS want FROM documents),
g AS (SELECT doc_id, list_filter(want, lambda x: list_contains(have, x)) AS matched, list_filter(want, lambda x: NOT list_contains(have, x)) AS missing FROM s)
SELECT doc_id, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, round(len(matched) / 3 * 100, 1) AS coverage, row_number() OVER (ORDER BY len(matched) DESC, doc_id) AS place FROM g QUALIFY place <= 50""", name="skill_gap")
def skill_gap(spark, t):
    """What a text's skills cover of three wanted ones; the fifty best."""
    x = t.documents.select("doc_id", S.gap(S.extract_skills(F.expr(_SKILLS)), F.array(F.lit("docker"), F.lit("git"), F.lit("sql"))).alias("g"))
    top = x.select("doc_id", "g.*").orderBy(F.desc("coverage"), "doc_id").limit(50)
    from pyspark.sql.window import Window as W

    return top.select("doc_id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "coverage", F.row_number().over(W.orderBy(F.desc("coverage"), "doc_id")).alias("place"))


@query("ST28", """SELECT conv_id, 1 AS number, 'Ann' AS name FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 2, 'Candidate 2' FROM conversations WHERE turn = 0""")
def resume_blocks(spark, t):
    """Blocks of a pasted text with their names."""
    x = F.concat(F.lit("=== RESUME ===\nAnn\n"), F.col("text"), F.lit("\n===resume===\n"), F.lit("x" * 70))
    return t.conversations.filter("turn = 0").select("conv_id", F.explode(S.resume_blocks(x)).alias("b")).select("conv_id", "b.number", "b.name")


@query("ST29", "SELECT p_partkey, CASE WHEN p_size * 2 >= 80 THEN 'strong' WHEN p_size * 2 >= 60 THEN 'good' WHEN p_size * 2 >= 40 THEN 'partial' ELSE 'weak' END AS label FROM part")
def score_labels(spark, t):
    """Strength of a match."""
    return t.part.select("p_partkey", T.score_label(F.col("p_size") * 2).alias("label"))


@query("ST32 Q19", """SELECT p_partkey, 'Table row:' || chr(10) || '- name: ' || p_name || chr(10) || '- (row): ' || p_brand AS body FROM part""")
def table_rows(spark, t):
    """A table's rows written out; empty and surplus cells go."""
    from ..operators.chunking import row_text

    cols = F.array(F.lit("name"), F.lit(""), F.lit("size"))
    return t.part.select("p_partkey", row_text(cols, F.array("p_name", "p_brand", F.lit(""), F.lit("surplus"))).alias("body"))


@query("ST33", """SELECT doc_id, 'py' AS language, 'x = ' || doc_id AS body FROM documents""")
def code_blocks(spark, t):
    """Fenced code out of markdown."""
    x = F.concat(F.col("text"), F.lit("\n```py\nx = "), F.col("doc_id").cast("string"), F.lit("\n```\nend"))
    return t.documents.select("doc_id", F.explode(T.code_blocks(x)).alias("c")).select("doc_id", "c.language", "c.body")


@query("ST34 PF18", "SELECT doc_id, array_to_string(list_filter(list_sort(list_distinct([2, (doc_id % 12)::INT, 2])), lambda n: n > 0 AND n <= 8), ',') AS cited FROM documents")
def citations(spark, t):
    """Citation numbers inside the bounds."""
    x = F.concat(F.lit("see [2] and ["), (F.col("doc_id") % 12).cast("string"), F.lit("] or [2]"))
    return t.documents.select("doc_id", F.array_join(F.transform(F.filter(T.citations(x), lambda n: (n > 0) & (n <= 8)), lambda n: n.cast("string")), ",").alias("cited"))


_NO = "I have no information about that."


@query("ST35", f"""WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{_NO}' WHEN 1 THEN text || ' {_NO}' ELSE text END AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT contains(a, '{_NO}') OR trim(a, ' ') = '{_NO}' THEN a ELSE trim(replace(a, '{_NO}', ''), ' ') END AS answer, starts_with(a, '{_NO}') AS refused FROM x""")
def stray_refusals(spark, t):
    """A refusal that follows an answer goes."""
    a = F.when(F.col("turn") % 3 == 0, _NO).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" " + _NO))).otherwise(F.col("text"))
    x = t.conversations.withColumn("a", a)
    keep = ~F.contains("a", F.lit(_NO)) | (F.trim("a") == _NO)
    return x.select("conv_id", "turn", F.when(keep, F.col("a")).otherwise(F.trim(F.replace("a", F.lit(_NO), F.lit("")))).alias("answer"), F.startswith("a", F.lit(_NO)).alias("refused"))


@query("ST36", r"SELECT page_id, split_part(url, '?', 1) AS bare, replace('docs\' || page_id || '\x.md', '\', '/') AS path FROM pages")
def bare_sources(spark, t):
    """Sources without query, paths with slashes."""
    return t.pages.select("page_id", F.substring_index("url", "?", 1).alias("bare"), F.replace(F.concat(F.lit("docs\\"), F.col("page_id").cast("string"), F.lit("\\x.md")), F.lit("\\"), F.lit("/")).alias("path"))


@query("ST37", "SELECT p_partkey, 'int main() { return ' || p_size || '; }' AS code FROM part")
def stripped_fences(spark, t):
    """Code without the fence around it."""
    x = F.concat(F.lit("```cpp\nint main() { return "), F.col("p_size").cast("string"), F.lit("; }\n```"))
    return t.part.select("p_partkey", T.strip_fence(x).alias("code"))


@query("ST38", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE least(greatest(p_size, 1), 5) END AS score FROM part")
def judge_scores(spark, t):
    """Scores clamped to 1..5, 3 where there is none."""
    x = F.when(F.col("p_partkey") % 4 == 0, "good answer").otherwise(F.concat(F.lit("Score="), F.col("p_size").cast("string"), F.lit(" fine")))
    return t.part.select("p_partkey", T.judge_score(x).alias("score"))


@query("ST39", "SELECT n_nationkey, '<span style=\"color: #00dd00\">' || n_name || '</span>' AS html FROM nation")
def coloured_log(spark, t):
    """Colour codes as HTML."""
    return t.nation.select("n_nationkey", T.ansi_to_html(F.concat(F.lit("\x1b[40m\x1b[32m"), F.col("n_name"), F.lit("\x1b[0m"))).alias("html"))


@query("HA1 HA2", "SELECT doc_id, left(sha1('text' || chr(10) || text), 24) AS id, sha1(text) AS full_hash, left(sha1(source), 12) AS short FROM documents")
def content_ids(spark, t):
    """Content-based ids."""
    return t.documents.select("doc_id", T.chunk_id(F.lit("text"), "text").alias("id"), F.sha1("text").alias("full_hash"), F.substring(F.sha1("source"), 1, 12).alias("short"))


@query("MA3 MA4 PF17 T4", """WITH x AS (SELECT p_partkey, 0.8 * p_retailprice + 0.1 * (p_retailprice + 500) + 0.1 * (p_size * 20) AS estimate, p_retailprice AS price FROM part)
SELECT p_partkey, round(estimate, 4) AS estimate, round(estimate - price, 4) AS discount FROM x WHERE estimate - price > 50""")
def blended_discounts(spark, t):
    """A weighted blend of three estimates against the price."""
    e = 0.8 * F.col("p_retailprice") + 0.1 * (F.col("p_retailprice") + 500) + 0.1 * (F.col("p_size") * 20)
    return t.part.select("p_partkey", e.alias("e"), (e - F.col("p_retailprice")).alias("d")).filter("d > 50").select("p_partkey", F.round("e", 4).alias("estimate"), F.round("d", 4).alias("discount"))


@query("T4 PF17", """WITH x AS (SELECT p_partkey, p_size * 2.0::DOUBLE AS discount FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5)) SELECT p_partkey, discount FROM x WHERE discount > 50 ORDER BY discount DESC, p_partkey LIMIT 1""")
def best_deal(spark, t):
    """The best of the first five, if it is good enough."""
    from ..streaming.streams import best_alert

    return best_alert(t.part.select("p_partkey", (F.col("p_size") * 2.0).alias("discount")), "discount", 50.0, 5, "p_partkey")


@query("MA5 GR4", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)
SELECT doc_id, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), 'START') AS src, token AS dst, round(exp(-pos::DOUBLE / 10), 6) AS p FROM w
UNION ALL SELECT doc_id, token, 'END', 1.0 FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1
UNION ALL SELECT doc_id, token, alt, round(exp(-pos::DOUBLE / 10 - k), 6) FROM (SELECT doc_id, token, pos, unnest(list_filter([reverse(token), token || 's', '_' || token], lambda a: a <> token)[1:2]) AS alt, generate_subscripts(list_filter([reverse(token), token || 's', '_' || token], lambda a: a <> token)[1:2], 1) AS k FROM w)""")
def token_chain(spark, t):
    """The chain of a text's tokens as edges, with probabilities from log probabilities, and the two best other tokens as leaves."""
    from pyspark.sql.window import Window as W

    w = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    other = lambda x: F.slice(F.filter(F.array(F.reverse(x), F.concat(x, F.lit("s")), F.concat(F.lit("_"), x)), lambda a: a != x), 1, 2)
    leaves = w.select("doc_id", "token", "pos", F.posexplode(other(F.col("token"))).alias("k", "alt"))
    leaves = leaves.select("doc_id", F.col("token").alias("src"), F.col("alt").alias("dst"), F.round(F.exp(-(F.col("pos") + 1).cast("double") / 10 - (F.col("k") + 1)), 6).alias("p"))
    o = W.partitionBy("doc_id").orderBy("pos")
    chain = w.select("doc_id", F.coalesce(F.lag("token").over(o), F.lit("START")).alias("src"), F.col("token").alias("dst"), F.round(F.exp(-(F.col("pos") + 1).cast("double") / 10), 6).alias("p"))
    last = w.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("pos")))).filter("n = 1").select("doc_id", F.col("token").alias("src"), F.lit("END").alias("dst"), F.lit(1.0).alias("p"))
    return chain.union(last).union(leaves)


@query("MA6", "SELECT round(4 * (1 + sum(-1.0::DOUBLE / (4 * i - 1) + 1.0::DOUBLE / (4 * i + 1))), 6) AS pi FROM range(1, 1000001) AS r(i)")
def slow_series(spark, t):
    """A million terms of a slow series."""
    i = F.col("id").cast("double")
    return spark.range(1, 1_000_001).agg(F.round(4 * (1 + F.sum(-1 / (4 * i - 1) + 1 / (4 * i + 1))), 6).alias("pi"))


@query("MA7", "SELECT (sum(32 * (p_size + p_size * 4)) * 28)::BIGINT AS parameters FROM part")
def adapter_parameters(spark, t):
    """Parameters of low-rank adapters over a table of shapes."""
    return t.part.agg((F.sum(32 * (F.col("p_size") + F.col("p_size") * 4)) * 28).alias("parameters"))


@query("MA1", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, t):
    """Cosine of consecutive vectors."""
    a, b = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.cosine("x", "y"), 6).alias("cosine"))


@query("TR1", """WITH m AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id) SELECT conv_id, transcript FROM m""")
def transcripts(spark, t):
    """Conversations folded to one text each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("x")))), lambda s: s["x"])
    return t.conversations.groupBy("conv_id").agg(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(no messages)")).alias("transcript"))


@query("W9 PF20", r"""WITH c AS (SELECT * FROM conversations WHERE NOT (trim(text, ' ') = '**Images**' OR (starts_with(trim(text, ' '), '_') AND ends_with(trim(text, ' '), '_') AND NOT contains(trim(text, ' '), chr(10)))))
SELECT conv_id, turn, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def last_six_turns(spark, t):
    """The last six turns that are no captions."""
    from pyspark.sql.window import Window as W

    x = F.trim("text")
    noise = (x == "**Images**") | (x.startswith("_") & x.endswith("_") & ~F.contains(x, F.lit("\n")))
    return t.conversations.filter(~noise).withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("n <= 6").select("conv_id", "turn", "role")


@query("W10", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 18")
def last_log_lines(spark, t):
    """The last eighteen lines."""
    return t.events.orderBy(F.desc("event_id")).limit(18).select("event_id")


@query("JS3", "SELECT conv_id, turn, text FROM conversations")
def message_texts(spark, t):
    """Contents that are texts or lists of parts, as text."""
    as_list = F.to_json(F.array(F.struct("text")))
    return t.conversations.select("conv_id", "turn", T.message_text(F.when(F.col("turn") % 2 == 0, as_list).otherwise(F.col("text"))).alias("text"))
