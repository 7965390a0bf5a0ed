"""Curation queries: parts play products, documents play texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..registry import query
from ..scratch import scratch
from ..sources import sinks, tables

PRICED = """
raw AS (SELECT p_partkey AS id, p_name AS title, p_type AS category,
  CASE WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE p_retailprice::VARCHAR END AS price,
  p_size || CASE p_partkey % 6 WHEN 0 THEN ' Pounds' WHEN 1 THEN ' ounces' WHEN 2 THEN ' Grams' WHEN 3 THEN ' Kilograms' WHEN 4 THEN ' Milligrams' ELSE ' stone' END AS item_weight FROM part),
items AS (SELECT id, title, category, TRY_CAST(price AS DOUBLE) AS price, item_weight FROM raw WHERE TRY_CAST(price AS DOUBLE) BETWEEN 0.5 AND 999.49)
"""


def raw_products(t):
    unit = F.element_at(F.array(*[F.lit(x) for x in (" Pounds", " ounces", " Grams", " Kilograms", " Milligrams", " stone")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    price = F.when(F.col("p_partkey") % 17 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), price.alias("price"), F.concat(F.col("p_size").cast("string"), unit).alias("item_weight"))


def items(t):
    return raw_products(t).withColumn("price", T.try_number("price")).filter(F.col("price").between(C.MIN_PRICE, C.MAX_PRICE))


@query("PF1 PF2", f"WITH {PRICED} SELECT id, title, category, price FROM items")
def priced_items(spark, t):
    """Numeric prices in range."""
    return items(t).select("id", "title", "category", "price")


@query("ST3", f"""WITH {PRICED} SELECT id, round(CASE id % 6 WHEN 0 THEN w WHEN 1 THEN w / 16.0 WHEN 2 THEN w / 453.592 WHEN 3 THEN w / 0.453592 WHEN 4 THEN w / 453592.0 ELSE 0 END, 6) AS pounds
FROM (SELECT id, split_part(item_weight, ' ', 1)::DOUBLE AS w FROM items)""")
def unit_weight(spark, t):
    """Weights in pounds."""
    return items(t).select("id", F.round(T.weight_in_pounds("item_weight"), 6).alias("pounds"))


@query("PF4 ST1 ST2 PF3 SC1")
def curate_items(spark, t):
    """Raw rows through the whole parse; documents give the descriptions."""
    d = t.documents.select((F.col("doc_id") + 1).alias("k"), "text")
    details = F.to_json(F.create_map(F.lit("Item Weight"), F.col("item_weight"), F.lit("Best Sellers Rank"), F.lit("9")))
    raw = raw_products(t).join(d, F.col("id") == F.col("k")).select("id", "title", "category", "price", F.split("text", "\n").alias("description"), F.array(F.col("category")).alias("features"), details.alias("details"))
    return C.parse_items(raw).select("id", "price", F.length("full").alias("n_full"), F.round("weight", 6).alias("weight"))


@query("DD2 W5 T9 U2", """WITH d AS (SELECT doc_id, source || '/' || lang AS title, text, md5('42:' || doc_id) AS h FROM documents),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, n ORDER BY h, doc_id) AS r FROM (SELECT *, doc_id % 50 AS n FROM d)) WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY h, doc_id) AS q FROM a) WHERE q = 1)
SELECT doc_id, title FROM b""")
def dedup_sequential(spark, t):
    """By title, then by text on the survivors, in a seeded order."""
    d = t.documents.select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("name"), (F.col("doc_id") % 50).alias("n")).withColumn("title", F.concat_ws(":", "name", F.col("n").cast("string")))
    return C.dedup_in_sequence(d, C.shuffled(d, "doc_id", 42), ("title", "text")).select("doc_id", F.col("name").alias("title"))


@query("A1 A5", f"WITH {PRICED} SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM items GROUP BY category")
def category_share(spark, t):
    """Counts and percentages by category."""
    c = items(t).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select("category", "n", F.round(F.col("n") * 100.0 / F.col("all"), 6).alias("pct"))


@query("A2 A6", f"WITH {PRICED} SELECT round(avg(price), 6) AS avg_price, min(price) AS min_price, max(price) AS max_price, round(avg(length(title)), 6) AS avg_len, min(length(title)) AS min_len, max(length(title)) AS max_len FROM items")
def price_length_stats(spark, t):
    """Ranges of price and length."""
    return items(t).agg(F.round(F.avg("price"), 6).alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(F.avg(F.length("title")), 6).alias("avg_len"), F.min(F.length("title")).cast("long").alias("min_len"), F.max(F.length("title")).cast("long").alias("max_len"))


@query("A3", f"""WITH {PRICED} SELECT least(floor(price / 10), 98)::BIGINT AS bin, count(*) AS n FROM items WHERE price >= 0 AND price <= 990 GROUP BY 1""")
def price_histogram(spark, t):
    """Bins of 10; the last edge is 990 and belongs to its bin."""
    return C.histogram(items(t), "price", 990, 10)


@query("A3", "SELECT least(floor(n_chars / 50), 79)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 4000 GROUP BY 1")
def length_histogram(spark, t):
    """Text lengths in bins of 50."""
    return C.histogram(t.documents, "n_chars", 4000, 50)


@query("A4", f"""WITH {PRICED} SELECT 'price' AS what, id FROM (SELECT id FROM items ORDER BY price DESC, id LIMIT 1)
UNION ALL SELECT 'length', doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)""")
def argmax_rows(spark, t):
    """The dearest item and the longest text, first of equals."""
    a = items(t).orderBy(F.desc("price"), "id").limit(1).select(F.lit("price").alias("what"), "id")
    return a.union(t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(1).select(F.lit("length"), F.col("doc_id")))


@query("A36", f"WITH {PRICED} SELECT id, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS scaled FROM items")
def min_max_scaled(spark, t):
    """Prices scaled to 0..1 by a broadcast range."""
    x = items(t)
    return x.crossJoin(F.broadcast(x.agg(F.min("price").alias("lo"), F.max("price").alias("hi")))).select("id", F.round((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"))


@query("T10", f"""WITH {PRICED},
r AS (SELECT min(price) AS lo, max(price) AS hi FROM items),
w AS (SELECT id, price, pow((price - lo) / (hi - lo + 1e-9), 2.0) * CASE category WHEN 'PROMO STEEL' THEN 0.5 ELSE 1.0 END AS w FROM items, r),
k AS (SELECT id, price, ln((('0x' || substr(md5('42:' || id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS k FROM w WHERE w > 0)
SELECT id, price FROM k ORDER BY k DESC, id LIMIT 100""")
def weighted_sample(spark, t):
    """100 items without replacement, dear ones likelier."""
    return C.weighted_sample(items(t), 100, {"PROMO STEEL": 0.5}).select("id", "price")


@query("T11 T13 W13 DD1 SC2", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS seq FROM documents)
SELECT doc_id, seq, CASE WHEN seq < 150 THEN 'train' WHEN seq < 170 THEN 'validation' ELSE 'test' END AS split, (seq < 30 OR seq BETWEEN 150 AND 154 OR seq BETWEEN 170 AND 174) AS lite FROM d WHERE seq < 190""")
def split_lite_full(spark, t):
    """Splits by running number of a seeded order; lite is the prefix of each."""
    d = C.numbered(t.documents.select("doc_id"), C.shuffled(t.documents, "doc_id", 7))
    s = C.split_prefixes(d, {"train": 150, "validation": 20, "test": 20})
    lite = (F.col("seq") < 30) | F.col("seq").between(150, 154) | F.col("seq").between(170, 174)
    return s.select("doc_id", "seq", "split", lite.alias("lite"))


@query("T12", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5('5:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5 < 0.01 * 4503599627370496.0")
def one_percent(spark, t):
    """A one per cent validation split by hash."""
    return t.documents.filter(C.hash_uniform("5", F.col("doc_id")) < 0.01).select("doc_id")


@query("ST4", f"""WITH {PRICED} SELECT id, 'What does this cost to the nearest dollar?' || chr(10) || chr(10) || title || chr(10) || chr(10) || 'Price is $' || round_even(price, 0)::BIGINT || '.00' AS prompt,
'What does this cost to the nearest dollar?' || chr(10) || chr(10) || title || chr(10) || chr(10) || 'Price is $' AS question FROM items""")
def prompts(spark, t):
    """Training and test prompts; prices rounded half to even."""
    return items(t).withColumn("prompt", T.price_prompt("title", "price")).select("id", "prompt", T.question_prompt("prompt").alias("question"))


@query("ST5", f"""WITH {PRICED}, p AS (SELECT id, 'What does this cost to the nearest dollar?' || chr(10) || chr(10) || array_to_string(string_split(title, ' ')[1:2], ' ') || chr(10) || chr(10) || 'Price is $' AS prompt, price FROM items)
SELECT id, prompt, CASE WHEN id % 2 = 0 THEN round_even(price, 0)::BIGINT || '.00' ELSE price::VARCHAR END AS completion FROM p""")
def truncated_prompts(spark, t):
    """Prompts of texts cut to two tokens of a blank tokenizer; rounded prices for even ids, exact ones for odd."""
    even, odd = (T.made_prompt("title", "price", 2, r) for r in (True, False))
    x = items(t).withColumn("p", F.when(F.col("id") % 2 == 0, even).otherwise(odd))
    return x.select("id", "p.prompt", "p.completion")


@query("SC1 SC2", f"""WITH {PRICED} SELECT id, category, title, 'train' AS split FROM items WHERE id % 10 < 8 AND category = (SELECT min(category) FROM items)
UNION ALL SELECT id, category, title, 'test' FROM items WHERE id % 10 = 9 AND category = (SELECT min(category) FROM items)""")
def typed_splits(spark, t):
    """One configuration of a dataset written by configuration and split, read back as typed rows by split."""
    path = scratch(spark, "dataset")
    x = items(t).withColumn("split", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "validation").otherwise("test"))
    x.withColumn("config", F.col("category")).write.partitionBy("config", "split").parquet(path)
    first = x.agg(F.min("category")).first()[0]
    train, _, test = tables.read_splits(spark, path, first)
    return train.select("id", "category", "title", F.lit("train").alias("split")).union(test.select("id", "category", "title", F.lit("test")))


@query("SK1 SK2")
def split_round_trip(spark, t):
    """Prompts written by split and read back by split."""
    path = scratch(spark)
    df = items(t).select(T.price_prompt("title", "price").alias("prompt"), T.price_text("price").alias("completion"), F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "validation").otherwise("test").alias("split"))
    sinks.write_splits(sinks.prompts_only(df), path)
    return tables.read_split(spark, path, "validation")


@query("SK3 G8", f"""WITH {PRICED} SELECT (id // 1000)::BIGINT AS batch, (id // 1000 * 1000) || '_' || ((id // 1000 + 1) * 1000) || '.jsonl' AS name, count(*) AS n FROM items GROUP BY ALL""")
def request_files(spark, t):
    """Requests in files of a thousand."""
    return sinks.request_lines(items(t), "m", text="title").groupBy("batch", "name").agg(F.count("line").alias("n"))


@query("SK4", f"""WITH {PRICED} SELECT id, '{{"messages":[{{"role":"user","content":"' || title || '"}},{{"role":"assistant","content":"$' || round_even(price, 0)::BIGINT || '.00"}}]}}' AS line FROM items""")
def chat_lines(spark, t):
    """Fine-tuning lines."""
    return items(t).select("id", sinks.chat_line(F.col("title"), F.concat(F.lit("$"), T.price_text("price"))).alias("line"))


@query("SK8 T6", "SELECT p_brand, '## ' || p_brand || chr(10) || string_agg('- ' || p_name, chr(10) ORDER BY '- ' || p_name) AS listing FROM part GROUP BY p_brand")
def brand_listing(spark, t):
    """A sorted listing per brand."""
    return sinks.listing(t.part, "p_brand", "p_name")


@query("SK12 T13", "SELECT text AS summary, 0 AS guess FROM documents ORDER BY doc_id LIMIT 100")
def labelling_sheet(spark, t):
    """The first hundred texts with a zero to fill in."""
    return sinks.labelling_sheet(t.documents, "text", "doc_id")


@query("A35 MA2", "SELECT round(avg(ln(p_retailprice + 1)), 6) AS mean, round(stddev_samp(ln(p_retailprice + 1)), 6) AS std FROM part")
def log_price_scale(spark, t):
    """Mean and sample deviation of log prices."""
    return t.part.agg(F.round(F.avg(F.ln(F.col("p_retailprice") + 1)), 6).alias("mean"), F.round(F.stddev_samp(F.ln(F.col("p_retailprice") + 1)), 6).alias("std"))


@query("MA2", "SELECT p_partkey, round(greatest(0, exp(((ln(p_retailprice + 1) - 4.434937953948975) / 1.0328539609909058) * 1.0328539609909058 + 4.434937953948975) - 1), 4) AS price FROM part")
def log_price_round_trip(spark, t):
    """The transform and its inverse."""
    from ..functions import vectors as V

    z = V.price_to_log("p_retailprice", 4.434937953948975, 1.0328539609909058)
    return t.part.withColumn("z", z).select("p_partkey", F.round(V.log_to_price("z", 4.434937953948975, 1.0328539609909058), 4).alias("price"))


@query("PF15", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def missing_summaries(spark, t):
    """Ids that lack a label."""
    return t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").filter("quality is null").select("doc_id")
