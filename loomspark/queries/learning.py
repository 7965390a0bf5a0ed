"""Learning queries on MLlib; fits are checked by rows and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learning as L
from ..registry import query


@query("ML1", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END::DOUBLE AS weight, (p_size % 5 = 0)::INT AS weight_unknown, length(p_name) AS text_length FROM part")
def hand_features(spark, t):
    """Weight, whether it is known, and text length."""
    w = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    return L.hand_features(t.part.select("p_partkey", w.alias("w"), "p_name"), "w", "p_name").select("p_partkey", "weight", "weight_unknown", "text_length")


@query("ML2")
def bag_of_words(spark, t):
    """Counts of the most frequent words."""
    from pyspark.ml.functions import vector_to_array

    d = t.documents.select("doc_id", "text")
    m = L.bag_of_words("text").fit(d)
    return m.transform(d).select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x > 0)).alias("terms"))


@query("ML3")
def hashed_words(spark, t):
    """Hashed binary words."""
    from pyspark.ml.functions import vector_to_array

    d = t.documents.select("doc_id", "text")
    return L.hashed_words("text").fit(d).transform(d).select("doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x).alias("terms"))


def _priced(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("length"), F.col("p_retailprice").alias("price"))


@query("ML4")
def linear_pricer(spark, t):
    """Linear regression."""
    d = _priced(t)
    return L.predict(L.regressor("linear", ["size", "length"], "price").fit(d), d, ["p_partkey"]).select("p_partkey", F.round("guess", 3).alias("guess"))


@query("ML4")
def forest_pricer(spark, t):
    """A random forest of 100 trees on the first 15,000 rows."""
    d = _priced(t)
    return L.predict(L.regressor("forest", ["size", "length"], "price").fit(d.orderBy("p_partkey").limit(15_000)), d, ["p_partkey"])


@query("ML4")
def boosted_pricer(spark, t):
    """Boosted trees."""
    d = _priced(t)
    return L.predict(L.regressor("boosted", ["size", "length"], "price", maxIter=10).fit(d), d, ["p_partkey"])


@query("ML5", "SELECT p_partkey, floor((('0x' || substr(md5('42:' || p_partkey), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 * 1000)::INT AS random_guess, (SELECT round(avg(p_retailprice), 6) FROM part) AS constant_guess FROM part")
def simple_pricers(spark, t):
    """A random and a constant price."""
    avg = t.part.agg(F.round(F.avg("p_retailprice"), 6).alias("constant_guess"))
    return t.part.crossJoin(F.broadcast(avg)).select("p_partkey", L.random_price("p_partkey").alias("random_guess"), "constant_guess")


@query("ML6")
def projected_vectors(spark, t):
    """Two principal components."""
    return L.project(t.embeddings, "embedding", 2).select("vec_id", F.get("projection", F.lit(0)).alias("x"), F.get("projection", F.lit(1)).alias("y"))


@query("U1", "SELECT p_partkey, greatest(0, p_size * 20.0::DOUBLE) AS guess FROM part")
def predictor_column(spark, t):
    """A predictor is any column expression."""
    predictor = F.greatest(F.lit(0), F.col("p_size") * 20.0)
    return t.part.select("p_partkey", predictor.alias("guess"))


@query("U6", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN length(n_name)::VARCHAR WHEN 1 THEN upper(left(n_name, 2)) END AS result FROM nation")
def registered_tools(spark, t):
    """Tools registered by name with the schema of their arguments, and calls that name them; an unknown name gives null."""
    tools = L.Tools()
    tools.register("text_size", {"text": "string"}, lambda a: F.length(a["text"]))
    tools.register("beginning", {"text": "string", "n": "int"}, lambda a: F.upper(F.substring(a["text"], F.lit(1), a["n"])))
    name = F.element_at(F.array(F.lit("text_size"), F.lit("beginning"), F.lit("no_such")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    calls = t.nation.select("n_nationkey", name.alias("tool"), F.to_json(F.struct(F.col("n_name").alias("text"), F.lit(2).alias("n"))).alias("arguments"))
    return calls.select("n_nationkey", tools.call("tool", "arguments").alias("result"))


@query("ST4 ST6", "SELECT p_partkey, round_even(p_retailprice, 0) AS guess FROM part")
def parsed_answers(spark, t):
    """A prompt's answer read back as a number."""
    return t.part.select("p_partkey", T.first_number(F.concat(F.lit("Price is $"), T.price_text("p_retailprice"))).alias("guess"))
