"""Key and value lookups, nested JSON, dates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..registry import query
from ..sources.tables import scan_records

# Weather codes and what they mean; other codes are mixed conditions.
WEATHER = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast",
    45: "foggy", 48: "freezing fog", 51: "light drizzle", 53: "drizzle",
    55: "heavy drizzle", 61: "light rain", 63: "rain", 65: "heavy rain",
    71: "light snow", 73: "snow", 75: "heavy snow", 80: "rain showers",
    81: "heavy rain showers", 82: "violent rain showers",
    95: "thunderstorms", 96: "thunderstorms with hail",
}
# Other names of airlines.
ALIASES = {
    "United Airlines": "United",
    "Delta Air Lines": "Delta",
    "All Nippon Airways": "ANA",
    "Scandinavian Airlines": "SAS",
    "SWISS": "Swiss",
    "Swiss International Air Lines": "Swiss",
    "TAP Portugal": "TAP Air Portugal",
    "LOT Polish Airlines": "LOT",
    "Cathay": "Cathay Pacific",
    "Turkish": "Turkish Airlines",
    "Asiana": "Asiana Airlines",
    "Etihad": "Etihad Airways",
    "Qatar": "Qatar Airways",
    "Southwest Airlines": "Southwest",
    "JetBlue Airways": "JetBlue",
    "Alaska": "Alaska Airlines",
}


def code_label(code):
    """A weather code's meaning."""
    pairs = F.create_map(*[x for k, v in WEATHER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(pairs[code], F.lit("mixed conditions"))


@query("J13", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'mainly clear' WHEN 2 THEN 'partly cloudy' WHEN 3 THEN 'overcast' WHEN 45 THEN 'foggy' WHEN 48 THEN 'freezing fog' ELSE 'mixed conditions' END AS weather FROM part WHERE p_size < 50")
def code_labels(spark, t):
    """Codes looked up with a default."""
    return t.part.filter("p_size < 50").select("p_partkey", code_label(F.col("p_size")).alias("weather"))


@query("J12", """WITH a AS (SELECT * FROM (VALUES ('GERMANY', 'FRANCE'), ('CHINA', 'INDIA')) v(alias, canonical)), n AS (SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), d AS (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 10)
SELECT c_custkey, coalesce(canonical, n.n_name) AS name, coalesce(n_regionkey, -1) AS region FROM n LEFT JOIN a ON alias = n.n_name LEFT JOIN d ON d.n_name = coalesce(canonical, n.n_name)""")
def alias_lookup(spark, t):
    """Alias first, then the dimension with a default."""
    a = spark.createDataFrame([("GERMANY", "FRANCE"), ("CHINA", "INDIA")], "alias string, canonical string")
    n = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    x = n.join(F.broadcast(a), F.col("alias") == F.col("n_name"), "left").withColumn("name", F.coalesce("canonical", "n_name"))
    d = t.nation.filter("n_nationkey < 10").select(F.col("n_name").alias("dn"), "n_regionkey")
    return x.join(F.broadcast(d), F.col("dn") == F.col("name"), "left").select("c_custkey", "name", F.coalesce("n_regionkey", F.lit(-1)).alias("region"))


NAMES = [*ALIASES, *dict.fromkeys(ALIASES.values()), "No Such Air"]


@query("J12", f"""WITH a AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ALIASES.items())}) v(alias, canonical)), c AS (SELECT c_custkey, list_value({", ".join(f"'{n}'" for n in NAMES)})[c_custkey % {len(NAMES)} + 1] AS name FROM customer)
SELECT c_custkey, name, coalesce(canonical, name) AS airline FROM c LEFT JOIN a ON alias = name""")
def airline_names(spark, t):
    """Other names of airlines brought to one."""
    known = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    return t.customer.select("c_custkey", name.alias("name")).withColumn("airline", F.coalesce(known[F.col("name")], F.col("name")))


@query("J14", """SELECT q.event_id, count(f.event_id) AS feedback FROM events q LEFT JOIN events f ON f.event_type = 'click' AND f.user_id = q.user_id AND f.event_id = q.event_id + 1 WHERE q.event_type <> 'click' GROUP BY 1""")
def feedback_join(spark, t):
    """Questions with the feedback that shares their key."""
    q = t.events.filter("event_type <> 'click'").select("event_id", "user_id", (F.col("event_id") + 1).alias("k"))
    f = t.events.filter("event_type = 'click'").select(F.col("event_id").alias("k"), "user_id", F.lit(1).alias("one"))
    return q.join(f, ["k", "user_id"], "left").groupBy("event_id").agg(F.count("one").alias("feedback"))




@query("SC18 A26 JS2", """SELECT p_partkey, greatest(p_size + 3, 5)::DOUBLE AS high, least(p_size, 5)::DOUBLE AS low, (p_size % 4 > 1)::INT AS rainy FROM part""")
def daily_weather(spark, t):
    """Ranges of a JSON array and days with more than a millimetre."""
    j = F.concat(F.lit('{"daily":{"max":['), F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") + 3).cast("string"), F.lit(',5],"rain":[0.5,1.0,'), (F.col("p_size") % 4).cast("string"), F.lit(",null]}}"))
    x = t.part.select("p_partkey", F.from_json(j, "daily struct<max:array<double>,rain:array<double>>").alias("j"))
    return x.select("p_partkey", F.array_max("j.daily.max").alias("high"), F.array_min("j.daily.max").alias("low"), F.size(F.filter("j.daily.rain", lambda r: r > 1.0)).alias("rainy"))


@query("A27 Q22", "WITH c AS (SELECT p_brand, p_size % 5 AS code, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, code FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, code) = 1")
def mode_code(spark, t):
    """The most frequent code; the smallest of equals."""
    c = t.part.groupBy("p_brand", (F.col("p_size") % 5).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))


def _plausible(text: str | None) -> float | None:
    """The least number from 20 to 20000 under any key with price in its name, rounded."""
    try:
        stack, best = [("", json.loads(text or "null"))], None
    except ValueError:
        return None
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack += v.items()
        elif isinstance(v, list):
            stack += [(key, x) for x in v]
        elif isinstance(v, (int, float)) and not isinstance(v, bool) and "price" in key.lower() and 20 <= v <= 20000:
            best = v if best is None else min(best, v)
    return None if best is None else float(round(best))


@query("A28", "SELECT p_partkey, CASE WHEN p_size >= 20 THEN p_size::DOUBLE ELSE round_even(p_retailprice, 0) END AS price FROM part")
def plausible_price(spark, t):
    """The least plausible price anywhere in a JSON tree."""

    @F.pandas_udf("double")
    def least(s):
        return s.map(_plausible)

    j = F.to_json(F.struct(F.struct(F.col("p_size").alias("basePrice"), F.array(F.struct(F.col("p_retailprice").alias("price"))).alias("offers")).alias("a"), F.lit(7).alias("id")))
    return t.part.select("p_partkey", least(j).alias("price"))


@query("A29 T15", "SELECT p_partkey, least(p_size * 10, CASE WHEN p_partkey % 3 = 0 THEN 1000000000 ELSE p_size * 5 END)::BIGINT AS cheapest, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS airline FROM part")
def cheapest_itinerary(spark, t):
    """The cheapest of two lists of itineraries; no price counts as very dear."""
    p = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_size") * 5).cast("long")
    all_ = F.concat(F.array(F.struct((F.col("p_size") * 10).cast("long").alias("price"), F.lit("A").alias("airline"))), F.array(F.struct(p.alias("price"), F.lit("B").alias("airline"))))
    best = F.array_min(F.transform(all_, lambda x: F.struct(F.coalesce(x["price"], F.lit(1_000_000_000)).alias("price"), x["airline"].alias("airline"))))
    return t.part.select("p_partkey", best["price"].alias("cheapest"), best["airline"].alias("airline"))


@query("A30 SC19", "SELECT count(*) AS destinations, (SELECT n_nationkey FROM nation WHERE lower(n_name) = lower(trim('  FRANCE '))) AS france FROM nation")
def destinations(spark, t):
    """A count and a lookup by a cleaned key."""
    return t.nation.agg(F.count(F.lit(1)).alias("destinations"), F.max(F.when(F.lower("n_name") == F.lower(F.trim(F.lit("  FRANCE "))), F.col("n_nationkey"))).alias("france"))


@query("DT1 Q20", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day FROM events")
def iso_dates(spark, t):
    """ISO dates, null for anything else."""
    x = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", F.try_to_date(x, "yyyy-MM-dd").alias("day"))


@query("DT2", """WITH x AS (SELECT event_id, DATE '2024-01-05' AS today, ts::DATE AS a, ts::DATE + 10 AS b FROM events)
SELECT event_id, CASE WHEN a - today <= 16 THEN a ELSE (a - INTERVAL 12 MONTH)::DATE END AS from_day, CASE WHEN a - today <= 16 THEN least(b, today + 16) ELSE (b - INTERVAL 12 MONTH)::DATE END AS to_day FROM x""")
def forecast_window(spark, t):
    """Sixteen days ahead at most; else the same days a year before."""
    today = F.lit("2024-01-05").cast("date")
    a = F.to_date("ts")
    b = F.date_add(a, 10)
    near = F.datediff(a, today) <= 16
    return t.events.select("event_id", F.when(near, a).otherwise(F.add_months(a, -12)).alias("from_day"), F.when(near, F.least(b, F.date_add(today, 16))).otherwise(F.add_months(b, -12)).alias("to_day"))


@query("DT3", "SELECT event_id, printf('%dh %02dm', event_id // 60, event_id % 60) AS duration, split_part(strftime(ts, '%Y-%m-%d %H:%M'), ' ', 2) AS clock FROM events")
def durations(spark, t):
    """Minutes and stamps as text."""
    return t.events.select("event_id", T.minutes_text("event_id").alias("duration"), F.get(F.split(F.date_format("ts", "yyyy-MM-dd HH:mm"), " "), F.lit(1)).alias("clock"))


@query("W11", "SELECT l_orderkey, (max({'n': l_linenumber, 'd': l_shipdate}).d::DATE - min({'n': l_linenumber, 'd': l_shipdate}).d::DATE)::INT AS days FROM lineitem GROUP BY 1")
def day_offset(spark, t):
    """Days between an order's first and last leg; of equal legs the earliest and the latest day."""
    leg = F.struct("l_linenumber", F.to_date("l_shipdate").alias("d"))
    return t.lineitem.groupBy("l_orderkey").agg(F.datediff(F.max(leg)["d"], F.min(leg)["d"]).alias("days"))


@query("STR4", "SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id HAVING 1706745600 - epoch(max(ts)) < 10800")
def ttl_cache(spark, t):
    """Cache entries younger than three hours."""
    from ..streaming.streams import fresh

    c = t.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.unix_timestamp(F.max("ts")).cast("double").alias("fetched_at"))
    return fresh(c, 1706745600.0).select("user_id", "value")


@query("PF16", "SELECT event_id, value FROM events WHERE value > 0")
def positive_deals(spark, t):
    """Nested deals with a price above zero."""
    d = t.events.select(F.struct("event_id", F.col("value").alias("price")).alias("deal"))
    return d.filter("deal.price > 0").select("deal.event_id", F.col("deal.price").alias("value"))


@query("SC21 W6 A31 DD13 T7", """SELECT 'net' || (n_nationkey % 7) AS ssid, 'b' || n_nationkey AS bssid, CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE n_nationkey + 50 END AS strength FROM nation""")
def network_scan(spark, t):
    """Records from a scan's lines; header fields hold until the next."""
    n = t.nation.select((F.col("n_nationkey") * 3).alias("at"), "n_nationkey")
    ssid = n.select("at", F.format_string("SSID %d : net%d", F.col("n_nationkey") + 1, F.col("n_nationkey") % 7).alias("value"))
    cell = n.select(F.col("at") + 1, F.format_string("    BSSID 1 : b%d", "n_nationkey"))
    sig = n.select(F.col("at") + 2, F.concat(F.lit("      Signal : "), F.when(F.col("n_nationkey") % 4 == 0, "?").otherwise(F.concat((F.col("n_nationkey") + 50).cast("string"), F.lit("%")))))
    r = scan_records(ssid.union(cell).union(sig).withColumnRenamed("at", "line_no"))
    return r.dropDuplicates(["bssid", "ssid"]).select("ssid", "bssid", F.coalesce(F.rtrim(F.col("signal"), F.lit("%")).try_cast("int"), F.lit(-1)).alias("strength"))


@query("JS1 JS2 Q3", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_fields(spark, t):
    """A field of a JSON text."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
