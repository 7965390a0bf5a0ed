"""Web queries over pages: URLs, links, texts, crawls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import html as H
from ..functions import urls as U
from ..operators import web as O
from ..registry import query
from ..sources import sinks, tables

HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("ST10 PF7", rf"""WITH x AS (SELECT page_id, {HOST} AS h, regexp_replace(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END, '/index(\.html?)?$', '/') AS p FROM pages),
y AS (SELECT page_id, h, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS p FROM x)
SELECT page_id, CASE WHEN regexp_matches(lower(p), '\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|msi|exe|xml|json|css|js|txt|rss|atom|mp4|woff2?|ttf)$') OR contains(p, '/feeds/') THEN NULL ELSE 'https://' || h || p END AS url FROM y""")
def url_normalize(spark, t):
    """Canonical URLs; null for what is no page."""
    return t.pages.select("page_id", U.canonical("url").alias("url"))


@query("ST11 ST12 PF6 PF5 PF9 PF11", f"""SELECT page_id, regexp_replace(regexp_replace(url || '#top', '#.*$', ''), '/+$', '') AS bare, regexp_matches(url, '^https?://[^/]+') AS valid, starts_with(url, 'http://th') AS prefixed,
{PATH} = '/fr' OR starts_with({PATH}, '/fr/') AS under, regexp_matches(split_part({PATH}, '/', 2), '^[a-z]{{2}}([-_][a-z]{{2}})?$') AS locale, {HOST} = regexp_replace('www.ththre.example.com', '^www\\.', '') AS same FROM pages""")
def url_predicates(spark, t):
    """Fragment removal and tests of URLs."""
    return t.pages.select(
        "page_id", U.without_fragment(F.concat(F.col("url"), F.lit("#top"))).alias("bare"), U.is_web("url").alias("valid"), U.starts_with("url", "http://th/").alias("prefixed"),
        U.under_path("url", "/fr").alias("under"), U.has_locale("url").alias("locale"), U.same_site("url", F.lit("http://www.ththre.example.com/x")).alias("same"),
    )


@query("ST14 ST16 SK6", rf"""WITH x AS (SELECT page_id, url, {PATH} AS p FROM pages), y AS (SELECT *, trim(p, '/') AS q, split_part(regexp_replace(p, '/+$', ''), '/', -1) AS last FROM x)
SELECT page_id, regexp_replace(CASE WHEN q = '' THEN 'index' ELSE regexp_replace(q, '\.html?$', '') END, '[^a-zA-Z0-9/_-]', '_', 'g') || '.md' AS file, upper(left(replace(last, '-', ' '), 1)) || lower(substr(replace(last, '-', ' '), 2)) AS category, sha1(url) AS url_sha1 FROM y""")
def saved_files(spark, t):
    """File names, category names and hashes of URLs."""
    p = sinks.page_files(t.pages.select("page_id", "url", F.col("html").alias("text")), U.file_name("url"))
    return p.select("page_id", F.col("file_path").alias("file"), U.category_name("url").alias("category"), "url_sha1")


@query("ST22 ST13", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS dst FROM l""")
def page_links(spark, t):
    """Links made absolute."""
    return O.page_links(t.pages).select("page_id", "pos", "dst")


@query("DD9", r"""SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*href="(/[^"]*)"', 1)) AS href FROM pages)""")
def distinct_links(spark, t):
    """Different links of all pages."""
    return O.page_links(t.pages).filter(F.col("dst").rlike("^https?://")).select("dst").distinct()


ANCHORS = r"""a AS (SELECT page_id, m AS raw, pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS m, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), 1) AS pos FROM pages)),
links AS (SELECT page_id, pos, regexp_extract(raw, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(raw, '>([^<]*)</a>', 1), ' ') AS text FROM a)"""


def _anchors(t):
    pat = r'<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'
    a = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pat), F.lit(0))).alias("pos", "raw"))
    return a.select("page_id", (F.col("pos") + 1).alias("pos"), F.regexp_extract("raw", 'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("raw", ">([^<]*)</a>", 1)).alias("text"))


@query("DD10", f"WITH {ANCHORS} SELECT href, text FROM links WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY href ORDER BY length(text) DESC, page_id, pos) = 1")
def longest_anchors(spark, t):
    """Per link the longest text."""
    a = _anchors(t).withColumn("at", F.struct("page_id", "pos"))
    return O.longest_anchor(a, "href", "text", "at").select("href", "text")


@query("PF10 PF19", f"WITH {ANCHORS}, p AS (SELECT DISTINCT lower(href) AS path, lower(text) AS text FROM links) SELECT path, text, contains(path, 'product-groups/') OR ends_with(rtrim(path, '/'), '/all-products') OR starts_with(text, 'explore all') OR starts_with(text, 'the') AS category, contains(path, '/products/') OR contains(path, '/product-groups/') AS candidate FROM p WHERE path IN (SELECT lower('/' || n_name) FROM nation) OR starts_with(path, '/t')")
def link_predicates(spark, t):
    """Category and product tests of links."""
    p = _anchors(t).select(F.lower("href").alias("path"), F.lower("text").alias("text")).distinct()
    known = t.nation.select(F.lower(F.concat(F.lit("/"), "n_name")).alias("path"))
    kept = p.filter(F.col("path").startswith("/t")).union(p.filter(~F.col("path").startswith("/t")).join(F.broadcast(known), "path", "left_semi"))
    cat = F.contains("path", F.lit("product-groups/")) | F.regexp_replace("path", "/+$", "").endswith("/all-products") | F.col("text").startswith("explore all") | F.col("text").startswith("the")
    return kept.select("path", "text", cat.alias("category"), (F.contains("path", F.lit("/products/")) | F.contains("path", F.lit("/product-groups/"))).alias("candidate"))


@query("ST19", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \n\t\r]+', ' ', 'g'), ' ') AS text FROM pages""")
def html_text(spark, t):
    """Visible text by built-in expressions."""
    return t.pages.select("page_id", H.simple_text("html").alias("text"))


@query("ST19 SC13")
def html_visible(spark, t):
    """Title and visible text by a parser, 2000 characters."""
    return t.pages.select("page_id", F.length(H.html_text("html")).alias("n"))


@query("ST20 U4")
def html_main(spark, t):
    """Main content of pages."""
    return t.pages.select("page_id", F.length(H.html_main("html")).alias("n"))


@query("ST21 PF12 W8 DD5")
def html_sections(spark, t):
    """Sections with their heading paths."""
    s = t.pages.select("page_id", H.html_sections("html").alias("s")).filter(F.exists("s", lambda x: x["text"] != ""))
    return s.select("page_id", F.posexplode("s").alias("n", "x")).select("page_id", "n", F.array_join("x.path", " > ").alias("path"), F.length("x.text").alias("size"))


@query("ST23", "SELECT page_id, coalesce(nullif(trim(split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), '|', 1), ' '), ''), url) AS title, array_to_string(string_split(split_part(regexp_replace(url, '^https?://', ''), '?', 1), '/'), ' > ') AS crumbs FROM pages")
def titles_and_crumbs(spark, t):
    """Titles with a fallback, and breadcrumbs."""
    title = F.trim(F.substring_index(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "|", 1))
    bare = F.substring_index(F.regexp_replace("url", "^https?://", ""), "?", 1)
    return t.pages.select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.col("url")).alias("title"), F.array_join(F.split(bare, "/"), " > ").alias("crumbs"))


@query("ST24")
def best_title(spark, t):
    """The heading most like the title, the shorter of equals."""
    h = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.explode(F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))).alias("h"))
    s = h.withColumn("ratio", H.similarity("title", "h"))
    return s.groupBy("page_id").agg(F.max_by("h", F.struct("ratio", -F.length("h"))).alias("heading"))


@query("DD3", "WITH x AS (SELECT page_id, url, sha1(html) AS hash FROM pages) SELECT page_id, hash FROM x QUALIFY row_number() OVER (PARTITION BY hash ORDER BY page_id) = 1")
def pages_by_html(spark, t):
    """Pages with different HTML, the first of each."""
    return O.first_by_hash(t.pages, F.col("html"), [F.col("page_id")]).select("page_id", "hash")


@query("DD3 HA2")
def pages_by_content(spark, t):
    """Pages with different sections, the first of each: the fingerprint is the sha1 of all sections as JSON."""
    return O.first_by_hash(t.pages, F.to_json(H.html_sections("html")), [F.col("page_id")]).select("page_id", "hash")


EDGES = """e AS (SELECT DISTINCT l_suppkey % 200 AS src, l_partkey % 200 AS dst FROM lineitem)"""


def _edges(t):
    return t.lineitem.select((F.col("l_suppkey") % 200).alias("src"), (F.col("l_partkey") % 200).alias("dst")).distinct()


_BFS = f"""WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {{d}}),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node, depth FROM m"""


@query("DD11", _BFS.format(d=2))
def bfs_depth2(spark, t):
    """Nodes within two steps."""
    return O.breadth_first(_edges(t), spark.createDataFrame([(1,)], "node long"), 2)


@query("GR2", _BFS.format(d=2).replace("WHERE r.depth < 2)", "WHERE r.depth < 2 AND (r.depth = 0 OR r.node % 2 = 0))") + " ORDER BY depth, node LIMIT 200")
def bfs_rules(spark, t):
    """Two steps with a rule for each level (below the start only even nodes are expanded) and a budget of 200."""
    rule = lambda d: F.lit(True) if d == 0 else F.col("node") % 2 == 0
    return O.breadth_first(_edges(t), spark.createDataFrame([(1,)], "node long"), 2, budget=200, expand=rule)


@query("GR1", _BFS.format(d=2).replace("UNION SELECT e.dst, r.depth + 1", "UNION SELECT CASE WHEN e.dst % 17 = 5 THEN e.dst - 4 ELSE e.dst END, r.depth + 1") + " ORDER BY depth, node LIMIT 45")
def bfs_redirects(spark, t):
    """A crawl where some nodes redirect: what is seen and kept is where they lead."""
    nodes = _edges(t).select(F.col("dst").alias("node")).distinct().filter("node % 17 = 5")
    return O.breadth_first(_edges(t), spark.createDataFrame([(1,)], "node long"), 2, budget=45, redirects=nodes.withColumn("target", F.col("node") - 4))


@query("GR3", _BFS.format(d=3) + " ORDER BY depth, node LIMIT 15")
def bfs_budget(spark, t):
    """The first fifteen nodes of a crawl."""
    return O.breadth_first(_edges(t), spark.createDataFrame([(1,)], "node long"), 3, budget=15)


@query("W7", f"""WITH RECURSIVE {EDGES}, r AS (SELECT * FROM (VALUES (1::BIGINT, 0, 'a'), (2::BIGINT, 0, 'b')) v(node, depth, cat) UNION SELECT e.dst, r.depth + 1, r.cat FROM r JOIN e ON e.src = r.node WHERE r.depth < 1)
SELECT node, depth, min(cat) AS cat FROM r WHERE (node, depth) IN (SELECT (node, min(depth)) FROM r GROUP BY node) GROUP BY ALL""")
def inherited_category(spark, t):
    """Reached nodes carry their parent's category."""
    return O.breadth_first(_edges(t), spark.createDataFrame([(1, "a"), (2, "b")], "node long, cat string"), 1, carry="cat")


@query("PF8")
def robots(spark, t):
    """Pages that rules allow."""
    rules = t.pages.select(U.host("url").alias("host")).distinct().crossJoin(spark.createDataFrame([("/", True), ("/fr", False), ("/fr/8", True)], "prefix string, allow boolean"))
    return O.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


@query("SC15", "SELECT page_id, max_by(d, i) AS lastmod FROM (SELECT page_id % 40 AS page_id, page_id AS i, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS d FROM pages) GROUP BY page_id")
def sitemap_entries(spark, t):
    """A sitemap's entries; later ones replace earlier ones."""
    e = F.format_string("<url><loc>u%d</loc><lastmod>2024-01-%02dT10:00:00Z</lastmod></url>", (F.col("page_id") % 40), (F.col("page_id") % 28 + 1))
    x = t.pages.select("page_id", F.explode(tables.sitemap(F.concat(F.lit("<urlset>"), e, F.lit("</urlset>")))).alias("s"))
    return x.groupBy(F.substring("s.url", 2, 9).cast("long").alias("page_id")).agg(F.max_by("s.lastmod", "page_id").alias("lastmod"))


@query("SC16", """SELECT l_suppkey, (n - 1)::INT AS n, 'item ' || l_orderkey || '/' || l_linenumber AS title, 'http://s/' || l_partkey AS link FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 10""")
def feed_entries(spark, t):
    """The first ten entries of every feed, read from its XML; a supplier's orders are its feed."""
    item = F.format_string("<item><title><![CDATA[item %d/%d]]></title><link> http://s/%d </link></item>", "l_orderkey", "l_linenumber", "l_partkey")
    feeds = t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", item.alias("x")))).alias("x"))
    feeds = feeds.select("l_suppkey", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("x", lambda s: s["x"]), ""), F.lit("</channel></rss>")).alias("xml"))
    return tables.feed_entries(feeds, "l_suppkey", "xml")


@query("SC16", "SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 10")
def feed_heads(spark, t):
    """The first ten entries of every feed."""
    x = t.pages.select("page_id", U.host("url").alias("host"))
    return x.withColumn("n", F.row_number().over(W.partitionBy("host").orderBy("page_id"))).filter("n <= 10").select("page_id", "host")


@query("SC17", "SELECT page_id, url AS title FROM pages WHERE page_id % 3 <> 0")
def feed_titles(spark, t):
    """Titles of feed items that have one."""
    item = F.concat(F.lit("<rss><item><title> "), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")), F.lit(" </title><x/></item></rss>"))
    return t.pages.select("page_id", F.explode(tables.feed_titles(item)).alias("title"))
