"""Extraction jobs over the pages, and over payloads built from documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.functions import urls
from clipworks.operators import extract
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.plans.tag_queries import PARAS, para_text
from clipworks.sources import bind
from clipworks.sources.tables import load_table


def page_text(x: str) -> str:
    return para_text(f"regexp_replace({x}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')")


PG = f"pg AS ({bind.PAGES})"


@query("ex1_html_to_text", f"WITH {PG} SELECT page_id, {page_text('html')} AS text FROM pg")
def html_to_text(spark, d):
    return extract.html_to_text(bind.pages(spark, d)).select("page_id", "text")


PARAS20 = PARAS.replace("length(p) >= 40", "length(p) >= 20").replace("paras AS (SELECT page_id,", "p20 AS (SELECT page_id, html,")


BODIES = f"""{PARAS20}, bodies AS (SELECT page_id, html, CASE WHEN len(ps) > 0 THEN array_to_string(list_reduce(list_prepend([], list_transform(ps, lambda p: [p])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ' ') ELSE {page_text('html')} END AS body FROM p20)"""


@query("ex2_body", f"WITH {BODIES} SELECT page_id, body FROM bodies")
def body(spark, d):
    return extract.extract_body(bind.pages(spark, d)).select("page_id", "body")


@query("ex3_paragraphs", f"WITH {PARAS}, u AS (SELECT page_id, list_reduce(list_prepend([], list_transform(ps, lambda p: [p])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS ps FROM paras) SELECT page_id, generate_subscripts(ps, 1) - 1 AS position, unnest(ps) AS text FROM u")
def paragraphs(spark, d):
    return extract.paragraphs(bind.pages(spark, d))


DATE_META = "CASE page_id % 5 WHEN 0 THEN printf('2024-%02d-%02d 10:30', page_id % 12 + 1, page_id % 28 + 1) WHEN 1 THEN printf('%02d/%02d/2024', page_id % 28 + 1, page_id % 12 + 1) ELSE '' END"


@query("ex4_meta", f"SELECT page_id, {DATE_META} AS published, CASE WHEN page_id % 4 = 0 THEN 'Lead & line ' || page_id || ' - Site' ELSE '' END AS og_title FROM pages")
def meta(spark, d):
    from clipworks import config
    pages = extract.extract_meta(bind.pages(spark, d), config.DATE_METAS, "published")
    return extract.extract_meta(pages, ["og:title"], "og_title").select("page_id", "published", "og_title")


HEADING = para_text("regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)")
TITLE = f"CASE WHEN page_id % 4 = 0 THEN 'Lead & line ' || page_id ELSE {k.title(HEADING)} END"


@query("ex5_title", f"WITH {PG} SELECT page_id, {TITLE} AS title FROM pg")
def title(spark, d):
    return extract.extract_title(bind.pages(spark, d)).select("page_id", "title")


DATED = """CASE page_id % 5 WHEN 0 THEN printf('2024-%02d-%02d 10:30:00', page_id % 12 + 1, page_id % 28 + 1) WHEN 1 THEN printf('2024-%02d-%02d 00:00:00', page_id % 12 + 1, page_id % 28 + 1)
 WHEN 2 THEN printf('2024-%02d-%02d 08:05:00', page_id % 12 + 1, page_id % 28 + 1) WHEN 3 THEN printf('2024-03-%02d 09:15:00', page_id % 28 + 1) END"""


@query("ex6_published_at", f"SELECT page_id, {DATED} AS published_at FROM pages")
def published_at(spark, d):
    out = extract.extract_published_at(bind.pages(spark, d))
    return out.select("page_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


LEAD = "'Café 中文 & <b> item ' || page_id || ' of the constructed lead text, eren.'"


# The pages are well formed, so what each selector finds can be cut out plainly. A chosen element without a date leaves none.
CUT = lambda pattern: para_text(f"regexp_extract(html, '(?is){pattern}', 1)")
CHOSEN = f"""CASE page_id % 7 WHEN 0 THEN {CUT('<div class="ad">(.*?)</div>')} WHEN 1 THEN {CUT('<article><h1>(.*?)</h1>')} WHEN 2 THEN {CUT('<nav><ul><li><a[^>]*>(.*?)</a>')}
 WHEN 3 THEN {CUT('<footer>(.*?)</footer>')} WHEN 5 THEN {CUT('<div class="ad">(.*?)</div>')} ELSE '' END"""
RULED_TITLE = f"CASE WHEN ({CHOSEN}) <> '' THEN {k.title(f'({CHOSEN})')} ELSE {TITLE} END"


@query("ex7_source_rules", f"""WITH {BODIES} SELECT page_id, {RULED_TITLE} AS title, {DATED} AS published_at, {LEAD} AS summary, CASE WHEN page_id % 7 % 2 = 1 THEN 'fr' ELSE 'en' END AS language,
 'p' || (page_id % 7) AS code, 'https://www.p' || (page_id % 7) || '.example.com/news/' || page_id || '.html' AS asked, body = p_body AS same_body FROM (SELECT *, body AS p_body FROM bodies) WHERE page_id % 5 <> 4 AND NOT (page_id % 7 = 1 AND page_id % 5 = 2) AND {RULED_TITLE} <> ''""")
def source_rules(spark, d):
    n = F.col("page_id")
    own = F.concat(F.lit("https://www.p"), (n % 7).cast("string"), F.lit(".example.com/news/"), n, F.lit(".html"))
    pages = bind.pages(spark, d).withColumns({"source_id": n % 7, "url": own})
    out = extract.source_candidates(pages, bind.selecting_sources(spark), bind.REQUIRED)
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    return out.select("page_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "summary", "language", said("source").alias("code"),
                      said("requestedUrl").alias("asked"), (said("bodyText") == F.col("body")).alias("same_body"))


@query("ex7_candidates", f"WITH {PG} SELECT page_id, {TITLE} AS title, {DATED} AS published_at, {LEAD} AS summary FROM pg WHERE page_id % 5 <> 4 AND {TITLE} <> ''")
def candidates(spark, d):
    out = extract.pages_to_candidates(bind.pages(spark, d), bind.REQUIRED)
    return out.select("page_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "summary")


EXTRA = '\'<a href="?q=\' || page_id || \'">query</a> <a href="x\' || page_id || \'.html">rel</a> <a href="#f">f</a> <a href="mailto:a@b.c">m</a> <a href="//cdn.example.net/2024/\' || page_id || \'.html"> far &amp; off </a>\''
LINKS = f"""hp AS (SELECT page_id, url, html || {EXTRA} AS html FROM pages),
raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS h, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS t,
  unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']+)["''][^>]*>(.*?)</a>')))) AS pos FROM hp),
lk AS (SELECT page_id, url, pos, {para_text('t')} AS text, CASE WHEN h LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || h WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]+') || h
   WHEN h LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || h ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || h END AS href
  FROM raw WHERE NOT regexp_matches(h, '^(mailto:|#|javascript:|tel:)')),
links AS (SELECT page_id, url AS page_url, href, arg_min(text, pos) AS text, min(pos) AS pos FROM lk WHERE length(text) >= 3 GROUP BY 1, 2, 3)"""


def links_of(spark, d):
    n = F.col("page_id")
    extra = F.concat(F.lit('<a href="?q='), n, F.lit('">query</a> <a href="x'), n, F.lit('.html">rel</a> <a href="#f">f</a> <a href="mailto:a@b.c">m</a> <a href="//cdn.example.net/2024/'), n, F.lit('.html"> far &amp; off </a>'))
    pages = load_table(spark, d, "pages").withColumn("html", F.concat("html", extra))
    return extract.extract_links(pages, 3)


@query("ex8_links", f"WITH {LINKS} SELECT page_id, href, text FROM links")
def links(spark, d):
    return links_of(spark, d).select("page_id", "href", "text")


@query("ex9_rank_links", f"""WITH {LINKS}, s AS (SELECT *, lower(href || ' ' || text) AS l FROM links),
c AS (SELECT *, CASE WHEN regexp_matches(l, 'nicht') THEN -100 ELSE CASE WHEN regexp_extract(href, '^[a-z]+://[^/]+') = regexp_extract(page_url, '^[a-z]+://[^/?#]+') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(href, '(?i)[/_-](20[0-9]{{2}}|[0-9]{{6,}})|\\.s?html$') THEN 6 ELSE 0 END - CASE WHEN regexp_matches(l, 'index|list|#') THEN 4 ELSE 0 END + CASE WHEN contains(l, 'the') THEN 4 ELSE 0 END END AS score FROM s)
SELECT page_id, href, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM c WHERE score > 0) WHERE rank <= 4""")
def rank_links(spark, d):
    rows = links_of(spark, d).withColumns({"link_deny_patterns": F.array(F.lit("nicht")), "whitelist": F.array(F.lit("The"))})
    return extract.rank_links(rows, 4).select("page_id", "href", "score", "rank")


@query("ex10_rank_candidates", k.with_current(f"""SELECT id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, published_at DESC, url) AS rank FROM (
 SELECT id, source, published_at, url, CASE WHEN {k.any_of('t', bind.REQUIRED)} THEN 80 ELSE 0 END + CASE WHEN {k.any_of('lower(t)', [x.lower() for x in bind.DOMAIN])} THEN 40 ELSE 0 END
  + CASE WHEN published_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-09-01' THEN 30 ELSE 0 END - CASE WHEN {k.any_of('t', bind.LOW)} AND {k.count_of('t', bind.REQUIRED)} < 2 THEN 60 ELSE 0 END - CASE WHEN length(title) < 6 THEN 80 ELSE 0 END AS score
 FROM (SELECT *, title || ' ' || summary || ' ' || url AS t FROM cur))) WHERE rank <= 10"""))
def rank_candidates(spark, d):
    out = extract.rank_candidates(bind.current(spark, d), 10, bind.REQUIRED, bind.DOMAIN, bind.LOW, "2024-03-01", "2024-09-01")
    return out.select("id", "score", "rank")


@query("ex11_feed", f"""SELECT doc_id AS feed_id, {k.clean("t")} AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://' || source || '.example.com/news/' || doc_id || '.html' ELSE 'https://' || source || '.example.com/e/' || doc_id END AS link,
 printf('2024-02-%02d 10:00:00', doc_id % 28 + 1) AS published_at, {k.clean('t')} AS content, lang || '|' || source AS categories FROM (SELECT *, regexp_replace(text, '[<>&]', ' ', 'g') AS t FROM documents)""")
def feed(spark, d):
    n = F.col("doc_id")
    t = F.regexp_replace("text", "[<>&]", " ")
    site = F.concat(F.lit("https://"), "source", F.lit(".example.com"))
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    cats = F.concat(F.lit("<category>"), "lang", F.lit("</category><category>"), "source", F.lit("</category>"))
    rss = F.concat(F.lit("<rss><channel><title>c</title><item><title><![CDATA["), t, F.lit("]]></title><link>/news/"), n, F.lit(".html</link><pubDate>Mon, "), day,
                   F.lit(" Feb 2024 10:00:00 GMT</pubDate><description>"), t, F.lit("</description>"), cats, F.lit("</item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), t, F.lit("</title><link rel='alternate' href='"), site, F.lit("/e/"), n, F.lit("'/><updated>2024-02-"), day,
                    F.lit("T10:00:00Z</updated><content type='html'>"), t, F.lit("</content>"), cats, F.lit("</entry></feed>"))
    payloads = load_table(spark, d, "documents").select(n.alias("feed_id"), F.concat(site, F.lit("/feed.xml")).alias("url"), F.when(n % 2 == 0, rss).otherwise(atom).alias("payload"))
    out = extract.explode_feed(payloads)
    return out.select("feed_id", "title", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "content", F.concat_ws("|", "categories").alias("categories"))


@query("ex12_posts", f"""WITH t AS (SELECT *, regexp_replace(text, '[<>&]', ' ', 'g') AS t FROM documents), u AS (SELECT *, {k.clean("t || '.'")} AS long FROM t)
SELECT doc_id AS feed_id, CASE WHEN doc_id % 9 <> 8 THEN {k.clean("'T ' || doc_id || ' & co'")} END AS title, CASE WHEN doc_id % 9 <> 8 THEN CASE WHEN length(long) >= 20 THEN long ELSE trim(long || ' short') END END AS body,
 CASE WHEN doc_id % 9 <> 8 THEN CASE WHEN doc_id % 3 = 2 THEN 'ex ' || doc_id ELSE '' END END AS excerpt,
 CASE WHEN doc_id % 9 = 8 THEN 'malformed' WHEN doc_id % 10 = 0 THEN 'missing_date' WHEN doc_id % 28 + 1 < 5 THEN 'out_of_window' WHEN doc_id % 10 = 1 THEN 'non_detail' ELSE 'kept' END AS outcome FROM u""")
def posts(spark, d):
    """Three shapes of posts (rendered fields, plain fields, an excerpt and a number as date_gmt), and answers that are no array."""
    n = F.col("doc_id")
    t = F.concat(F.regexp_replace("text", "[<>&]", " "), F.lit("."))
    day = F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("2024-02-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00")))
    link = F.when(n % 10 == 1, "https://a.example.com/list").otherwise(F.concat(F.lit("https://a.example.com/news/"), n))
    title, content = F.concat(F.lit("<b>T</b> "), n, F.lit(" &amp; co")), F.concat(F.lit("<p>"), t, F.lit("</p><p>short</p>"))
    one = lambda *fields: F.to_json(F.array(F.struct(*fields)))
    rendered = one(day.alias("date"), F.lit("").alias("date_gmt"), link.alias("link"), F.struct(title.alias("rendered")).alias("title"), F.struct(content.alias("rendered")).alias("content"))
    plain = one(day.alias("date"), link.alias("link"), title.alias("title"), content.alias("content"), F.lit(7).alias("extra"))
    mixed = one(n.alias("date_gmt"), day.alias("date"), link.alias("link"), title.alias("title"), F.struct(content.alias("rendered"), F.lit(True).alias("protected")).alias("content"),
                F.struct(F.concat(F.lit("<p>ex "), n, F.lit("</p>")).alias("rendered")).alias("excerpt"))
    broken = F.when(n % 2 == 0, F.lit('{"code":"no_posts"}')).otherwise(F.lit("<html>not found"))
    payload = F.when(n % 9 == 8, broken).when(n % 3 == 0, rendered).when(n % 3 == 1, plain).otherwise(mixed)
    payloads = load_table(spark, d, "documents").select(n.alias("feed_id"), payload.alias("payload"))
    return extract.explode_posts(payloads, "2024-02-05", "2024-12-31", required=bind.REQUIRED).select("feed_id", "title", "body", "excerpt", "outcome")


@query("ex13_sitemap", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS site FROM pages),
l AS (SELECT site || '/news/' || (page_id % 50) || '.html' AS loc, FALSE AS is_index, page_id FROM p UNION ALL SELECT site || '/sitemap-' || (page_id % 3) || '.xml', TRUE, page_id FROM p WHERE page_id % 2 = 0)
SELECT loc, is_index, printf('2024-05-%02d 00:00:00', min(page_id) % 28 + 1) AS published_at FROM l WHERE NOT contains(loc, 'spam') GROUP BY 1, 2""")
def sitemap(spark, d):
    n = F.col("page_id")
    site = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    mod = F.concat(F.lit("<lastmod>2024-05-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))
    one = F.concat(F.lit("<urlset><url><loc> "), site, F.lit("/news/"), n % 50, F.lit(".html</loc>"), mod, F.lit("</url><url><loc>"), site, F.lit("/list</loc></url><url><loc>https://else.where/news/1.html</loc></url></urlset>"))
    index = F.when(n % 2 == 0, F.concat(F.lit("<sitemap><loc>"), site, F.lit("/sitemap-"), n % 3, F.lit(".xml</loc>"), mod, F.lit("</sitemap>"))).otherwise("")
    payloads = load_table(spark, d, "pages").select(n.alias("feed_id"), site.alias("site_url"), F.concat(one, index).alias("payload"))
    out = extract.explode_sitemap(payloads, deny=["spam"])
    return out.select("loc", "is_index", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("ex14_seed_urls", """WITH s AS (SELECT s_suppkey, 'https://s' || s_suppkey || '.test' AS site FROM supplier), r AS (SELECT unnest([1, 2, 3]) AS n)
SELECT s_suppkey, site || '/list_' || n || '.html' AS url FROM s, r WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, site || '/p/' || n FROM s, r WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, site || '/in' FROM s WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, site FROM s WHERE s_suppkey % 3 = 2 UNION ALL SELECT s_suppkey, site || '/feed' FROM s WHERE s_suppkey % 2 = 0""")
def seed_urls(spark, d):
    s = F.col("s_suppkey")
    site = F.concat(F.lit("https://s"), s, F.lit(".test"))
    rows = load_table(spark, d, "supplier").select(
        "s_suppkey", site.alias("site_url"), F.when(s % 3 == 0, F.array(F.concat(site, F.lit("/list_{page}.html")), F.concat(site, F.lit("/p/%d")))).alias("templates"),
        F.when(s % 3 == 1, F.array(F.concat(site, F.lit("/in")), F.concat(site, F.lit("/in")))).alias("entry_urls"), F.when(s % 2 == 0, F.array(F.concat(site, F.lit("/feed")))).alias("feed_urls"))
    return extract.expand_seed_urls(rows, 3, "s_suppkey").select("s_suppkey", "url")


RULES = """r AS (SELECT s_suppkey AS s, 'https://s' || s_suppkey || '.test' AS site FROM supplier),
m AS (SELECT *, s % 8 AS k, CASE s % 8 WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'html' WHEN 3 THEN 'feed' WHEN 4 THEN 'api' WHEN 5 THEN 'sitemap' WHEN 6 THEN 'feed' ELSE 'html' END AS mode FROM r)"""


def ruled_sources(spark, d):
    """Suppliers with rules of all kinds; one kind is broken."""
    s = F.col("s_suppkey")
    site = F.concat(F.lit("https://s"), s, F.lit(".test"))
    rules = ['{"parser":"html-list","maxPages":4,"paginationTemplates":[{"template":"@/a/{page}","start":2,"end":9},"@/b/%d",{"template":" "}]}', '{"paginationTemplate":"@/c{page}.html","maxPages":2}',
             '{"entryUrl":"@/in","fallbackEntryUrls":["@/in","@/more",""]}', '{"parser":"rss","feedUrls":["@/f1","@/f2","@/f1"]}', '{"mode":"api","apiUrl":"@/api?x=1&page=7","maxPages":3}',
             '{"parser":"sitemap"}', '{"parser":"atom","entryUrl":"@/atom"}', '{"parser": broken']
    rule = F.get(F.array(*[F.lit(r) for r in rules]), (s % 8).cast("int"))
    return load_table(spark, d, "supplier").select("s_suppkey", F.concat(site, F.lit("/")).alias("site_url"), F.replace(rule, F.lit("@"), site).alias("crawl_rule"))


@query("ex14_rule_seeds", f"""WITH {RULES}, u AS (SELECT s, mode, unnest(CASE k WHEN 0 THEN [site || '/a/2', site || '/a/3', site || '/a/4', site || '/b/1', site || '/b/2', site || '/b/3', site || '/b/4'] WHEN 1 THEN [site || '/c1.html', site || '/c2.html']
  WHEN 2 THEN [site || '/in', site || '/more'] WHEN 3 THEN [site || '/f1', site || '/f2'] WHEN 4 THEN [site || '/api?x=1&page=1', site || '/api?x=1&page=2', site || '/api?x=1&page=3'] WHEN 5 THEN [site || '/sitemap.xml', site || '/sitemap_index.xml']
  WHEN 6 THEN [site || '/atom'] ELSE [site || '/'] END) AS url FROM m) SELECT s AS s_suppkey, mode, url FROM u""")
def rule_seeds(spark, d):
    return extract.rule_seed_urls(ruled_sources(spark, d), key="s_suppkey").select("s_suppkey", "mode", "url")


@query("ex15_rule_modes", f"WITH {RULES} SELECT s AS s_suppkey, mode, CASE WHEN k IN (0, 1, 3, 4, 5) THEN 'best_effort' ELSE 'partial' END AS coverage FROM m")
def rule_modes(spark, d):
    return extract.rule_modes(ruled_sources(spark, d)).select("s_suppkey", "mode", "coverage")


OUTCOME = "CASE WHEN page_id % 5 = 4 THEN 'missing_date' WHEN d < TIMESTAMP '2024-03-01' OR d > TIMESTAMP '2024-10-01 00:01:00' THEN 'out_of_window' WHEN page_id % 3 = 0 THEN 'non_detail' ELSE 'kept' END"


@query("ex15_extraction_stats", f"""WITH p AS (SELECT page_id, {k.host('url')} AS source, CAST({DATED} AS TIMESTAMP) AS d FROM pages), o AS (SELECT *, {OUTCOME} AS o FROM p)
SELECT source, count(*) AS fetched, count(*) FILTER (o = 'missing_date') AS missing_date, count(*) FILTER (o = 'out_of_window') AS out_of_window, count(*) FILTER (o = 'non_detail') AS non_detail, count(*) FILTER (o = 'kept') AS kept,
 {k.stamp("min(d) FILTER (o = 'kept')")} AS earliest, {k.stamp("max(d) FILTER (o = 'kept')")} AS latest, CASE WHEN count(*) FILTER (o = 'kept') = 0 THEN 'partial' ELSE 'best_effort' END AS coverage FROM o GROUP BY 1""")
def extraction_stats(spark, d):
    n = F.col("page_id")
    rows = extract.extract_published_at(bind.pages(spark, d)).select(
        urls.host("url").alias("source"), "published_at", F.when(n % 3 == 0, "https://a.test/list").otherwise("https://a.test/news/1").alias("url"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return extract.extraction_stats(rows, "2024-03-01", "2024-10-01").withColumns({"earliest": fmt("earliest"), "latest": fmt("latest")})


@query("ex16_limit_per_source", k.with_articles("SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS rank FROM articles) WHERE rank <= 6"))
def limit_per_source(spark, d):
    return extract.limit_per_source(bind.articles(spark, d).select("id", "source", "published_at"), 6).select("id", "rank")


_PS = "list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda p: " + para_text("p") + "), lambda p: length(p) >= 20)"


@query("ex17_source_yield", f"""WITH r AS (SELECT page_id, url, html, {k.host('url')} AS host, row_number() OVER (PARTITION BY {k.host('url')} ORDER BY page_id) AS rn FROM pages),
b AS (SELECT page_id, url, host, CASE WHEN len({_PS}) > 0 THEN array_to_string({_PS}, ' ') ELSE {page_text('html')} END AS body FROM r WHERE rn <= 5),
c AS (SELECT *, {k.any_of('body', bind.REQUIRED)} AS good FROM b)
SELECT host, count(*) AS checked, count(*) FILTER (good) AS good, arg_min(url, page_id) FILTER (good) AS sample_url FROM c GROUP BY 1""")
def source_yield(spark, d):
    pages = load_table(spark, d, "pages").withColumn("host", urls.host("url"))
    return extract.source_yield(pages, bind.REQUIRED, 5)
