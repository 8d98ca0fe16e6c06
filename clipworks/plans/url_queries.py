"""URL jobs over the pages and the constructed article URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.operators import urlset as ops
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table

# URLs with known answers (detail pages, then lists), added to the pages in query and oracle alike.
KNOWN = [
    ("https://www.cagis.org.cn/Lists/content/id/4687.html", True),
    ("https://www.usgs.gov/centers/eros/news/example-story", True),
    ("https://www.geographyrealm.com/landsat-ndvi-vegetation-change", True),
    ("https://www.huace.cn/informationDetail/465", True),
    ("https://www.southsurvey.com/news_view/id/488.html", True),
    ("https://www.bdstar.com/news.aspx?type=17&&id=4884", True),
    ("https://www.mapgis.com/index.php?a=shows&catid=33&id=1874", True),
    ("https://www.glac.org.cn/a9837.html", True),
    ("https://ngcc.cn/xwzx/ywcg/202601/t20260113_2599.html", True),
    ("https://www.csgpc.org/list/93.html", False),
    ("https://www.cagis.org.cn/Lists/index/cid/93.html", False),
    ("https://www.supermap.com/zh-cn/a/news/list_9_1.html", False),
    ("https://example.test/news", False),
]


def _variants(spark, d):
    """Page URLs, each also with a fragment and a trailing slash on a third of the rows."""
    n = F.col("page_id") % 3
    shaped = F.when(n == 0, F.concat("url", F.lit("#x"))).when(n == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("/"))).otherwise(F.col("url"))
    return load_table(spark, d, "pages").select("page_id", shaped.alias("url"))


VARIANTS = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '#x' WHEN 1 THEN regexp_replace(url, '#.*$', '') || '/' ELSE url END AS url FROM pages"""


@query("ur1_canonical_url", f"SELECT page_id, {k.canonical('url')} AS canonical_url FROM ({VARIANTS})")
def canonical_url(spark, d):
    return ops.canonical_urls(_variants(spark, d)).select("page_id", "canonical_url")


@query("ur1_url_duplicates", f"""
SELECT canonical_url, count(*) AS n FROM (SELECT {k.canonical('url')} AS canonical_url FROM ({VARIANTS} UNION ALL SELECT page_id, url FROM pages))
GROUP BY 1 HAVING count(*) > 1""")
def url_duplicates(spark, d):
    both = _variants(spark, d).unionByName(load_table(spark, d, "pages").select("page_id", "url"))
    return ops.url_duplicates(ops.canonical_urls(both))


@query("ur2_host", f"SELECT page_id, {k.host('url')} AS host FROM pages")
def host(spark, d):
    return ops.add_host(load_table(spark, d, "pages")).select("page_id", "host")


PATH = f"regexp_replace(lower({k.path('url')}), '/+$', '')"
DETAIL = f"""CASE WHEN {PATH} = '' THEN FALSE
  WHEN regexp_matches({PATH}, '/(news|dt|list|index)$|/(index|list)([_-][0-9]+)*\\.s?html?$') THEN FALSE
  WHEN regexp_matches({PATH}, '/(content|detail|info|article|blog-article|announcement|post|story|blog|press|press_releases|press-releases|event|events|id|art|news)/') THEN TRUE
  WHEN regexp_matches({PATH}, '/([a-z][0-9]{{4,}}|t[0-9]+(_[0-9]+)?)\\.s?html?$') THEN TRUE
  WHEN regexp_matches({PATH}, '/[0-9]{{5,}}\\.s?html?$') THEN NOT contains({PATH}, '/list/')
  WHEN NOT regexp_matches({PATH}, '/(category|tag|author|topic|page)/') AND regexp_matches({PATH}, '/[^/.]{{12,}}$')
       AND (regexp_matches({PATH}, '-[^/]*-[^/]*$') OR (regexp_matches({PATH}, '_[^/]*_[^/]*$') AND regexp_matches({PATH}, '^/[^/]+/'))) THEN TRUE
  ELSE regexp_matches({PATH}, '(20[0-9]{{2}}|[0-9]{{6,}}).*\\.s?html?$') AND NOT regexp_matches({PATH}, '/(category|tag|special)/') END"""
KNOWN_SQL = " UNION ALL ".join(f"SELECT {k.q(u)} AS url, {str(v).upper()} AS is_detail" for u, v in KNOWN)


@query("ur3_detail_url", f"""
WITH shaped AS (SELECT CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/news/' || page_id || '.html'
   WHEN 2 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/topic-' || page_id || '-long-name' ELSE regexp_extract(url, '^[a-z]+://[^/]+') || '/a/list_' || page_id || '.html' END AS url FROM pages)
SELECT url, {DETAIL} AS is_detail FROM shaped UNION ALL {KNOWN_SQL}""")
def detail_url(spark, d):
    n = F.col("page_id")
    site = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    shaped = (
        F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(site, F.lit("/news/"), n, F.lit(".html")))
        .when(n % 4 == 2, F.concat(site, F.lit("/topic-"), n, F.lit("-long-name"))).otherwise(F.concat(site, F.lit("/a/list_"), n, F.lit(".html")))
    )
    known = spark.createDataFrame([(u,) for u, _ in KNOWN], "url STRING")
    return ops.flag_detail_urls(load_table(spark, d, "pages").select(shaped.alias("url")).unionByName(known))


@query("ur4_list_urls", f"""
WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '/[a-z]{{2}}/', '/list/') ELSE url || '/index.html' END AS url FROM pages)
SELECT page_id, regexp_matches(regexp_replace({k.path('url')}, '/+$', ''), '(?i)/list([_/-]|$)') AS is_list,
       regexp_matches(url, '(?i)#$|/index(\\.s?html)?$|/list[_-]') AS is_noise, {k.host('url')} = 'spam-farm.example.org' AS is_blocked FROM t""")
def list_urls(spark, d):
    n = F.col("page_id") % 3
    shaped = F.when(n == 0, F.col("url")).when(n == 1, F.regexp_replace("url", "/[a-z]{2}/", "/list/")).otherwise(F.concat("url", F.lit("/index.html")))
    pages = load_table(spark, d, "pages").select("page_id", shaped.alias("url"))
    return ops.flag_list_urls(pages, blocked_hosts=["spam-farm.example.org"]).drop("url")


DOMAIN_OK = f"""({k.host('a.url')} = {k.host('s.site_url')} OR ends_with({k.host('a.url')}, '.' || {k.host('s.site_url')})
  OR (s.allowed_host <> '' AND {k.host('a.url')} = s.allowed_host)
  OR (s.allowed_pattern <> '' AND regexp_matches({k.host('a.url')}, s.allowed_pattern)))"""


@query("ur5_source_domain", k.with_model(f"SELECT a.id, {DOMAIN_OK} AS domain_ok FROM articles a JOIN sources s ON a.source = s.source_code"))
def source_domain(spark, d):
    return ops.check_source_domain(bind.articles(spark, d), bind.sources(spark, d)).select("id", "domain_ok")


def _targets(spark, d):
    site = F.col("site_url")
    n = F.col("source_id")
    return bind.sources(spark, d).withColumn("targets", F.array(
        F.concat(site, F.lit("news/list_1.html")), F.concat(site, F.lit("a/b/c"), n), F.when(n % 4 == 0, F.concat(site, F.lit("detail/12.html"))), site))


TARGETS = """SELECT source_code, site_url, CASE WHEN source_id % 4 = 0 THEN site_url || 'detail/12.html' ELSE site_url || 'a/b/c' || source_id END AS target,
   CASE WHEN source_id % 4 = 0 THEN 14 ELSE 5 END AS score FROM sources"""


@query("ur6_best_source_target", k.with_model(TARGETS))
def best_source_target(spark, d):
    return ops.best_source_target(_targets(spark, d))


@query("ur6_resolve_article_url", k.with_model(f"""
SELECT a.id, CASE WHEN a.id % 10 <> 0 THEN a.url ELSE t.target END AS resolved_url FROM articles a JOIN ({TARGETS}) t ON a.source = t.source_code"""))
def resolve_article_url(spark, d):
    targets = ops.best_source_target(_targets(spark, d))
    return ops.resolve_article_url(bind.articles(spark, d), targets).select("id", "resolved_url")


@query("ur7_access_urls", k.with_articles("""
SELECT id, url AS primary_url, CASE WHEN id % 10 = 1 OR id % 4 = 0 THEN 'https://web.archive.org/web/' || url ELSE 'https://www.' || source || '.example.com/' END AS backup_url,
       id % 10 = 1 OR id % 4 = 0 AS used_mirror FROM articles"""))
def access_urls(spark, d):
    site = F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("https://www."), "source", F.lit(".example.com/")))
    arts = bind.articles(spark, d).withColumn("source_url", site)
    return ops.access_urls(arts, mirror_hosts=["outside.example.org"]).select("id", "primary_url", "backup_url", "used_mirror")
