"""Views of the driver tables in the shape of the model.

Only names and constructed values are added here; the operators stay generic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipworks.sources.tables import load_table

# Latin terms for the invented prose of the driver's documents.
REQUIRED = ["eren", "thing", "ouan", "pour", "nicht", "para"]
CORE = ["ther", "thon", "erin", "anea", "eren", "thing", "pour", "avec", "nicht", "auch", "para", "los", "on the"]
LOW = ["thwh", "erwh", "onwh"]
DOMAIN = ["Ther", "thon", "erin", "anea", "onre", "pour", "avec", "nicht", "auch", "para", "los", "thedou"]
REGIONS = ["anan", "onon", "rere", "heat", "leau", "lich", "dad"]
CATEGORIES = {
    "enterprise": ["eron", "anou", "eaux", "lich", "osos"],
    "policy": ["erst", "hean", "tre", "keit", "ción"],
    "technology": ["thes", "reor", "elle", "eich", "mente"],
}
ENTITIES = [
    ("entity-0", "thanea", ["thanedble", "reanea"]),
    ("entity-1", "erinthe", ["onhean"]),
    ("entity-2", "eauxle", ["pation", "oireau"]),
    ("entity-3", "sichge", ["lichen"]),
    ("entity-4", "osdad", ["ciónde"]),
    ("entity-5", "zz no such name", []),
]


def articles(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as article candidates: first line as title, constructed date and URL. ``only`` (id) restricts the rows read on."""
    n = F.col("doc_id")
    own = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
    url = (
        F.when(n % 10 == 0, F.concat(own, F.lit("/list/"), n, F.lit("/")))
        .when(n % 10 == 1, F.concat(F.lit("https://outside.example.org/news/"), n))
        .when(n % 10 == 2, F.concat(F.lit("https://www.news.example.com/news/"), n - n % 40, F.lit(".html#top")))
        .otherwise(F.concat(own, F.lit("/news/"), n, F.lit(".html")))
    )
    docs = load_table(spark, folder, "documents")
    if only is not None:
        docs = docs.join(only.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return docs.select(
        n.alias("id"),
        "source",
        F.col("lang").alias("language"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((n % 365).cast("int"))).alias("published_at"),
        url.alias("url"),
    )


ARTICLES = """
SELECT doc_id AS id, source, lang AS language, split_part(text, chr(10), 1) AS title, text AS body,
       TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS published_at,
       CASE WHEN doc_id % 10 = 0 THEN 'https://' || source || '.example.com/list/' || doc_id || '/'
            WHEN doc_id % 10 = 1 THEN 'https://outside.example.org/news/' || doc_id
            WHEN doc_id % 10 = 2 THEN 'https://www.news.example.com/news/' || (doc_id - doc_id % 40) || '.html#top'
            ELSE 'https://' || source || '.example.com/news/' || doc_id || '.html' END AS url
FROM documents
"""


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Publishers derived from the documents, with constructed flags and rules."""
    names = load_table(spark, folder, "documents").select("source").distinct()
    n = F.substring("source", 4, 10).cast("bigint")
    empty = F.array().cast("array<string>")
    return names.select(
        n.alias("source_id"),
        F.col("source").alias("source_code"),
        F.col("source").alias("name"),
        F.when(n % 3 == 0, "government").when(n % 3 == 1, "enterprise").otherwise("university").alias("type"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/")).alias("site_url"),
        F.when(n % 2 == 0, "en").otherwise("fr").alias("language"),
        F.when(n % 7 == 6, "").otherwise(F.concat(F.lit("entity-"), (n % 6).cast("string"))).alias("whitelist_entity_id"),
        (n % 10 != 9).alias("active"),
        F.array(F.lit("thble"), F.concat(F.lit("er"), n.cast("string"))).alias("whitelist"),
        F.when(n % 2 == 0, F.array(F.lit("www.news.example.com"))).otherwise(empty).alias("allowed_hosts"),
        F.when(n % 5 == 0, F.array(F.lit(r"^outside\."))).otherwise(empty).alias("allowed_host_patterns"),
    )


SOURCES = """
SELECT n AS source_id, source AS source_code, source AS name,
       CASE n % 3 WHEN 0 THEN 'government' WHEN 1 THEN 'enterprise' ELSE 'university' END AS type,
       'https://www.' || source || '.example.com/' AS site_url,
       CASE WHEN n % 2 = 0 THEN 'en' ELSE 'fr' END AS language,
       CASE WHEN n % 7 = 6 THEN '' ELSE 'entity-' || (n % 6) END AS whitelist_entity_id,
       n % 10 <> 9 AS active,
       ['thble', 'er' || n] AS whitelist,
       CASE WHEN n % 2 = 0 THEN 'news.example.com' ELSE '' END AS allowed_host,
       CASE WHEN n % 5 = 0 THEN '^outside\\.' ELSE '' END AS allowed_pattern
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS n FROM documents)
"""


def entities(spark: SparkSession) -> DataFrame:
    """The whitelist as a small table."""
    rows = [(i, name, aliases) for i, name, aliases in ENTITIES]
    return spark.createDataFrame(rows, "entity_id STRING, name STRING, aliases ARRAY<STRING>")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages, with the meta tags, dates and entities that the driver's pages lack put in front."""
    n = F.col("page_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    month = F.lpad((n % 12 + 1).cast("string"), 2, "0")
    dated = (
        F.when(n % 5 == 0, F.concat(F.lit('<meta name="PubDate" content="2024-'), month, F.lit("-"), day, F.lit(' 10:30">')))
        .when(n % 5 == 1, F.concat(F.lit('<meta content="'), day, F.lit("/"), month, F.lit("/2024\" property='article:published_time'>")))
        .when(n % 5 == 2, F.concat(F.lit('<time datetime="2024-'), month, F.lit("-"), day, F.lit('T08:05">x</time>')))
        .when(n % 5 == 3, F.concat(F.lit('<span class="post-date">March '), (n % 28 + 1).cast("string"), F.lit(", 2024 09:15</span>")))
        .otherwise(F.lit(""))
    )
    entity = F.concat(F.lit("<p>Caf&#233; &#x4e2d;&#25991; &amp; &lt;b&gt; item "), n, F.lit(" of the constructed lead text, eren.</p>"))
    label = F.when(n % 4 == 0, F.concat(F.lit('<meta property="og:title" content="Lead &amp; line '), n, F.lit(' - Site">'))).otherwise(F.lit(""))
    return load_table(spark, folder, "pages").select(
        "page_id", "url", F.concat(label, dated, entity, F.col("html")).alias("html")
    )


PAGES = """
SELECT page_id, url,
  CASE WHEN page_id % 4 = 0 THEN '<meta property="og:title" content="Lead &amp; line ' || page_id || ' - Site">' ELSE '' END ||
  CASE page_id % 5
    WHEN 0 THEN '<meta name="PubDate" content="2024-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:30">'
    WHEN 1 THEN '<meta content="' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '/2024" property=''article:published_time''>'
    WHEN 2 THEN '<time datetime="2024-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T08:05">x</time>'
    WHEN 3 THEN '<span class="post-date">March ' || (page_id % 28 + 1) || ', 2024 09:15</span>'
    ELSE '' END ||
  '<p>Caf&#233; &#x4e2d;&#25991; &amp; &lt;b&gt; item ' || page_id || ' of the constructed lead text, eren.</p>' || html AS html
FROM pages
"""


def page_sources(spark: SparkSession) -> DataFrame:
    """Seven sources of fetched pages, with flags and allowed hosts."""
    rows = [(n, f"p{n}", f"https://www.p{n}.example.com/", n != 6, "" if n == 5 else f"entity-{n}", ["mirror.example.org"] if n == 2 else [], []) for n in range(7)]
    return spark.createDataFrame(rows, "source_id BIGINT, source_code STRING, site_url STRING, active BOOLEAN, whitelist_entity_id STRING, allowed_hosts ARRAY<STRING>, allowed_host_patterns ARRAY<STRING>")


SELECTORS = [(["#none", "div.ad"], []), (["article > h1"], [".post-date, time[datetime]"]), (["nav li a"], ["span[class*=date]"]), (["body div > h1", "footer"], [".missing"]), ([], ["article time"]), (["[class^=a]"], []), (None, None)]


def selecting_sources(spark: SparkSession) -> DataFrame:
    """The sources of fetched pages with selectors of all kinds."""
    rows = [(n, titles, dates, "fr" if n % 2 else "en") for n, (titles, dates) in enumerate(SELECTORS)]
    return page_sources(spark).join(spark.createDataFrame(rows, "source_id BIGINT, title_selectors ARRAY<STRING>, date_selectors ARRAY<STRING>, language STRING"), "source_id")


def page_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A rejected candidate for every fetched page: its source, a constructed URL, a date on some, and the reason."""
    n = F.col("page_id")
    host = F.concat(F.lit("https://www.p"), (n % 7).cast("string"), F.lit(".example.com"))
    url = (F.when(n % 11 == 0, F.concat(F.lit("https://outside.example.net/news/"), n, F.lit(".html"))).when(n % 13 == 0, F.concat(host, F.lit("/list/"), n, F.lit("/")))
           .when(n % 10 == 2, F.concat(F.lit("https://mirror.example.org/news/"), n, F.lit(".html"))).otherwise(F.concat(host, F.lit("/news/"), n, F.lit(".html#top"))))
    return load_table(spark, folder, "pages").select(
        n.alias("id"), (n % 7).alias("source_id"), F.concat(F.lit("p"), (n % 7).cast("string")).alias("source_code"), url.alias("url"), F.when(n % 3 == 0, "fr").otherwise("en").alias("language"),
        F.lit("rejected").alias("review_status"), F.when(n % 4 == 0, "not_detail_url").when(n % 4 == 1, "title_too_short").when(n % 4 == 2, "missing_published_at").otherwise("other").alias("reject_reason"),
        F.when(n % 6 == 0, F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")).alias("published_at"))


def page_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of those candidates that could be fetched; some were moved to another host."""
    n = F.col("page_id")
    made = pages(spark, folder).drop("url").join(page_candidates(spark, folder).select(F.col("id").alias("page_id"), "url"), "page_id")
    return made.filter(n % 17 != 0).withColumn("final_url", F.when(n % 19 == 0, F.concat(F.lit("https://moved.example.net/news/"), n, F.lit(".html"))))


def candidates(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """Articles with given summaries on a third of the rows: the title, or text that is not in the body."""
    n = F.col("id") % 6
    given = F.when(n == 0, F.col("title")).when(n == 1, "eren pour nothing of this is in the body").otherwise("")
    return articles(spark, folder, only).withColumn("summary", given)


def cleaned(spark: SparkSession, folder: str, with_slug: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Clean articles of the driver's documents under the Latin term lists."""
    from clipworks.operators.cleaning import clean_candidates

    return clean_candidates(candidates(spark, folder, only), sources(spark, folder), REQUIRED, DOMAIN, REGIONS, CATEGORIES,
                            default_tag="none", with_slug=with_slug)


def current(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Current articles in the shape the derived datasets and searches read; with ``whole`` the body itself is the summary."""
    from clipworks.functions import terms, text
    from clipworks.operators import tagging

    arts = articles(spark, folder).withColumn("_low", F.lower("body"))
    n = F.col("id") % 3
    return arts.select(
        "id", "source", "language", "published_at", "url", text.clean("title").alias("title"),
        (text.clean("body") if whole else terms.natural_summary("body", REQUIRED)).alias("summary"),
        terms.matched(F.col("_low"), DOMAIN, word_boundary=False).alias("keywords"),
        tagging.region_list(F.col("body"), REGIONS, "none").alias("region_tags"),
        (F.size(terms.keep((t, F.contains(F.col("body"), F.lit(t))) for t in REGIONS)) > 0).alias("is_related"),
        F.when(n == 0, "enterprise").when(n == 1, "technology").otherwise("policy").alias("category"),
        terms.keep((i, terms.any_term(F.col("body"), [name, *aliases])) for i, name, aliases in ENTITIES).alias("entity_ids"),
    )


NOW, SINCE = "2024-12-20 00:00:00", "2024-01-10 00:00:00"


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Current articles with what the gates of lists and lookups read: flags from their sources and labels; and a slug."""
    names = sources(spark, folder).select(F.col("source_code").alias("source"), "active", "whitelist_entity_id")
    toxic = load_table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic")
    status = F.when(F.coalesce("toxic", F.lit(0)) == 0, "accessible").otherwise("inaccessible")
    return current(spark, folder).join(names, "source").join(toxic, "id", "left").withColumns({"url_status": status, "slug": F.concat(F.lit("story-"), "id")})


def shown(spark: SparkSession, folder: str) -> DataFrame:
    from clipworks.operators import search

    return search.visible(flagged(spark, folder), NOW, SINCE, REQUIRED)


def regions(current: DataFrame) -> DataFrame:
    """The regions of current articles: article ids, counts as summary, and their three commonest keywords."""
    from clipworks.functions import groups

    tagged = current.select("id", "keywords", F.explode("region_tags").alias("region"))
    counts = tagged.groupBy("region").agg(F.count("*").alias("n"), F.collect_list(F.col("id").cast("string")).alias("articles"))
    words = tagged.select("region", F.explode("keywords").alias("word")).groupBy("region", "word").agg(F.count("*").alias("k"))
    best = groups.top_k(words, ["region"], [F.desc("k"), F.asc("word")], 3)
    highlights = best.groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "word"))), lambda x: x["word"]).alias("highlights"))
    return counts.join(highlights, "region", "left").select(
        F.col("region").alias("id"), F.col("region").alias("name"), F.concat(F.lit("region of "), "region").alias("name_en"), F.lit("").alias("summary"),
        F.concat(F.col("n").cast("string"), F.lit(" articles on para and pour")).alias("summary_en"), F.coalesce("highlights", F.array().cast("array<string>")).alias("highlights"), "articles")


def entity_items(spark: SparkSession, current: DataFrame) -> DataFrame:
    """The whitelist with texts, one region each and the ids of its articles."""
    rows = [(i, name, aliases, f"known as {name} for the erin work", REGIONS[n % len(REGIONS)], [list(CATEGORIES)[n % 3]]) for n, (i, name, aliases) in enumerate(ENTITIES)]
    known = spark.createDataFrame(rows, "id STRING, name STRING, aliases ARRAY<STRING>, intro STRING, region STRING, tags ARRAY<STRING>")
    linked = current.select("id", F.explode("entity_ids").alias("entity")).groupBy("entity").agg(F.collect_list(F.col("id").cast("string")).alias("articles"))
    return known.join(linked.withColumnRenamed("entity", "id"), "id", "left")


def source_items(spark: SparkSession, folder: str) -> DataFrame:
    from clipworks import config

    known = sources(spark, folder)
    return known.select(F.col("source_code").alias("id"), "name", F.concat_ws(" ", "name", "type", "site_url", F.lit(config.SOURCE_ANCHOR), "whitelist").alias("text"))


PAGES_OF_SITE = ["home", "news", "news-detail", "map", "knowledge-graph", "sources", "about", "other"]


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The page of every conversation: kind, query, category, source, region and the article it shows."""
    n = F.col("conv_id")
    at = lambda values, i: F.get(terms_of(values), i.cast("int"))
    page = at(PAGES_OF_SITE, n % 8)
    return load_table(spark, folder, "conversations").select("conv_id").distinct().select(
        "conv_id", page.alias("page"), F.when(n % 4 == 1, "erin").otherwise("").alias("query"), F.when(n % 16 == 1, "src5").otherwise("").alias("source"),
        F.when(n % 8 == 1, at(list(CATEGORIES), n % 3)).otherwise("").alias("category"), F.when((n % 8).isin(3, 4), at(REGIONS, n % 7)).otherwise("").alias("region"),
        F.when(n % 8 == 2, n * 7 % 97).alias("current_id"))


def terms_of(values):
    return F.array(*[F.lit(v) for v in values])


def versions(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """Clean documents as article versions: three to a head, with a constructed URL status."""
    labels = load_table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic")
    out = cleaned(spark, folder, only=only).join(labels, "id", "left")
    return out.withColumns({
        "version_id": F.col("id"), "news_id": F.floor(F.col("id") / 3),
        "url_status": F.when(F.coalesce("toxic", F.lit(0)) == 0, "accessible").otherwise("inaccessible"),
    })


def graph(spark: SparkSession, folder: str):
    """Nodes and edges from the region and nation tables, with one edge that leads nowhere."""
    region, nation = load_table(spark, folder, "region"), load_table(spark, folder, "nation")
    rid = F.concat(F.lit("r"), "r_regionkey")
    parent = F.concat(F.lit("r"), "n_regionkey")
    nid = F.concat(F.lit("n"), "n_nationkey")
    classes = F.array(*[F.lit(c) for c in CLASSES])
    nodes = region.select(
        rid.alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("type"), F.lit("content").alias("element_class"),
        F.lit("").alias("parent_id"), F.array(rid).alias("region_ids"), F.col("r_regionkey").alias("display_order"),
    ).unionByName(nation.select(
        nid.alias("id"), F.col("n_name").alias("name"), F.lit("institution").alias("type"),
        F.get(classes, F.col("n_nationkey") % 5).alias("element_class"), parent.alias("parent_id"),
        F.array(parent).alias("region_ids"), (F.col("n_nationkey") % 4).alias("display_order"),
    ))
    edges = nation.filter("n_nationkey % 6 <> 0").select(
        parent.alias("source_id"), nid.alias("target_id"), F.lit("organizes").alias("relation"), (F.col("n_nationkey") % 3).alias("n_refs"))
    lost = nation.filter("n_nationkey = 7").select(
        F.lit("gone").alias("source_id"), nid.alias("target_id"), F.lit("lost").alias("relation"), F.lit(1).alias("n_refs"))
    return nodes, edges.unionByName(lost)


CLASSES = ["subject", "goal", "content", "activity", "evaluation"]
GRAPH = """
nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS type, 'content' AS element_class, '' AS parent_id, 'r' || r_regionkey AS region_id, r_regionkey AS display_order FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'institution', ['subject', 'goal', 'content', 'activity', 'evaluation'][n_nationkey % 5 + 1], 'r' || n_regionkey, 'r' || n_regionkey, n_nationkey % 4 FROM nation),
edges AS (SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'organizes' AS relation, n_nationkey % 3 AS n_refs FROM nation WHERE n_nationkey % 6 <> 0
  UNION ALL SELECT 'gone', 'n7', 'lost', 1)
"""
