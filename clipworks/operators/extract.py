"""Fetched pages and feed payloads to text, links and article candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import dates, dom, groups, html, terms, text, urls
from clipworks.functions.text import let


def html_to_text(pages: DataFrame, col="html", out="text") -> DataFrame:
    return pages.withColumn(out, html.to_text(col))


def extract_body(pages: DataFrame, min_len: int = 20, cap: int | None = None, col="html", out="body") -> DataFrame:
    """Distinct paragraphs joined by spaces, else the whole page text. ``cap`` cuts only when a store asks for it."""
    joined = F.array_join(html.paragraphs(col, min_len), " ")
    body = let(joined, lambda p: F.when(p != "", p))
    pages = pages.withColumn(out, body).withColumn(out, F.coalesce(F.col(out), html.to_text(col)))
    return pages.withColumn(out, F.substring(out, 1, cap)) if cap else pages


def paragraphs(pages: DataFrame, min_len: int = 40, id_col="page_id", col="html") -> DataFrame:
    """One row per distinct paragraph, numbered from 0."""
    return pages.select(id_col, F.posexplode(html.paragraphs(col, min_len)).alias("position", "text"))


def extract_meta(pages: DataFrame, names, out: str, col="html") -> DataFrame:
    return pages.withColumn(out, html.first_meta(col, names))


def _selected(found: str | None) -> list[Column]:
    """The text of what a selector found, if it found any."""
    return [F.nullif(html.to_text(found), F.lit(""))] if found else []


def page_title(metas=config.TITLE_METAS, col="html", link_text: str | None = None, selected: str | None = None) -> Column:
    """Cleaned title from what a selector found, metas, the first heading, the document title or the link that led here."""
    tries = [*_selected(selected), F.nullif(html.first_meta(col, metas), F.lit("")), F.nullif(html.tag_text(col, "h1"), F.lit("")),
             F.nullif(html.tag_text(col, "title"), F.lit(""))]
    if link_text:
        tries.append(F.nullif(text.clean(link_text), F.lit("")))
    return text.title(F.coalesce(*tries, F.lit("")))


def extract_title(pages: DataFrame, metas=config.TITLE_METAS, col="html", out="title", link_text: str | None = None) -> DataFrame:
    return pages.withColumn(out, page_title(metas, col, link_text))


def _attr(col, pattern) -> Column:
    return F.nullif(text.clean(F.regexp_extract(col, pattern, 1)), F.lit(""))


def page_date(metas=config.DATE_METAS, col="html", url="url", link_hint: str | None = None, zone=config.LOCAL_ZONE, selected: str | None = None) -> Column:
    """Publish time from the first ranked place that says anything: what a selector found, metas, ``<time>``, any datetime attribute,
    linked data, date-like elements, then free text. The URL and the link's hint stand in for an unreadable one."""
    raw = F.coalesce(F.col(col), F.lit(""))
    linked = F.regexp_extract(raw, r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", 1)
    element = F.regexp_extract(
        raw, r"(?is)<[a-z0-9]+[^>]*\b(?:class|id)=[\"'][^\"']*(?:date|time|publish|posted)[^\"']*[\"'][^>]*>(.*?)</", 1)
    said = F.coalesce(
        *_selected(selected), F.nullif(html.first_meta(raw, metas), F.lit("")),
        _attr(raw, r"(?i)<time[^>]+datetime=[\"']([^\"']+)[\"']"), _attr(raw, r"(?i)<[a-z0-9]+[^>]+datetime=[\"']([^\"']+)[\"']"),
        F.nullif(dates.hint(linked), F.lit("")), F.nullif(dates.hint(html.strip_tags(element)), F.lit("")),
        F.nullif(dates.hint(html.strip_tags(raw)), F.lit("")))
    spare = [dates.parse_feed(dates.hint(url))] + ([dates.parse_feed(link_hint)] if link_hint else [])
    return F.coalesce(dates.parse_feed(said, zone), *spare)


def extract_published_at(pages: DataFrame, metas=config.DATE_METAS, col="html", url="url", link_hint: str | None = None,
                         zone=config.LOCAL_ZONE, out="published_at") -> DataFrame:
    return pages.withColumn(out, page_date(metas, col, url, link_hint, zone))


def pages_to_candidates(pages: DataFrame, required=config.REQUIRED_TERMS, known_date: Column | None = None) -> DataFrame:
    """Article candidates: title, body, natural summary, cover, date; pages without title or date are dropped.

    A ``known_date`` wins over what the page says. Columns of the page's source are used where there are any:
    ``title_selectors`` and ``date_selectors`` (array<string>), tried before everything else; ``link_text`` and
    ``link_date`` from the link that led here, tried last.

    Every stage is a projection of the page row: one scan, no shuffle.
    """
    have = set(pages.columns)
    chosen = {name: f"_{name}" if f"{name}_selectors" in have else None for name in ("title", "date")}
    for name, column in chosen.items():
        if column:
            pages = pages.withColumn(column, dom.select_first("html", f"{name}_selectors"))
    said = page_date(selected=chosen["date"], link_hint="link_date" if "link_date" in have else None)
    made = {"title": page_title(selected=chosen["title"], link_text="link_text" if "link_text" in have else None), "published_at": said if known_date is None else F.coalesce(known_date, said)}
    out = groups.keep_computed(pages, made, lambda x: (x["title"] != "") & x["published_at"].isNotNull())
    out = extract_body(out)
    out = out.withColumn("summary", terms.natural_summary("body", required))
    return extract_meta(out, config.COVER_METAS, "cover").drop("html", *[c for c in chosen.values() if c])


def source_candidates(pages: DataFrame, sources: DataFrame, required=config.REQUIRED_TERMS) -> DataFrame:
    """Candidates of fetched pages under the rules of their sources, with ``language`` and the raw ``payload`` as JSON.

    pages(source_id, url, html; optional final_url, link_text, link_date); sources(source_id, source_code, site_url,
    language, title_selectors, date_selectors). Pages of unknown sources give no candidates.
    """
    rules = sources.select("source_id", "source_code", "site_url", "language", "title_selectors", "date_selectors")
    met = pages.drop(*[c for c in rules.columns if c != "source_id"]).join(groups.small_side(rules), "source_id")
    met = met.withColumn("_asked", F.col("url"))
    if "final_url" in pages.columns:
        met = met.withColumn("url", F.coalesce("final_url", "_asked"))
    out = pages_to_candidates(met, required)
    payload = F.struct(F.col("source_code").alias("source"), F.col("_asked").alias("requestedUrl"), F.col("url").alias("finalUrl"), "title", "summary", F.col("body").alias("bodyText"), F.lit("body").alias("summarySource"))
    return out.withColumn("payload", F.to_json(payload)).drop("_asked", "title_selectors", "date_selectors")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute URL of a link on a page."""
    origin = urls.origin(base)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "/")
    relative = F.concat(F.when(folder.rlike(r"^[a-z]+://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder), F.regexp_replace(href, r"^(?:\./)+", ""))
    climbed = F.regexp_replace(F.regexp_replace(relative, r"/[^/]+/\.\./", "/"), r"/[^/]+/\.\./", "/")
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(climbed)
    )


def extract_links(pages: DataFrame, min_text: int = 1, id_col="page_id", col="html", url="url") -> DataFrame:
    """``(id, page_url, href, text, pos)`` of every usable link, first occurrence of each target.

    A page is one row, so repeats are dropped inside the row: no shuffle.
    """
    pattern = r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    hrefs = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    labels = F.regexp_extract_all(col, F.lit(pattern), F.lit(2))
    page = F.col(url)

    def read(pair, i):
        return F.struct(i.alias("pos"), F.trim(html.decode_entities(pair["h"])).alias("raw"), html.to_text(pair["t"]).alias("text"))

    def usable(x):
        return (x["raw"] != "") & ~x["raw"].rlike(r"(?i)^(?:javascript:|mailto:|tel:|#)") & (F.length(x["text"]) >= min_text)

    read_all = F.filter(F.transform(F.arrays_zip(hrefs.alias("h"), labels.alias("t")), read), usable)
    full = F.transform(read_all, lambda x: F.struct(x["pos"].alias("pos"), resolve_url(x["raw"], page).alias("href"), x["text"].alias("text")))

    def firsts(links):
        targets = F.transform(links, lambda x: x["href"])
        return let(targets, lambda ts: F.filter(links, lambda x, i: F.array_position(ts, x["href"]) == i + 1))

    return pages.select(id_col, page.alias("page_url"), F.explode(let(full, firsts)).alias("a")).select(
        id_col, "page_url", "a.href", "a.text", "a.pos")


def _matches(patterns: Column, href: Column, lower: Column) -> Column:
    def hit(p):
        q = F.concat(F.lit("(?i)"), p)
        return (p != "") & (F.regexp_like(href, q) | F.regexp_like(lower, q))

    return F.exists(patterns, hit)


def rank_links(links: DataFrame, k: int, id_col="page_id", detail_only=False) -> DataFrame:
    """Best ``k`` links of each page by score; links scoring 0 or less go.

    Optional columns from the page's source: ``link_allow_patterns``, ``link_deny_patterns``, ``whitelist``, ``site_url``.
    """
    have = set(links.columns)
    col = lambda c: F.coalesce(F.col(c), terms.strings([])) if c in have else terms.strings([])
    href, lower = F.col("href"), F.lower(F.concat_ws(" ", "href", "text"))
    same = urls.origin("href") == urls.origin("page_url")
    if "site_url" in have:
        same = same | (urls.host("href") == urls.host("site_url"))
    rows = links.filter(urls.is_detail("href")) if detail_only else links
    rows = rows.withColumn("_l", lower)
    allow, deny, white = col("link_allow_patterns"), col("link_deny_patterns"), col("whitelist")
    shape = href.rlike(r"(?i)[/_-](?:20\d{2}|\d{6,})|\.s?html$")
    noisy = F.col("_l").rlike("index|list|#")
    score = (
        F.when(same, 4).otherwise(0) + F.when(shape, 6).otherwise(0) - F.when(noisy, 4).otherwise(0)
        + F.when(F.exists(white, lambda w: F.contains(F.col("_l"), F.lower(w))), 4).otherwise(0))
    shut = _matches(deny, href, F.col("_l")) | ((F.size(allow) > 0) & ~_matches(allow, href, F.col("_l")))
    scored = rows.withColumn("score", F.when(shut, -100).otherwise(score)).filter("score > 0").drop("_l")
    return groups.top_k(scored, [id_col], [F.desc("score"), F.asc("pos")], k, rank="rank")


def rank_candidates(cands: DataFrame, k: int, required=config.REQUIRED_TERMS, hints=config.DOMAIN_TERMS, low=config.LOW_CONTEXT_TERMS,
                    lo: str = config.MIN_PUBLISHED_AT, hi: str = "2099-01-01", key="source", min_required=2) -> DataFrame:
    """Best ``k`` candidates of each source: required term, subject hint and date add; low context and short titles subtract.

    A text with ``min_required`` different required terms is never low context.
    """
    said = F.concat_ws(" ", "title", "summary", "url")
    rows = cands.withColumn("_t", said).withColumn("_low", F.lower("_t"))
    n_req = F.size(terms.keep((t, F.contains(F.col("_t"), F.lit(t))) for t in required))
    in_range = F.coalesce(F.col("published_at").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")), F.lit(False))
    weak = terms.any_term(F.col("_t"), low) & (n_req < min_required)
    score = (
        F.when(n_req > 0, 80).otherwise(0) + F.when(terms.any_term(F.col("_low"), [h.lower() for h in hints]), 40).otherwise(0)
        + F.when(in_range, 30).otherwise(0) - F.when(weak, 60).otherwise(0)
        - F.when(F.length(F.coalesce("title", F.lit(""))) < 6, 80).otherwise(0))
    scored = rows.withColumn("score", score).drop("_t", "_low")
    return groups.top_k(scored, [key], [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("url")], k, rank="rank")


def _xml(item: Column, tag: str) -> Column:
    raw = F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return let(html.to_text(F.regexp_replace(raw, r"<!\[CDATA\[|\]\]>", "")), lambda t: F.when(t != "", t))  # nullif would make the text twice


def explode_feed(payloads: DataFrame, id_col="feed_id", col="payload", base="url", max_categories: int | None = None) -> DataFrame:
    """One row per RSS item or Atom entry: title, link, date, content, categories (all, or the first ``max_categories``)."""
    items = payloads.select(id_col, F.col(base).alias("feed_url"), F.posexplode(
        F.regexp_extract_all(col, F.lit(r"(?is)<(item|entry)\b.*?</\1>"), F.lit(0))).alias("position", "_item"))
    item = F.col("_item")
    attr = F.nullif(F.regexp_extract(item, r"(?is)<link\b[^>]*\bhref=[\"']([^\"']+)[\"']", 1), F.lit(""))
    link = F.coalesce(_xml(item, "link"), attr, _xml(item, "guid"), _xml(item, "id"), F.lit(""))
    when = F.coalesce(*[_xml(item, t) for t in ("pubDate", "published", "updated", "dc:date", "date")], F.lit(""))
    content = F.coalesce(*[_xml(item, t) for t in ("content:encoded", "content", "description", "summary")], F.lit(""))
    cats = F.filter(F.transform(F.regexp_extract_all(item, F.lit(r"(?is)<category\b[^>]*>(.*?)</category>"), F.lit(1)), html.to_text), lambda c: c != "")
    rows = items.select(id_col, "feed_url", "position", F.coalesce(_xml(item, "title"), F.lit("")).alias("title"), link.alias("_link"),
                        when.alias("_when"), content.alias("content"), (F.slice(cats, 1, max_categories) if max_categories else cats).alias("categories"))
    return rows.withColumns({"link": F.when(F.col("_link") == "", "").otherwise(resolve_url(F.col("_link"), F.col("feed_url"))),
                             "published_at": dates.parse_feed("_when")}).drop("_link", "_when")


def explode_posts(payloads: DataFrame, start: str, end: str, id_col="feed_id", col="payload", required=config.REQUIRED_TERMS, item_limit: int | None = None) -> DataFrame:
    """One row per post of a posts-API answer, with ``outcome``: kept, missing_date, out_of_window, non_detail or malformed.

    Posts are variants, so their fields may change shape: title, content and excerpt are text or hold ``rendered`` text. The
    body follows the paragraph rule, the summary comes from it, and ``post`` is the whole post as JSON. An answer that is
    no JSON array is one row, malformed. With ``item_limit`` only so many posts are kept for each answer, in its order.
    """
    parsed = payloads.select(id_col, F.try_parse_json(col).alias("_v"))
    listed = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY")), F.lit(False))
    posts = parsed.filter(listed).lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(id_col, F.col("pos").alias("position"), F.col("value").alias("_p"))

    def said(*names):
        tries = []
        for name in names:
            plain = F.when(F.schema_of_variant(F.try_variant_get("_p", f"$.{name}", "variant")) == "STRING", F.try_variant_get("_p", f"$.{name}", "string"))
            tries += [F.nullif(F.try_variant_get("_p", f"$.{name}.rendered", "string"), F.lit("")), F.nullif(plain, F.lit(""))]
        return F.coalesce(*tries, F.lit(""))

    rows = posts.select(id_col, "position", said("link").alias("link"), html.to_text(said("title")).alias("title"), said("content").alias("_html"), html.to_text(said("excerpt")).alias("excerpt"),
                        dates.parse_feed(said("date_gmt", "date")).alias("published_at"), F.to_json("_p").alias("post"))
    rows = extract_body(rows, col="_html").withColumn("summary", terms.natural_summary("body", required)).drop("_html").withColumn("outcome", outcome("published_at", "link", start, end))
    if item_limit is not None:
        kept = groups.top_k(rows.filter("outcome = 'kept'"), [id_col], [F.asc("position")], item_limit)
        rows = kept.unionByName(rows.filter("outcome <> 'kept'"))
    broken = parsed.filter(~listed).select(id_col, F.lit("malformed").alias("outcome"))
    return rows.unionByName(broken, allowMissingColumns=True)


def outcome(at: str, url: str, start: str, end: str, grace_seconds: int = 60) -> Column:
    """Why a fetched item is kept or not."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(grace_seconds).cast("decimal(18,6)"))
    return (
        F.when(F.col(at).isNull(), "missing_date").when((F.col(at) < lo) | (F.col(at) > hi), "out_of_window")
        .when(~urls.is_detail(url), "non_detail").otherwise("kept"))


def explode_sitemap(payloads: DataFrame, id_col="feed_id", col="payload", site="site_url", allow=(), deny=()) -> DataFrame:
    """``(loc, published_at, is_index)`` of sitemaps: allowed detail pages of the same host, and nested sitemaps.

    Of several entries for one location the first wins.
    """
    blocks = payloads.select(id_col, F.col(site).alias("_site"), F.posexplode(
        F.regexp_extract_all(col, F.lit(r"(?is)<(url|sitemap)\b[^>]*>.*?</\1>"), F.lit(0))).alias("position", "_b"))
    rows = blocks.select(
        id_col, "_site", "position", html.to_text(F.regexp_extract("_b", r"(?is)<loc>(.*?)</loc>", 1)).alias("loc"),
        html.to_text(F.regexp_extract("_b", r"(?is)<lastmod>(.*?)</lastmod>", 1)).alias("_mod"), F.col("_b").rlike("(?i)^<sitemap").alias("is_index"))
    ok = F.col("loc") != ""
    if deny:
        ok = ok & ~F.col("loc").rlike(urls.any_of(deny))
    if allow:
        ok = ok & (F.col("is_index") | F.col("loc").rlike(urls.any_of(allow)))
    ok = ok & (F.col("is_index") | ((urls.host("loc") == urls.host("_site")) & urls.is_detail("loc")))
    firsts = rows.filter(ok).groupBy("loc", "is_index").agg(F.min(F.struct(id_col, "position", "_mod")).alias("m"))
    said = F.coalesce(F.nullif(F.col("m._mod"), F.lit("")), F.nullif(dates.hint("loc"), F.lit("")), F.lit(""))
    return firsts.select("loc", "is_index", said.alias("_said")).withColumn("published_at", dates.parse_feed("_said")).drop("_said")


def expand_seed_urls(sources: DataFrame, max_pages: int, key="source_code") -> DataFrame:
    """Distinct URLs to fetch per source: templates times page numbers, then entry, feed, sitemap or site URLs.

    sources(key, site_url, templates, entry_urls, feed_urls); missing lists are null or empty.
    """
    def some(c):
        return F.coalesce(F.col(c), terms.strings([]))

    numbers = F.sequence(F.lit(1), F.lit(max_pages))
    paged = F.flatten(F.transform(some("templates"), lambda t: F.transform(
        numbers, lambda n: F.replace(F.replace(t, F.lit("{page}"), n.cast("string")), F.lit("%d"), n.cast("string")))))
    rows = sources.withColumn("_paged", F.filter(paged, lambda u: F.trim(u) != ""))
    entry = F.when(F.size(some("entry_urls")) > 0, some("entry_urls")).otherwise(F.array("site_url"))
    pages = F.when(F.size("_paged") > 0, F.col("_paged")).otherwise(entry)
    every = F.array_distinct(F.filter(F.concat(pages, some("feed_urls")), lambda u: F.coalesce(F.trim(u), F.lit("")) != ""))
    return rows.select(key, F.posexplode(every).alias("position", "url"))


def _rule(rule_col: str):
    """Readers of a source's rule, a variant: text of a field ('' without one), and list of a field's texts."""
    def said(path):
        return F.trim(F.coalesce(F.try_variant_get(rule_col, f"$.{path}", "string"), F.lit("")))

    def texts(path):
        return F.coalesce(F.try_variant_get(rule_col, f"$.{path}", "array<string>"), terms.strings([]))

    def is_list(path):
        return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(rule_col, f"$.{path}", "variant")), F.lit("ARRAY")), F.lit(False))

    return said, texts, is_list


def rule_modes(sources: DataFrame, rule="crawl_rule") -> DataFrame:
    """``mode`` (feed, api, sitemap or html) and ``coverage`` of each source from its rule in JSON.

    Coverage is best_effort when the rule names more than one page (templates, an API, feeds, a sitemap), else partial. A
    missing or broken rule is an empty one.
    """
    rows = sources.withColumn("_r", F.coalesce(F.try_parse_json(rule), F.parse_json(F.lit("{}"))))
    said, _, is_list = _rule("_r")
    parser = said("parser")
    mode = (F.when(parser.isin("rss", "atom"), "feed").when(is_list("feedUrls"), "feed")
            .when((said("mode") == "api") | (parser == "wp-json"), "api").when(parser == "sitemap", "sitemap").otherwise("html"))
    deep = (said("paginationTemplate") != "") | is_list("paginationTemplates") | (said("apiUrl") != "") | is_list("feedUrls") | (parser == "sitemap")
    return rows.withColumns({"mode": mode, "coverage": F.when(deep, "best_effort").otherwise("partial")}).drop("_r")


def rule_seed_urls(sources: DataFrame, rule="crawl_rule", key="source_code", max_pages: int = 10) -> DataFrame:
    """(key, mode, position, url): the distinct URLs that each source's rule starts from.

    html: templates with their start and end page, else one template, else the entry and fallback URLs, else the site; feed:
    feed URLs, else those; api: the API's pages; sitemap: feed, entry and fallback URLs, else the two usual sitemaps. The
    rule's ``maxPages`` bounds pages, ``max_pages`` where it has none.
    """
    rows = rule_modes(sources, rule).withColumn("_r", F.coalesce(F.try_parse_json(rule), F.parse_json(F.lit("{}"))))
    said, texts, is_list = _rule("_r")
    rows = rows.withColumn("_max", F.greatest(F.coalesce(F.try_variant_get("_r", "$.maxPages", "int"), F.lit(max_pages)), F.lit(0)))

    def paged(template, first, last):
        numbers = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda n: F.replace(F.replace(template, F.lit("{page}"), n.cast("string")), F.lit("%d"), n.cast("string")))

    def of_entry(e):
        plain = F.schema_of_variant(e) == "STRING"
        number = lambda name, spare: F.coalesce(F.when(~plain, F.try_variant_get(e, f"$.{name}", "int")), spare)
        template = F.coalesce(F.when(plain, e.cast("string")).otherwise(F.try_variant_get(e, "$.template", "string")), F.lit(""))
        first = F.greatest(number("start", F.lit(1)), F.lit(1))
        last = F.least(F.greatest(first, number("end", number("maxPages", F.col("_max")))), F.col("_max"))
        return F.when(F.trim(template) != "", paged(template, first, last)).otherwise(terms.strings([]))

    many = F.flatten(F.transform(F.coalesce(F.try_variant_get("_r", "$.paginationTemplates", "array<variant>"), F.array().cast("array<variant>")), of_entry))
    entry = F.concat(F.array(said("entryUrl")), texts("fallbackEntryUrls"))
    named = lambda c: F.filter(c, lambda u: F.coalesce(F.trim(u), F.lit("")) != "")
    first_of = lambda *lists: F.coalesce(*[F.when(F.size(named(x)) > 0, named(x)) for x in lists], terms.strings([]))
    site = F.regexp_replace("site_url", "/+$", "")
    api = said("apiUrl")
    numbered = paged(F.when(api.rlike(r"[?&]page=\d+"), F.regexp_replace(api, r"([?&]page=)\d+", "$1{page}")).when(F.contains(api, F.lit("?")), F.concat(api, F.lit("&page={page}"))).otherwise(F.concat(api, F.lit("?page={page}"))), F.lit(1), F.col("_max"))
    html_pages = first_of(many, F.when(said("paginationTemplate") != "", paged(said("paginationTemplate"), F.lit(1), F.col("_max"))).otherwise(terms.strings([])), entry, F.array("site_url"))
    urls_of = (F.when(F.col("mode") == "feed", first_of(texts("feedUrls"), entry, F.array("site_url"))).when(F.col("mode") == "api", F.when(api != "", numbered).otherwise(terms.strings([])))
               .when(F.col("mode") == "sitemap", first_of(F.concat(texts("feedUrls"), entry), F.array(F.concat(site, F.lit("/sitemap.xml")), F.concat(site, F.lit("/sitemap_index.xml"))))).otherwise(html_pages))
    return rows.withColumn("_u", F.array_distinct(urls_of)).select(key, "mode", F.posexplode("_u").alias("position", "url"))


def extraction_stats(cands: DataFrame, start: str, end: str, key="source", url="url", item_limit: int | None = None) -> DataFrame:
    """Outcome counts and date range per source; ``partial`` coverage when nothing was kept or the limit was hit."""
    rows = cands.withColumn("outcome", outcome("published_at", url, start, end))
    kept = F.col("outcome") == "kept"
    out = rows.groupBy(key).agg(
        F.count("*").alias("fetched"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("missing_date", "out_of_window", "non_detail", "kept")],
        F.min(F.when(kept, F.col("published_at"))).alias("earliest"), F.max(F.when(kept, F.col("published_at"))).alias("latest"))
    short = F.col("kept") == 0 if item_limit is None else (F.col("kept") == 0) | (F.col("kept") >= item_limit)
    return out.withColumn("coverage", F.when(short, "partial").otherwise("best_effort"))


def limit_per_source(cands: DataFrame, n: int, key="source", id_col="id") -> DataFrame:
    return groups.top_k(cands, [key], [F.desc_nulls_last("published_at"), F.asc(id_col)], n, rank="rank")


def source_yield(pages: DataFrame, required, limit: int, key="host", id_col="page_id") -> DataFrame:
    """Per source: pages checked (at most ``limit``), pages whose body gives a summary, one sample URL."""
    checked = groups.top_k(pages, [key], [F.asc(id_col)], limit)
    rows = extract_body(checked).withColumn("_good", terms.natural_summary("body", required) != "")
    return rows.groupBy(key).agg(
        F.count("*").alias("checked"), F.count_if("_good").alias("good"),
        F.min_by("url", F.when(F.col("_good"), F.col(id_col))).alias("sample_url"))
