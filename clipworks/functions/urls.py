"""URL expressions: canonical form, host, detail and list tests, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipworks.functions.text import col_of

# Path parts that mark an article page.
DETAIL_PARTS = [
    "/content/", "/detail/", "/info/", "/article/", "/blog-article/", "/announcement/", "/post/", "/story/",
    "/blog/", "/press/", "/press_releases/", "/press-releases/", "/event/", "/events/", "/id/", "/art/", "/news/",
]
# Path parts under which a long slug is still a listing.
LISTING_PARTS = ["/category/", "/tag/", "/author/", "/topic/", "/page/"]
# Shapes of article paths and of list paths used by the dataset rules.
DETAIL_PATTERNS = [
    r"/detail/\d+\.html$", r"/content/id/\d+\.html$", r"/info/\d+/\d+\.htm$", r"/a/news/\d+_\d+\.html$",
    r"/announcement/", r"/blog-article/", r"/applications/observing_the_earth/.+", r"/dtxw/.+t\d+_\d+\.html$",
    r"/t\d+\.(?:s?html)$",
]
LIST_PATTERNS = [
    r"/list(?:[_/-]|$)", r"/lists/index/", r"/content/index/", r"/news/list_", r"/xyxw\.htm$",
    r"/applications/observing_the_earth$", r"/zfwj/zxwj/?$", r"/xwzx/?$",
]
# Links that never lead to an article.
NOISE_PATTERNS = [
    r"\.css(?:\?|$)", r"\.js(?:\?|$)", r"\.png(?:\?|$)", r"\.jpe?g(?:\?|$)", r"\.svg(?:\?|$)", r"\.gif(?:\?|$)",
    r"mailto:", r"javascript:", r"#$", r"/index(?:\.s?html)?$", r"/list[_-]", r"/lists/index/", r"/content/index/",
    r"/search", r"/login", r"/download",
]


def any_of(patterns) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def canonical(c) -> Column:
    """Trimmed, fragment and trailing slashes off; null or blank gives ''."""
    text = F.trim(F.coalesce(col_of(c), F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, r"#.*$", ""), r"/+$", "")


def _part(c, part: str) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(col_of(c)), F.lit(part)), F.lit(""))


def host(c) -> Column:
    """Lower-case host without ``www.``; a bad URL gives ''."""
    return F.regexp_replace(F.lower(_part(c, "HOST")), r"^www\.", "")


def path(c) -> Column:
    return _part(c, "PATH")


def query(c) -> Column:
    return _part(c, "QUERY")


def is_http(c) -> Column:
    return F.coalesce(col_of(c), F.lit("")).rlike(r"(?i)^https?://[^/\s]+")


def host_matches(host_col, allowed_col) -> Column:
    """Same host or a subdomain of it."""
    h, a = col_of(host_col), col_of(allowed_col)
    return (h == a) | F.endswith(h, F.concat(F.lit("."), a))


def is_detail(c) -> Column:
    """Whether a URL is one article page rather than a list or home page."""
    p = F.regexp_replace(F.lower(path(c)), r"/+$", "")
    q = F.lower(query(c))
    file = F.substring_index(p, "/", -1)
    inside_listing = p.rlike(any_of(LISTING_PARTS))
    long_name = ~F.contains(file, F.lit(".")) & (F.length(file) >= 12) & ~inside_listing
    id_query = q.rlike(r"(?:^|&)id=\d") & p.rlike(r"(?:news|show|detail|view|index\.php|\.aspx?)$")
    listing = p.rlike(r"/(?:news|dt|list|index)$|/(?:index|list)(?:[_-]\d+)*\.s?html?$")
    viewer = p.rlike(r"/(?:informationdetail|news_view|solution_view|products_view|case_view|shows)(?:/.*)?$")
    dated_hash = p.rlike(r"^/20\d{6}/[0-9a-f]{16,}/[ac]\.html$")
    coded_file = file.rlike(r"^(?:[a-z]\d{4,}|t\d+(?:_\d+)?)\.s?html?$")
    numbered_file = file.rlike(r"^\d{5,}\.s?html?$")
    dated_file = p.rlike(r"(?:20\d{2}|\d{6,}).*\.s?html?$") & ~p.rlike(r"/(?:category|tag|special)/")
    return (
        F.when(p == "", False)
        .when(id_query, True)
        .when(listing, False)
        .when(viewer | p.rlike(any_of(DETAIL_PARTS)) | dated_hash | coded_file, True)
        .when(numbered_file, ~F.contains(p, F.lit("/list/")))
        .when(long_name & file.rlike("-.*-"), True)
        .when(long_name & file.rlike("_.*_") & p.rlike("^/+[^/]+/"), True)
        .otherwise(dated_file)
    )


def is_list_like(c) -> Column:
    return F.regexp_replace(path(c), r"/+$", "").rlike(any_of(LIST_PATTERNS))


def is_noise(c) -> Column:
    return F.coalesce(col_of(c), F.lit("")).rlike(any_of(NOISE_PATTERNS))


def origin(c) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col_of(c), F.lit("")), r"^([A-Za-z]+://[^/?#]+)", 1))


def _route(c) -> Column:
    p = F.regexp_replace(path(c), r"/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def is_specific(url, site, blocked_hosts=()) -> Column:
    """A page of its own: not blocked, not a home page, not the source's entry page."""
    u, s = col_of(url), col_of(site)
    bare = query(u) == ""
    blocked = F.lower(_part(u, "HOST")).isin(list(blocked_hosts)) if blocked_hosts else F.lit(False)
    same_entry = (origin(u) == origin(s)) & (_route(u) == _route(s)) & bare
    home = (_route(u) == "/") & bare
    return (origin(u) != "") & ~blocked & ~home & ~F.coalesce(same_entry, F.lit(False))


def is_article_page(c) -> Column:
    """Not a home page and not list-like."""
    return (origin(c) != "") & (_route(c) != "/") & ~is_list_like(c)


def target_score(url, site, blocked_hosts=()) -> Column:
    """Specificity of a source's target URL; -100 when it is not a page of its own."""
    u, s = col_of(url), col_of(site)
    p = _route(u)
    segments = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    score = (
        segments
        + F.when(p.rlike(any_of(DETAIL_PATTERNS)), 10).otherwise(0)
        - F.when(p.rlike(any_of(LIST_PATTERNS)), 8).otherwise(0)
        + F.when(query(u) != "", 1).otherwise(0)
        + F.when(origin(u) == origin(s), 2).otherwise(0)
    )
    return F.when(is_specific(u, s, blocked_hosts), score).otherwise(F.lit(-100)).cast("int")
