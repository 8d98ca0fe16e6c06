"""Domain rows with known answers: relevance, review, URLs, dates, entities, extraction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clipworks.config import ReviewRule
from clipworks.functions import dates, html, terms, text, urls
from clipworks.operators import extract, joins, normalize, relevance, review, tagging, versions
from clipworks.streaming import ingest

ENTITY = "广西测绘学会"
RELEVANCE = [
    ("遥感技术在测绘领域的应用", "本文介绍了遥感和测绘的结合", [], True, ["遥感", "测绘"]),
    ("广西测绘学会举办技术研讨会", "会议邀请了多位专家讨论行业发展", [], True, ["测绘"]),
    ("广西测绘学会党委召开干部任职会议", "会议围绕组织建设和干部任免事项展开。", [], False, ["测绘"]),
    ("学院召开年度学术会议，讨论遥感课程建设", "会议围绕教学改革展开", [], False, ["遥感"]),
    ("Register for the GIS conference on Remote Sensing", "Registration details available", [], True, ["GIS", "Remote Sensing"]),
    ("学术会议通知", "本次会议将重点讨论遥感技术和测绘方法的最新进展", [], True, ["遥感", "测绘"]),
    ("学术研讨会", "会议通知", ["GIS", "北斗"], False, []),
    ("学院举办篮球比赛", "比赛将于下周举行", [], False, []),
    ("GIS技术与遥感应用", "", [], True, ["遥感", "GIS"]),
]


def test_strict_relevance(spark):
    rows = [(i, t, s, "", k) for i, (t, s, k, _, _) in enumerate(RELEVANCE)]
    df = spark.createDataFrame(rows, "id INT, title STRING, summary STRING, body STRING, kw ARRAY<STRING>")
    out = {r.id: r for r in relevance.strict_relevance(df, None, [ENTITY], keywords="kw").collect()}
    for i, (title, _, _, passed, core) in enumerate(RELEVANCE):
        assert out[i].relevant == passed, title
        assert out[i].matched_core == core, title
    assert out[2].low_context


def test_entity_table_gives_the_same(spark):
    rows = [(i, t, s, "") for i, (t, s, _, _, _) in enumerate(RELEVANCE)]
    df = spark.createDataFrame(rows, "id INT, title STRING, summary STRING, body STRING")
    table = spark.createDataFrame([(ENTITY,)], "term STRING")
    a = relevance.strict_relevance(df, None, table).select("id", "relevant").collect()
    b = relevance.strict_relevance(df, None, [ENTITY]).select("id", "relevant").collect()
    assert sorted(a) == sorted(b)


BASE = dict(
    id=1, source="s1", language="zh", title="遥感测绘平台发布", summary="平台面向地理信息和自然资源数字化业务提供遥感测绘能力。",
    body="平台面向地理信息和自然资源数字化业务提供遥感测绘能力。", published_at=dt.datetime(2024, 5, 1, 10),
    original_url="https://example.test/info/123.htm", whitelist_entity_id="entity-001", active=True, site_url="https://example.test",
    allowed_hosts=[], allowed_host_patterns=[], url_status="accessible")
REVIEWS = [
    ({}, ""),
    ({"active": False}, "source_inactive"),
    ({"whitelist_entity_id": "missing-entity"}, "source_not_whitelisted"),
    ({"published_at": None}, "missing_published_at"),
    ({"published_at": dt.datetime(2023, 12, 31, 23, 59)}, "published_at_before_minimum"),
    ({"url_status": "inaccessible"}, "original_url_inaccessible"),
    ({"title": "学院召开年度会议", "summary": "会议围绕学科建设、人才培养和科研合作展开交流。"}, "summary_required_term_missing"),
    ({"title": "GIS platform released", "summary": "GIS platform released"}, "summary_from_title"),
    ({"body": "正文只介绍组织建设和人才培养，没有包含摘要原文。"}, "summary_not_from_body"),
    ({"body": ""}, "body_missing"),
    ({"original_url": "https://outside.invalid.test/info/123.htm"}, "source_url_domain_mismatch"),
    ({"original_url": "https://example.test/"}, "not_detail_url"),
    ({"title": "遥感"}, "title_too_short"),
]
SCHEMA = ("id INT, source STRING, language STRING, title STRING, summary STRING, body STRING, published_at TIMESTAMP_NTZ, original_url STRING, "
          "whitelist_entity_id STRING, active BOOLEAN, site_url STRING, allowed_hosts ARRAY<STRING>, allowed_host_patterns ARRAY<STRING>, url_status STRING")


def assessed(spark):
    rows = [tuple({**BASE, **change, "id": i}.values()) for i, (change, _) in enumerate(REVIEWS)]
    ents = spark.createDataFrame([("entity-001", ENTITY, ["GX Surveying Society"])], "entity_id STRING, name STRING, aliases ARRAY<STRING>")
    return review.assess(spark.createDataFrame(rows, SCHEMA), ents, ReviewRule())


def test_review_gate(spark):
    out = review.review(assessed(spark), ReviewRule(), "2024-01-01 00:00:00", "2024-12-31 23:59:00").collect()
    assert {r.id: r.reason for r in out} == {i: reason for i, (_, reason) in enumerate(REVIEWS)}


def test_accepted_rows_are_compliant(spark):
    both = review.compliance(review.review(assessed(spark), ReviewRule(), "2024-01-01 00:00:00", "2024-12-31 23:59:00"))
    for r in both.filter("accepted").collect():
        assert r.reasons == []
    assert both.filter("accepted").count() == 1


DETAIL = [
    ("https://www.cagis.org.cn/Lists/content/id/4687.html", True), ("https://www.usgs.gov/centers/eros/news/example-story", True),
    ("https://www.ogc.org/blog-article/insights-from-innovation-days", True), ("https://www.esa.int/Newsroom/Press_Releases/example", True),
    ("https://www.bdstar.com/news.aspx?type=17&&id=4884", True), ("https://www.mapgis.com/index.php?a=shows&catid=33&id=1874", True),
    ("https://www.glac.org.cn/a9837.html", True), ("https://www.csgpc.org/list/93.html", False), ("https://example.test/news", False),
    ("https://www.supermap.com/zh-cn/a/news/list_9_1.html", False), ("not a url", False), (None, False),
]


def test_detail_urls(spark):
    df = spark.createDataFrame(DETAIL, "url STRING, want BOOLEAN")
    assert df.filter(urls.is_detail("url") != F.col("want")).collect() == []


def test_dates(spark):
    rows = [
        ("2026-04-15T12:04:00+00:00", "2026-04-15 12:04:00"), ("2026年4月27日 10:30", "2026-04-27 10:30:00"), ("April 29, 2026 09:45", "2026-04-29 09:45:00"),
        ("https://example.gov.cn/news/202604/t20260427_123.html", "2026-04-27 00:00:00"), ("Apr 29, 2026 12:05 am", "2026-04-29 00:05:00"),
        ("31/12/2024", "2024-12-31 00:00:00"), ("2024-02-30", None), ("1999-01-01T00:00:00Z", "1999-01-01 08:00:00"), ("nothing", None), (None, None)]
    df = spark.createDataFrame(rows, "s STRING, want STRING")
    got = df.select("want", F.date_format(dates.parse("s"), "yyyy-MM-dd HH:mm:ss").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("last, requested, start, first", [
    (None, None, "2024-01-01 00:00", True), ("2026-04-29 11:30", None, "2026-04-29 11:20", False),
    ("2026-04-29 12:30", None, "2026-04-29 11:50", False), (None, "2026-04-29 12:30", "2026-04-29 11:50", False)])
def test_windows(spark, last, requested, start, first):
    rows = [("succeeded", dt.datetime.fromisoformat(last))] if last else []
    runs = spark.createDataFrame(rows, "status STRING, window_end_at TIMESTAMP_NTZ")
    got = ingest.next_window(runs, "2026-04-29 12:00:00", "2024-01-01", 10, requested).collect()[0]
    assert got.start_at == dt.datetime.fromisoformat(start) and got.first_run == first


def test_entity_binding(spark):
    ents = spark.createDataFrame([
        ("entity-001", ENTITY, ["GX Surveying Society"], ["https://gx.example.test/about"]), ("entity-002", "广西 测绘学会", [], ["https://shared.test/a"]),
        ("entity-003", "Other", [], ["https://shared.test/b"])], "entity_id STRING, name STRING, aliases ARRAY<STRING>, evidence_urls ARRAY<STRING>")
    srcs = spark.createDataFrame([
        ("a", "entity-003", "x", ""), ("wl-entity-002", "", "x", ""), ("b", "gone", "gx surveying-society", ""), ("c", "", "x", "https://www.gx.example.test/"),
        ("d", "", "x", "https://shared.test/")], "source_code STRING, configured_id STRING, name STRING, site_url STRING")
    got = {r.source_code: r.entity_id for r in joins.bind_entities(srcs, ents).collect()}
    assert got == {"a": "entity-003", "wl-entity-002": "entity-002", "b": "entity-001", "c": "entity-001", "d": ""}


def test_text(spark):
    one = spark.range(1)
    row = one.select(
        text.clean(F.lit(" a  b\n\tc ")).alias("clean"), text.title(F.lit("遥感新闻 - 某网")).alias("title"),
        text.slug(F.lit("Été 北斗 2024"), F.lit("c"), F.lit("u")).alias("slug"), text.slug(F.lit("!!"), F.lit("c"), F.lit("u")).alias("fallback"),
        html.to_text(F.lit("<p>&lt;p&gt; &#20013;&#x1F600; <b>x</b></p><script>no</script>")).alias("html"),
        terms.natural_summary(F.lit("短。这里没有要求的词语可以找到吗？平台提供遥感测绘能力服务。"), ["遥感"]).alias("summary")).collect()[0]
    assert row.clean == "a b c" and row.title == "遥感新闻" and row.slug == "e-te-北斗-2024"
    assert row.fallback.startswith("c-") and len(row.fallback) == 10
    assert row.html == "<p> 中😀 x" and row.summary == "平台提供遥感测绘能力服务。"


def test_long_text_is_read_to_the_end(spark):
    body = "x " * 30000 + "结尾有遥感一词在此处出现。"
    row = spark.createDataFrame([(body,)], "body STRING").select(
        text.clean("body").alias("c"), terms.natural_summary("body", ["遥感"]).alias("s")).collect()[0]
    assert len(row.c) == len(body) and "遥感" in row.s


def test_pages(spark):
    ld = '<script type="application/ld+json">{"datePublished":"April 3, 2024 09:15"}</script>'
    pages = spark.createDataFrame([
        (1, "https://a.test/news/1", ld + "<h1>A long headline | Site</h1><p>Plain text about 遥感 in a paragraph of text.</p>"),
        (2, "https://a.test/news/2", "<h1>No date here at all</h1><p>x</p>")], "page_id INT, url STRING, html STRING")
    got = extract.pages_to_candidates(pages, ["遥感"]).collect()
    assert [(r.page_id, r.title, str(r.published_at)) for r in got] == [(1, "A long headline", "2024-04-03 09:15:00")]
    assert got[0].summary == "Plain text about 遥感 in a paragraph of text."


def test_feed(spark):
    xml = ("<rss><item><title>T</title><link>/news/1.html</link><pubDate>Mon, 12 Feb 2024 10:00:00 GMT</pubDate>"
           "<description><![CDATA[<p>body</p>]]></description><category>c</category></item></rss>")
    got = extract.explode_feed(spark.createDataFrame([(1, "https://a.test/feed", xml)], "feed_id INT, url STRING, payload STRING")).collect()
    assert [(r.title, r.link, str(r.published_at), r.content, r.categories) for r in got] == [
        ("T", "https://a.test/news/1.html", "2024-02-12 10:00:00", "body", ["c"])]


@pytest.mark.parametrize("boundary", [False, True])
def test_term_table_equals_brute_force(spark, boundary):
    import re
    docs = [(i, t) for i, t in enumerate(["the maps and a map", "mapping remote-sensing", "Remote  sensing remote sensing", "", "遥感map测绘", "a b", "GIS应用 gis_x"])]
    words = ["map", "maps", "remote sensing", "遥感", "b", "gis", "zz", "a"]
    df = spark.createDataFrame(docs, "id INT, body STRING")
    table = spark.createDataFrame([(w,) for w in words], "term STRING")
    got = {(r.id, r.term) for r in tagging.match_term_table(df, table, "id", "body", boundary, True).collect()}
    cjk = re.compile("[一-龥]")
    want = {(i, w) for i, t in docs for w in words if (
        re.search(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])", t.lower()) if boundary and not cjk.search(w) else w in t.lower())}
    assert got == want
    short = {(r.id, r.term) for r in tagging.match_terms(df, words, "id", "body", boundary, True).collect()}
    assert short == want


def test_mojibake_and_suffix(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad �"), (3, "cafÃ©")], "id INT, t STRING")
    assert {r.id for r in normalize.find_mojibake(df, ["t"]).collect()} == {2, 3}
    s = spark.createDataFrame([("摘要。关键词：遥感",), ("关键词：遥感 x",)], "s STRING")
    assert [r.s for r in normalize.strip_term_suffix(s, "s").collect()] == ["摘要", "关键词：遥感 x"]
