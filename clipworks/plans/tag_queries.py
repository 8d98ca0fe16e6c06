"""Summaries, tagging, classification and relevance over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.config import RelevanceRule
from clipworks.functions import groups
from clipworks.operators import cleaning, relevance, tagging
from clipworks.operators import urlset
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.plans.url_queries import TARGETS, _targets
from clipworks.sources import bind
from clipworks.sources.tables import load_table

RULE = RelevanceRule(core_terms=bind.CORE, low_terms=bind.LOW)
LOW_TEXT = "lower(body)"
CLEAN_BODY = k.clean("body")


@query("sm1_natural_summary", k.with_articles(f"SELECT id, {k.natural('body', bind.REQUIRED)} AS summary FROM articles"))
def natural_summary(spark, d):
    return tagging.choose_summary(bind.articles(spark, d), bind.REQUIRED).select("id", "summary")


@query("sm2_snippet", k.with_articles(f"SELECT id, {k.snippet('b', bind.REQUIRED)} AS snippet FROM (SELECT id, {CLEAN_BODY} AS b FROM articles)"))
def snippet(spark, d):
    return tagging.snippet_around(bind.articles(spark, d), bind.REQUIRED).select("id", "snippet")


STRIPPED = k.clean("regexp_replace(regexp_replace(h, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")


def para_text(x: str) -> str:
    """Text of one paragraph of the constructed pages."""
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]:
        out = f"replace({out}, '{name}', '{char}')"
    for code, char in [("&#233;", "é"), ("&#x4e2d;", "中"), ("&#25991;", "文")]:
        out = f"replace({out}, '{code}', '{char}')"
    return k.clean(out)


PARAS = f"""paras AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda p: {para_text('p')}),
   lambda p: length(p) >= 40) AS ps FROM ({bind.PAGES}))"""


@query("sm3_excerpt", f"WITH {PARAS} SELECT page_id, substr(coalesce(list_filter(ps, lambda p: length(p) >= 60)[1], ps[1], ''), 1, 220) AS excerpt FROM paras")
def excerpt(spark, d):
    return tagging.excerpt(bind.pages(spark, d)).select("page_id", "excerpt")


@query("sm4_summary_in_body", k.with_cleaned(
    "SELECT id, summary <> '' AND body <> '' AND contains(lower(body), lower(summary)) AS summary_in_body, title <> '' AND title = trim(summary) AS title_only FROM cleaned"))
def summary_in_body(spark, d):
    arts = tagging.flag_title_only(tagging.flag_summary_in_body(bind.cleaned(spark, d)))
    return arts.select("id", "summary_in_body", "title_only")


@query("sm5_title_only", k.with_articles(f"""
SELECT id, {k.clean('title')} <> '' AND (id % 2 = 0 OR {k.clean('title')} = {CLEAN_BODY}) AS title_only FROM articles"""))
def title_only(spark, d):
    arts = bind.articles(spark, d).withColumn("summary", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "title", F.lit("  "))).otherwise(F.col("body")))
    return tagging.flag_title_only(arts).select("id", "title_only")


@query("tg1_required_terms", f"SELECT doc_id, unnest(list_filter({k.term_list(bind.REQUIRED)}, lambda t: contains(text, t))) AS term FROM documents")
def required_terms(spark, d):
    return tagging.match_terms(load_table(spark, d, "documents"), bind.REQUIRED, "doc_id", "text")


@query("tg2_word_terms", f"SELECT doc_id, unnest({k.words('lower(text)', bind.CORE)}) AS term FROM documents")
def word_terms(spark, d):
    return tagging.match_terms(load_table(spark, d, "documents"), bind.CORE, "doc_id", "text", word_boundary=True)


ALIASES = {"alpha": ["thanedble", "eauxle"], "beta": ["sichge", "ther", "ciónde"], "gamma": ["avec", "los", "thon"]}


@query("tg3_alias_terms", "SELECT doc_id, CASE " + " ".join(
    f"WHEN len({k.words('lower(text)', a)}) > 0 THEN {k.q(c)}" for c, a in ALIASES.items()) + " ELSE '' END AS canonical_term FROM documents")
def alias_terms(spark, d):
    return tagging.resolve_alias_term(load_table(spark, d, "documents"), ALIASES, "text").select("doc_id", "canonical_term")


@query("tg4_keywords", k.with_model(f"""
SELECT a.id, array_to_string(list_slice(list_concat([a.language], {k.parts(LOW_TEXT.replace('body', "a.title || ' ' || a.body"), bind.DOMAIN)},
  list_filter(s.whitelist, lambda w: contains(lower(a.title || ' ' || a.body), w))), 1, 5), '|') AS keywords FROM articles a JOIN sources s ON a.source = s.source_code"""))
def keywords(spark, d):
    arts = bind.articles(spark, d).withColumn("summary", F.lit("")).withColumn("raw_keywords", F.array("language", F.lit("x")))
    return tagging.extract_keywords(arts, bind.DOMAIN, bind.sources(spark, d), k=5).select("id", F.concat_ws("|", "keywords").alias("keywords"))


PHRASES = ["Ther", "on the", "pour la", "nicht"]
TG5 = f"""
WITH {k.CLEANED},
f AS (SELECT id, keywords, title, array_to_string([title, summary, array_to_string(keywords, ' '), source, array_to_string(region_tags, ' ')], ' ') AS ft FROM cleaned),
bag AS (
  SELECT id, unnest(keywords) AS term, 4 AS w FROM f
  UNION ALL SELECT id, name, 3 FROM f, known WHERE list_bool_or(list_transform(terms, lambda x: contains(ft, x)))
  UNION ALL SELECT id, unnest({k.parts('lower(ft)', PHRASES)}), 2 FROM f
  UNION ALL SELECT id, unnest(list_filter(list_transform(regexp_split_to_array({{title}}, '[：:，,、|｜]'), lambda p: {k.clean('p')}), lambda p: length(p) BETWEEN 3 AND 18)), 1 FROM f
  UNION ALL SELECT id, unnest(list_filter(regexp_extract_all(ft, '[A-Za-z][A-Za-z-]{{{{2,}}}}'), lambda w: lower(w) NOT IN ('the', 'and', 'for'))), 1 FROM f),
n AS (SELECT id, regexp_replace(regexp_replace({k.clean('term')}, '^[—-]+|[—-]+$', '', 'g'), '[：:，,。；;、]+$', '') AS term, w FROM bag),
m AS (SELECT id, CASE WHEN regexp_matches(term, '^[A-Za-z][A-Za-z\\s-]+$') THEN lower(term) ELSE term END AS term, w FROM n),
s AS (SELECT id, term, sum(w) AS weight FROM m WHERE length(term) BETWEEN 2 AND 24 AND term <> 'data' GROUP BY 1, 2),
r AS (SELECT id, term, CAST(weight AS BIGINT) AS weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM s)
SELECT id, term, weight, rank FROM r WHERE rank <= 10"""
_ENT = "replace(replace(replace(replace(replace(replace(title, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>')"


@query("tg5_scored_keywords", TG5.replace("{title}", _ENT).replace("{{", "{").replace("}}", "}"))
def scored_keywords(spark, d):
    ents = [(n, a) for _, n, a in bind.ENTITIES]
    return tagging.score_keywords(bind.cleaned(spark, d), ents, PHRASES, ["the", "and", "for"], ["data"])


@query("tg6_region_tags", k.with_articles(f"""
SELECT id, CASE WHEN len(r) = 0 THEN 'none' ELSE array_to_string(list_slice(r, 1, 3), '|') END AS region_tags, len(r) > 0 AS is_related
FROM (SELECT id, list_filter({k.term_list(bind.REGIONS)}, lambda t: contains(body, t)) AS r FROM articles)"""))
def region_tags(spark, d):
    return tagging.tag_regions(bind.articles(spark, d), bind.REGIONS, "none").select("id", F.concat_ws("|", "region_tags").alias("region_tags"), "is_related")


TG7 = f"""
WITH {k.CLEANED},
reg AS (SELECT unnest({k.term_list(bind.REGIONS)}) AS term), regs AS (SELECT term, 'r-' || term AS region_id FROM reg),
themes AS (SELECT 'lich' AS theme, unnest(['r-heat', 'r-onon']) AS region_id),
f AS (SELECT id, region_tags, array_to_string([title, summary, array_to_string(keywords, ' '), source, array_to_string(region_tags, ' ')], ' ') AS t,
      CASE WHEN id % 5 = 0 THEN 'entity-1' ELSE 'entity-9' END AS e FROM cleaned),
hit AS (SELECT id, region_id FROM f, regs WHERE contains(t, term) OR list_contains(region_tags, term)
  UNION SELECT id, region_id FROM f, themes WHERE contains(t, theme) OR list_contains(region_tags, theme)
  UNION SELECT id, 'r-dad' FROM f WHERE e = 'entity-1')
SELECT id, region_id FROM hit UNION SELECT id, 'r-all' FROM hit"""


@query("tg7_region_ids", TG7)
def region_ids(spark, d):
    arts = bind.cleaned(spark, d).withColumn("entity_ids", F.array(F.when(F.col("id") % 5 == 0, "entity-1").otherwise("entity-9")))
    regions = spark.createDataFrame([(t, "r-" + t) for t in bind.REGIONS], "term STRING, region_id STRING")
    themes = spark.createDataFrame([("lich", "r-heat"), ("lich", "r-onon")], "term STRING, region_id STRING")
    ents = spark.createDataFrame([("entity-1", ["r-dad", "r-all"])], "entity_id STRING, region_ids ARRAY<STRING>")
    return tagging.resolve_regions(arts, regions, themes, ents, "r-all")


@query("tg8_category", k.with_articles(f"SELECT id, {k.category_sql('lower(body)')} AS category FROM articles"))
def category(spark, d):
    return tagging.classify(bind.articles(spark, d), bind.CATEGORIES).select("id", "category")


def _argmax_sql():
    p, e, t = (k.count_of("lower(body)", bind.CATEGORIES[c]) for c in ("policy", "enterprise", "technology"))
    return (f"CASE WHEN id % 7 = 0 THEN 'policy' WHEN {p} >= {e} AND {p} >= {t} THEN 'policy' WHEN {e} >= {t} THEN 'enterprise' ELSE 'technology' END AS argmax_category, "
            "CASE WHEN regexp_matches(body, 'eron|lich') THEN 'enterprise' WHEN regexp_matches(body, 'erst') THEN 'policy' ELSE 'technology' END AS regex_category")


@query("tg9_category_variants", k.with_articles(f"SELECT id, {_argmax_sql()} FROM articles"))
def category_variants(spark, d):
    hints = {c: bind.CATEGORIES[c] for c in ("policy", "enterprise", "technology")}
    arts = bind.articles(spark, d).withColumn("given", F.when(F.col("id") % 7 == 0, "policy").otherwise(""))
    arts = tagging.classify_argmax(arts, hints, "body", given="given", out="argmax_category")
    arts = tagging.classify_regex(arts, [("enterprise", "eron|lich"), ("policy", "erst")], out="regex_category")
    return arts.select("id", "argmax_category", "regex_category")


@query("tg10_entities", k.with_articles(f"""
SELECT DISTINCT id, entity_id FROM articles, ({k.ENTITY_TABLE}) WHERE list_bool_or(list_transform(terms, lambda x: contains(body, x)))
UNION SELECT id, 'entity-2' FROM articles WHERE id % 9 = 0"""))
def entities(spark, d):
    arts = bind.articles(spark, d).withColumn("entity_ids", F.when(F.col("id") % 9 == 0, F.array(F.lit("entity-2"), F.lit("gone"))).otherwise(F.array().cast("array<string>")))
    return tagging.resolve_entities(arts, bind.entities(spark))


REL = f"""
m AS (SELECT *, lower(CASE WHEN body <> '' THEN body ELSE trim(title || ' ' || summary) END) AS ev FROM cleaned),
n AS (SELECT m.*, {k.words('ev', bind.CORE)} AS core, list_concat({k.words('ev', k.ENTITY_TERMS)},
  list_filter(coalesce(known.terms, []), lambda t: NOT list_contains({k.words('ev', k.ENTITY_TERMS)}, t))) AS ents,
  known.entity_id IS NOT NULL AS entity_known
  FROM m LEFT JOIN known ON m.whitelist_entity_id = known.entity_id),
rel AS (SELECT *, len(core) >= 2 OR (len(core) >= 1 AND len(ents) >= 1 AND NOT (len(core) < 2 AND {k.any_of('body', bind.LOW)})) AS relevant FROM n)
"""


def own_terms(df, entities):
    """Names of the source's own entity, for the relevance evidence."""
    dim = entities.select(F.col("entity_id").alias("whitelist_entity_id"),
                          F.concat(F.array("name"), "aliases").alias("own_terms"), F.lit(True).alias("entity_known"))
    return df.join(groups.small_side(dim), "whitelist_entity_id", "left").withColumn("entity_known", F.coalesce("entity_known", F.lit(False)))


@query("rl1_strict_relevance", f"WITH {k.CLEANED}, {REL} SELECT id, relevant, array_to_string(core, '|') AS core, array_to_string(ents, '|') AS ents FROM rel")
def strict_relevance(spark, d):
    arts = own_terms(bind.cleaned(spark, d), bind.entities(spark))
    out = relevance.strict_relevance(arts, RULE, k.ENTITY_TERMS, own_terms="own_terms")
    return out.select("id", "relevant", F.concat_ws("|", "matched_core").alias("core"), F.concat_ws("|", "matched_entities").alias("ents"))


@query("rl2_source_relevance", f"""WITH {k.CLEANED}, t AS (SELECT *, lower(title || ' ' || summary) AS ts, title || ' ' || summary AS tx FROM cleaned),
u AS (SELECT *, {k.any_of('ts', [x.lower() for x in bind.DOMAIN])} OR contains(ts, whitelist[1]) OR contains(ts, whitelist[2]) AS dom FROM t)
SELECT id, CASE source WHEN 'src1' THEN dom OR regexp_matches(ts, 'ing|aux') WHEN 'src2' THEN dom ELSE dom OR {k.any_of('ts', bind.REGIONS)} END AS source_relevant,
  len({k.words('ts', bind.CORE)}) >= 2 OR (len({k.words('ts', bind.CORE)}) >= 1 AND NOT {k.any_of('tx', bind.LOW)}) AS core_relevant FROM u""")
def source_relevance(spark, d):
    arts = relevance.source_relevance(bind.cleaned(spark, d), bind.DOMAIN, bind.REGIONS, {"src1": "ing|aux", "src2": ""})
    return relevance.core_relevance(arts, RULE).select("id", "source_relevant", "core_relevant")


@query("rl3_low_context", k.with_articles(f"SELECT id, {k.any_of('body', bind.LOW)} AS low_context FROM articles"))
def low_context(spark, d):
    return relevance.flag_low_context(bind.articles(spark, d), bind.LOW).select("id", "low_context")


@query("cl1_clean_candidates", k.with_cleaned(f"""
SELECT id, title, summary, original_url, array_to_string(keywords, '|') AS keywords, array_to_string(region_tags, '|') AS region_tags,
 region_tags[1] <> 'none' AS is_related, category, substr(sha256(source || '::' || original_url), 1, 16) AS stable_id,
 sha256(concat_ws(chr(10), title, summary, body, original_url, {k.stamp('published_at')}, category, array_to_string(keywords, ','), array_to_string(region_tags, ','))) AS content_hash
FROM cleaned"""))
def clean_candidates(spark, d):
    return bind.cleaned(spark, d).select(
        "id", "title", "summary", "original_url", F.concat_ws("|", "keywords").alias("keywords"),
        F.concat_ws("|", "region_tags").alias("region_tags"), "is_related", "category", "stable_id", "content_hash")


@query("cl2_normalize_articles", f"""WITH {k.CLEANED},
t AS (SELECT *, CASE WHEN length(trim(summary)) >= 12 THEN trim(summary) WHEN length(trim(substr(title, 1, 260))) >= 12 THEN trim(substr(title, 1, 260)) ELSE '' END AS ns FROM cleaned WHERE title <> ''),
b AS (SELECT * REPLACE (list_concat(keywords, list_filter({k.parts("lower(title || ' ' || ns)", bind.DOMAIN)}, lambda w: NOT list_contains(keywords, w))) AS keywords), title || ' ' || ns AS tn FROM t WHERE ns <> '' AND {k.any_of('ns', bind.REQUIRED)}),
u AS (SELECT *, array_to_string([title, ns, array_to_string(keywords, ' '), source, array_to_string(region_tags, ' ')], ' ') AS ft, lower(tn) AS ts, list_filter({k.term_list(bind.REGIONS)}, lambda r: contains(tn || ' ' || array_to_string(keywords, ' '), r)) AS found FROM b),
targets AS ({TARGETS})
SELECT u.id, u.title, ns AS summary, coalesce((SELECT string_agg(entity_id, '|' ORDER BY entity_id) FROM known WHERE list_bool_or(list_transform(terms, lambda x: contains(ft, x)))), '') AS entity_ids,
 CASE WHEN {k.count_of('ts', bind.CATEGORIES['policy'])} >= {k.count_of('ts', bind.CATEGORIES['enterprise'])} AND {k.count_of('ts', bind.CATEGORIES['policy'])} >= {k.count_of('ts', bind.CATEGORIES['technology'])} THEN 'policy'
   WHEN {k.count_of('ts', bind.CATEGORIES['enterprise'])} >= {k.count_of('ts', bind.CATEGORIES['technology'])} THEN 'enterprise' ELSE 'technology' END AS category,
 CASE WHEN u.id % 10 <> 0 THEN u.url ELSE targets.target END AS resolved_url, array_to_string(keywords, '|') AS keywords, CASE WHEN len(found) = 0 THEN 'none' ELSE array_to_string(found, '|') END AS region_tags, len(found) > 0 AS is_related
FROM u JOIN targets ON u.source = targets.source_code""")
def normalize_articles(spark, d):
    hints = {c: bind.CATEGORIES[c] for c in ("policy", "enterprise", "technology")}
    out = cleaning.normalize_articles(bind.cleaned(spark, d).drop("site_url"), bind.entities(spark),
                                      urlset.best_source_target(_targets(spark, d)), bind.REQUIRED, hints, bind.DOMAIN, bind.REGIONS, "none")
    return out.select("id", "title", "summary", F.concat_ws("|", "entity_ids").alias("entity_ids"), "category", "resolved_url",
                      F.concat_ws("|", "keywords").alias("keywords"), F.concat_ws("|", "region_tags").alias("region_tags"), "is_related")
