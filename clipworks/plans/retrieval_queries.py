"""Question-context retrieval over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks import config
from clipworks.operators import retrieval
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table, materialize

TURNS = """t0 AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE role IN ('user', 'assistant')),
turns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM t0 WHERE text <> '') WHERE from_end <= 10)"""


def turns(spark, d):
    return retrieval.clean_turns(load_table(spark, d, "conversations"))


@query("rt1_clean_turns", f"WITH {TURNS} SELECT conv_id, turn, role, text, from_end FROM turns")
def clean_turns(spark, d):
    return turns(spark, d).select("conv_id", "turn", "role", "text", "from_end")


@query("rt1_latest_question", f"WITH {TURNS} SELECT conv_id, arg_max(text, turn) AS question FROM turns WHERE role = 'user' GROUP BY 1")
def latest_question(spark, d):
    return retrieval.latest_question(turns(spark, d))


SIGNALS = f"""{TURNS}, r6 AS (SELECT * FROM turns WHERE from_end <= 6),
s0 AS (SELECT conv_id, lower(text) AS value, CASE WHEN from_end = 1 THEN 5 ELSE 3 END AS w FROM r6
 UNION ALL SELECT conv_id, v, CASE WHEN length(v) >= 6 THEN 4 ELSE 3 END FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{1,}}')) AS v FROM r6)
 UNION ALL SELECT conv_id, '中文信号', 4 FROM r6 UNION ALL SELECT conv_id, unnest(['中文', '文信', '信号', '中文信', '文信号']), 3 FROM r6 UNION ALL SELECT conv_id, '中文信号', 2 FROM r6),
sig AS (SELECT conv_id, value, CAST(max(w) AS BIGINT) AS weight FROM s0 WHERE length(value) >= 2 GROUP BY 1, 2),
signals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, length(value) DESC, value) AS rank FROM sig) WHERE rank <= 80)""".replace("{{", "{").replace("}}", "}")
SIGNALS = SIGNALS.replace("lower(text) AS value", "lower(text || ' 中文信号') AS value").replace("regexp_extract_all(lower(text)", "regexp_extract_all(lower(text || ' ')")


def signals_of(spark, d):
    with_cjk = turns(spark, d).withColumn("text", F.concat("text", F.lit(" 中文信号")))
    return retrieval.extract_signals(with_cjk)


@query("rt2_signals", f"WITH {SIGNALS} SELECT conv_id, value, weight, rank FROM signals")
def signals(spark, d):
    return signals_of(spark, d)


PAGE_LIST = k.term_list(bind.PAGES_OF_SITE)
CONTEXTS = f"""ctx0 AS (SELECT DISTINCT conv_id AS n FROM conversations),
ctx1 AS (SELECT n AS conv_id, {PAGE_LIST}[n % 8 + 1] AS page, CASE WHEN n % 4 = 1 THEN 'erin' ELSE '' END AS query, CASE WHEN n % 16 = 1 THEN 'src5' ELSE '' END AS src,
  CASE WHEN n % 8 = 1 THEN {k.term_list(bind.CATEGORIES)}[n % 3 + 1] ELSE '' END AS cat, CASE WHEN n % 8 IN (3, 4) THEN {k.term_list(bind.REGIONS)}[n % 7 + 1] ELSE '' END AS region, CASE WHEN n % 8 = 2 THEN n * 7 % 97 END AS current_id FROM ctx0),
ctx AS (SELECT ctx1.* EXCLUDE (src), CASE WHEN src <> '' THEN src ELSE coalesce(c.source, '') END AS src, c.id IS NOT NULL AS known, c.source AS own, coalesce(c.keywords, []) AS words FROM ctx1 LEFT JOIN cur c ON c.id = current_id)"""

# The prose has no CJK runs, so whole texts and Latin words are all signals there are.
PAGE_SIGNALS = f"""{k.CURRENT}, {TURNS}, {CONTEXTS},
tx0 AS (SELECT conv_id, text, -from_end AS place FROM turns WHERE from_end <= 6 UNION ALL
  SELECT conv_id, x.t, x.p FROM (SELECT conv_id, unnest([{{'p': 1, 't': query}}, {{'p': 2, 't': region}}, {{'p': 3, 't': cat}}, {{'p': 4, 't': src}}]) AS x FROM ctx) WHERE x.t <> ''),
tx AS (SELECT *, place = max(place) OVER (PARTITION BY conv_id) AS last FROM tx0),
sg0 AS (SELECT conv_id, lower(text) AS value, CASE WHEN last THEN 5 ELSE 3 END AS w FROM tx
  UNION ALL SELECT conv_id, v, CASE WHEN length(v) >= 6 THEN 4 ELSE 3 END FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{1,}}')) AS v FROM tx)),
sg AS (SELECT * FROM (SELECT conv_id, value, CAST(max(w) AS BIGINT) AS weight, row_number() OVER (PARTITION BY conv_id ORDER BY max(w) DESC, length(value) DESC, value) AS rank FROM sg0 WHERE length(value) >= 2 GROUP BY 1, 2) WHERE rank <= 80)"""


def page_signals(spark, d, contexts):
    return retrieval.extract_signals(turns(spark, d), page=retrieval.page_texts(contexts))


def page_contexts(spark, d, articles):
    return materialize(retrieval.with_current_source(bind.contexts(spark, d), articles))


@query("rt2_page_signals", f"WITH {PAGE_SIGNALS} SELECT conv_id, value, weight, rank FROM sg")
def signals_with_page(spark, d):
    return page_signals(spark, d, page_contexts(spark, d, bind.current(spark, d))).select("conv_id", "value", "weight", "rank")


ITEMS = f"""{PAGE_SIGNALS}, src AS ({bind.SOURCES}),
rg AS (SELECT region, count(*) AS n, list(id) AS articles FROM (SELECT id, unnest(region_tags) AS region FROM cur) GROUP BY 1),
rw AS (SELECT region, word, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, word) AS r FROM (SELECT region, unnest(keywords) AS word FROM (SELECT keywords, unnest(region_tags) AS region FROM cur)) GROUP BY 1, 2),
regions AS (SELECT region AS id, n, articles, coalesce((SELECT string_agg(word, ' ' ORDER BY r) FROM rw WHERE rw.region = rg.region AND r <= 3), '') AS highlights FROM rg),
entities(id, name, aliases, intro, region, tags) AS (VALUES {", ".join(f"({k.q(i)}, {k.q(name)}, {k.q(' '.join(aliases))}, {k.q(f'known as {name} for the erin work')}, {k.q(bind.REGIONS[n % len(bind.REGIONS)])}, {k.q(list(bind.CATEGORIES)[n % 3])})" for n, (i, name, aliases) in enumerate(bind.ENTITIES))}),
items AS (
  SELECT 'article' AS kind, id::VARCHAR AS item, unnest([{{'m': 6, 't': title}}, {{'m': 3, 't': summary}}, {{'m': 4, 't': array_to_string(keywords, ' ')}}, {{'m': 3, 't': array_to_string(region_tags, ' ')}}, {{'m': 2, 't': source}},
    {{'m': 4, 't': CASE category {" ".join(f"WHEN {k.q(c)} THEN {k.q(words)}" for c, words in config.CATEGORY_LABELS.items())} END}}, {{'m': 2, 't': {k.q(config.ANCHORS["article"][0])}}}]) AS f FROM cur
  UNION ALL SELECT 'region', id, unnest([{{'m': 6, 't': id}}, {{'m': 4, 't': 'region of ' || id}}, {{'m': 2, 't': n || ' articles on para and pour'}}, {{'m': 4, 't': highlights}}, {{'m': 2, 't': {k.q(config.ANCHORS["region"][0])}}}]) FROM regions
  UNION ALL SELECT 'entity', id, unnest([{{'m': 6, 't': name}}, {{'m': 5, 't': aliases}}, {{'m': 2, 't': intro}}, {{'m': 3, 't': region}}, {{'m': 2, 't': tags}}, {{'m': 2, 't': {k.q(config.ANCHORS["entity"][0])}}}]) FROM entities
  UNION ALL SELECT 'source', source_code, unnest([{{'m': 4, 't': name || ' ' || type || ' ' || site_url || ' ' || {k.q(config.SOURCE_ANCHOR)} || ' ' || array_to_string(whitelist, ' ')}}]) FROM src),
fields AS (SELECT kind, item, f.m, lower(f.t) AS text FROM items),
bs AS (SELECT conv_id, kind, item, CAST(sum(weight * CASE WHEN length(value) >= 6 THEN 2 ELSE 1 END * m) AS BIGINT) AS base_score FROM sg JOIN fields ON contains(text, value) GROUP BY 1, 2, 3)"""


def article_texts(current):
    labels = F.create_map(*[F.lit(x) for pair in config.CATEGORY_LABELS.items() for x in pair])
    return retrieval.item_texts(current.withColumn("labels", labels[F.col("category")]), "article", retrieval.ARTICLE_FIELDS)


@query("rt3_score_fields", f"""WITH {ITEMS} SELECT conv_id, item, base_score, rank FROM (SELECT conv_id, item, base_score, row_number() OVER (PARTITION BY conv_id ORDER BY base_score DESC, item) AS rank FROM bs WHERE kind = 'article') WHERE rank <= 20""")
def score_fields(spark, d):
    current = bind.current(spark, d)
    contexts = page_contexts(spark, d, current)
    out = retrieval.retrieve(page_signals(spark, d, contexts), contexts, materialize(article_texts(current)), limits={"article": 20})
    return out.select("conv_id", "item", F.col("base").alias("base_score"), "rank")


BIAS = "CASE page " + " ".join(f"WHEN {k.q(p)} THEN CASE kind " + " ".join(f"WHEN {k.q(kind)} THEN {b}" for kind, b in kinds.items()) + " END" for p, kinds in config.PAGE_BIAS.items()) + " END"
HITS = f"""{ITEMS}, pairs AS (SELECT conv_id, kind, item FROM ctx, (SELECT DISTINCT kind, item FROM fields)),
boosts AS (SELECT conv_id, 'article' AS kind, c.id::VARCHAR AS item, CASE WHEN cat <> '' AND category = cat THEN 20 ELSE 0 END + CASE WHEN src <> '' AND c.source = src THEN 20 ELSE 0 END
    + CASE WHEN c.id = current_id THEN 240 WHEN known THEN 5 * len(list_intersect(c.keywords, words)) ELSE 0 END + CASE WHEN region <> '' AND list_contains(region_tags, region) THEN 28 ELSE 0 END AS boost FROM ctx, cur c
  UNION ALL SELECT conv_id, 'region', r.id, CASE WHEN r.id = region THEN 240 ELSE 0 END + CASE WHEN known AND list_contains(articles, current_id) THEN 24 ELSE 0 END FROM ctx, regions r
  UNION ALL SELECT conv_id, 'entity', e.id, CASE WHEN ctx.region <> '' AND e.region = ctx.region THEN 22 ELSE 0 END + CASE WHEN known AND (SELECT list_contains(entity_ids, e.id) FROM cur WHERE cur.id = current_id) THEN 18 ELSE 0 END FROM ctx, entities e
  UNION ALL SELECT conv_id, 'source', source_code, CASE WHEN name = src THEN 240 ELSE 0 END + CASE WHEN name = own THEN 30 ELSE 0 END FROM ctx, src s),
hits AS (SELECT conv_id, kind, item, coalesce(base_score, 0) AS base_score, coalesce(base_score, 0) + CASE WHEN base_score > 0 THEN {BIAS} ELSE 0 END + coalesce(boost, 0) AS score
  FROM boosts FULL JOIN bs USING (conv_id, kind, item) JOIN ctx USING (conv_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY score DESC, item) AS rank FROM hits WHERE score > 0)
SELECT conv_id, kind, item, base_score, score, rank FROM top WHERE rank <= CASE kind WHEN 'article' THEN 6 WHEN 'entity' THEN 5 ELSE 3 END"""


def hits(spark, d):
    current = materialize(bind.current(spark, d))
    contexts = page_contexts(spark, d, current)
    regions, entities, sources = materialize(bind.regions(current)), bind.entity_items(spark, current), bind.source_items(spark, d)
    texts = article_texts(current)
    for items, kind in ((regions, "region"), (entities, "entity"), (sources, "source")):
        texts = texts.unionByName(retrieval.item_texts(items, kind, retrieval.FIELDS[kind]))
    facets = retrieval.facets_of(current, "article", "id", {"category": "category", "source": "source", "region": "region_tags", "id": "id", "keyword": "keywords"})
    facets = facets.unionByName(retrieval.facets_of(regions, "region", "id", {"id": "id", "article": "articles"})).unionByName(retrieval.facets_of(entities, "entity", "id", {"region": "region", "article": "articles"}))
    facets = facets.unionByName(retrieval.facets_of(sources, "source", "id", {"name": "name", "current": "name"}))
    return retrieval.retrieve(page_signals(spark, d, contexts), contexts, materialize(texts), retrieval.page_facets(contexts, current), facets)


@query("rt4_retrieve", f"WITH {HITS}")
def retrieve(spark, d):
    return hits(spark, d).select("conv_id", "kind", "item", F.col("base").alias("base_score"), "score", "rank")


@query("rt5_references", """WITH h AS (SELECT 'source' AS type, source AS label, '/sources' AS href, doc_id AS pos FROM documents UNION ALL SELECT 'lang', lang, '', doc_id FROM documents)
SELECT type, label, href, (SELECT count(*) FROM h) AS hit_count FROM (SELECT type, label, href, min((CASE type WHEN 'source' THEN 1 ELSE 0 END, pos)) AS o FROM h GROUP BY 1, 2, 3) ORDER BY o, label LIMIT 10""")
def references(spark, d):
    docs = load_table(spark, d, "documents")
    row = lambda kind, order, label, href: docs.select(F.lit(kind).alias("type"), F.col(label).alias("label"), F.lit(href).alias("href"), F.lit(order).alias("kind_order"), F.col("doc_id").alias("position"))
    return retrieval.references(row("source", 1, "source", "/sources").unionByName(row("lang", 0, "lang", "")))


@query("rt6_pack_context", f"""WITH RECURSIVE {TURNS}, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM turns),
f AS (SELECT conv_id, 0 AS i, '' AS c FROM s GROUP BY 1 UNION ALL SELECT f.conv_id, s.i, CASE WHEN length(CASE WHEN f.c = '' THEN s.text ELSE f.c || chr(10) || chr(10) || s.text END) > 900 THEN f.c
  WHEN f.c = '' THEN s.text ELSE f.c || chr(10) || chr(10) || s.text END FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, arg_max(c, i) AS context FROM f GROUP BY 1""")
def pack_context(spark, d):
    sections = turns(spark, d).select("conv_id", F.col("turn").alias("position"), F.col("text").alias("section"))
    return retrieval.pack_context(sections, 900)
