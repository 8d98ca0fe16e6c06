"""Summaries, term hits, keywords, regions, categories and entities of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import groups, html, terms, text
from clipworks.functions.text import col_of, let

MAX_LITERAL_TERMS = 400


def choose_summary(df: DataFrame, required=config.REQUIRED_TERMS, body="body", out="summary") -> DataFrame:
    return df.withColumn(out, terms.natural_summary(body, required))


def snippet_around(df: DataFrame, required=config.REQUIRED_TERMS, col="body", before=config.SNIPPET_BEFORE,
                   width=config.SUMMARY_MAX, out="snippet") -> DataFrame:
    return df.withColumn(out, terms.snippet(col, required, before, width))


def excerpt(pages: DataFrame, min_len=40, good_len=60, cap=220, out="excerpt") -> DataFrame:
    """First paragraph of ``good_len`` characters, else the first one, cut at ``cap``."""
    found = pages.withColumn("_p", html.paragraphs("html", min_len))
    first_good = F.try_element_at(F.filter("_p", lambda p: F.length(p) >= good_len), F.lit(1))
    pick = F.coalesce(first_good, F.get("_p", F.lit(0)), F.lit(""))
    return found.withColumn(out, F.substring(pick, 1, cap)).drop("_p")


def flag_summary_in_body(df: DataFrame, summary="summary", body="body", out="summary_in_body") -> DataFrame:
    return df.withColumn(out, terms.contained(summary, body))


def flag_title_only(df: DataFrame, title="title", summary="summary", out="title_only") -> DataFrame:
    return df.withColumn(out, (text.clean(title) != "") & (text.clean(title) == text.clean(summary)))


def real_terms(table: DataFrame, col="term") -> DataFrame:
    """Rows whose term is neither null nor blank."""
    return table.filter(F.trim(col) != "")


def match_terms(df: DataFrame, term_list, id_col="id", col="body", word_boundary=False, ignore_case=False) -> DataFrame:
    """Long table ``(id, term)`` of the terms found in a text column.

    A list, or a term table that proves small, becomes plain searches inside one scan of the documents.
    A larger table meets the documents in an equi-join on the first ``ANCHOR`` characters of each term.
    Null and blank terms match nothing, whichever way is taken.
    """
    if isinstance(term_list, DataFrame):
        table = real_terms(term_list.select(F.col(term_list.columns[0]).alias("term"))).distinct()
        rows = groups.bounded(table, MAX_LITERAL_TERMS)
        if rows is None:
            return match_term_table(df, table, id_col, col, word_boundary, ignore_case)
        term_list = sorted(r.term for r in rows)
    term_list = [t for t in term_list if t and t.strip()]
    hay = F.lower(col_of(col)) if ignore_case or word_boundary else col_of(col)
    if ignore_case or word_boundary:
        found = terms.matched(F.col("_hay"), term_list, word_boundary)
    else:
        found = terms.keep((t, F.contains(F.col("_hay"), F.lit(t))) for t in term_list)
    return df.select(id_col, hay.alias("_hay")).select(id_col, F.explode(found).alias("term"))


ANCHOR = 6


def match_term_table(df, table, id_col, col, word_boundary=False, ignore_case=False) -> DataFrame:
    """Term tables of any size: documents and terms meet on the first characters of each term, then the hit is verified.

    Anchors have up to six characters, so few wrong pairs arise; a document offers each distinct piece once. A table that
    is broadcast meets the texts where they lie. With a larger one the text itself is not carried through the meeting
    join, only ids are.
    """
    fold = F.lower if ignore_case or word_boundary else (lambda c: c)
    docs = df.select(F.col(id_col), fold(F.coalesce(F.col(col), F.lit(""))).alias("_hay"))
    size = F.least(F.length("term"), F.lit(ANCHOR))
    keyed = table.filter(F.length("term") >= 1).select("term", F.substring(fold(F.col("term")), F.lit(1), size).alias("_start"))
    sizes = [r.n for r in keyed.select(F.length("_start").alias("n")).distinct().limit(ANCHOR).collect()]
    if not sizes:
        return docs.limit(0).select(id_col, F.lit("").alias("term"))
    pieces = F.concat(*[F.regexp_extract_all("_hay", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes])
    small = bounded_terms(keyed)
    offered = F.explode(F.array_distinct(pieces)).alias("_start")
    needle = fold(F.col("term"))
    hit = F.contains(F.col("_hay"), needle)
    if word_boundary:
        bounded = F.concat(F.lit(rf"(?<!{terms.WORD})\Q"), needle, F.lit(rf"\E(?!{terms.WORD})"))
        hit = hit & (needle.rlike("[一-龥]") | F.regexp_like(F.col("_hay"), bounded))
    if small is not None:
        return docs.select(id_col, "_hay", offered).join(small, "_start").filter(hit).select(id_col, "term")
    pairs = docs.select(id_col, offered).join(keyed, "_start").select(id_col, "term")
    return pairs.join(docs, id_col).filter(hit).select(id_col, "term")


def bounded_terms(keyed: DataFrame, rows: int = groups.SMALL_SIDE, chars: int = 4_000_000):
    """``keyed`` (term, _start) for a broadcast, if it proves to hold few terms and characters, else None."""
    some = keyed.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    return F.broadcast(keyed) if some.n <= rows and some.chars <= chars else None


def resolve_alias_term(df: DataFrame, alias_map: dict, col="body", out="canonical_term") -> DataFrame:
    """First canonical term, in map order, one of whose aliases is in the text; else ''."""
    df = df.withColumn("_low", F.lower(col_of(col))).withColumn("_norm", terms.spaced(F.col("_low")))
    picks = []
    for canonical, aliases in alias_map.items():
        cond = F.lit(False)
        for a in aliases:
            cond = cond | terms.hit(F.col("_low"), F.col("_norm"), a, True)
        picks.append(F.when(cond, F.lit(canonical)))
    return df.withColumn(out, F.coalesce(*picks, F.lit(""))).drop("_low", "_norm")


def keyword_list(hay, raw, whitelist, domain_terms, k):
    """Column: given keywords, then domain terms, then source terms found in lower-cased text; first ``k``."""
    given = F.filter(F.transform(raw, text.clean), lambda w: F.length(w) >= 2)
    own = F.filter(F.transform(whitelist, text.clean), lambda w: (w != "") & F.contains(hay, F.lower(w)))
    found = terms.matched(hay, domain_terms, word_boundary=False)
    return F.slice(F.array_distinct(F.concat(given, found, own)), 1, k)


def extract_keywords(df: DataFrame, domain_terms=config.DOMAIN_TERMS, sources: DataFrame | None = None, key="source",
                     k=config.KEYWORD_LIMIT) -> DataFrame:
    """``keywords`` from title, summary and body; columns ``raw_keywords`` and the source's ``whitelist`` may add to them."""
    if sources is not None:
        df = df.join(groups.small_side(sources.select(F.col("source_code").alias(key), "whitelist")), key, "left")
    empty = F.array().cast("array<string>")
    raw = F.coalesce(F.col("raw_keywords"), empty) if "raw_keywords" in df.columns else empty
    white = F.coalesce(F.col("whitelist"), empty) if "whitelist" in df.columns else empty
    hay = F.lower(F.concat_ws(" ", "title", "summary", "body"))
    return df.withColumn("_hay", hay).withColumn("keywords", keyword_list(F.col("_hay"), raw, white, domain_terms, k)).drop("_hay")


def matching_text():
    """Column: the short fields that tagging looks at, joined by spaces."""
    return F.concat_ws(" ", "title", "summary", F.concat_ws(" ", "keywords"), "source", F.concat_ws(" ", "region_tags"))


def score_keywords(df: DataFrame, entities, phrases=config.DOMAIN_PHRASES, stopwords=config.LATIN_STOPWORDS,
                   blocked=config.BLOCKED_KEYWORDS, k=config.KEYWORD_LIMIT, id_col="id") -> DataFrame:
    """Weighted keyword bag ``(id, term, weight, rank)``: given 4, entity 3, phrase 2, title part 1, Latin word 1 each."""
    df = df.withColumn("_full", matching_text()).withColumn("_low", F.lower("_full"))

    def weigh(values, weight):
        return F.transform(values, lambda v: F.struct(v.alias("term"), F.lit(weight).alias("weight")))

    named = []
    for name, aliases in entities:
        named.append((name, terms.any_term(F.col("_full"), [name, *aliases])))
    title_parts = F.filter(F.transform(F.split(html.decode_entities("title"), "[：:，,、|｜]"), text.clean),
                           lambda p: F.length(p).between(3, 18))
    latin = F.filter(F.regexp_extract_all("_full", F.lit("[A-Za-z][A-Za-z-]{2,}"), F.lit(0)),
                     lambda w: ~F.lower(w).isin(list(stopwords)))
    bag = F.concat(
        weigh(F.col("keywords"), 4), weigh(terms.keep(named), 3),
        weigh(terms.matched(F.col("_low"), phrases, word_boundary=False), 2), weigh(title_parts, 1), weigh(latin, 1))
    rows = df.select(id_col, F.explode(bag).alias("e")).select(
        id_col, text.keyword_term("e.term", blocked).alias("term"), F.col("e.weight").alias("weight")).filter("term <> ''")
    summed = rows.groupBy(id_col, "term").agg(F.sum("weight").alias("weight"))
    return groups.top_k(summed, [id_col], [F.desc("weight"), F.asc("term")], k, rank="rank")


def region_list(body, region_terms, default):
    found = F.slice(terms.keep((t, F.contains(body, F.lit(t))) for t in region_terms), 1, config.REGION_TAG_LIMIT)
    return let(found, lambda f: F.when(F.size(f) == 0, terms.strings([default])).otherwise(f))


def tag_regions(df: DataFrame, region_terms=config.REGION_TERMS, default=config.DEFAULT_REGION_TAG, col="body") -> DataFrame:
    """First three region terms in list order as ``region_tags`` (else the default), and ``is_related``."""
    df = df.withColumn("region_tags", region_list(F.col(col), region_terms, default))
    return df.withColumn("is_related", F.get("region_tags", F.lit(0)) != default)


def resolve_regions(df: DataFrame, regions: DataFrame, themes: DataFrame, entities: DataFrame, parent: str | None = None,
                    id_col="id") -> DataFrame:
    """``(id, region_id)``: by tag, mention in the text, theme, and entity; a parent region is added to all.

    regions(term, region_id) · themes(term, region_id) · entities(entity_id, region_ids).
    Tags are part of the searched text, so one search finds tags and mentions alike.
    """
    wanted = real_terms(regions.select("term", "region_id").unionByName(themes.select("term", "region_id")))
    rows = groups.bounded(wanted, MAX_LITERAL_TERMS)
    docs = df.select(id_col, "entity_ids", matching_text().alias("_full"))
    if rows is None:
        said = match_term_table(docs, wanted.select("term").distinct(), id_col, "_full").join(wanted, "term")
        found = said.groupBy(id_col).agg(F.collect_set("region_id").alias("_found"))
        docs = docs.join(found, id_col, "left").withColumn("_found", F.coalesce("_found", terms.strings([])))
    else:
        docs = docs.withColumn("_found", terms.keep((r.region_id, F.contains(F.col("_full"), F.lit(r.term))) for r in rows))
    of_entity = entities.select("entity_id", "region_ids")
    linked = docs.select(id_col, "_found", F.explode_outer("entity_ids").alias("entity_id")).join(groups.small_side(of_entity), "entity_id", "left")
    own = F.coalesce("region_ids", terms.strings([]))
    if parent is not None:
        own = F.filter(own, lambda r: r != parent)
    all_ids = linked.select(id_col, F.array_union("_found", own).alias("_ids")).filter(F.size("_ids") > 0)
    return all_ids.select(id_col, F.explode(F.array_union("_ids", terms.strings([parent] if parent else []))).alias("region_id")).distinct()


def category(lower, hints):
    """Column: enterprise if above policy and not below technology, policy if below neither, else technology."""
    scores = F.struct(*[terms.count_terms(lower, hints[name]).alias(name) for name in ("enterprise", "policy", "technology")])
    return let(scores, lambda s: (
        F.when((s["enterprise"] > s["policy"]) & (s["enterprise"] >= s["technology"]), "enterprise")
        .when((s["policy"] >= s["enterprise"]) & (s["policy"] >= s["technology"]), "policy")
        .otherwise("technology")))


def classify(df: DataFrame, hints=config.CATEGORY_TERMS, col="body", out="category") -> DataFrame:
    return df.withColumn("_low", F.lower(col_of(col))).withColumn(out, category(F.col("_low"), hints)).drop("_low")


def classify_argmax(df: DataFrame, hints=config.ARGMAX_HINTS, col="body", given: str | None = None, out="category") -> DataFrame:
    """A given category wins; else the one with most hint terms, the first listed on ties."""
    df = df.withColumn("_low", F.lower(col_of(col)))
    scores = [terms.count_terms(F.col("_low"), ts) for ts in hints.values()]
    df = df.withColumn("_scores", F.array(*scores))
    best = F.get(terms.strings(hints), (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int"))
    value = F.coalesce(F.nullif(F.col(given), F.lit("")), best) if given else best
    return df.withColumn(out, value).drop("_low", "_scores")


def classify_regex(df: DataFrame, rules, default="technology", col="body", out="category") -> DataFrame:
    """First matching ``(category, pattern)`` rule."""
    value = F.coalesce(*[F.when(col_of(col).rlike(p), F.lit(c)) for c, p in rules], F.lit(default))
    return df.withColumn(out, value)


def with_entities(df: DataFrame, entities: DataFrame, col="body", id_col="id", out="entity_ids") -> DataFrame:
    """Adds the sorted ids of entities named in the text, plus the listed ids that exist.

    A whitelist that proves small is searched in place; a larger one goes through ``match_terms``.
    """
    names = F.filter(F.concat(F.array("name"), F.coalesce("aliases", terms.strings([]))), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    entities = entities.select("entity_id", F.array_distinct(names).alias("names"))
    rows = groups.bounded(entities, MAX_LITERAL_TERMS)
    listed = F.coalesce(F.col("entity_ids"), terms.strings([])) if "entity_ids" in df.columns else terms.strings([])
    if rows is not None:
        said = terms.keep((r.entity_id, terms.any_term(col_of(col), r.names)) for r in rows)
        known = F.array_intersect(listed, terms.strings([r.entity_id for r in rows]))
        return df.withColumn(out, F.array_sort(F.array_union(said, known)))
    alias = entities.select("entity_id", F.explode("names").alias("term"))
    said = match_terms(df, alias.select("term"), id_col, col).join(alias, "term").select(id_col, "entity_id")
    if "entity_ids" in df.columns:
        known = df.select(id_col, F.explode("entity_ids").alias("entity_id")).join(entities.select("entity_id"), "entity_id", "left_semi")
        said = said.unionByName(known.select(id_col, "entity_id"))
    per_doc = said.groupBy(id_col).agg(F.array_sort(F.collect_set("entity_id")).alias("_found"))
    merged = df.drop(out).join(per_doc, id_col, "left")
    return merged.withColumn(out, F.coalesce("_found", terms.strings([]))).drop("_found")


def resolve_entities(df: DataFrame, entities: DataFrame, col="body", id_col="id") -> DataFrame:
    """``(id, entity_id)``: listed ids that exist, and entities whose name or alias is in the text."""
    return with_entities(df, entities, col, id_col, "_ids").select(id_col, F.explode("_ids").alias("entity_id"))
