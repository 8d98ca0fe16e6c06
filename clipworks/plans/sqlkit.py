"""Snippets of DuckDB SQL for the oracles (written apart from the Spark expressions)."""

from __future__ import annotations

from clipworks.sources.bind import ARTICLES, SOURCES


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def artifact(x: str) -> str:
    return (f"(contains(lower({x}), 'javascript') OR contains(lower({x}), 'window.') "
            f"OR contains(lower({x}), 'function(') OR length({x}) > 1024)")


def title(x: str) -> str:
    cut = f"trim(regexp_replace({clean(x)}, '\\s*[-|_].*$', ''))"
    return f"CASE WHEN {artifact(cut)} THEN '' ELSE {cut} END"


def summary(x: str) -> str:
    cut = f"substr({clean(x)}, 1, 260)"
    return f"CASE WHEN {artifact(cut)} THEN '' ELSE {cut} END"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def count_of(x: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(t.lower())}) AS INTEGER)" for t in terms) + ")"


def term_list(terms) -> str:
    return "[" + ", ".join(q(t) for t in terms) + "]"


def words(x: str, terms) -> str:
    """List of terms found as whole words of lower-cased text, in list order."""
    return f"list_filter({term_list(terms)}, lambda t: regexp_matches({x}, '\\b' || lower(t) || '\\b'))"


def parts(x: str, terms) -> str:
    """List of terms contained in lower-cased text, in list order."""
    return f"list_filter({term_list(terms)}, lambda t: contains({x}, lower(t)))"


def joined(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


def host(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '')"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"


def canonical(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(coalesce({x}, '')), '#.*$', ''), '/+$', '')"


def natural(x: str, terms, min_len: int = 12) -> str:
    """Summary by first qualifying sentence, else a window of the whole text."""
    t = clean(x)
    marked = f"regexp_replace({t}, '([。！？.!?])\\s*', '\\1' || chr(1), 'g')"
    sentence = (f"list_filter(string_split({marked}, chr(1)), lambda s: length(trim(s)) >= {min_len} "
                f"AND {any_of('s', terms)})[1]")
    chosen = f"coalesce(nullif(trim({sentence}), ''), {t})"
    return f"CASE WHEN {any_of(t, terms)} THEN {snippet(chosen, terms)} ELSE '' END"


def snippet(x: str, terms) -> str:
    spots = ", ".join(f"nullif(instr({x}, {q(t)}), 0)" for t in terms)
    start = f"greatest(coalesce(least({spots}), 1) - 91, 0)"
    return f"CASE WHEN length({x}) <= 260 THEN {x} ELSE trim(substr({x}, {start} + 1, 260)) END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def with_articles(body: str) -> str:
    return f"WITH articles AS ({ARTICLES}) {body}"


def with_model(body: str) -> str:
    return f"WITH articles AS ({ARTICLES}), sources AS ({SOURCES}) {body}"


from clipworks.sources.bind import CATEGORIES, CORE, DOMAIN, ENTITIES, LOW, REGIONS, REQUIRED  # noqa: E402

ENTITY_TERMS = [t for _, name, aliases in ENTITIES for t in [name, *aliases]]
ENTITY_TABLE = " UNION ALL ".join(
    f"SELECT {q(i)} AS entity_id, {q(n)} AS name, {term_list([n, *a])} AS terms" for i, n, a in ENTITIES)


def category_sql(x: str) -> str:
    e, p, t = (count_of(x, CATEGORIES[c]) for c in ("enterprise", "policy", "technology"))
    return (f"CASE WHEN {e} > {p} AND {e} >= {t} THEN 'enterprise' WHEN {p} >= {e} AND {p} >= {t} THEN 'policy' "
            f"ELSE 'technology' END")


RAW_SUMMARY = "CASE id % 6 WHEN 0 THEN title WHEN 1 THEN 'eren pour nothing of this is in the body' ELSE '' END"

# Clean articles with their source's fields, as the review and audit oracles see them.
CLEANED = f"""
articles AS ({ARTICLES}), sources AS ({SOURCES}), known AS ({ENTITY_TABLE}),
c0 AS (SELECT a.id, a.source, a.language, a.published_at, a.url, {title('a.title')} AS title, {clean('a.body')} AS body,
              {summary(RAW_SUMMARY.replace('title', 'a.title').replace('id %', 'a.id %'))} AS raw_summary,
              {canonical('a.url')} AS original_url, s.* EXCLUDE (language)
       FROM articles a JOIN sources s ON a.source = s.source_code),
c1 AS (SELECT * EXCLUDE (raw_summary), CASE WHEN raw_summary <> '' THEN raw_summary ELSE {natural('body', REQUIRED)} END AS summary FROM c0),
c2 AS (SELECT *, lower(title || ' ' || summary || ' ' || body) AS hay FROM c1),
c3 AS (SELECT *, list_slice(list_concat({parts('hay', DOMAIN)}, list_filter(whitelist, lambda w: contains(hay, w))), 1, 10) AS keywords FROM c2),
c4 AS (SELECT *, title || ' ' || summary || ' ' || body || ' ' || array_to_string(keywords, ' ') AS full_text FROM c3),
cleaned AS (SELECT * EXCLUDE (hay, full_text),
   CASE WHEN len(list_filter({term_list(REGIONS)}, lambda t: contains(full_text, t))) = 0 THEN ['none']
        ELSE list_slice(list_filter({term_list(REGIONS)}, lambda t: contains(full_text, t)), 1, 3) END AS region_tags,
   {category_sql('lower(full_text)')} AS category FROM c4)
"""


def with_cleaned(body: str) -> str:
    return f"WITH {CLEANED} {body}"


CURRENT = f"""
cur AS (SELECT id, source, language, published_at, url, {clean('title')} AS title, {natural('body', REQUIRED)} AS summary,
   {parts('lower(body)', DOMAIN)} AS keywords,
   CASE WHEN {any_of('body', REGIONS)} THEN list_slice({parts('body', REGIONS)}, 1, 3) ELSE ['none'] END AS region_tags,
   {any_of('body', REGIONS)} AS is_related,
   CASE id % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'technology' ELSE 'policy' END AS category,
   list_filter([{', '.join(f"CASE WHEN {any_of('body', [n, *a])} THEN {q(i)} END" for i, n, a in ENTITIES)}], lambda e: e IS NOT NULL) AS entity_ids
 FROM ({ARTICLES}))
"""

# The same with the whole body as summary, for queries that look for words in all of an article.
CURRENT_WHOLE = CURRENT.replace(f"{natural('body', REQUIRED)} AS summary", f"{clean('body')} AS summary")


def with_current(body: str) -> str:
    return f"WITH {CURRENT} {body}"
