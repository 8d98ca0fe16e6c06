"""Lexical retrieval for questions: turns, signals, scores, references and packed context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from clipworks import config
from clipworks.functions import groups, sparse
from clipworks.functions.text import let
from clipworks.sources.tables import materialize

MAX_SIGNALS = 80


def clean_turns(conversations: DataFrame, n: int = 10, key="conv_id") -> DataFrame:
    """Last ``n`` non-empty user and assistant turns of each conversation; ``from_end`` 1 is the latest."""
    tidy = F.regexp_replace(F.trim("text"), r"\s+", " ")
    rows = conversations.filter(F.col("role").isin("user", "assistant")).withColumn("text", F.trim(tidy)).filter("text <> ''")
    return groups.top_k(rows, [key], [F.desc("turn")], n, rank="from_end")


def latest_question(turns: DataFrame, key="conv_id") -> DataFrame:
    return turns.filter("role = 'user'").groupBy(key).agg(F.max_by("text", "turn").alias("question"))


def page_texts(contexts: DataFrame, key="conv_id") -> DataFrame:
    """(key, position, text): what a page adds to a question, in this order: query, region, category, source."""
    parts = F.array(*[F.struct(F.lit(i).alias("position"), F.trim(F.coalesce(c, F.lit(""))).alias("text")) for i, c in enumerate(["query", "region", "category", "source"], 1)])
    return contexts.select(key, F.explode(parts).alias("p")).select(key, "p.position", "p.text").where("text <> ''")


def extract_signals(turns: DataFrame, k: int = MAX_SIGNALS, recent: int = 6, key="conv_id", page: DataFrame | None = None) -> DataFrame:
    """``(key, value, weight, rank)``: whole texts, CJK runs and their 2- to 4-grams, Latin words; best ``k``.

    ``page`` (key, position, text) follows the turns; the last text of a question weighs most. Grams are made inside
    each text and reduced to distinct values by partial sums before the shuffle.
    """
    rows = turns.filter(F.col("from_end") <= recent).select(key, "text", (-F.col("from_end")).alias("place"))
    if page is not None:
        rows = rows.unionByName(page.select(key, "text", F.col("position").alias("place")))
    rows = rows.withColumn("last", F.col("place") == F.max("place").over(W.partitionBy(key)))  # a handful of texts a key
    low = F.lower(F.trim("text"))

    def weigh(values, weight):
        return F.transform(values, lambda v: F.struct(v.alias("value"), weight(v).alias("weight")))

    runs = F.regexp_extract_all("text", F.lit("[一-鿿]{2,24}"), F.lit(0))

    def grams(run):
        def of(n):
            starts = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))
        return F.concat(of(2), of(3), of(4))

    words = F.regexp_extract_all(low, F.lit("[a-z][a-z0-9-]{1,}"), F.lit(0))
    every = F.concat(
        F.array(F.struct(low.alias("value"), F.when(F.col("last"), 5).otherwise(3).alias("weight"))),
        weigh(runs, lambda v: F.lit(4)),
        weigh(F.flatten(F.transform(runs, grams)), lambda v: F.when(F.length(v) == 4, 2).otherwise(3)),
        weigh(words, lambda v: F.when(F.length(v) >= 6, 4).otherwise(3)))
    best = rows.select(key, F.explode(every).alias("s")).filter(F.length("s.value") >= 2).groupBy(key, "s.value").agg(F.max("s.weight").alias("weight"))
    return groups.top_k(best, [key], [F.desc("weight"), F.desc(F.length("value")), F.asc("value")], k, rank="rank")


ARTICLE_FIELDS = {"title": 6, "summary": 3, "keywords": 4, "region_tags": 3, "source": 2, "labels": 4}
REGION_FIELDS = {"name": 6, "name_en": 4, "summary": 2, "summary_en": 2, "highlights": 4}
ENTITY_FIELDS = {"name": 6, "aliases": 5, "intro": 2, "region": 3, "tags": 2}
SOURCE_FIELDS = {"text": 4}
FIELDS = {"article": ARTICLE_FIELDS, "region": REGION_FIELDS, "entity": ENTITY_FIELDS, "source": SOURCE_FIELDS}
KIND_LIMITS = {"article": 6, "region": 3, "entity": 5, "source": 3}


def item_texts(items: DataFrame, kind: str, fields: dict[str, int], id_col: str = "id") -> DataFrame:
    """(kind, item, field, strength, text): the non-empty fields of items in lower case; array fields are joined by spaces."""
    types = dict(items.dtypes)
    text = lambda n: F.lower(F.concat_ws(" ", n) if types[n].startswith("array") else F.coalesce(F.col(n), F.lit("")))
    parts = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(m).alias("strength"), text(n).alias("text")) for i, (n, m) in enumerate(fields.items())])
    rows = items.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("item"), F.explode(parts).alias("p"))
    return rows.select("kind", "item", "p.*").where("text <> ''")


#: A value starts with a piece of the largest of these sizes that it has; a piece of ``SIZES`` characters is met by its hash.
SIZES = (2, 3, 4, 6, 8, 12, 20)
#: Bits of the filter for each start, and at most; characters of text hashed at a time.
FILTER_BITS, MOST_BITS, HASHED_CHARS = 16, 1 << 27, 1_000_000


def _pieces(texts: list[str]):
    """Of some texts: (size, text number, hash) of the pieces of each size that stand anywhere in them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))
    rolled, power = np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(SIZES[-1]):
            rolled[:max(0, len(codes) - k)] += (codes[k:] + np.uint64(1)) * power
            power *= np.uint64(0x9E3779B97F4A7C15)
            if k + 1 in SIZES:
                at = np.flatnonzero(left >= k + 1)
                h = (rolled[at] + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                yield k + 1, row[at], (h ^ (h >> np.uint64(32))).view(np.int64)


@F.arrow_udf(LongType())
def _start(value: pa.Array) -> pa.Array:
    """The hash of the piece that a value of at least two characters starts with."""
    texts = [v[:max(n for n in SIZES if n <= len(v))] for v in value.to_pylist()]
    length, out = np.fromiter(map(len, texts), np.int64, len(texts)), np.zeros(len(texts), np.int64)
    for size, row, h in _pieces(texts):
        whole = length[row] == size
        out[row[whole]] = h[whole]
    return pa.array(out)


def _offered(bits):
    """UDF: the distinct hashes of a text's pieces that the filter lets through."""

    @F.arrow_udf(ArrayType(LongType()))
    def offered(text: pa.Array) -> pa.Array:
        mask, out = np.int64(len(bits.value) * 8 - 1), []
        texts = text.to_pylist()
        length = np.cumsum([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(length // HASHED_CHARS)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, row, h in _pieces(texts[lo:hi]):
                place = h & mask
                some = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                rows.append(row[some])
                hashes.append(h[some])
            row, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(first), pa.array(h)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return offered


def _filter(starts: DataFrame, count: int) -> np.ndarray:
    """A bitmap of hashes, ``FILTER_BITS`` bits for each at first; a few megabytes whatever the input."""
    size = 1 << min(max(16, (count * FILTER_BITS).bit_length()), MOST_BITS.bit_length() - 1)
    place = F.col("start").bitwiseAND(F.lit(size - 1))
    runs = starts.groupBy(F.floor(place / 32768).alias("run")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for run, bits in runs:
        out[run * 4096:(run + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def postings(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(kind, item, value, strength): which of ``values`` (value) stand in which item, with the strengths of their fields summed.

    Values of all questions meet the texts of all items once, by the piece of up to 20 characters that they start with; a
    text offers only pieces that a filter of all starts lets through. So a meeting is nearly always a hit, and work follows
    the texts and their hits, whatever the number of questions. Hits are verified in the text.
    """
    values = values.select("value").where(F.length("value") >= 2).distinct()
    starts = materialize(values.select("value", _start("value").alias("start")))
    bits = texts.sparkSession.sparkContext.broadcast(_filter(starts, starts.count()))
    place = ["kind", "item", "field"]
    spots = texts.where("text <> ''").select(*place, F.explode(_offered(bits)("text")).alias("start"))
    met = spots.join(starts, "start").drop("start").join(texts, place).where(F.contains("text", "value"))
    return met.groupBy("kind", "item", "value").agg(F.sum("strength").alias("strength"))


def constant_scores(signals: DataFrame, contexts: DataFrame, anchors: dict, key="conv_id") -> DataFrame:
    """(key, kind, base, bias): what a question's signals score in the fixed words of each kind, and the page's bias for it."""
    weight = _signal_weight()
    hit = lambda kind: F.sum(F.when(F.contains(F.lit(anchors[kind][0].lower()), F.col("value")), weight * anchors[kind][1]).otherwise(0)).alias(kind)
    sums = signals.groupBy(key).agg(*[hit(kind) for kind in anchors])
    bias = F.create_map(*[x for page, kinds in config.PAGE_BIAS.items() for x in (F.lit(page), F.create_map(*[y for kind, b in kinds.items() for y in (F.lit(kind), F.lit(b))]))])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(kind, F.lit(0)).alias("base"), F.coalesce(bias[F.col("page")], bias["other"])[kind].alias("bias")) for kind in anchors])
    return contexts.select(key, "page").join(sums, key, "left").select(key, F.explode(kinds).alias("k")).select(key, "k.*")


def _signal_weight():
    return F.col("weight") * F.when(F.length("value") >= 6, 2).otherwise(1)


def wanted_features(signals: DataFrame, facets: DataFrame | None, kinds, key="conv_id") -> DataFrame:
    """(key, kind, feature, main, weight): signals for every kind, and ``facets`` (key, kind, facet, weight) as boosts."""
    every = F.explode(F.array(*[F.lit(kind) for kind in kinds])).alias("kind")
    main = signals.select(key, every, F.concat(F.lit("t:"), "value").alias("feature"), F.lit(True).alias("main"), _signal_weight().alias("weight"))
    if facets is None:
        return main
    return main.unionByName(facets.select(key, "kind", F.concat(F.lit("f:"), "facet").alias("feature"), F.lit(False).alias("main"), "weight"))


def retrieve(signals: DataFrame, contexts: DataFrame, texts: DataFrame, facets: DataFrame | None = None, item_facets: DataFrame | None = None,
             limits: dict | None = None, anchors: dict | None = None, key="conv_id", item_postings: DataFrame | None = None) -> DataFrame:
    """(key, kind, item, base, boost, score, rank): the best items of each kind for every question at once.

    signals(key, value, weight): of all questions; contexts(key, page): one row per question. ``texts`` as ``item_texts``
    gives them. ``facets`` (key, kind, facet, weight) boost the items that have them in ``item_facets`` (kind, item, facet).
    One question or a million: the same plan, in which only items that can be among the best are met.
    """
    limits, anchors = limits or KIND_LIMITS, config.ANCHORS if anchors is None else anchors
    signals = materialize(signals.select(key, "value", "weight"))
    found = postings(texts, signals) if item_postings is None else item_postings
    offers = found.select("kind", "item", F.concat(F.lit("t:"), "value").alias("feature"), "strength")
    if item_facets is not None:
        offers = offers.unionByName(item_facets.select("kind", "item", F.concat(F.lit("f:"), "facet").alias("feature"), F.lit(1).cast("bigint").alias("strength")).distinct())
    constants = constant_scores(signals, contexts, {kind: anchors.get(kind, ("", 0)) for kind in limits}, key)
    first = groups.top_k(texts.select("kind", "item").distinct(), ["kind"], [F.asc("item")], max(limits.values()))
    return sparse.best_matches(wanted_features(signals, facets, limits, key), materialize(offers), limits, constants, first, key)


def page_facets(contexts: DataFrame, articles: DataFrame, key="conv_id") -> DataFrame:
    """(key, kind, facet, weight): the boosts of a page's category, source, region and current article.

    contexts(key, category, source, region, current_id). The current article's source counts as the page's when the page
    names none. Its keywords boost other articles; for itself they are taken off again.
    """
    now = articles.select(F.col("id").alias("current_id"), F.col("source").alias("current_source"), F.array_distinct("keywords").alias("words"))
    seen = contexts.join(now, "current_id", "left")
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    named = lambda name, value: F.concat(F.lit(name + "="), value)
    known, words = F.col("current_source").isNotNull(), F.coalesce("words", F.array().cast("array<string>"))
    current = named("id", F.when(known, F.col("current_id").cast("string")))
    source = F.coalesce(text("source"), F.col("current_source"))
    boosts = [
        ("article", named("category", text("category")), F.lit(20)), ("article", named("source", source), F.lit(20)), ("article", named("region", text("region")), F.lit(28)),
        ("article", current, 240 - 5 * F.size(words)), ("region", named("id", text("region")), F.lit(240)), ("region", named("article", F.when(known, F.col("current_id").cast("string"))), F.lit(24)),
        ("entity", named("region", text("region")), F.lit(22)), ("entity", named("article", F.when(known, F.col("current_id").cast("string"))), F.lit(18)),
        ("source", named("name", source), F.lit(240)), ("source", named("current", F.col("current_source")), F.lit(30)),
    ]
    fixed = [F.struct(F.lit(kind).alias("kind"), facet.alias("facet"), weight.alias("weight")) for kind, facet, weight in boosts]
    shared = F.transform(words, lambda w: F.struct(F.lit("article").alias("kind"), F.concat(F.lit("keyword="), w).alias("facet"), F.lit(5).alias("weight")))
    return seen.select(key, F.explode(F.concat(F.array(*fixed), shared)).alias("b")).select(key, "b.*").where("facet IS NOT NULL")


def with_current_source(contexts: DataFrame, articles: DataFrame) -> DataFrame:
    """``contexts`` whose empty source is the current article's."""
    now = articles.select(F.col("id").alias("current_id"), F.col("source").alias("_own"))
    return contexts.join(now, "current_id", "left").withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), "_own")).drop("_own")


def facets_of(items: DataFrame, kind: str, id_col: str, facets: dict) -> DataFrame:
    """(kind, item, facet) of the named values of items; array values give one facet each."""
    types = dict(items.dtypes)

    def named(name, column):
        values = F.col(column) if types[column].startswith("array") else F.array(column)
        given = F.transform(F.array_compact(values), lambda v: F.concat(F.lit(name + "="), v.cast("string")))
        return F.coalesce(given, F.array().cast("array<string>"))

    listed = [named(name, column) for name, column in facets.items()]
    return items.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("item"), F.explode(F.concat(*listed)).alias("facet"))


def references(hits: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` distinct references ``(type, label, href)`` in hit order, with the number of hits."""
    total = hits.count()
    named = hits.filter("href <> '' OR label <> ''").groupBy("type", "label", "href").agg(F.min(F.struct("kind_order", "position")).alias("o"))
    return named.orderBy("o", "label").limit(k).select("type", "label", "href", F.lit(total).cast("bigint").alias("hit_count"))


def pack_context(sections: DataFrame, budget: int = config.CONTEXT_BUDGET, key="conv_id", glue="\n\n") -> DataFrame:
    """Sections in order while the text stays within the budget; one that does not fit is skipped.

    sections(key, position, section): a question has a handful of sections, so each fold is short.
    """
    joined = sections.filter("section <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "section"))).alias("s"))

    def add(acc, item):
        longer = F.when(acc == "", item["section"]).otherwise(F.concat(acc, F.lit(glue), item["section"]))
        return let(longer, lambda t: F.when(F.length(t) > budget, acc).otherwise(t))

    return joined.select(key, F.aggregate("s", F.lit(""), add).alias("context"))
