"""Related articles of all articles against all pairs; running sums and pages against sorted lists."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from clipworks.functions import ordered
from clipworks.operators import related, search

COLS = "id long, keywords array<string>, entity_ids array<string>, category string, is_related boolean, language string, published_at timestamp_ntz"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small inputs stay on several partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def articles(n, seed, days):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        words = rng.sample([f"w{j}" for j in range(40)], rng.choice([0, 0, 1, 2, 3])) + (["hot"] if rng.random() < 0.4 else [])
        date = None if rng.random() < 0.05 else start + datetime.timedelta(days=rng.randrange(days), seconds=rng.choice([0, 0, 0, 3600]))
        out.append((i, words if rng.random() > 0.05 else None, rng.sample(["e1", "e2", "e3"], rng.choice([0, 0, 0, 1, 2])), rng.choice(["a", "b", None]), rng.choice([True, False, None]), rng.choice(["en", "fr"]), date))
    return out


def pairs(rows, k):
    out = set()
    for i, kw, en, cat, rel, lang, at in rows:
        scored = []
        for j, kw2, en2, cat2, rel2, lang2, at2 in rows:
            if i == j:
                continue
            tenths = 24 * len(set(kw or ()) & set(kw2 or ())) + 30 * len(set(en) & set(en2)) + 15 * (cat is not None and cat == cat2) + 12 * bool(rel and rel2) + 5 * (lang == lang2)
            gap = abs((at - at2) // datetime.timedelta(microseconds=1)) if at and at2 else None
            points = tenths * related.TENTH + (max(0, 2 * related.POINT - gap) if gap is not None else 0)
            if points:
                scored.append((-points, -at2.timestamp() if at2 else float("inf"), j))
        out |= {(i, j, round(-p / related.POINT, 6), r) for r, (p, _, j) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("n, seed, days, k", [(250, 1, 30, 3), (250, 2, 900, 2), (4, 3, 10, 3)])
def test_related_articles_of_all_articles(spark, n, seed, days, k):
    rows = articles(n, seed, days)
    got = related.related_articles(spark.createDataFrame(rows, COLS), k)
    assert {tuple(r) for r in got.collect()} == pairs(rows, k)


def test_profiles_that_cannot_lift_a_score_are_not_asked(spark, monkeypatch):
    """Forty profiles share a common keyword; every article finds its best among those that have its other keyword, too."""
    start, rng = datetime.datetime(2024, 1, 1), random.Random(9)
    rows = [(i, ["hot", f"w{i % 40}"], [], "a", True, "en", start + datetime.timedelta(days=rng.randrange(10))) for i in range(400)]
    written, write = [], related.materialize
    monkeypatch.setattr(related, "materialize", lambda df: written.append(write(df)) or written[-1])
    got = related.related_articles(spark.createDataFrame(rows, COLS), 3)
    assert {tuple(r) for r in got.collect()} == pairs(rows, 3)
    assert max(df.count() for df in written) <= 8 * len(rows)


def test_related_articles_of_an_empty_table(spark):
    assert related.related_articles(spark.createDataFrame([], COLS)).isEmpty()


def test_running_sums_cross_partitions(spark):
    rows = [(g, i * 7 % 1000, i % 3) for g in ("a", "b") for i in range(1000 if g == "a" else 5)]
    df = spark.createDataFrame(rows, "g string, at int, v long").repartition(3)
    got = {(r.g, r.at): r.s for r in ordered.running_sum(df, ["g"], ["at"], "v", "s").collect()}
    for g in ("a", "b"):
        total = 0
        for _, at, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[g, at] == total


def test_pages_join_to_the_whole_order(spark):
    rows = spark.range(5000).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 7 % 300).cast("int"))).alias("published_at"))
    want = [r.id for r in rows.orderBy(F.desc("published_at"), F.desc("id")).collect()]
    index = search.page_index(rows)
    assert index.total == 5000 and len(index.counts) > 1
    for start, count in ((0, 10), (4990, 20), (1200, 1500), (5000, 5), (7000, 1)):
        got = index.rows(start, count).collect()
        assert [r.id for r in sorted(got, key=lambda r: r.position)] == want[start:start + count]
        assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(start, min(start + count, 5000)))
    page = search.page_articles(index, 10**6, 60).collect()
    assert {r.id for r in page} == set(want[83 * 60:]) and page[0].page == 84 and not page[0].has_next
    cursor, seen = None, []
    for _ in range(3):
        part = search.next_articles(rows, cursor, 100).collect()
        seen += [r.id for r in part]
        cursor = part[-1].published_at, part[-1].id
    assert seen == want[:300]
    assert search.page_index(rows.where("false")).total == 0 and search.page_articles(search.page_index(rows.where("false"))).isEmpty()


@pytest.mark.parametrize("share, need", [(1.0, 50), (0.9, 50), (0.02, 30), (0.0, 10), (0.3, 0), (0.5, 10**6)])
def test_first_passing_rows_are_exact_and_few_are_judged(spark, share, need):
    rng = random.Random(7)
    good = {i for i in range(3000) if rng.random() < share}
    rows = spark.range(3000).select("id", ((F.col("id") * 1237) % 3000).alias("rank")).repartition(4)
    passing = spark.createDataFrame([(i,) for i in good] or [(-1,)], "id long")
    got, judged = ordered.first_passing(rows, [F.asc("rank")], lambda r: r.join(passing, "id", "left_semi"), need)
    want = [i for i in sorted(range(3000), key=lambda i: i * 1237 % 3000) if i in good][:need]
    assert sorted((r.id for r in got.collect()), key=lambda i: i * 1237 % 3000) == want
    if share >= 0.9:
        assert judged < 2 * need
