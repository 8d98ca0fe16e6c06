"""Faults found in the third round's review."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from clipworks.functions import sparse
from clipworks.operators import derive, normalize, retrieval
from clipworks.plans import graph_queries


@pytest.mark.parametrize("top", [150, 300, 600, 2350, 6459])
def test_legend_bounds_are_exact_shares(spark, top):
    rows = spark.createDataFrame([(1, top), (2, 5)], "region_id INT, v BIGINT")
    first, second = math.ceil(Fraction(34, 100) * top), math.ceil(Fraction(67, 100) * top)
    got = [tuple(r) for r in derive.legend_bins(rows, "v").orderBy("bin").collect()]
    assert got == [(0, 0, 0), (1, 1, first), (2, first + 1, second), (3, second + 1, top)]


def test_edge_evidence_reads_whole_bodies(spark, tmp_path):
    filler = "nothing of note stands here. " * 40
    rows = [(1, "a plain title\n" + filler + "nobody sees erin", "src0", "en"), (2, "another\n" + filler, "src1", "en")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, lang STRING").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {("k3", "k4", 1, 1), ("k4", "gone", 1, 1)}  # "erin" is a keyword, too; "nobody" stands in the body only
    got = graph_queries.edge_evidence(spark, str(tmp_path)).select("source_id", "target_id", "id", "rank").collect()
    assert {tuple(r) for r in got} == wanted
    refs = {tuple(r) for r in graph_queries.edge_refs(spark, str(tmp_path)).where("ref LIKE 'article:%'").collect()}
    assert refs == {("k3", "k4", "article:1", 1), ("k4", "gone", "article:1", 1)}


def test_values_and_texts_meet_only_where_they_can_hit(spark):
    """Values whose trigrams are common, but whose starts are rare: the meeting held nearly every pair before."""
    words = [f"{a}{b}{c}erationing" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprst"]
    texts = [("article", str(n), 0, 2, f"the {w} one, \\u00e9\\U0001f600 {w[:-1]}") for n, w in enumerate(words)]
    values = [(w,) for w in words] + [("\\u00e9\\U0001f600",), ("erationing one",), ("nowhere at all in these texts, which is long",), ("x",)]
    texts = spark.createDataFrame(texts, "kind STRING, item STRING, field INT, strength INT, text STRING")
    values = spark.createDataFrame(values, "value STRING")
    expect = texts.crossJoin(values).where("length(value) >= 2 AND contains(text, value)").select("kind", "item", "value", "strength").collect()
    got = retrieval.postings(texts, values).select("kind", "item", "value", "strength").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expect))
    starts = values.where("length(value) >= 2").select("value", retrieval._start("value").alias("start"))
    bits = spark.sparkContext.broadcast(retrieval._filter(starts, starts.count()))
    meetings = texts.select(F.explode(retrieval._offered(bits)("text")).alias("start")).join(starts, "start").count()
    assert meetings < 2 * len(expect)


def test_best_matches_over_many_blocks(spark):
    """Only the best of each block leave it: no row for each question and item that meet."""
    offers = [("a", f"i{n:04}", f"f{f}", 1 + (n * f) % 5) for n in range(400) for f in range(6) if (n + f) % 3]
    wanted = [(q, "a", f"f{f}", f < 4, 1 + (q + f) % 4 if f < 4 or q % 2 else -2) for q in range(30) for f in range(6) if (q * f) % 4 != 1]
    o = spark.createDataFrame(offers, "kind string, item string, feature string, strength long")
    w = spark.createDataFrame(wanted, "key long, kind string, feature string, main boolean, weight long")
    c = spark.createDataFrame([(q, "a", 2 * (q % 3 == 0), 5) for q in range(30)], "key long, kind string, base long, bias long")
    first = spark.createDataFrame([("a", f"i{n:04}") for n in range(7)], "kind string, item string")
    one = sparse.best_matches(w, o, {"a": 7}, c, first)
    many = sparse.best_matches(w, o, {"a": 7}, c, first, wanted_rows=20, offer_rows=100)
    score = F.sum(F.when(F.col("main"), F.col("weight") * F.col("strength")).otherwise(0)), F.sum(F.when(F.col("main"), 0).otherwise(F.col("weight") * F.col("strength")))
    met = w.join(o, ["kind", "feature"]).groupBy("key", "kind", "item").agg(score[0].alias("s"), score[1].alias("t")).join(c, ["key", "kind"])
    total = met.select("key", "item", (F.col("s") + F.col("base") + F.col("t") + F.when(F.col("s") + F.col("base") > 0, F.col("bias")).otherwise(0)).alias("score")).where("score > 0")
    plain = {}
    for r in total.collect():
        plain.setdefault(r.key, []).append((-r.score, r.item))
    expect = {(q, item, -s, n) for q, rows in plain.items() for n, (s, item) in enumerate(sorted(rows)[:7], 1)}
    assert {tuple(r) for r in one.select("key", "item", "score", "rank").collect()} == expect
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in one.collect()}


def test_route_texts_go_to_python_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    df = spark.createDataFrame([(1, "ﬁne Ａ/b%"), (2, ""), (3, "É" * 90), (4, "E\u0301" * 90)], "id INT, slug STRING")
    routes = normalize.route_segments(df).orderBy("id")
    assert int(spark.conf.get(key)) <= 1000
    assert [r.route for r in routes.collect()] == ["1-fine-A-b", "2", "3-" + "É" * 80, "4-" + "É" * 80]
    spark.conf.set(key, before)
