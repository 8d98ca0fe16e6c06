"""Faults found in the fourth round's review."""

from pyspark.sql import functions as F

from clipworks.operators import audit, extract, normalize, tagging
from clipworks.plans import review_queries

FOLDER = "/root/testdata/sf0.001"


def filters(df):
    """The filters of a plan that hold computed reasons."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter" in line and "source_not_whitelisted" in line]


def test_checks_are_made_once(spark):
    """A filter on the reasons was pushed below the checks, and the report read its input twice."""
    checked = review_queries.checked(spark, FOLDER)
    assert not filters(audit.top_reasons(checked, 5)) and not filters(audit.problem_samples(checked))
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, ["a", "b"], False), (2, [], True), (3, ["a"], False)], "id INT, reasons ARRAY<STRING>, qualified BOOLEAN")
    got = {tuple(r) for r in audit.assert_report(rows.mapInArrow(counted, rows.schema)).collect()}
    assert got == {("total", 3), ("qualified", 1), ("problems", 3), ("a", 2), ("b", 1)} and calls.value == 3
    assert {tuple(r) for r in audit.assert_report(rows.where("false")).collect()} == {("total", 0), ("qualified", 0), ("problems", None)}
    assert [tuple(r) for r in audit.problems(rows).orderBy("id", "reason").collect()] == [(1, "a"), (1, "b"), (3, "a")]


def test_feed_texts_are_made_once(spark):
    """nullif made every text twice."""
    expression = extract._xml(F.col("item"), "title")._jc.toString()
    assert "nullif" not in expression
    rows = spark.createDataFrame([("<item><title><![CDATA[a &amp; <b>b</b>]]></title></item>",), ("<item><title> </title></item>",), ("<item/>",)], "item STRING")
    assert [r[0] for r in rows.select(extract._xml(F.col("item"), "title")).collect()] == ["a & b", None, None]


def test_plain_words_are_passed_on(spark):
    words = ["plain", "Word", "x", "the", "The", "tail,", "—dash-", "a b", "\u00a0hard\u00a0", "caf\u00e9", "CAF\u00c9", "R2D2", "new\n", "line\n", "don't", "", "plain", "y" * 24, "y" * 25, None]
    df = spark.createDataFrame([(1, words)], "id INT, terms ARRAY<STRING>")
    got = normalize.normalize_terms(df, "terms", blocked=["the"]).first()["terms"]
    assert got == ["plain", "word", "tail", "dash", "a b", "hard", "caf\u00e9", "CAF\u00c9", "R2D2", "new", "line", "don't", "y" * 24]


def test_small_term_tables_meet_texts_where_they_lie(spark):
    """The texts were joined again by id to verify a hit."""
    docs = spark.createDataFrame([(n, f"the number{n} and numbering {n}") for n in range(300)], "id INT, body STRING")
    table = spark.createDataFrame([(f"number{n}",) for n in range(500)] + [("numbering",), ("none of these",), ("n",)], "term STRING")
    hits = tagging.match_term_table(docs, table, "id", "body")
    want = docs.crossJoin(table).where("contains(body, term)").select("id", "term").collect()
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want))
    plan = tagging.match_term_table(docs, table, "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
