"""Parallel reads of an embedded database with skewed keys."""

import pytest

from clipworks.sources.tables import read_jdbc

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    try:
        spark._jvm.java.lang.Class.forName(DRIVER["driver"])
    except Exception:
        pytest.skip("no embedded database")
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/store;create=true"
    keys = [*range(900), *range(10**9, 10**9 + 50), -5, 10**12]
    rows = [(k, f"name {k}", k % 7) for k in keys] + [(None, "nobody", 3)]
    spark.createDataFrame(rows, "id long, name string, kind long").coalesce(1).write.jdbc(url, "things", properties=DRIVER)
    spark.createDataFrame([], "id long, name string").write.jdbc(url, "nothing", properties=DRIVER)
    return url, rows


def test_skewed_keys_make_even_partitions(spark, store):
    url, rows = store
    df = read_jdbc(spark, url, "things", '"id"', rows_per_partition=100, properties=DRIVER)
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    assert max(sizes) <= 100 and 10 <= len(sizes) <= 20


def test_filters_columns_and_where_reach_the_store(spark, store):
    url, rows = store
    df = read_jdbc(spark, url, "things", '"id"', 500, where='"kind" <> 0', properties=DRIVER)
    some = df.where("kind = 3").select("name")
    plan = some._jdf.queryExecution().explainString(some._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(KIND,3)" in plan.upper().replace("EQUALTO", "EqualTo") and "struct<name:string>" in plan.lower()
    assert sorted(r[0] for r in some.collect()) == sorted(n for k, n, kind in rows if kind == 3)
    assert df.count() == sum(1 for r in rows if r[2] != 0)


def test_empty_tables_and_no_keys(spark, store):
    url, _ = store
    assert read_jdbc(spark, url, "nothing", '"id"', properties=DRIVER).columns and read_jdbc(spark, url, "nothing", '"id"', properties=DRIVER).isEmpty()
    assert read_jdbc(spark, url, "things", '"id"', where='"id" IS NULL', properties=DRIVER).count() == 1
