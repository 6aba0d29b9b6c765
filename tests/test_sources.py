"""Tables from a database: an embedded one, read in ranges of its key."""

import pytest

from formcheck.sources.files import read_jdbc, read_tables

SCHEMA = "id long, name string, amount double"


@pytest.fixture(scope="module")
def url(spark):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no embedded database among Spark's jars")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    where = "jdbc:derby:memory:formcheck;create=true"
    rows = spark.createDataFrame([(k, f"name {k}", k / 4) for k in range(1000)] + [(None, "no key", 1.0)], SCHEMA)
    rows = rows.toDF("ID", "NAME", "AMOUNT")
    rows.write.jdbc(where, "RESULTS", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    rows.where("false").write.jdbc(where, "NOTHING", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    return where


def test_ranges_of_the_key(spark, url):
    rows = read_jdbc(spark, url, "results", SCHEMA, "id", 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.columns == ["id", "name", "amount"]
    sizes = [len(p) for p in rows.rdd.glom().collect()]
    assert sum(sizes) == 1001 and max(sizes) < 300
    assert rows.where("id IS NULL").first().name == "no key"


def test_filters_and_columns_are_the_database_s_work(spark, url):
    rows = read_tables(spark, url, {"results": SCHEMA, "nothing": "id long, name string"}, {"results": "id", "nothing": "id"}, 3)
    some = rows["results"].where("id >= 990 AND id <> 995").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThanOrEqual(ID,990)" in plan and "*Not(EqualTo(ID,995))" in plan and "ReadSchema: struct<NAME:string>" in plan
    assert sorted(r.name for r in some.collect()) == [f"name {k}" for k in range(990, 1000) if k != 995]
    assert rows["nothing"].count() == 0 and rows["nothing"].columns == ["id", "name"]
