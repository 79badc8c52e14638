from pyspark.sql import functions as F

from quantloom.sources import sinks


def test_tables(spark, tmp_path):
    p = f"{tmp_path}/t"
    a = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "uid string, v int")
    sinks.upsert_ignore(a, p, "uid", "v")
    sinks.upsert_ignore(a.unionByName(spark.createDataFrame([("c", 9)], "uid string, v int")), p, "uid", F.desc("v"))
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("a", 1), ("b", 3), ("c", 9)]
    h = f"{tmp_path}/h"
    assert sinks.history(spark, h, "uid string").count() == 0
    sinks.append(a, h)
    sinks.append(a.withColumn("w", F.lit(1.5)), h)
    got = sinks.history(spark, h, "uid string")
    assert got.count() == 6 and got.where("w is null").count() == 3
    calls = []
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/c", lambda: calls.append(1) or a).count() == 3
    assert len(calls) == 1


def test_reports(spark):
    d = spark.range(1250).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    assert sinks.thinned(d, "k", "t").count() == 625
    rows = [{"name": "<x>", "v": 0.123456}, {"name": "y", "v": None}]
    assert sinks.markdown(rows, ["name", "v"]).splitlines()[2] == "| <x> | 0.1235 |"
    page = sinks.page("T", rows, ["name", "v"], {"s": "</script>"})
    assert "&lt;x&gt;" in page and page.count("</script>") == 1


def test_replaced_results_and_state(spark, tmp_path):
    from quantloom.sources import sinks

    at = str(tmp_path / "state")
    default = spark.createDataFrame([("a", None)], "k string, v double")
    assert [tuple(r) for r in sinks.state(spark, at, "k string, v double", default).collect()] == [("a", None)]
    for v in (1.5, None):
        sinks.replace_json(spark.createDataFrame([("b", v)], "k string, v double"), at)
        assert [tuple(r) for r in sinks.state(spark, at, "k string, v double", default).collect()] == [("b", v)]
        sinks.replace_csv(spark.createDataFrame([("b", v)], "k string, v double"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("b", None)]
    sinks.append_csv(spark.createDataFrame([("c", 2.0)], "k string, v double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
