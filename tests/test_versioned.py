import os

import pytest
from pyspark.sql import functions as F

from turnloom.sources import versioned


@pytest.fixture
def path(spark, tmp_path):
    versioned.register(spark)
    return str(tmp_path / "store")


def rows(spark, path, **options):
    return sorted(tuple(r) for r in spark.read.format("versioned").options(**options).load(path).collect())


def put(df, path, mode="append", **options):
    df.write.format("versioned").mode(mode).options(**options).save(path)


def data(path):
    return sorted(x for x in os.listdir(path) if x.endswith(".parquet"))


def test_appends_and_older_versions(spark, path):
    a, b = (spark.range(k, k + 3).select("id", F.col("id").cast("string").alias("s")).repartition(2) for k in (0, 10))
    put(a, path)
    put(b, path)
    assert len(rows(spark, path)) == 6 and rows(spark, path, version="1") == [(0, "0"), (1, "1"), (2, "2")]
    put(b, path, "overwrite")
    assert [r[0] for r in rows(spark, path)] == [10, 11, 12] and versioned.newest(path) == 3
    put(a.limit(0), path)
    assert len(rows(spark, path)) == 3
    put(a.limit(0), path, table="none")
    assert rows(spark, path, table="none") == []
    assert spark.read.format("versioned").load(path).select("s").where("id = 11").first()["s"] == "11"
    with pytest.raises(Exception, match="no table"):
        rows(spark, path, table="other")
    with pytest.raises(Exception, match="another schema"):
        put(spark.range(2).withColumnRenamed("id", "x"), path)


def test_of_two_appends_from_one_version_the_second_is_refused(spark, path):
    df = spark.range(3)
    put(df, path, expected="0")
    before = data(path)
    with pytest.raises(Exception, match="not the newest|exists"):
        put(spark.range(5), path, expected="0")
    assert data(path) == before and rows(spark, path) == [(0,), (1,), (2,)]
    with pytest.raises(versioned.Conflict):
        versioned.create(*versioned.located(f"{path}/{versioned.MANIFESTS}/000000000001.json"), b"{}")
    assert len(os.listdir(f"{path}/{versioned.MANIFESTS}")) == 1


def test_a_write_that_fails_leaves_nothing(spark, path):
    put(spark.range(2), path)
    before = data(path)
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        put(broken, path)
    assert versioned.newest(path) == 1 and rows(spark, path) == [(0,), (1,)]
    versioned.vacuum(path)
    assert data(path) == before and versioned.vacuum(path) == 0


def test_several_tables_appear_at_once(spark, path):
    put(spark.range(1), path, table="turns", transaction="t")
    put(spark.range(2), path, table="events", transaction="t")
    assert versioned.newest(path) == 0
    assert versioned.publish(path, "t") == 1
    assert len(rows(spark, path, table="turns")) == 1 and len(rows(spark, path, table="events")) == 2
    put(spark.range(9), path, "overwrite", table="turns", transaction="u")
    put(spark.range(3), path, table="events", transaction="u")
    before = data(path)
    with pytest.raises(versioned.Conflict):
        versioned.publish(path, "u", expected=0)
    assert len(data(path)) < len(before) and len(rows(spark, path, table="turns")) == 1 and not os.listdir(f"{path}/{versioned.STAGED}")
