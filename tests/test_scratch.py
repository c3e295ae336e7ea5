import pytest
from pyspark.sql import functions as F

from murmura import scratch
from murmura.operators.ranks import numbered


def test_materialize_keeps_schema_and_clears(spark):
    df = spark.range(3).selectExpr("id", "cast(null as string) as s")
    out = scratch.materialize(df.where("false"), "t")
    assert out.dtypes == df.dtypes and out.count() == 0
    assert scratch.clear(spark) >= 1
    assert scratch.clear(spark) == 0


def test_shared_dir_is_required_on_a_cluster():
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert scratch.shared_dir(Session("local[2]")) == scratch.LOCAL_DIR
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            scratch.shared_dir(Session(master))


def test_bounded_broadcast(spark):
    assert scratch.bounded_broadcast(spark.range(5), 5)[1]
    assert not scratch.bounded_broadcast(spark.range(6), 5)[1]


def test_numbered(spark):
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1009 as int) as x")
    got = [r.n for r in numbered(df.repartition(7), [F.col("x")], "n").orderBy("x").collect()]
    assert got == list(range(1000))
