import os

import pytest

from newsignal.session import broadcast_if_small, durable, scratch, shared_dir


class Cluster:
    """A session that is not local and has no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class sparkContext:
        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster, "x")
    Cluster.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs:///shared/")
    assert shared_dir(Cluster, "x").startswith("hdfs:///shared/newsignal/x-")


def test_scratch_is_deleted(spark):
    with scratch(spark) as keep:
        kept = keep(spark.range(3))
        files = [f.removeprefix("file://") for f in kept.inputFiles()]
        assert kept.count() == 3 and files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_durable_keeps_empty_results_and_types(spark):
    empty = spark.createDataFrame([], "a struct<x:int,y:date>, b decimal(5,4)")
    again = durable(spark, empty)
    assert again.schema.simpleString() == empty.schema.simpleString() and again.count() == 0


def test_broadcast_only_below_the_bound(spark):
    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "strategy=broadcast" in plan(broadcast_if_small(spark.range(10), 10))
    assert "strategy=broadcast" not in plan(broadcast_if_small(spark.range(11), 10))
