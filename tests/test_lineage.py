import pytest

from tidemark import session
from tidemark.functions.lineage import written


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Context:
    master = "spark://somewhere:7077"

    def __init__(self, conf, folder=None):
        self._conf, self._folder = _Conf(conf), folder

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._folder


class _Session:
    def __init__(self, conf, folder=None):
        self.conf, self.sparkContext = _Conf(conf), _Context(conf, folder)


def test_the_clusters_folder_is_used():
    assert session.checkpoint_dir(_Session({"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session({}))


def test_the_contexts_folder_is_used():
    assert session.checkpoint_dir(_Session({}, "hdfs:///set")) == "hdfs:///set"


def test_written_table_cuts_the_plan_and_keeps_pruning(spark):
    base = spark.range(10).selectExpr("id", "id * 2 as b", "cast(id as string) as c").groupBy("id", "b").count()
    table = written(base)
    plan = table.filter("b > 4").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThan(b,4)" in plan and "count" not in plan.split("ReadSchema")[1]
    assert sorted(table.collect()) == sorted(base.collect())


def test_released_removes_its_tables(spark):
    from pyspark.errors import PySparkException

    from tidemark.functions.lineage import released

    kept = written(spark.range(3))
    with released(spark):
        inner = written(spark.range(4))
        assert inner.count() == 4
    assert kept.count() == 3
    with pytest.raises(PySparkException):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_derived_tables_scan_their_source_once(spark, sf_dir):
    """Everything behind the stored table reads the stored table, and the source is scanned to store it only."""
    from tidemark.plans.catalog import QUERIES

    for name in ("ranker_features", "topk_metrics", "forward_labels", "limit_up_events"):
        assert not [f for f in QUERIES[name](spark, sf_dir).inputFiles() if f.endswith("lineitem.parquet")], name
    plan = QUERIES["event_batch"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 1  # the source profiles; the news were stored
