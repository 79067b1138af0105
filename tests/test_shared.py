from types import SimpleNamespace

import pytest

from vantage import shared


def session(master, configured=None):
    conf = {"spark.checkpoint.dir": configured} if configured else {}
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf.get(k)), getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))), made


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.folder(session(master)[0])


def test_the_session_names_the_folder():
    for master in ("yarn", "local[4]"):
        spark, made = session(master, "s3://bucket/x")
        assert shared.folder(spark) == "s3://bucket/x" and made == ["s3://bucket/x"]


def test_a_local_master_gets_a_folder_of_its_own():
    spark, made = session("local[2]")
    assert made == [] and shared.folder(spark) == made[0]


def test_cut_keeps_the_rows(spark):
    assert shared.cut(spark.range(10)).count() == 10
