import os
from types import SimpleNamespace

import pytest

from loomset.session import materialise, remove_intermediates, shared_path


def session(conf=None, checkpoint=None, master="yarn"):
    context = SimpleNamespace(
        master=master,
        applicationId="app",
        getCheckpointDir=lambda: checkpoint,
        setCheckpointDir=lambda path: made.append(path),
    )
    made = []
    settings = {"spark.checkpoint.dir": conf} if conf else {}
    return SimpleNamespace(conf=settings, sparkContext=context, made=made)


def test_the_cluster_names_the_folder(spark):
    assert shared_path(session(conf="hdfs://x/shared/"), "a").startswith("hdfs://x/shared/intermediates-app/a-")
    assert shared_path(session(checkpoint="s3://y"), "a").startswith("s3://y/intermediates-app/a-")
    assert shared_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_path(spark, "a") != shared_path(spark, "a")


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError):
        shared_path(session(), "a")


def test_a_local_session_makes_its_own():
    local = session(master="local[8]")
    assert shared_path(local, "a").startswith(local.made[0])


def test_intermediates_can_be_removed(spark):
    kept = materialise(spark.range(5), "x")
    assert kept.count() == 5
    folder = shared_path(spark, "y").rsplit("/", 1)[0]
    assert os.listdir(folder)
    remove_intermediates(spark)
    assert not os.path.exists(folder)
    assert materialise(spark.range(3), "z").count() == 3
