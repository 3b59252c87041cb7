"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from sortmill import shared


class Conf(dict):
    def set(self, k, v):
        self[k] = v


def session(master, **conf):
    return SimpleNamespace(conf=Conf({k.replace("_", "."): v for k, v in conf.items()}), sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used_and_a_cluster_must_name_one():
    assert shared.shared_dir(session("spark://host:7077", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "k8s://https://x"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(session(master))
    own = session("local[4]")
    assert shared.shared_dir(own) == own.conf["spark.checkpoint.dir"] and shared.shared_dir(own).startswith("file:")


def test_tables_can_be_discarded(spark):
    df = shared.settled(spark.range(10), "kept")
    assert df.count() == 10
    path = df._settled_at.replace("file://", "")
    assert os.path.isdir(path)
    shared.discard(df)
    assert not os.path.exists(path)


def test_broadcasts_are_bounded(spark):
    df = spark.range(10)
    assert "broadcast" in shared.sized(df, 1000, 8)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in shared.sized(df, shared.BROADCAST_BYTES // 50, 8)._jdf.queryExecution().logical().toString()
