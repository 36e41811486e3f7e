"""Scratch tables: where they go, and when."""

import os
from types import SimpleNamespace

import pytest

from gatewright.llm import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_a_shared_folder():
    assert scratch.shared_folder(session("local[4]")).startswith("file://")
    assert scratch.shared_folder(session("spark://x:7077", "s3://b/c/")) == "s3://b/c"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_folder(session(master))


def test_tables_are_tracked_and_dropped(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    with scratch.tracked() as held:
        one = scratch.Scratch(spark, "test")
        table = one.table(spark.range(10), "t")
    other = scratch.Scratch(spark, "test")
    assert held == [one] and table.count() == 10 and spark.conf.get("spark.checkpoint.dir", None) == before
    folder = one.root.removeprefix("file://")
    assert os.path.isdir(f"{folder}/t")
    one.drop_all()
    assert not os.path.exists(folder) and other.table(spark.range(3), "t").count() == 3
    assert spark.conf.get(scratch._CLEANUP, None) in (None, "false")
