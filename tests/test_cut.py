import os

import pytest

from lattica.plans import cut
from lattica.plans.cut import release, staged


def test_staged_tables_are_tables_until_released(spark):
    release(spark)
    df = staged(spark.range(5))
    again = staged(df.where("id > 2"))
    assert sorted(r.id for r in again.collect()) == [3, 4]
    assert release(spark) == 2 and release(spark) == 0


def test_what_was_staged_within_is_gone_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cut, "shared_folder", lambda spark: f"file://{tmp_path}")
    with cut.staging(spark):
        rows = staged(staged(spark.range(5)).where("id > 1"))
        assert rows.count() == 3 and len(os.listdir(tmp_path)) == 2
    assert os.listdir(tmp_path) == []


def test_the_folder_is_the_one_that_the_cluster_names():
    class Session:
        def __init__(self, **given):
            self.conf = {k.replace("_", "."): v for k, v in given.items()}

    assert cut.shared_folder(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    assert cut.shared_folder(Session(spark_master="local[4]")) == cut.shared_folder(Session(spark_master="local")) != ""
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut.shared_folder(Session(spark_master="spark://a:7077"))
