import pytest

from clicktrail.sources import shared


def test_work_is_found_by_its_mark(spark, monkeypatch):
    monkeypatch.setattr(shared, "_mark", lambda spark: "clicktrail-one-run-")
    other = f"{shared.shared_root(spark)}/clicktrail-another-run"
    spark.range(1).write.parquet(other)
    frames = [shared.stash(spark.range(1), name) for name in ("a", "b")]
    assert shared.remove_work(spark) == 2
    assert not shared.Storage(spark).exists(frames[0].inputFiles()[0]) and spark.read.parquet(other).count() == 1
    assert shared.remove_work(spark) == 0


class Elsewhere:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        master = "yarn"

    def __init__(self, **conf):
        self.values, self.conf = conf, self

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


def test_a_folder_of_the_driver_is_refused_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(Elsewhere(spark_sql_warehouse_dir="file:/home/me/warehouse"))
    assert shared.shared_root(Elsewhere(spark_sql_warehouse_dir="hdfs://n/warehouse/")) == "hdfs://n/warehouse"
    assert shared.shared_root(Elsewhere(spark_checkpoint_dir="file:/mnt/shared", spark_sql_warehouse_dir="file:/x")) == "file:/mnt/shared"
