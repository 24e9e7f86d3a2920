"""Given tables spread over tasks by their rows."""

from clausegrid.sources import tables as T


def test_many_short_rows_are_spread(spark, tmp_path, monkeypatch):
    spark.range(0, 1000, 1, 5).write.parquet(str(tmp_path / "t.parquet"))
    assert T.read(spark, str(tmp_path), "t").rdd.getNumPartitions() < 10
    monkeypatch.setattr(T, "ROWS_PER_TASK", 100)
    spread = T.read(spark, str(tmp_path), "t")
    assert spread.rdd.getNumPartitions() == 10 and spread.distinct().count() == 1000
