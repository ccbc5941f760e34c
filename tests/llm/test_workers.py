import os

from tessera.llm import _shared, bpe


def test_entering_an_operator_empties_the_others(monkeypatch):
    monkeypatch.setattr(_shared, "_CLEAR", dict(_shared._CLEAR))
    kept = {}
    _shared.worker_cache("probe", kept.clear)
    _shared.enter("probe")
    kept["a"] = 1
    _shared.enter("probe")  # still in the same operator: nothing is emptied
    assert kept == {"a": 1}
    _shared.enter("bpe")
    assert kept == {}
    kept["b"] = 2
    _shared.enter("bpe")
    assert kept == {"b": 2}
    assert bpe.chunks(["a"]) is not None


def test_materialized_tables_can_be_discarded(spark):
    now = _shared.materialize(spark.range(10).repartition(3), "probe")
    path = now._own_folder.removeprefix("file:")
    assert now.count() == 10 and os.path.isdir(path)
    _shared.discard(now, None, spark.range(3))
    assert not os.path.exists(path)
    _shared.discard(now)  # once more does nothing


def test_partition_keys_deal_evenly(spark):
    from pyspark.sql import functions as F

    keys = _shared.partition_keys(spark, 13)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(13, "k").withColumn("p", F.spark_partition_id())
    assert sorted(r.p for r in df.collect()) == list(range(13))
