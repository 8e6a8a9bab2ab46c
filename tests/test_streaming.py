from __future__ import annotations

from premia.sources import fixtures as fx
from premia.streaming.scoring import attempts_by_window


def test_windows(spark, sf_dir, tmp_path):
    attempts = fx.attempts(spark, sf_dir).withColumn("occurred_at", fx.F.col("occurred_at").cast("timestamp"))
    attempts.write.parquet(str(tmp_path / "in"))
    stream = attempts_by_window(spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == attempts.count()
