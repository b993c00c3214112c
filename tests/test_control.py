import threading
import time

import pytest

from glossweave.streaming import control


@pytest.mark.parametrize(("done", "total", "want"), [(0, 10, 10), (5, 10, 50), (10, 10, 90), (20, 10, 90), (3, 0, 10), (-1, 10, 10), (1, 3, 36)])
def test_scaled(done, total, want):
    assert control.scaled(done, total, 10, 90) == want


def test_a_cancelled_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def writer(name):
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).mapInPandas(lambda frames: (time.sleep(0.4) or df for df in frames), "id long")
        return rows.writeStream.queryName(name).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)

    said = []
    first = control.Progress("first", 60, lambda *x: said.append(x))
    second = control.Progress("second", 60)
    spark.streams.addListener(first)
    spark.streams.addListener(second)
    try:
        assert control.run(writer("first"), lambda: first.batches >= 2) is False
        seen = spark.read.schema("id long").parquet(str(tmp_path / "out")).count()
        assert 20 <= seen < 60
        assert control.run(writer("second"), lambda: False) is True
        for _ in range(100):
            if first.rows + second.rows >= 60:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(first)
        spark.streams.removeListener(second)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
    assert said[:2] == [(1, 10, 16), (2, 20, 33)] and second.error is None and first.error is None


def test_jobs_end_by_their_tag(spark):
    failed = []

    def work():
        with control.interruptible(spark, "long-job"):
            try:
                spark.range(4, numPartitions=4).mapInPandas(lambda frames: (time.sleep(40) or df for df in frames), "id long").count()
            except Exception as e:
                failed.append(str(e))

    t = threading.Thread(target=work)
    began = time.time()
    t.start()
    while t.is_alive() and time.time() - began < 25:
        time.sleep(1)
        control.cancel(spark, "long-job")
    t.join(5)
    assert failed and time.time() - began < 32
    assert spark.range(3).count() == 3
