import threading
import time

from pyspark.sql import functions as F

from docloom.sources.log_sink import LogSink
from docloom.sources.store import Store
from docloom.streaming.progress import Progress, StreamProgress

KIND = "ts long, line string"


def lines(spark, low, high):
    return spark.createDataFrame([(k, f"line {k}") for k in range(low, high)], KIND)


def held(sink):
    log = sink.store.at().read("log")
    return [] if log is None else sorted(r["ts"] for r in log.collect())


def test_repeated_batches_add_nothing(spark, tmp_path):
    flag = [True]
    sink = LogSink(Store(spark, f"file://{tmp_path}/log"), ["ts"], lambda: flag[0], tail=50)
    for batch in (0, 0, 1, 0, 1):
        sink.write(lines(spark, 10 * batch, 10 * batch + 10), batch)
    assert held(sink) == list(range(20))
    flag[0] = False
    sink.write(lines(spark, 20, 30), 2)
    flag[0] = True
    sink.write(lines(spark, 20, 30), 2)  # it was passed over while the log was off
    sink.write(lines(spark, 30, 40), 0, "another")
    assert held(sink) == [*range(20), *range(30, 40)]
    sink.write(lines(spark, 40, 140), 3)
    assert held(sink) == list(range(90, 140))
    assert [r["ts"] for r in sink.last(3).collect()] == [137, 138, 139]


def test_a_stream_that_breaks_off_and_goes_on(spark, tmp_path):
    path = str(tmp_path / "in")
    sink = LogSink(Store(spark, f"file://{tmp_path}/log"), ["ts"])
    for k in range(3):
        lines(spark, 5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    write, calls = sink.write, []

    def broken(df, batch, name=""):
        write(df, batch, name)
        calls.append(batch)
        if len(calls) == 2:
            raise OSError("stopped after the commit")  # the batch is in the log, but not in the checkpoint

    sink.write = broken
    for _ in range(2):
        query = sink.stream(rows, "s").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(60)
        except Exception as e:  # noqa: BLE001
            assert "stopped after the commit" in str(e)
    assert calls == [0, 1, 1, 2] and held(sink) == list(range(15))


def test_progress_of_a_job(spark):
    progress = Progress(spark)
    rows = progress.mark(spark.range(1000).repartition(10), "embed", 1000)
    slow = rows.select(F.expr("id"), F.lit(1).alias("x"))
    thread = threading.Thread(target=lambda: slow.write.format("noop").mode("overwrite").save())
    thread.start()
    thread.join()
    row = progress.table().first()
    assert (row["stage"], row["done"], row["total"]) == ("embed", 1000, 1000) and row["rows_per_second"] > 0 and row["seconds_left"] == 0
    progress.finish("embed")
    assert progress.table().first()["seconds_left"] == 0
    half = progress.mark(spark.range(500), "half", 1000)
    half.count()
    found = {r["stage"]: r for r in progress.table().collect()}["half"]
    assert found["done"] == 500 and abs(found["seconds_left"] - 500 / found["rows_per_second"]) < 1


def test_progress_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(3):
        lines(spark, 5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(path)
    listener = StreamProgress({"lines": 20})
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
        query = rows.writeStream.format("noop").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        end = time.monotonic() + 20
        while time.monotonic() < end and (listener.done.get("lines") != 15 or "lines" not in listener.over):
            time.sleep(0.2)
        row = listener.table(spark).first()
        assert (row["stage"], row["done"], row["total"], row["seconds_left"]) == ("lines", 15, 20, 0.0)
    finally:
        spark.streams.removeListener(listener)
