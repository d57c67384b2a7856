"""How far a job or a stream is: rows done, rows a second, seconds left."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "stage string, done long, total long, rows_per_second double, seconds_left double"


@dataclass
class Stage:
    name: str
    total: int | None
    done: object  # an accumulator
    began: float = field(default_factory=time.monotonic)
    ended: float | None = None

    def row(self) -> tuple:
        done, took = int(self.done.value), max(1e-9, (self.ended or time.monotonic()) - self.began)
        speed = done / took
        left = None if self.total is None or not done else max(0, self.total - done) / speed
        return self.name, done, self.total, speed, 0.0 if self.ended is not None else left


class Progress:
    """Counts the rows that pass through marked places of a job.

    Accumulators are merged when tasks end, so the figures move in steps of tasks; a
    task that is run again may count its rows twice, so `done` is for display.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, {}

    def mark(self, rows: DataFrame, name: str, total: int | None = None) -> DataFrame:
        """The same rows; those that pass are counted under the name."""
        counter = self.spark.sparkContext.accumulator(0)
        self.stages[name] = Stage(name, total, counter)

        def run(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    def finish(self, name: str) -> None:
        self.stages[name].ended = time.monotonic()

    def table(self) -> DataFrame:
        """PROGRESS, one row a stage."""
        return self.spark.createDataFrame([s.row() for s in self.stages.values()], PROGRESS)


class StreamProgress(StreamingQueryListener):
    """The last state of each named stream; totals: the rows that are expected, by name."""

    def __init__(self, totals: dict[str, int] | None = None):
        self.totals, self.done, self.speed, self.over = totals or {}, {}, {}, set()
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.done[name] = self.done.get(name, 0) + (p.numInputRows or 0)
        if p.numInputRows:
            self.speed[name] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.over.add(self.names.get(str(event.id), str(event.id)))

    def table(self, spark: SparkSession) -> DataFrame:
        """PROGRESS, one row a stream."""
        rows = []
        for name, done in sorted(self.done.items()):
            total, speed = self.totals.get(name), self.speed.get(name)
            left = 0.0 if name in self.over else None if total is None or not speed else max(0, total - done) / speed
            rows.append((name, done, total, speed, left))
        return spark.createDataFrame(rows, PROGRESS)
