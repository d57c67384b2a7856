"""A gated log: batches of a stream are written once each, while a flag is set, and the table keeps a bounded tail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.store import Change, Store

TAIL = 2000  # lines that stay when the log is cut


class LogSink:
    """The table `log` of a store. Rows and the number of their batch are put in place by one commit, so a repeated batch adds nothing.

    enabled: read for each batch; while it is false batches are passed over. order:
    the columns by which lines are older or newer. The log is cut to its last `tail`
    lines when it holds twice as many.
    """

    def __init__(self, store: Store, order: list[str], enabled: Callable[[], bool] = lambda: True, tail: int = TAIL):
        self.store, self.order, self.enabled, self.tail = store, order, enabled, tail

    def write(self, rows: DataFrame, batch: int, stream: str = "") -> None:
        """For foreachBatch; stream: a name for each stream that writes to this log."""
        on = self.enabled()

        def make(change: Change) -> None:
            done = dict(change.notes.get("batches", {}))
            if done.get(stream, -1) >= batch:
                return
            change.notes["batches"] = done | {stream: batch}
            if on and not rows.isEmpty():
                change.append("log", rows)

        base = self.store.at()
        if base.notes.get("batches", {}).get(stream, -1) < batch:
            self.store.transact(make)
            self.cut()

    def cut(self) -> None:
        """Leaves the last lines, if there are twice as many."""
        held = self.store.at().read("log")
        if held is not None and held.count() > 2 * self.tail:
            self.store.transact(lambda change: change.replace("log", self.last(self.tail, change)))

    def last(self, n: int, change: Change | None = None) -> DataFrame:
        """The last n lines, oldest first."""
        held = (self.store.at() if change is None else change.base).read("log")
        return held.orderBy(*[F.desc(c) for c in self.order]).limit(n).orderBy(*self.order)

    def stream(self, rows: DataFrame, name: str):
        """A writer of a stream; give it a checkpoint location and start it."""
        return rows.writeStream.foreachBatch(lambda df, batch: self.write(df, batch, name))
