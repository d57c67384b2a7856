"""Vector bin packing of training examples under several limits at once.

A sequence holds at most so many tokens, segments and loss-bearing tokens. An
example asks for some of each. The open sequence takes, of the examples that
fit, the one whose demand has the largest dot product with what the sequence has
left, each dimension weighted by how scarce it is among the examples that wait.
Examples of equal demand are one kind with a count, so a choice looks at kinds,
not at rows. When no whole example fits, one is cut to fill the sequence exactly,
and its rest waits like any other.

Sequences are padded to the limit unless their length is a power of two, so a
sequence that another limit closes early, and the last one of all, are cut down
to powers of two.

Each task packs the examples that it tokenised, window by window (WINDOW_TOKENS
of ids at most and the rest of the window before), so nothing is shuffled but
what a task has left at its end: the examples of less than one sequence. Groups
of GROUP tasks pack these again, and again, until one group is left; each level
carries a sequence's worth per group. Every level ends in a reliable checkpoint,
so a lost executor costs its own tasks only.

Defined cases: a null or empty text is the single end token; an example longer
than a sequence is cut into whole sequences as far as its loss tokens allow and
a rest; rows with null ids and repeated rows are packed like any other; ties in
the dot product go to the kind that came first, and within a kind to the example
that did; an empty table gives an empty result; only the named columns are read,
whatever others are called.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import column
from docloom.llm.common import checkpoint, map_arrow
from docloom.llm.packing import END, encoder

TOKENS, SEGMENTS = 2048, 256
LEAST_PIECE = 16  # tokens of a piece that is cut off and doesn't fill its sequence
WINDOW_TOKENS = 2 << 20
GROUP = 64


class Example:
    """Consecutive tokens of one document that lie in no sequence yet."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "loss", "start")

    def __init__(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray, loss: np.ndarray | None):
        self.doc_id, self.start, self.doc_tokens, self.ids, self.loss = doc_id, start, doc_tokens, ids, loss

    def demand(self, n: int | None = None) -> tuple[int, int]:
        """Tokens and loss-bearing tokens of the first n. Without a mask all but the first of a piece bear loss: nothing stands before that one."""
        n = len(self.ids) if n is None else n
        return n, n - 1 if self.loss is None else int(self.loss[1:n].sum())

    def cut(self, n: int) -> tuple[Example, Example]:
        head, tail = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return (
            Example(self.doc_id, self.start, self.doc_tokens, self.ids[:n], head),
            Example(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:], tail),
        )

    def longest(self, tokens: int, loss: int) -> int:
        """How many of the first tokens keep within both limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return max(1, min(n, loss + 1))
        return max(1, int(np.searchsorted(np.cumsum(self.loss[1:n]), loss, "right")) + 1)


class Pool:
    """The examples that wait, by kind (tokens, loss tokens); the kinds as arrays for the dot products."""

    def __init__(self):
        self.held: list[deque[Example]] = []
        self.row: dict[tuple[int, int], int] = {}
        self.tokens, self.loss, self.there = np.zeros(64), np.zeros(64), np.zeros(64, bool)
        self.total = np.zeros(3)  # tokens, examples, loss tokens

    def __bool__(self) -> bool:
        return bool(self.total[1])

    def add(self, x: Example, first: bool = False) -> None:
        kind = x.demand()
        row = self.row.setdefault(kind, len(self.row))
        if row == len(self.held):
            if row == len(self.there):
                self.tokens, self.loss, self.there = (np.concatenate([a, np.zeros_like(a)]) for a in (self.tokens, self.loss, self.there))
            self.tokens[row], self.loss[row] = kind
            self.held.append(deque())
        (self.held[row].appendleft if first else self.held[row].append)(x)
        self.there[row] = True
        self.total += kind[0], 1, kind[1]

    def take(self, row: int) -> Example:
        x = self.held[row].popleft()
        self.there[row] = bool(self.held[row])
        self.total -= self.tokens[row], 1, self.loss[row]
        return x

    def best(self, left: tuple[int, int, int], limits: np.ndarray) -> int | None:
        """The kind that fits and has the largest weighted dot product with what is left.

        A dimension weighs as many sequences as the waiting examples need of it. Each
        example is one segment, so that term is the same for all.
        """
        n = len(self.held)
        tokens, loss = self.tokens[:n], self.loss[:n]
        pull = self.total / limits * left / limits / limits
        score = np.where(self.there[:n] & (tokens <= left[0]) & (loss <= left[2]), pull[0] * tokens + pull[1] + pull[2] * loss, -1.0)
        row = int(score.argmax())
        return row if score[row] >= 0 else None

    def longest(self) -> int:
        n = len(self.held)
        return int(np.where(self.there[:n], self.tokens[:n], -1.0).argmax())


class Packer:
    """Fills sequences from a pool; `emit` gets the examples of each finished one."""

    def __init__(self, limits: tuple[int, int, int], emit: Callable[[list[Example]], None]):
        if min(limits) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.emit, self.pool = limits, emit, Pool()
        self.per = np.array(limits, float)

    def add(self, x: Example) -> None:
        """An example joins the pool; what fills sequences alone is cut off at once."""
        tokens, _, loss = self.limits
        while len(x.ids) >= tokens:
            n = x.longest(tokens, loss)
            if n < tokens:
                break
            head, x = x.cut(n)
            self.emit([head])
        if len(x.ids):
            self.pool.add(x)

    def run(self, finish: bool) -> list[Example]:
        """Packs what waits. Unless it is to finish, an unfinished sequence's examples come back."""
        while self.pool:
            taken, (room, segments, loss) = [], self.limits
            while room and segments and self.pool:
                row = self.pool.best((room, segments, loss), self.per)
                x = None
                if row is None or segments == 1 and self.pool.tokens[row] < room:
                    x = self._piece(room, loss, not taken)
                if x is None:
                    if row is None:
                        break
                    x = self.pool.take(row)
                used = x.demand()
                room, segments, loss = room - used[0], segments - 1, loss - used[1]
                taken.append(x)
            if not room:
                self.emit(taken)
            elif self.pool:
                self._close(taken)
            elif not finish:
                self.pool = Pool()
                return taken
            else:
                while taken:
                    taken = self._close(taken, wait=False)
        self.pool = Pool()
        return []

    def _piece(self, room: int, loss: int, alone: bool) -> Example | None:
        """The first part of the longest example, as much as there is room for; None if that is next to nothing."""
        x = self.pool.take(self.pool.longest())
        n = x.longest(room, loss)
        if n < min(room, LEAST_PIECE) and not alone:
            self.pool.add(x, first=True)
            return None
        if n < len(x.ids):
            x, rest = x.cut(n)
            self.pool.add(rest, first=True)
        return x

    def _close(self, taken: list[Example], wait: bool = True) -> list[Example]:
        """A sequence of the largest power of two of tokens; what is over waits or comes back."""
        room = 1 << (sum(len(x.ids) for x in taken).bit_length() - 1)
        held, over = [], []
        for x in taken:
            if len(x.ids) <= room:
                held.append(x)
                room -= len(x.ids)
            elif room:
                head, tail = x.cut(room)
                held.append(head)
                over.append(tail)
                room = 0
            else:
                over.append(x)
        self.emit(held)
        if wait:
            for x in over:
                self.pool.add(x, first=True)
        return over


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WAITING = ", part int, place int, ids binary, loss binary"


class _Rows:
    """Placed pieces and waiting examples of a task as Arrow batches."""

    def __init__(self, part: int, level: int, keep_ids: bool):
        self.part, self.keep_ids = part, keep_ids
        self.sequence = (level << 56) | (part << 32)
        self.rows: list[tuple] = []

    def emit(self, examples: list[Example]) -> None:
        offset = 0
        for x in examples:
            data = x.ids.astype("<u4").tobytes()
            kept = (data, None if x.loss is None else x.loss.tobytes()) if self.keep_ids else (None, None)
            self.rows.append((x.doc_id, x.start, len(x.ids), zlib.crc32(data), x.doc_tokens, self.sequence, offset, None, None, *kept))
            offset += len(x.ids)
        self.sequence += 1

    def wait(self, examples: list[Example]) -> None:
        for k, x in enumerate(examples):
            loss = None if x.loss is None else x.loss.tobytes()
            self.rows.append((x.doc_id, x.start, len(x.ids), None, x.doc_tokens, None, None, self.part, k, x.ids.astype("<u4").tobytes(), loss))

    def batch(self) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()] * 2
        names = [x.split()[0] for x in (_PLACED + _WAITING).split(", ")]
        for at in range(0, len(self.rows), 4096):
            cells = zip(*self.rows[at : at + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names)
        self.rows = []


def _packed(examples: Iterator[Example | None], limits: tuple[int, int, int], part: int, level: int, finish: bool, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Packs examples in windows; None marks a place where rows may be given out."""
    rows = _Rows(part, level, keep_ids)
    packer = Packer(limits, rows.emit)
    for x in examples:
        if x is not None:
            packer.add(x)
        elif packer.pool.total[0] >= WINDOW_TOKENS:
            for y in packer.run(finish=False):
                packer.pool.add(y)
        if len(rows.rows) >= 4096:
            yield from rows.batch()
    rows.wait(packer.run(finish))
    yield from rows.batch()


def pack_examples(examples: DataFrame, read: Callable, limits: tuple[int, int, int], keep_ids: bool = False) -> DataFrame:
    """Placed pieces of the examples that `read` makes of each Arrow batch (an iterator of Example).

    limits: tokens, segments and loss-bearing tokens of a sequence. keep_ids: with
    columns ids (little-endian 32-bit) and loss (a byte a token, null where all but
    the first of a piece bear loss).
    """
    schema = _PLACED + _WAITING

    def first(batches):
        def each():
            for batch in batches:
                for x in read(batch):
                    yield x
                    yield None

        yield from _packed(each(), limits, TaskContext.get().partitionId(), 0, False, keep_ids)

    def again(level: int, finish: bool):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by([("part", "ascending"), ("place", "ascending")])
            waiting = (
                Example(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], np.uint32), None if r["loss"] is None else np.frombuffer(r["loss"], np.uint8))
                for batch in table.to_batches(max_chunksize=256)
                for r in batch.to_pylist()
            )
            done = list(_packed(waiting, limits, key[0].as_py(), level, finish, keep_ids))
            return pa.Table.from_batches(done, schema=table.schema.remove(table.schema.get_field_index("group"))) if done else table.drop_columns("group").slice(0, 0)

        return run

    level = checkpoint(map_arrow(examples, first, schema))
    placed = level.where("part IS NULL")
    for k in range(1, 128):
        waiting = level.where("part IS NOT NULL")
        last = waiting.agg(F.max("part")).first()[0]
        if last is None:
            break
        grouped = waiting.withColumn("group", F.floor(F.col("part") / GROUP).cast("int")).groupBy("group")
        level = checkpoint(grouped.applyInArrow(again(k, last < GROUP), schema))
        placed = placed.unionByName(level.where("part IS NULL"))
    return placed.drop("part", "place", *([] if keep_ids else ["ids", "loss"]))


def pack_documents(docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Documents as plain text: every token but the first of a piece bears loss."""
    tail = array("I", [end]).tobytes()

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(path)
        for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(column(batch, "text").to_pylist()), strict=True):
            data = np.frombuffer(ids + tail, np.uint32)
            yield Example(doc_id, 0, len(data), data, None)

    return pack_examples(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, (tokens, segments, loss), keep_ids)


def pack_conversations(
    turns: DataFrame, path: str, tokens: int = TOKENS, segments: int = 64, loss: int = 1024, answering: str = "assistant", end: int = END, keep_ids: bool = False
) -> DataFrame:
    """Instruction data (conv_id, turn, role, text): a conversation is one example, the tokens of the answering role bear loss.

    Each turn ends in the end token, which belongs to it. doc_id is the conversation's id.
    Turns are sorted by turn, nulls first; those of a null conversation are one.
    """
    tail = array("I", [end]).tobytes()

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(path)
        for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = [x + tail for x in own.encode([t["text"] or "" for t in said])]
            mask = np.repeat(np.array([t["role"] == answering for t in said], np.uint8), [len(x) // 4 for x in ids])
            data = np.frombuffer(b"".join(ids), np.uint32)
            yield Example(conv_id, 0, len(data), data, mask)

    held = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    return pack_examples(held, read, (tokens, segments, loss), keep_ids)
