"""Ranked lexical search: documents at a time over compressed postings per shard.

Documents are cut into shards where they lie: at most SHARD_DOCS documents or
SHARD_POSTINGS postings, sorted by id. A shard keeps, for each word asked for, the
places of the documents that hold it and how often, in blocks of BLOCK entries of
variable-length bytes (gaps, then counts), each with its last place, largest count
and shortest document. Counts of documents and words, summed by Spark, give the
weights of the words.

A task then answers every query over its shards. The cursors of the query's words
lie in a heap by the last place of their current block; up to the lowest one no
cursor needs a further block, so the documents of that window get their whole
scores at once from the merged blocks. A window whose bound is below the
query's worst kept score isn't opened. The best `most` documents of a query stay
in a bounded heap keyed by score, then id. Spark merges the heaps of all tasks.

Queries come in slices of at most SLICE_BYTES of text, so what goes to the tasks
is bounded; each slice is a pass over the documents.

Words are compared by 64-bit fingerprints. Scores are whole numbers, as stated at
`search`.

Defined cases: a null text and one without words count nowhere and are never
found; texts of any length are read whole; rows of repeated documents are found
one by one; a document without an id comes after all ids of equal score; of
repeated queries each gets its own result; a query without words has none; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.arrowtext import Words, column, parts, raw
from docloom.llm.common import Tables, checkpoint, map_arrow

#: Class 1: ASCII letters and digits and all that isn't ASCII.
TERM = np.zeros(256, np.uint8)
TERM[[b for b in range(256) if b > 127 or chr(b).isalnum()]] = 1

SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16_384, 1_000_000, 1024
SLICE_BYTES = 4 << 20


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as variable-length bytes, seven bits each, low ones first; and where each begins (one more entry)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k))
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        more = (size[own] > k + 1).astype(np.uint8) << 7
        out[at[:-1][own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, at


def from_bytes(data: np.ndarray) -> np.ndarray:
    """The whole numbers that `to_bytes` wrote."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins)


_SHARD = (
    "n_docs long, n_words long, ids array<long>, lengths array<long>, terms array<int>, dfs array<int>, "
    "first array<int>, last array<int>, most_tf array<long>, least_length array<long>, at array<long>, data binary"
)
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary()]


class Builder:
    """Gathers documents into one shard."""

    def __init__(self, known: np.ndarray):
        self.known = known  # sorted fingerprints of the words asked for
        self.clear()

    def clear(self) -> None:
        self.n_docs = self.n_words = self.docs = self.postings = 0
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, ids: list, texts: pa.Array) -> None:
        """Documents with these ids and lower-cased texts; those without a word asked for only count."""
        words = Words(*raw(texts), TERM)
        length = np.diff(words.first)
        self.n_docs += int((length > 0).sum())
        self.n_words += int(length.sum())
        hashes = words.hashes()
        term = np.searchsorted(self.known, hashes)
        term[term == len(self.known)] = 0
        hit = self.known[term] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        both, tf = np.unique(words.row_of_word()[hit] * len(self.known) + term[hit], return_counts=True)
        row, place = np.unique(both // max(1, len(self.known)), return_inverse=True)
        self.ids += [ids[k] for k in row.tolist()]
        self.lengths.append(length[row])
        self.rows.append(place + self.docs)
        self.terms.append(both % max(1, len(self.known)))
        self.counts.append(tf)
        self.docs += len(row)
        self.postings += len(both)

    def full(self) -> bool:
        return self.docs >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def shard(self) -> tuple:
        """The row of the shard; documents sorted by id, those without one last."""
        order = sorted(range(self.docs), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        gather = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        length = gather(self.lengths)[order] if self.docs else np.zeros(0, np.int64)
        doc, term, tf = place[gather(self.rows)], gather(self.terms), gather(self.counts)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        terms, begin, dfs = np.unique(term, return_index=True, return_counts=True)
        in_term = np.arange(len(doc)) - np.repeat(begin, dfs)
        opens = np.flatnonzero(in_term % BLOCK == 0)  # a block's first place is written in full
        gap = np.diff(doc, prepend=0)
        gap[opens] = doc[opens]
        size = np.diff(np.append(opens, len(doc)))
        # Per block: all gaps, then all counts.
        at = np.arange(len(doc)) + np.repeat(opens, size)
        mixed = np.empty(2 * len(doc), np.int64)
        mixed[at], mixed[at + np.repeat(size, size)] = gap, tf
        data, offsets = to_bytes(mixed)
        reduce = lambda f, x: f.reduceat(x, opens) if len(opens) else x[:0]
        out = (
            self.n_docs, self.n_words, [self.ids[k] for k in order], length, terms, dfs,
            np.searchsorted(opens, np.append(begin, len(doc))), doc[opens + size - 1], reduce(np.maximum, tf), reduce(np.minimum, length[doc]),
            offsets[2 * np.append(opens, len(doc))], data.tobytes(),
        )
        self.clear()
        return out


def shards(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Shards of the documents (doc_id, text) with the postings of the words with these sorted fingerprints."""

    def run(batches):
        own = Builder(known)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own.shard(), _KINDS, strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), column(batch, "text", lower=True)
            for lo, hi in parts(texts):
                own.add(ids[lo:hi], texts.slice(lo, hi - lo))
                if own.full():
                    yield row()
        if own.n_docs:
            yield row()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SHARD)


class Shard:
    """Reads a shard's blocks. part: the factor of a word's weight, by count and document length."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        self.ids, self.weights, self.n, self.total = row["ids"], weights, n, total
        self.m = self.scale(np.array(row["lengths"], np.int64))
        self.first, self.last, self.at = (np.array(row[k], np.int64) for k in ("first", "last", "at"))
        self.slot = {t: k for k, t in enumerate(row["terms"])}
        self.data = np.frombuffer(row["data"], np.uint8)
        term = np.repeat(np.array(row["terms"], np.int64), np.diff(self.first))
        self.weight = weights[term]
        self.bound = self.weight * self.part(np.array(row["most_tf"], np.int64), self.scale(np.array(row["least_length"], np.int64)))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scale(self, length: np.ndarray) -> np.ndarray:
        return 50 + (50 * length * self.n) // max(1, self.total)

    @staticmethod
    def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a block's documents and what its word adds to their scores."""
        if k not in self.open:
            both = from_bytes(self.data[self.at[k] : self.at[k + 1]])
            doc, tf = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
            self.open[k] = doc, self.weight[k] * self.part(tf, self.m[doc])
        return self.open[k]


class Best:
    """The best `most` documents of one query, as a heap with the worst on top."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    def least(self) -> int:
        """The lowest score that may still enter."""
        return self.heap[0][0] if len(self.heap) == self.most else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        for k in np.flatnonzero(scores >= self.least()).tolist():
            doc_id = ids[docs[k]]
            entry = int(scores[k]), doc_id is not None, 0 if doc_id is None else -doc_id
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def answer(shard: Shard, terms: list[int], best: Best) -> None:
    """All documents of the shard that hold one of the words, window by window."""
    now: dict[int, int] = {}  # the block of each cursor
    heap: list[tuple[int, int]] = []
    for slot in (shard.slot[t] for t in terms if t in shard.slot):
        now[slot] = int(shard.first[slot])
        heap.append((int(shard.last[now[slot]]), slot))
    heapq.heapify(heap)
    low = -1  # documents up to here are done
    while heap:
        high = heap[0][0]
        if int(shard.bound[list(now.values())].sum()) >= best.least():
            docs, adds = [], []
            for k in now.values():
                doc, add = shard.block(k)
                lo, hi = np.searchsorted(doc, (low, high), "right")
                if lo < hi:
                    docs.append(doc[lo:hi])
                    adds.append(add[lo:hi])
            doc, add = np.concatenate(docs), np.concatenate(adds)
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            best.add(np.add.reduceat(add[order], begin), doc[begin], shard.ids)
        low = high
        while heap and heap[0][0] == high:
            slot = heap[0][1]
            now[slot] += 1
            if now[slot] == shard.first[slot + 1]:
                heapq.heappop(heap)
                del now[slot]
            else:
                heapq.heapreplace(heap, (int(shard.last[now[slot]]), slot))


def _slices(queries: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The queries (id, text) in slices of bounded size."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for key, text in queries.toLocalIterator():
        ids.append(key)
        texts.append(text or "")
        size += 16 + len(texts[-1])
        if size >= SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _best_of_slice(docs: DataFrame, texts: list[str], most: int) -> DataFrame:
    """(query, rank, doc_id, score); query: the text's place in the slice."""
    lowered = column(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text", lower=True)
    words = Words(*raw(lowered), TERM)
    known, number = np.unique(words.hashes(), return_inverse=True)
    asked = [np.unique(number[a:b]).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    with Tables(docs.sparkSession, "lexical") as tables:
        held = tables.put(shards(docs, known))
        n, total = held.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        pairs = held.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.dfs").alias("df"))
        for term, count in pairs.collect():  # one row for each word asked for
            df[term] = count
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)

        def run(batches):
            kept = [Best(most) for _ in asked]
            for batch in batches:
                for k in range(batch.num_rows):
                    shard = Shard({c: batch.column(c)[k].as_py() for c in batch.schema.names}, weights, n, total)
                    for terms, best in zip(asked, kept, strict=True):
                        answer(shard, terms, best)
            found = [(q, -x if there else None, score) for q, best in enumerate(kept) for score, there, x in best.heap]
            cells = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "doc_id", "score"])

        found = map_arrow(held, run, "query int, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        return checkpoint(ranked.select("query", "rank", "doc_id", "score"))


def search(docs: DataFrame, queries: DataFrame, most: int = 50) -> DataFrame:
    """The best `most` documents (doc_id, text) of each query (item_id, text): item_id, rank from 1, doc_id, score.

    With N documents that have words, L words in them, n words in a document, df
    documents that have a word and tf places of it in the document, the score is the
    sum over the query's words, once each, of
    floor(1000 ln((2 N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 20 (50 + 50 n N div L))).
    Scores above 0 only; equal ones by id.
    """
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for ids, texts in _slices(queries.select("item_id", "text")):
        names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, to_arrow_type(kind))}))
        found = _best_of_slice(docs, texts, most)
        out = out.unionByName(found.join(F.broadcast(names), "query").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    return out
