"""A stored keyword index: sorted segments of compressed-by-column blocks, removed chunks, merges, and a top k that skips blocks.

Chunks are tokenised once, when they are added, where they lie: a task makes shards
of at most SHARD chunks, and a shard holds, for each term in order, blocks of at most
BLOCK postings (chunk ids, counts, lengths, places) with the first and last id, the
largest count and the extreme lengths. The row with the empty term is the shard's
directory of chunks. A segment is what one update adds; removed chunks are rows of
their own until a merge writes their shards anew.

A search reads the blocks' headings first. They give the weights of the words and,
from what each block is sure to hold, a score that the k-th best chunk of a query
reaches at least. A block is read only where it and all blocks of the query beside
it could add up to that. So the result is exact, and for phrases too: their places
are met in the blocks of their words, before any block is skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.slices import each_slice
from docloom.functions.text import tokens
from docloom.operators.search import B, K1, Asked, Top, _bm25_part, asked_phrases, best_of_all
from docloom.session import reliable
from docloom.sources.store import Change, Snapshot

SHARD, SHARD_TOKENS, BLOCK = 16_384, 4_000_000, 512
BROADCAST_BLOCKS = 200_000
HEADING = ["shard", "term", "block", "first", "last", "n", "most_tf", "least_dl", "most_dl"]
_SCHEMA = (
    "shard string, term string, block int, first long, last long, n int, most_tf int, least_dl int, most_dl int, "
    "chunks array<long>, tfs array<int>, dls array<int>, places array<int>"
)
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 3
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
GONE = "\x00"  # stands for a term in the rows of removed chunks, PHRASE + number in those of a phrase's places
PHRASE = "\x01"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def _blocks(shard: str, terms: pa.Array, code: np.ndarray, chunk: np.ndarray, tf: np.ndarray, dl: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Block rows of postings sorted by (code, chunk); terms: the texts of the codes; places: of all postings, one after the other."""
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    count = np.diff(np.append(begin, len(code)))
    in_term = np.arange(len(code)) - np.repeat(begin, count)
    opens = np.flatnonzero(in_term % BLOCK == 0)
    ends = np.append(opens[1:], len(code)) if len(opens) else opens
    place_ends = np.cumsum(tf)[ends - 1] if len(ends) else ends
    reduced = lambda f, x: f.reduceat(x, opens) if len(opens) else x[:0]
    arrays = [
        pa.array([shard] * len(opens), pa.string()), terms.take(pa.array(code[opens])).cast(pa.string()), in_term[opens] // BLOCK, chunk[opens], chunk[ends - 1], ends - opens,
        reduced(np.maximum, tf), reduced(np.minimum, dl), reduced(np.maximum, dl),
        _lists(chunk, ends, pa.int64()), _lists(tf, ends, pa.int32()), _lists(dl, ends, pa.int32()), _lists(places, place_ends, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, _KINDS, strict=True)], _NAMES)


def _directory(shard: str, chunk: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(chunk, kind="stable")
    chunk, dl = chunk[order], dl[order]
    row = [[shard], [""], [0], [chunk[0]], [chunk[-1]], [len(chunk)], [0], [dl.min()], [dl.max()], [chunk], [None], [dl], [None]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _KINDS, strict=True)], _NAMES)


def segment(chunks: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """The block rows of chunks (chunk_id, text), shard by shard; ids are distinct and not null."""
    name = uuid.uuid4().hex

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = size = made = 0

        def shard():
            nonlocal held, n, size, made
            own, lists = f"{name}/{TaskContext.get().partitionId()}/{made}", pa.chunked_array([b.column(1) for b in held]).combine_chunks()
            chunk = np.concatenate([b.column(0).to_numpy() for b in held])
            dl = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(dl)), dl)
            place = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
            by = np.lexsort((chunk[row], code))
            code, row, place = code[by], row[by], place[by]
            new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            tf = np.diff(np.append(new, len(code)))
            code, row = code[new], row[new]
            held, n, size, made = [], 0, 0, made + 1
            yield _directory(own, chunk, dl)
            yield _blocks(own, coded.dictionary.take(pa.array(order)), code, chunk[row], tf, dl[row], place)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                n, size = n + part.num_rows, size + len(part.column(1).flatten())
                if n >= SHARD or size >= SHARD_TOKENS:
                    yield from shard()
        if n:
            yield from shard()

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), tokenize(F.col("text")).alias("terms")).mapInArrow(run, _SCHEMA)


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The blocks of several shards (`_from`; and their removed chunks) as those of one."""
    table = table.combine_chunks()
    shards = table["_from"].combine_chunks().dictionary_encode()
    several = len(shards.dictionary)
    table = table.set_column(table.schema.get_field_index("_from"), "_from", shards.indices)
    gone = pc.equal(table["term"], GONE)
    directory, blocks, gone = table.filter(pc.equal(table["term"], "")), table.filter(pc.and_(pc.not_equal(table["term"], ""), pc.invert(gone))), table.filter(gone)
    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy().astype(np.int64)
    ids = np.unique(flat(directory, "chunks"))

    def own(t: pa.Table) -> np.ndarray:
        """A number for each chunk of each shard, as an id can be gone in one and live in another."""
        return np.searchsorted(ids, flat(t, "chunks")) * several + np.repeat(t["_from"].to_numpy(), pc.list_value_length(t["chunks"]).to_numpy())

    dead = own(gone)
    chunk, dl, live = flat(directory, "chunks"), flat(directory, "dls"), ~np.isin(own(directory), dead)
    out = [_directory(key[0].as_py(), chunk[live], dl[live])] if live.any() else []
    if len(blocks):
        chunk, tf, dl, places = (flat(blocks, c) for c in ("chunks", "tfs", "dls", "places"))
        coded = blocks["term"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = np.repeat(rank[coded.indices.to_numpy()], blocks["n"].to_numpy())
        by = np.lexsort((chunk, code))
        by = by[~np.isin(own(blocks), dead)[by]]
        begin, count = np.cumsum(tf) - tf, tf[by]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[by], count)
        out.append(_blocks(key[0].as_py(), coded.dictionary.take(pa.array(order)), code[by], chunk[by], count, dl[by], places[at]))
    return pa.Table.from_batches(out, pa.schema(list(zip(_NAMES, _KINDS, strict=True))))


class KeywordIndex:
    """The tables `name` (block rows) and `name`_gone (removed chunks by shard) of a store.

    Counts of live chunks and their words are notes of the snapshot.
    """

    def __init__(self, name: str = "postings", tokenize: Callable[[Column], Column] = tokens):
        self.name, self.gone, self.tokenize = name, f"{name}_gone", tokenize

    def live(self, snapshot: Snapshot) -> tuple[int, int]:
        return tuple(snapshot.notes.get(self.name, (0, 0)))

    def _directory(self, snapshot: Snapshot) -> DataFrame | None:
        """shard, chunk_id, dl of the live chunks."""
        blocks, gone = snapshot.read(self.name), snapshot.read(self.gone)
        if blocks is None:
            return None
        rows = blocks.where("term = ''").select("shard", F.inline(F.arrays_zip("chunks", "dls"))).select("shard", F.col("chunks").alias("chunk_id"), F.col("dls").alias("dl"))
        return rows if gone is None else rows.join(gone.select("shard", "chunk_id"), ["shard", "chunk_id"], "left_anti")

    def update(self, change: Change, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        """Chunks (chunk_id, text) join the index, in the place of those with their ids; chunks to remove (chunk_id) go.

        A change takes one update of an index.
        """
        n, length = self.live(change.base)
        going = [x.select(F.col("chunk_id").cast("long").alias("chunk_id")) for x in (add, remove) if x is not None]
        held = self._directory(change.base)
        if held is not None and going:
            ids = going[0] if len(going) == 1 else going[0].union(going[1])
            dead = reliable(held.join(ids.distinct(), "chunk_id", "left_semi"))
            m, less = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if m:
                change.append(self.gone, dead)
                n, length = n - m, length - less
        if add is not None:
            change.append(self.name, segment(add, self.tokenize), **{"parquet.block.size": 8 << 20})
            new = change.store.spark.read.parquet(f"{change.store.root}/{change.tables[self.name][-1].path}").where("term = ''")
            m, more = new.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(dls, 0L, (s, x) -> s + x)")), F.lit(0))).first()
            n, length = n + m, length + more
        change.notes[self.name] = [n, length]

    def merge(self, change: Change) -> None:
        """Small shards and those with removed chunks are written anew, together with others up to SHARD chunks; full ones stay."""
        blocks, gone = change.base.read(self.name), change.base.read(self.gone)
        if blocks is None:
            return
        size = blocks.where("term = ''").groupBy("shard").agg(F.sum("n").alias("n"))
        dead = None if gone is None else gone.groupBy("shard").agg(F.count("*").alias("dead"))
        size = size.withColumn("dead", F.lit(0)) if dead is None else size.join(dead, "shard", "left").fillna(0, ["dead"])
        worn = size.where((F.col("dead") > 0) | (F.col("n") * 2 < SHARD)).withColumn("live", F.col("n") - F.col("dead"))
        total = worn.agg(F.coalesce(F.sum("live"), F.lit(0))).first()[0]
        name, parts = uuid.uuid4().hex, max(1, -(-total // SHARD))
        target = reliable(worn.select("shard", F.concat(F.lit(f"{name}/"), F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("string")).alias("_to")))
        kept = blocks.join(target, "shard", "left_anti")
        moving = blocks
        if gone is not None:
            nothing = {"block": "int", "first": "long", "last": "long", "n": "int", "most_tf": "int", "least_dl": "int", "most_dl": "int", "tfs": "array<int>", "dls": "array<int>", "places": "array<int>"}
            as_rows = gone.groupBy("shard").agg(F.collect_list("chunk_id").alias("chunks")).withColumns({"term": F.lit(GONE), **{c: F.lit(None).cast(t) for c, t in nothing.items()}})
            moving = blocks.unionByName(as_rows)
        anew = moving.join(target, "shard").withColumns({"_from": F.col("shard"), "shard": F.col("_to")}).drop("_to").groupBy("shard").applyInArrow(_merged, _SCHEMA)
        change.replace(self.name, kept.unionByName(anew).sortWithinPartitions("shard", "term", "block"))
        change.tables[self.gone] = []

    def search(self, snapshot: Snapshot, queries: DataFrame, most: int) -> DataFrame:
        """query_id, chunk_id, score (4 digits), place: as `bm25` over the live chunks, which aren't read or tokenised again."""
        kind = queries.schema["query_id"].dataType
        return each_slice(asked_phrases(queries, self.tokenize), lambda rows: _Search(self, snapshot, Asked(rows, to_arrow_type(kind)), most).found(kind.simpleString()))


class _Search:
    """One slice of queries over one snapshot."""

    def __init__(self, index: KeywordIndex, snapshot: Snapshot, asked: Asked, most: int):
        self.spark, self.asked, self.most = snapshot.store.spark, asked, most
        self.blocks, self.gone = snapshot.read(index.name), snapshot.read(index.gone)
        if self.blocks is None:
            self.blocks = self.spark.createDataFrame([], _SCHEMA)
        n, length = index.live(snapshot)
        self.n, self.mean = n, length / n if length else 1.0
        self.single = {p[0]: k for k, p in enumerate(asked.phrases) if len(p) == 1}
        self.several = [(k, p) for k, p in enumerate(asked.phrases) if len(p) > 1]
        # An index keeps to the words asked for: the scan gets them as a filter.
        self.own = self.blocks.where(F.col("term").isin([*self.single]))
        self.hits = self._phrases()
        self.idf = asked.idf(n, self._frequencies())

    def _gone_rows(self) -> DataFrame | None:
        return None if self.gone is None else self.gone.groupBy("shard").agg(F.collect_list("chunk_id").alias("chunks")).select(
            "shard", F.lit(GONE).alias("term"), "chunks", F.lit(None).cast("array<int>").alias("tfs"), F.lit(None).cast("array<int>").alias("dls")
        )

    def _phrases(self) -> DataFrame | None:
        """shard, term (PHRASE and number), chunks, tfs, dls: where the phrases of several words stand, removed chunks among them."""
        if not self.several:
            return None
        several = self.several
        words = sorted({w for _, p in several for w in p})

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            held: dict[str, list] = {}
            for b in table.to_batches():
                for k in range(b.num_rows):
                    tf = b.column(3)[k].values.to_numpy()
                    places = np.repeat(b.column(2)[k].values.to_numpy(), tf), b.column(5)[k].values.to_numpy(), np.repeat(b.column(4)[k].values.to_numpy(), tf)
                    held.setdefault(b.column(1)[k].as_py(), []).append(places)
            joined = {w: [np.concatenate(x) for x in zip(*parts, strict=True)] for w, parts in held.items()}
            ids = np.unique(np.concatenate([x[0] for x in joined.values()]))
            width = 1 + max(int(x[1].max()) for x in joined.values())
            at = {w: np.searchsorted(ids, x[0]) * (width + 64) + x[1] for w, x in joined.items()}
            out = []
            for number, phrase in several:
                if not all(w in at for w in phrase):
                    continue
                there = at[phrase[0]]
                for k, w in enumerate(phrase[1:], 1):
                    there = there[np.isin(there + k, at[w])]
                if len(there):
                    chunk, tf = np.unique(there // (width + 64), return_counts=True)
                    first = joined[phrase[0]]
                    length = dict(zip(first[0].tolist(), first[2].tolist(), strict=True))
                    out.append((key[0].as_py(), f"{PHRASE}{number}", ids[chunk], tf, [length[c] for c in ids[chunk].tolist()]))
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            cells = zip(*out, strict=True) if out else [[]] * 5
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["shard", "term", "chunks", "tfs", "dls"])

        rows = self.blocks.where(F.col("term").isin(words)).select("shard", "term", "chunks", "tfs", "dls", "places")
        return reliable(rows.groupBy("shard").applyInArrow(run, "shard string, term string, chunks array<long>, tfs array<int>, dls array<int>"))

    def _frequencies(self) -> np.ndarray:
        """Live chunks that have each phrase."""
        df = np.zeros(len(self.asked.phrases))
        rows = self.own.groupBy("term").agg(F.sum("n").alias("n"))
        if self.hits is not None:
            rows = rows.union(self.hits.groupBy("term").agg(F.sum(F.size("chunks")).alias("n")))
        if self.gone is not None:
            worn = self.gone.groupBy("shard").agg(F.min("chunk_id").alias("_low"), F.max("chunk_id").alias("_high"))
            worn_blocks = self.own.join(worn, "shard").where("first <= _high AND last >= _low").select("shard", "term", "chunks")
            if self.hits is not None:
                worn_blocks = worn_blocks.union(self.hits.select("shard", "term", "chunks"))
            dead = worn_blocks.select("shard", "term", F.explode("chunks").alias("chunk_id")).join(self.gone.select("shard", "chunk_id"), ["shard", "chunk_id"], "left_semi")
            rows = rows.union(dead.groupBy("term").agg((-F.count("*")).alias("n")))
        for term, n in rows.groupBy("term").agg(F.sum("n")).collect():  # a row for each phrase asked for
            df[int(term[1:]) if term.startswith(PHRASE) else self.single[term]] = n
        return df

    def least(self) -> np.ndarray:
        """A score that the k-th best chunk of each query reaches, from what the blocks of one word are sure to hold."""
        out = np.zeros(self.asked.queries)
        weights = [(w, int(self.asked.owner[at]), float(self.asked.times[at] * self.idf[k])) for w, k in self.single.items() for at in range(self.asked.first[k], self.asked.first[k + 1])]
        if not weights:
            return out
        asked = self.spark.createDataFrame(weights, "term string, query int, weight double")
        heads = self.own.select("shard", "term", "block", "n", "most_dl")
        if self.gone is not None:  # any of a shard's removed chunks may lie in any of its blocks
            heads = heads.join(self.gone.groupBy("shard").agg(F.count("*").alias("dead")), "shard", "left").withColumn("n", F.col("n") - F.coalesce("dead", F.lit(0)))
        sure = F.col("weight") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("most_dl") / self.mean))
        rows = heads.where("n > 0").join(F.broadcast(asked), "term").withColumn("sure", sure)
        w = Window.partitionBy("query", "term").orderBy(F.desc("sure"), "shard", "block")
        rows = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= self.most)  # each block has a chunk at least
        enough = rows.withColumn("_n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") >= self.most)
        for query, score in enough.groupBy("query").agg(F.max("sure")).collect():
            out[query] = score
        return out

    def needed(self) -> DataFrame:
        """shard, term, block of the blocks that may add to one of the best chunks of a query."""
        asked, idf, mean, single, least = self.asked, self.idf, self.mean, self.single, self.least()
        extra = np.zeros(asked.queries)  # what phrases of several words may add to any chunk
        for k, _ in self.several:
            own = slice(asked.first[k], asked.first[k + 1])
            np.add.at(extra, asked.owner[own], asked.times[own] * idf[k] * (K1 + 1))

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            word = np.array([single[t] for t in table["term"].to_pylist()], np.int64)
            first, last = table["first"].to_numpy(), table["last"].to_numpy()
            most = idf[word] * _bm25_part(table["most_tf"].to_numpy(), table["least_dl"].to_numpy(), mean)
            of: dict[int, list] = {}  # by query: blocks and how often their word is asked for
            for k in range(len(word)):
                for at in range(asked.first[word[k]], asked.first[word[k] + 1]):
                    of.setdefault(int(asked.owner[at]), []).append((k, asked.times[at]))
            keep = np.zeros(len(word), bool)
            for query, blocks in of.items():
                own = np.array([k for k, _ in blocks])
                if least[query] <= 0:
                    keep[own] = True
                    continue
                edges = np.unique(np.concatenate([first[own], last[own] + 1]))
                begin, end = np.searchsorted(edges, first[own]), np.searchsorted(edges, last[own] + 1)
                change = np.zeros(len(edges) + 1)
                worth = most[own] * np.array([t for _, t in blocks])
                np.add.at(change, begin, worth)
                np.add.at(change, end, -worth)
                total = np.cumsum(change)[:-1] + extra[query]
                bounds = np.maximum.reduceat(total, np.stack([begin, end], 1).ravel())[::2]
                keep[own[bounds >= least[query] * (1 - 1e-6) - 1e-6]] = True
            return table.select(["shard", "term", "block"]).filter(pa.array(keep))

        return self.own.select(*HEADING).groupBy("shard").applyInArrow(run, "shard string, term string, block int")

    def found(self, kind: str) -> DataFrame:
        asked, idf, mean, single, most = self.asked, self.idf, self.mean, self.single, self.most
        needed = reliable(self.needed())
        some = F.broadcast(needed) if needed.count() <= BROADCAST_BLOCKS else needed
        rows = self.own.join(some, ["shard", "term", "block"], "left_semi").select("shard", "term", "chunks", "tfs", "dls")
        for more in (self.hits, self._gone_rows()):
            rows = rows if more is None else rows.unionByName(more)

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            gone = pc.equal(table["term"], GONE)
            dead = table.filter(gone)["chunks"].combine_chunks().flatten().to_numpy()
            table = table.filter(pc.invert(gone))
            chunk, tf, dl = (table[c].combine_chunks().flatten().to_numpy() for c in ("chunks", "tfs", "dls"))
            number = np.array([int(t[1:]) if t.startswith(PHRASE) else single[t] for t in table["term"].to_pylist()], np.int64)
            phrase = np.repeat(number, pc.list_value_length(table["chunks"]).to_numpy())
            live = ~np.isin(chunk, dead)
            chunk, tf, dl, phrase = chunk[live], tf[live], dl[live], phrase[live]
            by = np.lexsort((phrase, chunk))
            ids, row = np.unique(chunk[by], return_inverse=True)
            top = Top(asked, most)
            top.add(ids, row, phrase[by], idf[phrase[by]] * _bm25_part(tf[by], dl[by], mean))
            return pa.Table.from_batches([top.batch(pa.int64())])

        return best_of_all(rows.groupBy("shard").applyInArrow(run, f"query_id {kind}, chunk_id long, score double"), most)
