"""Best-fit packing of token sequences by exact complements.

Documents are tokenised and cut into pieces where they lie. The plan depends on
the lengths alone: a histogram (at most `capacity` numbers, whatever the corpus)
comes to the driver. Longest first, each length looks its gap up among the
single, pair and triple sums of the available lengths and consumes as many exact
combinations as the counts allow; what is left is packed best-fit into the gaps.
The plan says which ranks of each length go to which sequences and offsets, and
the pieces find their place by their rank among the pieces of their length.

Defined cases: a null or empty text is the single end token; texts of any length
are tokenised whole and cut into pieces; rows with null ids and repeated rows are
packed like any other; pieces of one length are told apart by their place in the
table alone, so ties don't matter; an empty table gives an empty result; only the
id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.arrowtext import column
from docloom.llm.common import checkpoint, map_arrow

CAPACITY, END = 4096, 1
BROADCAST_COUNTS = 500_000  # rows of piece counts by length and part
CACHE_WORDS, CACHE_LENGTH = 300_000, 64  # words that are remembered, of how many characters at most
LATIN_END = 0x300  # below it nothing composes, so NFC changes nothing


def _class(kind: str) -> str:
    """A regex class of the code points below LATIN_END whose category begins with a letter."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


#: How the vocabulary file says that texts are split.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_steps(spec: dict):
    """The tokenizer of a vocabulary file (its JSON) for pretokens between spaces, or None if it doesn't split texts by SPLIT."""
    from tokenizers import Tokenizer

    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"].get("Regex") != SPLIT:
        return None
    spec = spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
    return Tokenizer.from_str(json.dumps(spec))


class WordEncoder:
    """Token ids of texts; each distinct word is encoded once and remembered.

    The tokenizer lower-cases, drops white space and encodes each pretoken by
    itself, so a text's ids are those of its pretokens, one after the other. For
    texts of Latin script, which normalisation leaves alone, the pretokens are
    cut here, and new ones are encoded by the same merges without the steps that are
    done already; other texts, those where a special token may stand, and all texts
    if the file splits in another way, go to the tokenizer whole. Two generations of
    words are held, so memory is bounded and frequent words stay.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        with open(path, encoding="utf-8") as f:
            self._words = _plain_steps(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        letter, number, space = _class("L"), _class("N"), "\t-\r \x85\xa0"
        self._pretoken = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self._ascii = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
        self._other = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")

    def _whole(self, text: str) -> list[str] | None:
        """The pretokens of a text of Latin script; None for others."""
        if "<|" in text or self._words is None:
            return None
        low = text.lower()
        if low.isascii():
            return self._ascii.findall(low)
        # Some letters of the range have their small form beyond it, so the small forms are looked at.
        return None if self._other.search(low) else self._pretoken.findall(low)

    def _learn(self, fresh: list[str]) -> bool:
        """Encodes new pretokens side by side; each one's last id carries the mark of a word's end.

        False, and nothing learnt, if the tokenizer sees other words than these.
        """
        new = []
        for w in fresh:
            if w in self._old:
                self._young[w] = self._old[w]
            else:
                new.append(w)
        if not new:
            return True
        ids = np.array(self._words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(new):
            return False
        data, at = ids.tobytes(), 0
        for w, end in zip(new, (4 * ends).tolist(), strict=True):
            self._young[w] = data[at:end]
            at = end
        return True

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], group: int = 64) -> Iterator[bytes]:
        """Unsigned 32-bit ids of each text, in the machine's byte order; `group` texts are looked up at once."""
        for at in range(0, len(texts), group):
            own = texts[at : at + group]
            cut = [self._whole(t) for t in own]
            words = set().union(*(c for c in cut if c))
            if len(self._young) > self.cache:
                self._old, self._young = self._young, {}
            fresh = list(words.difference(self._young))
            if not self._learn(fresh):
                yield from map(self._plain, own)
                continue
            for text, c in zip(own, cut, strict=True):
                if c is None:
                    yield self._plain(text)
                else:
                    yield b"".join(itemgetter(*c)(self._young)) if len(c) > 1 else b"".join(map(self._young.get, c))
            for w in fresh:
                if len(w) > CACHE_LENGTH:
                    del self._young[w]


@lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE_WORDS) -> WordEncoder:
    return WordEncoder(path, cache)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, part and place (rank among the part's pieces of that length), and ids."""
    tail = array("I", [end]).tobytes()
    cache = CACHE_WORDS // 8 if keep_ids else CACHE_WORDS  # the ids of the batches take the room
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * keep_ids

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, part = encoder(path, cache), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            ids_of = batch.column(0).to_pylist()
            for doc_id, ids in zip(ids_of, own.encode(column(batch, "text").to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    data = np.frombuffer(ids, np.uint32)[start : start + capacity]
                    size = len(data)
                    rows.append((doc_id, k, start, size, zlib.crc32(data.astype("<u4").tobytes()), part, int(seen[size])))
                    seen[size] += 1
                    if keep_ids:
                        kept.append(data.astype(np.int32))
            cells = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cells, kinds, strict=True)]
            if keep_ids:
                offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


class Plan:
    """Runs of equal sequences: how many, and the lengths in each.

    least: shortest length whose gap is looked up among the sums; shorter ones
    only fill gaps. most: how many lengths an exact complement may have, 1 to 3.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, least: int = 1, most: int = 3):
        self.capacity, self.least, self.most, self.left = capacity, least, most, np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] += n
        self.runs: list[tuple[int, tuple[int, ...]]] = []
        self._exact()
        self._best_fit()

    def _take(self, combination: tuple[int, ...]) -> int:
        """Consumes a combination as often as the counts allow."""
        sizes, need = np.unique(combination, return_counts=True)
        n = int((self.left[sizes] // need).min())
        if n:
            self.left[sizes] -= n * need
            self.runs.append((n, combination))
        return n

    def _pairs(self, total: int, held: np.ndarray) -> Iterator[tuple[int, int]]:
        """Available pairs (a >= b) with that sum, largest a first: the complement of each length is looked up."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[a < len(held)]
        ok = held[a] & held[total - a]
        for x in a[ok]:
            yield int(x), int(total - x)

    def _index_sums(self) -> None:
        """Which sums two available lengths have; lengths only run out, so it errs on the side of trying."""
        held = (self.left > 0).astype(np.float32)
        n = 1 << (2 * self.capacity + 2).bit_length()
        counts = np.fft.irfft(np.fft.rfft(held, n) ** 2, n)
        self.sums = counts[: self.capacity + 1] > 0.5

    def _exact(self) -> None:
        self._index_sums()
        for size in range(self.capacity, self.least - 1, -1):
            if size % 64 == 0:
                self._index_sums()
            if not self.left[size]:
                continue
            gap = self.capacity - size
            if gap == 0:
                self._take((size,))
                continue
            self._take((size, gap)) if self.left[gap] else 0
            if self.left[size] and gap > 1 and self.most > 1:
                for pair in self._pairs(gap, self.left > 0):
                    self._take((size, *pair))
                    if not self.left[size]:
                        break
            if self.left[size] and gap > 2 and self.most > 2:
                self._triples(size, gap)

    def _triples(self, size: int, gap: int) -> None:
        """Longest first, the lengths whose complement may be a pair sum are tried."""
        third = np.flatnonzero(self.left[: gap - 1])[::-1]
        for x in third[self.sums[gap - third]]:
            if not self.left[x]:
                continue
            held = self.left > 0
            held[x + 1 :] = False
            for pair in self._pairs(gap - int(x), held):
                self._take((size, int(x), *pair))
                if not self.left[size] or not self.left[x]:
                    break
            if not self.left[size]:
                return

    def _best_fit(self) -> None:
        """Longest first into the smallest gap that holds them, whole runs of equal sequences at once."""
        open_runs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        gaps: list[int] = []

        def put(n: int, lengths: tuple[int, ...]) -> None:
            gap = self.capacity - sum(lengths)
            if gap == 0:
                self.runs.append((n, lengths))
                return
            if not open_runs.get(gap):
                insort(gaps, gap)
                open_runs[gap] = []
            open_runs[gap].append((n, lengths))

        for size in range(self.capacity, 0, -1):
            n = int(self.left[size])
            self.left[size] = 0
            while n:
                at = bisect_left(gaps, size)
                if at == len(gaps):
                    each = self.capacity // size
                    if n // each:
                        put(n // each, (size,) * each)
                    if n % each:
                        put(1, (size,) * (n % each))
                    break
                gap = gaps[at]
                have, lengths = open_runs[gap].pop()
                if not open_runs[gap]:
                    del open_runs[gap]
                    gaps.pop(at)
                used = min(n, have)
                if used < have:
                    put(have - used, lengths)
                put(used, (*lengths, size))
                n -= used
        for runs in open_runs.values():
            self.runs += runs

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: first ranks of its intervals, and each one's first sequence and offset."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for n, lengths in self.runs:
            offset = 0
            for size in lengths:
                rank = used.get(size, 0)
                out.setdefault(size, []).append((rank, first, offset))
                used[size] = rank + n
                offset += size
            first += n
        return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in out.items()}


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences: short lengths used up among themselves can leave long ones alone.

    Every plan consumes exact complements; they differ in how short the lengths and how large the complements may be.
    """
    plans = [Plan(counts, capacity, least) for least in (1, capacity // 3, capacity // 2)] + [Plan(counts, capacity, 1, 1)]
    return min(plans, key=lambda p: sum(n for n, _ in p.runs))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; with keep_ids their token ids too.

    The rank of a piece is its place in its part (the task that tokenised it)
    plus the pieces of that length in the parts before, so no task sees all
    pieces of one length.
    """
    pieces = checkpoint(tokenize(docs, path, capacity, end, keep_ids))
    counts = checkpoint(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    places = best_plan(histogram, capacity).places()
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col("length").alias("_length"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_base")
    )
    if counts.count() <= BROADCAST_COUNTS:
        base = F.broadcast(base)
    ranked = pieces.join(base, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*columns, (F.col("_base") + F.col("place")).alias("_rank"))
    if keep_ids:
        placed = ranked.select(*columns, _placer(places)("length", "_rank").alias("_at"))
        return placed.select(*columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))

    def run(batches):
        for batch in batches:
            sequence, offset = _at_ranks(places, batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, run, schema)


def _at_ranks(places: dict, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for size in np.unique(length):
        own = length == size
        first_ranks, firsts, offsets = places[int(size)]
        at = np.searchsorted(first_ranks, rank[own], "right") - 1
        sequence[own] = firsts[at] + rank[own] - first_ranks[at]
        offset[own] = offsets[at]
    return sequence, offset


def _placer(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """An Arrow function of length and rank: struct of sequence_id and offset. Token ids stay in the JVM meanwhile."""

    @arrow_udf(StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequence, offset = _at_ranks(places, lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, doc_ids, input_ids (at most `capacity` ids)."""
    packed = pack(docs, path, capacity, end, keep_ids=True)
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return held.select(
        "sequence_id", F.size(ids).cast("long").alias("n_tokens"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), ids.alias("input_ids")
    )
