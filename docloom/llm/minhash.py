"""Near-duplicate detection by tensored MinHash banding.

Each set of word shingles gets two small collections of t sub-keys, each made of
`width` minhashes; every pair of a sub-key of the first and one of the second
collection is a table key, so t * t tables cost 2 * t * width minhashes. Equal
sets are one class from the start. Sub-keys that no other class has can't make
a shared key, so only keys of two shared sub-keys are formed.

1. In each table bucket the classes meet the one with the smallest id, and each
   class the centre with most company among its buckets' (the likely original of
   the others), so a bucket yields pairs in proportion to its members. Estimates
   from the signatures drop hopeless pairs; each class's best is confirmed on the
   full sets. A group of copies is one component after this.
2. Buckets whose members are of one component are settled. The others are taken
   together by their sub-key of the first collection. Where up to SMALL classes
   have it, the pairs of different components are estimated and confirmed.
3. Where up to PART have it, a task gets the full sets of all of them and finds every
   pair of different components that is similar enough, exactly: a pair must share
   one of the shingles that are rarest among those sets, as many as could be missing
   from the other set and one more, so texts that share a frequent passage only are
   never counted against each other. A link that joins two components is emitted,
   the others are implied.
4. All larger groups are one pool, filtered by the same rule: shingles are counted
   over the pool, each class sends its id to its rarest ones, and classes of
   different components that meet there are estimated and confirmed. A set is read
   once for the counts and once for the rare shingles and travels with its
   links only. Where more than MEET classes have a shingle among their rarest (sets
   made of frequent shingles throughout), a first round compares sketches in tasks
   and gives the likeliest pair for each two components that they would join; for
   components that are still apart after those are confirmed, a second round compares
   full sets in tasks as in 3, once for all shingles that the same classes have.
   All rows between the steps are in proportion to the pool and to the rarest
   shingles of a class, but for shingles of more than BLOCK (or PART) classes, whose
   rows are copied for each pair of blocks.

So of two texts that share a bucket, none is left out. Components come from a
union-find over the links, or from alternating star steps.

Defined cases: a text without words (or null) has an empty set and links with
nothing; fewer words than a shingle make one shingle of them all; texts of any
length are read whole, in blocks; null ids take part and count as absent when the
smallest id is sought; a component of null ids alone has component_id null;
repeated rows are in one class; ties between centres go to the smaller id, then
the class's digest; an empty table gives an empty result; other columns, whatever
their names, are ignored by `near_groups` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from docloom.llm.arrowtext import Words, column, grams, mix, parts, raw
from docloom.llm.common import Tables, checkpoint, components, map_arrow, written

BROADCAST_IDS = 1_000_000
BROADCAST_SETS = 8 << 20  # bytes
SMALL = 16  # classes with a sub-key whose pairs are formed one by one
PART, PART_SHINGLES = 2048, 1 << 21  # classes and shingles that one task compares
COMMON = 16  # classes with a shingle that is counted as frequent
MOST_COMMON = 1_000_000  # frequent shingles that go to every task
MEET, BLOCK = 16, 8192  # classes at a rare shingle whose pairs are formed one by one; sketches of one side of a block


@dataclass(frozen=True)
class Settings:
    """shingle: words; percent: least similarity; tables: t; width: minhashes per sub-key; sketch: signature minhashes."""

    shingle: int = 5
    percent: int = 80
    tables: int = 8
    width: int = 2
    sketch: int = 96
    slack: float = 0.14

    def seeds(self) -> np.ndarray:
        n = 2 * self.tables * self.width + self.sketch
        return np.random.default_rng(97).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle fingerprints of each (lower-cased) text."""
    for lo, hi in parts(texts):
        data, offsets = raw(texts[lo:hi])
        words = Words(data, offsets)
        codes = words.hashes()
        runs = grams(codes, size)
        for k in range(hi - lo):
            a, b = words.first[k], words.first[k + 1]
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield grams(codes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _minima(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, in bounded blocks."""
    out = np.full(len(seeds), np.uint64(2**64 - 1))
    for at in range(0, len(codes), 4096):
        x = codes[at : at + 4096, None] * seeds[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def signature(codes: np.ndarray, s: Settings, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 2 * t sub-keys and the sketch (8 bits of each minhash)."""
    low = _minima(codes, seeds)
    n = 2 * s.tables * s.width
    sub = grams_of_rows(low[:n].reshape(2 * s.tables, s.width))
    sub = mix(sub + np.arange(2 * s.tables, dtype=np.uint64))
    return sub.astype(np.int64), (mix(low[n:]) & np.uint64(0xFF)).astype(np.uint8)


def grams_of_rows(rows: np.ndarray) -> np.ndarray:
    acc = mix(rows[:, 0])
    for k in range(1, rows.shape[1]):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return acc


def _digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _sign(s: Settings):
    def run(batches):
        seeds = s.seeds()
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            memo: dict[bytes, tuple] = {}
            for codes in shingle_sets(column(batch, "text", lower=True), s.shingle):
                sizes.append(len(codes))
                if not len(codes):
                    digests.append(None)
                    keys.append(None)
                    sketches.append(None)
                    continue
                digest = _digest(codes)
                if digest not in memo:
                    key, sketch = signature(codes, s, seeds)
                    memo[digest] = key, sketch.tobytes()
                digests.append(digest)
                keys.append(memo[digest][0])
                sketches.append(memo[digest][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "node", "subs", "sketch"],
            )

    return run


def _near(s: Settings):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            values = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in (2, 3)]
            same = [float((x == y).mean()) for x, y in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(same, pa.float64())], ["a", "b", "likeness"])

    return run


def _fingerprints(s: Settings):
    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            for codes in shingle_sets(column(batch, "text", lower=True), s.shingle):
                nodes.append(_digest(codes) if len(codes) else None)
                sets.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "codes"])

    return run


def _set(x: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _confirm(s: Settings):
    def run(batches):
        for batch in batches:
            ok = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one, two = _set(one), _set(two)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(100 * both >= s.percent * (len(one) + len(two) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


class _Cell:
    """The sets of a cell, their shingles numbered from the rarest of the cell on."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(x) for x in sets])
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        _, ids, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(found, kind="stable")
        number = np.empty(len(found), np.int64)
        number[order] = np.arange(len(found))
        row = np.repeat(np.arange(len(sets)), self.size)
        ids = number[ids]
        self.ids = ids[np.lexsort((ids, row))]
        # A set that is similar enough has `percent` of these at least, so it has one of so many:
        lead = self.size - -(-percent * self.size // 100) + 1
        within = np.arange(len(self.ids)) - np.repeat(self.first[:-1], self.size)
        leads = (within < np.repeat(lead, self.size)) & (found[order][self.ids] > 1)
        self.lead_ids, self.lead_rows = self.ids[leads], row[leads]
        self.lead_first = np.searchsorted(self.lead_rows, np.arange(len(sets) + 1))
        by_id = np.argsort(self.lead_ids, kind="stable")  # rows stay in order within an id
        self.posted, self.posted_ids = self.lead_rows[by_id], self.lead_ids[by_id]
        self.seen = np.zeros(len(found), bool)

    def later(self, i: int) -> np.ndarray:
        """Marks the rows with one of the leading shingles of row i."""
        own = self.lead_ids[self.lead_first[i] : self.lead_first[i + 1]]
        lo, hi = np.searchsorted(self.posted_ids, own, "left"), np.searchsorted(self.posted_ids, own, "right")
        out = np.zeros(len(self.size), bool)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            out[self.posted[a:b]] = True
        return out

    def both(self, i: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles row i has in common with each of the rows (in ascending order)."""
        own = self.ids[self.first[i] : self.first[i + 1]]
        self.seen[own] = True
        if 3 * self.size[rows].sum() > self.first[-1] - self.first[rows[0]]:
            hit = np.concatenate(([0], np.cumsum(self.seen[self.ids[self.first[rows[0]] :]])))
            at = self.first[rows] - self.first[rows[0]]
        else:
            ends = np.cumsum(self.size[rows])
            place = np.arange(ends[-1]) + np.repeat(self.first[rows] - ends + self.size[rows], self.size[rows])
            hit = np.concatenate(([0], np.cumsum(self.seen[self.ids[place]])))
            at = ends - self.size[rows]
        self.seen[own] = False
        return hit[at + self.size[rows]] - hit[at]


def _forest(s: Settings):
    """Links between the components of a cell: each joins two that no earlier one has joined."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by("node")
        node, out = cell.column("node"), []
        sets = _Cell([_set(x) for x in cell.column("codes")], s.percent)
        root, size = np.unique(cell.column("root").to_numpy(), return_inverse=True)[1], sets.size
        for i in range(len(size) - 1):
            fit = (root != root[i]) & (100 * np.minimum(size, size[i]) >= s.percent * np.maximum(size, size[i]))
            fit[: i + 1] = False
            rows = np.flatnonzero(fit & sets.later(i)) if fit.any() else []
            if not len(rows):
                continue
            both = sets.both(i, rows)
            for j in rows[100 * both >= s.percent * (size[i] + size[rows] - both)]:
                if root[i] != root[j]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        a, b = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
        return pa.table({"a": node.take(a), "b": node.take(b)})

    return run


def _ids(frame: DataFrame, count: int) -> DataFrame:
    """A table of ids, broadcast up to BROADCAST_IDS of them."""
    return F.broadcast(frame) if count <= BROADCAST_IDS else frame


def _shared_keys(classes: DataFrame, s: Settings, held: Tables) -> DataFrame:
    """(node, low, n_shingles, first, key, n): the table keys that n > 1 classes have; first is the key's sub-key of the first collection."""
    posts = classes.select("node", "low", "n_shingles", F.posexplode("subs").alias("slot", "sub"))
    shared = held.put(posts.groupBy("sub").count().where("count > 1").select(F.col("sub").alias("_sub")))
    own = posts.join(_ids(shared, shared.count()), F.col("sub") == F.col("_sub"), "left_semi").groupBy("node").agg(
        F.first("low").alias("low"),
        F.first("n_shingles").alias("n_shingles"),
        F.collect_list(F.when(F.col("slot") < s.tables, F.col("sub"))).alias("one"),
        F.collect_list(F.when(F.col("slot") >= s.tables, F.col("sub"))).alias("two"),
    )
    subs = held.put(own.where("size(one) > 0 and size(two) > 0"))
    each = subs.select("node", "low", "n_shingles", F.explode("one").alias("first"), "two")
    keys = each.select("node", "low", "n_shingles", "first", F.explode("two").alias("_second"))
    keys = keys.select("node", "low", "n_shingles", "first", F.xxhash64("first", "_second").alias("key"))
    sizes = keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    out = held.put(keys.join(sizes, F.col("key") == F.col("_key")).drop("_key"))
    held.drop(shared, subs)
    return out


def _centre_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): a class with the lowest centre of each of its buckets, and with the fullest of all of them."""
    company = shared.groupBy(F.col("node").alias("_node")).agg(F.sum("n").alias("company"))
    known = shared.join(company, F.col("node") == F.col("_node"))
    lowest = F.min(F.struct(F.col("low").isNull(), "low", "node"))["node"]
    fullest = F.max(F.struct("company", "node"))
    centres = known.groupBy(F.col("key").alias("_key")).agg(lowest.alias("lowest"), fullest.alias("full"))
    met = shared.join(centres, F.col("key") == F.col("_key")).groupBy("node").agg(F.collect_set("lowest").alias("lowest"), F.max("full").alias("full"))
    every = met.select("node", F.explode(F.array_union("lowest", F.array("full.node"))).alias("c")).where("node <> c")
    return every.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _likely(pairs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity, with the likeness of their sketches."""
    one = members.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = members.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    fit = 100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb")
    known = pairs.join(one, "a").join(two, "b").where(fit).select("a", "b", "sa", "sb")
    return map_arrow(known, _near(s), "a binary, b binary, likeness double").where(F.col("likeness") >= s.percent / 100 - s.slack)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, s: Settings, held: Tables) -> DataFrame:
    """(node, codes): the full sets of the classes named by nodes, read from their documents with the lowest id.

    Several documents of a class are read only where they share that id; then the
    table is reduced to one row for each class.
    """
    needed = held.put(nodes.distinct())
    count = needed.count()
    low = classes.join(_ids(needed, count), "node", "left_semi").select(F.col("low").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(_ids(low, count), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = map_arrow(texts, _fingerprints(s), "node binary, codes binary")
    sets = held.put(sets.join(_ids(needed, count), "node", "left_semi"))
    return sets if sets.count() == count else held.put(sets.dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets of up to BROADCAST_SETS bytes are broadcast.

    Others are shuffled: first the set of the end with fewer pairs joins its pair,
    then that of the end with more, so a centre's set isn't sent once for each of its members.
    """
    size = sets.agg(F.count("*").alias("n"), F.sum(F.octet_length("codes")).alias("bytes")).first()
    one, two = (sets.select(F.col("node").alias(n), F.col("codes").alias(f"c{n}")) for n in "ab")
    if (size["bytes"] or 0) <= BROADCAST_SETS and size["n"] <= BROADCAST_IDS:
        one, two = F.broadcast(one), F.broadcast(two)
        pairs = pairs.select("a", "b")
    else:
        degree = _ends(pairs).groupBy("node").agg(F.count("*").alias("n"))
        known = pairs.select("a", "b").join(degree.toDF("a", "na"), "a").join(degree.toDF("b", "nb"), "b")
        swap = F.col("na") > F.col("nb")
        pairs = known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    found = map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "ca", "cb"), _confirm(s), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open_groups(shared: DataFrame, roots: DataFrame, held: Tables) -> tuple[DataFrame, DataFrame]:
    """(first, node, root, n_shingles) of the classes in buckets that hold several components, and what is known of each `first`.

    Of groups with the same members one is looked at.
    """
    own = shared.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    own = own.withColumn("root", F.xxhash64(F.coalesce("root", "node")))
    mixed = own.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r <> q")
    members = held.put(own.join(mixed, F.col("key") == F.col("_key"), "left_semi").select("first", "node", "root", "n_shingles").distinct())
    prints = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in (0, 1)]
    each = members.groupBy("first", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), *prints)
    groups = each.groupBy(F.col("first").alias("_first")).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "root")).alias("most"), *[F.bit_xor(f"p{k}").alias(f"p{k}") for k in (0, 1)]
    )
    return members, held.put(groups.dropDuplicates(["n", "p0", "p1"]).drop("p0", "p1"))


def _small_pairs(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components in groups of up to SMALL classes."""
    small = members.join(groups.where(F.col("n") <= SMALL).select("_first"), F.col("first") == F.col("_first"), "left_semi")
    one = small.select("first", F.col("node").alias("a"), F.col("root").alias("ra"))
    two = small.select(F.col("first").alias("_f"), F.col("node").alias("b"), F.col("root").alias("rb"))
    return one.join(two, (F.col("first") == F.col("_f")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b").distinct()


def _cells(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(cell, node, root): the members of each group that one task can compare."""
    own = groups.where((F.col("n") > SMALL) & (F.col("n") <= PART) & (F.col("w") <= PART_SHINGLES)).select("_first")
    return members.join(own, F.col("first") == F.col("_first"), "left_semi").select(F.col("first").alias("cell"), "node", "root")


def _pool(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root, n_shingles) of the members of all larger groups, each once."""
    own = groups.where((F.col("n") > SMALL) & ((F.col("n") > PART) | (F.col("w") > PART_SHINGLES))).select("_first")
    return members.join(own, F.col("first") == F.col("_first"), "left_semi").select("node", "root", "n_shingles").dropDuplicates(["node"])


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than COMMON sets have, at most MOST_COMMON of them (the most frequent), sorted, and their counts."""

    def each(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_set(x).view(np.int64))], ["code"])

    counts = checkpoint(map_arrow(sets.select("codes"), each, "code long").groupBy("code").count().where(F.col("count") > COMMON))
    least = COMMON
    while counts.where(F.col("count") > least).count() > MOST_COMMON:
        least *= 2
    found = counts.where(F.col("count") > least).toArrow()
    codes, n = found["code"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _leads(pool: DataFrame, sets: DataFrame, common: tuple[np.ndarray, np.ndarray], s: Settings) -> DataFrame:
    """(code, node, root, n_shingles): each class at its rarest shingles, of which a set that is similar enough has one.

    All sets order shingles alike: by their count where they are frequent, others first, then by their code.
    """
    codes, n = common

    def run(batches):
        for batch in batches:
            found, rows = [], []
            for k, x in enumerate(batch.column(3)):
                own = _set(x)
                lead = len(own) - -(-s.percent * len(own) // 100) + 1
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                count = np.where(codes[at] == own, n[at], 0) if len(codes) else np.zeros(len(own), np.int64)
                found.append(own[np.lexsort((own, count))[:lead]].view(np.int64))
                rows.append(np.full(lead, k))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            arrays = [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), *(batch.column(c).take(row) for c in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, ["code", "node", "root", "n_shingles"])

    return map_arrow(pool.join(sets, "node").select("node", "root", "n_shingles", "codes"), run, "code long, node binary, root long, n_shingles long")


def _sketched(s: Settings):
    """Of a block's rows (of one side and the other) pairs whose components differ and whose sizes and sketches allow the similarity.

    A pair that joins two components stands for all pairs of them.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        sketch = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table["sketch"]])
        root, size, side = (table[c].to_numpy().copy() for c in ("root", "n_shingles", "side"))
        out = [np.zeros((0, 2), np.int64)]
        for i in range(len(root) - 1):
            fit = (root[i + 1 :] != root[i]) & ((side[i + 1 :] < 0) | (side[i + 1 :] != side[i]))
            fit &= 100 * np.minimum(size[i + 1 :], size[i]) >= s.percent * np.maximum(size[i + 1 :], size[i])
            rows = i + 1 + np.flatnonzero(fit)
            alike = (sketch[rows] == sketch[i]).mean(axis=1)
            rows, alike = rows[alike >= s.percent / 100 - s.slack], alike[alike >= s.percent / 100 - s.slack]
            if len(rows):
                rows = rows[np.argsort(-alike, kind="stable")]
                rows = rows[np.unique(root[rows], return_index=True)[1]]
                root[np.isin(root, root[rows])] = root[i]
                out.append(np.stack([np.full(len(rows), i), rows], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": table["node"].take(pairs[:, 0]), "b": table["node"].take(pairs[:, 1])})

    return run


def _met(leads: DataFrame, roots: DataFrame, held: Tables) -> DataFrame:
    """(code, node, root, n_shingles, n) of the classes at rare shingles that n > 1 classes of several components have."""
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    now = leads.drop("root").join(known, F.col("node") == F.col("_node"), "left")
    now = now.select("code", "node", F.xxhash64(F.coalesce("_root", "node")).alias("root"), "n_shingles")
    met = now.groupBy(F.col("code").alias("_code")).agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("q")).where("n > 1 AND r <> q")
    return held.put(now.join(met.select("_code", "n"), F.col("code") == F.col("_code")).drop("_code"))


def _few_pairs(met: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of different components at shingles of up to MEET classes, as far as sizes and sketches allow."""
    few = met.where(F.col("n") <= MEET)
    one = few.select("code", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"))
    two = few.select("code", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"))
    fit = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb"))
    return _likely(one.join(two, "code").where(fit).select("a", "b").distinct(), members, s).select("a", "b")


def _blocks(met: DataFrame, size: int) -> DataFrame:
    """(code, i, j, node, root, n_shingles, side): the classes at shingles of more than MEET, each shingle in pairs of blocks.

    Of shingles that the same classes have one is looked at.
    """
    many = met.where(F.col("n") > MEET)
    prints = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in (0, 1)]
    codes = many.groupBy(F.col("code").alias("_code")).agg(F.first("n").alias("m"), *prints).dropDuplicates(["m", "p0", "p1"]).select("_code")
    parts = F.ceil(F.col("n") / F.lit(float(size))).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(part, q).alias("i"), F.greatest(part, q).alias("j")))
    dealt = many.join(codes, F.col("code") == F.col("_code"), "left_semi").select("code", "node", "root", "n_shingles", part.alias("part"), F.explode(blocks).alias("block"))
    return dealt.select("code", "block.i", "block.j", "node", "root", "n_shingles", F.when(F.col("block.i") == F.col("block.j"), -1).otherwise(F.col("part")).alias("side"))


def _joined_pool(pool: DataFrame, sets: DataFrame, members: DataFrame, tested: DataFrame, links: DataFrame, s: Settings, held: Tables) -> DataFrame:
    """The links with those of the pool: a round by sketches for the likeliest pairs, and one by full sets for all that are still apart."""
    leads = held.put(_leads(pool, sets, _frequent(pool.select("node").join(sets, "node")), s))
    met = _met(leads, held.put(components(links)), held)
    rows = _blocks(met, BLOCK).join(members.select("node", "sketch"), "node")
    likely = rows.groupBy("code", "i", "j").applyInArrow(_sketched(s), "a binary, b binary")
    fresh = held.put(_few_pairs(met, members, s).union(likely).distinct().join(tested, ["a", "b"], "left_anti"))
    links = held.put(links.union(_confirmed(fresh, sets, s)))
    met = _met(leads, held.put(components(links)), held)
    few = _few_pairs(met, members, s).join(tested.select("a", "b").union(fresh), ["a", "b"], "left_anti")
    cells = _blocks(met, PART).select(F.struct("code", "i", "j").alias("cell"), "node", "root")
    many = cells.join(sets, "node").groupBy("cell").applyInArrow(_forest(s), "a binary, b binary")
    return held.put(links.union(_confirmed(held.put(few), sets, s)).union(many))


def near_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, node (its set's class; null if empty), root (its component's), component_id, kept."""
    with Tables(docs.sparkSession, "near") as held:
        signed = held.put(map_arrow(docs.select("doc_id", "text"), _sign(s), "doc_id long, n_shingles long, node binary, subs array<long>, sketch binary"))
        classes = held.put(signed.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("subs").alias("subs"), F.first("sketch").alias("sketch"),
        ))
        shared = _shared_keys(classes, s, held)
        members = held.put(classes.select("node", "n_shingles", "sketch").join(shared.select("node").distinct(), "node", "left_semi"))

        pairs = held.put(_likely(_centre_pairs(shared), members, s))
        best = pairs.select(F.col("a").alias("x"), "a", "b", "likeness").union(pairs.select(F.col("b").alias("x"), "a", "b", "likeness"))
        tested = held.put(best.groupBy("x").agg(F.max(F.struct("likeness", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
        links = held.put(_confirmed(tested, _sets(docs, classes, _ends(tested), s, held), s))
        roots = held.put(components(links))

        of_open, groups = _open_groups(shared, roots, held)
        fresh = held.put(_likely(_small_pairs(of_open, groups).join(tested, ["a", "b"], "left_anti"), members, s))
        cells, pool = held.put(_cells(of_open, groups)), held.put(_pool(of_open, groups))
        sets = _sets(docs, classes, _ends(fresh).union(cells.select("node")).union(pool.select("node")), s, held)
        few = _confirmed(fresh, sets, s)
        many = cells.join(sets, "node").groupBy("cell").applyInArrow(_forest(s), "a binary, b binary")
        links = held.put(links.union(few).union(many))
        if not pool.isEmpty():
            links = _joined_pool(pool, sets, members, tested.union(fresh.select("a", "b")), links, s, held)
        roots = held.put(components(links))

        own = classes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
        found = own.join(lowest, "root").select(F.col("node").alias("_node"), "root", F.col("component_id").alias("_component"))
        rows = signed.select("doc_id", "n_shingles", "node").join(found, F.col("node") == F.col("_node"), "left")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
        rows = rows.select("doc_id", "n_shingles", "node", "root", component.alias("component_id"))
        return written(rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-groups")


def drop_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each group with all its columns (the one with the smallest id).

    Documents stay where they lie: the ids of those that go are joined to them,
    broadcast up to BROADCAST_IDS. Rows that share an id are told apart by the
    digests of their sets; of those that could stand for a group one stays.
    """

    @arrow_udf(BinaryType())
    def node_of(text: pa.Array) -> pa.Array:
        lowered = pc.ascii_lower(pc.fill_null(text, ""))
        return pa.array([_digest(codes) if len(codes) else None for codes in shingle_sets(lowered, s.shingle)], pa.binary())

    names = [f"_c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    groups = near_groups(docs, s)
    per_id = groups.groupBy(F.col("doc_id").alias("_id")).agg((F.count("*") > 1).alias("_shared"), F.count_if("kept").alias("_kept"))
    marks = written(per_id.where("_shared or _kept = 0").select("_id", "_shared"), "near-marks")
    marked = plain.join(_ids(marks, marks.count()), doc_id.eqNullSafe(F.col("_id")), "left")
    single = marked.where("_shared is null").select(*names)
    shared = marks.where("_shared").select("_id")
    if not shared.limit(1).count():
        return single.toDF(*docs.columns)
    tops = groups.where("kept").join(_ids(shared, shared.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    tops = tops.select(F.col("doc_id").alias("_top"), F.col("node").alias("_node"), F.col("root").alias("_root")).distinct()
    several = marked.where("_shared").withColumn("_own", node_of(text)).join(tops, doc_id.eqNullSafe(F.col("_top")) & F.col("_own").eqNullSafe(F.col("_node")))
    empty, full = several.where("_root is null"), several.where("_root is not null").dropDuplicates(["_root"])
    return single.union(empty.select(*names)).union(full.select(*names)).toDF(*docs.columns)
