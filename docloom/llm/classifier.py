"""Quality classifier by importance resampling.

Hashed uni- and bigram models of the target (labelled good documents) and of
the raw corpus give each document a log ratio; with Gumbel noise from a hash of
its id added, the k documents with the largest keys are a sample drawn without
replacement in proportion to their importance. The raw model counts all
documents; the target model is fitted on at most SAMPLE labelled rows, chosen
by a hash of the id, of which every fourth is held out. k is given, or it is how
many keys reach the level that `recall` of the held-out target rows reach, so it
follows the corpus and is not flattered by rows the model has seen. Log ratios are
sums over whole texts, so the noise (a standard deviation of 1.3) decides between
documents of about equal weight only.

Defined cases: a null or empty text has log ratio 0; texts of any length are read
whole, in blocks; a null doc_id gets the noise of the text "null"; rows with equal
keys at the boundary are all kept, also with k given; repeated rows count in the
raw model each and stay or go together; with fewer than two target rows everything
is kept; null labels are no target rows; an empty table gives an empty result;
other columns, whatever their names, are ignored by `classify` and kept by
`keep_sampled`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import WORD_OR_SIGN, Words, column, grams, parts, raw
from docloom.llm.common import checkpoint, map_arrow

BUCKETS = 10_000
SAMPLE = 20_000


def features(texts: pa.Array, buckets: int = BUCKETS):
    """(bucket of each uni- and bigram, row of each) for a lower-cased text column."""
    data, offsets = raw(texts)
    words = Words(data, offsets, WORD_OR_SIGN)
    codes, row = words.hashes(), words.row_of_word()
    pairs = grams(codes, 2)
    inside = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
    every = np.concatenate([codes, pairs[inside]]) % np.uint64(buckets)
    return every.astype(np.int64), np.concatenate([row, row[:-1][inside]]) if len(row) else row


def _count(target: set, buckets: int):
    def run(batches):
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts = column(batch, "text", lower=True)
            hit = np.array([x in target for x in batch.column(0).to_pylist()], bool)
            for lo, hi in parts(texts):
                code, row = features(texts[lo:hi], buckets)
                counts[0] += np.bincount(code, minlength=buckets)
                counts[1] += np.bincount(code[hit[lo:hi][row]], minlength=buckets)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "target"])

    return run


def gumbel(doc_id, seed: int) -> float:
    """Gumbel noise from a hash of the id and the seed."""
    code = hashlib.blake2b(f"{seed}|{'null' if doc_id is None else doc_id}".encode(), digest_size=8).digest()
    u = (int.from_bytes(code, "little") + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def _score(ratio: np.ndarray, seed: int, id_at: int, text_at: int):
    def run(batches):
        for batch in batches:
            texts = column(batch, batch.schema.names[text_at], lower=True)
            logs = []
            for lo, hi in parts(texts):
                code, row = features(texts[lo:hi], len(ratio))
                logs.append(np.bincount(row, ratio[code], minlength=hi - lo))
            log = np.concatenate(logs) if logs else np.zeros(0)
            noise = np.array([gumbel(x, seed) for x in batch.column(id_at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(log, pa.float64()), pa.array(log + noise, pa.float64())],
                [*batch.schema.names, "_log", "_key"],
            )

    return run


def target_ids(labels: DataFrame, sample: int = SAMPLE) -> list[int]:
    """Ids of at most `sample` rows labelled good, smallest hash first."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]


def log_ratio(docs: DataFrame, target: set[int], buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw per bucket, each smoothed with one count a bucket."""
    sums = map_arrow(docs.select("doc_id", "text"), _count(target, buckets), "bucket long, raw long, target long")
    rows = sums.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # at most `buckets` rows
    counts = np.ones((2, buckets))
    for bucket, *both in rows:
        counts[:, bucket] += both
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _scored(docs: DataFrame, ratio: np.ndarray | None, seed: int) -> DataFrame:
    """docs (columns renamed _c0, _c1, ...) with _log and _key."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    if ratio is None:
        return plain.withColumns({"_log": F.lit(0.0), "_key": F.lit(0.0)})
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + ["_log double", "_key double"])
    return map_arrow(plain, _score(ratio, seed, docs.columns.index("doc_id"), docs.columns.index("text")), schema)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest of a column of numbers, by histograms of ever narrower ranges; -inf if there are fewer."""
    n, low, high = keys.agg(F.count(column), F.min(column), F.max(column)).first()
    if k > n or k < 1:
        return float("-inf") if k > n else float("inf")
    value, left = F.col(column), k  # the answer is the left-th largest of the values in [low, high]
    while low < high:
        width = (high - low) / bins
        if low + width == low or high - width == high:
            break
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = keys.where((value >= F.lit(low)) & (value <= F.lit(high)))
        counted = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(counted.collect(), key=lambda r: -r["b"]):  # at most `bins` rows
            if left <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            left -= r["n"]
    if low == high:
        return low
    few = keys.where((value >= F.lit(low)) & (value <= F.lit(high))).groupBy(column).agg(F.count("*").alias("n"))
    for r in sorted(few.collect(), key=lambda r: -r[0]):  # neighbouring doubles
        left -= r["n"]
        if left <= 0:
            return r[0]
    return low


def fit(docs: DataFrame, labels: DataFrame, recall: float, seed: int, sample: int, k: int | None = None) -> tuple[np.ndarray | None, float]:
    """The log ratios, and the k-th largest key, or the key that `recall` of the held-out target rows reach.

    One key per held-out row comes to the driver: at most a quarter of `sample`.
    """
    target = target_ids(labels, sample)
    held = target[::4]
    if len(target) < 2:
        return None, float("-inf")
    pairs = docs.select("doc_id", "text")
    ratio = log_ratio(pairs, set(target) - set(held))
    if k is not None:
        return ratio, kth_largest(checkpoint(_scored(pairs, ratio, seed).select("_key")), "_key", k)
    ids = docs.sparkSession.createDataFrame([(x,) for x in held], "_target long")
    own = pairs.join(F.broadcast(ids), F.col("doc_id") == F.col("_target")).drop("_target")
    keys = sorted(r[0] for r in _scored(own, ratio, seed).groupBy("_c0").agg(F.min("_key").alias("k")).select("k").collect())
    return ratio, keys[int((1 - recall) * len(keys))] if keys else float("-inf")


def classify(docs: DataFrame, labels: DataFrame, recall: float = 0.999, seed: int = 17, sample: int = SAMPLE, k: int | None = None) -> DataFrame:
    """One row per document: doc_id, log_weight, sample_key, kept. k: how many to keep, in place of the recall."""
    ratio, least = fit(docs, labels, recall, seed, sample, k)
    scored = _scored(docs.select("doc_id", "text"), ratio, seed)
    return scored.select(
        F.col("_c0").alias("doc_id"),
        F.col("_log").alias("log_weight"),
        F.col("_key").alias("sample_key"),
        (F.col("_key") >= F.lit(least)).alias("kept"),
    )


def keep_sampled(docs: DataFrame, labels: DataFrame, recall: float = 0.999, seed: int = 17, sample: int = SAMPLE, k: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    ratio, least = fit(docs, labels, recall, seed, sample, k)
    scored = _scored(docs, ratio, seed)
    return scored.where(F.col("_key") >= F.lit(least)).select(*scored.columns[:-2]).toDF(*docs.columns)
