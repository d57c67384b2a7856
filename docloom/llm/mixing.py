"""Mixing sources to target weights.

Sizes are summed per source before anything is shuffled; the targets come from
pouring the wanted total over the sources in proportion to their weights, each
source taking at most `cap` times its size and the excess going to the others.
A document is emitted floor(rate) times plus once more if a hash of its id, its
text and the seed falls below the fraction of the rate, so reruns agree and rows
without an id of their own are drawn one by one.

Defined cases: a null text has size 0, texts of any length are counted whole; null
is a source of its own, last in the order; a source of size 0 has target 0 and
rate 0; a null id is an id like others; rows equal in id and text are one draw, so
all of them get the same number of copies; ties between sources don't arise, as
each is one row; an empty table gives an empty result; other columns, whatever
their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, with_rank

BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Runs of other characters than space and \\x09-\\x0D; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with the columns weight and target.

    Each round pours what is left over the sources below their caps, and fixes
    those that would pass their cap; only sums come to the driver.
    """
    ranked = with_rank(sizes, "source", "_rank")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    now = checkpoint(
        ranked.withColumn("weight", F.get(pattern, (F.col("_rank") % len(weights)).cast("int")))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .drop("_rank")
    )
    total = float(share) * float(now.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        used, open_weight, n = now.agg(
            F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - (used or 0.0)) / open_weight, n
    return now.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight"))).drop("_cap")


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with the columns _size, _source_size, _target and _copies after its own.

    A join on the source follows the aggregate: broadcast up to
    BROADCAST_SOURCES sources, beyond that shuffled.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    text, source, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("text", "source", "doc_id"))
    plain = docs.toDF(*names).withColumn("_size", n_words(text))
    sizes = plain.groupBy(source.alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = checkpoint(source_targets(sizes, weights, share, cap))
    side = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = plain.join(side, source.eqNullSafe(F.col("_source")))
    whole = F.floor(rate)
    return joined.withColumn("_copies", (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")).select(
        *names, "_size", "_source_size", "_target", "_copies"
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns."""
    out = copies(docs, weights, share, cap, seed)
    names = out.columns[: len(docs.columns)]
    return (
        out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
        .select(*names)
        .toDF(*docs.columns)
    )
