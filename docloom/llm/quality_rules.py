"""Quality rules with verdicts of whole hosts.

Each document is measured once (words, symbols, repeated lines, repeated
eight-word windows). The failures are summed per host (the documents' source),
the host rates are shrunk with a beta prior fitted to all hosts by its moments,
and the host's verdict is joined back: a document that fails a rule itself goes
when its host is suspect, one that fails none goes only when its host is
rejected.

Defined cases: a null text has no words and fails; null is a host of its own;
texts of any length are measured whole; rates equal to a limit don't exceed it;
repeated rows count each; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import SPACE, Words, column, grams, parts, raw
from docloom.llm.common import checkpoint, map_arrow

BROADCAST_HOSTS = 50_000
SYMBOLS = b"#*$%&|<>"
_STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_BLANK = b" \t\n\x0b\x0c\r"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def repeated_words(words: Words, window: int = 8) -> np.ndarray:
    """Per row, the words that lie in a window found at least twice in that row."""
    rows = len(words.offsets) - 1
    out = np.zeros(rows, np.int64)
    codes = grams(words.hashes(), window)
    for k in range(rows):
        lo, hi = words.first[k], words.first[k + 1]
        if hi - lo <= window:
            continue
        own = codes[lo : hi - window + 1]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(hi - lo + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        out[k] = int((np.cumsum(edge[:-1]) > 0).sum())
    return out


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches):
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        texts = column(batch, "_text")
        for lo, hi in parts(texts):
            data, offsets = raw(texts[lo:hi])
            words = Words(data, offsets)
            lines = [duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            counts = [
                np.diff(words.first),
                _per_row((SPACE[data] != 0) & ((data & 0xC0) != 0x80), offsets),
                _per_row(symbol[data], offsets),
                np.array([x[0] for x in lines], np.int64),
                np.array([x[1] for x in lines], np.int64),
                repeated_words(words),
            ]
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), *(pa.array(c, pa.int64()) for c in counts)],
                ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
            )


def measure(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """One row of counts per document."""
    return map_arrow(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("_text")), _measure, _STATS)


def judge(docs: DataFrame, host: str = "source", suspect: float = 0.3, rejected: float = 0.8) -> DataFrame:
    """The counts with base_failed, rule_failed, host_rate (shrunk) and kept.

    suspect, rejected: shrunk failure rates above which a host's failing, or all
    its documents go.
    """
    base = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
    soft = "10 * n_symbols > n_words or word_chars > 15 * n_words or word_chars < 2 * n_words or 10 * n_dup_lines > 3 * n_lines"
    stats = checkpoint(
        measure(docs, host).withColumn("base_failed", F.expr(base)).withColumn("rule_failed", F.expr(f"({base}) or ({soft})"))
    )
    hosts = checkpoint(stats.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("f")))
    count, mean, spread = hosts.agg(F.count("*"), F.avg(F.expr("f / n")), F.var_pop(F.expr("f / n"))).first()
    strength = prior_strength(mean, spread)
    side = hosts.select(
        F.col("host").alias("_host"), ((F.col("f") + F.lit(strength * (mean or 0.0))) / (F.col("n") + F.lit(strength))).alias("host_rate")
    )
    if count <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    limit = F.when(F.col("rule_failed"), F.lit(suspect)).otherwise(F.lit(rejected))
    return (
        stats.join(side, F.col("host").eqNullSafe(F.col("_host")))
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limit))
    )


def prior_strength(mean: float | None, spread: float | None, most: float = 1000.0) -> float:
    """Rows that the beta prior counts as, from the mean and variance of the host rates; 1 at least."""
    if not mean or not spread or mean >= 1:
        return 1.0
    return min(most, max(1.0, mean * (1 - mean) / spread - 1))
