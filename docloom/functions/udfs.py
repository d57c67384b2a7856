"""Registers the Python functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docloom.functions import dates, embed, text
from docloom.operators import diff


class _DiffLines:
    def eval(self, old: str, new: str):
        for row in diff._line_ops(old or "", new or ""):
            yield row["op"], row["line_num"], row["content"]


def register(spark: SparkSession, now: int) -> list[str]:
    """Names that SQL can call from now on; now: epoch seconds that relative dates count from."""
    functions = {
        "chunk_text": text.chunk_text,
        "chat_chunk_text": text.chat_chunk_text,
        "fts_tokens": text.keyword_terms,
        "unified_diff": diff.unified_diff,
        "diff_ops": diff.line_ops,
        "seq_ratio": diff.likeness,
        "word_diff": diff.word_diff,
        "parse_nl_date": dates.date_parser(now),
        "embed": embed.embedder(),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("diff_lines", udtf(_DiffLines, returnType="op: string, line_num: bigint, content: string"))
    return [*functions, "diff_lines"]
