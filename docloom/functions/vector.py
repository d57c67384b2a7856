"""Vector functions and exact nearest rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions.slices import each_slice

MAX_CHOICES = 10_000
NEAR = 9  # digits of a product that decide its place
FOUND = "query_id long, vec_id long, score double"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector is divided by 1e-10."""
    length = F.when(norm(v) == 0, F.lit(1e-10)).otherwise(norm(v))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as of length 1."""
    la, lb = (F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v)) for v in (a, b))
    return dot(a, b) / (la * lb)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_choices(vectors: DataFrame, choices: DataFrame, k: int, least: float, digits: int = 4) -> DataFrame:
    """vec_id, tag, score: for each vector (vec_id, embedding) its k best choices (tag, embedding) of more than `least`; ties go to the smaller tag.

    The choices, at most MAX_CHOICES, come to the driver and go to every task; the
    vectors stay where they lie.
    """
    rows = choices.select("tag", "embedding").where("embedding is not null").orderBy("tag").limit(MAX_CHOICES + 1).collect()
    if len(rows) > MAX_CHOICES:
        raise ValueError(f"more than {MAX_CHOICES} choices")
    kind = choices.schema["tag"].dataType.simpleString()
    tags, table = pa.array([r[0] for r in rows], to_arrow_type(choices.schema["tag"].dataType)), np.array([r[1] for r in rows], np.float64)

    def best(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(1)))
            if not batch.num_rows or not len(tags):
                continue
            matrix, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for lo in range(0, len(own), 1024):
                scores = np.round(matrix[lo : lo + 1024] @ table.T, digits)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(scores, order, 1)
                good = kept > least
                row = np.broadcast_to(np.arange(len(kept))[:, None], kept.shape)[good]
                yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 1024][row]), tags.take(pa.array(order[good])), pa.array(kept[good])], ["vec_id", "tag", "score"])

    return vectors.select("vec_id", "embedding").mapInArrow(best, f"vec_id long, tag {kind}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, digits: int = 4, near: int = NEAR) -> DataFrame:
    """query_id, vec_id, score (`digits` digits), place: the k largest inner products of each query, exactly.

    queries (query_id, query_embedding) go to every task, slice by slice; vectors
    (vec_id, embedding) stay where they lie. A task multiplies its batches with the
    queries of the slice and keeps its own k best, so the shuffle carries k rows per
    query and task. The first `near` digits of a product decide its place, ties go to
    the smaller id.
    """
    asked = queries.select("query_id", "query_embedding").where("query_embedding is not null")
    top = each_slice(asked, lambda rows: best_of_all(vectors.select("vec_id", "embedding").mapInArrow(_nearest(rows, k, near), FOUND), k))
    top = top.withColumn("score", F.round("score", digits))
    return top if least is None else top.where(F.col("score") >= least)


def best_of_all(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _nearest(rows: list, k: int, near: int):
    """For mapInArrow over (vec_id, embedding): the k best of a task for each query row."""
    ids, asked = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)

    def best(batches):
        top = Nearest(ids, asked, k, near)
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(1)))
            if batch.num_rows and len(ids):
                top.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield top.batch()

    return best


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does it: halves go away from zero."""
    x = x * 10.0**digits
    whole = np.trunc(x)
    whole[np.abs(x - whole) >= 0.5] += np.sign(x[np.abs(x - whole) >= 0.5])
    return whole / 10.0**digits


class Nearest:
    """The k largest products of each query so far, in the order of score, then id."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int, near: int = NEAR):
        self.ids, self.asked, self.k, self.near = ids, asked, k, near
        self.score, self.vec = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)

    def add(self, own: np.ndarray, matrix: np.ndarray) -> None:
        for lo in range(0, len(own), 4096):
            kept = []
            for q in range(0, len(self.ids), 512):  # so that scores of 512 queries by 4096 vectors are held at a time
                scores = _rounded(self.asked[q : q + 512] @ matrix[lo : lo + 4096].T, self.near)
                s = np.hstack([self.score[q : q + 512], scores])
                v = np.hstack([self.vec[q : q + 512], np.broadcast_to(own[lo : lo + 4096], scores.shape)])
                order = np.lexsort((v, -s))[:, : self.k]
                kept.append((np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)))
            self.score, self.vec = (np.concatenate(x) for x in zip(*kept, strict=True))

    def batch(self) -> pa.RecordBatch:
        n = self.score.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(self.vec.ravel()), pa.array(self.score.ravel())], ["query_id", "vec_id", "score"])
