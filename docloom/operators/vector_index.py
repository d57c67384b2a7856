"""A stored vector index with exact pruning.

Vectors lie in cells round centres, one folder per cell. Centres are fitted once, on
a bounded sample (SAMPLE vectors); every vector is stored, in the cell of its nearest
centre, and each addition notes the radius and the count of its cells. A product
with a vector of a cell is at most that with the centre plus the query's length times
the radius. A search first reads, for each query, its best cells until they hold k
vectors; the k-th product found there is a bar, and of the other cells only those are
read whose bound reaches it. So no hit is lost, and the scan lists only the cells in use.

Vectors that are null are not stored; ids that are added again take the place of
the old ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.slices import each_slice
from docloom.functions.vector import FOUND, Nearest, _matrix, best_of_all
from docloom.session import reliable
from docloom.sources.store import Change, Snapshot

SAMPLE, MAX_CELLS, ROUNDS = 20_000, 1024, 10
SLACK = 1e-7  # products are compared after rounding


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of at most MAX_CELLS cells (by default the root of the count), fitted on a sample of at most `sample` vectors."""
    there = vectors.where("embedding IS NOT NULL")
    n = there.count()
    cells = min(MAX_CELLS, max(1, round(n**0.5)) if cells is None else cells)
    some = there if n <= sample else there.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample)
    rows = np.array([r[0] for r in some.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").select("embedding").limit(sample).collect()], np.float64)
    if not len(rows):
        return np.zeros((0, 0))
    centres = rows[: min(cells, len(rows))].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(rows, centres)
        sums, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres**2).sum(axis=1) / 2
    return np.concatenate([(rows[a : a + 4096] @ centres.T - length).argmax(axis=1) for a in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


class VectorIndex:
    """The tables `name` (vec_id, embedding, cell), `name`_cells (cell, centre) and `name`_sizes (cell, n, radius) of a store."""

    def __init__(self, name: str = "vectors"):
        self.name, self.cells, self.sizes = name, f"{name}_cells", f"{name}_sizes"

    def _centres(self, snapshot: Snapshot) -> np.ndarray:
        rows = snapshot.read(self.cells)  # at most MAX_CELLS
        return np.zeros((0, 0)) if rows is None else np.array([r["centre"] for r in rows.orderBy("cell").collect()], np.float64)

    def rows(self, snapshot: Snapshot) -> DataFrame | None:
        """vec_id, embedding, cell of the vectors that are there."""
        return snapshot.read(self.name, "vec_id")

    def update(self, change: Change, add: DataFrame | None = None, remove: DataFrame | None = None, cells: int | None = None) -> None:
        """Vectors (vec_id, embedding) join the index, ids (vec_id) go. The first vectors give the centres."""
        spark, root = change.store.spark, change.store.root
        if change.base.parts(self.name):
            going = [x.select(F.col("vec_id").cast("long").alias("vec_id")) for x in (add, remove) if x is not None]
            for ids in going:
                change.remove(self.name, ids)
        if add is None:
            return
        centres = self._centres(change.base)
        if not centres.size:
            centres = fit_centres(add, cells)
            if not centres.size:
                return
            change.append(self.cells, spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1))

        def place(batches):
            for batch in batches:
                batch = batch.filter(pa.compute.is_valid(batch.column(1)))
                rows = _matrix(batch.column(1))
                own = nearest_centre(rows, centres) if len(rows) else np.zeros(0, np.int64)
                far = np.linalg.norm(rows - centres[own], axis=1) if len(rows) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far)], ["vec_id", "embedding", "cell", "far"])

        kind = add.schema["embedding"].dataType.simpleString()
        placed = add.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(place, f"vec_id long, embedding {kind}, cell int, far double")
        path = change._write(placed)  # as they come, for the sizes; then by cell
        held = spark.read.schema(placed.schema).parquet(f"{root}/{path}")
        change.append(self.sizes, held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")))
        change.append_by(self.name, held.drop("far"), "cell")

    def search(self, snapshot: Snapshot, queries: DataFrame, k: int, least: float | None = None, digits: int = 4) -> DataFrame:
        """query_id, vec_id, score, place: as `nearest` over the vectors that are there."""
        asked = queries.select("query_id", "query_embedding").where("query_embedding IS NOT NULL")
        top = each_slice(asked, lambda rows: best_of_all(self._found(snapshot, rows, k), k)).withColumn("score", F.round("score", digits))
        return top if least is None else top.where(F.col("score") >= least)

    def _found(self, snapshot: Snapshot, rows: list, k: int) -> DataFrame:
        held = self.rows(snapshot)
        if held is None or not rows:
            return snapshot.store.spark.createDataFrame([], FOUND)
        ids, asked = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        centres = self._centres(snapshot)
        sizes = {r["cell"]: r for r in snapshot.read(self.sizes).groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}  # at most MAX_CELLS
        n = np.array([sizes[c]["n"] if c in sizes else 0 for c in range(len(centres))])
        radius = np.array([sizes[c]["radius"] if c in sizes else 0.0 for c in range(len(centres))])
        bound = asked @ centres.T + np.linalg.norm(asked, axis=1)[:, None] * radius
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= n > 0
        one = reliable(self._scan(held, ids, asked, first, k))
        bar = np.full(len(ids), -np.inf)
        at = {q: x for x, q in enumerate(ids.tolist())}
        for r in best_of_all(one, k).where(F.col("place") == k).collect():
            bar[at[r["query_id"]]] = r["score"]
        more = (bound >= bar[:, None] - SLACK) & ~first & (n > 0)
        return one.unionByName(self._scan(held, ids, asked, more, k)) if more.any() else one

    @staticmethod
    def _scan(held: DataFrame, ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The k best of a task for each query, of the cells wanted for it."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        who = {c: np.flatnonzero(wanted[:, c]) for c in cells}

        def best(batches):
            tops: dict[int, Nearest] = {}
            for batch in batches:
                cell, own, matrix = batch.column(2).to_numpy(), batch.column(0).to_numpy(), _matrix(batch.column(1))
                for c in np.unique(cell).tolist():
                    if c not in tops:
                        tops[c] = Nearest(ids[who[c]], asked[who[c]], k)
                    tops[c].add(own[cell == c], matrix[cell == c])
            for top in tops.values():
                yield top.batch()

        return held.where(F.col("cell").isin(cells)).select("vec_id", "embedding", "cell").mapInArrow(best, FOUND)
