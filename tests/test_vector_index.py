import re

import numpy as np
import pytest

from docloom.functions import vector as V
from docloom.operators.vector_index import VectorIndex
from docloom.sources.store import Store

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, held, parts=4):
    return spark.createDataFrame([(k, None if v is None else np.asarray(v, float).tolist()) for k, v in held.items()], SCHEMA).repartition(parts)


def rows(found):
    return sorted((r["query_id"], r["place"], r["vec_id"], r["score"]) for r in found.collect())


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(5)
    asked = [*rng.normal(size=(8, 6)), np.zeros(6)]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id long, query_embedding array<double>")


def test_equals_a_scan_after_every_change(spark, queries, tmp_path):
    rng = np.random.default_rng(1)
    held = {k: v for k, v in enumerate(rng.normal(size=(700, 6)))} | {10_000: None} | {k: [1.0] * 6 for k in range(20_000, 20_030)}
    store, index = Store(spark, f"file://{tmp_path}/v"), VectorIndex()
    assert rows(index.search(store.at(), queries, 5)) == []

    def check(snapshot):
        assert rows(index.search(snapshot, queries, 9)) == rows(V.nearest(queries, frame(spark, held), 9))
        assert rows(index.search(snapshot, queries, 9, 0.5)) == rows(V.nearest(queries, frame(spark, held), 9, 0.5))

    first = store.transact(lambda c: index.update(c, frame(spark, held)))
    check(first)
    before = rows(index.search(first, queries, 9))
    changed = {k: 4 * v for k, v in zip(range(600, 800), rng.normal(size=(200, 6)), strict=True)}
    held |= changed
    gone = [*range(0, 300, 2), 99_999]
    held = {k: v for k, v in held.items() if k not in gone}
    check(store.transact(lambda c: index.update(c, frame(spark, changed), spark.createDataFrame([(k,) for k in gone], "vec_id long"))))
    held |= {0: [9.0] * 6}
    check(store.transact(lambda c: index.update(c, frame(spark, {0: [9.0] * 6}))))
    held = {k: held[k] for k in range(301, 304)}
    check(store.transact(lambda c: index.update(c, remove=frame(spark, {k: None for k in [*range(301), *range(304, 900), *range(20_000, 20_030)]}))))
    assert rows(index.search(first, queries, 9)) == before


def test_cells_are_skipped(spark, tmp_path):
    """Of thirty clumps a query reads those that can hold a hit; the scan lists their folders only."""
    rng = np.random.default_rng(2)
    clumps = 10 * rng.normal(size=(30, 6))
    held = {k: clumps[k % 30] + 0.1 * rng.normal(size=6) for k in range(3000)}
    store, index = Store(spark, f"file://{tmp_path}/v"), VectorIndex()
    snapshot = store.transact(lambda c: index.update(c, frame(spark, held), cells=30))
    asked = spark.createDataFrame([(1, clumps[4].tolist())], "query_id long, query_embedding array<double>")
    found = index.search(snapshot, asked, 5)
    assert rows(found) == rows(V.nearest(asked, frame(spark, held), 5))
    seen = []
    scan = index._scan

    def counted(rows_, *args):
        out = scan(rows_, *args)
        seen.append(out)
        return out

    index._scan = counted
    index.search(snapshot, asked, 5).collect()
    for out in seen:
        plan = out._jdf.queryExecution().executedPlan()
        listed = re.search(r"PartitionFilters: \[.*?cell#\d+( IN|\)? = | =)", plan.toString())
        assert listed, plan.toString()
        assert len(out.inputFiles()) > 0
    cells = {int(c) for out in seen for c in re.findall(r"cell#\d+ (?:IN \(|= )([\d,]+)", out._jdf.queryExecution().executedPlan().toString())[0].split(",")}
    assert len(cells) < 10


def test_no_vectors(spark, tmp_path, queries):
    store, index = Store(spark, f"file://{tmp_path}/v"), VectorIndex()
    snapshot = store.transact(lambda c: index.update(c, frame(spark, {1: None})))
    assert rows(index.search(snapshot, queries, 5)) == []
    snapshot = store.transact(lambda c: index.update(c, frame(spark, {1: [1.0] * 6})))
    assert len(rows(index.search(snapshot, queries, 5))) == 9
