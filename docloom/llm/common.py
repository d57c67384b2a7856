"""What the operators of this subpackage share: reading, checkpoints, ranks, components."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of the pieces in which a task works through its Arrow batches: texts may be long, and a piece is held several times over.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """While the block runs a job, Arrow batches hold BATCH_ROWS rows at most."""
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def with_rank(df: DataFrame, column: str, name: str, parts: int = 32) -> DataFrame:
    """Adds the place (from 0) of each row in the order of `column`, nulls last.

    A range partitioning orders the rows; the counts of the parts (bounded by
    `parts`) give the offsets, so no task sees more than its own range.
    """
    ranged = checkpoint(
        df.repartitionByRange(parts, F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    )
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offset, before = {}, 0
    for part, n in counts:
        offset[part], before = before, before + n
    window = Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())
    if not offset:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_part")
    start = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])
    return ranged.withColumn(name, (start[F.col("_part")] + F.row_number().over(window) - 1).cast("long")).drop("_part")


#: Edges that one task joins up.
TASK_EDGES = 300_000


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected edges (`a`, `b`) as (node, root); root is the smallest node.

    Up to `task_edges` edges are joined up by one task. Beyond that come
    alternating large-star and small-star rounds: each is a grouped minimum,
    combined before the shuffle, and a join whose large keys AQE can split.
    Every round ends in a checkpoint; it stops when no edge changes.
    """
    if edges.limit(task_edges + 1).count() <= task_edges:
        kind = edges.schema["a"].dataType.simpleString()
        return map_arrow(edges.select("a", "b").coalesce(1), _join_up, f"node {kind}, root {kind}")
    now = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = large.where("v <> u")
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        now = checkpoint(
            joined.select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(small.select("v", F.col("m").alias("u")))
            .where("v <> u")
            .distinct()
        )
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def _join_up(batches):
    """Union-find over all edges of the task; the smaller root stays."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if schema is not None:
        nodes = list(parent)
        kind = schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Tables:
    """The tables between the steps of a job, as Parquet in the shared folder.

    `put` writes a step's rows and gives them back as a plain scan, so that a lost
    executor costs the tasks it held and no earlier step; `drop` removes a table
    that later steps don't need, leaving the block removes the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.at: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        with _small_batches(self.spark):
            df.write.parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(held)] = held, path
        return held

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, self.at.pop(id(df))[1])

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path)


_REMOVAL: weakref.WeakKeyDictionary[DataFrame, Callable[[], None]] = weakref.WeakKeyDictionary()


def removed(df: DataFrame) -> None:
    """Removes the table of a frame that `written` gave; for others nothing."""
    remove = _REMOVAL.pop(df, None)
    if remove is not None:
        remove()
        atexit.unregister(remove)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; removed by `removed`, or when Python ends, if the session still runs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)

    atexit.register(remove)
    held = spark.read.schema(df.schema).parquet(path)
    _REMOVAL[held] = remove
    return held


def pieces(batch: pa.RecordBatch):
    """A batch in slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes, or of one row."""
    at = 0
    while at < batch.num_rows:
        n = min(BATCH_ROWS, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > BATCH_BYTES:
            n //= 2
        yield batch.slice(at, n)
        at += n


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over bounded slices of Spark's batches; a task's Python memory goes back to the system at its end."""

    def bounded(batches):
        try:
            yield from run(part for batch in batches for part in pieces(batch))
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
