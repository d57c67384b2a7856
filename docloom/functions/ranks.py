"""Global places without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import reliable


def with_place(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order: a range partitioning sorts, counts of the parts give the offsets.

    Bounds are sampled, so the parts are held in a checkpoint before they are counted.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    start = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return ranged.withColumn(name, (start + own).cast("long")).drop("_part")
