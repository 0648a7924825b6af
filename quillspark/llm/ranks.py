"""Gapless ranks within keys, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


def rank_within(df: DataFrame, keys: list[str], rank: str = "rank", *, written: bool = False) -> DataFrame:
    """Add ``rank``: 0, 1, 2 ... within each combination of ``keys`` (nulls form one key).

    The rows are written once (``written``: they come from ``store.materialize`` already); a row's place is (part file, row index), which a rerun of a lost
    task reads again unchanged. Rows are ranked inside (key, part file), which one file bounds
    however hot the key is, and shifted by the counts of the key's earlier files. Ties and
    repeated rows get ranks of their own in file order; an empty table stays empty.
    """
    table = df if written else store.materialize(df, "ranked")[0]
    part, row = "__part", "__row"
    placed = table.select(
        "*",
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias(part),
        F.col("_metadata.row_index").alias(row),
    )
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            F.col(part).alias("__p"),
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"),
        )
    )
    within = Window.partitionBy(*keys, part).orderBy(row)
    same = F.col(part) == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (
        placed.withColumn("__at", F.row_number().over(within) - 1)
        .join(shifts, same)
        .select(*df.columns, (F.col("__at") + F.col("__shift")).cast("long").alias(rank))
    )
