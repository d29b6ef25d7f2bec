"""Industry memberships kept as a table, with the counts that tell whether a load was sane."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COLUMNS = ("l1_code", "l1_name", "l2_code", "l2_name", "l3_code", "l3_name", "ts_code", "name", "in_date", "out_date", "is_new")
#: A membership is this; of several rows for it the last load's stays.
KEY = ("ts_code", "l3_code", "in_date")


@dataclass(frozen=True)
class Counts:
    """Of what a load wrote: rows, earliest in_date, memberships without an end, and those that hold on a day."""

    rows: int
    earliest: str | None
    open_intervals: int
    members: int


def whole(rows: DataFrame) -> DataFrame:
    """``rows`` with all COLUMNS as text, missing ones empty; of rows for one membership the closed one, or else the largest, stays."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS]
    rest = [c for c in COLUMNS if c not in KEY]
    last = F.max(F.struct((F.col("out_date") != "").alias("closed"), *rest))
    return rows.select(*text).groupBy(*KEY).agg(last.alias("r")).select(*(F.col(c) if c in KEY else F.col(f"r.{c}") for c in COLUMNS))


def write_memberships(rows: DataFrame, path: str, day: str) -> Counts:
    """Replace the l1_code partitions that ``rows`` has under ``path``, others stay; so a load done twice leaves what it leaves once.

    The counts are taken in the job that writes. ``day``: yyyymmdd, for the members on it.
    """
    seen = Observation()
    on_day = (F.col("in_date") <= day) & ((F.col("out_date") == "") | (F.col("out_date") > day))
    watched = whole(rows).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("in_date").alias("earliest"), F.count_if(F.col("out_date") == "").alias("open_intervals"), F.count_if(on_day).alias("members")
    )
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("l1_code").parquet(path)
    return Counts(**seen.get)
