"""The given tables as signal data: peaks, time series, masses, profiles, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, scan (week number), mz (whole units), intensity (cents), summed for each channel and scan."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("channel"),
        F.expr("cast(unix_date(cast(l_shipdate as date)) div 7 as int)").alias("scan"),
        F.expr("cast(l_quantity as bigint)").alias("mz"),
        F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("intensity"),
    )
    return rows.groupBy("channel", "scan").agg(F.sum("intensity").alias("intensity"), F.sum(F.col("mz") * F.col("intensity")).alias("mz_weighted"))


PEAKS_SQL = """
peaks as (
  select l_suppkey as channel, ((l_shipdate::date - date '1970-01-01') // 7)::int as scan,
    sum(round(l_extendedprice * 100)::bigint)::bigint as intensity,
    sum(l_quantity::bigint * round(l_extendedprice * 100)::bigint)::bigint as mz_weighted
  from lineitem group by all
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (event type), channel (user), seq (event id), value (thousandths)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("user_id").alias("channel"), F.col("event_id").alias("seq"), F.expr("cast(round(value * 1000) as bigint)").alias("value")
    )


SERIES_SQL = "series as (select event_type as run, user_id as channel, event_id as seq, round(value * 1000)::bigint as value from events)"
