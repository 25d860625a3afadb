"""Cleaned views of the domain tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.text import plain, session_key
from loomgate.sources import table


def events(spark, d) -> DataFrame:
    """One row an action; re-delivered rows are equal but for their time of arrival."""
    m = table(spark, d, "event_manifest").drop("ingested_at").dropDuplicates(["event_id"])
    return m.withColumn("source", plain(F.col("source"))).withColumn("session_id", session_key(F.col("session_id"))).withColumn("instruction_sha256", F.lower("instruction_sha256"))


def records(spark, d) -> DataFrame:
    """One row a materialized record."""
    return table(spark, d, "materialized_record").drop("ingested_at").dropDuplicates(["event_id"]).withColumn("source", plain(F.col("source")))


def scores(spark, d) -> DataFrame:
    """One row for each tier and action: a good row before a failed one, then the smallest label and risk."""
    order = [F.when(F.col("status") == "ok", 0).otherwise(1), F.asc_nulls_last("label"), F.asc_nulls_last("risk_score")]
    w = Window.partitionBy("tier", "event_id").orderBy(*order)
    return table(spark, d, "score_cache").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("source", plain(F.col("source")))


def measurements(spark, d) -> DataFrame:
    """One row a measurement, with plain status and tercile."""
    m = table(spark, d, "service_profile").drop("ingested_at").dropDuplicates(["measurement_id"])
    return m.withColumn("status", plain(F.col("status"))).withColumn("input_length_tercile", plain(F.col("input_length_tercile")))


EV = """ev as (
  select * replace (lower(trim(source)) as source, replace(lower(trim(session_id)), '/', ':') as session_id, lower(instruction_sha256) as instruction_sha256)
  from (select distinct on (event_id) * from event_manifest))"""
RC = "rc as (select * replace (lower(trim(source)) as source) from (select distinct on (event_id) * from materialized_record))"
SC = """sc as (
  select * replace (lower(trim(source)) as source) from score_cache
  qualify row_number() over (partition by tier, event_id order by case when status = 'ok' then 0 else 1 end, label nulls last, risk_score nulls last) = 1)"""
SP = """sp as (
  select * replace (lower(trim(status)) as status, lower(trim(input_length_tercile)) as input_length_tercile)
  from (select distinct on (measurement_id) * from service_profile))"""
