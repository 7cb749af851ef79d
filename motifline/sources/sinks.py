"""Where matches, forecasts and scores go. Everything is a DataFrame, so any writer serves; these fix layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_lines(matches: DataFrame) -> DataFrame:
    events = F.concat_ws("->", F.transform("events", lambda x: x.cast("string"))) if "events" in matches.columns else F.col("end_id").cast("string")
    return matches.select(F.concat(F.lit("MATCH: Timestamp->"), F.col("match_ts"), F.lit(" Events->"), events, F.lit("->COMPLETE")).alias("value"))


def forecast_lines(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(F.concat(F.lit("PREDICTION@"), F.col("ts"), F.lit(":Attr->"), F.col("part"), F.lit("|["), F.col("start_counter"), F.lit(","), F.col("end_counter"), F.lit("]:"), F.col("prob")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Appends a CSV row; statistics are a handful of rows."""
    stats.coalesce(1).write.mode("append").option("header", True).csv(path)


def detections_table(matches: DataFrame) -> DataFrame:
    events = F.concat_ws(",", F.transform("events", lambda x: x.cast("string"))) if "events" in matches.columns else F.lit(None).cast("string")
    return matches.select(F.col("pattern_id").alias("id"), F.col("match_ts").alias("ts"), F.col("part").alias("partitionval"), F.col("end_id").alias("state"), events.alias("events"))


def forecasts_table(judged: DataFrame, pattern_id: int = 0) -> DataFrame:
    return judged.select(
        F.lit(pattern_id).alias("id"), "ts", F.col("part").alias("partitionval"), "state", F.col("start").alias("startnow"), F.col("end").alias("endnow"), F.col("start_counter").alias("startcounter"),
        F.col("end_counter").alias("endcounter"), "prob", "spread", F.col("middle").alias("distance"), F.col("correct").alias("iscorrect"),
    )


def write_jdbc(df: DataFrame, url: str, table: str, **properties) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties)
