"""Conversion along a flow of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import ratio


def page_pairs(actions: DataFrame) -> DataFrame:
    """Consecutive pages of each session: session_id, from_page, to_page."""
    order = Window.partitionBy("session_id").orderBy("action_time", "action_id")
    return actions.select("session_id", F.lag("page_id").over(order).alias("from_page"), F.col("page_id").alias("to_page")).where("from_page IS NOT NULL")


def flow_table(spark, flow: Sequence[int]) -> DataFrame:
    """position, from_page, to_page of each step of a flow."""
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False), 1)]
    return spark.createDataFrame(rows, "position long, from_page long, to_page long")


def split_views(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """Views of each step, zero included; a pair that the flow has twice counts for both."""
    steps = flow_table(actions.sparkSession, flow)
    pairs = F.broadcast(steps.select("from_page", "to_page").distinct())  # as long as the flow
    views = page_pairs(actions).join(pairs, ["from_page", "to_page"]).groupBy("from_page", "to_page").agg(F.count("*").alias("views"))
    return steps.join(views, ["from_page", "to_page"], "left").select("position", "from_page", "to_page", F.coalesce("views", F.lit(0)).alias("views"))


def start_views(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """One row: views of the flow's first page."""
    return actions.agg(F.count_if(F.col("page_id") == flow[0]).alias("views"))


def conversion(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """Each step's views over those of the step before, the first's over the start page's; null after a step without views."""
    start = start_views(actions, flow).select(F.lit(0).cast("long").alias("position"), F.lit(None).cast("long").alias("from_page"), F.lit(flow[0]).cast("long").alias("to_page"), "views")
    steps = split_views(actions, flow).unionByName(start)
    before = F.lag("views").over(Window.orderBy("position"))  # as many rows as the flow has
    return steps.withColumn("before", before).where("position > 0").select("position", "from_page", "to_page", "views", ratio(F.col("views"), F.col("before")).alias("rate"))


def rendered(rates: DataFrame) -> DataFrame:
    """One row `from_to=rate|...` in flow order."""
    part = F.concat_ws("=", F.concat_ws("_", F.col("from_page").cast("string"), F.col("to_page").cast("string")), F.format_string("%.2f", "rate"))
    rows = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))
    return rates.agg(F.array_join(F.transform(rows, lambda x: x["part"]), "|").alias("rates"))
