"""Category counts, top categories and top sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category_events(actions: DataFrame) -> DataFrame:
    """A row (category_id, kind) for each click, and for each id of an order or payment; one pass over the actions."""
    one = lambda c, kind: F.struct(c.cast("long").alias("category_id"), F.lit(kind).alias("kind"))
    listed = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<long>")), lambda x: one(x, kind))
    every = F.concat(F.array(one(F.col("click_category_id"), "click")), listed("order_category_ids", "order"), listed("pay_category_ids", "pay"))
    return actions.select(F.explode(F.filter(every, lambda x: x["category_id"].isNotNull())).alias("x")).select("x.category_id", "x.kind")


def distinct_categories(actions: DataFrame) -> DataFrame:
    return category_events(actions).select("category_id").distinct()


def category_counts(actions: DataFrame) -> DataFrame:
    """Clicks, orders and payments of every category; one shuffle of partial sums."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}_count")
    return category_events(actions).groupBy("category_id").agg(count("click"), count("order"), count("pay"))


def top_categories(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n categories with most clicks, then orders, then payments; ties by id."""
    return counts.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(n)


def category_session_counts(actions: DataFrame, categories: DataFrame) -> DataFrame:
    """Clicks of each session in each of the given few categories."""
    own = F.broadcast(categories.select("category_id"))  # the n of a top-n
    clicks = actions.where("click_category_id IS NOT NULL").select("session_id", F.col("click_category_id").alias("category_id"))
    return clicks.join(own, "category_id").groupBy("category_id", "session_id").agg(F.count("*").alias("click_count"))


def top_sessions(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions with most clicks in each category; ties by session id."""
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
