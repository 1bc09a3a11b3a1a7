"""Session aggregates, filters, length and step statistics, sampling and details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import ratio, seconds_between
from clickloom.params import TaskParams

#: Fixed bucket bounds (name, first, last), both included; a visit of 0 s is in none.
VISIT_BUCKETS = [
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60), ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None),
]
STEP_BUCKETS = [("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None)]


def session_aggregate(actions: DataFrame) -> DataFrame:
    """One row per session: user, keywords and click categories (distinct, sorted), start, end, whole seconds, steps."""
    lists = lambda c: F.array_sort(F.collect_set(c))
    out = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), lists("search_keyword").alias("keywords"), lists("click_category_id").alias("category_ids"),
        F.min("action_time").alias("start_time"), F.max("action_time").alias("end_time"), F.count("*").alias("step_length"),
    )
    return out.withColumn("visit_length", seconds_between(F.col("start_time"), F.col("end_time")))


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of known users with age, professional, city and sex."""
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def between(value: Column, low, high) -> Column | None:
    """Both bounds included; no predicate unless both are given; a missing value is outside."""
    return None if low is None or high is None else F.coalesce(value.between(low, high), F.lit(False))


def equal(value: Column, wanted) -> Column | None:
    return None if wanted is None else F.coalesce(value == wanted, F.lit(False))


def one_of(value: Column, wanted) -> Column | None:
    return F.coalesce(value.isin(*wanted), F.lit(False)) if wanted else None


def any_of(values: Column, wanted, kind: str) -> Column | None:
    """Whether an array shares an element with the wanted ones."""
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted)).cast(f"array<{kind}>")), F.lit(False)) if wanted else None


def session_filter(sessions: DataFrame, p: TaskParams) -> DataFrame:
    """Sessions that meet every given condition on age, professional, city, sex, keywords and click categories."""
    conditions = [
        between(F.col("age"), p.start_age, p.end_age), one_of(F.col("professional"), p.professionals), one_of(F.col("city"), p.cities), equal(F.col("sex"), p.sex),
        any_of(F.col("keywords"), p.keywords, "string"), any_of(F.col("category_ids"), p.category_ids, "bigint"),
    ]
    given = [c for c in conditions if c is not None]
    return sessions.where(reduce(lambda a, b: a & b, given)) if given else sessions


def bucket(value: Column, bounds: list[tuple[str, int, int | None]]) -> Column:
    """Name of the bucket that a value falls in; null if in none."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bounds):
        out = F.when(value.between(low, high) if high is not None else value >= low, name).otherwise(out)
    return out


def session_statistics(sessions: DataFrame) -> DataFrame:
    """One row: number of sessions and of those in each bucket."""
    counts = [F.count_if(bucket(F.col(c), b) == name).alias(f"{prefix}_{name}") for prefix, c, b in (("visit", "visit_length", VISIT_BUCKETS), ("step", "step_length", STEP_BUCKETS)) for name, _, _ in b]
    return sessions.agg(F.count("*").alias("session_count"), *counts)


def session_ratios(statistics: DataFrame) -> DataFrame:
    """The buckets' shares of all sessions, two places."""
    return statistics.select("session_count", *(ratio(F.col(c), F.col("session_count")).alias(c) for c in statistics.columns if c != "session_count"))


def hourly_counts(sessions: DataFrame) -> DataFrame:
    """Sessions by date and hour of their start."""
    return sessions.groupBy(F.to_date("start_time").alias("date"), F.hour("start_time").cast("long").alias("hour")).agg(F.count("*").alias("sessions"))


def stratified_sample(sessions: DataFrame, total: int = 100, order: Column | None = None) -> DataFrame:
    """total shared equally among days and within a day by the hours' shares (both cut to whole sessions), without replacement; order picks within an hour (default: a hash of the id)."""
    keyed = sessions.withColumn("date", F.to_date("start_time")).withColumn("hour", F.hour("start_time").cast("long"))
    hours = keyed.groupBy("date", "hour").agg(F.count("*").alias("in_hour"))
    # a row for each hour of a calendar day goes through these windows
    in_day = F.sum("in_hour").over(Window.partitionBy("date"))
    ranked_days = hours.withColumn("in_day", in_day).withColumn("_day", F.dense_rank().over(Window.orderBy("date")))
    days = F.max("_day").over(Window.partitionBy())
    per_day = F.floor(F.lit(total) / F.col("days"))
    quota = ranked_days.withColumn("days", days)
    quota = quota.select("date", "hour", F.least(F.floor(F.col("in_hour").cast("double") / F.col("in_day") * per_day), F.col("in_hour")).alias("quota")).where("quota > 0")
    pick = Window.partitionBy("date", "hour").orderBy(F.md5("session_id") if order is None else order, "session_id")
    # no hour has a larger quota than total, so each task keeps that many rows of an hour at most
    ranked = keyed.withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") <= total)
    return ranked.join(quota, ["date", "hour"]).where(F.col("_pick") <= F.col("quota")).drop("_pick", "quota")


def details(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """All actions of the given sessions, each once."""
    return actions.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
