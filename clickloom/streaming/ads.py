"""Ad clicks: transforms that batches and streams share. Each takes and returns a DataFrame and keeps keys as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Clicks of a user on an ad in a day at which the user is blacklisted.
THRESHOLD = 100
#: Minutes that the trend looks back.
TREND_MINUTES = 60


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """`timestamp province city user ad` as typed columns; lines of another form are left out."""
    part = F.split(F.trim(F.col(column).cast("string")), r"\s+")
    typed = lines.withColumn("_p", part).where(F.size("_p") == 5)
    ts = F.timestamp_millis(F.col("_p")[0].try_cast("long"))
    rows = typed.select(ts.alias("ts"), F.to_date(ts).alias("date"), F.col("_p")[1].alias("province"), F.col("_p")[2].alias("city"), F.col("_p")[3].try_cast("long").alias("user_id"), F.col("_p")[4].try_cast("long").alias("ad_id"))
    return rows.where("ts IS NOT NULL AND user_id IS NOT NULL AND ad_id IS NOT NULL")


def without_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that aren't blacklisted."""
    return clicks.join(blacklist.select("user_id"), "user_id", "left_anti")


def user_ad_counts(clicks: DataFrame) -> DataFrame:
    """Clicks by day, user and ad."""
    return clicks.groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklisted(counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Users with at least threshold clicks on one ad in one day."""
    return counts.where(F.col("click_count") >= threshold).select("user_id").distinct()


def ad_counts(clicks: DataFrame) -> DataFrame:
    """Clicks by day, province, city and ad."""
    return clicks.groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_counts(stat: DataFrame) -> DataFrame:
    """Cities summed to provinces."""
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top(stat: DataFrame, n: int = 3) -> DataFrame:
    """The n most clicked ads of each day and province; ties by ad."""
    rank = F.row_number().over(Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id"))
    return province_counts(stat).withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def minute_counts(clicks: DataFrame) -> DataFrame:
    """Clicks of each ad in each minute of event time."""
    return clicks.groupBy(F.date_trunc("minute", "ts").alias("minute"), "ad_id").agg(F.count("*").alias("click_count"))


def trend(clicks: DataFrame, minutes: int = TREND_MINUTES) -> DataFrame:
    """Minute counts of the last minutes before the newest click's minute, that minute included."""
    counts = minute_counts(clicks)
    last = counts.agg(F.max("minute").alias("last"))  # one row
    return counts.crossJoin(F.broadcast(last)).where(F.col("minute") > F.col("last") - F.expr(f"INTERVAL {minutes} MINUTES")).drop("last")


def sliding_counts(clicks: DataFrame, length: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks of each ad in windows of event time, one each slide; for a batch or a stream (with a watermark on ts). Clicks are counted by slide before they are spread over the windows that hold them."""
    short = clicks.groupBy(F.window("ts", slide).alias("_slide"), "ad_id").agg(F.count("*").alias("_n"))
    return short.groupBy(F.window(F.window_time("_slide"), length, slide).alias("window"), "ad_id").agg(F.sum("_n").alias("click_count")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "ad_id", "click_count")
