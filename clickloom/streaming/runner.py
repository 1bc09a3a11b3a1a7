"""The ad stream as a Structured Streaming query: one ordered step list per micro-batch, restarted from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.streaming import ads
from clickloom.streaming.sinks import VersionedTable


def kafka_lines(spark: SparkSession, servers: str, topics: str, **options) -> DataFrame:
    """Lines of comma-separated Kafka topics (needs Spark's Kafka package)."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, **options}).load().select(F.col("value").cast("string").alias("value"))


def file_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of text files that appear in a folder."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


class AdStream:
    """Tables ad_user_click_count, ad_blacklist, ad_stat, ad_province_top3 and ad_click_trend under one folder.

    In each batch: clicks of users blacklisted in earlier batches go; the day's user-ad counts grow; users of this batch at the
    threshold join the blacklist, which the next batch is filtered by; ad counts, the tops of this batch's provinces and the totals of its
    minutes follow. The trend counts every click, blacklisted users' too, by event time. A batch that is replayed changes
    nothing; batches are told apart by the query that runs them, so a new checkpoint begins anew.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int = ads.THRESHOLD, top: int = 3, trend_minutes: int = ads.TREND_MINUTES):
        self.folder, self.threshold, self.top, self.trend_minutes = folder, threshold, top, trend_minutes
        make = lambda name, schema: VersionedTable(spark, f"{folder}/{name}", schema)
        self.user_counts = make("ad_user_click_count", "date date, user_id long, ad_id long, click_count long")
        self.blacklist = make("ad_blacklist", "user_id long")
        self.stat = make("ad_stat", "date date, province string, city string, ad_id long, click_count long")
        self.tops = make("ad_province_top3", "date date, province string, ad_id long, click_count long, rank long")
        self.minutes = make("ad_click_trend", "minute timestamp, ad_id long, click_count long")

    def step(self, batch: DataFrame, batch_id: int, query: str | None = None) -> None:
        every = batch.persist()
        query = query or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        try:
            # a replayed batch must be filtered by the blacklist that it was filtered by at first
            clicks = ads.without_blacklisted(every, self.blacklist.read((query, batch_id)))
            counts = ads.user_ad_counts(clicks)
            self.user_counts.add(counts, batch_id, ["date", "user_id", "ad_id"], "click_count", query)
            # only users whose counts this batch changed can have come to the threshold
            changed = self.user_counts.read().join(counts.select("user_id").distinct(), "user_id", "left_semi")
            self.blacklist.append(ads.blacklisted(changed, self.threshold), batch_id, ["user_id"], query)
            stat = ads.ad_counts(clicks)
            self.stat.add(stat, batch_id, ["date", "province", "city", "ad_id"], "click_count", query)
            places = stat.select(F.col("date").alias("_date"), F.col("province").alias("_province")).distinct()
            own = self.stat.read().join(places, F.col("date").eqNullSafe(F.col("_date")) & F.col("province").eqNullSafe(F.col("_province")), "left_semi")
            self.tops.replace(ads.province_top(own, self.top), batch_id, ["date", "province"], query)
            # the totals of the minutes that this batch touches replace those there
            now = ads.minute_counts(every)
            before = self.minutes.read((query, batch_id)).join(now.select("minute", "ad_id"), ["minute", "ad_id"], "left_semi")
            self.minutes.replace(before.unionByName(now).groupBy("minute", "ad_id").agg(F.sum("click_count").alias("click_count")), batch_id, ["minute", "ad_id"], query)
        finally:
            every.unpersist()

    def trend(self) -> DataFrame:
        counts = self.minutes.read()
        last = counts.agg(F.max("minute").alias("last"))
        return counts.crossJoin(F.broadcast(last)).where(F.col("minute") > F.col("last") - F.expr(f"INTERVAL {self.trend_minutes} MINUTES")).drop("last")

    def start(self, lines: DataFrame, checkpoint: str, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
        """Run over a stream of log lines; a restart goes on from the checkpoint."""
        writer = ads.parsed(lines).writeStream.foreachBatch(lambda batch, batch_id: self.step(batch, batch_id)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def running_counts(clicks: DataFrame, lateness: str | None = None) -> DataFrame:
    """Ad counts of a stream as Spark's own keyed state; lateness bounds the state by event day."""
    keyed = clicks.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day")["start"].cast("date").alias("date"), "province", "city", "ad_id") if lateness else clicks.groupBy("date", "province", "city", "ad_id")
    return keyed.agg(F.count("*").alias("click_count"))
