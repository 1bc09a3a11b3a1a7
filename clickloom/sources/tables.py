"""Readers, and the mapping of the star schema to behaviour tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A pause longer than this starts a new session.
GAP_HOURS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A table of a database; options: driver, user, password, partitionColumn, lowerBound, upperBound, numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the session's catalog (a Hive metastore where the session has one)."""
    return spark.table(name)


def hive_session(name: str, warehouse: str, **config) -> SparkSession:
    """A session with a Hive metastore; its tables are catalog tables."""
    builder = SparkSession.builder.appName(name).config("spark.sql.warehouse.dir", warehouse)
    for key, value in config.items():
        builder = builder.config(key, value)
    return builder.enableHiveSupport().getOrCreate()


def as_view(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """Rows as a temporary view that SQL can name."""
    df = in_memory(spark, rows, schema)
    df.createOrReplaceTempView(name)
    return df


def generated(spark: SparkSession, users: int = 100, sessions: int = 1000, products: int = 100, seed: int = 1, heavy: float = 0.0, day: str = "2024-01-01") -> dict[str, DataFrame]:
    """Seeded behaviour tables of any size, made on the executors: user_visit_action, user_info and product_info. heavy: share of all actions that fall on session 0, for skew."""
    kinds = F.array(*map(F.lit, ("search", "click", "order", "pay")))
    number = lambda salt, n: F.pmod(F.xxhash64("action_id", F.lit(salt), F.lit(seed)), F.lit(n))
    plain = spark.range(sessions).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100)))).alias("step")).select(F.col("id").alias("n"), (F.col("id") * 1000 + F.col("step")).alias("action_id"))
    more = spark.range(int(heavy / (1 - heavy) * sessions * 50)).select(F.lit(0).cast("long").alias("n"), (-1 - F.col("id")).alias("action_id"))
    rows = plain.unionByName(more).withColumn("kind", F.get(kinds, number(1, 4).cast("int"))).withColumn("second", number(2, 86_400))
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    listed = lambda salt, n: F.array(number(salt, n))
    actions_ = rows.select(
        "action_id", F.lit(day).cast("date").alias("date"), F.pmod(F.xxhash64("n", F.lit(seed + 1)), F.lit(users)).alias("user_id"), F.md5(F.concat(F.col("n").cast("string"), F.lit(f"-{seed}"))).alias("session_id"), number(3, 10).alias("page_id"),
        F.timestamp_seconds(F.unix_seconds(F.lit(day).cast("timestamp")) + F.col("second")).cast("timestamp_ntz").alias("action_time"), when("search", F.concat(F.lit("keyword"), number(4, 10).cast("string"))).alias("search_keyword"),
        when("click", number(5, 100)).alias("click_category_id"), when("click", number(6, products)).alias("click_product_id"), when("order", listed(5, 100)).alias("order_category_ids"), when("order", listed(6, products)).alias("order_product_ids"),
        when("pay", listed(5, 100)).alias("pay_category_ids"), when("pay", listed(6, products)).alias("pay_product_ids"), number(7, 10).alias("city_id"),
    )
    named = lambda prefix, c="id": F.concat(F.lit(prefix), F.col(c).cast("string"))
    people = spark.range(users).select(
        F.col("id").alias("user_id"), named("user").alias("username"), named("name").alias("name"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(60)).cast("int").alias("age"),
        F.concat(F.lit("professional"), F.pmod(F.xxhash64("id", F.lit(seed + 3)), F.lit(100)).cast("string")).alias("professional"), F.concat(F.lit("city"), F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(100)).cast("string")).alias("city"),
        F.when(F.col("id") % 2 == 0, "male").otherwise("female").alias("sex"),
    )
    goods = spark.range(products).select(F.col("id").alias("product_id"), named("product").alias("product_name"), F.concat(F.lit('{"product_status":'), F.pmod(F.xxhash64("id", F.lit(seed + 5)), F.lit(2)).cast("string"), F.lit("}")).alias("extend_info"))
    return {"user_visit_action": actions_, "user_info": people, "product_info": goods}


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def between_dates(df: DataFrame, start: dt.date | None, end: dt.date | None, column: str = "date") -> DataFrame:
    """Rows whose date is from start to end, both included; a missing bound restricts nothing."""
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            df = df.where(keep(F.col(column), F.lit(bound)))
    return df


def sessionized(events: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """events (user_id, ts, event_id) with session_id: the user and the running number of the user's pauses."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.lag("ts").over(order)
    first = F.when(pause.isNull() | (F.col("ts") > pause + F.expr(f"INTERVAL {gap_hours} HOURS")), 1).otherwise(0)
    numbered = events.withColumn("_first", first).withColumn("_n", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("session_id", F.concat_ws("_", F.col("user_id").cast("string"), F.col("_n").cast("string"))).drop("_first", "_n")


def actions(spark: SparkSession, sf_dir: str, gap_hours: int = GAP_HOURS) -> DataFrame:
    """user_visit_action from events: views are searches, sign-ups orders, purchases payments."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind = lambda *names: F.col("event_type").isin(*names)
    pair = F.array(F.col("k") % 20, (F.col("k") + 1) % 20)
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("city_id"))
    rows = sessionized(table(spark, sf_dir, "events").withColumn("k", k), gap_hours).join(homes, "user_id", "left")
    return rows.select(
        F.col("event_id").alias("action_id"), F.to_date("ts").alias("date"), "user_id", "session_id", (F.col("k") % 10).alias("page_id"), F.col("ts").alias("action_time"),
        F.when(kind("view"), F.concat(F.lit("kw"), (F.col("k") % 10).cast("string"))).alias("search_keyword"),
        F.when(kind("click"), F.col("k") % 20).alias("click_category_id"), F.when(kind("click"), F.col("k")).alias("click_product_id"),
        F.when(kind("signup"), pair).alias("order_category_ids"), F.when(kind("signup"), F.array("k")).alias("order_product_ids"),
        F.when(kind("purchase"), pair).alias("pay_category_ids"), F.when(kind("purchase"), F.array("k")).alias("pay_product_ids"), "city_id",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_info from customer and nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"), (F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"), "city", F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("sex"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_info from nation and region: city_id, city_name, area."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("area"))
    return table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), "area")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_info from part: product_id, product_name, extend_info as JSON."""
    info = F.concat(F.lit('{"product_status":'), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), info.alias("extend_info"))


def product_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many clicks of products by city, from lineitem, orders and customer: city_id, product_id, date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    homes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("city_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("date"))
    return lines.join(orders, "l_orderkey").join(homes, "c_custkey").select("city_id", "product_id", "date")


def ad_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad clicks from click events: ts, date, province, city, user_id, ad_id."""
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("city_id"))
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    rows = events.join(homes, "user_id").join(cities(spark, sf_dir), "city_id")
    return rows.select("event_id", "ts", F.to_date("ts").alias("date"), F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("ad_id"))
