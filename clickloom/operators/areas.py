"""Most clicked products of each area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import concat_long_string, json_field

#: Levels of areas; other areas are D Level.
LEVELS = {"华北": "A Level", "华东": "A Level", "华南": "B Level", "华中": "B Level", "西北": "C Level", "西南": "C Level"}
OTHER_LEVEL = "D Level"
#: Names of the product status 0 and of every other.
OWN, THIRD_PARTY = "自营", "第三方"


def with_cities(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks in known cities, with city name and area; Spark broadcasts the cities where they are few."""
    return clicks.join(cities, "city_id")


def area_product_counts(clicks: DataFrame) -> DataFrame:
    """Clicks of each product in each area, and the distinct cities `id:name`, sorted and comma-joined."""
    per_city = clicks.groupBy("area", "product_id", "city_id", "city_name").agg(F.count("*").alias("n"))
    info = concat_long_string(F.col("city_id"), F.col("city_name"), ":")
    return per_city.groupBy("area", "product_id").agg(F.sum("n").alias("click_count"), F.array_join(F.array_sort(F.collect_set(info)), ",").alias("city_infos"))


def product_status(extend_info: Column) -> Column:
    status = json_field(extend_info, "product_status").try_cast("long")
    return F.when(status == 0, OWN).otherwise(THIRD_PARTY)


def with_products(counts: DataFrame, products: DataFrame) -> DataFrame:
    return counts.join(products, "product_id").select("area", "product_id", "click_count", "city_infos", "product_name", product_status(F.col("extend_info")).alias("product_status"))


def area_level(area: Column, levels: Mapping[str, str] = LEVELS) -> Column:
    out = F.lit(OTHER_LEVEL)
    for name, level in levels.items():
        out = F.when(area == name, level).otherwise(out)
    return out


def top_products(full: DataFrame, n: int = 3, levels: Mapping[str, str] = LEVELS) -> DataFrame:
    """The n most clicked products of each area, ties by product id, with the area's level."""
    rank = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id"))
    ranked = full.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
    return ranked.select("area", area_level(F.col("area"), levels).alias("area_level"), "product_id", "click_count", "city_infos", "product_name", "product_status", "rank")
