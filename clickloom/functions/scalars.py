"""Scalar helpers as column expressions, and their SQL names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded half up to two places, by integers; null if whole is 0."""
    n = F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    return F.floor((part.cast("long") * 200 + n) / (n * 2)).cast("double") / 100


def concat_long_string(number: Column, text: Column, separator: str) -> Column:
    """number, separator and text in one; a null shows as null."""
    return F.concat(F.coalesce(number.cast("string"), F.lit("null")), F.lit(separator), F.coalesce(text, F.lit("null")))


def json_field(json: Column, name: str) -> Column:
    """A top-level field of a JSON text, whatever signs its name has but quotes and question marks; null for bad JSON or no such field."""
    return F.get_json_object(json, f"$['{name}']")


def format_double(number: Column, scale: int) -> Column:
    """A double rounded half up by its exact binary value to scale places (at most 7); null for what is no finite number."""
    power = 10.0**scale
    size = F.abs(number.cast("double"))
    scaled = size * power
    # the product's rounding error, exactly: the number is split into halves whose products with the power are exact
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * power - scaled) + (size - high) * power
    whole = F.floor(scaled).cast("double")
    rounded = (whole + F.when((scaled - whole - 0.5) + error >= 0, 1.0).otherwise(0.0)) / power
    finite = F.when(F.isnan(size) | (size == float("inf")), F.lit(None).cast("double"))
    return finite.when(scaled >= 2.0**52, number.cast("double")).otherwise(F.when(number < 0, -rounded).otherwise(rounded))


def random_prefix(text: Column, n: int, seed: int | None = None) -> Column:
    """A salt from 0 to n - 1, `_`, and the text."""
    return F.concat(F.floor(F.rand(seed) * n).cast("string"), F.lit("_"), text)


def remove_random_prefix(text: Column) -> Column:
    """What follows the first `_`."""
    return F.regexp_replace(text, "^[^_]*_", "")


def ids(text: Column) -> Column:
    """A comma-joined list as array of longs; what is no number is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def parse_time(text: Column) -> Column:
    """`yyyy-MM-dd H:mm:ss`, hours with or without a leading zero; null for what is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:mm:ss"))


def parse_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def seconds_between(first: Column, second: Column) -> Column:
    """Whole seconds from first to second."""
    return F.timestamp_diff("SECOND", first, second)


def trim_comma(text: Column) -> Column:
    """Without one comma at either end."""
    return F.regexp_replace(text, "^,|,$", "")


def two_digits(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def is_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def is_before(first: Column, second: Column) -> Column:
    """Whether one time text is before another; false where either is none."""
    return F.coalesce(parse_time(first) < parse_time(second), F.lit(False))


def is_after(first: Column, second: Column) -> Column:
    return F.coalesce(parse_time(first) > parse_time(second), F.lit(False))


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def date_key(text: Column) -> Column:
    """`yyyyMMdd` as a date; null for what is none."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def _fields(text: Column, separator: str) -> Column:
    return F.split(text, "\\Q" + separator + "\\E", -1)


def field_of(text: Column, name: str, separator: str = "|") -> Column:
    """The value of the first `name=value` in a joined list; null if there is none. A field with an empty value or another equals sign inside is no such field."""
    parts = F.transform(_fields(text, separator), lambda p: F.split(F.regexp_replace(p, "=+$", ""), "=", -1))
    return F.get(F.filter(parts, lambda p: (F.size(p) == 2) & (p[0] == name)), F.lit(0))[1]


def with_field(text: Column, name: str, value: Column, separator: str = "|") -> Column:
    """The same list with the first field of that name set to value, if there is one; joined by `|`, and empty fields at the end dropped."""
    cut = _fields(F.regexp_replace(text, "(?:\\Q" + separator + "\\E)+$", ""), separator)
    named = F.transform(cut, lambda p: F.substring_index(p, "=", 1) == name)
    first = F.array_position(named, True)
    return F.array_join(F.transform(cut, lambda p, k: F.when(k + 1 == first, F.concat(F.lit(f"{name}="), value)).otherwise(p)), "|")


def group_concat_distinct(text: Column, separator: str = ",") -> Column:
    """Distinct texts of a group, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(text)), separator)


_CALL = re.compile(r"\bgroup_concat_distinct\s*\(", re.I)


def sql(spark: SparkSession, query: str) -> DataFrame:
    """Run SQL in which the helpers have their names, group_concat_distinct(x) too, which SQL functions can't define: it becomes the same built-in aggregates."""
    register(spark)
    while (m := _CALL.search(query)) is not None:
        depth, end, quote = 1, m.end(), ""
        while depth and end < len(query):
            c = query[end]
            quote = "" if c == quote else quote or (c if c in "'\"`" else "")
            depth += 0 if quote else (c == "(") - (c == ")")
            end += 1
        query = f"{query[: m.start()]}array_join(array_sort(collect_set({query[m.end() : end - 1]})), ','){query[end:]}"
    return spark.sql(query)


def register(spark: SparkSession) -> None:
    """SQL names for these helpers, as temporary SQL functions: no Python runs."""
    for statement in (
        "concat_long_string(n BIGINT, s STRING, sep STRING) RETURNS STRING RETURN concat(coalesce(string(n), 'null'), sep, coalesce(s, 'null'))",
        "json_field(js STRING, name STRING) RETURNS STRING RETURN get_json_object(js, concat('$[\\'', name, '\\']'))",
        "random_prefix(s STRING, n INT) RETURNS STRING NOT DETERMINISTIC RETURN concat(string(bigint(floor(rand() * n))), '_', s)",
        "remove_random_prefix(s STRING) RETURNS STRING RETURN regexp_replace(s, '^[^_]*_', '')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {statement}")
