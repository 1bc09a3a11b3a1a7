"""Result tables of the analysis tasks: their columns, and how the jobs' results fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators import funnel
from clickloom.operators.sessions import STEP_BUCKETS, VISIT_BUCKETS
from clickloom.params import TaskParams
from clickloom.plans.jobs import SessionReport, area_top_products, page_conversion, session_analysis
from clickloom.streaming.sinks import write_jdbc

#: Tables and columns, in order.
TABLES = {
    "session_aggr_stat": "taskid long, session_count long, " + ", ".join([f"visit_length_{n}_ratio double" for n, _, _ in VISIT_BUCKETS] + [f"step_length_{n}_ratio double" for n, _, _ in STEP_BUCKETS]),
    "session_random_extract": "taskid long, sessionid string, start_time timestamp_ntz, search_keywords string, click_category_ids string",
    "session_detail": "taskid long, userid long, sessionid string, pageid long, action_time timestamp_ntz, search_keyword string, click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string",
    "top10_category": "taskid long, categoryid long, click_count long, order_count long, pay_count long",
    "top10_category_session": "taskid long, categoryid long, sessionid string, click_count long",
    "page_split_convert_rate": "taskid long, convert_rate string",
    "area_top3_product": "taskid long, area string, area_level string, product_id long, city_infos string, click_count long, product_name string, product_status string",
}


def _as(name: str, df: DataFrame, task_id: int, **columns: Column | str) -> DataFrame:
    """df as rows of a table; columns: what fills those that have another name."""
    out = []
    for part in TABLES[name].split(", "):
        column, kind = part.split(" ")
        value = F.lit(task_id) if column == "taskid" else columns.get(column, column)
        out.append((F.col(value) if isinstance(value, str) else value).cast(kind).alias(column))
    return df.select(*out)


def _listed(values: str) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def _details(rows: DataFrame, task_id: int) -> DataFrame:
    lists = {c: _listed(c) for c in ("order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids")}
    return _as("session_detail", rows, task_id, userid="user_id", sessionid="session_id", pageid="page_id", **lists)


def session_tables(report: SessionReport, task_id: int) -> dict[str, DataFrame]:
    """The session task's results: shares of the buckets, the sample, details of the sample and of the top sessions, top categories and their top sessions."""
    ratios = {f"{long}_{n}_ratio": f"{short}_{n}" for long, short, bounds in (("visit_length", "visit", VISIT_BUCKETS), ("step_length", "step", STEP_BUCKETS)) for n, _, _ in bounds}
    return {
        "session_aggr_stat": _as("session_aggr_stat", report.ratios, task_id, **ratios),
        "session_random_extract": _as("session_random_extract", report.sample, task_id, sessionid="session_id", search_keywords=_listed("keywords"), click_category_ids=_listed("category_ids")),
        "session_detail": _details(report.sample_details, task_id).unionByName(_details(report.top_session_details, task_id)),
        "top10_category": _as("top10_category", report.top_categories, task_id, categoryid="category_id"),
        "top10_category_session": _as("top10_category_session", report.top_sessions, task_id, categoryid="category_id", sessionid="session_id"),
    }


def page_tables(actions: DataFrame, p: TaskParams, task_id: int) -> dict[str, DataFrame]:
    """The page task's result: the rates along the flow, rendered."""
    return {"page_split_convert_rate": _as("page_split_convert_rate", funnel.rendered(page_conversion(actions, p)), task_id, convert_rate="rates")}


def area_tables(clicks: DataFrame, cities: DataFrame, products: DataFrame, p: TaskParams, task_id: int, **options) -> dict[str, DataFrame]:
    """The area task's result: the most clicked products of each area."""
    return {"area_top3_product": _as("area_top3_product", area_top_products(clicks, cities, products, p, **options), task_id)}


def session_task(actions: DataFrame, users: DataFrame, p: TaskParams, task_id: int, **options) -> dict[str, DataFrame]:
    return session_tables(session_analysis(actions, users, p, **options), task_id)


def write_tables(tables: dict[str, DataFrame], folder: str | None = None, url: str | None = None, **options) -> None:
    """Write results to folder/<table> as Parquet by task (a task that runs again replaces its own rows), or append them to a database's tables."""
    for name, df in tables.items():
        if url is not None:
            write_jdbc(df, url, name, "append", **options)
        else:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("taskid").parquet(f"{folder}/{name}")
