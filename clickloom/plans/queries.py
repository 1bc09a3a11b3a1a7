"""Registered queries and their DuckDB twins, side by side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars
from clickloom.operators import areas, funnel, sessions, skew, topn
from clickloom.params import TaskParams, find_task
from clickloom.plans import jobs, task_tables
from clickloom.sources import tables
from clickloom.streaming import ads
from clickloom.streaming.sinks import VersionedTable, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FLOW = (3, 5, 2, 4, 6)
FIRST, LAST = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
#: Regions stand for the areas of the star schema.
REGION_LEVELS = {"ASIA": "A Level", "EUROPE": "A Level", "AMERICA": "B Level", "AFRICA": "C Level"}
PARAMS = TaskParams(start_age=10, end_age=50, professionals=("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"), sex="male", keywords=("kw1", "kw2", "kw3", "kw4"), category_ids=(1, 2, 3, 4, 5, 6, 7, 8))
SAMPLE = 1000
BLACKLIST_AT = 2
SECOND_BATCH = dt.date(2024, 1, 16)


def registered(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _actions_sql(hours: int = 24) -> str:
    return f"""
WITH ev AS (
  SELECT *, CAST(nullif(regexp_extract(props, '"k" *: *(-?[0-9]+)', 1), '') AS BIGINT) AS k FROM events
), gaps AS (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev
), numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL {hours} HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM gaps
), actions AS (
  SELECT event_id AS action_id, CAST(ts AS DATE) AS date, user_id, CAST(user_id AS VARCHAR) || '_' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS session_id, k % 10 AS page_id, ts AS action_time, k, event_type,
         CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword,
         CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id, CASE WHEN event_type = 'click' THEN k END AS click_product_id,
         CAST(c_nationkey AS BIGINT) AS city_id
  FROM numbered LEFT JOIN customer ON c_custkey = user_id
), sess AS (
  SELECT session_id, min(user_id) AS user_id, min(action_time) AS start_time, max(action_time) AS end_time, count(*) AS step_length, date_sub('second', min(action_time), max(action_time)) AS visit_length,
         coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '') AS keywords, list(DISTINCT search_keyword) FILTER (WHERE search_keyword IS NOT NULL) AS kws,
         coalesce(string_agg(DISTINCT CAST(click_category_id AS VARCHAR), ',' ORDER BY CAST(click_category_id AS VARCHAR)), '') AS category_ids, list(DISTINCT click_category_id) FILTER (WHERE click_category_id IS NOT NULL) AS cats
  FROM actions GROUP BY session_id
), users AS (
  SELECT c_custkey AS user_id, CAST(c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS professional, n_name AS city, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
), su AS (
  SELECT s.*, age, professional, city, sex FROM sess s JOIN users u ON s.user_id = u.user_id
), filtered AS (
  SELECT * FROM su
  WHERE age BETWEEN 10 AND 50 AND professional IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE') AND sex = 'male'
    AND list_has_any(coalesce(kws, []), ['kw1', 'kw2', 'kw3', 'kw4']) AND list_has_any(coalesce(cats, []), [1, 2, 3, 4, 5, 6, 7, 8])
), cat AS (
  SELECT click_category_id AS category_id, 'click' AS kind FROM actions WHERE click_category_id IS NOT NULL
  UNION ALL
  SELECT unnest([k % 20, (k + 1) % 20]) AS category_id, CASE event_type WHEN 'signup' THEN 'order' ELSE 'pay' END AS kind FROM actions WHERE event_type IN ('signup', 'purchase') AND k IS NOT NULL
), cat_counts AS (
  SELECT category_id, count(*) FILTER (WHERE kind = 'click') AS click_count, count(*) FILTER (WHERE kind = 'order') AS order_count, count(*) FILTER (WHERE kind = 'pay') AS pay_count FROM cat GROUP BY category_id
), top_cat AS (
  SELECT * FROM cat_counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
), cat_sess AS (
  SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM actions WHERE click_category_id IN (SELECT category_id FROM top_cat) GROUP BY ALL
), top_sess AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS rank FROM cat_sess) WHERE rank <= 10
)"""


ACTIONS = _actions_sql()


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.actions(spark, sf_dir)


def _shown(sessions_: DataFrame, *more: str) -> DataFrame:
    """Sessions with their lists as text."""
    names = F.array_sort(F.transform("category_ids", lambda x: x.cast("string")))
    return sessions_.select("session_id", "user_id", F.array_join("keywords", ",").alias("keywords"), F.array_join(names, ",").alias("category_ids"), "start_time", "end_time", "visit_length", "step_length", *more)


SHOWN = "session_id, user_id, keywords, category_ids, start_time, end_time, visit_length, step_length"


@registered("date_scan", ACTIONS + "\nSELECT action_id, date, user_id, session_id, page_id, action_time FROM actions WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, sf_dir):
    return tables.between_dates(_actions(spark, sf_dir), FIRST, LAST).select("action_id", "date", "user_id", "session_id", "page_id", "action_time")


@registered("click_scan", ACTIONS + "\nSELECT city_id, click_product_id AS product_id FROM actions WHERE click_product_id IS NOT NULL AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(spark, sf_dir):
    return tables.between_dates(_actions(spark, sf_dir), FIRST, LAST).where("click_product_id IS NOT NULL").select("city_id", F.col("click_product_id").alias("product_id"))


@registered("user_scan", ACTIONS + "\nSELECT * FROM users")
def _(spark, sf_dir):
    return tables.users(spark, sf_dir).select("user_id", "age", "professional", "city", "sex")


@registered("session_agg", ACTIONS + f"\nSELECT {SHOWN} FROM sess")
def _(spark, sf_dir):
    return _shown(sessions.session_aggregate(_actions(spark, sf_dir)))


def _with_users(spark, sf_dir):
    return sessions.with_users(sessions.session_aggregate(_actions(spark, sf_dir)), tables.users(spark, sf_dir))


@registered("session_user_join", ACTIONS + f"\nSELECT {SHOWN}, age, professional, city, sex FROM su")
def _(spark, sf_dir):
    return _shown(_with_users(spark, sf_dir), "age", "professional", "city", "sex")


for _name, _params, _where in (
    ("between", TaskParams(start_age=18, end_age=35), "age BETWEEN 18 AND 35"),
    ("in", TaskParams(professionals=("BUILDING", "MACHINERY"), cities=("FRANCE", "CHINA", "NATION_1", "NATION_2")), "professional IN ('BUILDING', 'MACHINERY') AND city IN ('FRANCE', 'CHINA', 'NATION_1', 'NATION_2')"),
    ("equal", TaskParams(sex="female"), "sex = 'female'"),
    ("overlap", TaskParams(keywords=("kw1", "kw9"), category_ids=(3, 7)), "list_has_any(coalesce(kws, []), ['kw1', 'kw9']) AND list_has_any(coalesce(cats, []), [3, 7])"),
):
    registered(f"session_filter_{_name}", ACTIONS + f"\nSELECT session_id, user_id FROM su WHERE {_where}")(lambda spark, sf_dir, p=_params: sessions.session_filter(_with_users(spark, sf_dir), p).select("session_id", "user_id"))


def _filtered(spark, sf_dir):
    return sessions.session_filter(_with_users(spark, sf_dir), PARAMS)


@registered("session_filter_all", ACTIONS + f"\nSELECT {SHOWN} FROM filtered")
def _(spark, sf_dir):
    return _shown(_filtered(spark, sf_dir))


def _bucket_sql(share: bool) -> str:
    out = []
    for prefix, column, bounds in (("visit", "visit_length", sessions.VISIT_BUCKETS), ("step", "step_length", sessions.STEP_BUCKETS)):
        for name, low, high in bounds:
            count = f"count(*) FILTER (WHERE {column} " + (f"BETWEEN {low} AND {high})" if high else f">= {low})")
            out.append((f"((200 * {count} + nullif(count(*), 0)) // (2 * nullif(count(*), 0))) / 100.0" if share else count) + f' AS "{prefix}_{name}"')
    return _actions_sql(2) + "\nSELECT count(*) AS session_count, " + ", ".join(out) + " FROM sess"


def _short_sessions(spark, sf_dir):
    return sessions.session_aggregate(tables.actions(spark, sf_dir, 2))


@registered("session_stats", _bucket_sql(False))
def _(spark, sf_dir):
    return sessions.session_statistics(_short_sessions(spark, sf_dir))


@registered("session_ratios", _bucket_sql(True))
def _(spark, sf_dir):
    return sessions.session_ratios(sessions.session_statistics(_short_sessions(spark, sf_dir)))


@registered("session_hours", ACTIONS + "\nSELECT CAST(start_time AS DATE) AS date, hour(start_time) AS hour, count(*) AS sessions FROM sess GROUP BY ALL")
def _(spark, sf_dir):
    return sessions.hourly_counts(sessions.session_aggregate(_actions(spark, sf_dir)))


@registered("session_detail", ACTIONS + "\nSELECT action_id, session_id, page_id FROM actions WHERE session_id IN (SELECT session_id FROM filtered)")
def _(spark, sf_dir):
    return sessions.details(_actions(spark, sf_dir), _filtered(spark, sf_dir)).select("action_id", "session_id", "page_id")


SAMPLED = (
    ACTIONS
    + f""", keyed AS (
  SELECT session_id, CAST(start_time AS DATE) AS date, hour(start_time) AS hour, md5(session_id) AS h FROM sess
), hours AS (
  SELECT date, hour, count(*) AS in_hour FROM keyed GROUP BY ALL
), quotas AS (
  SELECT date, hour, least(CAST(floor(CAST(in_hour AS DOUBLE) / sum(in_hour) OVER (PARTITION BY date) * ({SAMPLE} // (SELECT count(DISTINCT date) FROM hours))) AS BIGINT), in_hour) AS quota FROM hours
), sampled AS (
  SELECT k.session_id, k.date, k.hour FROM (SELECT *, row_number() OVER (PARTITION BY date, hour ORDER BY h, session_id) AS pick FROM keyed) k JOIN quotas q ON k.date = q.date AND k.hour = q.hour WHERE pick <= quota
)"""
)


def _sampled(spark, sf_dir):
    return sessions.stratified_sample(sessions.session_aggregate(_actions(spark, sf_dir)), SAMPLE)


@registered("stratified_sample", SAMPLED + "\nSELECT session_id, date, hour FROM sampled")
def _(spark, sf_dir):
    return _sampled(spark, sf_dir).select("session_id", "date", "hour")


@registered("sample_detail", SAMPLED + "\nSELECT action_id, session_id FROM actions WHERE session_id IN (SELECT session_id FROM sampled)")
def _(spark, sf_dir):
    return sessions.details(_actions(spark, sf_dir), _sampled(spark, sf_dir)).select("action_id", "session_id")


@registered("distinct_categories", ACTIONS + "\nSELECT DISTINCT category_id FROM cat")
def _(spark, sf_dir):
    return topn.distinct_categories(_actions(spark, sf_dir))


@registered("category_counts", ACTIONS + "\nSELECT * FROM cat_counts")
def _(spark, sf_dir):
    return topn.category_counts(_actions(spark, sf_dir))


def _top(spark, sf_dir):
    return topn.top_categories(topn.category_counts(_actions(spark, sf_dir)))


@registered("top10_categories", ACTIONS + "\nSELECT * FROM top_cat")
def _(spark, sf_dir):
    return _top(spark, sf_dir)


@registered("category_session_counts", ACTIONS + "\nSELECT category_id, session_id, click_count FROM cat_sess")
def _(spark, sf_dir):
    return topn.category_session_counts(_actions(spark, sf_dir), _top(spark, sf_dir))


def _top_sessions(spark, sf_dir):
    return topn.top_sessions(topn.category_session_counts(_actions(spark, sf_dir), _top(spark, sf_dir)))


@registered("top_sessions_per_category", ACTIONS + "\nSELECT category_id, session_id, click_count, rank FROM top_sess")
def _(spark, sf_dir):
    return _top_sessions(spark, sf_dir)


@registered("top_session_detail", ACTIONS + "\nSELECT action_id, session_id FROM actions WHERE session_id IN (SELECT session_id FROM top_sess)")
def _(spark, sf_dir):
    return sessions.details(_actions(spark, sf_dir), _top_sessions(spark, sf_dir)).select("action_id", "session_id")


PAIRS = (
    ACTIONS
    + f""", pairs AS (
  SELECT * FROM (SELECT session_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY action_time, action_id) AS from_page, page_id AS to_page FROM actions) WHERE from_page IS NOT NULL
), flow AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(FLOW, FLOW[1:], strict=False), 1))}) AS t(position, from_page, to_page)
), splits AS (
  SELECT CAST(f.position AS BIGINT) AS position, CAST(f.from_page AS BIGINT) AS from_page, CAST(f.to_page AS BIGINT) AS to_page, (SELECT count(*) FROM pairs p WHERE p.from_page = f.from_page AND p.to_page = f.to_page) AS views FROM flow f
), begun AS (
  SELECT count(*) AS views FROM actions WHERE page_id = {FLOW[0]}
), rates AS (
  SELECT position, from_page, to_page, views, coalesce(lag(views) OVER (ORDER BY position), (SELECT views FROM begun)) AS before FROM splits
)"""
)
RATE = "((200 * views + nullif(before, 0)) // (2 * nullif(before, 0))) / 100.0"


@registered("page_splits", PAIRS + "\nSELECT position, from_page, to_page, views FROM splits")
def _(spark, sf_dir):
    return funnel.split_views(_actions(spark, sf_dir), FLOW)


@registered("page_pairs", PAIRS + "\nSELECT from_page, to_page, count(*) AS views FROM pairs GROUP BY ALL")
def _(spark, sf_dir):
    return funnel.page_pairs(_actions(spark, sf_dir)).groupBy("from_page", "to_page").agg(F.count("*").alias("views"))


@registered("start_page_pv", PAIRS + "\nSELECT views FROM begun")
def _(spark, sf_dir):
    return funnel.start_views(_actions(spark, sf_dir), FLOW)


@registered("page_convert_rate", PAIRS + f"\nSELECT position, from_page, to_page, views, {RATE} AS rate FROM rates")
def _(spark, sf_dir):
    return funnel.conversion(_actions(spark, sf_dir), FLOW)


@registered("page_rates_rendered", PAIRS + f"\nSELECT string_agg(from_page || '_' || to_page || '=' || printf('%.2f', {RATE}), '|' ORDER BY position) AS rates FROM rates")
def _(spark, sf_dir):
    return funnel.rendered(funnel.conversion(_actions(spark, sf_dir), FLOW))


AREAS = """
WITH clicks AS (
  SELECT CAST(c_nationkey AS BIGINT) AS city_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), city AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey
), placed AS (
  SELECT city_id, product_id, date, city_name, area FROM clicks JOIN city USING (city_id)
), counts AS (
  SELECT area, product_id, count(*) AS click_count, string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name) AS city_infos FROM placed GROUP BY area, product_id
), full_counts AS (
  SELECT area, product_id, click_count, city_infos, p_name AS product_name, CASE WHEN p_size % 2 = 0 THEN '自营' ELSE '第三方' END AS product_status FROM counts JOIN part ON p_partkey = product_id
)"""


def _placed(spark, sf_dir):
    return areas.with_cities(tables.product_clicks(spark, sf_dir), tables.cities(spark, sf_dir))


@registered("city_join", AREAS + "\nSELECT area, city_name, count(*) AS clicks FROM placed GROUP BY ALL")
def _(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("area", "city_name").agg(F.count("*").alias("clicks"))


@registered("area_product_counts", AREAS + "\nSELECT * FROM counts")
def _(spark, sf_dir):
    return areas.area_product_counts(_placed(spark, sf_dir))


@registered("area_full_product", AREAS + "\nSELECT * FROM full_counts")
def _(spark, sf_dir):
    return areas.with_products(areas.area_product_counts(_placed(spark, sf_dir)), tables.products(spark, sf_dir))


@registered(
    "area_top3_products",
    AREAS
    + """
SELECT area, CASE area WHEN 'ASIA' THEN 'A Level' WHEN 'EUROPE' THEN 'A Level' WHEN 'AMERICA' THEN 'B Level' WHEN 'AFRICA' THEN 'C Level' ELSE 'D Level' END AS area_level,
       product_id, click_count, city_infos, product_name, product_status, rank
FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS rank FROM full_counts) WHERE rank <= 3""",
)
def area_top3_products(spark, sf_dir):
    return jobs.area_top_products(tables.product_clicks(spark, sf_dir), tables.cities(spark, sf_dir), tables.products(spark, sf_dir), levels=REGION_LEVELS)


JOINED = "\nSELECT product_id, product_name, count(*) AS clicks FROM clicks JOIN (SELECT p_partkey AS product_id, p_name AS product_name FROM part) USING (product_id) GROUP BY ALL"


def _per_product(joined: DataFrame) -> DataFrame:
    return joined.groupBy("product_id", "product_name").agg(F.count("*").alias("clicks"))


@registered("broadcast_join", AREAS + JOINED)
def _(spark, sf_dir):
    return _per_product(skew.broadcast_join(tables.product_clicks(spark, sf_dir), tables.products(spark, sf_dir), "product_id"))


@registered("salted_join", AREAS + JOINED)
def _(spark, sf_dir):
    return _per_product(skew.salted_join(tables.product_clicks(spark, sf_dir), tables.products(spark, sf_dir), "product_id"))


@registered("skew_split_join", AREAS + JOINED)
def _(spark, sf_dir):
    return _per_product(skew.skew_split_join(tables.product_clicks(spark, sf_dir), tables.products(spark, sf_dir), "product_id"))


@registered("salted_count", AREAS + "\nSELECT product_id, count(*) AS clicks FROM clicks GROUP BY product_id")
def _(spark, sf_dir):
    return skew.salted_count(tables.product_clicks(spark, sf_dir), ["product_id"], name="clicks")


ADS = f"""
WITH clicks AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date, r_name AS province, n_name AS city, user_id, CAST(nullif(regexp_extract(props, '"k" *: *(-?[0-9]+)', 1), '') AS BIGINT) AS ad_id
  FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey WHERE event_type = 'click'
), user_counts AS (
  SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
), listed AS (
  SELECT DISTINCT user_id FROM user_counts WHERE click_count >= {BLACKLIST_AT}
), stat AS (
  SELECT date, province, city, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
), provinces AS (
  SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat GROUP BY ALL
), minutes AS (
  SELECT date_trunc('minute', ts) AS minute, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
), first_counts AS (
  SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks WHERE date < DATE '{SECOND_BATCH}' GROUP BY ALL
), first_listed AS (
  SELECT DISTINCT user_id FROM first_counts WHERE click_count >= {BLACKLIST_AT}
), second_counts AS (
  SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks WHERE date >= DATE '{SECOND_BATCH}' AND user_id NOT IN (SELECT user_id FROM first_listed) GROUP BY ALL
), all_counts AS (
  SELECT date, user_id, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM (SELECT * FROM first_counts UNION ALL SELECT * FROM second_counts) GROUP BY ALL
)"""


@registered("ad_log_parse", ADS + "\nSELECT ts, date, province, city, user_id, ad_id FROM (SELECT date_trunc('millisecond', ts) AS ts, date, replace(province, ' ', '-') AS province, replace(city, ' ', '-') AS city, user_id, ad_id FROM clicks) WHERE ad_id IS NOT NULL")
def _(spark, sf_dir):
    rows = tables.ad_clicks(spark, sf_dir)
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    lines = rows.select(F.concat_ws(" ", millis, F.replace("province", F.lit(" "), F.lit("-")), F.replace("city", F.lit(" "), F.lit("-")), F.col("user_id").cast("string"), F.col("ad_id").cast("string")).alias("value"))
    return ads.parsed(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered("user_ad_daily_clicks", ADS + "\nSELECT * FROM user_counts")
def _(spark, sf_dir):
    return ads.user_ad_counts(tables.ad_clicks(spark, sf_dir))


@registered("blacklist_generate", ADS + "\nSELECT user_id FROM listed")
def _(spark, sf_dir):
    return ads.blacklisted(ads.user_ad_counts(tables.ad_clicks(spark, sf_dir)), BLACKLIST_AT)


@registered("blacklist_filter", ADS + "\nSELECT event_id, user_id, ad_id FROM clicks WHERE user_id NOT IN (SELECT user_id FROM listed)")
def _(spark, sf_dir):
    clicks = tables.ad_clicks(spark, sf_dir)
    return ads.without_blacklisted(clicks, ads.blacklisted(ads.user_ad_counts(clicks), BLACKLIST_AT)).select("event_id", "user_id", "ad_id")


@registered("ad_stat_daily", ADS + "\nSELECT * FROM stat")
def _(spark, sf_dir):
    return ads.ad_counts(tables.ad_clicks(spark, sf_dir))


@registered("ad_province_counts", ADS + "\nSELECT * FROM provinces")
def _(spark, sf_dir):
    return ads.province_counts(ads.ad_counts(tables.ad_clicks(spark, sf_dir)))


@registered("province_top3_ads", ADS + "\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS rank FROM provinces) WHERE rank <= 3")
def _(spark, sf_dir):
    return ads.province_top(ads.ad_counts(tables.ad_clicks(spark, sf_dir)))


@registered("ad_minute_counts", ADS + "\nSELECT * FROM minutes")
def _(spark, sf_dir):
    return ads.minute_counts(tables.ad_clicks(spark, sf_dir)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@registered("ad_click_trend_minute", ADS + "\nSELECT * FROM minutes WHERE minute > (SELECT max(minute) FROM minutes) - INTERVAL 60 MINUTES")
def _(spark, sf_dir):
    return ads.trend(tables.ad_clicks(spark, sf_dir)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


COUNTS = "date date, user_id long, ad_id long, click_count long"


@registered("dynamic_blacklist", ADS + f"\nSELECT user_id FROM first_listed UNION SELECT user_id FROM all_counts WHERE click_count >= {BLACKLIST_AT}")
def _(spark, sf_dir):
    from clickloom.streaming.runner import AdStream

    clicks, stream = tables.ad_clicks(spark, sf_dir), AdStream(spark, shared_folder(spark), BLACKLIST_AT)
    for batch_id, batch in enumerate((clicks.where(F.col("date") < SECOND_BATCH), clicks.where(F.col("date") >= SECOND_BATCH))):
        stream.step(batch.withColumn("ts", F.col("ts").cast("timestamp")), batch_id)
    return stream.blacklist.read()


def _halves(spark, sf_dir):
    clicks = tables.ad_clicks(spark, sf_dir)
    return clicks.where("event_id % 2 = 0"), clicks.where("event_id % 2 = 1")


@registered("upsert_add", ADS + "\nSELECT * FROM user_counts")
def _(spark, sf_dir):
    out = VersionedTable(spark, shared_folder(spark), COUNTS)
    for batch_id, half in enumerate(_halves(spark, sf_dir)):
        for _again in range(2):
            out.add(ads.user_ad_counts(half), batch_id, ["date", "user_id", "ad_id"], "click_count")
    return out.read()


HALVES = """, a AS (
  SELECT date, province, ad_id, count(*) AS click_count FROM clicks WHERE event_id % 2 = 0 GROUP BY ALL
), b AS (
  SELECT date, province, ad_id, count(*) AS click_count FROM clicks WHERE event_id % 2 = 1 GROUP BY ALL
)"""
PROVINCES = "date date, province string, ad_id long, click_count long"


def _province_halves(spark, sf_dir):
    return [h.groupBy("date", "province", "ad_id").agg(F.count("*").alias("click_count")) for h in _halves(spark, sf_dir)]


@registered("upsert_replace", ADS + HALVES + "\nSELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.date = a.date AND b.province = a.province AND b.ad_id IS NOT DISTINCT FROM a.ad_id)")
def _(spark, sf_dir):
    out = VersionedTable(spark, shared_folder(spark), PROVINCES)
    for batch_id, half in enumerate(_province_halves(spark, sf_dir)):
        out.replace(half, batch_id, ["date", "province", "ad_id"])
    return out.read()


@registered("delete_insert", ADS + HALVES + "\nSELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.date = a.date AND b.province = a.province)")
def _(spark, sf_dir):
    out = VersionedTable(spark, shared_folder(spark), PROVINCES)
    for batch_id, half in enumerate(_province_halves(spark, sf_dir)):
        out.replace(half, batch_id, ["date", "province"])
    return out.read()


@registered(
    "scalar_strings",
    """
SELECT c_custkey, c_custkey || ':' || c_name AS joined, regexp_replace('7_' || c_mktsegment, '^[^_]*_', '') AS unsalted, 'v' || c_custkey AS field, 'a=1|b=new|c=' || c_mktsegment AS changed,
       lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS padded, trim(',' || c_mktsegment || ',', ',') AS trimmed, c_custkey % 3 = 0 AS empty, CAST(2 * (c_custkey % 100) + 1 AS BIGINT) AS id_sum
FROM customer""",
)
def _(spark, sf_dir):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    numbers = F.concat((key % 100).cast("string"), F.lit(","), (key % 100 + 1).cast("string"), F.lit(",x,"))
    text = F.concat(F.lit("a=1|b=v"), key.cast("string"), F.lit("|c="), segment)
    return tables.table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.concat_long_string(key, F.col("c_name"), ":").alias("joined"), scalars.remove_random_prefix(F.concat(F.lit("7_"), segment)).alias("unsalted"),
        scalars.field_of(text, "b").alias("field"), scalars.with_field(text, "b", F.lit("new")).alias("changed"), scalars.two_digits(key % 60).alias("padded"),
        scalars.trim_comma(F.concat(F.lit(","), segment, F.lit(","))).alias("trimmed"), scalars.is_empty(F.when(key % 3 != 0, segment)).alias("empty"), F.aggregate(scalars.ids(numbers), F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
    )


@registered(
    "scalar_dates",
    """
SELECT event_id, strftime(ts, '%Y-%m-%d_%H') AS date_hour, strftime(ts, '%Y%m%d%H%M') AS minute_key, CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS day, date_trunc('second', ts) AS parsed,
       date_sub('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS seconds, ((200 * (event_id % 7) + nullif(event_id % 5, 0)) // (2 * nullif(event_id % 5, 0))) / 100.0 AS rate
FROM events""",
)
def _(spark, sf_dir):
    ts = F.col("ts")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd "), F.hour(ts).cast("string"), F.date_format(ts, ":mm:ss"))
    return tables.table(spark, sf_dir, "events").select(
        "event_id", scalars.date_hour(ts).alias("date_hour"), scalars.minute_key(ts).alias("minute_key"), scalars.parse_date(F.date_format(ts, "yyyy-MM-dd")).alias("day"), scalars.parse_time(text).cast("timestamp_ntz").alias("parsed"),
        scalars.seconds_between(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"), ts).alias("seconds"), scalars.ratio(F.col("event_id") % 7, F.col("event_id") % 5).alias("rate"),
    )


@registered("json_field", "SELECT p_partkey AS product_id, CAST(p_size % 2 AS VARCHAR) AS status, CASE WHEN p_size % 2 = 0 THEN '自营' ELSE '第三方' END AS product_status, CAST(NULL AS VARCHAR) AS missing, p_partkey || '-' || p_name AS named FROM part")
def _(spark, sf_dir):
    scalars.register(spark)
    info = F.col("extend_info")
    return tables.products(spark, sf_dir).select("product_id", F.expr("json_field(extend_info, 'product_status')").alias("status"), areas.product_status(info).alias("product_status"), scalars.json_field(info, "none").alias("missing"), F.expr("concat_long_string(product_id, product_name, '-')").alias("named"))


@registered("row_counts", "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM customer) AS users")
def _(spark, sf_dir):
    count = lambda name: tables.table(spark, sf_dir, name).agg(F.count("*").alias("n"))
    one = count("events").select(F.col("n").alias("events"))
    return one.crossJoin(F.broadcast(count("customer").select(F.col("n").alias("users"))))  # a row each


@registered("session_job", ACTIONS + "\nSELECT category_id, click_count, order_count, pay_count FROM (SELECT category_id, count(*) FILTER (WHERE kind = 'click') AS click_count, count(*) FILTER (WHERE kind = 'order') AS order_count, count(*) FILTER (WHERE kind = 'pay') AS pay_count FROM (SELECT click_category_id AS category_id, 'click' AS kind FROM actions WHERE click_category_id IS NOT NULL AND session_id IN (SELECT session_id FROM filtered) UNION ALL SELECT unnest([k % 20, (k + 1) % 20]), CASE event_type WHEN 'signup' THEN 'order' ELSE 'pay' END FROM actions WHERE event_type IN ('signup', 'purchase') AND k IS NOT NULL AND session_id IN (SELECT session_id FROM filtered)) GROUP BY category_id) ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10")
def _(spark, sf_dir):
    return jobs.session_analysis(_actions(spark, sf_dir), tables.users(spark, sf_dir), PARAMS).top_categories


TASK = '{"startDate": ["2024-01-05"], "endDate": ["2024-01-20"], "startAge": ["10"], "endAge": ["50"], "sex": ["male"], "targetPageFlow": ["3,5,2,4,6"]}'
TASK_ID = 7
#: The parts of a session that fall in the task's dates are a session of their own.
OWN = (
    ACTIONS.replace(") , sess AS", "), sess AS").replace("FROM actions GROUP BY session_id", "FROM actions WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY session_id")
    + """, mine AS (
  SELECT * FROM su WHERE age BETWEEN 10 AND 50 AND sex = 'male'
), own_actions AS (
  SELECT * FROM actions WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND session_id IN (SELECT session_id FROM mine)
), own_cat AS (
  SELECT click_category_id AS category_id, 'click' AS kind FROM own_actions WHERE click_category_id IS NOT NULL
  UNION ALL
  SELECT unnest([k % 20, (k + 1) % 20]) AS category_id, CASE event_type WHEN 'signup' THEN 'order' ELSE 'pay' END AS kind FROM own_actions WHERE event_type IN ('signup', 'purchase') AND k IS NOT NULL
), own_top AS (
  SELECT category_id, count(*) FILTER (WHERE kind = 'click') AS click_count, count(*) FILTER (WHERE kind = 'order') AS order_count, count(*) FILTER (WHERE kind = 'pay') AS pay_count FROM own_cat GROUP BY category_id
  ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
), own_top_sess AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS rank
    FROM (SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM own_actions WHERE click_category_id IN (SELECT category_id FROM own_top) GROUP BY ALL)
  ) WHERE rank <= 10
), keyed AS (
  SELECT *, CAST(start_time AS DATE) AS day, hour(start_time) AS hour, md5(session_id) AS h FROM mine
), hours AS (
  SELECT day, hour, count(*) AS in_hour FROM keyed GROUP BY ALL
), quotas AS (
  SELECT day, hour, least(CAST(floor(CAST(in_hour AS DOUBLE) / sum(in_hour) OVER (PARTITION BY day) * (100 // (SELECT count(DISTINCT day) FROM hours))) AS BIGINT), in_hour) AS quota FROM hours
), picked AS (
  SELECT k.* FROM (SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY h, session_id) AS pick FROM keyed) k JOIN quotas q ON k.day = q.day AND k.hour = q.hour WHERE pick <= quota
)"""
)


def _task_sql() -> dict[str, str]:
    ratios = []
    for prefix, column, bounds in (("visit_length", "visit_length", sessions.VISIT_BUCKETS), ("step_length", "step_length", sessions.STEP_BUCKETS)):
        for name, low, high in bounds:
            count = f"count(*) FILTER (WHERE {column} " + (f"BETWEEN {low} AND {high})" if high else f">= {low})")
            ratios.append(f'((200 * {count} + nullif(count(*), 0)) // (2 * nullif(count(*), 0))) / 100.0 AS "{prefix}_{name}_ratio"')
    lists = ", ".join(f"CASE WHEN event_type = '{kind}' THEN {value} END AS {name}" for kind, names in (("signup", "order"), ("purchase", "pay")) for name, value in ((f"{names}_category_ids", "(k % 20) || ',' || ((k + 1) % 20)"), (f"{names}_product_ids", "CAST(k AS VARCHAR)")))
    detail = f"SELECT CAST({TASK_ID} AS BIGINT) AS taskid, user_id AS userid, session_id AS sessionid, page_id AS pageid, action_time, search_keyword, click_category_id, click_product_id, {lists} FROM actions WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND session_id IN "
    task = f"SELECT CAST({TASK_ID} AS BIGINT) AS taskid, "
    return {
        "session_aggr_stat": OWN + f"\n{task}count(*) AS session_count, {', '.join(ratios)} FROM mine",
        "session_random_extract": OWN + f"\n{task}session_id AS sessionid, start_time, keywords AS search_keywords, coalesce(array_to_string(list_sort(cats), ','), '') AS click_category_ids FROM picked",
        "session_detail": OWN + f"\n{detail}(SELECT session_id FROM picked) UNION ALL {detail}(SELECT session_id FROM own_top_sess)",
        "top10_category": OWN + f"\n{task}category_id AS categoryid, click_count, order_count, pay_count FROM own_top",
        "top10_category_session": OWN + f"\n{task}category_id AS categoryid, session_id AS sessionid, click_count FROM own_top_sess",
        "page_split_convert_rate": PAIRS.replace("FROM actions)", "FROM actions WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')").replace(f"FROM actions WHERE page_id = {FLOW[0]}", f"FROM actions WHERE page_id = {FLOW[0]} AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
        + f"\n{task}string_agg(from_page || '_' || to_page || '=' || printf('%.2f', {RATE}), '|' ORDER BY position) AS convert_rate FROM rates",
        "area_top3_product": AREAS.replace("JOIN customer ON o_custkey = c_custkey", "JOIN customer ON o_custkey = c_custkey WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1990-01-01' AND DATE '2100-01-01'")
        + f"\n{task}area, CASE area WHEN 'ASIA' THEN 'A Level' WHEN 'EUROPE' THEN 'A Level' WHEN 'AMERICA' THEN 'B Level' WHEN 'AFRICA' THEN 'C Level' ELSE 'D Level' END AS area_level, product_id, city_infos, click_count, product_name, product_status FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS rank FROM full_counts) WHERE rank <= 3",
    }


def _task_tables(spark, sf_dir, name: str) -> DataFrame:
    """The task's row is looked up, its job run, and one of its tables returned."""
    tasks = spark.createDataFrame([(TASK_ID, TASK)], "task_id long, params string")
    p = find_task(tasks, TASK_ID)
    if name == "page_split_convert_rate":
        return task_tables.page_tables(_actions(spark, sf_dir), p, TASK_ID)[name]
    if name == "area_top3_product":
        wide = replace(p, start_date=dt.date(1990, 1, 1), end_date=dt.date(2100, 1, 1))
        return task_tables.area_tables(tables.product_clicks(spark, sf_dir), tables.cities(spark, sf_dir), tables.products(spark, sf_dir), wide, TASK_ID, levels=REGION_LEVELS)[name]
    return task_tables.session_task(_actions(spark, sf_dir), tables.users(spark, sf_dir), p, TASK_ID)[name]


for _name, _sql in _task_sql().items():
    registered(f"task_{_name}", _sql)(lambda spark, sf_dir, name=_name: _task_tables(spark, sf_dir, name))


@registered("upsert_replace_nulls", ADS + HALVES.replace("ad_id, count(*)", "CASE WHEN ad_id % 3 = 0 THEN NULL ELSE ad_id END AS ad_id, count(*)") + "\nSELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.date = a.date AND b.province = a.province AND b.ad_id IS NOT DISTINCT FROM a.ad_id)")
def _(spark, sf_dir):
    out = VersionedTable(spark, shared_folder(spark), PROVINCES)
    for batch_id, half in enumerate(_halves(spark, sf_dir)):
        rows = half.withColumn("ad_id", F.when(F.col("ad_id") % 3 != 0, F.col("ad_id"))).groupBy("date", "province", "ad_id").agg(F.count("*").alias("click_count"))
        for _again in range(2):
            out.replace(rows, batch_id, ["date", "province", "ad_id"])
    return out.read()


@registered(
    "trend_sliding",
    ADS
    + """, ends AS (
  SELECT ad_id, unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 60 MINUTES, INTERVAL 1 MINUTE)) AS window_end FROM clicks
)
SELECT window_end - INTERVAL 60 MINUTES AS window_start, window_end, ad_id, count(*) AS click_count FROM ends GROUP BY window_end, ad_id""",
)
def _(spark, sf_dir):
    clicks = tables.ad_clicks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return ads.sliding_counts(clicks, "60 minutes", "1 minute").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "ad_id", "click_count")


@registered(
    "scalar_edges",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'v' || event_id END AS field, 'a=1|b=new|b=2' AS changed, CAST(event_id AS VARCHAR) AS dotted,
       floor((event_id % 1000) / 8.0 * 100 + 0.5) / 100 AS rounded, event_id % 2 = 0 AS earlier, DATE '2024-02-03' AS key_day
FROM events""",
)
def _(spark, sf_dir):
    scalars.register(spark)
    n = F.col("event_id").cast("string")
    # a first field that is none, one with two signs, one that counts, and one that comes too late
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b=|b=x="), n, F.lit("=|a=1"))).otherwise(F.concat(F.lit("a=1|a=2|b=|b=v"), n, F.lit("|b=9")))
    odd = F.concat(F.lit('{"a.b":'), n, F.lit(',"a":{"b":0}}'))
    return tables.table(spark, sf_dir, "events").withColumn("js", odd).select(
        "event_id", scalars.field_of(text, "b").alias("field"), scalars.with_field(F.lit("a=1|b=1|b=2||"), "b", F.lit("new")).alias("changed"), F.expr("json_field(js, 'a.b')").alias("dotted"),
        scalars.format_double(F.col("event_id") % 1000 / 8.0, 2).alias("rounded"), scalars.is_before(F.lit("2024-01-01 1:00:00"), F.when(F.col("event_id") % 2 == 0, "2024-01-01 02:00:00").otherwise("none")).alias("earlier"), scalars.date_key(F.lit("20240203")).alias("key_day"),
    )


@registered("group_concat_distinct", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(spark, sf_dir):
    tables.table(spark, sf_dir, "nation").createOrReplaceTempView("own_nation")
    return scalars.sql(spark, "SELECT n_regionkey, group_concat_distinct(concat(n_name, '')) AS names FROM own_nation GROUP BY n_regionkey")
