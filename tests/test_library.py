"""Hand-made fixtures for edges that the driver's tables don't have."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clickloom.functions import scalars
from clickloom.operators import areas, funnel, sessions, skew, topn
from clickloom.params import TaskParams, find_task
from clickloom.plans import jobs, task_tables
from clickloom.sources import tables
from clickloom.streaming import ads
from clickloom.streaming.runner import AdStream, file_lines, running_counts
from clickloom.streaming.sinks import VersionedTable, shared_folder, upsert_jdbc, write_jdbc, write_task_rows

START = dt.datetime(2024, 1, 1, 10)
ACTION = "action_id long, date date, user_id long, session_id string, page_id long, action_time timestamp_ntz, search_keyword string, click_category_id long, click_product_id long, order_category_ids array<long>, pay_category_ids array<long>, city_id long"


def action(i, session, seconds=0, page=1, keyword=None, category=None, orders=None, pays=None, user=1, start=START):
    return (i, start.date(), user, session, page, start + dt.timedelta(seconds=seconds), keyword, category, category, orders, pays, 1)


def test_visit_and_step_bucket_edges(spark):
    lengths = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    rows = spark.createDataFrame([(n,) for n in lengths], "n long")
    got = [r.b for r in rows.select(sessions.bucket(F.col("n"), sessions.VISIT_BUCKETS).alias("b")).collect()]
    assert got == [None, "1s_3s", "1s_3s", "4s_6s", "4s_6s", "7s_9s", "7s_9s", "10s_30s", "10s_30s", "30s_60s", "30s_60s", "1m_3m", "1m_3m", "3m_10m", "3m_10m", "10m_30m", "10m_30m", "30m"]
    rows = spark.createDataFrame([(n,) for n in [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61]], "n long")
    assert [r.b for r in rows.select(sessions.bucket(F.col("n"), sessions.STEP_BUCKETS).alias("b")).collect()] == ["1_3", "1_3", "4_6", "4_6", "7_9", "7_9", "10_30", "10_30", "30_60", "30_60", "60"]


def test_session_lists_are_exact_sets_and_lone_actions_last_zero(spark):
    rows = [action(1, "a", 0, keyword="long word", category=12), action(2, "a", 61, keyword="word", category=1), action(3, "a", 5, keyword="word"), action(4, "b")]
    got = {r.session_id: r for r in sessions.session_aggregate(spark.createDataFrame(rows, ACTION)).collect()}
    assert (got["a"].keywords, got["a"].category_ids, got["a"].visit_length, got["a"].step_length) == (["long word", "word"], [1, 12], 61, 3)
    assert (got["b"].keywords, got["b"].visit_length) == ([], 0)
    stats = sessions.session_statistics(spark.createDataFrame([(0, 1), (61, 3)], "visit_length long, step_length long"))
    row = stats.first()
    assert row.session_count == 2 and sum(v for k, v in row.asDict().items() if k.startswith("visit")) == 1 and sum(v for k, v in row.asDict().items() if k.startswith("step")) == 2
    assert sessions.session_ratios(stats).first()["visit_1m_3m"] == 0.5
    empty = sessions.session_ratios(sessions.session_statistics(spark.createDataFrame([], "visit_length long, step_length long"))).first()
    assert empty.session_count == 0 and empty["step_1_3"] is None


def test_filter_semantics(spark):
    rows = spark.createDataFrame([("a", 20, "x", "c1", "male", ["k"], [1]), ("b", None, None, None, None, [], None), ("c", 30, "y", "c2", "female", ["kk"], [11])], "session_id string, age int, professional string, city string, sex string, keywords array<string>, category_ids array<long>")
    got = lambda **p: sorted(r.session_id for r in sessions.session_filter(rows, TaskParams(**p)).collect())
    assert got() == ["a", "b", "c"] and got(start_age=25) == ["a", "b", "c"] and got(start_age=20, end_age=29) == ["a"]
    assert got(sex="female") == ["c"] and got(keywords=("k",)) == ["a"] and got(category_ids=(1,)) == ["a"] and got(professionals=("x", "y"), cities=("c2",)) == ["c"]


def test_orders_and_payments_count_without_a_click(spark):
    rows = [action(1, "a", category=5), action(2, "a", orders=[5, 7]), action(3, "b", pays=[7, None, 9])]
    got = {tuple(r) for r in topn.category_counts(spark.createDataFrame(rows, ACTION)).collect()}
    assert got == {(5, 1, 1, 0), (7, 0, 1, 1), (9, 0, 0, 1)}


def test_ties_in_tops_go_to_the_smaller_id(spark):
    counts = spark.createDataFrame([(3, 1, 0, 0), (1, 1, 0, 0), (2, 2**40, 0, 0)], "category_id long, click_count long, order_count long, pay_count long")
    assert [r.category_id for r in topn.top_categories(counts, 2).collect()] == [2, 1]
    by = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 2)], "category_id long, session_id string, click_count long")
    assert sorted((r.session_id, r.rank) for r in topn.top_sessions(by, 2).collect()) == [("a", 1), ("b", 2)]


def test_funnel_with_a_repeated_pair_and_empty_steps(spark):
    pages = [1, 2, 1, 2, 9]
    df = spark.createDataFrame([action(i, "s", i, page=p) for i, p in enumerate(pages)], ACTION)
    got = [(r.position, r.views, r.rate) for r in funnel.conversion(df, (1, 2, 1, 2, 3, 4)).orderBy("position").collect()]
    assert got == [(1, 2, 1.0), (2, 1, 0.5), (3, 2, 2.0), (4, 0, 0.0), (5, 0, None)]
    assert [r.rate for r in funnel.conversion(df, (7, 1)).collect()] == [None]


def test_sample_quotas(spark):
    rows = [(f"{d}-{h}-{i}", dt.datetime(2024, 1, d, h)) for d in (1, 2) for h, n in ((1, 30), (2, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, start_time timestamp_ntz")
    got = {(r.date.day, r.hour): r.n for r in sessions.stratified_sample(df, 20).groupBy("date", "hour").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 1): 7, (1, 2): 2, (2, 1): 7, (2, 2): 2}
    many = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(101)], "session_id string, start_time timestamp_ntz")
    assert sessions.stratified_sample(many, 100).count() == 0 and sessions.stratified_sample(many, 10**6).count() == 101


def test_areas(spark):
    clicks = spark.createDataFrame([(11, 1), (1, 1), (1, 1), (1, 2), (99, 1), (1, 77)], "city_id long, product_id long")
    cities = spark.createDataFrame([(11, "x", "华北"), (1, "x", "华北")], "city_id long, city_name string, area string")
    products = spark.createDataFrame([(1, "p", '{"product_status":0}'), (2, "q", None), (3, "r", "{")], "product_id long, product_name string, extend_info string")
    got = sorted(map(tuple, jobs.area_top_products(clicks, cities, products).collect()))
    assert got == [("华北", "A Level", 1, 3, "11:x,1:x", "p", "自营", 1), ("华北", "A Level", 2, 1, "1:x", "q", "第三方", 2)]
    infos = spark.createDataFrame([('{"product_status":1}',), ('{"product_status":"x"}',), ("{}",), ("bad",), (None,)], "j string")
    assert {r.s for r in infos.select(areas.product_status(F.col("j")).alias("s")).collect()} == {"第三方"}


def test_salted_forms_equal_plain_ones(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    for joined in (skew.salted_join(left, right, "k", 4), skew.skew_split_join(left, right, "k", 4), skew.broadcast_join(left, right, "k"), skew.broadcast_join(left, right, "k", rows=3)):
        assert sorted(map(tuple, joined.select("k", "id", "v").collect())) == plain
    assert sorted(map(tuple, skew.salted_count(left, ["k"]).collect())) == sorted(map(tuple, left.groupBy("k").count().collect()))
    assert skew.heavy_keys(left, "k").first().k == 7


def test_salted_copies_are_never_broadcast(spark):
    left, right = spark.range(5000).select((F.col("id") % 50).alias("k"), "id"), spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = skew.salted_join(left, right, "k")
    assert joined.count() == 4000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parameters_and_tasks(spark):
    text = json.dumps({"startDate": ["2024-01-02"], "startAge": ["10"], "endAge": ["50"], "professionals": ["a,b"], "keywords": [], "targetPageFlow": ["3,5,2"], "sex": ["male"]})
    tasks = spark.createDataFrame([(1, text)], "task_id long, params string")
    p = find_task(tasks, 1)
    assert p == TaskParams(start_date=dt.date(2024, 1, 2), start_age=10, end_age=50, professionals=("a", "b"), page_flow=(3, 5, 2), sex="male")
    with pytest.raises(LookupError):
        find_task(tasks, 2)


def test_scalars(spark):
    one = spark.createDataFrame([("2024-01-01 5:03:07", "a=1|b=|c=x=y", ",1,2,", "1,,x,3,")], "t string, kv string, c string, l string")
    row = one.select(
        scalars.parse_time(F.col("t")).cast("string").alias("time"), scalars.field_of(F.col("kv"), "a").alias("a"), scalars.field_of(F.col("kv"), "b").alias("b"), scalars.field_of(F.col("kv"), "z").alias("z"), scalars.trim_comma(F.col("c")).alias("c"), scalars.ids(F.col("l")).alias("ids"),
        scalars.parse_time(F.lit("x")).alias("bad"), scalars.remove_random_prefix(F.lit("3_a_b")).alias("rest"), scalars.concat_long_string(F.lit(None).cast("long"), F.lit("n"), ":").alias("null"), scalars.ratio(F.lit(1), F.lit(8)).alias("half_up"),
        scalars.random_prefix(F.lit("k"), 3, 1).alias("salted"),
    ).first()
    assert (row.time, row.a, row.b, row.z, row.c, row.ids, row.bad, row.rest, row.null, row.half_up) == ("2024-01-01 05:03:07", "1", None, None, "1,2", [1, 3], None, "a_b", "null:n", 0.13)
    assert row.salted in {"0_k", "1_k", "2_k"}


def test_sources_and_batch_sinks(spark, tmp_path):
    rows = tables.in_memory(spark, [(1, "x")], "id long, name string")
    url = "jdbc:derby:memory:loom;create=true"
    write_jdbc(rows, url, "t", "overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert [tuple(r) for r in tables.jdbc_table(spark, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").collect()] == [(1, "x")]
    rows.createOrReplaceTempView("own_rows")
    assert tables.catalog_table(spark, "own_rows").count() == 1
    write_task_rows(rows, str(tmp_path / "out"), 5)
    assert spark.read.parquet(str(tmp_path / "out")).first().task_id == 5
    grouped = skew.materialised_sessions(spark.createDataFrame([action(2, "a", 5), action(1, "a", 0)], ACTION), str(tmp_path / "s"))
    assert [x.action_id for x in grouped.collect()] == [1, 2]


def test_versioned_table(spark):
    table = VersionedTable(spark, shared_folder(spark), "k long, v long")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v long")
    assert table.read().count() == 0 and table.add(rows((1, 1), (2, 1)), 0, ["k"], "v") and not table.add(rows((1, 1)), 0, ["k"], "v")
    assert table.add(rows((1, 5), (3, 1)), 1, ["k"], "v") and table.replace(rows((2, 9), (4, 4)), 2, ["k"]) and not table.replace(rows((2, 1)), 1, ["k"])
    assert sorted(map(tuple, table.read().collect())) == [(1, 6), (2, 9), (3, 1), (4, 4)]
    assert table.append(rows((4, 0), (5, 5)), 3, ["k"]) and table.read().count() == 5 and table.batches() == [2, 3]


def line(ts, user, ad=1, province="P_1", city="C"):
    return f"{int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)} {province} {city} {user} {ad}"


def test_stream_with_blacklist_feedback(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    noon = dt.datetime(2024, 1, 1, 12)
    batches = [[(7, 99), (8, 101), (9, 3)], [(7, 1), (8, 50), (9, 3)], [(7, 5), (9, 2)]]
    stream = AdStream(spark, shared_folder(spark))
    for k, batch in enumerate(batches):
        (source / f"{k}.txt").write_text("\n".join(line(noon + dt.timedelta(minutes=k), u) for u, n in batch for _ in range(n)) + "\nbad line\n")
        stream.start(file_lines(spark, str(source), 1), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    counts = {r.user_id: r.click_count for r in stream.user_counts.read().collect()}
    assert counts == {7: 100, 8: 101, 9: 8}  # the click that reaches the threshold counts, later ones don't
    assert sorted(r.user_id for r in stream.blacklist.read().collect()) == [7, 8]
    assert [r.click_count for r in stream.stat.read().collect()] == [209] and [r["rank"] for r in stream.tops.read().collect()] == [1]
    assert sorted(r.click_count for r in stream.trend().collect()) == [7, 54, 203]
    (own,) = {d.query for d in stream.user_counts._log()[1]}
    before = stream.user_counts.batches(own)
    stream.step(ads.parsed(spark.read.text(str(source / "2.txt"))), 2, own)
    assert stream.user_counts.batches(own) == before == [0, 1, 2]
    # another checkpoint is another query: its batches begin at 0 and count
    more = tmp_path / "more"
    more.mkdir()
    (more / "0.txt").write_text("\n".join(line(noon, 9) for _ in range(5)))
    stream.start(file_lines(spark, str(more), 1), str(tmp_path / "other"), once=True).awaitTermination()
    assert {r.user_id: r.click_count for r in stream.user_counts.read().collect()} == {7: 100, 8: 101, 9: 13}
    assert sum(r.click_count for r in stream.minutes.read().collect()) == 269


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    rows = [line(dt.datetime(2024, 1, 1 + i % 3, 5, i % 60), i % 5, i % 4) for i in range(200)]
    for k in range(4):
        (source / f"{k}.txt").write_text("\n".join(rows[k::4]))
    query = running_counts(ads.parsed(file_lines(spark, str(source), 1))).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    want = ads.ad_counts(ads.parsed(spark.read.text(str(source))))
    key = lambda df: sorted(map(tuple, df.select("date", "province", "city", "ad_id", "click_count").collect()))
    assert key(spark.table("running")) == key(want)


def test_table_of_many_batches_with_nulls(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "a long, b long, v long")
    table = VersionedTable(spark, shared_folder(spark), "a long, b long, v long", fold=3)
    for k in range(8):
        assert table.replace(rows((1, None, k), (None, None, k), (k, 1, k)), k, ["a", "b"])
    assert not table.replace(rows((1, None, 99)), 2, ["a", "b"]) and not table.replace(rows((1, None, 99)), 7, ["a", "b"])
    want = sorted([(1, None, 7), (None, None, 7), *((k, 1, k) for k in range(8))], key=repr)
    assert sorted(map(tuple, table.read().collect()), key=repr) == want and len(table._log()[1]) <= 3
    assert table.replace(rows((5, 5, 5)), 0, ["a", "b"], query="other") and table.read().count() == len(want) + 1
    assert table.read(("other", 0)).count() == len(want)
    keyed = VersionedTable(spark, shared_folder(spark), "a long, b long, v long", fold=2)
    for k in range(5):
        keyed.append(rows((None, k % 2, k), (None, k % 2, 50 + k)), k, ["a", "b"])
    assert {(r.a, r.b) for r in keyed.read().collect()} == {(None, 0), (None, 1)} and keyed.read().count() == 2
    assert keyed.append(rows((1, 1, 1), (1, 1, 1)), 9) and keyed.read().count() == 4


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_upserts(spark):
    url, typed = "jdbc:derby:memory:upserts;create=true", {**DERBY, "createTableColumnTypes": "day VARCHAR(32)"}
    rows = lambda *x: spark.createDataFrame(list(x), "day string, ad long, clicks long")
    read = lambda: sorted(map(tuple, tables.jdbc_table(spark, url, "ad_stat", **DERBY).collect()), key=repr)
    write_jdbc(rows(("d", 1, 5), ("d", None, 1)), url, "ad_stat", "overwrite", **typed)
    upsert_jdbc(rows(("d", 1, 2), ("e", 1, 4), ("d", None, 3)), url, "ad_stat", ["day", "ad"], "clicks", **typed)
    assert read() == sorted([("d", 1, 7), ("d", None, 4), ("e", 1, 4)], key=repr)
    upsert_jdbc(rows(("d", 1, 1), ("f", 9, 9)), url, "ad_stat", ["day", "ad"], **typed)
    assert read() == sorted([("d", 1, 1), ("d", None, 4), ("e", 1, 4), ("f", 9, 9)], key=repr)
    upsert_jdbc(rows(("d", 8, 8)), url, "ad_stat", ["day"], **typed)
    assert read() == sorted([("d", 8, 8), ("e", 1, 4), ("f", 9, 9)], key=repr)


def test_task_tables_in_files_and_a_database(spark, tmp_path):
    made = tables.generated(spark, users=20, sessions=60, products=10, heavy=0.3)
    p = TaskParams(start_age=0, end_age=59, page_flow=(1, 2, 3))
    cities = spark.createDataFrame([(i, f"c{i}", f"area{i % 2}") for i in range(10)], "city_id long, city_name string, area string")
    clicks = made["user_visit_action"].select("city_id", made["user_visit_action"]["click_product_id"].alias("product_id"), "date")
    results = task_tables.session_task(made["user_visit_action"], made["user_info"], p, 3) | task_tables.page_tables(made["user_visit_action"], p, 3) | task_tables.area_tables(clicks, cities, made["product_info"], p, 3)
    assert set(results) == set(task_tables.TABLES)
    for _again in range(2):
        task_tables.write_tables(results, folder=str(tmp_path))
    task_tables.write_tables(results, url="jdbc:derby:memory:tasks;create=true", **DERBY)
    for name, schema in task_tables.TABLES.items():
        n = spark.read.parquet(f"{tmp_path}/{name}").count()
        stored = tables.jdbc_table(spark, "jdbc:derby:memory:tasks", name, **DERBY)
        assert n == stored.count() > 0 and [c.lower() for c in stored.columns] == [x.split(" ")[0] for x in schema.split(", ")]


def test_generated_tables_are_skewed_and_repeatable(spark):
    one, two = (tables.generated(spark, sessions=40, heavy=0.5)["user_visit_action"] for _ in range(2))
    counts = sorted((r["count"] for r in one.groupBy("session_id").count().collect()), reverse=True)
    assert one.exceptAll(two).isEmpty() and counts[0] > 10 * counts[1] and len(counts) == 40
    assert tables.as_view(spark, [(1, "x")], "id long, name string", "few_rows").count() == spark.table("few_rows").count() == 1


def test_sliding_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    rows = [line(dt.datetime(2024, 1, 1, 5, i % 60, i % 50), i, i % 3) for i in range(60)]
    for k in range(3):
        (source / f"{k}.txt").write_text("\n".join(rows[k::3]))
    clicks = ads.parsed(file_lines(spark, str(source), 1)).withWatermark("ts", "2 hours")
    ads.sliding_counts(clicks, "30 minutes", "10 minutes").writeStream.outputMode("append").format("memory").queryName("sliding").trigger(availableNow=True).start().awaitTermination()
    whole = {tuple(r) for r in ads.sliding_counts(ads.parsed(spark.read.text(str(source))), "30 minutes", "10 minutes").collect()}
    brute = {}
    for r in ads.parsed(spark.read.text(str(source))).collect():
        for k in range(3):
            start = r.ts.replace(minute=r.ts.minute // 10 * 10, second=0, microsecond=0) - dt.timedelta(minutes=10 * k)
            brute[start, r.ad_id] = brute.get((start, r.ad_id), 0) + 1
    assert {(r[0], r[2]): r[3] for r in whole} == brute and set(map(tuple, spark.table("sliding").collect())) <= whole


def test_exact_rounding(spark):
    import decimal
    import random

    rng = random.Random(2)
    values = [1.005, 2.675, 0.125, 0.375, -0.125, 1e17, 0.0, 5e-324, 0.285, 1.115, 1234567.885] + [rng.randrange(10**7) / 1000 + 0.005 * rng.randrange(2) for _ in range(2000)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(scalars.format_double(F.col("v"), 2).alias("x")).collect()]
    assert got == [float(decimal.Decimal(v).quantize(decimal.Decimal("0.01"), rounding=decimal.ROUND_HALF_UP)) for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(scalars.format_double(F.col("v"), 2).alias("x"))
    assert [r.x for r in odd.collect()] == [None] * 3


def test_scans_of_shared_plans(spark):
    from tests.conftest import DATA

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id")

    actions = tables.actions(spark, f"{DATA}/sf0.001")
    assert scans(topn.category_counts(actions)) == 1 and scans(sessions.stratified_sample(sessions.session_aggregate(actions))) == 2
