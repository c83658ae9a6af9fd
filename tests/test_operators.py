from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from revlens.functions import columns as X
from revlens.operators import topk
from revlens.operators.calendar import all_bounds, day_bounds, each_day, fill_days, on_every_day
from revlens.operators.latest import latest_per_key
from revlens.operators.reshape import melt, stack_days
from revlens.plans import serving

D = [date(2024, 1, n) for n in range(1, 11)]


@pytest.mark.parametrize("text, want", [
    ("paid_search", "Paid Search"), ("a-b c_d", "A-B C D"), ("MID_market", "Mid Market"), ("x2y", "X2y"),
    ("o'neil", "O'Neil"), (None, None), ("", "")])
def test_display_name(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.display_name(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("number, want", [
    ("0.125", "12.5%"), ("0.0625", "6.3%"), ("-0.1124", "-11.2%"), ("1.4074", "140.7%"), (None, None)])
def test_percent(spark, number, want):
    df = spark.createDataFrame([(None if number is None else float(number),)], "v double")
    assert df.select(X.percent(F.col("v"))).first()[0] == want


def test_small_expressions(spark):
    row = spark.range(1).select(
        X.ratio(F.lit(1), F.lit(0)).alias("none"), X.ratio(F.lit(1), F.lit(4)).alias("quarter"),
        X.rank_in(F.lit("b"), ("a", "b")).alias("second"), X.rank_in(F.lit("z"), ("a", "b")).alias("unknown"),
        X.rank_in(F.lit(None).cast("string"), ("a", "b")).alias("null"),
        X.flag(F.lit(None).cast("boolean")).alias("flag"), X.signed(F.lit("-1")).alias("minus"),
        X.signed(F.lit("1")).alias("plus"), X.grouped(F.lit(1234567.5)).alias("grouped"),
        X.week_of(F.lit(date(2024, 1, 7))).alias("week"), X.month_of(F.lit(D[6])).alias("month"),
    ).first()
    assert tuple(row) == (None, 0.25, 2, None, None, False, "-1", "+1", "1,234,568", D[0], D[0])


def test_each_day_guards_empty_ranges(spark):
    df = spark.createDataFrame([(1, D[0], D[2]), (2, D[3], D[1]), (3, None, D[1]), (4, D[5], D[5])],
                               "k int, a date, b date")
    got = each_day(df, F.col("a"), F.col("b")).groupBy("k").count()
    assert {r.k: r["count"] for r in got.collect()} == {1: 3, 4: 1}


def test_fill_days(spark):
    df = spark.createDataFrame([(D[0], 1, 5), (D[3], 2, None), (None, 9, 9)], "metric_date date, flow int, level int")
    got = fill_days(df, keep=["level"]).orderBy("metric_date").collect()
    assert [tuple(r) for r in got] == [(D[0], 1, 5), (D[1], None, 5), (D[2], None, 5), (D[3], 2, None)]
    assert fill_days(df.limit(0)).count() == 0


def test_calendar_without_cross_join(spark):
    a = spark.createDataFrame([(D[1],), (D[3],)], "d date")
    empty = a.limit(0)
    items = spark.createDataFrame([("x",), ("y",)], "item string")
    calendar = on_every_day(items, all_bounds(day_bounds(a, "d"), day_bounds(empty, "d")))
    assert calendar.count() == 6
    plan = calendar._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert on_every_day(items, day_bounds(empty, "d")).count() == 0


def test_stack_days_merges_series(spark):
    a = spark.createDataFrame([(D[0], 1), (D[1], 2)], "metric_date date, x int")
    b = spark.createDataFrame([(D[1], 7), (D[2], None)], "metric_date date, y int")
    got = stack_days("metric_date", a, b).orderBy("metric_date").collect()
    assert [tuple(r) for r in got] == [(D[0], 1, None), (D[1], 2, 7), (D[2], None, None)]


def test_melt_reads_its_input_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    long = melt(df, ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"])
    assert long.count() == 3 * df.count()
    assert long._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_latest_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = latest_per_key(df, "k", [F.desc("id")])
    # before the run the text holds one plan: a partial and a final limit
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert {r.k: r.id for r in got.collect()} == {0: 999, 1: 997, 2: 998}


def test_topk(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", 2)], "g string, v int")
    top = topk.rank_within(df, ["g"], [F.desc_nulls_last("v")], 2)
    assert sorted((r.g, r.v, r.record_no) for r in top.collect()) == [("a", 1, 2), ("a", 3, 1), ("b", 2, 1)]
    first = topk.first_rows(df, [F.desc_nulls_last("v")], 2)
    assert "TakeOrderedAndProject" in first._jdf.queryExecution().executedPlan().toString()
    records = [r.record for r in topk.records_json(df, [F.col("g"), F.asc_nulls_last("v")], 3).collect()]
    assert records == ['{"g":"a","v":1}', '{"g":"a","v":3}', '{"g":"a","v":null}']


def kpis(spark, *rows):
    names = ["metric_date date"] + [f"{f} double" for f, _ in serving.KPI_CARDS]
    return spark.createDataFrame([(d, *[float(v)] * 6) for d, v in rows], ", ".join(names))


def test_kpi_cards(spark):
    cards = serving.kpi_cards(kpis(spark, (D[0], 3), (D[2], 1), (D[1], 2))).orderBy("position").collect()
    assert [(c.current_value, c.previous_value, c.change) for c in cards] == [(1.0, 2.0, -1.0)] * 6
    assert [c.display_value for c in cards] == ["$1", "1", "1", "100.00%", "$1", "1.0"]
    assert [c.display_change for c in cards] == ["$-1", "-1", "-1", "-100.00%", "$-1", "-1.0"]
    only = serving.kpi_cards(kpis(spark, (D[0], 3))).first()
    assert (only.previous_value, only.change, only.display_change) == (None, None, None)
    assert serving.kpi_cards(kpis(spark)).count() == 0


def test_dashboard_filters(spark):
    days = [date(2024, 1, 1), date(2024, 1, 2), date(2024, 4, 1)]
    df = spark.createDataFrame([(d, c, s) for d in days for c in ("revenue", "retention") for s in (True, False)],
                               "metric_date date, metric_category string, should_investigate boolean")
    assert serving.dashboard_filter(df).count() == 8          # the last 90 days leave out January 1
    assert serving.dashboard_filter(df, days[0], days[1]).count() == 8
    assert serving.dashboard_filter(df, start=days[0]).count() == 12
    assert serving.dashboard_filter(df, categories=["revenue"], flags_only=True).count() == 2


def test_sweep_equals_pairing(spark):
    import random
    from revlens.operators.sweep import open_intervals
    r = random.Random(3)
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    entities, groups = ["a", "b", "c", None], ["x", "y", None]
    points = [(r.choice(entities), day(r.randrange(20)), i) for i in range(120)]
    spans = []
    for _ in range(60):
        first = r.randrange(20)
        spans.append((r.choice(entities), r.choice(groups), day(first), r.choice([None, day(first + r.randrange(0, 6))])))
    got = open_intervals(spark.createDataFrame(points, "e string, day date, v long"),
                         spark.createDataFrame(spans, "e string, g string, first date, gone date"),
                         "e", "g", "day", "first", "gone", "n")
    want = []
    for e, d, v in points:
        for g in groups:
            n = sum(1 for f, h, a, z in spans if e is not None and f == e and h == g and a <= d and (z is None or d < z))
            want += [(e, d, v, g, n)] if n else []
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, want))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("series", [(), ("s",)])
def test_lag_with_carry_equals_a_plain_lag(spark, series):
    import random
    from pyspark.sql import Window
    from revlens.operators.carry import lag_with_carry
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(60)]), i, r.choice([None, i * 10])) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, at int, id int, v int").repartition(5)
    got = lag_with_carry(df, ["v", "id"], ["at", "id"], F.floor(F.col("at") / 7), series)
    w = Window.partitionBy(*series).orderBy("at", "id")
    want = df.select("*", F.lag("v").over(w).alias("previous_v"), F.lag("id").over(w).alias("previous_id"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # No window sees more than one range's rows, or one row per range.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") == 3
