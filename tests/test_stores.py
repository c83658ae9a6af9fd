"""Raw store, model store, report store and id allocation."""

import os
import time
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.operators import ids
from revlens.session import shared_dir
from revlens.sources.model_store import ModelStore
from revlens.sources import files, raw_store
from revlens.sources.day_table import DayTable
from revlens.sources.files import versions
from revlens.sources.raw_store import BatchError, RawStore, read_raw_csv, write_batch_once
from revlens.sources.report_store import SCHEMA, ReportStore
from revlens.sources.schemas import raw_schema

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
HEADER = ",".join(raw_schema("raw_transactions").names)


def csv(folder, table, *lines, header=HEADER):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{table}.csv", "w") as out:
        out.write("\n".join([header, *lines]) + "\n")


def line(tid, day, amount="5.00"):
    return f"{tid},u1,{day},{amount},completed,card,invoice,new_customer,,,{day}"


@pytest.fixture
def store(spark):
    return RawStore(spark, shared_dir(spark))


def loaded(store):
    rows = store.read("raw_transactions").orderBy("transaction_id").collect()
    return [(r.transaction_id, str(r.transaction_amount), r.batch_date) for r in rows]


def test_daily_load_is_idempotent_and_leaves_other_days(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1), line("t2", D1))
    assert store.load_daily(str(tmp_path), D1) == ["raw_transactions"]
    csv(tmp_path, "raw_transactions", line("t3", D2))
    store.load_daily(str(tmp_path), D2)
    store.load_daily(str(tmp_path), D2)
    assert [t for t, _, _ in loaded(store)] == ["t1", "t2", "t3"]
    csv(tmp_path, "raw_transactions", line("t3", D2, "7.50"), line("t4", D2))
    store.load_daily(str(tmp_path), D2)
    assert loaded(store) == [("t1", "5.00", D1), ("t2", "5.00", D1), ("t3", "7.50", D2), ("t4", "5.00", D2)]


def test_header_only_file_empties_the_day_and_missing_file_does_nothing(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1))
    store.load_daily(str(tmp_path), D1)
    assert store.load_daily(str(tmp_path / "nowhere"), D1) == []
    assert len(loaded(store)) == 1
    csv(tmp_path, "raw_transactions")
    store.load_daily(str(tmp_path), D1)
    assert loaded(store) == []
    csv(tmp_path, "raw_transactions", line("t9", D1))
    store.load_daily(str(tmp_path), D1)
    assert [t for t, _, _ in loaded(store)] == ["t9"]


def test_rows_of_another_day_are_refused(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D2))
    store.load_daily(str(tmp_path), D2)
    csv(tmp_path, "raw_transactions", line("t2", D1), line("t3", D2))
    for _ in range(2):
        with pytest.raises(BatchError, match="another date"):
            store.load_daily(str(tmp_path), D1)
    with pytest.raises(BatchError, match="another date"):
        store.replace_batch("raw_transactions", store.read("raw_transactions"), D1)
    assert [t for t, _, _ in loaded(store)] == ["t1"]


def test_columns_are_found_by_name(spark, store, tmp_path):
    names = raw_schema("raw_transactions").names
    values = dict(zip(names, line("t1", D1).split(",")))
    turned = names[::-1]
    csv(tmp_path, "raw_transactions", ",".join(values[n] for n in turned), header=",".join(turned))
    store.load_daily(str(tmp_path), D1)
    assert loaded(store) == [("t1", "5.00", D1)]
    csv(tmp_path, "raw_transactions", header=",".join([*names[:-2], "batch_date", "surprise"]))
    with pytest.raises(BatchError, match="missing .*refund_reason.* unknown .*surprise"):
        store.load_daily(str(tmp_path), D1)


AWKWARD = ['He said "hi", ok', "back\\slash\\", "two\nlines", " blanks ", '"', "a,b;c", "é | \t"]


def test_any_text_survives_writing_and_reading(spark, store, tmp_path):
    schema = raw_schema("raw_users")
    rows = [(f"u{i}", "a1", text, *[None] * 10, D1) for i, text in enumerate(AWKWARD)]
    frame = spark.createDataFrame(rows, schema)
    write_batch_once(frame.repartition(3), f"{tmp_path}/raw_users.csv")
    for _ in range(2):
        assert store.load_daily(str(tmp_path), D1) == ["raw_users"]
    assert [r.first_name for r in store.read("raw_users").orderBy("user_id").collect()] == AWKWARD


def test_values_that_do_not_parse_stop_a_load(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1, "five"), line("t2", D1), line("t3", D1, ""))
    for load in (lambda: store.load_daily(str(tmp_path), D1), lambda: store.load_backfill(str(tmp_path))):
        with pytest.raises(BatchError, match="transaction_amount': 1"):
            load()
    csv(tmp_path, "raw_transactions", line("t1", D1, "5"), line("t2", D1))
    store.load_daily(str(tmp_path), D1)
    assert [a for _, a, _ in loaded(store)] == ["5.00", "5.00"]


def snapshot(store):
    return store.table("raw_transactions").snapshot().number


def test_a_broken_batch_changes_nothing(store, tmp_path):
    csv(tmp_path / "good", "raw_transactions", line("t1", D1), line("t2", D2))
    store.load_backfill(str(tmp_path / "good"))
    before, number = loaded(store), snapshot(store)
    csv(tmp_path / "bad", "raw_transactions", line("t8", D1), line("t9", D1, "five"))
    for load in (lambda: store.load_daily(str(tmp_path / "bad"), D1), lambda: store.load_backfill(str(tmp_path / "bad"))):
        with pytest.raises(BatchError):
            load()
        assert loaded(store) == before and snapshot(store) == number
    folders = [n for n in files.names(store.spark, store.path("raw_transactions")) if n.startswith("load=")]
    assert len(folders) == 1  # what was staged is gone
    assert {(r.reason, r.record.split(",")[0]) for r in store.rejects("raw_transactions").collect()} == {("transaction_amount", "t9")}


def test_one_broken_table_keeps_the_others_back(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1))
    csv(tmp_path, "raw_users", "u1,a1,Ann,Lee,,owner,active,,,maybe,2024-01-01,,,2024-01-01",
        header=",".join(raw_schema("raw_users").names))
    for load in (lambda: store.load_daily(str(tmp_path), D1), lambda: store.load_backfill(str(tmp_path))):
        with pytest.raises(BatchError, match="onboarding_completed"):
            load()
    assert loaded(store) == [] and store.read("raw_users").count() == 0


def test_rejects_below_the_bound(spark, tmp_path):
    store = RawStore(spark, shared_dir(spark), max_reject_share=0.5)
    csv(tmp_path, "raw_transactions", line("t1", D1), line("t2", D1), line("t3", D1), line("t4", D1, "five"),
        line("t5", D2), "t6,u1,too short")
    store.load_daily(str(tmp_path), D1)
    assert [t for t, _, _ in loaded(store)] == ["t1", "t2", "t3"]
    found = {r.record.split(",")[0]: r.reason for r in store.rejects("raw_transactions").collect()}
    assert found.keys() == {"t4", "t5", "t6"} and found["t4"] == "transaction_amount"
    assert found["t5"] == "date of another batch" and "malformed record" in found["t6"]
    assert store.rejects("raw_users").count() == 0
    csv(tmp_path, "raw_transactions", line("t7", D1), line("t8", D1, "x"), line("t9", D1, "y"))
    with pytest.raises(BatchError, match="2 of 3 rows"):
        store.load_daily(str(tmp_path), D1)
    assert [t for t, _, _ in loaded(store)] == ["t1", "t2", "t3"]


def test_files_without_line_breaks_in_values_are_split(spark, tmp_path):
    from revlens.sources.raw_store import read_text_csv, spans_lines
    csv(tmp_path, "raw_transactions", *[line(f"t{i:05d}", D1) for i in range(3000)])
    csv(tmp_path, "raw_users", 'u1,a1,"two\nlines",Lee,,owner,active,,,True,2024-01-01,,,2024-01-01',
        header=",".join(raw_schema("raw_users").names))
    assert not spans_lines(spark, f"{tmp_path}/raw_transactions.csv") and spans_lines(spark, f"{tmp_path}/raw_users.csv")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert read_text_csv(spark, f"{tmp_path}/raw_transactions.csv", "raw_transactions").rdd.getNumPartitions() > 3
        assert read_text_csv(spark, f"{tmp_path}/raw_transactions.csv", "raw_transactions").count() == 3000
        assert read_text_csv(spark, f"{tmp_path}/raw_users.csv", "raw_users").first().first_name == "two\nlines"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def day_rows(spark, *rows):
    return spark.createDataFrame(rows, "id long, day date")


def held(table):
    return sorted((r.id, r.day) for r in table.read().collect())


def test_days_are_published_by_pointer(spark):
    table = DayTable(spark, shared_dir(spark), "day")
    table.publish_all(table.stage(day_rows(spark, (1, D1), (2, D2), (3, None))))
    first = table.read()
    staged = table.stage(day_rows(spark, (4, D2)))
    assert held(table) == held(DayTable(spark, table.folder)) and len(held(table)) == 3  # staged rows do not count
    table.publish_days(staged, [D2, None])
    assert [r[0] for r in sorted(held(table))] == [1, 4]
    assert first.count() == 3  # readers of the last snapshot go on
    assert table.changed_days(1) == {D2, None} and table.changed_days(7) is None
    with pytest.raises(ValueError, match="other days"):
        table.publish_days(table.stage(day_rows(spark, (5, D1))), [D2])
    table.publish_more(table.stage(day_rows(spark, (6, D1))))
    assert [r[0] for r in held(table)] == [1, 4, 6]
    table.publish_days(table.stage(day_rows(spark)), [D1, D2])
    assert held(table) == []
    table.publish_all(table.stage(day_rows(spark)))
    table.publish_all(table.stage(day_rows(spark)))
    loads = [n for n in files.names(spark, table.folder) if n.startswith("load=")]
    assert loads == []  # what no kept snapshot names is deleted


def test_publishers_at_once_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor
    table = DayTable(spark, shared_dir(spark), "day")
    staged = [table.stage(day_rows(spark, (i, date(2024, 1, i)))) for i in range(1, 9)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda s: DayTable(spark, table.folder, "day").publish_more(s), staged))
    assert [r[0] for r in held(table)] == list(range(1, 9)) and table.snapshot().number == 8


def test_loads_of_dead_jobs_are_cleaned(spark):
    table = DayTable(spark, shared_dir(spark), "day")
    table.publish_all(table.stage(day_rows(spark, (1, D1))))
    lost = table.stage(day_rows(spark, (2, D1)))
    assert table.clean() == [] and table.clean(older_than=0) == [lost.load]
    assert held(table) == [(1, D1)]


def test_a_file_is_created_once(spark):
    folder = shared_dir(spark)
    assert files.create_once(spark, f"{folder}/x", "a") and not files.create_once(spark, f"{folder}/x", "b")
    assert files.read_text(spark, f"{folder}/x") == "a"
    assert [n for n in files.names(spark, folder) if "draft" in n] == []
    files.create_once(spark, f"{folder}/y", "c")
    with pytest.raises(FileExistsError):
        files.rename_new(spark, f"{folder}/y", f"{folder}/x")
    files.rename_new(spark, f"{folder}/y", f"{folder}/z")
    assert files.read_text(spark, f"{folder}/z") == "c"


def test_what_a_dead_job_left_is_written_again(spark, tmp_path):
    target = str(tmp_path / "batch")
    os.makedirs(f"{target}/_temporary/0")
    write_batch_once(spark.range(3), target)
    assert spark.read.option("header", True).csv(target).count() == 3


def test_a_version_is_read_only_when_complete(spark, store):
    models, folder = ModelStore(spark, shared_dir(spark)), None
    first = models.table("m", spark.range(5))
    folder = f"{models.path('m')}/v99999999999999999999-dead"
    spark.range(9).write.parquet(folder)
    os.remove(f"{folder}/_SUCCESS".removeprefix("file://"))
    assert models.read("m").count() == 5
    models.table("m", spark.range(6))
    assert first.count() == 5 and models.read("m").count() == 6  # readers of the old version go on
    models.table("m", spark.range(7))
    assert len(versions(spark, models.path("m"))) == 2
    with pytest.raises(LookupError):
        models.read("nothing")


def test_backfill_replaces_and_skips_missing_or_empty(store, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1), line("t2", D2))
    csv(tmp_path, "raw_users", header=",".join(raw_schema("raw_users").names))
    for _ in range(2):
        assert store.load_backfill(str(tmp_path)) == ["raw_transactions"]
    assert len(loaded(store)) == 2 and store.read("raw_users").count() == 0


def test_values_that_do_not_parse_become_null(spark, tmp_path):
    names = raw_schema("raw_users").names
    csv(tmp_path, "raw_users", "u1,a1,Ann,Lee,,owner,active,,,True,2024-01-01,,,2024-01-01",
        "u2,a1,Bob,Ray,,owner,active,,,maybe,2024-01-01 10:30:00,n/a,,2024-01-01", header=",".join(names))
    rows = read_raw_csv(spark, f"{tmp_path}/raw_users.csv", "raw_users").orderBy("user_id").collect()
    assert [r.onboarding_completed for r in rows] == [True, None]
    assert rows[1].created_at.hour == 10 and rows[1].last_login_at is None and rows[0].email is None
    assert read_raw_csv(spark, f"{tmp_path}/none.csv", "raw_users") is None


def test_first_batch_stays(spark, tmp_path):
    target = str(tmp_path / "batch")
    for value in (1, 2):
        write_batch_once(spark.range(value).withColumn("v", F.lit(value)), target)
    assert spark.read.option("header", True).csv(target).count() == 1


def test_partitioned_table_prunes_files(spark):
    store = ModelStore(spark, shared_dir(spark))
    frame = spark.range(100).select("id", F.date_add(F.lit(D1), (F.col("id") % 5).cast("int")).alias("day"))
    table = store.table("t", frame, "day")
    assert table.columns == ["id", "day"] and table.count() == 100
    plan = table.where(F.col("day") == F.lit(D2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert store.table("t", frame.limit(3), "day").count() == 3  # full refresh


def test_reports_are_written_once(spark):
    store = ReportStore(spark, shared_dir(spark))
    row = lambda day, name, text: (day, name, "revenue", "high", "revenue", text, "e", "r")
    store.add(spark.createDataFrame([row(D1, "mrr", "first")], SCHEMA))
    store.add(spark.createDataFrame([row(D1, "mrr", "second"), row(D2, "mrr", "third")], SCHEMA))
    assert [(r.metric_date, r.summary) for r in store.read().collect()] == [(D2, "third"), (D1, "first")]
    assert store.read(start=D2).count() == 1 and store.read(end=D1).count() == 1
    assert ReportStore(spark, shared_dir(spark)).read().count() == 0


def test_entity_ids_continue_after_the_highest(spark):
    existing = spark.createDataFrame([("acct_000009",), ("x_000099",), (None,), ("acct_none",)], "account_id string")
    new = spark.createDataFrame([(f"k{i}",) for i in range(3)], "name string")
    got = ids.assign_entity_ids(new, "name", existing, "account_id", "acct_")
    assert sorted(r.account_id for r in got.collect()) == ["acct_000010", "acct_000011", "acct_000012"]
    assert ids.highest_number(existing.limit(0), "account_id", "acct_").first()[0] == 0


def test_ids_are_dense_unique_repeatable_and_grow_past_the_padding(spark):
    new = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("name"))
    existing = spark.createDataFrame([("u_995000",)], "uid string")
    first = {r.name: r.uid for r in ids.assign_entity_ids(new, "name", existing, "uid", "u_").collect()}
    again = {r.name: r.uid for r in ids.assign_entity_ids(new.repartition(7), "name", existing, "uid", "u_").collect()}
    assert first == again
    assert sorted(int(v[2:]) for v in first.values()) == list(range(995001, 1015001))


def test_rows_without_key_or_day_are_refused(spark):
    rows = spark.createDataFrame([(1, D1), (2, None), (None, D1)], "id long, day date")
    for wrong in ("id is null or id = 1", "day is null or id = 1"):
        with pytest.raises(Exception, match="cannot get an id"):
            ids.assign_daily_ids(rows.where(wrong), "id", "day", "event_id", "evt_").collect()
    with pytest.raises(Exception, match="cannot get an id"):
        ids.assign_entity_ids(rows, "id", rows.selectExpr("'x' as uid"), "uid", "u_").collect()


def test_daily_ids_restart_every_day(spark):
    rows = spark.range(10).select("id", F.date_add(F.lit(D1), (F.col("id") % 2).cast("int")).alias("day"))
    got = sorted(r.event_id for r in ids.assign_daily_ids(rows, "id", "day", "event_id", "evt_").collect())
    assert got == [f"evt_{d:%Y%m%d}_{n:06d}" for d in (D1, D2) for n in range(1, 6)]


def test_decimals_survive_csv(spark, tmp_path):
    csv(tmp_path, "raw_transactions", line("t1", D1, "1234567890.12"))
    row = read_raw_csv(spark, f"{tmp_path}/raw_transactions.csv", "raw_transactions").first()
    assert row.transaction_amount == Decimal("1234567890.12")


def test_csv_parts_are_compressed_and_hold_few_rows(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(raw_store, "PART_ROWS", 10)
    rows = spark.createDataFrame([(f"u{i:02d}", "a1", AWKWARD[i % len(AWKWARD)], *[None] * 10, D1) for i in range(25)],
                                 raw_schema("raw_users")).coalesce(1)
    raw_store.write_raw_csv(rows, f"{tmp_path}/raw_users.csv")
    parts = [n for n in os.listdir(tmp_path / "raw_users.csv") if n.startswith("part-")]
    assert len(parts) == 3 and all(n.endswith(".csv.gz") for n in parts)
    assert store.load_daily(str(tmp_path), D1) == ["raw_users"]
    assert [tuple(r) for r in store.read("raw_users").orderBy("user_id").collect()] == [tuple(r) for r in rows.collect()]


def test_shuffle_files_go_when_a_table_is_stored(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in blocks.getAllBlocks().mkString(" ").split() if n.startswith("shuffle_")}

    before = shuffles()
    counted = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    assert ModelStore(spark, shared_dir(spark)).table("m", counted).count() == 700
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def slices(spark, monkeypatch, folder, *files):
    """A folder of files, each a slice of its own."""
    monkeypatch.setattr(raw_store, "SLICE_BYTES", 1)
    monkeypatch.setattr(raw_store, "SLICES", 1000)
    os.makedirs(folder / "raw_transactions.csv")
    for i, lines in enumerate(files):
        csv(folder, f"raw_transactions.csv/part-{i}", *lines)
    csv(folder, "raw_transactions.csv/_not_read", line("t0", D1))


def test_a_load_in_slices_is_one_load(spark, store, tmp_path, monkeypatch):
    slices(spark, monkeypatch, tmp_path, [line("t1", D1), line("t2", D2)], [], [line("t3", D1)])
    for _ in range(2):
        assert store.load_backfill(str(tmp_path)) == ["raw_transactions"]
        assert [t for t, _, _ in loaded(store)] == ["t1", "t2", "t3"]
    found = store.table("raw_transactions").snapshot().days
    assert sorted(map(len, found.values())) == [1, 2]  # the first and the last slice have rows of a day
    store.replace_batch("raw_transactions", store.read("raw_transactions").where("batch_date = '2024-01-02'"), D2)
    assert [t for t, _, _ in loaded(store)] == ["t1", "t2", "t3"]
    assert store.load_daily(str(tmp_path / "nowhere"), D1) == []
    slices(spark, monkeypatch, tmp_path / "day", [line("t4", D1)], [line("t5", D1)])
    store.load_daily(str(tmp_path / "day"), D1)
    assert [t for t, _, _ in loaded(store)] == ["t2", "t4", "t5"]


def test_a_broken_slice_stops_the_load_or_is_set_aside(spark, store, tmp_path, monkeypatch):
    slices(spark, monkeypatch, tmp_path, [line("t1", D1)], [line("t2", D1, "five")], [line("t3", D2), line("t4", D1, "six")])
    with pytest.raises(BatchError, match="2 of 4 rows cannot be taken in, by column {'transaction_amount': 2}"):
        store.load_backfill(str(tmp_path))
    assert loaded(store) == []
    assert [n for n in files.names(spark, store.path("raw_transactions")) if n.startswith("load=")] == []
    with pytest.raises(BatchError, match="another date"):
        store.load_daily(str(tmp_path), D1)
    lenient = RawStore(spark, shared_dir(spark), max_reject_share=0.5)
    lenient.load_backfill(str(tmp_path))
    assert [t for t, _, _ in loaded(lenient)] == ["t1", "t3"]
    rejects = lenient.rejects("raw_transactions").collect()
    assert {r.record.split(",")[0] for r in rejects} == {"t2", "t4"} and len({r.load for r in rejects}) == 1
