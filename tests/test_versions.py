"""Versioned tables: racing writers lose nothing, a reader keeps its version, only touched buckets are written again."""

import threading

from pyspark.sql import functions as F

from marketloom.sources import cache, sheets
from marketloom.sources.versions import VersionedTable, newest

SCHEMA = "k bigint, v bigint, ts bigint"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_racing_writers_and_a_reader(spark, tmp_path):
    make = lambda: VersionedTable(spark, str(tmp_path), SCHEMA, ("k",), 4)
    make().upsert(rows(spark, *[(k, 0, 0) for k in range(40)]), newest(["k"], ["ts"]))
    held = make().read(1)
    seen, errors, done = [], [], threading.Event()

    def add(old, changes):  # a counter: each change adds one to its key
        more = changes.groupBy("k").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
        return old.join(more, "k", "left").select("k", (F.col("v") + F.coalesce("n", F.lit(0))).alias("v"), F.coalesce("t", "ts").alias("ts"))

    def write(first):
        try:
            for step in range(3):
                make().upsert(rows(spark, *[(k, 1, step) for k in range(first, 40, 3)]), add)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def watch():
        while not done.is_set():
            try:
                found = make().read().collect()
                seen.append((len(found), sum(r.v for r in found)))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    writers = [threading.Thread(target=write, args=(x,)) for x in (0, 0)]
    reader = threading.Thread(target=watch)
    for t in (*writers, reader):
        t.start()
    for t in writers:
        t.join(300)
    done.set()
    reader.join(60)
    assert not errors
    final = {r.k: r.v for r in make().read().collect()}
    assert final == {k: 6 if k % 3 == 0 else 0 for k in range(40)}  # no increment of either is lost
    assert make().version() == 7 and sorted(r.v for r in held.collect()) == [0] * 40
    per_step = len(range(0, 40, 3))
    assert all(n == 40 and total % per_step == 0 for n, total in seen)  # never half a write


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), SCHEMA, ("k",), 8)
    table.replace(rows(spark, *[(k, k, 0) for k in range(100)]))
    before = table.folders(1)
    table.upsert(rows(spark, (5, 55, 1), (5, 54, 0), (200, 1, 1)), newest(["k"], ["ts"]))
    after = table.folders(2)
    assert 1 <= sum(before.get(b) != after.get(b) for b in range(8)) <= 2
    found = {r.k: r.v for r in table.read().collect()}
    assert found[5] == 55 and found[200] == 1 and len(found) == 101
    table.clear()
    assert table.read().count() == 0 and table.read(2).count() == 101
    assert VersionedTable(spark, str(tmp_path / "none"), SCHEMA, ("k",)).read().count() == 0


def test_cache_compaction_keeps_readers_and_live_entries(spark, tmp_path):
    path = str(tmp_path)
    entries = [("html", f"u{k}", "x", 0) for k in range(20)] + [("selector", "d", ".price", 0), ("html", "new", "y", 90_000_000)]
    cache.put(spark.createDataFrame(entries, cache.SCHEMA), path)
    held = cache.table(spark, path).read()
    cache.compact(spark, path, 100_000_000)
    assert {(r.section, r.key) for r in cache.table(spark, path).read().collect()} == {("selector", "d"), ("html", "new")}
    cache.clear(spark, path)
    assert cache.live(spark, path, 0).count() == 0 and held.count() == 22


def test_sheet_rows_are_written_back_by_key(spark, tmp_path):
    path, cells = str(tmp_path), lambda *x: [*x, *[""] * (10 - len(x))]
    table = sheets.stored_rows(spark, path)
    table.replace(spark.createDataFrame([("s", 3, cells("9.000.000"), None, 8_000_000, None, None, None), ("s", 4, cells("7.000.000"), 1, None, None, None, None)], sheets.STORED))
    sheets.write_back(spark, path, spark.createDataFrame([("s", 3, [10_000_000])], "sheet_name string, row_number int, market_prices array<bigint>"))
    after = {r.row_number: r for r in table.read().collect()}
    assert (after[3].sale_price, after[3].gap_value, after[3].gap_percent, after[3].cells[0]) == (10_000_000, 2_000_000, 0.25, "10000000")
    assert after[4].cells[0] == "7.000.000" and len(after) == 2


def test_tab_names_fall_back_to_the_workbook_page(spark):
    tabs = spark.createDataFrame([("B", None, None), ("A", None, None)], sheets.RAW_SCHEMA)
    page = spark.createDataFrame([('x docs-sheet-tab-caption">Z &amp; 1<x docs-sheet-tab-caption">A<',)], "html string")
    names = lambda *a: [r.sheet_name for r in sheets.tab_names(*a).orderBy("position").collect()]
    assert names(tabs, page) == ["A", "B"] and names(tabs.where("false"), page) == ["Z & 1", "A"] and names(tabs.where("false")) == []
