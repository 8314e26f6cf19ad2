"""Rejects, orphans, wide tables, rolling totals and skewed keys against brute force, with nulls, ties, repeats and empty tables."""

import collections
import datetime
import math
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import asof, orphans, rejects, rolling, skew, wide
from quern.operators.bind import with_ordinal


# ------------------------------------------------------------ rejects


def parsed(record):
    """(reason, cells) by a reader of single characters."""
    if record is None:
        return "column_count", None
    r, cells, i = record.rstrip("\r\n"), [], 0
    broken = False
    while True:
        if r[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(r):
                    return "quoting", None
                if r[i] == '"' and r[i + 1 : i + 2] == '"':
                    cell, i = cell + '"', i + 2
                elif r[i] == '"':
                    i += 1
                    break
                else:
                    cell, i = cell + r[i], i + 1
            if i < len(r) and r[i] != ",":
                return "quoting", None
        else:
            end = r.find(",", i)
            end = len(r) if end < 0 else end
            cell, i = r[i:end], end
            if '"' in cell:
                return "quoting", None
            broken |= "\n" in cell or "\r" in cell
        cells.append(cell)
        if i >= len(r):
            break
        i += 1
    if len(cells) != 5 or broken:
        return "column_count", None
    salary, date = cells[3].strip(), cells[4].strip()
    if salary and (not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", salary) or math.isinf(float(salary))):
        return "salary", None
    if date:
        m = re.fullmatch(r"([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})(?: +([0-9]{2}):([0-9]{2}):([0-9]{2}))?", date)
        try:
            datetime.datetime(*(int(x) for k, x in enumerate(m.groups()) if k != 1 and x))
        except (AttributeError, ValueError):
            return "update_date", None
    return None, cells


FIXED = [
    None, "", ",,,,", "1,a,2,3,2020/1/1", '1,"a, b",2,3,2020-1-1', '1,"open,2,3,2020/1/1', '1,a"b",2,3,2020/1/1', '1,"a" x,2,3,2020/1/1', '1,"a\nb",2,3,2020/1/1', "1,a,2,3", "1,a,2,3,2020/1/1,x",
    "1,a,2,1e,2020/1/1", "1,a,2,NaN,2020/1/1", "1,a,2, +.5e3 ,2020/1/1\r", "1,a,2,1,2020/1/1\n", "1,a,2,1,2020/1-1", "1,a,2,1,2020/2/30", "1,a,2,1,2020/02/29 23:59:59", "1,a,2,1,2020/02/29 24:00:00",
    "1,a,2,1,20/1/1", "1,a\nb,2,3,2020/1/1", '"1","a","2","3","2020/1/1"', '1,"a ""q"" b",2,3,2020/1/1', '""', '"', 'a"', "1,\tx\t,2,3,", "1,a,2,1_000,2020/02/30", '1,"' + "x" * 100_000 + '",2,3,2020/1/1', "1,é,2,１,2020/1/1", "\x00,a,2,3,2020/1/1",
    "1,a,2,1e999,2020/1/1", '1,a,2,"-1e400",2020/1/1', "\\0,\\0,\\0,3,2020/1/1", "1,a,2,inf,", "1,a,2,nan,", "1,a,2,0x1,", "1,a,2,1e-400,2020/1/1", "1,a,2,1,0000-01-01", "1,a,2,1,epoch", "1,a,2,1,infinity", "1,a,2,1,2020-1-2T03:04:05", "1,a,2,1,2020-1-2 3:04:05",
    "1,a,2,1,2020-1-2 03:04:05+01", "1,a,2, 1 , 2020/1/1 ", '1,"a",2,"",""', '1,a,2,"3,5",2020/1/1', "NULL,NULL,NULL,NULL,NULL", "1,a,2,1,12020-01-01", "1,a,2,1,2020-01-01 23:59:60", "1,a,2,\xa05\u3000,\u20032020/1/1\x1f",
]


def test_records_against_a_reader_of_characters():
    rng = random.Random(5)
    pieces = ['"', '""', ",", "\n", "a", "1", " ", "2020/1/1", '"x"', ",,", '","', "3.5", "\r"]
    records = FIXED + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    records += [f'{i},"n{i}",2,{i},2020/1/{i % 31 + 1}' if i % 3 else f'{i},"n{i},2,{i},2020/1/1' for i in range(300)]
    rng.shuffle(records)
    files = [rng.choice([None, *"abcdefgh"]) for _ in records]
    rows, failed = rejects.load_batch(records, files)
    assert rows.num_rows + len(failed) == len(records)
    got = dict.fromkeys(rows["n"].to_pylist()) | {n: reason for n, (reason, _) in failed.items()}
    wrong = [(r, got.get(n, "none"), parsed(r)[0]) for n, r in enumerate(records) if got.get(n, "none") != parsed(r)[0]]
    assert not wrong
    cells = {r["n"]: r for r in rows.to_pylist()}
    for n, r in enumerate(records):
        if (want := parsed(r))[0] is None:
            assert [cells[n][c] for c in rejects.CELLS[:3]] == want[1][:3]
            assert cells[n]["Salary"] == (float(x) if (x := want[1][3].strip()) else None)


def test_reject_tables_name_typed_columns_and_files():
    many = [f"f{i}" for i in range(450)]  # more files than one call of the reader opens
    texts, files = [], []
    for f in many:
        texts += ["1,a,2,3.5,2020/1/2", "1,a,2,x,bad", "1,a,2,1,2020/02/30", '1,"open,2,3,2020/1/1', "1,a,2,4,2021-1-2"]
        files += [f] * 5
    rows, failed = rejects.load_batch(texts, files)
    assert sorted(n % 5 for n in rows["n"].to_pylist()) == [0] * 450 + [4] * 450
    assert {failed[n] for n in failed if n % 5 == 1} == {("salary", "CAST Salary; CAST UpdateDate")} and {failed[n] for n in failed if n % 5 == 2} == {("update_date", "CAST UpdateDate")}
    assert {failed[n][0] for n in failed if n % 5 == 3} == {"quoting"} and len(failed) == 3 * 450
    assert rejects.load_batch([], [])[0].num_rows == 0


def test_loading_on_spark(spark):
    data = [(1, "f", '1,"a, b",2,3.5,2020/1/2', "x"), (1, "f", "1,a", "x"), (None, None, None, None), (3, "g", "1,a,,,", "y")]
    df = spark.createDataFrame(data, "record_no bigint, file_name string, record string, reason string")
    got = sorted((tuple(r) for r in rejects.load_records(df).collect()), key=repr)
    assert got == sorted(
        [
            (1, "f", "1", "a, b", "2", 3.5, datetime.datetime(2020, 1, 2), None, None, None), (1, "f", None, None, None, None, None, "column_count", "MISSING COLUMNS", "1,a"),
            (None, None, None, None, None, None, None, "column_count", "NULL RECORD", None), (3, "g", "1", "a", "", None, None, None, None, None),
        ],
        key=repr,
    )
    assert rejects.load_records(df.limit(0)).collect() == []


# ------------------------------------------------------------ as-of and orphans


def day(n):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=6 * n)


@pytest.mark.parametrize("crowded", [256, 1])
def test_last_before_carries_over_buckets(spark, monkeypatch, crowded):
    monkeypatch.setattr(asof, "CROWDED", crowded)
    rng = random.Random(3)
    left = [(rng.choice([1, 2, None]), rng.choice([None, *map(day, range(80))]), i) for i in range(200)]
    right = {(rng.choice([1, 2, None]), day(rng.randrange(80))): i for i in range(30)}
    a = spark.createDataFrame(left, "k int, t timestamp_ntz, id int")
    b = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, t timestamp_ntz, v int")
    for down in (False, True):
        got = {r.id: r.v for r in asof.last_before(a, b, ["k"], "t", ["date_trunc('month', t)", "date_trunc('day', t)"], "v", down).collect()}
        for k, t, i in left:
            near = [(s, v) for (kk, s), v in right.items() if kk == k and t is not None and (s >= t if down else s <= t)]
            assert got[i] == ((min if down else max)(near)[1] if near else None)


@pytest.mark.parametrize("crowded", [256, 1])
def test_orphans(spark, monkeypatch, crowded):
    monkeypatch.setattr(asof, "CROWDED", crowded)
    rng = random.Random(4)
    keys = ["1", " 1 ", "001", "2", "3", "70000", "70001", "-5", "x1", "9" * 30, "", " ", None, "4"]
    parents = [(i, rng.choice(keys[:-1]), day(rng.randrange(20)), rng.choice([True, False, None])) for i in range(40)] + [(99, "4", None, False)]
    refs = [(rng.choice("st"), i, rng.choice([*keys, "8", "65536"]), rng.choice([None, *map(day, range(20))])) for i in range(300)]
    refs += refs[:5]
    got = orphans.find_orphans(spark.createDataFrame(refs, "table_name string, row_id int, key_text string, loaded_at timestamp_ntz").withColumn("key", F.lit("clash")),
                               spark.createDataFrame(parents, "parent_id int, key_text string, loaded_at timestamp_ntz, removed boolean").withColumn("gone", F.lit(1)))

    def key(t):
        t = (t or "").strip()
        return (int(t) if re.fullmatch(r"[+-]?\d{1,18}", t) else t) if t else None

    want = []
    for table, i, k, t in refs:
        if key(k) is None:
            continue
        own = [(s, p, g) for p, kk, s, g in parents if key(kk) == key(k)]
        seen = sorted((s, p, bool(g)) for s, p, g in own if s is not None and t is not None and s <= t)
        reason = "missing" if not own else None if t is None else "late" if not seen else "deleted" if seen[-1][2] else None
        if reason:
            want.append((table, i, t.strftime("%Y-%m") if t else None, reason))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "parent_id int, key_text string, loaded_at timestamp_ntz, removed boolean")
    few = spark.createDataFrame(refs[:20], "table_name string, row_id int, key_text string, loaded_at timestamp_ntz")
    assert {r.reason for r in orphans.find_orphans(few, empty).collect()} == {"missing"}
    assert orphans.find_orphans(few.limit(0), empty).collect() == []


def test_runs_are_contiguous(spark):
    runs = orphans.key_runs(spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 5, 65535, 65536, 65537, -1, 0, None)], "key bigint"))
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(-1, -1), (0, 3), (5, 5), (65535, 65535), (65536, 65537)]


# ------------------------------------------------------------ wide tables


MEASURES = [("born", "date"), ("n", "int"), ("w", "double"), ("pet", "boolean"), ("town", "text"), ("odd", "colour"), (None, "int")]


def test_wide(spark):
    rows = [
        (1, " a", "born", "2020/02/29"), (2, "a", "BORN ", "2020-02-30"), (3, "a", "n", "+08.00"), (4, "a", "n", "x"), (5, "b", "w", "5e-1"), (6, "b", "pet", " YES\t"), (7, "b", "pet", "0"),
        (8, "c", "town", " New Town "), (9, "c", "unknown", "1"), (10, None, "n", "1"), (11, " ", "n", "1"), (12, "d", "n", "1.5"), (13, "d", None, "1"), (14, "e", "odd", "red"), (15, "f", "n", "-0"),
        (15, "f", "n", "7"), (16, "g", "town", ""), (17, "h", "n", None), (None, "i", "n", "3"), (18, "j", "w", "-0"), (19, "k", "n", "9" * 30),
    ]
    long = spark.createDataFrame(rows, "row_no bigint, family_id string, measure string, value string").withColumn("kind", F.lit(1))
    table = wide.widen(long, spark.createDataFrame(MEASURES, "measure string, value_type string"))
    assert table.columns == ["family_id", "born", "n", "pet", "town", "w"] and dict(table.dtypes)["born"] == "date"
    got = sorted(map(tuple, wide.filled_cells(table).collect()))
    assert got == sorted([("a", "born", "2020-02-29"), ("a", "n", "8"), ("b", "w", "0.50"), ("b", "pet", "false"), ("c", "town", "New Town"), ("f", "n", "7"), ("i", "n", "3"), ("j", "w", "0.00"), ("k", "n", "9" * 30)])
    none = wide.widen(long.limit(0), spark.createDataFrame(MEASURES, "measure string, value_type string"))
    assert none.columns == table.columns and none.collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_every_entity_comes_out_of_the_dense_table_of_its_own_signature(spark):
    long, measures = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("family_long", "measures"))
    types = wide.value_types(measures)
    names = list(types)
    settled = wide.cells(long, types)
    want = collections.defaultdict(dict)
    for r in settled.collect():
        want[r.family_id][str(r.place)] = r.value
    sets = wide.characteristic_sets(settled)
    got, per_signature = {}, collections.Counter()
    for batch in sets.coalesce(1).sortWithinPartitions("signature").toArrow().to_batches():
        for table in wide.dense_tables(batch):
            per_signature[tuple(table.column_names[1:])] += 1
            assert not any(c.null_count for c in table.columns)  # dense
            for row in table.to_pylist():
                got[row.pop("family_id")] = row
    assert got == want
    assert set(per_signature.values()) == {1} and len(per_signature) == sets.select("signature").distinct().count() > 200
    filled = {(r.family_id, r.measure) for r in wide.filled_cells(wide.widen(long, measures)).collect()}
    assert filled == {(e, names[int(p)]) for e, row in want.items() for p in row}


def test_parts_of_dense_tables_are_united_by_name():
    schema = pa.schema([("family_id", pa.string()), *((str(i), pa.string()) for i in range(3))])
    sets = [("a", "0", ["1"]), ("b", "0,2", ["2", "3"]), ("c", "0,2", ["4", "5"]), ("d", "1", ["6"]), ("e", "0", ["7"])]
    batch = pa.RecordBatch.from_pylist([{"family_id": e, "signature": s, "values": v} for e, s, v in sets]).slice(1)
    tables = list(wide.dense_tables(batch))
    assert [t.column_names[1:] for t in tables] == [["0", "2"], ["1"], ["0"]]
    assert [tuple(r.values()) for r in wide.united(tables, schema).to_pylist()] == [("b", "2", None, "3"), ("c", "4", None, "5"), ("d", None, "6", None), ("e", "7", None, None)]
    assert wide.united([], schema).num_rows == 0 and list(wide.dense_tables(batch.slice(0, 0))) == []


# ------------------------------------------------------------ rolling totals


def test_trailing_totals(spark):
    rng = random.Random(6)
    sold = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 60)]), rng.choice([None, *range(-3, 9)])) for _ in range(300)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-50, 90)])) for _ in range(150)]
    totals = rolling.daily_totals(spark.createDataFrame(sold, "cust string, day bigint, v bigint"), "cust", "day", "v")
    got = rolling.trailing_totals(spark.createDataFrame(asked, "entity string, day bigint"), totals).select("entity", "day", "total_7", "average_7", "total_30", "average_30")
    want = [(e, d, *((None, None) if d is None else (t := sum(v for k, x, v in sold if k == e and None not in (x, v) and d - n < x <= d), t / n))) for e, d in asked for n in (7,)]
    want = [(*w, *((None, None) if w[1] is None else (t := sum(v for k, x, v in sold if k == w[0] and None not in (x, v) and w[1] - 30 < x <= w[1]), t / 30))) for w in want]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [tuple(r) for r in rolling.trailing_totals(spark.createDataFrame([("a", 3)], "entity string, day bigint"), totals.limit(0)).collect()] == [("a", 3, 0, 0.0, 0, 0.0)]
    days = rolling.calendar(spark.createDataFrame([("a", 3, 1), ("a", 6, 1)], "entity string, day bigint, total bigint"))
    assert sorted(r.day for r in days.collect()) == [3, 4, 5, 6]


def test_sales_by_day_counts_tickets_once(spark):
    data = [(1, "t1", "0", " a ", "+2.0"), (2, "t1", "0", "a", "2"), (3, None, "0", "a", "1"), (4, None, "0", "a", "1"), (5, " ", "0", "a", "5"), (6, "t2", "0", "a", "x"), (7, "t3", None, "a", "9"), (8, "t4", "86400000000", "", "-3"), (9, "t5", "0", None, "4")]
    df = spark.createDataFrame(data, "sale_id bigint, ticket string, date string, cust string, sold string").withColumn("feed", F.lit("f"))
    got = rolling.sales_by_day(df, lambda text, feed: text.cast("bigint"))
    assert sorted(map(tuple, got.collect()), key=repr) == [("", 1, -3), ("a", 0, 9)]


def test_calendar_totals_are_those_of_the_range_join(spark):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", "c", None]), rng.randrange(-60, 200), rng.choice([None, *range(-3, 9)])) for _ in range(120)] + [("d", 5, 1), ("e", 0, 2), ("e", 400, 3)]
    totals = spark.createDataFrame(data, "entity string, day bigint, total bigint")
    got, want = rolling.calendar_totals(totals), rolling.trailing_totals(rolling.calendar(totals), totals).select("entity", "day", "total_7", "average_7", "total_30", "average_30")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert rolling.calendar_totals(totals.limit(0)).collect() == []


def test_calendar_query_has_days_without_sales(spark, tmp_path):
    import __spark_entry__ as entry

    sold = [(" a ", "1970-01-02", "2"), ("a", "1970-01-05", "4"), ("a", "1970-02-10", "-1"), ("b", "1970-01-09", "7"), ("b", "no day", "5"), ("c", "1970-01-09", "x"), (None, "1970-01-09", "1"), ("a", "1970-01-05", "+1.0")]
    rows = [(i, c, d, v, f"t{i}", "f") for i, (c, d, v) in enumerate(sold)]
    spark.createDataFrame(rows, "sale_id long, cust string, date string, sold string, ticket string, feed string").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame([("f", "UTC", "DMY")], "feed string, zone_name string, date_order string").write.parquet(f"{tmp_path}/feeds.parquet")
    spark.createDataFrame([("UTC", "UTC")], "label string, zone_name string").write.parquet(f"{tmp_path}/zone_labels.parquet")
    daily = {"a": {1: 2, 4: 5, 40: -1}, "b": {8: 7}}
    want = []
    for c, days in daily.items():
        for d in range(min(days), max(days) + 1):
            sold_7, sold_30 = (sum(v for k, v in days.items() if d - n < k <= d) for n in (7, 30))
            want.append((c, (datetime.date(1970, 1, 1) + datetime.timedelta(d)).isoformat(), sold_7, round(sold_7 / 7, 6), sold_30, round(sold_30 / 30, 6)))
    assert sorted(map(tuple, entry.queries()["p6_calendar"](spark, str(tmp_path)).collect())) == want


# ------------------------------------------------------------ skewed keys


def test_hot_keys_and_exact_quantiles(spark):
    rng = random.Random(8)
    keys = [" hot "] * 400 + ["warm"] * 45 + [f"k{i}" for i in range(300)] + ["", " ", None] * 85
    value = lambda: rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1e3), float(rng.randrange(5)), -0.0, rng.random() * 1e-300, rng.choice([-1.7e308, 1.7e308])])
    data = [(k, value()) for k in keys]
    df = spark.createDataFrame(data, "key string, v double").repartition(5).withColumn("cell", F.lit(1)).withColumn("q", F.lit(1))
    assert sorted(map(tuple, skew.hot_keys(df, "key", 0.04).collect())) == [("hot", 400), ("warm", 45)]
    assert [r.key_value for r in skew.hot_keys(df, "key", 46 / 1000).collect()] == ["hot"]
    assert skew.hot_keys(df.limit(0), "key", 0.04).collect() == []
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    by = collections.defaultdict(list)
    for k, v in data:
        if k and k.strip() and v is not None and math.isfinite(v):
            by[k.strip()].append(v)
    want = {(k, p, sorted(vs)[max(1, math.ceil(p * len(vs) - 1e-9)) - 1]) for k, vs in by.items() for p in qs}
    for large in (skew.LARGE, 40, 0):  # none, the two largest, all keys by selection
        got = skew.exact_quantiles(df, "key", "v", qs, large).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert skew.exact_quantiles(df.limit(0), "key", "v", qs).collect() == []


def test_no_key_of_more_than_the_stated_rows_is_sorted(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(skew, "written", lambda df: kept.append(df.cache()) or kept[-1])
    df = spark.range(5000).selectExpr("case when id < 3000 then 'a' when id < 4001 then 'b' when id < 4999 then 'c' end as key", "cast(id % 97 as double) as v")
    got = {(r.key_value, r.q): r.quantile for r in skew.exact_quantiles(df, "key", "v", (0.5,)).collect()}
    assert {r.key_value for r in kept[1].collect()} == {"a", "b"}  # resolved by selection; c has fewer rows
    assert got == {(k, 0.5): float(sorted(i % 97 for i in range(*r))[(r[1] - r[0] + 1) // 2 - 1]) for k, r in {"a": (0, 3000), "b": (3000, 4001), "c": (4001, 4999)}.items()}


def test_ordinals(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id as v")
    assert all(r.v == r.n for r in with_ordinal(df, "n").collect())
    assert all(999 - r.v == r.n for r in with_ordinal(df, "n", [F.col("v").desc()]).collect())
    assert with_ordinal(df.limit(0), "n").collect() == []
