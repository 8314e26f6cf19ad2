"""Semantics of frames: order of evaluation, types, nulls, names, errors, sinks and previews."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

import quern as q
from quern.functions import aggregates as agg
from quern.functions import opaque


def rows(frame):
    return sorted((tuple(r) for r in frame.to_df().collect()), key=repr)


def small(spark, data, schema):
    return q.dataframe(spark.createDataFrame(data, schema))


def test_filters_and_derived_columns_see_parsed_source_values(spark):
    f = small(spark, [("5",), ("-3",), (None,), ("x",)], "a string").operate(opaque.negate, "a").set_type("a", "int")
    f = f.filter("a", lambda a: a > 0).operate(opaque.increment, ["a"], "b")
    assert rows(f) == [(-5, 6)]


def test_only_the_first_operation_gets_all_inputs_and_derived_inputs_must_be_original(spark):
    f = small(spark, [(1, 2)], "a int, b int").operate(lambda a, b: a + b, ["a", "b"], "c").operate(opaque.increment, "c")
    assert rows(f) == [(1, 2, 4)]
    with pytest.raises(q.OperationError):
        f.operate(opaque.negate, ["c"], "d")
    with pytest.raises(q.OperationError):
        f.operate(opaque.negate, ["a"], "b")
    with pytest.raises(q.OperationError):
        f.set_type("c", "int")
    with pytest.raises(ValueError):
        f.set_type("a", "decimal")


def test_renaming_keeps_filters_and_names_may_differ_in_case_only(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("item,Item,a.b\n1,2,3\n4,5,6\n")
    f = q.dataframe(str(p)).filter("item", lambda c: c == "1").rename_col("item", "thing")
    assert f.get_col_names() == ["thing", "Item", "a.b"] and rows(f) == [("1", "2", "3")]
    assert rows(f.reorder_col(["a.b", "thing", "Item"])) == [("3", "1", "2")]
    for bad in (["a.b"], ["a.b", "thing", "thing"]):
        with pytest.raises(q.OperationError):
            f.reorder_col(bad)
    assert rows(f.delete_col("Item")) == [("1", "3")]
    with pytest.raises(q.OperationError):
        f.select_col([])


def test_lenient(spark):
    f = small(spark, [("1", 0), ("x", 2), ("", 1)], "a string, b int").set_type("a", "int").operate(opaque.divide, ["a", "b"], "c")
    assert rows(f) == [(1, 0, None), (None, 1, None), (None, 2, None)]
    g = small(spark, [("1",), ("x",)], "a string")
    assert rows(g.operate(opaque.udf(lambda s: int(s), "int"), "a")) == [(1,), (None,)]
    assert rows(g.operate(opaque.vector(lambda s: s.astype(int), "int"), "a")) == [(1,), (None,)]  # just the cell that fails


@pytest.mark.parametrize(
    "row,error",
    [(("x", 2), "not an int"), (("1", 0), "DIVIDE_BY_ZERO"), (("1", 7), "too far"), (("1", 8), "no series")],
)
def test_strict(spark, row, error):
    def far(a, b):
        if b == 7:
            raise ValueError("too far")
        return a

    def whole(a, b):
        if (b == 8).any():
            raise ValueError("no series")
        return a

    f = small(spark, [row], "a string, b int").set_type("a", "int").operate(opaque.divide, ["a", "b"], "c")
    f = f.operate(opaque.udf(far, "int"), ["a", "b"], "d").operate(opaque.vector(whole, "int"), ["a", "b"], "e")
    assert f.to_df().count() == 1
    with pytest.raises(Exception, match=error):
        f.to_df(strict=True).collect()


def test_data_is_checked_on_demand(spark):
    f = small(spark, [("1",), ("x",)], "a string")
    assert f.set_type("a", "int").get_col_names() == ["a"]
    q.check_data()
    try:
        with pytest.raises(q.OperationError, match="not an int"):
            f.set_type("a", "int")
        with pytest.raises(q.OperationError):
            f.operate(opaque.udf(lambda v: int(v), "int"), "a")
        assert rows(f.operate(opaque.udf(lambda v: v + "!", "string"), "a")) == [("1!",), ("x!",)]
    finally:
        q.check_data(False)


def test_limit_and_head(spark):
    f = small(spark, [(i,) for i in range(20)], "a int").sort(["-", "a"])
    assert f.head(3) == [{"a": 19}, {"a": 18}, {"a": 17}] and len(rows(f.limit(5).limit(9))) == 5 and rows(f.limit(0)) == []
    with pytest.raises(q.OperationError):
        f.limit(-1)


def test_types_and_formatters(spark):
    f = small(spark, [("3.7", " 5 ", "2020/12/01", "2020-01-02 03:04:05"), ("+5", "1e3", "bad", "2020-01-02"), ("99999999999", "NaN", "2021/02/30", "")], "a string, b string, c string, d string")
    f = f.set_type("a", "int").set_type("b", "double").set_type("c", "date:yyyy/MM/dd").set_type("d", "datetime")
    got = f.to_df(formatted=True).collect()
    assert [tuple(r) for r in got] == [(None, "5.0", "2020/12/01", "2020-01-02 03:04:05"), ("5", "1000.0", None, None), (None, "NaN", None, None)]
    g = small(spark, [(1e10,), (1e-5,), (-300.0,)], "x double").to_df(formatted=True)
    assert [r.x for r in g.collect()] == ["1.0E10", "1.0E-5", "-300.0"]
    h = small(spark, [("2020/12/01",)], "a string").set_type("a", "date:yyyy/MM/dd").operate(lambda c: F.year(c), "a")
    assert [r.a for r in h.to_df(formatted=True).collect()] == ["2020"]  # the date's formatter passes other values through


def test_group_keys_functions_and_names(spark):
    def rem10(c):
        return c % 10

    f = small(spark, [(11, "a"), (21, "a"), (12, "b"), (None, None), (None, None)], "n int, s string")
    assert rows(f.group_by([[rem10, "n"], ["s"]]).aggregate("count", "n", "k")) == [(1, "a", 2), (2, "b", 1), (None, None, 2)]
    assert f.group_by([rem10, "n"]).aggregate(agg.max, "n").get_col_names() == ["rem10(n)", "max(n)"]
    assert rows(f.group_by("s")) == [("a",), ("b",), (None,)]
    with pytest.raises(q.OperationError):
        f.group_by("none")
    with pytest.raises(q.OperationError):
        f.group_by("s").aggregate("count", "n", "s")


def test_aggregates(spark):
    f = small(spark, [("x", 1.0), ("x", 2.0), ("x", 2.0), ("x", 7.0), ("y", 5.0), ("z", None), ("z", 3.0), ("w", 4.0), ("w", 4.0)], "k string, v double").group_by("k")
    g = f.aggregate("sd", "v").aggregate("skew", "v").aggregate("median", "v").aggregate("min", "v").aggregate("sum", "v")
    got = {r[0]: tuple(r)[1:] for r in g.to_df().collect()}
    assert got["y"] == (0.0, None, 5.0, 5.0, 5.0) and got["w"] == (0.0, None, 4.0, 4.0, 8.0) and got["z"] == (0.0, None, 3.0, 3.0, 3.0)
    assert got["x"][0] == pytest.approx(2.708012801545) and got["x"][1] == pytest.approx(3 * (3 - 2) / 2.708012801545)
    strict = {r[0]: tuple(r)[1:] for r in g.null_rule("strict").to_df().collect()}
    assert strict["z"] == (None,) * 5 and strict["x"] == got["x"]


def test_listing_aggregates(spark):
    f = small(spark, [("x", 1), ("x", 1), ("x", 2), ("x", 2), ("x", 3), ("y", 9), ("z", None)], "k string, v int").group_by("k")
    assert rows(f.aggregate("mode", "v")) == [("x", 1), ("x", 2), ("y", 9), ("z", None)]
    assert rows(f.aggregate(agg.smallest(2), "v", "lo").aggregate(agg.largest(2), "v", "hi")) == [("x", 1, 2), ("x", 1, 3), ("y", 9, 9)]
    with pytest.raises(Exception, match="different numbers"):
        f.aggregate(agg.smallest3, "v", "lo").aggregate("max", "v", "hi").to_df().collect()
    whole = small(spark, [("x", 1), ("x", 1), ("x", 2)], "k string, v int")
    assert rows(whole.aggregate(agg.largest(2), "v", "hi")) == [(1,), (2,)]


def test_opaque_aggregates_and_folds(spark):
    f = small(spark, [("x", 1), ("x", 5), ("y", None)], "k string, v int")
    spread = opaque.group_udf(lambda vs: max(vs, default=0) - min(vs, default=0) if None not in vs else None, "int", name="spread")
    assert rows(f.group_by("k").aggregate(spread, "v").aggregate("count", "v")) == [("x", 4, 2), ("y", None, 1)]
    every = opaque.group_udf(lambda vs: vs, "int", many=True, name="all")
    assert rows(f.group_by("k").aggregate(every, "v")) == [("x", 1), ("x", 5), ("y", None)]
    total = opaque.fold_udf(lambda a, v: a + (v or 0), "int", 0, name="total")
    merged = opaque.fold_udf(lambda a, v: a + (v or 0), "int", 0, lambda a, b: a + b, name="merged")
    assert rows(f.aggregate(total, "v").aggregate(merged, "v").aggregate("max", "v")) == [(6, 6, 5)]
    empty = f.filter("v", lambda v: v > 100)
    assert rows(empty.aggregate(total, "v").aggregate("max", "v").aggregate("count", "v")) == [(None, None, 0)]


def test_medians_and_skews_against_the_engine(spark):
    rng = random.Random(11)
    values = lambda: rng.choice([None, 0.0, -0.0, float("inf"), float("nan"), rng.gauss(0, 1e4), float(rng.randrange(4)), 10.0 ** rng.randrange(-8, 300), -(10.0 ** rng.randrange(-8, 12))])
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), values()) for _ in range(900)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(3)
    plain = lambda found: sorted((tuple(None if v is None else repr(v) for v in r) for r in found), key=repr)
    f = q.dataframe(df).group_by("k").aggregate("median", "v").aggregate("count", "v", "n")
    want = df.groupBy("k").agg(F.median("v"), F.count(F.lit(1)))
    assert plain(f.to_df().collect()) == plain(want.collect())
    assert plain(q.dataframe(df).group_by("k").aggregate("median", "v").to_df().collect()) == plain(want.select("k", "median(v)").collect())
    strict = df.groupBy("k").agg(F.when(F.count("v") == F.count(F.lit(1)), F.median("v")))
    assert plain(f.null_rule("strict").to_df().select("k", "median(v)").collect()) == plain(strict.collect())
    whole = df.where("abs(v) < 1e6")
    assert plain(q.dataframe(whole).aggregate("median", "v").to_df().collect()) == plain(whole.agg(F.median("v")).collect())
    assert plain(q.dataframe(df.limit(0)).aggregate("median", "v").aggregate("count", "v").to_df().collect()) == [(None, "0")]
    assert q.dataframe(df.limit(0)).group_by("k").aggregate("median", "v").to_df().collect() == []
    skew = {r.k: r["skew(v)"] for r in q.dataframe(whole).group_by("k").aggregate("skew", "v").to_df().collect()}
    for r in whole.groupBy("k").agg((3 * (F.avg("v") - F.median("v"))).alias("top"), F.stddev_samp("v").alias("sd")).collect():
        assert skew[r.k] == (pytest.approx(r.top / r.sd) if r.sd else None)
    texts = spark.createDataFrame([("10",), ("9",), ("8",)], "v string")
    assert rows(q.dataframe(texts).aggregate("median", "v")) == [(9.0,)]


def test_joins_are_null_safe_and_typed(spark):
    a = small(spark, [(1, "p"), (None, "q"), (3, "r")], "k int, x string")
    b = small(spark, [(1, 10), (None, 20), (4, 40), (1, 11)], "k int, y int")
    assert rows(q.inner_join(a, b, "k", "k").to_frame()) == [(1, "p", 1, 10), (1, "p", 1, 11), (None, "q", None, 20)]
    assert len(rows(q.outer_join(a, b, "k", "k").to_frame())) == 5
    assert q.right_join(a, b, "k", "k", ("l", "r")).get_col_names() == ["r_k", "r_y", "l_k", "l_x"]
    with pytest.raises(q.OperationError):
        q.inner_join(a, b, "x", "y")
    with pytest.raises(q.OperationError):
        q.inner_join(a, b, "none", "k")
    with pytest.raises(q.OperationError):
        q.inner_join(a, b, ["k", "x"], "k")
    with pytest.raises(q.OperationError):
        q.left_join(a, b, "k", "k", ("l",))
    with pytest.raises(q.OperationError):
        q.inner_join(a.group_by("k"), b, "k", "k")


def naive_roll(a, b, forward, ok=lambda x, y: True):
    out = []
    for k, t, i in a:
        best = None
        for j, (kb, tb, ib) in enumerate(b):
            if kb == k and t is not None and tb is not None and (tb <= t if forward else tb >= t) and ok(t, tb):
                rank = (-tb if forward else tb, j)
                if best is None or rank < best[0]:
                    best = (rank, ib)
        out.append((i, best and best[1]))
    return sorted(out, key=repr)


def test_crowded_cells_are_cut(spark, monkeypatch):
    from quern.operators import asof

    cuts = [F.floor(F.col("t") / n) for n in (1000, 100, 10)]
    right = spark.range(2000).selectExpr("1 as k", "id as t", "id as v")
    chosen = [asof.fine_enough(right, ["k"], cuts, most).__str__() for most in (1000, 999, 99, 5)]
    assert [c.split(",")[-1].strip(" )>'") or c for c in chosen] == [str(x).split(",")[-1].strip(" )>'") or str(x) for x in (cuts[0], cuts[1], cuts[2], cuts[2])]
    monkeypatch.setattr(asof, "CROWDED", 5)
    for kind in ("string", "timestamp_ntz", "double"):
        make = {"string": "lpad(id, 6, '0')", "timestamp_ntz": "cast(timestamp_seconds(id * 61) as timestamp_ntz)", "double": "cast(id as double)"}[kind]
        a = q.dataframe(spark.range(0, 900, 7).selectExpr("1 as k", f"{make} as t", "id"))
        b = q.dataframe(spark.range(0, 900, 3).selectExpr("1 as k", f"{make} as t", "id"))
        assert {(r["1_id"], r["2_id"]) for r in q.rolling_join_forward(a, b, "k", "k", "t", "t").to_df().collect()} == {(i, i // 3 * 3) for i in range(0, 900, 7)}


@pytest.mark.parametrize("kind,crowded", [("int", 2), ("double", 256), ("double", 3), ("date", 2)])
def test_rolling_joins_against_all_pairs(spark, monkeypatch, kind, crowded):
    import datetime

    from quern.operators import asof

    monkeypatch.setattr(asof, "CROWDED", crowded)

    rng = random.Random(kind)
    make = (lambda v: None if v is None else datetime.date(2020, 1, 1) + datetime.timedelta(days=v * 5)) if kind == "date" else (lambda v: v if v is None or kind == "int" else float(v))
    some = lambda n: [(rng.choice([None, 1, 2]), rng.choice([None, *range(25)]), i) for i in range(n)]
    a, b = some(120), some(90)
    schema = f"k int, t {kind}, i int"
    fa, fb = (small(spark, [(k, make(t), i) for k, t, i in x], schema) for x in (a, b))
    fb = q.dataframe(fb.to_df().coalesce(1))
    for join, forward in ((q.rolling_join_forward, True), (q.rolling_join_backward, False)):
        got = join(fa, fb, "k", "k", "t", "t").to_df()
        assert sorted(((r["1_i"], r["2_i"]) for r in got.collect()), key=repr) == naive_roll(a, b, forward)
    if kind == "int":
        far = lambda x, y: abs(x - y) >= 3  # noqa: E731  the nearest fails, a farther one counts
        for join, forward in ((q.rolling_join_forward, True), (q.rolling_join_backward, False)):
            got = join(fa, fb, "k", "k", "t", "t", limit=lambda x, y: F.abs(x - y) >= 3).to_df()
            assert sorted(((r["1_i"], r["2_i"]) for r in got.collect()), key=repr) == naive_roll(a, b, forward, far)
            got = join(fa, fb, "k", "k", "t", "t", limit=lambda x, y: F.abs(x - y) <= 1, nearest_only=True).to_df()
            assert sorted(((r["1_i"], r["2_i"]) for r in got.collect()), key=repr) == naive_roll(a, b, forward, lambda x, y: abs(x - y) <= 1)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = q.rolling_join_backward(fa, fb, "k", "k", "t", "t", tolerance=2).to_df()
        assert sorted(((r["1_i"], r["2_i"]) for r in got.collect()), key=repr) == naive_roll(a, b, False, lambda x, y: abs(x - y) <= 2)


def test_sort_and_its_list(spark):
    f = small(spark, [(1, "b"), (None, "a"), (1, "c")], "n int, s string")
    assert [tuple(r) for r in f.sort(["-", "n", "+", "s"]).to_df().collect()] == [(1, "b"), (1, "c"), (None, "a")]
    assert f.sort(["+", "n"]).to_df().collect()[0].n is None
    for bad in (["n", "+"], ["+"], [], ["+", "none"]):
        with pytest.raises(q.OperationError):
            f.sort(bad)


def test_names_of_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('date,item,date\n1,"a ""q"", b",\n2\n3,c,d,e\n')
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        f = q.dataframe(str(p))
    assert said and f.get_col_names() == ["date1", "item", "date2"]
    assert rows(f) == [("1", 'a "q", b', ""), ("2", "", ""), ("3", "c", "d")]
    assert q.size_in_bytes(f) == p.stat().st_size and q.size_in_bytes(small(spark, [(1,)], "a int")) is None
    p.write_text("1,2\n3,4\n")
    g = q.dataframe(str(p), if_header=False)
    assert g.get_col_names() == ["Col_1", "Col_2"] and rows(g) == [("1", "2"), ("3", "4")]
    p.write_text("a;b\n1;2\n")
    assert rows(q.dataframe(str(p), sep=";")) == [("1", "2")]


def test_rows_and_endless_sources(spark):
    assert rows(q.dataframe([["a", "b"], [1, 2], [3]])) == [("1", "2"), ("3", None)]

    def endless():
        i = 0
        while True:
            i += 1
            yield [i, 1]

    f = q.dataframe(endless, if_header=False).set_type("Col_1", "int").filter("Col_1", lambda c: c % 2 == 0)
    assert f.preview(10, 3) == [{"Col_1": 2, "Col_2": "1"}, {"Col_1": 4, "Col_2": "1"}, {"Col_1": 6, "Col_2": "1"}]


def test_preview_takes_the_sample_first(spark, employees, capsys):
    f = q.dataframe(employees).set_type("Salary", "double").filter("Salary", lambda s: s > 800)
    assert [r["Employee"] for r in f.preview(3, 10)] == ["3"]
    assert f.preview(100, 1, formatted=True)[0]["Salary"] == "900.0"
    assert f.group_by("Department").aggregate("max", "Salary", "m").preview() != []
    shown = f.print_df(1000, 2)
    assert "..." in shown and "double" in shown and shown in capsys.readouterr().out
    j = q.inner_join(f, f, "Employee", "Employee")
    assert len(j.preview(1000, 2)) == 2 and "1_Employee" in j.print_df()


def test_sinks(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    f = q.dataframe(employees)
    for _ in range(2):  # an output is replaced
        f.compute(out, exclude=["Department", "UpdateDate"], header=["a", "b", "c"])
    assert open(out).read().startswith("a,b,c\n1,Alice,300\n")
    f.compute(out, select="Employee", header=False)
    assert open(out).read().splitlines() == list("1234567")
    f.compute(out, select=["Employee", "EmployeeName"], output=lambda cells: F.concat_ws(" | ", *cells))
    assert open(out).read().splitlines()[:2] == ["Employee,EmployeeName", "1 | Alice"]
    f.compute(out, select=["Employee", "EmployeeName", "Salary"], melt=lambda r: [[r[0], r[1]], [r[0], r[2]]], header=["id", "v"])
    assert open(out).read().splitlines()[:3] == ["id,v", "1,Alice", "1,300"]
    assert f.compute(None, select=["Employee"])[:2] == [["Employee"], ["1"]]
    assert f.compute(header=False, select=["Employee"], in_memory=True)[0] == ["1"]
    back = f.compute(str(tmp_path / "parts"), partitioned=True, workers=2)
    assert back.to_df().count() == 7
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".quern")]
    none = f.filter("Employee", lambda c: c == "99").compute(out)
    assert open(out).read() == "Employee,EmployeeName,Department,Salary,UpdateDate\n" and none.to_df().count() == 0
    for bad in ({"select": "a", "exclude": "b"}, {"select": "none"}, {"exclude": f.get_col_names()}, {"header": ["x"]}):
        with pytest.raises(q.OperationError):
            f.compute(out, **bad)
    with pytest.raises(q.OperationError):
        f.compute(employees)
    with pytest.raises(q.OperationError):
        q.inner_join(f, f, "Employee", "Employee").compute(employees)


def test_formats_of_outputs(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a;b\n1;x\n2;y,z\n")
    f = q.dataframe(str(p), sep=";").set_type("a", "int")
    f.compute(str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == "a;b\n1;x\n2;y,z\n"  # as the source
    tsv = f.compute(str(tmp_path / "o.tsv"))
    assert (tmp_path / "o.tsv").read_text() == "a\tb\n1\tx\n2\ty,z\n" and rows(tsv) == [("1", "x"), ("2", "y,z")]
    f.compute(str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text() == 'a,b\n1,x\n2,"y,z"\n'
    for ending in ("parquet", "orc", "json"):
        back = f.compute(str(tmp_path / f"o.{ending}"), header=["n", "t"])
        assert dict(back.to_df().dtypes) == {"n": "bigint" if ending == "json" else "int", "t": "string"} and rows(back) == [(1, "x"), (2, "y,z")]


def test_sources_of_the_user(spark, tmp_path):
    source = q.Source(lambda: iter([["a", "b"], [1, 2], [3, 4]]), output=lambda cells: F.concat_ws("/", *cells), size=99, path=str(tmp_path / "own.mine"))
    f = q.dataframe(source)
    assert rows(f) == [("1", "2"), ("3", "4")] and q.size_in_bytes(f) == 99
    f.compute(str(tmp_path / "o.mine"), header=False)
    assert (tmp_path / "o.mine").read_text() == "1/2\n3/4\n"
    f.compute(str(tmp_path / "o.csv"), header=False)
    assert (tmp_path / "o.csv").read_text() == "1,2\n3,4\n"
    with pytest.raises(q.OperationError):
        f.compute(str(tmp_path / "own.mine"))
    assert rows(q.dataframe(q.Source(spark.range(2)))) == [(0,), (1,)]


def test_order_of_the_source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for k in range(6):  # the later the file the larger, so that Spark reads it sooner
        lines = [f"{k}-{i}" for i in range(10 ** min(k, 4))]
        (folder / f"{k}.csv").write_text("a\n" + "\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        f = q.dataframe(str(folder)).filter("a", lambda c: c != "3-7")
        want.remove("3-7")
        plain = [r[0] for r in f.to_df().collect()]
        out = tmp_path / "o.csv"
        f.compute(str(out), order=True, workers=2)
        assert plain != want and sorted(plain) == sorted(want) and out.read_text().split("\n") == ["a", *want, ""]
        assert f.compute(order=True, header=False) == [[w] for w in want]
        f.sort(["-", "a"]).limit(3).compute(str(out), workers=1)
        assert out.read_text().split() == ["a", "5-9999", "5-9998", "5-9997"]
        assert f.get_col_names() == ["a"] and f.operate(opaque.concat, ["a"], "b").in_source_order().columns == ["a", "b"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_results_stay_parts_and_file_systems_may_join(spark, tmp_path, monkeypatch):
    from quern.sources import sinks

    lines = spark.range(0, 9, 1, 3).selectExpr("concat('v', id) as value")
    sinks.write_lines(lines, str(tmp_path / "o"), "h", copied=3)
    assert sorted(x for p in (tmp_path / "o").glob("part-*") for x in p.read_text().split()) == ["h"] * 3 + [f"v{i}" for i in range(9)]
    assert sorted(rows(q.dataframe(str(tmp_path / "o")))) == [(f"v{i}",) for i in range(9)]
    sinks.write_lines(lines, str(tmp_path / "o"), "h")
    assert (tmp_path / "o").read_text().split() == ["h", *(f"v{i}" for i in range(9))]
    sinks.write_lines(lines.limit(0), str(tmp_path / "e"), "h", partitioned=True)
    assert q.dataframe(str(tmp_path / "e")).get_col_names() == ["h"] and rows(q.dataframe(str(tmp_path / "e"))) == []
    with pytest.raises(Exception, match="Concat"):  # joining is left to the file system where it says that it can
        monkeypatch.setattr(sinks, "_joins", lambda fs, path: True)
        sinks.write_lines(lines, str(tmp_path / "c"), None)
    assert not (tmp_path / "c").exists()


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quern.sources.shared import shared_folder

    def session(master, **conf):
        get = lambda k, default=None: conf.get(k.replace(".", "_"), default)
        return SimpleNamespace(conf=SimpleNamespace(get=get, set=lambda *_: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))

    assert shared_folder(session("spark://host:7077", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[4]")).startswith("file:")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(q.OperationError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_sheets(spark, tmp_path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def sheet(name, body):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')

    sheet("a.xlsx", '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="str"><v>ok</v></c></row>'
          '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="C3" t="b"><v>0</v></c></row>')  # fmt: skip
    f = q.dataframe(str(tmp_path / "a.xlsx"))
    assert f.get_col_names() == ["name", "n", "ok"] and rows(f) == [("", "", "FALSE"), ("Anna", "1.5", "TRUE")]
    assert rows(f.set_type("n", "double").filter("n", lambda c: c > 1).select_col("n")) == [(1.5,)]
    assert len(rows(q.dataframe(str(tmp_path / "a.xlsx"), if_header=False))) == 3
    sheet("b.xlsx", "")
    with pytest.raises(q.OperationError):
        q.dataframe(str(tmp_path / "b.xlsx"))


def test_cells_that_need_quotes_come_back(spark, tmp_path):
    out = str(tmp_path / "o.csv")
    data = [("a,b", 'say "hi"'), ("", None), (" x ", "y")]
    small(spark, data, "p string, q string").compute(out)
    assert rows(q.dataframe(out)) == [(" x ", "y"), ("", ""), ("a,b", 'say "hi"')]


def test_bind(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("date,item,price\n" + "".join(f"d{i},i{i},{i}\n" for i in range(6)))
    b.write_text("date,cust,Item,sold\n" + "".join(f"e{i},c{i},j{i},{i}\n" for i in range(5)))
    r = q.rbind_csv(str(a), str(b))
    assert r.get_col_names() == ["date", "item", "price"] and len(rows(r)) == 11 and ("e4", "c4", "j4") in rows(r)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        c = q.cbind_csv(str(a), str(b))
    assert c.get_col_names() == ["date1", "item", "price", "date2", "cust", "Item", "sold"]
    assert rows(c) == sorted((f"d{i}", f"i{i}", str(i), f"e{i}", f"c{i}", f"j{i}", str(i)) for i in range(5))
    with pytest.raises(q.OperationError):
        q.rbind(q.dataframe(str(b)), q.dataframe(str(a)))


def test_dcast_last_wins_and_absent_cells(spark):
    f = q.dataframe(spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "z")], "id int, m string, v string").coalesce(1))
    assert rows(q.dcast(f, ["id"], "m", "v", ["a", "b"], ["A", "B"])) == [(1, "y", None), (2, None, "z")]
    with pytest.raises(q.OperationError):
        q.dcast(f, ["id"], "m", "v", ["a", "b"], ["A"])


def test_debug_mode_puts_checks_off(spark):
    f = small(spark, [("a",)], "s string")
    with pytest.raises(q.OperationError):
        f.operate(lambda c: F.abs(F.array(c)), "s")
    q.enable_debug()
    try:
        f.operate(lambda c: F.abs(F.array(c)), "s")
    finally:
        q.disable_debug()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "'x' as c").write.parquet(str(tmp_path / "t.parquet"))
    f = q.dataframe(str(tmp_path / "t.parquet")).filter("id", lambda c: c > 90).rename_col("b", "twice").select_col(["twice"])
    plan = f.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "c:string" not in plan and f.to_df().count() == 9
