"""Whole pipelines from file to file with known results."""

import quern as q
from quern.functions import aggregates as agg
from quern.functions import opaque


def lines(path, keep_order=False):
    got = open(path).read().splitlines()
    return got if keep_order else [got[0], *sorted(got[1:])]


# All results expected below are those of the rows in conftest.py.


def test_in_place_formatter_and_order(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    q.dataframe(employees).set_type("Salary", "double").operate(opaque.negate, "Salary").set_formatter("Salary", lambda c: opaque.concat(c, q.frame.F.lit("!"))).compute(out, order=True)
    assert lines(out, True) == [
        "Employee,EmployeeName,Department,Salary,UpdateDate", "1,Alice,11,-300.0!,2020/12/12", "2,Bob,11,-600.0!,2020/12/01", "3,Carla,12,-900.0!,2020/12/03",
        "4,Daniel,12,-1000.0!,2020/12/05", "5,Evelyn,13,-800.0!,2020/12/03", "6,Ferdinand,21,-700.0!,2020/12/05", "7,Amy,11,-50000.0!,2020/11/26",
    ]


def test_filter_and_derived_column(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    f = q.dataframe(employees).set_type("Salary", "double").filter("Salary", lambda s: s <= 800).operate(opaque.concat, ["Employee", "Salary"], "new-col")
    back = f.compute(out)
    assert lines(out) == ["Employee,EmployeeName,Department,Salary,UpdateDate,new-col", "1,Alice,11,300.0,2020/12/12,1300.0", "2,Bob,11,600.0,2020/12/01,2600.0", "5,Evelyn,13,800.0,2020/12/03,5800.0", "6,Ferdinand,21,700.0,2020/12/05,6700.0"]
    assert back.get_col_names()[-1] == "new-col" and back.to_df().count() == 4


def test_group_maximum(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    q.dataframe(employees).set_type("Salary", "double").group_by(["Department"]).aggregate(agg.max, ["Salary"], ["new-Salary"]).compute(out)
    assert lines(out) == ["Department,new-Salary", "11,50000.0", "12,1000.0", "13,800.0", "21,700.0"]


def test_whole_table_maximum_and_distinct_keys(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    q.dataframe(employees).set_type("Salary", "double").aggregate(agg.max, ["Salary"], ["new-Salary"]).compute(out)
    assert lines(out) == ["new-Salary", "50000.0"]
    q.dataframe(employees).group_by(["Department"]).compute(out)
    assert lines(out) == ["Department", "11", "12", "13", "21"]


def test_select(spark, employees, tmp_path):
    out = str(tmp_path / "o.csv")
    q.dataframe(employees).compute(out, select=["Employee", "EmployeeName"])
    assert lines(out) == ["Employee,EmployeeName", "1,Alice", "2,Bob", "3,Carla", "4,Daniel", "5,Evelyn", "6,Ferdinand", "7,Amy"]


def two(employees, infos):
    return (q.dataframe(p).set_type("UpdateDate", "date:yyyy/MM/dd") for p in (employees, infos))


# The results expected of joins of the rows in conftest.py.
HEAD = "1_Employee,1_EmployeeName,1_Department,1_Salary,1_UpdateDate,2_Employee,2_EmployeeName,2_DayOff,2_UpdateDate"
HEAD_OF_RIGHT = "2_Employee,2_EmployeeName,2_DayOff,2_UpdateDate,1_Employee,1_EmployeeName,1_Department,1_Salary,1_UpdateDate"
LEFT_JOINED = [
    "1,Alice,11,300,2020/12/12,1,Alice,20,2020/12/10",
    "2,Bob,11,600,2020/12/01,2,Bob,15,2020/12/05",
    "3,Carla,12,900,2020/12/03,3,Carla,5,2020/12/03",
    "4,Daniel,12,1000,2020/12/05,,,,",
    "5,Evelyn,13,800,2020/12/03,,,,",
    "6,Ferdinand,21,700,2020/12/05,,,,",
    "7,Amy,11,50000,2020/11/26,7,Angel,30,2020/12/11",
]
RIGHT_JOINED = [
    "1,Alice,20,2020/12/10,1,Alice,11,300,2020/12/12",
    "2,Bob,15,2020/12/05,2,Bob,11,600,2020/12/01",
    "3,Carla,5,2020/12/03,3,Carla,12,900,2020/12/03",
    "7,Angel,30,2020/12/11,7,Amy,11,50000,2020/11/26",
    "8,Jack,4,2019/03/21,,,,,",
]
ROLLED_FORWARD = [
    "1,Alice,11,300,2020/12/12,1,Alice,20,2020/12/10",
    "2,Bob,11,600,2020/12/01,,,,",
    "3,Carla,12,900,2020/12/03,3,Carla,5,2020/12/03",
    "4,Daniel,12,1000,2020/12/05,,,,",
    "5,Evelyn,13,800,2020/12/03,,,,",
    "6,Ferdinand,21,700,2020/12/05,,,,",
    "7,Amy,11,50000,2020/11/26,,,,",
]
ROLLED_BACKWARD = [
    "1,Alice,11,300,2020/12/12,,,,",
    "2,Bob,11,600,2020/12/01,2,Bob,15,2020/12/05",
    "3,Carla,12,900,2020/12/03,3,Carla,5,2020/12/03",
    "4,Daniel,12,1000,2020/12/05,,,,",
    "5,Evelyn,13,800,2020/12/03,,,,",
    "6,Ferdinand,21,700,2020/12/05,,,,",
    "7,Amy,11,50000,2020/11/26,,,,",
]


def test_left_join(spark, employees, infos, tmp_path):
    out = str(tmp_path / "o.csv")
    x, y = two(employees, infos)
    q.left_join(x, y, ["Employee"], ["Employee"]).compute(out)
    assert lines(out) == [HEAD, *LEFT_JOINED]


def test_right_join(spark, employees, infos, tmp_path):
    out = str(tmp_path / "o.csv")
    x, y = two(employees, infos)
    q.right_join(x, y, ["Employee"], ["Employee"]).compute(out)
    assert lines(out) == [HEAD_OF_RIGHT, *RIGHT_JOINED]


def test_inner_join_with_permuted_select(spark, employees, infos, tmp_path):
    out = str(tmp_path / "o.csv")
    x, y = two(employees, infos)
    q.inner_join(x, y, ["Employee"], ["Employee"]).compute(out, select=HEAD_OF_RIGHT.split(","))
    assert lines(out) == [HEAD_OF_RIGHT, *RIGHT_JOINED[:4]]


def test_rolling_joins(spark, employees, infos, tmp_path):
    out = str(tmp_path / "o.csv")
    for join, expected in ((q.rolling_join_forward, ROLLED_FORWARD), (q.rolling_join_backward, ROLLED_BACKWARD)):
        x, y = two(employees, infos)
        join(x, y, ["EmployeeName"], ["EmployeeName"], "UpdateDate", "UpdateDate").compute(out)
        assert lines(out) == [HEAD, *expected]


def test_outer_join(spark, employees, infos, tmp_path):
    out = str(tmp_path / "o.csv")
    x, y = two(employees, infos)
    q.outer_join(x, y, ["Employee"], ["Employee"]).compute(out, select=["1_Department", "2_Employee", "2_EmployeeName"])
    got = lines(out)
    assert len(got) == 9 and ",8,Jack" in got and "13,," in got


def test_melt_and_dcast_are_inverse(spark, wide, tmp_path):
    out, back = str(tmp_path / "long.csv"), str(tmp_path / "wide.csv")
    measures = ["dob_child1", "dob_child2", "dob_child3"]
    long = q.melt(q.dataframe(wide), ["family_id", "age_mother"], measures)
    long.compute(out)
    assert lines(out)[:4] == ["family_id,age_mother,measure,value", "1,30,dob_child1,1998-11-26", "1,30,dob_child2,2000-01-29", "1,30,dob_child3,"]
    q.dcast(q.dataframe(out), ["family_id", "age_mother"], "measure", "value", measures).compute(back)
    assert lines(back) == lines(wide)
