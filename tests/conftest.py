import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The rows of the three example tables.


@pytest.fixture
def employees(tmp_path):
    p = tmp_path / "employees.csv"
    p.write_text(
        "Employee,EmployeeName,Department,Salary,UpdateDate\n1,Alice,11,300,2020/12/12\n2,Bob,11,600,2020/12/01\n3,Carla,12,900,2020/12/03\n"
        "4,Daniel,12,1000,2020/12/05\n5,Evelyn,13,800,2020/12/03\n6,Ferdinand,21,700,2020/12/05\n7,Amy,11,50000,2020/11/26\n"
    )
    return str(p)


@pytest.fixture
def infos(tmp_path):
    p = tmp_path / "infos.csv"
    p.write_text("Employee,EmployeeName,DayOff,UpdateDate\n1,Alice,20,2020/12/10\n2,Bob,15,2020/12/05\n3,Carla,5,2020/12/03\n7,Angel,30,2020/12/11\n8,Jack,4,2019/03/21\n")
    return str(p)


@pytest.fixture
def wide(tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("family_id,age_mother,dob_child1,dob_child2,dob_child3\n1,30,1998-11-26,2000-01-29,\n2,27,1996-06-22,,\n3,26,2002-07-11,2004-04-05,2007-09-02\n4,32,2004-10-10,2009-08-27,2012-07-21\n5,29,2000-12-05,2005-02-28,\n")
    return str(p)
