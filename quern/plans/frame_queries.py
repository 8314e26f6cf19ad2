"""Queries of the frame API over the tables of a folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cbind, dataframe, dcast, inner_join, left_join, melt, outer_join, rbind, right_join, rolling_join_backward, rolling_join_forward
from ..frame import Frame
from ..functions import aggregates as agg
from ..functions import opaque
from ..sources.shared import deleted_at_exit, shared_folder
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def frame(spark: SparkSession, d: str, name: str, *columns: str) -> Frame:
    """A frame over a table, of some of its columns if the operator needs no others."""
    df = table(spark, d, name)
    return dataframe(df.select(*columns) if columns else df)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------ projection, typing, predicates


@query("""select l_returnflag, max(round(l_extendedprice * (1 - l_discount), 4)) as max_net from lineitem where l_quantity <= 30 group by 1""")
def flagship(spark, d):
    f = frame(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    f = f.set_type("l_extendedprice", "double").filter("l_quantity", lambda q: q <= 30)
    f = f.operate(lambda p, x: F.round(p * (1 - x), 4), ["l_extendedprice", "l_discount"], "net")
    return f.group_by("l_returnflag").aggregate(agg.max, "net", "max_net").to_df()


@query("select * from customer where c_acctbal <= 800 and c_mktsegment = 'BUILDING'")
def filter_multi(spark, d):
    return frame(spark, d, "customer").filter(["c_acctbal", "c_mktsegment"], lambda a, s: (a <= 800) & (s == "BUILDING")).to_df()


@query("select * from customer where c_acctbal <= 800 and c_mktsegment = 'BUILDING'")
def filter_chained(spark, d):
    return frame(spark, d, "customer").filter("c_acctbal", lambda a: a <= 800).filter("c_mktsegment", lambda s: s == "BUILDING").to_df()


@query("select c_custkey, c_name, c_nationkey, -c_acctbal as c_acctbal, c_mktsegment from customer where c_acctbal > 0")
def filter_sees_source(spark, d):
    return frame(spark, d, "customer").operate(opaque.negate, "c_acctbal").filter("c_acctbal", lambda a: a > 0).to_df()


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_totalprice * 2 as twice from orders where o_totalprice * 2 > 300000")
def filter_derived(spark, d):
    return frame(spark, d, "orders").operate(lambda p: p * 2, "o_totalprice", "twice").filter("twice", lambda t: t > 300000).to_df()


@query("select c_custkey, c_name, c_nationkey, -c_acctbal as c_acctbal, c_mktsegment from customer")
def operate_inplace(spark, d):
    return frame(spark, d, "customer").operate(opaque.negate, "c_acctbal").to_df()


@query("select l_orderkey, l_quantity + 10 + 1 as l_quantity from lineitem")
def operate_chain(spark, d):
    return frame(spark, d, "lineitem", "l_orderkey", "l_quantity").operate(lambda q: F.when(q.isNotNull(), q + 10).otherwise(0), "l_quantity").operate(opaque.increment, "l_quantity").to_df()


@query("select c_custkey, -c_acctbal as c_acctbal, concat(c_custkey, c_acctbal) as both from customer")
def derive_from_source(spark, d):
    f = frame(spark, d, "customer", "c_custkey", "c_acctbal")
    return f.operate(opaque.negate, "c_acctbal").operate(opaque.concat, ["c_custkey", "c_acctbal"], "both").to_df()


@query("select s_suppkey, case when s_acctbal < 0 then 'debt' when s_nationkey = 7 then 'seven' else 'other' end as kind from supplier")
def derive_conditional(spark, d):
    f = frame(spark, d, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    f = f.operate(lambda a, n: F.when(a < 0, "debt").when(n == 7, "seven").otherwise("other"), ["s_acctbal", "s_nationkey"], "kind")
    return f.select_col(["s_suppkey", "kind"]).to_df()


@query("select l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) as per_discount from lineitem")
def lenient_divide(spark, d):
    f = frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount").operate(opaque.divide, ["l_quantity", "l_discount"], "per_discount")
    return f.select_col(["l_orderkey", "l_linenumber", "per_discount"]).to_df()


@query("select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as o_orderdate from orders")
def date_format(spark, d):
    f = frame(spark, d, "orders", "o_orderkey", "o_orderdate").set_formatter("o_orderdate", lambda c: F.date_format(c, "yyyy/MM/dd"))
    return f.to_df(formatted=True).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("""select emp_row, case when regexp_matches("Department", '^[+-]?[0-9]+$') then try_cast("Department" as integer) end as "Department",
    try_cast("Salary" as double) as "Salary", case when regexp_matches("UpdateDate", '^[0-9]{4}/[0-9]{2}/[0-9]{2}$') then cast(try_strptime("UpdateDate", '%Y/%m/%d') as date) end as "UpdateDate" from employees""")
def set_types(spark, d):
    """Text columns to int, double and date; what doesn't parse is null."""
    f = frame(spark, d, "employees", "emp_row", "Department", "Salary", "UpdateDate")
    return f.set_type("Department", "int").set_type("Salary", "double").set_type("UpdateDate", "date:yyyy/MM/dd").to_df()


@query("select sale_id, cast(length(item) as integer) as item from sales")
def set_parser(spark, d):
    return frame(spark, d, "sales", "sale_id", "item").set_parser("item", F.length).to_df()


@query("select p_partkey, concat(p_size, '!') as p_size from part")
def set_formatter(spark, d):
    f = frame(spark, d, "part", "p_partkey", "p_size").set_formatter("p_size", lambda c: opaque.concat(c, F.lit("!")))
    return f.to_df(formatted=True).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("select n_name as nation, n_regionkey as region, n_nationkey from nation where n_regionkey > 1")
def rename_reorder(spark, d):
    f = frame(spark, d, "nation").filter("n_regionkey", lambda r: r > 1).rename_col("n_name", "nation").rename_col("n_regionkey", "region")
    return f.reorder_col(["nation", "region", "n_nationkey"]).to_df()


@query("select s_suppkey, s_name from supplier")
def delete_columns(spark, d):
    return frame(spark, d, "supplier").delete_col(["s_nationkey", "s_acctbal"]).to_df()


@query("select event_id, upper(event_type) as event_type, length(props) as size from events")
def opaque_udf(spark, d):
    f = frame(spark, d, "events", "event_id", "event_type", "props").operate(opaque.udf(lambda s: s.upper(), "string", "upper"), "event_type")
    return f.operate(opaque.vector(lambda s: s.str.len().astype("Int64"), "bigint", "size"), "props", "size").select_col(["event_id", "event_type", "size"]).to_df()


# ------------------------------------------------------------ groups and folds


@query("""select l_orderkey % 10 as "rem10(l_orderkey)", l_returnflag, max(l_quantity) as "max(l_quantity)" from lineitem group by 1, 2""")
def groupby_keyfn(spark, d):
    def rem10(c):
        return c % 10

    return frame(spark, d, "lineitem").group_by([[rem10, "l_orderkey"], "l_returnflag"]).aggregate(agg.max, "l_quantity").to_df()


@query("select distinct l_returnflag, l_linestatus from lineitem")
def groupby_distinct(spark, d):
    return frame(spark, d, "lineitem").group_by(["l_returnflag", "l_linestatus"]).to_df()


@query("""select l_returnflag, min(l_quantity) as low, count(*) as n, round(sum(l_extendedprice), 2) as total, round(avg(l_quantity), 6) as mean,
    median(l_extendedprice) as middle, round(coalesce(stddev_samp(l_quantity), 0), 6) as sd from lineitem group by 1""")
def groupby_stats(spark, d):
    f = frame(spark, d, "lineitem").group_by("l_returnflag").aggregate("min", "l_quantity", "low").aggregate("count", "l_quantity", "n").aggregate("sum", "l_extendedprice", "total")
    f = f.aggregate("mean", "l_quantity", "mean").aggregate("median", "l_extendedprice", "middle").aggregate("sd", "l_quantity", "sd")
    return rounded(rounded(f.to_df(), 2, "total"), 6, "mean", "sd")


@query("select p_brand, round(3 * (avg(p_retailprice) - median(p_retailprice)) / nullif(stddev_samp(p_retailprice), 0), 6) as skew from part group by 1")
def groupby_skew(spark, d):
    return rounded(frame(spark, d, "part").group_by("p_brand").aggregate("skew", "p_retailprice", "skew").to_df(), 6, "skew")


@query("select p_brand, p_size as mode from (select p_brand, p_size, rank() over (partition by p_brand order by n desc) r from (select p_brand, p_size, count(*) n from part group by all)) where r = 1")
def groupby_mode(spark, d):
    return frame(spark, d, "part").group_by("p_brand").aggregate("mode", "p_size", "mode").to_df()


@query("select p_brand, p_retailprice as lowest from (select *, row_number() over (partition by p_brand order by p_retailprice) r from part) where r <= 3")
def groupby_smallest3(spark, d):
    return frame(spark, d, "part").group_by("p_brand").aggregate(agg.smallest3, "p_retailprice", "lowest").to_df()


@query("""with l as (select p_brand, p_retailprice lo, row_number() over (partition by p_brand order by p_retailprice) r from part),
    h as (select p_brand, p_retailprice hi, row_number() over (partition by p_brand order by p_retailprice desc) r from part)
    select p_brand, lo, hi from l join h using (p_brand, r) where r <= 3""")
def groupby_lo3_hi3(spark, d):
    return frame(spark, d, "part").group_by("p_brand").aggregate(agg.smallest3, "p_retailprice", "lo").aggregate(agg.largest(3), "p_retailprice", "hi").to_df()


@query("select c_mktsegment, c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) as spread from customer group by 1, 2")
def groupby_user_expression(spark, d):
    spread = agg.of_expression("spread", lambda c: F.max(c) - F.min(c))
    return rounded(frame(spark, d, "customer").group_by(["c_mktsegment", "c_nationkey"]).aggregate(spread, "c_acctbal", "spread").to_df(), 6, "spread")


@query("select s_nationkey, count(distinct s_name) as names, max(s_acctbal) as best from supplier group by 1")
def groupby_opaque(spark, d):
    names = opaque.group_udf(lambda values: len(set(values)), "bigint", name="names")
    return frame(spark, d, "supplier").group_by("s_nationkey").aggregate(names, "s_name", "names").aggregate("max", "s_acctbal", "best").to_df()


@query("""select max(l_extendedprice) as "max(l_extendedprice)", min(l_extendedprice) as "min(l_extendedprice)", count(*) as "count(l_extendedprice)",
    round(sum(l_quantity), 2) as total from lineitem""")
def fold_multi(spark, d):
    f = frame(spark, d, "lineitem").aggregate("max", "l_extendedprice").aggregate("min", "l_extendedprice").aggregate("count", "l_extendedprice").aggregate("sum", "l_quantity", "total")
    return rounded(f.to_df(), 2, "total")


@query("select l_extendedprice as lowest from lineitem order by 1 limit 3")
def fold_smallest3(spark, d):
    return frame(spark, d, "lineitem").aggregate(agg.smallest3, "l_extendedprice", "lowest").to_df()


@query("select l_extendedprice as highest from lineitem order by 1 desc limit 5")
def fold_largest5(spark, d):
    return frame(spark, d, "lineitem").aggregate(agg.largest(5), "l_extendedprice", "highest").to_df()


@query("select cast(sum(l_linenumber) as bigint) as total from lineitem")
def fold_user(spark, d):
    total = opaque.fold_udf(lambda acc, v: acc + v, "bigint", 0, lambda a, b: a + b, name="total")
    return frame(spark, d, "lineitem", "l_linenumber").aggregate(total, "l_linenumber", "total").to_df()


@query("""with l as (select l_extendedprice lo, row_number() over (order by l_extendedprice) r from lineitem), h as (select l_extendedprice hi, row_number() over (order by l_extendedprice desc) r from lineitem)
    select lo, hi from l join h using (r) where r <= 3""")
def fold_lo3_hi3(spark, d):
    return frame(spark, d, "lineitem").aggregate(agg.smallest3, "l_extendedprice", "lo").aggregate(agg.largest3, "l_extendedprice", "hi").to_df()


# ------------------------------------------------------------ sinks


def _scratch(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}.csv"
    deleted_at_exit(spark, path)
    return path


@query("select cast(c_custkey as varchar) as key, c_mktsegment as segment, cast(c_acctbal as varchar) as balance from customer where c_acctbal > 0")
def sink_round_trip(spark, d):
    """A frame written to one text file under other names, and the file read again."""
    f = frame(spark, d, "customer").filter("c_acctbal", lambda a: a > 0)
    return f.compute(_scratch(spark), select=["c_custkey", "c_mktsegment", "c_acctbal"], header=["key", "segment", "balance"]).to_df()


@query("""select cast(l_orderkey as varchar) as id, unnest([cast(l_partkey as varchar), cast(l_quantity as varchar)]) as cell from lineitem""")
def sink_melt(spark, d):
    """Each row becomes several as it is written."""
    f = frame(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    return f.compute(_scratch(spark), melt=lambda r: [[r[0], r[1]], [r[0], r[2]]], header=["id", "cell"]).to_df()


# ------------------------------------------------------------ joins

_O = "a.o_orderkey as \"1_o_orderkey\", a.o_custkey as \"1_o_custkey\", a.o_totalprice as \"1_o_totalprice\""
_C = "b.c_custkey as \"2_c_custkey\", b.c_name as \"2_c_name\", b.c_nationkey as \"2_c_nationkey\""


def _orders(spark, d):
    return frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")


def _customers(spark, d):
    return frame(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")


@query(f"select {_O}, {_C} from orders a join customer b on a.o_custkey is not distinct from b.c_custkey")
def join_inner(spark, d):
    return inner_join(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey").to_df()


@query(f"select {_O}, {_C} from orders a left join (select * from customer where c_acctbal > 0) b on a.o_custkey is not distinct from b.c_custkey")
def join_left(spark, d):
    c = frame(spark, d, "customer").filter("c_acctbal", lambda x: x > 0).select_col(["c_custkey", "c_name", "c_nationkey"])
    return left_join(_orders(spark, d), c, "o_custkey", "c_custkey").to_df()


@query(f"select {_C}, {_O} from customer b left join orders a on a.o_custkey is not distinct from b.c_custkey")
def join_right(spark, d):
    return right_join(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey").to_df()


@query("""select a.k is null as a_missing, b.k is null as b_missing, count(*) as n from (select o_custkey k from orders where o_totalprice > 100000) a
    full join (select c_custkey k from customer where c_acctbal > 0) b on a.k is not distinct from b.k group by 1, 2""")
def join_outer_counts(spark, d):
    a = frame(spark, d, "orders").filter("o_totalprice", lambda p: p > 100000)
    b = frame(spark, d, "customer").filter("c_acctbal", lambda p: p > 0)
    both = outer_join(a, b, "o_custkey", "c_custkey").to_frame()
    f = both.group_by([[opaque.Op("a", F.isnull, F.isnull), "1_o_custkey"], [opaque.Op("b", F.isnull, F.isnull), "2_c_custkey"]]).aggregate("count", "1_o_custkey", "n")
    return f.to_df().toDF("a_missing", "b_missing", "n")


@query("""select a.s_suppkey as "1_s_suppkey", b.c_custkey as "2_c_custkey" from supplier a join customer b
    on a.s_suppkey % 10 is not distinct from b.c_custkey % 10 and a.s_nationkey is not distinct from b.c_nationkey""")
def join_keyfn(spark, d):
    def rem10(c):
        return c % 10

    j = inner_join(frame(spark, d, "supplier"), frame(spark, d, "customer"), [[rem10, "s_suppkey"], "s_nationkey"], [[rem10, "c_custkey"], ["c_nationkey"]])
    return j.to_df().select("1_s_suppkey", "2_c_custkey")


@query("""select a.n_name as "x_n_name", b.r_name as "y_r_name" from nation a join region b on a.n_regionkey = b.r_regionkey""")
def join_prefix(spark, d):
    return inner_join(frame(spark, d, "nation"), frame(spark, d, "region"), "n_regionkey", "r_regionkey", ("x", "y")).to_df().select("x_n_name", "y_r_name")


@query("""select a."Employee" as "1_Employee", a.emp_row as "1_emp_row", b.info_row as "2_info_row" from employees a join employee_info b on a."Employee" is not distinct from b."Employee" """)
def join_null_keys(spark, d):
    a, b = frame(spark, d, "employees", "Employee", "emp_row"), frame(spark, d, "employee_info", "Employee", "info_row")
    return inner_join(a, b, "Employee", "Employee").to_df().select("1_Employee", "1_emp_row", "2_info_row")


@query("""select a."EmployeeName" as "1_EmployeeName", a.emp_row as "1_emp_row", b.info_row as "2_info_row"
    from employees a join employee_info b on a."EmployeeName" is not distinct from b.EmployeeName""")
def join_null_keys_whole(spark, d):
    """Null keys equal each other; both tables whole, with null keys on both sides."""
    a = frame(spark, d, "employees", "EmployeeName", "emp_row")
    b = frame(spark, d, "employee_info", "EmployeeName", "info_row")
    return inner_join(a, b, "EmployeeName", "EmployeeName").to_df().select("1_EmployeeName", "1_emp_row", "2_info_row")


def _events(spark, d, kind):
    return frame(spark, d, "events", "event_id", "ts", "user_id", "event_type").filter("event_type", lambda t: t == kind)


@query("""select a.event_id, b.ts as matched from (select * from events where event_type = 'click') a
    asof left join (select * from events where event_type = 'error') b on a.user_id = b.user_id and a.ts >= b.ts""")
def roll_forward(spark, d):
    j = rolling_join_forward(_events(spark, d, "click"), _events(spark, d, "error"), "user_id", "user_id", "ts", "ts")
    return j.to_df().select(F.col("1_event_id").alias("event_id"), F.col("2_ts").alias("matched"))


@query("""select a.event_id, b.ts as matched from (select * from events where event_type = 'click') a
    asof left join (select * from events where event_type = 'error') b on a.user_id = b.user_id and a.ts <= b.ts""")
def roll_backward(spark, d):
    j = rolling_join_backward(_events(spark, d, "click"), _events(spark, d, "error"), "user_id", "user_id", "ts", "ts")
    return j.to_df().select(F.col("1_event_id").alias("event_id"), F.col("2_ts").alias("matched"))


@query("""select event_id, case when gap <= 21600 then matched end as matched from (select a.event_id, b.ts as matched, epoch(a.ts) - epoch(b.ts) as gap
    from (select * from events where event_type = 'purchase') a asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.ts >= b.ts)""")
def roll_tolerance(spark, d):
    import datetime

    j = rolling_join_forward(_events(spark, d, "purchase"), _events(spark, d, "click"), "user_id", "user_id", "ts", "ts", tolerance=datetime.timedelta(hours=6))
    return j.to_df().select(F.col("1_event_id").alias("event_id"), F.col("2_ts").alias("matched"))


@query("""select event_id, b_id from (select a.event_id, b.event_id b_id, row_number() over (partition by a.event_id order by b.ts desc nulls last, b.event_id) r
    from (select * from events where event_type = 'purchase') a left join (select * from events where event_type = 'click') b
    on a.user_id = b.user_id and b.ts <= a.ts and a.ts - b.ts <= interval 6 hours) where r = 1""")
def roll_limit(spark, d):
    j = rolling_join_forward(_events(spark, d, "purchase"), _events(spark, d, "click"), "user_id", "user_id", "ts", "ts", limit=lambda a, b: a - b <= F.expr("interval 6 hours"), nearest_only=True)
    return j.to_df().select(F.col("1_event_id").alias("event_id"), F.col("2_event_id").alias("b_id"))


@query("""select o_orderkey, s_suppkey, s_acctbal as matched from (select a.o_orderkey, b.s_suppkey, b.s_acctbal, row_number() over (partition by a.o_orderkey order by b.s_acctbal desc nulls last, b.s_suppkey) r
    from orders a left join supplier b on a.o_custkey % 25 = b.s_nationkey and b.s_acctbal <= a.o_totalprice / 50) where r = 1""")
def roll_numeric(spark, d):
    def rem25(c):
        return (c % 25).cast("int")

    a = _orders(spark, d).operate(lambda p: p / 50, "o_totalprice", "share")
    j = rolling_join_forward(a, frame(spark, d, "supplier"), [rem25, "o_custkey"], "s_nationkey", "share", "s_acctbal")
    return j.to_df().select(F.col("1_o_orderkey").alias("o_orderkey"), F.col("2_s_suppkey").alias("s_suppkey"), F.col("2_s_acctbal").alias("matched"))


# ------------------------------------------------------------ bind, reshape, sort


@query("select s_suppkey, s_name, s_nationkey from supplier union all select c_custkey, c_name, c_nationkey from customer")
def rbind_rows(spark, d):
    return rbind(frame(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey"), _customers(spark, d)).to_df()


@query("""select c_custkey, c_name, s_suppkey, s_name from (select *, row_number() over (order by c_custkey) r from customer)
    join (select *, row_number() over (order by s_suppkey) r from supplier) using (r)""")
def cbind_rows(spark, d):
    a, b = frame(spark, d, "customer", "c_custkey", "c_name"), frame(spark, d, "supplier", "s_suppkey", "s_name")
    return cbind(a, b, order_by=[["c_custkey"], ["s_suppkey"]]).to_df()


@query("""select l_orderkey, l_partkey, u.* from lineitem, lateral (values ('l_quantity', cast(l_quantity as varchar)), ('l_shipmode', l_linestatus), ('l_returnflag', l_returnflag)) u(measure, value)""")
def melt_columns(spark, d):
    f = frame(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag").rename_col("l_linestatus", "l_shipmode")
    out = melt(f, ["l_orderkey", "l_partkey"], ["l_quantity", "l_shipmode", "l_returnflag"]).to_df()
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey")})


@query("""select o_orderpriority, max(o_totalprice) filter (o_orderstatus = 'F') as "F", max(o_totalprice) filter (o_orderstatus = 'O') as "O", max(o_totalprice) filter (o_orderstatus = 'X') as absent
    from (select o_orderpriority, o_orderstatus, max(o_totalprice) as o_totalprice from orders group by 1, 2) group by 1""")
def dcast_columns(spark, d):
    best = frame(spark, d, "orders").group_by(["o_orderpriority", "o_orderstatus"]).aggregate("max", "o_totalprice", "best").to_df()
    return dcast(dataframe(best), ["o_orderpriority"], "o_orderstatus", "best", ["F", "O", "X"], ["F", "O", "absent"]).to_df()


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O" from orders group by 1""")
def dcast_counts(spark, d):
    n = frame(spark, d, "orders").group_by(["o_orderpriority", "o_orderstatus"]).aggregate("count", "o_totalprice", "n").to_df()
    return dcast(dataframe(n), ["o_orderpriority"], "o_orderstatus", "n", ["F", "O"]).to_df()


@query("select c_mktsegment, c_acctbal, c_custkey from customer order by c_mktsegment, c_acctbal desc, c_custkey")
def sort_mixed(spark, d):
    f = frame(spark, d, "customer", "c_mktsegment", "c_acctbal", "c_custkey")
    return f.sort(["+", "c_mktsegment", "-", "c_acctbal", "+", "c_custkey"]).to_df()


# ------------------------------------------------------------ the reference's benchmark workloads, over all columns of the table


@query("select * replace (l_quantity + 10 as l_quantity) from lineitem")
def bench_elementwise(spark, d):
    return frame(spark, d, "lineitem").operate(lambda q: F.when(q.isNotNull(), q + 10).otherwise(0), "l_quantity").to_df()


@query("select *, concat(l_orderkey, l_partkey) as both from lineitem")
def bench_rowwise_concat(spark, d):
    return frame(spark, d, "lineitem").operate(opaque.concat, ["l_orderkey", "l_partkey"], "both").to_df()


@query("select l_suppkey, max(l_extendedprice) as most from lineitem group by 1")
def bench_group_max(spark, d):
    return frame(spark, d, "lineitem").group_by("l_suppkey").aggregate("max", "l_extendedprice", "most").to_df()


@query("select max(l_extendedprice) as most from lineitem")
def bench_table_max(spark, d):
    return frame(spark, d, "lineitem").aggregate("max", "l_extendedprice", "most").to_df()
