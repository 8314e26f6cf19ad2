"""Queries of sources, sinks, previews, opaque functions and refusals over the tables of a folder, and their SQL."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import Source, cbind_csv, dataframe, disable_debug, enable_debug, inner_join, outer_join, rbind_csv, size_in_bytes
from ..functions import aggregates as agg
from ..functions import opaque
from ..functions.text import decimal_number
from ..operators.bind import with_ordinal
from ..sources.shared import deleted_at_exit, shared_folder
from .frame_queries import frame, query


def scratch(spark: SparkSession, ending: str = "csv") -> str:
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}.{ending}"
    deleted_at_exit(spark, path)
    return path


# ------------------------------------------------------------ sources


@query("select cast(i as varchar) as n, cast(i * i as varchar) as square from range(5000) t(i)")
def source_rows(spark, d):
    """Rows that a function gives, read on a worker as they are needed."""
    return dataframe(lambda: ([i, i * i] for i in range(5000)), if_header=False, spark=spark).rename_col("Col_1", "n").rename_col("Col_2", "square").to_df()


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_acctbal as varchar) as s_acctbal from supplier where s_acctbal > 0")
def source_with_own_writer(spark, d):
    """A source of the user's with a writer of its own; what it writes is read with the same separator."""
    supplier = frame(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal").to_df()
    f = dataframe(Source(supplier, output=lambda cells: F.concat_ws("~", *cells), path="table.own")).filter("s_acctbal", lambda a: a > 0)
    path = scratch(spark, "own")
    f.compute(path, header=False)
    back = dataframe(path, if_header=False, sep="~", spark=spark)
    return back.to_df().toDF("s_suppkey", "s_name", "s_acctbal")


@query("select cast(c_custkey as varchar) as key1, cast(c_nationkey as varchar) as key2, c_name as name from customer")
def source_duplicate_names(spark, d):
    """A file whose header has one name twice."""
    path = scratch(spark)
    frame(spark, d, "customer", "c_custkey", "c_nationkey", "c_name").compute(path, header=["key", "key", "name"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return dataframe(path, spark=spark).to_df()


@query("select cast(sum(length(p_name) + 1) + length('p_name') + 1 as bigint) as bytes from part")
def source_size(spark, d):
    """Bytes of a source, as its file system states them."""
    path = scratch(spark)
    f = frame(spark, d, "part", "p_name").compute(path)
    return spark.createDataFrame([(size_in_bytes(f),)], "bytes bigint")


# ------------------------------------------------------------ sinks


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation where n_regionkey < 3")
def sink_memory(spark, d):
    """A result as rows of text in the driver, header first."""
    titles, *rows = frame(spark, d, "nation").filter("n_regionkey", lambda r: r < 3).compute(in_memory=True)
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{t} string" for t in titles))


@query("select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, l_shipmode from (select l_orderkey, l_linenumber, l_returnflag || ', ' || l_linestatus as l_shipmode from lineitem)")
def sink_tabs(spark, d):
    """The path's ending gives the delimiter: tabs, so that commas need no quotes."""
    f = frame(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").operate(lambda a, b: F.concat(a, F.lit(", "), b), ["l_returnflag", "l_linestatus"], "l_shipmode")
    return f.compute(scratch(spark, "tsv"), exclude=["l_returnflag", "l_linestatus"]).to_df()


@query("select o_orderkey as key, o_totalprice as price, o_orderpriority as priority from orders where o_orderstatus = 'O'")
def sink_parquet(spark, d):
    """The path's ending gives the format: typed columns."""
    f = frame(spark, d, "orders").filter("o_orderstatus", lambda s: s == "O")
    return f.compute(scratch(spark, "parquet"), select=["o_orderkey", "o_totalprice", "o_orderpriority"], header=["key", "price", "priority"]).to_df()


@query("select row_number() over (order by o_orderkey) - 1 as line, o_orderkey || '|' || o_orderpriority as text from orders where o_orderkey % 2 = 0")
def sink_order_and_own_writer(spark, d):
    """One file in the source's order, each row by the user's writer; with the number of each line."""
    path = scratch(spark)
    f = dataframe(f"{d}/orders.parquet", spark=spark).filter("o_orderkey", lambda k: k % 2 == 0)
    f.compute(path, order=True, select=["o_orderkey", "o_orderpriority"], header=False, output=lambda cells: F.concat_ws("|", *cells))
    lines = dataframe(path, if_header=False, sep="\x01", spark=spark).rename_col("Col_1", "text").in_source_order()
    return with_ordinal(lines, "line").select("line", "text")


@query("select c_custkey || '' as c_custkey, c_acctbal || '' as c_acctbal from customer where c_acctbal < 0")
def sink_parts(spark, d):
    """A folder of parts by at most two workers, without some columns."""
    f = frame(spark, d, "customer").filter("c_acctbal", lambda a: a < 0)
    return f.compute(scratch(spark, "parts"), exclude=["c_name", "c_nationkey", "c_mktsegment"], workers=2, partitioned=True).to_df()


@query('select cast(a.n_name as varchar) as "x_n_name", b.r_name as "y_r_name" from nation a join region b on a.n_regionkey = b.r_regionkey')
def sink_of_join(spark, d):
    """Some columns of a join, to a file and back."""
    j = inner_join(frame(spark, d, "nation"), frame(spark, d, "region"), "n_regionkey", "r_regionkey", ("x", "y"))
    return j.compute(scratch(spark), select=["x_n_name", "y_r_name"]).to_df()


@query("""select row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) - 1 as line, c_mktsegment || ',' || c_custkey as text from customer""")
def sink_sorted(spark, d):
    """One file in sorted order, with the number of each line."""
    path = scratch(spark)
    f = frame(spark, d, "customer", "c_mktsegment", "c_acctbal", "c_custkey").sort(["+", "c_mktsegment", "-", "c_acctbal", "+", "c_custkey"])
    f.compute(path, select=["c_mktsegment", "c_custkey"], header=False)
    lines = dataframe(path, if_header=False, sep="\x01", spark=spark).rename_col("Col_1", "text").in_source_order()
    return with_ordinal(lines, "line").select("line", "text")


# ------------------------------------------------------------ joins, binding


@query("""select a.o_orderkey as "1_o_orderkey", a.o_custkey as "1_o_custkey", b.c_custkey as "2_c_custkey", b.c_name as "2_c_name" from (select * from orders where o_totalprice > 100000) a
    full join (select * from customer where c_acctbal > 0) b on a.o_custkey is not distinct from b.c_custkey""")
def join_outer(spark, d):
    a = frame(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").filter("o_totalprice", lambda p: p > 100000).select_col(["o_orderkey", "o_custkey"])
    b = frame(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").filter("c_acctbal", lambda p: p > 0).select_col(["c_custkey", "c_name"])
    return outer_join(a, b, "o_custkey", "c_custkey").to_df()


def _two_files(spark, d) -> tuple[str, str]:
    a, b = scratch(spark), scratch(spark)
    dataframe(f"{d}/customer.parquet", spark=spark).compute(a, order=True, select=["c_custkey", "c_name"])
    dataframe(f"{d}/supplier.parquet", spark=spark).compute(b, order=True, select=["s_suppkey", "s_name", "s_acctbal"])
    return a, b


@query("select cast(c_custkey as varchar) as c_custkey, c_name from customer union all select cast(s_suppkey as varchar), s_name from supplier")
def rbind_files(spark, d):
    return rbind_csv(*_two_files(spark, d), spark=spark).to_df()


@query("""select cast(c_custkey as varchar) as c_custkey, c_name, cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_acctbal as varchar) as s_acctbal
    from (select *, row_number() over (order by c_custkey) r from customer) join (select *, row_number() over (order by s_suppkey) r from supplier) using (r)""")
def cbind_files(spark, d):
    return cbind_csv(*_two_files(spark, d), spark=spark).to_df()


# ------------------------------------------------------------ previews


@query("select cast(k as varchar) as o_orderkey, o_orderpriority from (select o_orderkey as k, * from orders order by o_orderkey limit 500) where o_orderstatus = 'F' order by k limit 20")
def preview_rows(spark, d):
    """The first 500 source rows through the frame, at most 20 of what comes out, as text."""
    f = dataframe(frame(spark, d, "orders").to_df().coalesce(1)).filter("o_orderstatus", lambda s: s == "F").select_col(["o_orderkey", "o_orderpriority"])
    return spark.createDataFrame([tuple(r.values()) for r in f.preview(500, 20, formatted=True)], "o_orderkey string, o_orderpriority string")


@query("""select * from (values (1, 'r_regionkey', 'r_name'), (2, 'int', 'string'), (6, '...', '...')) t(line, a, b)
    union all select r_regionkey + 3, cast(r_regionkey as varchar), r_name from region where r_regionkey < 3""")
def preview_printed(spark, d):
    """The printed table of a frame: names, types, three rows, and dots as there are more."""
    printed = frame(spark, d, "region").sort(["+", "r_regionkey"]).print_df(1000, 3)
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in printed.splitlines() if not line.startswith("|-")]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells, 1)], "line int, a string, b string")


@query('select a.n_nationkey as "1_n_nationkey", a.n_name as "1_n_name", b.r_name as "2_r_name" from nation a join region b on a.n_regionkey = b.r_regionkey')
def preview_of_join(spark, d):
    j = inner_join(frame(spark, d, "nation"), frame(spark, d, "region"), "n_regionkey", "r_regionkey")
    rows = [(r["1_n_nationkey"], r["1_n_name"], r["2_r_name"]) for r in j.preview(1000, 1000)]
    return spark.createDataFrame(rows, "`1_n_nationkey` int, `1_n_name` string, `2_r_name` string")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_limit(spark, d):
    return frame(spark, d, "orders", "o_orderkey", "o_totalprice").sort(["-", "o_totalprice", "+", "o_orderkey"]).limit(25).to_df()


# ------------------------------------------------------------ types, opaque functions, null rule


@query("""select info_row, case when regexp_full_match("UpdateDate", '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') then try_strptime("UpdateDate", '%Y-%m-%d %H:%M:%S') end as "UpdateDate" from employee_info""")
def set_datetime(spark, d):
    return frame(spark, d, "employee_info", "info_row", "UpdateDate").set_type("UpdateDate", "datetime").to_df()


@query(r"""select sale_id, case when regexp_full_match(regexp_replace(sold, '^\s+|\s+$', '', 'g'), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(regexp_replace(sold, '^\s+|\s+$', '', 'g') as double) end as sold from sales""")
def set_numeric_parser(spark, d):
    return frame(spark, d, "sales", "sale_id", "sold").set_parser("sold", decimal_number).to_df()


@query("select s_suppkey, '[\"' || s_nationkey || '\",\"' || s_name || '\"]' as both from supplier")
def pair_of_values(spark, d):
    f = frame(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_name").operate(opaque.pair, ["s_nationkey", "s_name"], "both").select_col(["s_suppkey", "both"])
    return f.to_df(formatted=True).withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@query("select event_id, event_type, value from events where length(event_type) = 5 and value > 50")
def opaque_filter(spark, d):
    """A Python predicate."""
    likely = opaque.udf(lambda kind, value: len(kind) == 5 and value > 50, "boolean")
    return frame(spark, d, "events", "event_id", "event_type", "value").filter(["event_type", "value"], likely).to_df()


@query("""select p_partkey, '<' || length(replace(p_name, ' ', '')) || '>' as p_name, cast(p_size + 1 as varchar) as p_size from part""")
def opaque_parser_and_formatter(spark, d):
    f = frame(spark, d, "part", "p_partkey", "p_name", "p_size").set_parser("p_name", opaque.udf(lambda s: len(s.replace(" ", "")), "int"))
    f = f.set_formatter("p_name", opaque.udf(lambda n: f"<{n}>", "string")).operate(opaque.increment, "p_size")
    return f.to_df(formatted=True).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("""select "Department", case when count(v) = count(*) then min(v) end as low, case when count(v) = count(*) then round(sum(v), 2) end as total, max(v) as high, count(*) as n from
    (select "Department", case when regexp_full_match("Salary", '[0-9]+(\\.[0-9]+)?') then cast("Salary" as double) end as v from employees) group by 1""")
def groupby_strict_nulls(spark, d):
    """With the strict rule a null is the least value and makes a sum null."""
    f = frame(spark, d, "employees", "Department", "Salary").set_parser("Salary", lambda c: F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.cast("double"))).null_rule("strict").group_by("Department")
    f = f.aggregate("min", "Salary", "low").aggregate("sum", "Salary", "total").aggregate("max", "Salary", "high").aggregate(agg.count, "Salary", "n")
    return f.to_df().withColumn("total", F.round("total", 2))


# ------------------------------------------------------------ refusals


_REFUSALS = (
    "an output onto its input", "select together with exclude", "a column that isn't there", "a sort list without sign", "a new name that is taken", "an aggregate that isn't known", "a key of another type",
    "a function that doesn't fit its column", "strict: a cell that isn't an int", "strict: a division by zero", "strict: a Python function that fails",
)


def _refused(act) -> bool:
    try:
        act()
    except Exception:
        return True
    return False


@query("select unnest([" + ", ".join("'" + r.replace("'", "''") + "'" for r in _REFUSALS) + "]) as what, true as refused union all select 'put off in debug mode', false")
def refusals(spark, d):
    """What is an error: of specifications at once, of cells when a strict result is computed."""
    path = scratch(spark)
    written = frame(spark, d, "nation").compute(path)
    nation, region = frame(spark, d, "nation"), frame(spark, d, "region")

    def strict(f) -> DataFrame:
        return f.to_df(strict=True).write.format("noop").mode("overwrite").save()

    acts = (
        lambda: written.compute(path), lambda: nation.compute(select="n_name", exclude="n_name"), lambda: nation.filter("none", F.isnull), lambda: nation.sort(["n_name"]),
        lambda: nation.rename_col("n_name", "n_regionkey"), lambda: nation.aggregate("none", "n_name"), lambda: inner_join(nation, region, "n_name", "r_regionkey"),
        lambda: nation.operate(lambda c: F.explode(c), "n_regionkey"), lambda: strict(nation.set_type("n_name", "int")), lambda: strict(nation.operate(lambda k: k * 0, "n_regionkey").operate(opaque.Op("of", lambda c: F.try_divide(F.lit(1), c), lambda c: F.lit(1) / c), "n_regionkey")),
        lambda: strict(nation.operate(opaque.udf(lambda s: int(s), "int"), "n_name")),
    )
    found = [(what, _refused(act)) for what, act in zip(_REFUSALS, acts, strict=True)]
    enable_debug()
    try:
        found.append(("put off in debug mode", _refused(lambda: nation.operate(lambda c: F.explode(c), "n_regionkey"))))
    finally:
        disable_debug()
    return spark.createDataFrame(found, "what string, refused boolean")

