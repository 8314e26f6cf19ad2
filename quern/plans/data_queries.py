"""Queries p1 to p7 over the tables of a folder (those of the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decimal_number, strip, whole_number
from ..operators import orphans, rejects, rolling, skew, timestamps, wide
from ..sources.tables import table
from .instant_sql import instants

#: Share of a table's rows from which on a value is hot.
P7_SHARE = 0.04
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)


def instant_of(spark: SparkSession, d: str):
    return timestamps.instant_column(table(spark, d, "feeds"), table(spark, d, "zone_labels"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    instant = instant_of(spark, d)
    parts = [
        table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), instant(F.col(text), F.col("feed")).alias("utc_micros"))
        for name, key, text in (("sales", "sale_id", "date"), ("employees", "emp_row", "UpdateDate"), ("employee_info", "info_row", "UpdateDate"))
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).where("utc_micros is not null")


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_records(table(spark, d, "raw_employees"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rows(spark, d).where("reason is not null").select("record_no", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = p2_rows(spark, d).where("reason is null")
    return loaded.select("record_no", "file_name", *rejects.CELLS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs = [
        table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.col("Employee").alias("key_text"), "loaded_at")
        for name, key in (("sales", "sale_id"), ("employee_info", "info_row"))
    ]
    parents = table(spark, d, "employees").select(F.col("emp_row").alias("parent_id"), F.col("Employee").alias("key_text"), "loaded_at", "removed")
    return orphans.find_orphans(refs[0].unionAll(refs[1]), parents)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p3_found(spark, d))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.widen(table(spark, d, "family_long"), table(spark, d, "measures"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.filled_cells(p4_wide(spark, d))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = rolling.sales_by_day(table(spark, d, "sales"), instant_of(spark, d))
    asked = table(spark, d, "sold_asks").select(strip(F.col("cust")).alias("entity"), F.unix_date("ask_day").alias("day"))
    return rolling.trailing_totals(asked, totals)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_from_unix_date(F.col("day").cast("int")).cast("string")
    return p6_totals(spark, d).select(F.col("entity").alias("cust"), day.alias("ask_day"), F.col("total_7").alias("sold_7"), F.col("total_30").alias("sold_30"))


def p6_averages(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_from_unix_date(F.col("day").cast("int")).cast("string")
    return p6_totals(spark, d).select(F.col("entity").alias("cust"), day.alias("ask_day"), *(F.round(f"average_{n}", 6).alias(f"average_{n}") for n in (7, 30)))


def p6_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of each cust for each day from its first to its last, days without sales too."""
    totals = rolling.sales_by_day(table(spark, d, "sales"), instant_of(spark, d))
    day = F.date_from_unix_date(F.col("day").cast("int")).cast("string")
    both = [c for n in (7, 30) for c in (F.col(f"total_{n}").alias(f"sold_{n}"), F.round(f"average_{n}", 6).alias(f"average_{n}"))]
    return rolling.calendar_totals(totals).select(F.col("entity").alias("cust"), day.alias("day"), *both)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        skew.hot_keys(table(spark, d, "employees"), "Department", P7_SHARE)
        .select(F.lit("employees").alias("table_name"), "key_value")
        .unionAll(skew.hot_keys(table(spark, d, "sales"), "cust", P7_SHARE).select(F.lit("sales").alias("table_name"), "key_value"))
    )


def p7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    salary = table(spark, d, "employees").select("Department", decimal_number(F.col("Salary")).alias("v"))
    sold = table(spark, d, "sales").select("cust", whole_number(F.col("sold")).cast("double").alias("v"))
    return (
        skew.exact_quantiles(salary, "Department", "v", QUANTILES).select(F.lit("employees").alias("table_name"), "*")
        .unionAll(skew.exact_quantiles(sold, "cust", "v", QUANTILES).select(F.lit("sales").alias("table_name"), "*"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_loaded, p3_found, p3_report, p4_found, p4_wide, p6_found, p6_averages, p6_calendar, p7_found, p7_quantiles)}

_BLANKS = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _BLANKS.format(c)


def _usable(kind: str) -> str:
    """SQL for the canonical text of a usable value v of a kind."""
    number = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    return {
        "date": r"case when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{4}/[0-9]{2}/[0-9]{2}$') then cast(try_cast(replace(v, '/', '-') as date) as varchar) end",
        "int": r"case when regexp_matches(v, '^[+-]?[0-9]+(\.0+)?$') then cast(try_cast(regexp_extract(v, '^([+-]?[0-9]+)', 1) as hugeint) as varchar) end",
        "double": f"case when regexp_matches(v, {number}) then printf('%.2f', try_cast(v as double)) end",
        "boolean": "case when lower(v) in ('true', 'yes', 'y', '1') then 'true' when lower(v) in ('false', 'no', 'n', '0') then 'false' end",
        "text": "nullif(v, '')",
    }[kind]


_KEY = "case when regexp_matches({0}, '^[+-]?[0-9]+$') then try_cast({0} as bigint) end".format(_strip('"Employee"'))
_P3 = f"""
    with refs as (
            select 'sales' as table_name, sale_id as row_id, {_KEY} as k, loaded_at from sales
            union all select 'employee_info', info_row, {_KEY}, loaded_at from employee_info),
        own as (select {_KEY} as k, emp_row, loaded_at, coalesce(removed, false) as removed from employees),
        history as (select k, loaded_at, arg_max(removed, emp_row) as removed from own where k is not null group by all),
        seen as (select r.*, h.removed from (select * from refs where k is not null) r asof left join history h on r.k = h.k and r.loaded_at >= h.loaded_at),
        judged as (select s.*, case when k not in (select k from history) then 'missing' when removed is null then 'late' when removed then 'deleted' end as reason from seen s)
    select table_name, row_id, strftime(loaded_at, '%Y-%m') as period, reason from judged where reason is not null"""
_P4_CELLS = f"""
    select family_id, measure, typed from (
        select {_strip('family_id')} as family_id, m.measure, arg_max(u.typed, row_no) as typed
        from (select *, {_strip('value')} as v from family_long) f
        join measures m on regexp_replace(lower({_strip('f.measure')}), '[\\s-]', '_', 'g') = m.measure,
        lateral (select case value_type {' '.join(f"when '{k}' then {_usable(k)}" for k in ('date', 'int', 'boolean', 'text'))}
            when 'double' then case when regexp_matches(v, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then cast(try_cast(v as double) as varchar) end end as typed) u
        where u.typed is not null group by all) where family_id <> ''"""
#: The measures of the wide table by their type.
_WIDE = {
    "date": ["dob_child1", "dob_child2", "dob_child3", "dob_child4", "dob_child5", "moved_in"],
    "decimal(38,0)": ["n_children", "n_rooms"],
    "double": ["birth_weight_child1", "birth_weight_child2", "birth_weight_child3", "household_income"],
    "boolean": ["has_pet"],
    "varchar": ["sex_child1", "sex_child2", "sex_child3", "sex_child4", "sex_child5", "town"],
}
_P7 = " union all ".join(
    f"""select '{t}' as table_name, key_value from (select {_strip(c)} as key_value, count(*) as n from {t} group by 1)
    where key_value is not null and key_value <> '' and n >= {P7_SHARE} * (select count(*) from {t})"""
    for t, c in (("employees", '"Department"'), ("sales", "cust"))
)
_SALARY, _SOLD = _strip('"Salary"'), _strip("sold")
_QUANTILE_ROWS = f"""
    select 'employees' as table_name, {_strip('"Department"')} as key_value,
        case when regexp_matches({_SALARY}, '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({_SALARY} as double) end as v from employees
    union all select 'sales', {_strip('cust')},
        case when regexp_matches({_SOLD}, '^[+-]?[0-9]+(\\.0+)?$') then try_cast({_SOLD} as double) end from sales"""

_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)'
_NUMBER = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_DAY = r"'^[0-9]{4}([-/])[0-9]{1,2}([-/])[0-9]{1,2}( +([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?$'"
_P2 = f"""
    with records as (select record_no, file_name, regexp_replace(record, '[\r\n]+$', '') as t from raw_employees),
        cut as (select *, regexp_full_match(t, '{_CELL}(,{_CELL})*') as proper, regexp_extract_all(',' || t, ',({_CELL})', 1) as raw from records),
        cells as (select *, list_transform(raw, lambda c: case when c like '"%' then replace(c[2:-2], '""', '"') else c end) as c,
            len(list_filter(raw, lambda x: x not like '"%' and regexp_matches(x, '[\r\n]'))) as broken from cut),
        named as (select *, {_strip('c[4]')} as s, {_strip('c[5]')} as d from cells),
        typed as (select *, case when regexp_matches(s, {_NUMBER}) then try_cast(s as double) end as salary,
            case when regexp_matches(d, {_DAY}) and (not contains(d, '-') or not contains(d, '/')) then nullif(try_cast(replace(d, '/', '-') as timestamp), case when d like '0000%' then try_cast(replace(d, '/', '-') as timestamp) end) end as day from named)
    select *, case when t is null then 'column_count' when not proper then 'quoting' when len(raw) <> 5 or broken > 0 then 'column_count'
        when s <> '' and not coalesce(regexp_matches(s, {_NUMBER}) and isfinite(salary), false) then 'salary' when d <> '' and day is null then 'update_date' end as reason from typed"""

_P1_ROWS = """(select 'sales' as table_name, sale_id as row_id, date as text, feed from sales union all select 'employees', emp_row, "UpdateDate", feed from employees
    union all select 'employee_info', info_row, "UpdateDate", feed from employee_info)"""
_WHOLE = f"case when regexp_matches({_SOLD}, '^[+-]?[0-9]+(\\.0+)?$') then try_cast(regexp_extract({_SOLD}, '^([+-]?[0-9]+)', 1) as bigint) end"
_DAILY = f"""
    with dated as (select * from {instants("(select sale_id, ticket, cust, sold, date as text, feed from sales)")}),
        once as (select * from dated qualify row_number() over (partition by nullif({_strip('ticket')}, ''), case when coalesce({_strip('ticket')}, '') = '' then sale_id end order by sale_id) = 1),
        sums as (select {_strip('cust')} as cust, cast(floor(utc_micros / 86400000000.0) as integer) as day, {_WHOLE} as sold from once),
        daily as (select cust, day, sum(sold) as total from sums where cust is not null and day is not null and sold is not null group by all)"""
_TRAILING = "cast(coalesce(sum(total) filter (d.day > a.day - 7), 0) as bigint) as sold_7, cast(coalesce(sum(total), 0) as bigint) as sold_30"
_ASKED = f"""{_DAILY}, asked as (select {_strip('cust')} as cust, ask_day, ask_day - date '1970-01-01' as day from sold_asks),
        sums_of as (select a.cust, strftime(ask_day, '%Y-%m-%d') as ask_day, {_TRAILING} from asked a left join daily d on a.cust = d.cust and d.day between a.day - 29 and a.day group by all)"""
_CALENDAR = f"""{_DAILY}, days as (select cust, unnest(range(min(day), max(day) + 1)) as day from daily group by cust),
        sums_of as (select a.cust, strftime(date '1970-01-01' + cast(a.day as integer), '%Y-%m-%d') as day, {_TRAILING} from days a left join daily d on a.cust = d.cust and d.day between a.day - 29 and a.day group by a.cust, a.day)"""

#: SQL that gives the same rows.
ORACLES = {
    "p1_found": f"select table_name, row_id, utc_micros from {instants(_P1_ROWS)} where utc_micros is not null",
    "p6_found": f"{_ASKED} select cust, ask_day, sold_7, sold_30 from sums_of",
    "p6_averages": f"{_ASKED} select cust, ask_day, round(sold_7 / 7, 6) as average_7, round(sold_30 / 30, 6) as average_30 from sums_of",
    "p6_calendar": f"{_CALENDAR} select cust, day, sold_7, round(sold_7 / 7, 6) as average_7, sold_30, round(sold_30 / 30, 6) as average_30 from sums_of",
    "p2_found": f"select record_no, reason from ({_P2}) where reason is not null",
    "p2_loaded": f"""select record_no, file_name, c[1] as "Employee", c[2] as "EmployeeName", c[3] as "Department", salary as "Salary", day as "UpdateDate" from ({_P2}) where reason is null""",
    "p3_found": _P3,
    "p3_report": f"select table_name, period, reason, count(*) as n_rows from ({_P3}) group by all",
    "p4_found": f"""
        select family_id, measure, typed_value from (
            select {_strip('family_id')} as family_id, m.measure, arg_max(u.typed_value, row_no) as typed_value
            from (select *, {_strip('value')} as v from family_long) f
            join measures m on regexp_replace(lower({_strip('f.measure')}), '[\\s-]', '_', 'g') = m.measure,
            lateral (select case value_type {' '.join(f"when '{k}' then {_usable(k)}" for k in ('date', 'int', 'double', 'boolean', 'text'))} end as typed_value) u
            where u.typed_value is not null group by all) where family_id <> ''""",
    "p4_wide": "select family_id, " + ", ".join(f"max(case when measure = '{m}' then cast(typed as {kind}) end) as {m}" for kind, names in _WIDE.items() for m in names) + f" from ({_P4_CELLS}) group by 1",
    "p7_found": _P7,
    "p7_quantiles": f"""
        select table_name, key_value, q, v as quantile from (
            select *, row_number() over (partition by table_name, key_value order by v) as r, count(*) over (partition by table_name, key_value) as n
            from ({_QUANTILE_ROWS}) where key_value is not null and key_value <> '' and v is not null),
            (select unnest([{', '.join(str(q) for q in QUANTILES)}]::double[]) as q)
        where r = greatest(1, ceil(q * n - 1e-9))""",
}
