"""Lazy frames: an immutable specification over a source, compiled to one Spark plan.

The order in which a plan is built is fixed, whatever the order of the calls: typed scan, filters (over parsed source values),
every output column from the parsed values, then grouping or folding, then formatting (for text only). Columns of the source are
held under positional names, so renaming never breaks anything and names may differ in case only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import OperationError
from .functions import aggregates
from .functions.aggregates import Aggregate
from .functions.opaque import Op
from .keys import function_name, key_name, parse_keys
from .types import ColumnType, column_type, text

_STATE = {"debug": False, "data": False}
#: Source rows that the check of data runs through a frame.
CHECKED_ROWS = 100
#: A source may have one more column that tells the place of each row in it.
PLACE = "__place"


def enable_debug() -> None:
    """Operations aren't checked as they are given; errors come when the frame is computed."""
    _STATE["debug"] = True


def disable_debug() -> None:
    _STATE["debug"] = False


def check_data(on: bool = True) -> None:
    """Whether each call that changes a frame also runs the first CHECKED_ROWS source rows through it, strictly: a cell that fails is an error at once. Off at first, as each check is a job."""
    _STATE["data"] = on


def _call(fn: Callable, strict: bool, *columns: Column) -> Column:
    if isinstance(fn, Op):
        return (fn.strict if strict else fn.lenient)(*columns)
    out = fn(*columns)
    return out if isinstance(out, Column) else F.lit(out)


@dataclass(frozen=True)
class _Output:
    """A column: the source columns that it is made of (by position) and the functions applied in turn."""

    inputs: tuple[int, ...]
    ops: tuple[Callable, ...] = ()
    show: Callable[[Column], Column] | None = None
    original: bool = True


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


@dataclass(frozen=True)
class Frame:
    source: DataFrame  # columns _0, _1, ...
    names: tuple[str, ...]
    outputs: dict[str, _Output]
    parsers: dict[int, Callable[[Column, bool], Column]] = field(default_factory=dict)
    filters: tuple[tuple[Callable, tuple[_Output | int, ...]], ...] = ()
    keys: tuple[tuple[object, str], ...] = ()
    aggs: tuple[tuple[Aggregate, str, str], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    nulls: str = "sql"
    path: str | None = None
    most: int | None = None  # rows of the result
    placed: DataFrame | None = None  # the source with PLACE
    sep: str | None = None  # of the source, if it is delimited text
    output: Callable[[list[Column]], Column] | None = None  # the source's own writer
    size: int | None = None  # bytes of the source, as it states them itself

    # ------------------------------------------------------------ building

    @staticmethod
    def over(df: DataFrame, names: list[str] | None = None, path: str | None = None, **more) -> Frame:
        names = list(df.columns if names is None else names)
        plain = df.toDF(*(f"_{i}" for i in range(len(names))))
        return Frame(plain, tuple(names), {n: _Output((i,)) for i, n in enumerate(names)}, path=path, **more)

    def _checked(self, **changes) -> Frame:
        new = replace(self, **changes)
        if not _STATE["debug"]:
            try:
                new.to_df()
                if _STATE["data"]:
                    new.to_df(strict=True, df=new.source.limit(CHECKED_ROWS)).collect()
            except OperationError:
                raise
            except Exception as e:
                raise OperationError(str(e).splitlines()[0]) from e
        return new

    def _known(self, columns: list[str]) -> None:
        for c in columns:
            if c not in self.outputs:
                raise OperationError(f"no column {c!r}; there are {list(self.names)}")

    def _source_column(self, column: str) -> int:
        self._known([column])
        o = self.outputs[column]
        if not o.original:
            raise OperationError(f"{column!r} is a derived column")
        return o.inputs[0]

    def set_type(self, column: str, kind: str) -> Frame:
        t: ColumnType = column_type(kind)
        i = self._source_column(column)
        outputs = self.outputs | {column: replace(self.outputs[column], show=t.show)}
        return self._checked(parsers=self.parsers | {i: t.parse}, outputs=outputs)

    def set_parser(self, column: str, parser: Callable[[Column], Column]) -> Frame:
        i = self._source_column(column)
        return self._checked(parsers=self.parsers | {i: lambda c, strict: _call(parser, strict, c)})

    def set_formatter(self, column: str, formatter: Callable[[Column], Column]) -> Frame:
        self._known([column])
        return self._checked(outputs=self.outputs | {column: replace(self.outputs[column], show=lambda c: _call(formatter, False, c))})

    def filter(self, columns: str | list[str], predicate: Callable[..., Column]) -> Frame:
        columns = _list(columns)
        self._known(columns)
        parts = tuple(self.outputs[c].inputs[0] if self.outputs[c].original else c for c in columns)
        return self._checked(filters=(*self.filters, (predicate, parts)))

    def operate(self, fn: Callable[..., Column], columns: str | list[str], new: str | None = None) -> Frame:
        """In place on one column, or (with `new`) a column made of several original ones."""
        columns = _list(columns)
        self._known(columns)
        if new is None:
            if len(columns) != 1:
                raise OperationError("an operation in place takes one column")
            o = self.outputs[columns[0]]
            return self._checked(outputs=self.outputs | {columns[0]: replace(o, ops=(*o.ops, fn))})
        if new in self.outputs:
            raise OperationError(f"there is a column {new!r} already")
        made = _Output(tuple(self._source_column(c) for c in columns), (fn,), None, False)
        return self._checked(outputs=self.outputs | {new: made}, names=(*self.names, new))

    def rename_col(self, old: str, new: str) -> Frame:
        self._known([old])
        if new in self.outputs:
            raise OperationError(f"there is a column {new!r} already")
        swap = lambda x: new if x == old else x
        return self._checked(
            names=tuple(map(swap, self.names)),
            outputs={swap(k): v for k, v in self.outputs.items()},
            filters=tuple((p, tuple(map(swap, parts))) for p, parts in self.filters),
            keys=tuple((f, swap(c)) for f, c in self.keys),
            aggs=tuple((a, swap(c), n) for a, c, n in self.aggs),
            order=tuple((swap(c), up) for c, up in self.order),
        )

    def reorder_col(self, order: list[str]) -> Frame:
        if sorted(order) != sorted(self.names):
            raise OperationError("the order must name every column once")
        return self._checked(names=tuple(order))

    def select_col(self, keep: str | list[str]) -> Frame:
        keep = _list(keep)
        self._known(keep)
        if not keep:
            raise OperationError("at least one column must remain")
        return self._checked(names=tuple(keep))

    def delete_col(self, drop: str | list[str]) -> Frame:
        drop = _list(drop)
        self._known(drop)
        return self.select_col([n for n in self.names if n not in drop])

    def group_by(self, keys) -> Frame:
        parsed = parse_keys(keys)
        self._known([c for _, c in parsed])
        return self._checked(keys=tuple(parsed))

    def aggregate(self, fn: Aggregate | str, columns: str | list[str], new: str | list[str] | None = None) -> Frame:
        agg = aggregates.BY_NAME.get(fn) if isinstance(fn, str) else fn
        if not isinstance(agg, Aggregate):
            raise OperationError(f"no aggregate: {fn!r}")
        columns = _list(columns)
        self._known(columns)
        named = [f"{agg.name}({c})" for c in columns] if new is None else _list(new)
        if len(named) != len(columns):
            raise OperationError("as many new names as columns are needed")
        taken = {key_name(f, c) for f, c in self.keys} | {n for _, _, n in self.aggs}
        if taken & set(named) or len(set(named)) < len(named):
            raise OperationError(f"names are taken: {sorted(named)}")
        return self._checked(aggs=(*self.aggs, *((agg, c, n) for c, n in zip(columns, named, strict=True))))

    def null_rule(self, rule: str) -> Frame:
        """How aggregates treat nulls: "sql" or "strict"."""
        if rule not in ("sql", "strict"):
            raise OperationError("the rule is sql or strict")
        return self._checked(nulls=rule)

    def sort(self, order: list[str]) -> Frame:
        """order: "+" or "-" and a column, in turn: the sign, then the name."""
        if not order or len(order) % 2 or any(s not in ("+", "-") for s in order[::2]):
            raise OperationError('the order is a list of signs and names: ["+", "a", "-", "b"]')
        if missing := [c for c in order[1::2] if c not in self.get_col_names()]:
            raise OperationError(f"no columns {missing}")
        return self._checked(order=tuple((c, s == "+") for s, c in zip(order[::2], order[1::2], strict=True)))

    def limit(self, n: int) -> Frame:
        """At most n rows of the result; without sort, whichever come first."""
        if n < 0:
            raise OperationError("the number of rows can't be negative")
        return self._checked(most=n if self.most is None else min(n, self.most))

    def head(self, n: int = 10) -> list[dict]:
        """The first n rows of the result."""
        names = self.get_col_names()
        return [dict(zip(names, r, strict=True)) for r in self.limit(n).to_df().collect()]

    # ------------------------------------------------------------ compiling

    def get_col_names(self) -> list[str]:
        if self.keys or self.aggs:
            return [*(key_name(f, c) for f, c in self.keys), *(n for _, _, n in self.aggs)]
        return list(self.names)

    def _value(self, name: str, parsed: list[Column], strict: bool) -> Column:
        o = self.outputs[name]
        if not o.ops:
            return parsed[o.inputs[0]]
        value = _call(o.ops[0], strict, *(parsed[i] for i in o.inputs))
        for fn in o.ops[1:]:
            value = _call(fn, strict, value)
        return value

    def _scan(self, strict: bool, df: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
        df = self.source if df is None else df
        typed = df.select(*((self.parsers[i](F.col(c), strict) if i in self.parsers else F.col(c)).alias(c) for i, c in enumerate(self.source.columns)), *(c for c in df.columns if c == PLACE))
        parsed = [F.col(c) for c in self.source.columns]
        for predicate, parts in self.filters:
            given = [parsed[p] if isinstance(p, int) else self._value(p, parsed, strict) for p in parts]
            typed = typed.where(_call(predicate, strict, *given).cast("boolean"))  # null drops the row; the bare condition can reach the scan
        return typed, parsed

    def rows(self, strict: bool = False, df: DataFrame | None = None) -> DataFrame:
        """The row pipeline with every column of the frame, typed, under positional names c0, c1, ..."""
        typed, parsed = self._scan(strict, df)
        return typed.select(*(self._value(n, parsed, strict).alias(f"c{i}") for i, n in enumerate(self.names)), *(c for c in typed.columns if c == PLACE))

    def _working(self, strict: bool, df: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
        """Rows with just what grouping and aggregates need: keys k0.., values v0.."""
        typed, parsed = self._scan(strict, df)
        keys = [self._value(c, parsed, strict) if f is None else _call(f, strict, self._value(c, parsed, strict)) for f, c in self.keys]
        values = {c: f"v{i}" for i, c in enumerate(dict.fromkeys(c for _, c, _ in self.aggs))}
        return typed.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *(self._value(c, parsed, strict).alias(v) for c, v in values.items())), values

    def _grouped(self, strict: bool, df: DataFrame | None = None) -> DataFrame:
        rows, values = self._working(strict, df)
        keys = [f"k{i}" for i in range(len(self.keys))]
        if not self.aggs:
            return rows.select(*keys).distinct()
        nulls = self.nulls == "strict"
        scalars = [a.scalar(F.col(values[c]), nulls).alias(f"a{i}") for i, (a, c, _) in enumerate(self.aggs) if a.scalar]
        opaque = [a.opaque(F.col(values[c])).alias(f"a{i}") for i, (a, c, _) in enumerate(self.aggs) if a.opaque]
        parts = [rows.groupBy(*keys).agg(*x) if keys else rows.agg(*x) for x in (scalars, opaque) if x]
        for i, (a, c, _) in enumerate(self.aggs):
            if a.fold:
                if keys:
                    raise OperationError(f"{a.name} folds a whole table; it has no grouped form")
                parts.append(a.fold(rows, values[c]).withColumnRenamed("value", f"a{i}"))
            elif a.listing:
                parts.append(a.listing(rows, keys, values[c], nulls).withColumnRenamed("value", f"a{i}"))
        joined = _joined(parts, keys)
        many = [a.many for a, _, _ in self.aggs]
        if any(many):
            lists = [F.coalesce(f"a{i}", F.array()) if m else F.array(f"a{i}") for i, m in enumerate(many)]
            named = joined.select(*keys, *(x.alias(f"a{i}") for i, x in enumerate(lists)))
            zipped = F.arrays_zip(*(F.col(f"a{i}") for i in range(len(lists))))
            if len(lists) > 1:
                equal = F.lit(True)
                for i in range(1, len(lists)):
                    equal = equal & (F.size(f"a{i}") == F.size("a0"))
                zipped = F.when(equal, zipped).otherwise(F.raise_error(F.lit("aggregates give different numbers of rows")))
            joined = named.select(*keys, F.inline(zipped).alias(*(f"a{i}" for i in range(len(lists)))))
        return joined.select(*keys, *(f"a{i}" for i in range(len(self.aggs))))

    def _shows(self) -> list[Callable[[Column], Column]]:
        named = [c for _, c in self.keys] + [c for _, c, _ in self.aggs] if self.keys or self.aggs else list(self.names)
        plain = [f is not None for f, _ in self.keys] + [False] * len(self.aggs) if self.keys or self.aggs else [False] * len(named)
        return [text if p else self.outputs[c].show or text for c, p in zip(named, plain, strict=True)]

    def to_df(self, strict: bool = False, formatted: bool = False, df: DataFrame | None = None) -> DataFrame:
        """The frame's plan: typed columns, or (formatted) text."""
        out = self._grouped(strict, df) if self.keys or self.aggs else self.rows(strict, df)
        names = self.get_col_names()
        if PLACE in out.columns and not self.order:
            out = out.orderBy(PLACE)
        out = out.drop(PLACE)
        if self.order:
            places = {n: c for n, c in zip(names, out.columns, strict=True)}
            out = out.orderBy(*(F.col(places[c]).asc() if up else F.col(places[c]).desc() for c, up in self.order))
        if self.most is not None:
            out = out.limit(self.most)
        if formatted:
            out = out.select(*(_shown(show, out, c) for show, c in zip(self._shows(), out.columns, strict=True)))
        return out.toDF(*names)

    def in_source_order(self, strict: bool = False, formatted: bool = False) -> DataFrame:
        """As to_df, rows in the order of the source. A scan of files doesn't keep it: splits are packed by size."""
        if self.keys or self.aggs or self.placed is None:
            return self.to_df(strict, formatted)
        return self.to_df(strict, formatted, self.placed)

    # ------------------------------------------------------------ results

    def preview(self, sample_size: int = 1000, return_size: int = 10, formatted: bool = False) -> list[dict]:
        """First `sample_size` source rows through the frame, at most `return_size` of them, as dicts."""
        cut = self.source.limit(sample_size)
        if self.keys or self.aggs:
            rows = self.to_df(formatted=formatted, df=cut)
        else:
            rows = self.to_df(formatted=formatted, df=cut).limit(return_size)
        names = self.get_col_names()
        return [dict(zip(names, r, strict=True)) for r in rows.collect()]

    def print_df(self, sample_size: int = 1000, return_size: int = 10) -> str:
        """A table of names, types and rows, printed and returned; a last line of dots if there are more rows."""
        rows = self.preview(sample_size, return_size + 1)
        kinds = [t for _, t in self.to_df().dtypes]
        return _table(self.get_col_names(), kinds, [list(r.values()) for r in rows], return_size)

    def compute(self, path: str | None = None, **options):
        """Writes to path and returns a frame over it; without path, the rows as text, header first. See sources.sinks.compute."""
        from .sources.sinks import compute

        return compute(self, path, **options)


def _shown(show, df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    try:
        out = show(F.col(c))
        df.select(out)
    except Exception:  # the formatter belongs to the column, not to the value's present type
        out = F.col(c)
    if kind in ("array", "map", "struct"):
        return F.to_json(F.col(c)).alias(c)
    return out.cast("string").alias(c)


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    if not keys:
        parts = [p.withColumn("__one", F.lit(1)) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, "__one")
        return out.drop("__one")
    out = parts[0]
    for p in parts[1:]:  # a listing has no row for a group without values
        other = p.select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__other"), *(c for c in p.columns if c not in keys))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        kept = [c for c in out.columns if c not in keys]
        out = out.join(other, on, "full").select(*(F.when(F.col("__other"), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys), *kept, *(c for c in p.columns if c not in keys))
    return out


def _table(names: list[str], kinds: list[str], rows: list[list], most: int) -> str:
    shown = [names, kinds, *([("" if v is None else str(v)) for v in r] for r in rows[:most])]
    if len(rows) > most:
        shown.append(["..."] * len(names))
    widths = [max(len(r[i]) for r in shown) for i in range(len(names))]
    lines = ["| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |" for r in shown]
    lines.insert(1, "|-" + "-+-".join("-" * w for w in widths) + "-|")
    out = "\n".join(lines)
    print(out)
    return out


__all__ = ["Frame", "check_data", "disable_debug", "enable_debug", "function_name"]
