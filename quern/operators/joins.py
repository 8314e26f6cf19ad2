"""Joins of two frames: null-safe equi-joins and rolling (as-of) joins.

Keys compare null-safely and must be of one type. Columns come out as prefix_name, those of a first (right join: of b first).

Rolling joins keep every row of a. Forward finds b's greatest roll value not above a's, backward the least not below; the first of b's rows
wins ties; null roll values match nothing. They are as-of joins with lists of b's rows per (keys, cell of the roll value), so no pairs are formed and a
hot key is spread over its cells: of times days, of numbers equal parts of their range, of texts their first characters, or smaller cells where those are crowded.

A predicate `limit` says which candidates count. Where its refusal of a candidate holds for all farther ones, as that of any greatest distance, say nearest_only: then the nearest
candidate alone is judged. A greatest distance may also be given as `tolerance`. With any other predicate the nearest candidate is judged first; only rows whose nearest is
refused must be compared with all candidates of their key, which stream through a join into a partial aggregate that keeps the best one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OperationError
from ..frame import Frame, _call, _shown, _table
from ..keys import parse_keys
from ..sources.shared import written
from ..types import text
from .asof import last_before

#: Cells that the range of a numeric roll column is cut into, first and where they are crowded.
CELLS = (64, 4_096, 262_144)


@dataclass(frozen=True)
class JoinedFrame:
    left: Frame
    right: Frame
    how: str  # inner, left, right, outer, forward, backward
    left_keys: tuple
    right_keys: tuple
    prefix: tuple[str, str] = ("1", "2")
    roll: tuple[str, str] | None = None
    limit: Callable[[Column, Column], Column] | None = None
    tolerance: object = None
    nearest_only: bool = False

    @cached_property
    def _range(self) -> tuple[float, float] | None:
        """Least and greatest roll value of b, if it is a number; found once."""
        b = self._side(self.right, self.right_keys, "b", False, None)
        c = F.col(f"bc{self.right.names.index(self.roll[1])}").cast("double")
        return tuple(b.agg(F.min(F.when(F.abs(c) < float("inf"), c)), F.max(F.when(F.abs(c) < float("inf"), c))).first())

    @property
    def df(self) -> DataFrame:
        return self.left.source

    def _sides(self):
        a = [(self.left, self.prefix[0], "a"), (self.right, self.prefix[1], "b")]
        return a[::-1] if self.how == "right" else a

    def get_col_names(self) -> list[str]:
        return [f"{p}_{n}" for f, p, _ in self._sides() for n in f.names]

    def _side(self, frame: Frame, keys: tuple, tag: str, strict: bool, df: DataFrame | None) -> DataFrame:
        rows = frame.rows(strict, df)
        at = {n: f"c{i}" for i, n in enumerate(frame.names)}
        made = [F.col(at[c]) if f is None else _call(f, strict, F.col(at[c])) for f, c in keys]
        return rows.select(*(k.alias(f"{tag}k{i}") for i, k in enumerate(made)), *(F.col(c).alias(f"{tag}{c}") for c in rows.columns))

    def _plan(self, strict: bool = False, cuts: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
        """Columns ac0.., bc0.. in the order of the output."""
        a = self._side(self.left, self.left_keys, "a", strict, cuts[0])
        b = self._side(self.right, self.right_keys, "b", strict, cuts[1])
        n = len(self.left_keys)
        for i in range(n):
            x, y = a.schema[f"ak{i}"].dataType, b.schema[f"bk{i}"].dataType
            if x != y:
                raise OperationError(f"key {i + 1} is {x.simpleString()} on one side and {y.simpleString()} on the other")
        if self.roll:
            out = self._rolled(a, b, n)
        else:
            on = F.lit(True)
            for i in range(n):
                on = on & F.col(f"ak{i}").eqNullSafe(F.col(f"bk{i}"))
            out = b.join(a, on, "left") if self.how == "right" else a.join(b, on, {"inner": "inner", "left": "left", "outer": "full"}[self.how])
        return out.select(*(f"{tag}c{i}" for f, _, tag in self._sides() for i in range(len(f.names))))

    def _rolled(self, a: DataFrame, b: DataFrame, n: int) -> DataFrame:
        keys = [f"k{i}" for i in range(n)]
        forward = self.how == "forward"
        own = [f"ac{i}" for i in range(len(self.left.names))]
        theirs = [f"bc{i}" for i in range(len(self.right.names))]
        left = a.select(*(F.col(f"a{k}").alias(k) for k in keys), F.col(f"ac{self.left.names.index(self.roll[0])}").alias("roll"), *own)
        right = b.select(*(F.col(f"b{k}").alias(k) for k in keys), F.col(f"bc{self.right.names.index(self.roll[1])}").alias("roll"), F.struct(*theirs).alias("row"), F.monotonically_increasing_id().alias("ord"))
        x, y = left.schema["roll"].dataType, right.schema["roll"].dataType
        if x != y:
            raise OperationError(f"the roll columns are {x.simpleString()} and {y.simpleString()}")
        firsts = right.where("roll is not null").groupBy(*keys, "roll").agg(F.min_by("row", "ord").alias("row"), F.min("ord").alias("ord"))
        found = last_before(left, firsts.withColumn("found", F.struct("roll", "row")).drop("row", "ord"), keys, "roll", self._cells(x.typeName()), "found", descending=not forward)
        near = F.col("found.roll")
        if self.tolerance is not None:
            gap = F.col("roll") - near if forward else near - F.col("roll")
            found = found.withColumn("found", F.when(gap <= F.lit(self.tolerance), F.col("found")))
        if self.limit is None:
            return found.select(*own, *(F.col("found.row")[c].alias(c) for c in theirs))
        counts = F.coalesce(_call(self.limit, False, F.col("roll"), near).cast("boolean"), F.lit(False))
        judged = found.withColumn("refused", near.isNotNull() & ~counts)
        if self.nearest_only:
            return judged.select(*own, *(F.when(~F.col("refused"), F.col("found.row"))[c].alias(c) for c in theirs))
        judged = written(judged.withColumn("id", F.monotonically_increasing_id()))  # the ids must not change when a task is repeated
        r = right.where("roll is not null").select(*(F.col(k).alias(f"b{k}") for k in keys), F.col("roll").alias("broll"), "row", "ord")
        on = (F.col("broll") <= F.col("roll")) if forward else (F.col("broll") >= F.col("roll"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"b{k}"))
        on = on & F.coalesce(_call(self.limit, False, F.col("roll"), F.col("broll")).cast("boolean"), F.lit(False))
        best = F.struct(F.col("broll"), -F.col("ord")) if forward else F.struct(F.col("broll"), F.col("ord"))
        pick = F.max_by if forward else F.min_by
        again = judged.where("refused").join(r, on, "left").groupBy("id").agg(F.first(F.struct(*own)).alias("own"), pick(F.col("row"), F.when(F.col("ord").isNotNull(), best)).alias("row"))
        kept = judged.where("not refused").select(F.struct(*own).alias("own"), F.col("found.row").alias("row")).unionByName(again.drop("id"))
        return kept.select(*(F.col("own")[c].alias(c) for c in own), *(F.col("row")[c].alias(c) for c in theirs))

    def _cells(self, kind: str) -> list[Column]:
        """Expressions that never decrease with the roll value, from coarse to fine."""
        roll = F.col("roll")
        if kind in ("timestamp", "timestamp_ntz"):
            return [F.date_trunc(unit, roll) for unit in ("day", "hour", "minute", "second")]
        if kind == "date":
            return [F.trunc("roll", "month"), roll]
        if kind == "string":
            return [F.substring(roll, 1, n) for n in (2, 4, 8, 32)]
        low, high = self._range
        if low is None or low == high:
            return [F.when(roll.isNotNull(), F.lit(0))]
        place = (roll.cast("double") / 2 - low / 2) / (high / 2 - low / 2)  # halves, as the range itself may not be finite
        return [F.greatest(F.lit(-1), F.least(F.lit(n), F.floor(place * n))) for n in CELLS]

    def to_df(self, strict: bool = False, formatted: bool = False, df=None, cuts=(None, None)) -> DataFrame:
        out = self._plan(strict, cuts)
        if formatted:
            shows = [f.outputs[n].show or text for f, _, _ in self._sides() for n in f.names]
            out = out.select(*(_shown(show, out, c) for show, c in zip(shows, out.columns, strict=True)))
        return out.toDF(*self.get_col_names())

    def to_frame(self) -> Frame:
        """The join as the source of a new frame."""
        return Frame.over(self.to_df())

    def compute(self, path: str | None = None, **options):
        from ..sources.sinks import compute

        return compute(self, path, **options)

    def preview(self, sample_size: int = 1000, return_size: int = 10, formatted: bool = False) -> list[dict]:
        """The join of the first `sample_size` source rows of either side."""
        cuts = (self.left.source.limit(sample_size), self.right.source.limit(sample_size))
        rows = self.to_df(formatted=formatted, cuts=cuts).limit(return_size).collect()
        return [dict(zip(self.get_col_names(), r, strict=True)) for r in rows]

    def print_df(self, sample_size: int = 1000, return_size: int = 10) -> str:
        rows = self.preview(sample_size, return_size + 1)
        return _table(self.get_col_names(), [t for _, t in self.to_df().dtypes], [list(r.values()) for r in rows], return_size)


def _join(how: str, a: Frame, b: Frame, a_keys, b_keys, col_prefix, **more) -> JoinedFrame:
    for f in (a, b):
        if f.keys or f.aggs:
            raise OperationError("grouped frames can't be joined; compute them first")
    ka, kb = parse_keys(a_keys), parse_keys(b_keys)
    if len(ka) != len(kb):
        raise OperationError("both sides need the same number of keys")
    for f, keys in ((a, ka), (b, kb)):
        f._known([c for _, c in keys])
        if missing := [c for _, c in keys if c not in f.names]:
            raise OperationError(f"no columns {missing}")
    if len(col_prefix) != 2:
        raise OperationError("two prefixes are needed")
    out = JoinedFrame(a, b, how, tuple(ka), tuple(kb), tuple(col_prefix), **more)
    if out.roll is None:
        out.to_df()
    return out


def inner_join(a: Frame, b: Frame, a_keys, b_keys, col_prefix=("1", "2")) -> JoinedFrame:
    return _join("inner", a, b, a_keys, b_keys, col_prefix)


def left_join(a: Frame, b: Frame, a_keys, b_keys, col_prefix=("1", "2")) -> JoinedFrame:
    return _join("left", a, b, a_keys, b_keys, col_prefix)


def right_join(a: Frame, b: Frame, a_keys, b_keys, col_prefix=("1", "2")) -> JoinedFrame:
    """All rows of b; b's columns come first."""
    return _join("right", a, b, a_keys, b_keys, col_prefix)


def outer_join(a: Frame, b: Frame, a_keys, b_keys, col_prefix=("1", "2")) -> JoinedFrame:
    return _join("outer", a, b, a_keys, b_keys, col_prefix)


def _rolling(how, a, b, a_keys, b_keys, a_roll, b_roll, limit, tolerance, nearest_only, col_prefix) -> JoinedFrame:
    for f, c in ((a, a_roll), (b, b_roll)):
        if c not in f.names:
            raise OperationError(f"no column {c!r}")
    if limit is not None and tolerance is not None:
        raise OperationError("either limit or tolerance can be given")
    return _join(how, a, b, a_keys, b_keys, col_prefix, roll=(a_roll, b_roll), limit=limit, tolerance=tolerance, nearest_only=nearest_only)


def rolling_join_forward(a: Frame, b: Frame, a_keys, b_keys, a_roll: str, b_roll: str, limit=None, tolerance=None, nearest_only: bool = False, col_prefix=("1", "2")) -> JoinedFrame:
    """b's row of the greatest roll value not above a's. limit(a_roll, b_roll): which candidates count at all; nearest_only: what it refuses makes it refuse all that is farther."""
    return _rolling("forward", a, b, a_keys, b_keys, a_roll, b_roll, limit, tolerance, nearest_only, col_prefix)


def rolling_join_backward(a: Frame, b: Frame, a_keys, b_keys, a_roll: str, b_roll: str, limit=None, tolerance=None, nearest_only: bool = False, col_prefix=("1", "2")) -> JoinedFrame:
    """b's row of the least roll value not below a's."""
    return _rolling("backward", a, b, a_keys, b_keys, a_roll, b_roll, limit, tolerance, nearest_only, col_prefix)
