"""Mixed timestamp texts to one instant in UTC.

A text is tokenised into a character-class mask: every ASCII digit becomes ``9``, every ASCII letter ``a``,
anything else stays. Each distinct mask is mapped once to a layout (which field lies at which positions); with
the positions of its layout each text's fields are read by array arithmetic over the whole batch. What follows the clock time (half
of the day, zone) is resolved once per distinct text. Local times become instants through the transition tables of the time
zone database, which carry the database's version and a checksum and travel from the driver to every worker, so that all
workers use the same rules, whatever is installed there; a worker checks what it got. Where a zone's rule goes on without end its table holds
40 years of it, in which years of every shape occur (leap or not, first day of the week), and later years are read as the one of their shape.

Defined results: null, empty, blank or other texts, impossible dates or times, local times that a clock change
skips or repeats, and zone labels that aren't known give null. A text without zone takes the zone of its feed; with
neither, null. Repeated rows are converted each for itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import columns, small_rows

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Feeds and labels are configuration: more rows than this raise an error.
MOST_FEEDS = 1_000_000
#: From this year on, or from the last one that its file lists, a zone's rule alone holds; the tables go on for so many years.
RULE_YEAR, CYCLE = 2038, 40

# English names of months and days of the week.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MONTH_OF = {n: i + 1 for i, m in enumerate(MONTHS) for n in (m, m[:3])} | {"sept": 9}
WEEKDAY_OF = {n: i for i, d in enumerate(WEEKDAYS) for n in (d, d[:3])}


# ---------------------------------------------------------------- zone transition tables


@dataclass(frozen=True)
class Zone:
    """UTC microseconds of the changes of a zone's offset, the offset in each period between them, and the year from which on its rule alone holds (none without rule)."""

    at: np.ndarray
    offset: np.ndarray
    rule_year: int | None = None


def _days(years: np.ndarray) -> np.ndarray:
    """Days from 1970 to the first of January."""
    return (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)


def _shape(years: np.ndarray) -> np.ndarray:
    """A number for leap or not and the first day of the week."""
    first = _days(years)
    return (_days(years + 1) - first - 365) * 7 + first % 7


@dataclass
class ZoneTables:
    """The zones of one version of the time zone database."""

    version: str
    zones: dict[str, Zone] = field(default_factory=dict)
    checksum: int = 0

    def sum(self) -> int:
        out = zlib.crc32(self.version.encode())
        for name, z in sorted(self.zones.items()):
            for part in (name.encode(), z.at.tobytes(), z.offset.tobytes(), str(z.rule_year).encode()):
                out = zlib.crc32(part, out)
        return out

    def checked(self) -> ZoneTables:
        if self.sum() != self.checksum:
            raise RuntimeError(f"the tables of time zone database {self.version} aren't those that were sent")
        return self

    def to_utc(self, local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
        """Instants of local microseconds, and where exactly one instant exists."""
        z = self.zones[zone]
        later = np.zeros(len(local), np.int64)
        if z.rule_year is not None and len(late := np.flatnonzero(local >= _days(np.array([z.rule_year + CYCLE]))[0] * DAY)):
            own = np.arange(z.rule_year, z.rule_year + CYCLE)
            of_shape = np.zeros(14, np.int64)
            of_shape[_shape(own)] = own
            year = (local[late] // DAY).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
            later[late] = (_days(year) - _days(of_shape[_shape(year)])) * DAY
            local = local - later
        at, offset = z.at, z.offset
        n = len(at)
        guess = np.searchsorted(at, local, side="right")
        hits, utc = np.zeros(len(local), np.int8), np.zeros(len(local), np.int64)
        for step in range(-2, 3):
            k = guess + step
            inside = (k >= 0) & (k <= n)
            k = np.clip(k, 0, n)
            u = local - offset[k]
            if n:
                inside &= ((k == 0) | (u >= at[np.maximum(k - 1, 0)])) & ((k == n) | (u < at[np.minimum(k, n - 1)]))
            hits += inside
            utc = np.where(inside, u, utc)
        return utc + later, hits == 1


def _read_zone_file(data: bytes) -> tuple[list[int], list[int]]:
    """Transitions in UTC seconds and offsets of the periods, from the 64-bit block of a TZif file (RFC 8536)."""

    def header(at: int) -> tuple[int, ...]:
        return struct.unpack_from(">6l", data, at + 20)

    utc_n, std_n, leap_n, time_n, type_n, char_n = header(0)
    size = 8 if data[4:5] >= b"2" else 4
    at = 0
    if size == 8:
        at = 44 + time_n * 5 + type_n * 6 + char_n + leap_n * 8 + std_n + utc_n
        utc_n, std_n, leap_n, time_n, type_n, char_n = header(at)
    at += 44
    times = list(struct.unpack_from(f">{time_n}{'q' if size == 8 else 'l'}", data, at))
    kinds = data[at + time_n * size : at + time_n * (size + 1)]
    types = [struct.unpack_from(">lBB", data, at + time_n * (size + 1) + 6 * i) for i in range(type_n)]
    return times, [types[0][0], *(types[k][0] for k in kinds)]


_RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)(?P<std>[-+0-9:]+)(?:<[^>]+>|[A-Za-z]+)(?P<dst>[-+0-9:]+)?,(?P<begin>[^,/]+)(?:/(?P<begin_at>[-+0-9:]+))?,(?P<end>[^,/]+)(?:/(?P<end_at>[-+0-9:]+))?")


def _seconds(text: str) -> int:
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return sum(x * 60 ** (2 - i) for i, x in enumerate(parts)) * (-1 if text[0] == "-" else 1)


def _day_of_rule(rule: str, year: int) -> int:
    """Days since 1970 of the day that a rule (Mm.w.d, Jn or n) names in a year."""
    first = int(_days(np.array([year]))[0])
    if rule[0] == "M":
        month, week, weekday = map(int, rule[1:].split("."))
        months = (np.array([0, 1]) + (year - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        day = int(months[0]) + (weekday - (int(months[0]) + 4)) % 7 + 7 * (week - 1)
        return day if day < months[1] else day - 7
    leap = int(_days(np.array([year + 1]))[0]) - first == 366
    return first + int(rule[1:]) - 1 + (leap and int(rule[1:]) > 59) if rule[0] == "J" else first + int(rule)


def _changes(rule: re.Match, years: range) -> list[tuple[int, int]]:
    """(UTC second, offset from then on) of each change by a rule of POSIX."""
    standard = -_seconds(rule["std"])
    summer = -_seconds(rule["dst"]) if rule["dst"] else standard + 3600
    out = []
    for year in years:
        out.append((_day_of_rule(rule["begin"], year) * 86_400 + _seconds(rule["begin_at"] or "2") - standard, summer))
        out.append((_day_of_rule(rule["end"], year) * 86_400 + _seconds(rule["end_at"] or "2") - summer, standard))
    return sorted(out)


def _table_of(data: bytes) -> Zone:
    times, offsets = _read_zone_file(data)
    footer = data.rsplit(b"\n", 2)[-2].decode() if data.endswith(b"\n") else ""
    rule_year = None
    if rule := _RULE.fullmatch(footer):  # the file leaves later changes to its rule
        last = times[-1] if times else -(1 << 62)
        listed = int(np.datetime64(last, "s").astype("datetime64[Y]").astype(np.int64)) + 1970 if times else 1970
        rule_year = max(RULE_YEAR, listed + 1)
        for t, offset in _changes(rule, range(listed, rule_year + CYCLE + 1)):
            if t > last:
                times.append(t)
                offsets.append(offset)
    keep = [i for i in range(len(times)) if offsets[i] != offsets[i + 1]]  # changes of the name only don't count
    return Zone(np.array([times[i] for i in keep], np.int64) * SECOND, np.array([*(offsets[i] for i in keep), offsets[-1]], np.int64) * SECOND, rule_year)


@lru_cache(1)
def zone_tables() -> ZoneTables:
    """The tables of every zone of the installed time zone database, and its version."""
    import zoneinfo

    version, tables = "unknown", {}
    roots = [Path(p) for p in zoneinfo.TZPATH if Path(p).is_dir()]
    try:
        import tzdata

        roots.append(Path(tzdata.__file__).parent / "zoneinfo")
        version = tzdata.IANA_VERSION
    except ImportError:
        pass
    for root in roots:
        if (f := root / "tzdata.zi").exists():
            with f.open(encoding="ascii", errors="replace") as lines:
                version = lines.readline().split()[-1]
            break
    for name in zoneinfo.available_timezones():
        for root in roots:
            if (f := root / name).is_file():
                tables[name] = _table_of(f.read_bytes())
                break
    out = ZoneTables(version, tables)
    out.checksum = out.sum()
    return out


# ---------------------------------------------------------------- masks and layouts

_CLASS = {c: "9" for c in range(ord("0"), ord("9") + 1)} | {c: "a" for c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1))}
#: The fields of layouts, in the order of their positions' columns.
FIELDS = ("unix", "Y", "m", "d", "p", "q", "H", "M", "S", "f", "mon", "week", "T", "tail")
#: Texts up to this length are converted together; longer ones (only fractions can be that long) apart, by their length.
USUAL = 96
#: Masks that a worker keeps between batches; beyond that it starts afresh.
MOST_MASKS = 100_000

_TIME = r"(?:(?:(?P<T>a)| +)(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?)?"
_TAIL = r"(?P<tail>(?:[^9].*)?)"
_LAYOUTS = [
    re.compile(p, re.DOTALL)
    for p in (
        rf"(?P<Y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?){_TIME}{_TAIL}",
        rf"(?P<p>99?)(?P<sep>[-/.])(?P<q>99?)(?P=sep)(?P<Y>9999){_TIME}{_TAIL}",
        rf"(?:(?P<week>a{{3,9}}),? )?(?P<d>99?)(?P<sep>[- ])(?P<mon>a{{3,9}})(?P=sep)(?P<Y>9999){_TIME}{_TAIL}",
        rf"(?:(?P<week>a{{3,9}}),? )?(?P<mon>a{{3,9}}) (?P<d>99?),? (?P<Y>9999){_TIME}{_TAIL}",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<T>a)| )(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_TAIL}",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99){_TAIL}",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)(?P<S>99)",
    )
]
_UNIX = {10: SECOND, 13: 1000, 16: 1}


@lru_cache(65_536)
def layout_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field positions of all texts of this mask; none if no timestamp has this shape."""
    if mask.strip("9") == "" and len(mask) in _UNIX:
        return {"unix": (0, len(mask))}
    for layout in _LAYOUTS:
        if m := layout.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v and k != "sep"}
    return None


_TAIL_TEXT = re.compile(r"(?:\s*(?P<half>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?\s*(?P<zone>(?P<off>[+-]\d{2}(?::?\d{2})?)?\s*(?P<name>\[[^\[\]\s]+\]|[A-Za-z][A-Za-z0-9_+\-/]*)?)")


class Resolver:
    """What follows the clock time: half of the day and zone. Each distinct tail is resolved once."""

    def __init__(self, tables: ZoneTables, labels: dict[str, str]):
        self.tables, self.labels, self.seen = tables, labels, {}

    def zone(self, name: str) -> str | int | None:
        """Zone of a name, or its fixed offset in microseconds."""
        if name in self.tables.zones:
            return name
        if m := re.fullmatch(r"([+-])(\d{2}):?(\d{2})?", name):
            hours, minutes = int(m[2]), int(m[3] or 0)
            if hours <= 18 and minutes < 60:
                return (hours * 60 + minutes) * 60 * SECOND * (-1 if m[1] == "-" else 1)
        return 0 if name in ("Z", "z") else None

    def tail(self, text: str) -> tuple[str, object] | None:
        """(half of the day or "", zone, offset or ""), or none."""
        if text not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[text] = self._tail(text)
        return self.seen[text]

    def _tail(self, text: str) -> tuple[str, object] | None:
        if not (m := _TAIL_TEXT.fullmatch(text)):
            return None
        half = (m["half"] or "").replace(".", "").lower()
        if m["off"]:
            zone = self.zone(m["off"])
        elif m["name"]:
            name = m["name"].strip("[]")
            zone = self.zone(self.labels[name]) if name in self.labels else self.zone(name) if "/" in name or name in "Zz" else None
        else:
            zone = ""
        return None if zone is None else (half, zone)


class Normaliser:
    """Converts arrays of texts. feeds: name to (zone or none, "DMY" or "MDY" or none)."""

    def __init__(self, tables: ZoneTables, feeds: dict[str, tuple[str | None, str | None]], labels: dict[str, str]):
        self.resolver, self.tables = Resolver(tables, labels), tables
        self.feeds = {k: (self.resolver.zone(z) if z else None, {"DMY": 1, "MDY": 0}.get(o, -1)) for k, (z, o) in feeds.items()}
        self.number: dict[str, int] = {}  # of each mask's layout; -1: none
        self.places: list[list[tuple[int, int]]] = []
        self.zone_number: dict = {None: -1}
        self.zones: list = []

    def _layout(self, mask: str) -> int:
        layout = layout_of(mask)
        if layout is not None:
            self.places.append([(a, b - a) for a, b in (layout.get(f, (0, 0)) for f in FIELDS)])
        self.number[mask] = k = -1 if layout is None else len(self.places) - 1
        return k

    def _zone(self, zone) -> int:
        if zone not in self.zone_number:
            self.zone_number[zone] = len(self.zones)
            self.zones.append(zone)
        return self.zone_number[zone]

    def __call__(self, texts, feeds) -> tuple[np.ndarray, np.ndarray]:
        """Microseconds since 1970 UTC, and which of them are defined."""
        n = len(texts)
        utc, ok = np.zeros(n, np.int64), np.zeros(n, bool)
        clean = [x.strip() if isinstance(x, str) else "" for x in texts]
        sizes = np.fromiter(map(len, clean), np.int64, n)
        groups = [np.flatnonzero((sizes > 0) & (sizes <= USUAL)), *(np.flatnonzero(sizes == size) for size in np.unique(sizes[sizes > USUAL]))]
        for rows in groups:
            if len(rows):
                utc[rows], ok[rows] = self._convert([clean[i] for i in rows], [feeds[i] for i in rows])
        return utc, ok

    def _convert(self, texts: list[str], feeds: list) -> tuple[np.ndarray, np.ndarray]:
        total = len(texts)
        if len(self.number) > MOST_MASKS:  # only here: what follows takes indices into places
            self.number, self.places = {}, []
        known = self.number
        which = np.fromiter((k if (k := known.get(mask := t.translate(_CLASS))) is not None else self._layout(mask) for t in texts), np.int64, total)
        rows = np.flatnonzero(which >= 0)
        all_utc, all_ok = np.zeros(total, np.int64), np.zeros(total, bool)
        if not len(rows):
            return all_utc, all_ok
        texts, n = [texts[i] for i in rows], len(rows)
        places = np.array(self.places, np.int64)[which[rows]]
        at = {f: places[:, i, 0] for i, f in enumerate(FIELDS)}
        size = {f: places[:, i, 1] for i, f in enumerate(FIELDS)}
        width = max(map(len, texts))
        codes = np.array(texts, f"<U{width}").view(np.uint32).reshape(n, width)
        every = np.arange(n)

        def number(f: str, most: int = 99) -> np.ndarray:
            length = np.minimum(size[f], most)
            out = np.zeros(n, np.int64)
            for k in range(int(length.max())):
                digit = codes[every, np.minimum(at[f] + k, width - 1)].astype(np.int64) - 48
                out = np.where(k < length, out * 10 + digit, out)
            return out

        def words(f: str) -> tuple[np.ndarray, list[str]]:
            has = np.flatnonzero(size[f])
            return has, [texts[i][a : a + b] for i, a, b in zip(has.tolist(), at[f][has].tolist(), size[f][has].tolist(), strict=True)]

        feed, names = pd.factorize(np.array(feeds, object)[rows])  # a null feed: -1, so the last of the list
        of_feed = [(self._zone(zone), order) for zone, order in (*(self.feeds.get(f, (None, -1)) for f in names), (None, -1))]
        own_zone, day_first = (np.array(x, np.int64)[feed] for x in zip(*of_feed, strict=True))
        ok = np.ones(n, bool)
        unix = size["unix"] > 0
        year, month, day = number("Y"), number("m"), number("d")
        numeric = size["p"] > 0
        p, q = number("p"), number("q")
        day = np.where(numeric, np.where(day_first == 1, p, q), day)
        month = np.where(numeric, np.where(day_first == 1, q, p), month)
        ok &= ~numeric | (day_first >= 0)
        has, names = words("mon")
        month[has] = [MONTH_OF.get(w.lower(), 0) for w in names]
        ok &= unix | ((year >= 1) & (month >= 1) & (month <= 12) & (day >= 1))
        months = np.where(ok & ~unix, (year - 1970) * 12 + month - 1, 0)
        first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        ok &= unix | (day <= after - first)
        days = first + day - 1
        has, names = words("week")
        ok[has] &= np.array([WEEKDAY_OF.get(w.lower(), -1) for w in names], np.int64) == (days[has] + 3) % 7
        hour, minute, second = number("H"), number("M"), number("S")
        fraction = number("f", 6) * 10 ** np.clip(6 - size["f"], 0, 6)
        ok &= (size["T"] == 0) | np.isin(codes[every, np.minimum(at["T"], width - 1)], (ord("T"), ord("t")))
        zone = own_zone
        has, names = words("tail")
        if len(has):
            tails = [self.resolver.tail(w) for w in names]
            ok[has] &= np.array([t is not None for t in tails])
            half = np.zeros(n, np.int64)
            half[has] = [{"am": 1, "pm": 2}.get(t[0], 0) if t else 0 for t in tails]
            ok &= (half == 0) | ((size["H"] > 0) & (hour >= 1) & (hour <= 12))
            hour = np.where(half > 0, hour % 12 + 12 * (half == 2), hour)
            zone = zone.copy()
            zone[has] = [self._zone(t[1]) if t and t[1] != "" else z for t, z in zip(tails, own_zone[has].tolist(), strict=True)]
        ok &= (hour < 24) & (minute < 60) & (second < 60)
        local = days * DAY + ((hour * 60 + minute) * 60 + second) * SECOND + fraction
        utc = np.zeros(n, np.int64)
        for k in np.unique(zone[ok & ~unix]):
            here = np.flatnonzero((zone == k) & ok & ~unix)
            if k < 0:
                ok[here] = False
            elif isinstance(self.zones[k], str):
                utc[here], ok[here] = self.tables.to_utc(local[here], self.zones[k])
            else:
                utc[here] = local[here] - self.zones[k]
        if unix.any():
            scale = np.where(size["unix"] == 10, SECOND, np.where(size["unix"] == 13, 1000, 1))
            utc, ok = np.where(unix, number("unix") * scale, utc), ok | unix
        all_utc[rows], all_ok[rows] = utc, ok
        return all_utc, all_ok


# ---------------------------------------------------------------- Spark


def instant_column(feeds: DataFrame, labels: DataFrame):
    """A function (text column, feed column) -> bigint column of microseconds since 1970 UTC, or null.

    feeds (feed, zone_name, date_order) and labels (label, zone_name) are configuration tables; they are read
    here, once, and travel with the function. Of several rows of one name the least values hold."""
    feed_of: dict = {}
    for r in sorted(small_rows(columns(feeds, "feed", "zone_name", "date_order"), MOST_FEEDS, "feeds"), key=lambda r: tuple(map(str, r))):
        if r.feed is not None:
            feed_of.setdefault(r.feed, (r.zone_name, r.date_order))
    label_of: dict = {}
    for r in sorted(small_rows(columns(labels, "label", "zone_name"), MOST_FEEDS, "zone_labels"), key=lambda r: tuple(map(str, r))):
        if r.label is not None and r.zone_name is not None:
            label_of.setdefault(r.label, r.zone_name)
    tables, made = zone_tables(), []

    @F.pandas_udf("bigint")
    def instant(text: pd.Series, feed: pd.Series) -> pd.Series:
        if not made:
            made.append(Normaliser(tables.checked(), feed_of, label_of))
        utc, ok = made[0](text.to_numpy(object), feed.to_numpy(object))
        return pd.Series(pd.arrays.IntegerArray(utc, ~ok))

    once = instant.asNondeterministic()  # else a filter on the result would convert each text twice

    def column(text: Column, feed: Column) -> Column:
        return once(text, feed)

    return column


def with_instant(df: DataFrame, text: str, feed: str, feeds: DataFrame, labels: DataFrame, name: str = "utc_micros") -> DataFrame:
    """df with a bigint column of instants beside its own columns; a column of that name is replaced."""
    return df.withColumn(name, instant_column(feeds, labels)(df[text], df[feed]))
