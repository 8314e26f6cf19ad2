"""SQL for the instants of mixed timestamp texts, written for DuckDB apart from the operator: shapes by regular expressions, zones by its ICU library."""

from __future__ import annotations

#: The characters that Python takes for blanks, for a regular expression.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIME = r"(?:(?:([A-Za-z])| +)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?"
_TAIL = r"((?:[^0-9].*)?)$"
_WEEKDAY = r"(?:([A-Za-z]{3,9}),? )?"
#: Shapes of texts with the names of their groups.
_SHAPES = (
    (r"^([0-9]{4})([-/.])([0-9]{1,2})([-/.])([0-9]{1,2})" + _TIME + _TAIL, "Y s1 M s2 D T h mi s f tail"),
    (r"^([0-9]{1,2})([-/.])([0-9]{1,2})([-/.])([0-9]{4})" + _TIME + _TAIL, "p s1 q s2 Y T h mi s f tail"),
    ("^" + _WEEKDAY + r"([0-9]{1,2})([- ])([A-Za-z]{3,9})([- ])([0-9]{4})" + _TIME + _TAIL, "week D s1 mon s2 Y T h mi s f tail"),
    ("^" + _WEEKDAY + r"([A-Za-z]{3,9}) ([0-9]{1,2}),? ([0-9]{4})" + _TIME + _TAIL, "week mon D Y T h mi s f tail"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:([A-Za-z])| )([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?" + _TAIL, "Y M D T h mi s f tail"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})" + _TAIL, "Y M D tail"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "Y M D h mi s"),
)
_FIELDS = "week mon p q Y M D s1 s2 T h mi s f tail".split()
_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"


def _fields() -> str:
    """The fields of the first shape that a text has, as a struct of texts ('' where the shape has none); null without shape."""
    cases = []
    for pattern, names in _SHAPES:
        at = names.split()
        groups = "[" + ", ".join(f"'{n}'" for n in at) + "]"
        parts = ", ".join(f"{n} := g.{n}" if n in at else f"{n} := ''" for n in _FIELDS)
        equal = " and g.s1 = g.s2" if "s1" in at else ""
        cases.append(f"(select case when regexp_matches(t, '(?s){pattern}'){equal} then struct_pack({parts}) end from (select regexp_extract(t, '(?s){pattern}', {groups}) as g))")
    return "coalesce(" + ",\n        ".join(cases) + ")"


def _offset(text: str) -> str:
    """Microseconds of an offset like +05:30 or -0800; null beyond 18 hours or 59 minutes."""
    digits = f"replace(substr({text}, 2), ':', '')"
    hours, minutes = f"cast(substr({digits}, 1, 2) as bigint)", f"cast(coalesce(nullif(substr({digits}, 3, 2), ''), '0') as bigint)"
    return f"case when regexp_full_match({text}, '[+-][0-9]{{2}}(:?[0-9]{{2}})?') and {hours} <= 18 and {minutes} < 60 then ({hours} * 60 + {minutes}) * 60000000 * case when {text}[1] = '-' then -1 else 1 end end"


def instants(rows: str) -> str:
    """SELECT of the columns of `rows` (a relation with columns text and feed among others) and utc_micros, null where no instant is named."""
    number = lambda c: f"try_cast(nullif({c}, '') as bigint)"
    return f"""
    (with zones as (select name as region_name from pg_timezone_names()),
    cut as (select *, regexp_replace(regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', '') as t from {rows}),
    shaped as (select *, case when regexp_full_match(t, '[0-9]+') and length(t) in (10, 13, 16) then try_cast(t as bigint) * case length(t) when 10 then 1000000 when 13 then 1000 else 1 end end as unix,
        {_fields()} as x from cut),
    fed as (select s.*, f.zone_name as feed_zone, f.date_order from shaped s left join (select feed, any_value(zone_name) as zone_name, any_value(date_order) as date_order from feeds group by feed) f on s.feed = f.feed),
    halved as (select *, regexp_extract(x.tail, '^\\s*([AaPp]\\.?[Mm]\\.?)(?:[^A-Za-z]|$)', 1) as half from fed),
    tailed as (select *, case when half <> '' then substr(ltrim(x.tail, e' \\t\\n\\r\\f\\v'), length(half) + 1) else x.tail end as rest from halved),
    named as (select *, lower(replace(half, '.', '')) as ampm, regexp_full_match(rest, '\\s*([+-][0-9]{{2}}(:?[0-9]{{2}})?)?\\s*(\\[[^\\[\\]\\s]+\\]|[A-Za-z][A-Za-z0-9_+/-]*)?') as tail_ok,
        regexp_extract(rest, '^\\s*([+-][0-9]{{2}}(?::?[0-9]{{2}})?)', 1) as own_offset,
        regexp_replace(regexp_extract(rest, '(\\[[^\\[\\]\\s]+\\]|[A-Za-z][A-Za-z0-9_+/-]*)$', 1), '[\\[\\]]', '', 'g') as own_name from tailed),
    zoned as (select n.*, case when own_offset <> '' then own_offset when own_name = '' then feed_zone when l.label is not null then l.zone_name when own_name in ('Z', 'z') then '+00:00'
        when contains(own_name, '/') then own_name end as zone from named n left join zone_labels l on n.own_name = l.label),
    dated as (select *, {number('x.Y')} as year,
        case when x.p <> '' then case date_order when 'DMY' then {number('x.q')} when 'MDY' then {number('x.p')} end
            when x.mon <> '' then nullif(list_position(list_transform({_MONTHS}, lambda m: lower(x.mon) = m or lower(x.mon) = m[:3] or (lower(x.mon) = 'sept' and m = 'september')), true), 0)
            else {number('x.M')} end as month,
        case when x.p <> '' then case date_order when 'DMY' then {number('x.p')} when 'MDY' then {number('x.q')} end else {number('x.D')} end as day,
        coalesce({number('x.h')}, 0) as hour, coalesce({number('x.mi')}, 0) as minute, coalesce({number('x.s')}, 0) as second,
        coalesce(try_cast(nullif(rpad(substr(x.f, 1, 6), case when x.f = '' then 0 else 6 end, '0'), '') as bigint), 0) as micros from zoned),
    clocked as (select *, case when ampm = '' then hour when x.h <> '' and hour between 1 and 12 then hour % 12 + case when ampm = 'pm' then 12 else 0 end end as hour24 from dated),
    local as (select *, case when x is not null and (x.tail = '' or tail_ok) and upper(x.T) in ('', 'T') and year >= 1 and hour24 < 24 and minute < 60 and second < 60
        then try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', year, month, day, hour24, minute, second) as timestamp) + to_microseconds(micros) end as moment from clocked),
    checked as (select *, case when x.week = '' or lower(dayname(moment)) = lower(x.week) or lower(dayname(moment))[:3] = lower(x.week) then moment end as wall, {_offset('zone')} as shift, coalesce(region_name, 'UTC') as region, region_name is not null as known
        from local left join zones on region_name = zone)
    select * exclude (t, unix, x, feed_zone, date_order, half, rest, ampm, tail_ok, own_offset, own_name, zone, year, month, day, hour, minute, second, micros, hour24, moment, wall, shift, region, known, region_name),
        case when unix is not null then unix when wall is null then null when shift is not null then epoch_us(wall) - shift when known then
            (select case when len(u) = 1 then u[1] end from (select list_filter(list_transform(range(-24, 25), lambda k: epoch_us(timezone(region, wall)) + k * 900000000), lambda v: timezone(region, make_timestamptz(v)) = wall) as u)) end as utc_micros
    from checked)"""
