"""Instants of mixed texts: fixed cases, and rendered instants against the library's zone arithmetic."""

import random
import zoneinfo
from datetime import UTC, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.timestamps import _RULE, CYCLE, MOST_MASKS, Normaliser, ZoneTables, _changes, _shape, instant_column, layout_of, with_instant, zone_tables

FEEDS = {"berlin": ("Europe/Berlin", "DMY"), "york": ("America/New_York", "MDY"), "none": (None, "MDY"), "fixed": ("+05:30", None)}
LABELS = {"NYC": "America/New_York", "CET": "+01:00", "UTC": "UTC", "BER": "Europe/Berlin"}
MICRO = timedelta(microseconds=1)


@pytest.fixture(scope="module")
def normaliser():
    return Normaliser(zone_tables(), FEEDS, LABELS)


def at(text):
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1, tzinfo=UTC)) // MICRO if text else None


CASES = [
    ("2022-07-01", "berlin", "2022-06-30T22:00:00+00:00"), ("2022/07/01 UTC", "berlin", "2022-07-01T00:00:00+00:00"), ("  2022-07-01 12:30\t", "berlin", "2022-07-01T10:30:00+00:00"),
    ("03/04/2022 05:06", "berlin", "2022-04-03T03:06:00+00:00"), ("03/04/2022 05:06", "york", "2022-03-04T10:06:00+00:00"), ("3.4.2022", "york", "2022-03-04T05:00:00+00:00"),
    ("1/15/2022 12:05 AM", "york", "2022-01-15T05:05:00+00:00"), ("01/15/2022 12:05 pm BER", "york", "2022-01-15T11:05:00+00:00"), ("20220115", "none", None),
    ("20220115103000", "york", "2022-01-15T15:30:00+00:00"), ("1642242600", "none", "2022-01-15T10:30:00+00:00"), ("1642242600123", "none", "2022-01-15T10:30:00.123+00:00"),
    ("1642242600123456", "none", "2022-01-15T10:30:00.123456+00:00"), ("Sat, 15 Jan 2022 10:30:00 +0100", "none", "2022-01-15T09:30:00+00:00"), ("Sun, 15 Jan 2022 10:30:00 +0100", "none", None),
    ("15 January 2022", "berlin", "2022-01-14T23:00:00+00:00"), ("15-JAN-2022 10:30:00 NYC", "berlin", "2022-01-15T15:30:00+00:00"), ("Jan 5, 2022 1:02 PM CET", "none", "2022-01-05T12:02:00+00:00"),
    ("2022-01-15T10:30:00.123456789+05:30", "none", "2022-01-15T05:00:00.123456+00:00"), ("2022-01-15 10:30:00,1Z", "none", "2022-01-15T10:30:00.1+00:00"), ("20220115T103000+01", "none", "2022-01-15T09:30:00+00:00"),
    ("2022-01-15T10:30:00[Asia/Tokyo]", "none", "2022-01-15T01:30:00+00:00"), ("2022-01-15 10:30:00 America/New_York", "none", "2022-01-15T15:30:00+00:00"), ("2022-01-15T10:30:00." + "7" * 300 + "Z", "none", "2022-01-15T10:30:00.777777+00:00"),
    ("2022-01-15 00:00", "fixed", "2022-01-14T18:30:00+00:00"), ("01/02/2022", "fixed", None), ("2022-03-27 02:30", "berlin", None), ("2022-10-30 02:30", "berlin", None),
    ("2022-10-30 02:30+02:00", "berlin", "2022-10-30T00:30:00+00:00"), ("2022-10-30 03:00", "berlin", "2022-10-30T02:00:00+00:00"), ("9999-12-31", "berlin", "9999-12-30T23:00:00+00:00"), ("9999-07-01 12:00", "york", "9999-07-01T16:00:00+00:00"), ("2050-07-01 12:00 BER", "none", "2050-07-01T10:00:00+00:00"),
    ("2022-02-29", "berlin", None), ("2024-02-29 UTC", "none", "2024-02-29T00:00:00+00:00"), ("2022-01-15 24:00", "berlin", None), ("2022-01-15 13:00 PM", "berlin", None), ("2022-01-15 10:30 XYZ", "berlin", None),
    ("2022-01-15 10:30 EST", "berlin", None), ("2022-01-15 10:30 Mars/Base", "berlin", None), ("2022-01-15 10:30 +25:00", "berlin", None), ("0000-01-01", "berlin", None), ("", "berlin", None), (None, "berlin", None),
    ("n/a", "berlin", None), ("123", "berlin", None), ("٢٠٢٢-01-15", "berlin", None), ("x" * 100_000, "berlin", None), ("2022-01-15", None, None), ("2022-01-15", "unknown", None), ("2022-01-15Q10:30", "berlin", None),
]


def test_cases(normaliser):
    utc, ok = normaliser([c[0] for c in CASES], [c[1] for c in CASES])
    got = [int(u) if o else None for u, o in zip(utc, ok, strict=True)]
    wrong = [(c, g) for c, g in zip(CASES, got, strict=True) if g != at(c[2])]
    assert not wrong


def test_masks_are_mapped_once():
    layout_of.cache_clear()
    assert layout_of("9999-99-99")["Y"] == (0, 4) and layout_of("aa") is None
    layout_of("9999-99-99")
    assert layout_of.cache_info().hits == 1


def test_more_masks_than_are_kept():
    valid = [("2022-07-01", "2022-06-30T22:00:00+00:00"), ("15-JAN-2022 10:30:00 NYC", "2022-01-15T15:30:00+00:00"), ("3.4.2022", "2022-04-02T22:00:00+00:00")]
    texts, expected = [], []
    for i in range(130_000):  # as many masks
        texts.append(f"{i:b}".replace("0", ".").replace("1", "-"))
        expected.append(None)
        if i % 1_000 == 0:
            for text, instant in valid:
                texts.append(text)
                expected.append(at(instant))
    for size in (len(texts), 10_000):
        n, got = Normaliser(zone_tables(), FEEDS, LABELS), []
        for a in range(0, len(texts), size):
            batch = texts[a : a + size]
            got += [int(u) if o else None for u, o in zip(*n(batch, ["berlin"] * len(batch)), strict=True)]
        assert got == expected
        n(texts[:1], ["berlin"])
        assert len(n.number) <= MOST_MASKS


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2036, 12, 30)) | st.datetimes(datetime(1, 1, 3), datetime(9999, 12, 28)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "America/Sao_Paulo"]))
def test_wall_times_against_the_library(wall, zone):
    z, found = ZoneInfo(zone), set()
    for fold in (0, 1):
        u = wall.replace(tzinfo=z, fold=fold).astimezone(UTC)
        if u.astimezone(z).replace(tzinfo=None, fold=0) == wall:
            found.add((u - datetime(1970, 1, 1, tzinfo=UTC)) // MICRO)
    n = Normaliser(zone_tables(), {"f": (zone, "DMY")}, {})
    utc, ok = n([wall.isoformat(" ", "microseconds"), f"{wall:%d/%m}/{wall.year:04} {wall:%H:%M:%S.%f}"], ["f", "f"])
    assert [int(u) if o else None for u, o in zip(utc, ok, strict=True)] == [found.pop() if len(found) == 1 else None] * 2


def test_rules_go_on_as_the_library_says():
    rng = random.Random(9)
    for zone in sorted(zone_tables().zones):
        z = ZoneInfo(zone)
        if (first := zone_tables().zones[zone].rule_year) is not None:
            assert set(_shape(np.arange(first, first + CYCLE)).tolist()) == set(range(14))
        local = [datetime(rng.choice([2037, 2038, 2039, 2064, 2065, 2066, 2067, 2099, 2100, 2101, 2399, 2400, rng.randrange(2037, 9999)]), 1, 1) + timedelta(hours=rng.randrange(364 * 24)) for _ in range(40)]
        utc, ok = zone_tables().to_utc(np.array([(t - datetime(1970, 1, 1)) // MICRO for t in local]), zone)
        for t, u, good in zip(local, utc.tolist(), ok.tolist(), strict=True):
            found = {(x - datetime(1970, 1, 1, tzinfo=UTC)) // MICRO for f in (0, 1) if (x := t.replace(tzinfo=z, fold=f).astimezone(UTC)).astimezone(z).replace(tzinfo=None, fold=0) == t}
            assert (found == {u}) if good else len(found) != 1, (zone, t)


def test_rules_give_what_files_list():
    for name in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "America/Santiago", "Africa/Cairo", "America/Nuuk", "Europe/Dublin"):
        data = next(f for p in zoneinfo.TZPATH if (f := Path(p) / name).is_file()).read_bytes()
        z = zone_tables().zones[name]
        listed = dict(zip(z.at.tolist(), z.offset[1:].tolist(), strict=True))
        by_rule = {t * 1_000_000: o * 1_000_000 for t, o in _changes(_RULE.fullmatch(data.rsplit(b"\n", 2)[-2].decode()), range(2050, 2066))}
        assert by_rule.items() <= listed.items() and len(by_rule) == 32


def test_tables_have_a_version_and_are_checked():
    tables = zone_tables()
    assert tables.version != "unknown" and len(tables.zones) > 400 and tables.checked() is tables
    with pytest.raises(RuntimeError):
        ZoneTables("another", tables.zones, tables.checksum).checked()


def test_on_spark_with_clashing_names_and_no_rows(spark):
    feeds = spark.createDataFrame([("berlin", "Europe/Berlin", "DMY", "x"), (None, "UTC", "DMY", "y")], "feed string, zone_name string, date_order string, utc_micros string")
    labels = spark.createDataFrame([("NYC", "America/New_York"), (None, None)], "label string, zone_name string")
    rows = spark.createDataFrame([("2022-07-01", "berlin", 1), ("2022-07-01", "berlin", 1), (None, None, None)], "text string, feed string, utc_micros int")
    got = with_instant(rows, "text", "feed", feeds, labels)
    assert sorted((r.utc_micros for r in got.collect()), key=str) == [at("2022-06-30T22:00:00+00:00")] * 2 + [None]
    assert with_instant(rows.limit(0), "text", "feed", feeds.limit(0), labels.limit(0)).collect() == []
    plan = rows.select(instant_column(feeds, labels)(rows.text, rows.feed).alias("u")).where("u is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
