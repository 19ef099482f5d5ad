import random
import re
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from evidentia.llm.timestamps import date_tokens, normalise

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DATES = [
    (r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", "ymd"), (r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", "ymd"), (r"(?P<d>\d\d)[.](?P<m>\d\d)[.](?P<y>20\d\d)", "dmy"),
    (r"(?P<d>\d\d) (?P<b>" + "|".join(MONTHS) + r") (?P<y>20\d\d)", "dby"), (r"(?P<a>\d\d)/(?P<c>\d\d)/(?P<y>20\d\d)", "slash"),
]
TIME = r"(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<half>[AP]M))?(?: ?(?P<off>Z|[+-]\d\d:?\d\d))?)?"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def day(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def us(at):
    return (at - EPOCH) // timedelta(microseconds=1)


def parsed(raw, zone):
    """('epoch', us) | ('dates', month first, day first, seconds, offset) | None."""
    t = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}", t, re.ASCII) or re.fullmatch("[0-9]{13}", t, re.ASCII):
        return "epoch", int(t) * (1_000_000 if len(t) == 10 else 1000)
    for form, kind in DATES:
        m = re.fullmatch(form + TIME, t, re.ASCII)
        if not m:
            continue
        g = m.groupdict()
        if kind == "slash":
            first, second = day(g["y"], g["a"], g["c"]), day(g["y"], g["c"], g["a"])
        else:
            first = second = day(g["y"], MONTHS.index(g["b"]) + 1 if kind == "dby" else g["m"], g["d"])
        seconds, off = 0, None
        if g["h"]:
            h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
            if mi > 59 or s > 59 or (not 1 <= h <= 12 if g["half"] else h > 23):
                return None
            h = h % 12 + (12 if g["half"] == "PM" else 0) if g["half"] else h
            seconds = h * 3600 + mi * 60 + s
        if g["off"]:
            digits = re.sub(r"\D", "", g["off"]) or "0000"
            if int(digits[:2]) > 14 or int(digits[2:]) > 59:
                return None
            off = (int(digits[:2]) * 60 + int(digits[2:])) * (-60 if g["off"][0] == "-" else 60)
        if off is None:
            try:
                ZoneInfo(zone or "")
            except Exception:
                return None
        return None if first is None and second is None else ("dates", first, second, seconds, off, kind == "slash")
    return None


def brute(rows):
    votes = {}
    read = [(i, source, zone, parsed(raw, zone)) for i, source, zone, raw in rows]
    for _, source, _, p in read:
        if p and p[0] == "dates" and p[5] and (p[1] is None) != (p[2] is None):
            votes.setdefault(source, Counter())["month" if p[1] else "day"] += 1
    for i, source, zone, p in read:
        if p is None:
            yield i, None, "bad", False
        elif p[0] == "epoch":
            yield i, p[1], "epoch", False
        else:
            _, first, second, seconds, off, _ = p
            rule = "plain"
            if first and second and first != second:
                v = votes.get(source, Counter())
                rule = "votes" if v["month"] != v["day"] else "default"
                chosen = second if v["day"] > v["month"] else first
            else:
                chosen = first or second
            wall = datetime(chosen.year, chosen.month, chosen.day) + timedelta(seconds=seconds)
            if off is not None:
                yield i, us(wall.replace(tzinfo=timezone.utc)) - off * 1_000_000, rule, rule != "plain"
                continue
            one, two = (wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1))
            odd = one.utcoffset() != two.utcoffset()  # skipped or repeated
            yield i, us(wall.replace(tzinfo=timezone.utc)) - int(one.utcoffset() / timedelta(microseconds=1)), rule, rule != "plain" or odd


ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "America/Sao_Paulo", "Pacific/Apia"]
CASES = [
    None, "", " ", "n/a", "2024-02-30", "2023-02-29", "2024-02-29", "20240229", "2024022", "202402291", "29.02.2024", "29 Feb 2024", "29 feb 2024", "29 Foo 2024", "1733025832", "1733942329007", "173394232900",
    "13/01/2024", "01/13/2024", "01/02/2024", "02/02/2024", "30/02/2024", "13/13/2024", "2024-01-01T24:00", "2024-01-01T23:60", "2024-01-01T23:59:60", "2024-01-01T23:59:59", "2024-01-01 12:00 AM", "2024-01-01 12:00PM",
    "2024-01-01 13:00 PM", "2024-01-01 00:10 AM", "2024-01-01 11:59:59 PM +0530", "2024-01-01T10:00 Z", "2024-01-01T10:00-14:59", "2024-01-01T10:00+15:00", "2024-01-01T10:00+0560", "2024-01-01T10:00z", "2024-01-01t10:00",
    "2024-01-01  10:00", "2024-01-01T10:00  Z", "\t2024-01-01\r\n", "2024-01-01\x85", "2024-01-01 ", "２０２４-01-01", "1999-12-31", "2100-01-01", "2099-12-31", "2000-01-01", "2024-03-10 02:30", "2024-11-03 01:30", "2024-11-03 02:00",
    "2024-03-31 02:30", "2024-10-27 02:59:59", "2024-10-27 03:00", "2024-04-07 01:45", "2024-10-06 02:15", "10/03/2024 02:30", "03/10/2024 02:30 AM", "2018-11-04 00:30", "2011-12-30 10:00", "2018-02-17 23:30", "x" * 100_000, "2024-01-01 " + " " * 50_000, "0" * 10, "9" * 13,
]


@pytest.fixture(scope="module")
def rows():
    drawn, random_ = [], random.Random(5)
    for i, raw in enumerate(CASES):
        for j, zone in enumerate([*ZONES, None, "No/Zone", "+01:00"]):
            if zone == "+01:00" and raw and "/" in raw:
                continue
            drawn.append((i * 100 + j, random_.choice(["a", "b", "c", None]), zone, raw))
    for i in range(1500):
        d, m, y = random_.randint(1, 31), random_.randint(1, 12), random_.randint(2000, 2099)
        a, b = (d, m) if random_.random() < 0.5 else (m, d)
        drawn.append((10**6 + i, f"s{i % 7}", random_.choice(ZONES), f"{a:02}/{b:02}/{y} {random_.randint(0, 24):02}:{random_.randint(0, 60):02}"))
    return [r for r in drawn if r[2] != "+01:00"]


def test_equals_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string").selectExpr("*", "1 AS token", "2 AS dmy", "'x' AS rule")
    want = sorted(brute(rows), key=str)
    for parts in (1, 5):
        got = [tuple(r) for r in normalise(frame.repartition(parts)).select("stamp_id", "utc_us", "rule", "ambiguous").collect()]
        assert sorted(got, key=str) == want
    assert {r[2] for r in want} == {"bad", "epoch", "plain", "votes", "default"}


def test_ties_default_and_repeated_rows(spark):
    rows = [(1, "a", "UTC", "13/01/2024"), (1, "a", "UTC", "01/13/2024"), (2, "a", "UTC", "03/04/2024"), (2, "a", "UTC", "03/04/2024"), (None, None, "UTC", "25/12/2024"), (3, None, "UTC", "03/04/2024")]
    got = normalise(spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")).collect()
    rules = sorted((r.stamp_id or 0, r.rule, r.utc_us) for r in got)
    march, april = us(datetime(2024, 3, 4, tzinfo=timezone.utc)), us(datetime(2024, 4, 3, tzinfo=timezone.utc))
    assert [r for r in rules if r[0] == 2] == [(2, "default", march)] * 2 and (3, "votes", april) in rules


def test_majority_is_a_parameter(spark):
    rows = [(i, "a", "UTC", "13/01/2024") for i in range(3)] + [(9, "a", "UTC", "01/13/2024"), (10, "a", "UTC", "03/04/2024")]
    frame = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    rule = lambda m: normalise(frame, majority=m).where("stamp_id = 10").first().rule
    assert (rule(1.0), rule(2.9), rule(3.0)) == ("votes", "votes", "default")


def test_dictionary_has_every_date_and_both_readings(spark):
    tokens = {r.token: (r.dmy, r.mdy) for r in date_tokens(spark).collect()}
    days = (date(2099, 12, 31) - date(2000, 1, 1)).days + 1
    assert len(tokens) == 4 * days + 2 * days - 12 * 12 * 100
    number = lambda y, m, d: (date(y, m, d) - date(1970, 1, 1)).days
    assert tokens["03/04/2024"] == (number(2024, 4, 3), number(2024, 3, 4)) and tokens["13/04/2024"] == (number(2024, 4, 13), None)
    assert tokens["29 Feb 2024"][0] == number(2024, 2, 29) and "29.02.2023" not in tokens


def test_empty(spark):
    assert normalise(spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")).count() == 0
