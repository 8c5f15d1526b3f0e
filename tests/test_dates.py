"""Dates of feeds: literal cases, and made-up ones against the parser that such feeds are usually read with."""

import datetime as dt
import random
import warnings

import pytest
from newswell.functions import dates
from pyspark.sql import functions as F

UTC, SEOUL = dt.timezone.utc, dt.timezone(dt.timedelta(hours=9))


def parsed(spark, texts, lang="en"):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").select("k", F.date_format(dates.parse_date(F.col("c"), F.lit(lang)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


CASES = {
    "Wed, 1 Feb 2024 09:00:00 +0900": "2024-02-01 00:00:00",
    "Wed, 31 Jan 2024 9:00:00 GMT": "2024-01-31 09:00:00",
    "2024-01-31T09:00:00.123456+00:00": "2024-01-31 09:00:00.123456",
    "2024-01-31T09:00+09:00": "2024-01-31 00:00:00",
    "2024-01-31 09:00": "2024-01-31 09:00:00",
    "2024-01-31T09:00:00Z": "2024-01-31 09:00:00",
    "2024-01-31T09:00:00.5Z": "2024-01-31 09:00:00.500000",
    "2024-01-31T09:00:00.123456789Z": "2024-01-31 09:00:00.123456",
    "2024-01-31": "2024-01-31 00:00:00",
    "2024/1/31": "2024-01-31 00:00:00",
    "2024.01.31 18:58:52": "2024-01-31 18:58:52",
    "20240131": "2024-01-31 00:00:00",
    "20240131T090000Z": "2024-01-31 09:00:00",
    "20240131T0900": "2024-01-31 09:00:00",
    "31 Jan 2024": "2024-01-31 00:00:00",
    "31 January 2024 9:05": "2024-01-31 09:05:00",
    "31-Jan-2024": "2024-01-31 00:00:00",
    "Jan 31, 2024": "2024-01-31 00:00:00",
    "January 31, 2024 9:05 PM": "2024-01-31 21:05:00",
    "Jan 31 2024 12:05 a.m.": "2024-01-31 00:05:00",
    "Sept 5, 2024": "2024-09-05 00:00:00",
    "5th May 2024": "2024-05-05 00:00:00",
    "Wednesday, January 31, 2024 09:00:00": "2024-01-31 09:00:00",
    "Wed Jan 31 09:00:00 2024": "2024-01-31 09:00:00",
    "Wed Jan 31 09:00:00 UTC 2024": "2024-01-31 09:00:00",
    "01/31/2024": "2024-01-31 00:00:00",
    "31/01/2024 10:11:12": "2024-01-31 10:11:12",
    "01/02/2024": "2024-01-02 00:00:00",
    "Wed, 31 Jan 24 09:00:00 GMT": "2024-01-31 09:00:00",
    "31 Jan 2024 09:00:00 -0330": "2024-01-31 12:30:00",
    "31 Jan 2024 09:00:00 +09": "2024-01-31 00:00:00",
    "31 Jan 2024 09:00:00 GMT+3": "2024-01-31 12:00:00",
    "31 Jan 2024 09:00:00 GMT +0300": "2024-01-31 09:00:00",
    "31 Jan 2024 09:00:00 EST -0500": "2024-01-31 14:00:00",
    "Wed, 31 Jan 2024 09:00:00 EST": "2024-01-31 09:00:00",
    "Wed, 31 Jan 2024 09:00:00 +0900 (KST)": "2024-01-31 00:00:00",
    "  2024-01-31T09:00:00+0900\n": "2024-01-31 00:00:00",
    "2024-02-30": None,
    "2024-01-31 25:00": None,
    "31 Foo 2024": None,
    "soon": None,
    "": None,
    "2024-01-31 soon": None,
    "13:00 PM": None,
    "2024-01-31T09:00:00+9900": None,
}


def test_cases(spark):
    want = [None if w is None else w if "." in w else w + ".000000" for w in CASES.values()]
    assert dict(zip(CASES, parsed(spark, list(CASES)))) == dict(zip(CASES, want))
    assert parsed(spark, [None]) == [None]


def test_texts_without_a_zone_are_local(spark):
    naive = ["2024-01-31 09:00", "Wed, 31 Jan 2024 09:00:00", "Jan 31, 2024 9 Feb", "Wed, 31 Jan 2024 09:00:00 KST", "2024-01-31 09:00Z"]
    assert parsed(spark, naive, "ko") == ["2024-01-31 00:00:00.000000"] * 2 + [None, "2024-01-31 00:00:00.000000", "2024-01-31 09:00:00.000000"]


@pytest.mark.parametrize("lang", ["en", "ko"])
def test_made_up_dates_equal_the_usual_parser(spark, lang):
    parser = pytest.importorskip("dateutil.parser")
    rng = random.Random(lang)
    days = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d %Y", "%a, %d %b %Y", "%A, %B %d, %Y", "%m/%d/%Y", "%Y%m%d", "%d-%b-%Y", "%d %b %y"]
    clocks = ["", " %H:%M", " %H:%M:%S", "T%H:%M:%S", " %I:%M %p", " %H:%M:%S.%f", " %I:%M:%S%p"]
    zones = ["", "Z", " GMT", " UTC", " +0900", "+09:00", "-0330", " -08", " EST", " UTC+2", " +0530 (IST)"]
    texts = []
    for _ in range(400):
        t = dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randrange(30 * 365 * 86400), microseconds=rng.randrange(10**6))
        day, clock = rng.choice(days), rng.choice(clocks)
        if day == "%Y%m%d" and clock:
            clock = "T%H%M%S"
        texts.append(t.strftime(day + clock).replace(" 0", rng.choice((" ", " 0")) if day not in ("%Y%m%d", "%d %b %y") else " 0") + (rng.choice(["", " GMT", " +0900"] if clock.endswith("%p") else zones) if clock and clock != "T%H%M%S" else ""))
    want = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for t in texts:
            x = parser.parse(t)
            x = x if x.tzinfo else x.replace(tzinfo=SEOUL if lang == "ko" else UTC)
            want.append(x.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f"))
    assert [(t, g) for t, g, w in zip(texts, parsed(spark, texts, lang), want) if g != w] == []
