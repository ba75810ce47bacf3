"""Both nights of a year on which clocks change, in several zones, against the standard library."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times


def expected(local, zone):
    """Instants whose local time is this one; none: forward to the first that exists, two: null."""
    z = ZoneInfo(zone)
    utc = {local.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)}
    real = {u for u in utc if u.astimezone(z).replace(tzinfo=None) == local}
    if len(real) == 1:
        return real.pop()
    if len(real) == 2:
        return None
    u = min(utc)
    while u.astimezone(z).utcoffset() == min(utc).astimezone(z).utcoffset() and u > min(utc) - timedelta(hours=3):
        u -= timedelta(minutes=1)
    while u.astimezone(z).utcoffset() == (u - timedelta(minutes=1)).astimezone(z).utcoffset():
        u += timedelta(minutes=1)
    return u


@pytest.mark.parametrize("zone, nights", [("America/New_York", ["2024-03-10", "2024-11-03"]), ("Europe/Berlin", ["2024-03-31", "2024-10-27"]), ("Australia/Lord_Howe", ["2024-04-07", "2024-10-06"]), ("Asia/Kolkata", ["2024-03-10"])])
def test_nights_on_which_clocks_change(spark, zone, nights):
    rows = [(datetime.fromisoformat(n) + timedelta(minutes=m),) for n in nights for m in range(-120, 300, 15)]
    df = spark.createDataFrame([(str(t),) for (t,) in rows], "local string").withColumn("u", F.unix_seconds(times.wall_clock(F.col("local"), zone)))
    got = {r.local: r.u for r in df.collect()}
    seen = []
    for (t,) in rows:
        want = expected(t, zone)
        seen.append(want)
        assert got[str(t)] == (None if want is None else int(want.timestamp())), (zone, t)
    assert zone == "Asia/Kolkata" or None in seen


def test_the_session_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-06-01 12:00:00",)], "local string")
    read = lambda: [r.u for r in df.select(F.unix_seconds(times.wall_clock(F.col("local"), "America/New_York")).alias("u")).collect()]
    here = read()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read() == here == [1710054000, 1717257600]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_cannot_be_read_is_null(spark):
    df = spark.createDataFrame([("2024-09-08 13:00:00",), (None,), ("soon",)], "local string")
    got = [r.u for r in df.select(F.unix_seconds(times.wall_clock(F.col("local"), "America/New_York")).alias("u")).collect()]
    assert got == [int(datetime(2024, 9, 8, 17, tzinfo=timezone.utc).timestamp()), None, None]
