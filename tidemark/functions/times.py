"""Local wall-clock times as instants: hours that a zone skips or has twice are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def wall_clock(local: Column, zone: str) -> Column:
    """The instant (timestamp) of a local time without a zone, such as '2024-03-10 13:00:00'.

    A time that the zone skips is moved forward to the first one that exists; one that the zone has twice is null,
    as is a null or unreadable time. A skipped stretch is taken to begin at a multiple of its own length (as every
    change to summer time does).
    """
    t = local.try_cast("timestamp_ntz")
    wall = F.unix_micros(F.concat(t.cast("string"), F.lit("Z")).cast("timestamp"))  # the local time's own digits, in any session
    return _instant(wall, zone)


def _offset(instant: Column, zone: str) -> Column:
    """Microseconds that the zone's clocks are ahead at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def _instant(wall: Column, zone: str) -> Column:
    # the offsets a day before and after; a zone changes its clocks once in two days at most
    before, after = _offset(wall - _DAY, zone), _offset(wall + _DAY, zone)
    early, late = wall - before, wall - after
    fits = lambda u: _offset(u, zone) == wall - u
    gap = F.when(after > before, after - before).otherwise(F.lit(1))
    moved = F.floor(early / gap) * gap
    out = F.when(before == after, early).when(fits(early) & fits(late), None).when(fits(early), early).when(fits(late), late).otherwise(moved)
    return F.timestamp_micros(out)
