"""The reference time.

Every operator that depends on "now" takes ``as_of``; leaving it out means the
time the query starts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = Column | datetime | str | None


def instant(as_of: AsOf = None) -> Column:
    """``as_of`` as a TIMESTAMP column."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole-second distance in hours; negative when ``earlier`` lies ahead."""
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def plus_hours(moment: Column, hours: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), hours.cast("int"))


def minutes_ago(moment: Column, as_of: Column) -> Column:
    """``N min ago`` text for an activity feed."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(moment)
    return F.format_string("%d min ago", F.floor(seconds / 60))
