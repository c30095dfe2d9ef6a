"""Which postings the public sees, as predicates on an explicit reference time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the public window, hours within which an undated posting must have been seen, days ahead
# that a date may lie, days that count as recent, hours of clock skew.
WINDOW_DAYS, VERIFIED_HOURS, AHEAD_DAYS, RECENT_DAYS, SKEW_HOURS = 30, 48, 2, 7, 1
# Sources that give calendar dates only.
DATE_ONLY_SOURCES = ["workday", "amazon", "shopify", "phenom", "successfactors"]


def moment(as_of: datetime | str | Column) -> Column:
    """The reference time as an expression; nothing reads the clock."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def _hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


@dataclass(frozen=True)
class Times:
    posted: str = "posted_at"
    created: str = "created_at"
    seen: str = "last_seen_at"


def publicly_visible(as_of, t: Times = Times(), days: int = WINDOW_DAYS, hours: int = VERIFIED_HOURS) -> Column:
    """Dated inside the window and not beyond tomorrow; or undated (or dated too far ahead), first seen inside the
    window and seen again lately."""
    now = moment(as_of)
    limit = F.date_trunc("day", now) + _days(AHEAD_DAYS)
    start = now - _days(days)
    posted = F.col(t.posted)
    dated = posted.isNotNull() & (posted < limit)
    kept = (F.col(t.created) >= start) & (F.col(t.seen) >= now - _hours(hours))
    return F.coalesce(F.when(dated, posted >= start).otherwise(kept), F.lit(False))


def posted_today(as_of, posted: str = "posted_at") -> Column:
    day = F.date_trunc("day", moment(as_of))
    return F.coalesce((F.col(posted) >= day) & (F.col(posted) < day + _days(1)), F.lit(False))


def posted_within(as_of, days: int = RECENT_DAYS, posted: str = "posted_at", skew: bool = True) -> Column:
    now = moment(as_of)
    low = F.col(posted) >= now - _days(days)
    return F.coalesce(low & (F.col(posted) <= now + _hours(SKEW_HOURS)) if skew else low, F.lit(False))


def effective_date(t: Times = Times()) -> Column:
    return F.coalesce(t.posted, t.created)


def fresh(as_of, t: Times = Times(), days: int = WINDOW_DAYS) -> Column:
    """The older rule: posted, or else created, inside the last days."""
    return F.coalesce(effective_date(t) >= moment(as_of) - _days(days), F.lit(False))


def freshness_status(as_of, active: str = "is_active", t: Times = Times()) -> Column:
    """inactive, recently_posted, recently_discovered (undated only) or active."""
    discovered = F.col(t.posted).isNull() & posted_within(as_of, WINDOW_DAYS, t.created)
    return (
        F.when(~F.coalesce(F.col(active), F.lit(False)), "inactive")
        .when(posted_within(as_of, RECENT_DAYS, t.posted), "recently_posted")
        .when(discovered, "recently_discovered")
        .otherwise("active")
    )


def posted_precision(source: str = "source_name", posted: str = "posted_at") -> Column:
    """date where the source gives no time of day or the time is midnight, else time; null if undated."""
    whole_day = F.lower(F.coalesce(F.col(source), F.lit(""))).isin(DATE_ONLY_SOURCES) | (F.col(posted) == F.date_trunc("day", F.col(posted)))
    return F.when(F.col(posted).isNotNull(), F.when(whole_day, "date").otherwise("time"))


def relative_age(as_of, posted: str = "posted_at") -> Column:
    """today, yesterday, or how many days ago."""
    n = F.datediff(F.to_date(moment(as_of)), F.to_date(F.col(posted)))
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n > 1, F.concat(n.cast("string"), F.lit(" days ago")))
