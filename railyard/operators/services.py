"""Service days: which services run, and the trips and visits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.functions.scalar import WEEKDAYS


def as_date(text) -> Column:
    """Date of YYYYMMDD; null if it isn't one."""
    return F.try_to_date(F.col(text) if isinstance(text, str) else text, "yyyyMMdd")


def weekday_name(text) -> Column:
    """Weekday of YYYYMMDD as a column; null if it isn't a date."""
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(as_date(text)) + 1)


def weekday_of(date: str) -> str:
    import datetime

    return WEEKDAYS[datetime.datetime.strptime(date, "%Y%m%d").weekday()]


def check_filters(weekday: str | None, date: str | None) -> str | None:
    """The weekday to filter by; raises ValueError for an unknown one, a bad date or two that disagree."""
    if weekday is not None and weekday.lower() not in WEEKDAYS:
        raise ValueError(f"unknown weekday {weekday!r}; one of {', '.join(WEEKDAYS)}")
    if date is None:
        return weekday and weekday.lower()
    try:
        own = weekday_of(date)
    except ValueError as e:
        raise ValueError(f"date filter {date!r} is not YYYYMMDD") from e
    if weekday is not None and weekday.lower() != own:
        raise ValueError(f"{date} is a {own}, not a {weekday}")
    return own


def on_date(calendar: DataFrame, exceptions: DataFrame, date: str) -> DataFrame:
    """service_id of services that run on a date: in range with the weekday's flag, and added ones, without removed ones."""
    day, flag = F.to_date(F.lit(date), "yyyyMMdd"), F.col(weekday_of(date)).try_cast("int")
    regular = calendar.filter((flag == 1) & (as_date("start_date") <= day) & (as_date("end_date") >= day)).select("service_id")
    that_day = exceptions.filter(as_date("date") == day)
    kind = F.col("exception_type").try_cast("int")
    added, removed = that_day.filter(kind == 1).select("service_id"), that_day.filter(kind == 2).select("service_id")
    return regular.union(added).distinct().join(removed, "service_id", "left_anti")


def on_weekday(calendar: DataFrame, exceptions: DataFrame, weekday: str) -> DataFrame:
    """service_id of services with the weekday's flag, or ever added on such a day; removals don't count."""
    regular = calendar.filter(F.col(weekday).try_cast("int") == 1).select("service_id")
    return regular.union(added_on_weekday(exceptions, weekday)).distinct()


def added_on_weekday(exceptions: DataFrame, weekday: str) -> DataFrame:
    """service_id of services ever added on such a day (for feeds without regular services)."""
    day = F.weekday(as_date("date")) == WEEKDAYS.index(weekday)
    return exceptions.filter((F.col("exception_type").try_cast("int") == 1) & day).select("service_id").distinct()


def restrict(trips: DataFrame, visits: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips of the services and the visits of these trips."""
    kept = trips.join(services, "service_id", "left_semi")
    return kept, visits.join(kept, "trip_id", "left_semi")


def inflation(trips: DataFrame, loose: DataFrame, exact: DataFrame) -> DataFrame:
    """Trips of a weekday's services over those of one date."""
    count = lambda s, name: trips.join(s, "service_id", "left_semi").agg(F.count(F.lit(1)).alias(name))
    return count(loose, "n_weekday").crossJoin(count(exact, "n_date")).select("n_weekday", "n_date", F.try_divide(F.col("n_weekday"), F.col("n_date")).alias("ratio"))
