"""Pages of the default order from a table stored in one folder per day.

A page is named by the row it follows or precedes, not by an offset. Days are opened newest first (oldest first when going back), one, then two,
then four at a time, until the page is full: a deep page opens the days it needs and no others, with filters or without.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.operators.listing import PAGE_SIZE, default_order, score_or_zero, shuffled
from leafsift.sources.schemas import TABLES

NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a date


@dataclass(frozen=True)
class Place:
    """A row's place in the default order. Ids are unique."""

    date: str | None
    score: float | None
    id: int

    def after(self) -> Column:
        """Whether a row stands later."""
        return self._beyond(lambda a, b: a < b, lambda a, b: a > b, F.substring("date", 1, 10).isNull())

    def before(self) -> Column:
        return self._beyond(lambda a, b: a > b, lambda a, b: a < b, F.lit(False))

    def _beyond(self, falls: Callable, rises: Callable, beyond_days: Column) -> Column:
        score, mark = F.lit(float(self.score or 0.0)), F.md5(F.lit(str(self.id)).cast("binary"))
        tied = falls(score_or_zero(), score) | ((score_or_zero() == score) & rises(shuffled(), mark))
        day = F.substring("date", 1, 10)
        if self.date is None:  # undated rows stand last
            return (day.isNull() & tied) if falls(0, 1) else (day.isNotNull() | tied)
        own = F.lit(self.date[:10])
        return F.coalesce(falls(day, own) | ((day == own) & tied), beyond_days)


def day_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder by day, newest first; rows without a date have the day ''."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    days = {unquote(n.removeprefix("day=")): f"{path}/{n}" for n in names if n.startswith("day=")}
    return dict(sorted((("" if d == NO_DAY else d, f) for d, f in days.items()), reverse=True))


def _backwards() -> list[Column]:
    """The default order from its end."""
    return [F.substring("date", 1, 10).asc_nulls_first(), score_or_zero().asc(), shuffled().desc()]


def page_by_day(
    spark: SparkSession, path: str, place: Place | None = None, back: bool = False, limit: int = PAGE_SIZE, where: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """The page after ``place`` (the first one without), or the one before it, of the rows that ``where`` leaves."""
    own = None if place is None else (place.date or "")[:10]
    days = [(d, f) for d, f in day_folders(spark, path).items() if own is None or (d >= own if back else d <= own)]
    if back:
        days.reverse()
    order = _backwards() if back else default_order()

    def rows(folders: list[str]) -> DataFrame:
        read = spark.read.schema(TABLES["article"])
        found = where(read.parquet(*folders) if folders else spark.createDataFrame([], TABLES["article"]))
        return found if place is None else found.filter(place.before() if back else place.after())

    chosen: list[str] = []
    missing, step = limit, 1
    while days and missing > 0:
        opened, days, step = [f for _, f in days[:step]], days[step:], 2 * step
        if found := rows(opened).limit(missing).count():
            chosen += opened
            missing -= found
    return rows(chosen).orderBy(*order).limit(limit).orderBy(*default_order())
