"""Calendar parts, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400
EPOCH_WEEKDAY = 3  # 1970-01-01 was a Thursday; Monday is 0
SATURDAY = 5


def date_parts(number: Column) -> dict[str, Column]:
    """Weekday (Monday 0), month and weekend flag of a YYYYMMDD number.

    A number that is no date gives null parts and weekend 0; a missing number
    gives three nulls.
    """
    digits = number.try_cast("bigint").cast("string")
    day = F.when(F.length(digits) == 8, F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))
    weekday = F.weekday(day)
    weekend = F.coalesce(weekday >= SATURDAY, F.lit(False)).cast("int")
    return {
        "date_dow": weekday,
        "date_month": F.month(day),
        "date_is_weekend": F.when(number.isNotNull(), weekend),
    }


def unix_parts(seconds: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0) and weekend flag of unix seconds in UTC.

    A missing time gives null hour and weekday and weekend 0.
    """
    hour = F.pmod(F.floor(seconds / SECONDS_PER_HOUR), F.lit(24)).cast("int")
    weekday = F.pmod(F.floor(seconds / SECONDS_PER_DAY) + EPOCH_WEEKDAY, F.lit(7)).cast("int")
    return {
        "vst_hour": hour,
        "vst_dow": weekday,
        "vst_is_weekend": F.coalesce(weekday >= SATURDAY, F.lit(False)).cast("int"),
    }
