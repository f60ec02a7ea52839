"""Column drops and casts after flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.functions.numbers import to_double, to_long

ID_COLUMNS = ["fullVisitorId", "visitId"]
LABEL = "total_revenue"

# Flattened columns that hold a single value.
SINGLE_VALUED_COLUMNS = [
    "device_browserSize",
    "device_browserVersion",
    "device_flashVersion",
    "device_language",
    "device_mobileDeviceBranding",
    "device_mobileDeviceInfo",
    "device_mobileDeviceMarketingName",
    "device_mobileDeviceModel",
    "device_mobileInputSelector",
    "device_operatingSystemVersion",
    "device_screenColors",
    "device_screenResolution",
    "geoNetwork_cityId",
    "geoNetwork_latitude",
    "geoNetwork_longitude",
    "geoNetwork_networkLocation",
    "trafficSource_adwordsClickInfo_criteriaParameters",
]

# Totals that are whole numbers, and totals that are money.
WHOLE_TOTALS = [
    "totals_bounces",
    "totals_hits",
    "totals_newVisits",
    "totals_pageviews",
    "totals_sessionQualityDim",
    "totals_timeOnSite",
    "totals_transactions",
    "totals_visits",
]
MONEY_TOTALS = ["totals_totalTransactionRevenue", "totals_transactionRevenue"]


def drop_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*(SINGLE_VALUED_COLUMNS if columns is None else columns))


def cast_totals(
    df: DataFrame, whole: list[str] | None = None, money: list[str] | None = None
) -> DataFrame:
    """Whole-number totals to bigint and money totals to double; bad values become null."""
    types = {f.name: f.dataType for f in df.schema}
    casts = {}
    for name in WHOLE_TOTALS if whole is None else whole:
        if name in types:
            casts[name] = to_long(F.col(name), types[name])
    for name in MONEY_TOTALS if money is None else money:
        if name in types:
            casts[name] = to_double(F.col(name), types[name])
    return df.withColumns(casts) if casts else df


def cast_ids(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Identifiers as text."""
    names = [c for c in (ID_COLUMNS if columns is None else columns) if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in names}) if names else df
