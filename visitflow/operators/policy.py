"""Numeric feature policy and the model input table."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions.dates import date_parts, unix_parts
from visitflow.functions.numbers import log1p_capped, log1p_floor, to_double
from visitflow.operators.clean import ID_COLUMNS, LABEL
from visitflow.operators.encode import encode_categories
from visitflow.operators.order_stats import SORTED_ROWS, exact_quantiles

CAP_QUANTILE = 0.99

# The action of each numeric field. A cap is fitted at the quantile, never preset.
DEFAULT_POLICY = {
    "features": [
        {"field": "total_revenue", "action": "log1p"},
        {"field": "totals_totalTransactionRevenue", "action": "drop"},
        {"field": "totals_transactionRevenue", "action": "drop"},
        {"field": "totals_transactions", "action": "drop"},
        {
            "field": "total_product_viewed",
            "action": "log1p_cap",
            "cap_quantile": 0.99,
        },
        {"field": "total_category_viewed", "action": "log1p"},
        {"field": "totals_hits", "action": "log1p"},
        {"field": "totals_pageviews", "action": "log1p"},
        {"field": "totals_timeOnSite", "action": "log1p"},
        {
            "field": "average_price_product_viewed",
            "action": "log1p_cap",
            "cap_quantile": 0.99,
        },
        {"field": "visitNumber", "action": "log1p"},
        {"field": "date", "action": "drop_raw"},
        {"field": "visitStartTime", "action": "drop_raw"},
    ],
    "derived_features": {
        "date": {"parse": "YYYYMMDD"},
        "visitStartTime": {"parse": "unix_seconds", "timezone": "UTC"},
    },
}

# Order of the numeric columns of the model input.
NUMERIC_ORDER = [
    "total_revenue",
    "total_product_viewed",
    "total_category_viewed",
    "totals_hits",
    "totals_pageviews",
    "totals_timeOnSite",
    "average_price_product_viewed",
    "visitNumber",
    "date_dow",
    "date_month",
    "date_is_weekend",
    "vst_hour",
    "vst_dow",
    "vst_is_weekend",
]


def _number(df: DataFrame, name: str) -> Column:
    return to_double(F.col(f"`{name}`"), df.schema[name].dataType)


def _capped_fields(df: DataFrame, policy: dict) -> dict[str, float]:
    return {
        f["field"]: f.get("cap_quantile", CAP_QUANTILE)
        for f in policy["features"]
        if f["action"] == "log1p_cap" and f["field"] in df.columns
    }


def quantile_caps(
    df: DataFrame, fields: dict[str, float], sorted_rows: int = SORTED_ROWS
) -> dict[str, float]:
    """Exact quantile of each field over the whole table, missing values as 0."""
    wanted = {c: (F.coalesce(_number(df, c), F.lit(0.0)), [q]) for c, q in fields.items()}
    caps = exact_quantiles(df, wanted, sorted_rows=sorted_rows) if wanted else {}
    return {c: values[0] for c, values in caps.items() if values[0] is not None}


def fit_caps(df: DataFrame, policy: dict, sorted_rows: int = SORTED_ROWS) -> dict:
    """Policy with the cap of every capped field fitted on ``df``; a field that is absent has none."""
    caps = quantile_caps(df, _capped_fields(df, policy), sorted_rows)
    fitted = copy.deepcopy(policy)
    for f in fitted["features"]:
        if f["action"] == "log1p_cap":
            f.pop("cap_value", None)
        if f["field"] in caps:
            f["cap_value"] = caps[f["field"]]
    return fitted


def apply_policy(df: DataFrame, policy: dict) -> DataFrame:
    """Leakage drops, log transforms, capped log transforms, calendar parts.

    One projection. A capped field without a stored cap is fitted on ``df``.
    """
    missing = {
        c: q
        for c, q in _capped_fields(df, policy).items()
        if not any(
            f["field"] == c and isinstance(f.get("cap_value"), (int, float))
            for f in policy["features"]
        )
    }
    caps = quantile_caps(df, missing) if missing else {}
    dropped, changed = set(), {}
    for f in policy["features"]:
        name, action = f["field"], f["action"]
        if name not in df.columns:
            continue
        if action == "drop":
            dropped.add(name)
        elif action == "log1p":
            changed[name] = log1p_floor(_number(df, name))
        elif action == "log1p_cap":
            cap = f.get("cap_value")
            cap = caps[name] if not isinstance(cap, (int, float)) else cap
            changed[name] = log1p_capped(_number(df, name), cap)
    added = {}
    for name, parts in (("date", date_parts), ("visitStartTime", unix_parts)):
        if name in (policy.get("derived_features") or {}) and name in df.columns:
            added.update(parts(_number(df, name)))
            dropped.add(name)
    return df.select(
        *[
            changed[c].alias(c) if c in changed else F.col(f"`{c}`")
            for c in df.columns
            if c not in dropped
        ],
        *[c.alias(name) for name, c in added.items()],
    )


def order_columns(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Identifiers, label, numeric, categorical, then the rest."""
    first = [*ID_COLUMNS, LABEL, *NUMERIC_ORDER, *categorical]
    order = list(dict.fromkeys(c for c in [*first, *df.columns] if c in df.columns))
    return df.select(*[F.col(f"`{c}`") for c in order])


def model_input(df: DataFrame, policy: dict, dictionary: dict) -> DataFrame:
    """Model input table of cleaned sessions; row-local when all caps are stored."""
    encoded = encode_categories(apply_policy(df, policy), dictionary)
    return order_columns(encoded, list(dictionary.get("columns") or {}))
