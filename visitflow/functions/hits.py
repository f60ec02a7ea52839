"""Per-session metrics of the hits cell.

Each step is an expression over one column, so the operator can project it once
and keep Spark from evaluating a parse again for every metric.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitflow.functions.binding import let
from visitflow.functions.literals import empty_list, is_truthy, variant_text, variant_type
from visitflow.functions.numbers import float_or_zero
from visitflow.functions.text import known_leaf, last_segment, trim_ws

MICROS = 1e6  # money is in micros: 1e6 = 1 USD
PURCHASE = "6"
# Keys whose values count as revenue, at any depth of a purchase hit.
REVENUE_KEYS = ["transactionRevenue", "totalTransactionRevenue", "productRevenue"]


# What the metrics read of a hit. The cast gives null wherever a part has another
# shape: no object, no list, an entry that is no object.
PRODUCTS = "array<struct<productPrice:string,localProductPrice:string,v2ProductCategory:string>>"
HIT_FIELDS = f"array<struct<product:{PRODUCTS},eCommerceAction:struct<action_type:string>>>"
# Where the revenue keys usually are. The type of the action tells the text 6 from the number.
SORTED_KEYS = sorted(REVENUE_KEYS)
_AMOUNTS = ",".join(f"{k}:string" for k in SORTED_KEYS)
REVENUE_PLACES = (
    f"array<struct<{_AMOUNTS},transaction:struct<{_AMOUNTS}>,product:array<struct<{_AMOUNTS}>>,"
    "eCommerceAction:struct<action_type:variant>>>"
)
PRICE_KEYS = ("productPrice", "localProductPrice")
# Fields of the totals object that give the revenue when the hits give none.
TOTAL_REVENUE_KEYS = ("transactionRevenue", "totalTransactionRevenue")
# Texts whose meaning depends on the type they were parsed from.
TYPED_TEXTS = ["0", "0.0", "-0.0", "false", "true", "[]", "{}"]


def hit_fields(cell: Column, at: str = "$") -> Column:
    """What the metrics read of the hits, which ``cell`` holds at the path ``at``."""
    return F.try_variant_get(cell, at, HIT_FIELDS)


def products_of(fields: Column) -> Column:
    """All entries of the ``product`` lists; null for an entry that is no object."""
    listed = F.flatten(F.array_compact(fields["product"]))
    return F.coalesce(listed, F.array().cast(PRODUCTS))


def _float_of(text: Column, v: Column) -> Column:
    """Float of a parsed value whose text is ``text``: null when blank, 0 when no number."""
    boolean = text.isin("true", "false") & (variant_type(v) == "BOOLEAN")
    return (
        F.when(boolean, (text == "true").cast("double"))
        .when(trim_ws(text) != "", float_or_zero(text))
    )


def _field(source: Column, name: str) -> Column:
    return F.try_variant_get(source, f"$.{name}", "variant")


def _first_truthy(source: Column, names: tuple[str, str], texts: tuple[Column, Column]) -> Column:
    """Float of the first field, whose text comes with it, or of the second when the first is missing, empty or 0."""
    first, second = ((text, _field(source, name)) for name, text in zip(names, texts, strict=True))
    return F.when(is_truthy(*first), _float_of(*first)).otherwise(_float_of(*second))


def prices_usd(cell: Column, products: Column, at: str = "$") -> Column:
    """Prices of the products; blank, negative and NaN prices are left out.

    Texts decide, except in sessions with a text such as ``0`` or ``true``:
    those look at the parsed types again.
    """
    texts = F.flatten(F.array(products["productPrice"], products["localProductPrice"]))
    depends = F.arrays_overlap(texts, F.array(*[F.lit(t) for t in TYPED_TEXTS]))
    by_text = F.transform(products, _price_of_texts)
    prices = F.when(F.coalesce(depends, F.lit(False)), _typed_prices(cell, at)).otherwise(by_text)
    return F.filter(prices, lambda x: (x >= 0) & ~F.isnan(x))


def _price_of_texts(product: Column) -> Column:
    first, second = product["productPrice"], product["localProductPrice"]
    text = F.when(first != "", first).otherwise(second)
    # Most texts are plain whole numbers, which are not blank.
    return F.coalesce(text.try_cast("bigint").cast("double"), F.when(trim_ws(text) != "", float_or_zero(text))) / MICROS


def _typed_prices(cell: Column, at: str) -> Column:
    lists = F.transform(
        F.try_variant_get(cell, at, "array<variant>"),
        lambda h: F.coalesce(F.try_variant_get(h, "$.product", "array<variant>"), empty_list()),
    )
    return F.transform(
        F.flatten(lists),
        lambda p: _first_truthy(p, PRICE_KEYS, tuple(variant_text(_field(p, c)) for c in PRICE_KEYS)) / MICROS,
    )


def mean_or_zero(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.size(values)).otherwise(F.lit(0.0))


def categories_of(products: Column) -> Column:
    """Distinct last-leaf categories in text order."""
    objects = F.array_compact(products)
    # Step by step, so that each segment is cut once.
    names = F.transform(F.transform(objects["v2ProductCategory"], last_segment), known_leaf)
    return F.sort_array(F.array_distinct(names))


def is_purchase(hit: Column) -> Column:
    return _is_purchase_action(F.try_variant_get(hit, "$.eCommerceAction.action_type", "variant"))


def _is_purchase_action(action: Column) -> Column:
    return F.coalesce((variant_text(action) == PURCHASE) & (variant_type(action) == "STRING"), F.lit(False))


def revenue_usd(
    cell: Column, fields: Column, keys: list[str] | None = None, at: str = "$", text: Column | None = None
) -> Column:
    """Sum of the revenue keys anywhere inside purchase hits.

    With ``text``, the literal of a cell in which each key stands as it is, null for another cell, the usual places
    of :data:`REVENUE_KEYS` are read first; if the text names them as often, there is no other place to search.
    """
    searched = _revenue_anywhere(cell, keys or REVENUE_KEYS, at)
    micros = searched if text is None or keys else _revenue_of_places(cell, at, text, searched)
    # Most sessions hold no purchase, and their hits are not looked at one by one.
    any_purchase = F.array_contains(fields["eCommerceAction"]["action_type"], PURCHASE)
    return F.when(F.coalesce(any_purchase, F.lit(False)), micros / MICROS).otherwise(F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _revenue_anywhere(cell: Column, keys: list[str], at: str) -> Column:
    """Micros of the keys at any depth.

    The text of a VARIANT is canonical JSON: quotes inside a text are escaped,
    so the pattern can only match a real key.
    """
    entry = rf'"(?:{"|".join(keys)})":("(?:[^"\\]|\\.)*+"|[^,}}\]\[{{"\s]+)'
    bought = F.filter(F.try_variant_get(cell, at, "array<variant>"), is_purchase)
    raw = F.flatten(
        F.transform(bought, lambda h: F.regexp_extract_all(variant_text(h), F.lit(entry), F.lit(1)))
    )

    def value(x: Column) -> Column:
        return F.when(x == "true", F.lit(1.0)).otherwise(float_or_zero(F.trim(x, F.lit('"'))))

    return _sum(F.transform(raw, value))


def _revenue_of_places(cell: Column, at: str, text: Column, searched: Column) -> Column:
    """Micros of the keys in a hit, its transaction and its products; ``searched`` if there may be others.

    A key that stands twice, a null, and a text ``true``, which may have been a boolean, make it ``searched`` too.
    """
    def named(key: str) -> Column:
        shorter = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(key), F.lit(key[1:])))
        return F.when(F.contains(text, F.lit(key)), shorter).when(text.isNotNull(), 0)

    def texts(hit: Column) -> Column:
        # In the order of the names, as in the canonical text.
        products = F.transform(F.coalesce(hit["product"], F.array()), lambda p: F.array(*[p[k] for k in SORTED_KEYS]))
        transaction = [hit["transaction"][k] for k in SORTED_KEYS]
        first, second, third = [hit[k] for k in SORTED_KEYS]
        found = F.flatten(F.array(F.flatten(products), F.array(first, second, *transaction, third)))
        return F.filter(found, lambda x: x.isNotNull())

    def read(hits: Column) -> Column:
        bought = F.filter(hits, lambda h: h["bought"])
        found = F.flatten(hits["texts"])
        usual = (F.size(found) == reduce(add, [named(k) for k in REVENUE_KEYS])) & ~F.array_contains(found, "true")
        amounts = F.transform(F.flatten(bought["texts"]), float_or_zero)
        return F.when(F.coalesce(usual, F.lit(False)), _sum(amounts)).otherwise(searched)

    def of_hit(hit: Column) -> Column:
        return F.struct(_is_purchase_action(hit["eCommerceAction"]["action_type"]).alias("bought"), texts(hit).alias("texts"))

    return let(F.transform(F.try_variant_get(cell, at, REVENUE_PLACES), of_hit), read)


def total_revenue_texts(totals: Column) -> list[Column]:
    """Texts of the revenue fields of the totals object."""
    return [F.try_variant_get(totals, f"$.{name}", "string") for name in TOTAL_REVENUE_KEYS]


def total_revenue(totals: Column, texts: tuple[Column, Column]) -> Column:
    """Revenue of the totals object in micros, given the texts of its fields."""
    return F.coalesce(_first_truthy(totals, TOTAL_REVENUE_KEYS, texts), F.lit(0.0))


def revenue_with_fallback(from_hits: Column, fallback: Column) -> Column:
    """Revenue of the hits, or ``fallback``, that of the totals object, when the hits give 0."""
    usable = (from_hits == 0) & (fallback > 0) & ~F.isnan(fallback)
    return F.when(usable, fallback / MICROS).otherwise(from_hits)
