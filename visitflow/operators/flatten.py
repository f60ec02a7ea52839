"""Raw sessions to one wide, flat row per session.

The columns of the JSON cells are discovered once over the whole table and
then kept as parameters, so flattening itself is one row-local projection.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from visitflow.functions.hits import (
    categories_of,
    hit_fields,
    mean_or_zero,
    prices_usd,
    products_of,
    revenue_usd,
    revenue_with_fallback,
    total_revenue,
    total_revenue_texts,
)
from visitflow.functions.literals import (
    LISTED,
    allow_equal_keys,
    dimension_values,
    list_or_empty,
    parse_json_object,
    print_depends,
    text_of_type,
    variant_type,
)
from visitflow.operators.literals import listed_literals, lost_reasons, observe_reasons
from visitflow.session import materialize, temporary_tables

# Columns taken over as they are, and columns that hold JSON objects.
PASS_THROUGH = [
    "channelGrouping",
    "date",
    "fullVisitorId",
    "visitId",
    "visitNumber",
    "visitStartTime",
    "socialEngagementType",
]
JSON_COLUMNS = ["device", "geoNetwork", "totals", "trafficSource"]


# An object with more different keys than this over the whole table is a map, not a set of columns; so is one with more than
# the second number, of which most are in one row only.
MOST_KEYS = 1000
MOST_CATEGORIES = 1000  # columns that the categories of a session are spread over
MAP_KEYS, SEEN_ONCE = 100, 0.5


@dataclass(frozen=True)
class Leaf:
    """One flattened column: the path of a value inside a JSON cell; ``whole`` for a map, which stays JSON text."""

    source: str
    path: tuple[str, ...]
    whole: bool = False

    @property
    def column(self) -> str:
        return "_".join((self.source, *self.path))

    def to_dict(self) -> dict:
        return {**asdict(self), "path": list(self.path)}

    @staticmethod
    def from_dict(values: dict) -> Leaf:
        return Leaf(values["source"], tuple(values["path"]), values.get("whole", False))


def _json_path(path: tuple[str, ...]) -> str:
    parts = []
    for name in path:
        if '"' in name and "'" in name:
            raise ValueError(f"key {name!r} cannot be written as a path")
        parts.append(f"['{name}']" if '"' in name else f'["{name}"]')
    return "$" + "".join(parts)


def _entries(objects: DataFrame) -> DataFrame:
    """``(source, path, value, kind)`` of each entry of ``(source, path, value)`` objects; the path ends with the key."""
    found = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("value").outer()).alias("entry"))
    entries = found.where("entry.key is not null").select(
        "source", F.array_append("path", F.col("entry.key")).alias("path"), F.col("entry.value").alias("value")
    )
    return entries.withColumn("kind", F.regexp_extract(variant_type(F.col("value")), "^[A-Z]+", 0))


def key_counts(objects: DataFrame) -> DataFrame:
    """``(source, path, kind, rows)``: in how many objects each key has a value of each kind; summed in each task first."""
    return _entries(objects).groupBy("source", "path", "kind").agg(F.count(F.lit(1)).alias("rows"))


def objects_in(objects: DataFrame) -> DataFrame:
    """The objects that are values of ``(source, path, value)`` objects, one level further down."""
    return _entries(objects).where("kind = 'OBJECT'").select("source", "path", "value")


def cell_objects(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(source, path, value)`` of the JSON objects in ``columns``, with an empty path."""
    allow_equal_keys(df.sparkSession)
    parsed = df.select(*[parse_json_object(F.col(c)).alias(c) for c in columns])
    each = [F.struct(F.lit(c).alias("source"), F.col(c).alias("value")) for c in columns]
    rows = parsed.select(F.explode(F.array(*each)).alias("o")).where("o.value is not null")
    return rows.select("o.source", F.array().cast("array<string>").alias("path"), "o.value")


def _parents(counts: DataFrame) -> DataFrame:
    """``(source, parent, keys, once)``: number of different keys of the objects at a path, and of those in one object only."""
    keys = counts.groupBy("source", "path").agg(F.sum("rows").alias("rows"))
    parent = F.slice("path", 1, F.size("path") - 1)
    return keys.groupBy("source", parent.alias("parent")).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("rows") == 1).alias("once")
    )


def is_map(keys: int, once: int, most_keys: int = MOST_KEYS) -> bool:
    """Whether objects with so many different keys, so many of them in one object only, are maps."""
    return keys > most_keys or (keys > min(MAP_KEYS, most_keys) and once > SEEN_ONCE * keys)


def discover_leaves(
    df: DataFrame, columns: list[str] | None = None, most_keys: int = MOST_KEYS
) -> list[Leaf]:
    """All keys seen in the JSON cells of the whole table, in column order.

    Keys are rows, counted in Spark one level of nesting at a time. A map, whose keys are data rather than
    columns, is told by its counts (:func:`is_map`) and becomes one column of JSON text, so the driver holds
    at most ``most_keys`` names for each object that is none. A key that is an object in some
    rows and a scalar in others gives both its own column and the columns of the object.
    """
    sources = [c for c in (columns or JSON_COLUMNS) if c in df.columns]
    if not sources:
        return []
    leaves: set[Leaf] = set()
    objects = cell_objects(df, sources)
    while True:
        with temporary_tables(df.sparkSession):
            counts = materialize(key_counts(objects), "key-counts")
            parents = _parents(counts).collect()
            maps = [(r["source"], r["parent"]) for r in parents if is_map(r["keys"], r["once"], most_keys)]
            schema = "source string, parent array<string>"
            named = F.broadcast(df.sparkSession.createDataFrame(maps, schema))
            parent = F.slice("path", 1, F.size("path") - 1)
            kept = counts.withColumn("parent", parent).join(named, ["source", "parent"], "left_anti")
            kinds: dict[tuple, set[str]] = {}
            for r in kept.select("source", "path", "kind").collect():
                kinds.setdefault((r["source"], tuple(r["path"])), set()).add(r["kind"])
        leaves |= {Leaf(source, tuple(path), whole=True) for source, path in maps}
        # Null says nothing beside an object.
        leaves |= {Leaf(*at) for at, found in kinds.items() if found - {"OBJECT", "VOID"} or found == {"VOID"}}
        if not any("OBJECT" in found for found in kinds.values()):
            break
        nested = objects_in(objects).withColumn("parent", parent)
        objects = nested.join(named, ["source", "parent"], "left_anti").drop("parent")
    return _checked(sorted(leaves, key=lambda leaf: (leaf.column, leaf.whole)))


def _checked(leaves: list[Leaf]) -> list[Leaf]:
    """One leaf for each column; two paths that give one column name are an error.

    A path that holds maps in some rows and scalars in others is one column, which shows both.
    """
    seen: dict[str, Leaf] = {}
    for leaf in leaves:
        other = seen.get(leaf.column.lower())
        if other and (other.source, other.path) != (leaf.source, leaf.path):
            raise ValueError(f"{other} and {leaf} give the same column name")
        seen[leaf.column.lower()] = leaf  # the whole one comes last
    return list(seen.values())


def leaf_text(at: Column, text: Column, kind: Column, whole: bool = False) -> Column:
    """Text of one leaf, given its value, its text and, where the print depends on it, its type.

    Absent, null, empty list and object give the empty text. With ``whole`` an object gives its JSON text, an empty one
    the empty text. The type is looked up in each row: later data may hold another one here.
    """
    empty_list = (kind == "ARRAY<VOID>") & (text == "[]")
    none = (kind == "OBJECT<>") if whole else kind.startswith("OBJECT")
    empty = text.isNull() | none | empty_list
    as_is = kind.isNull() | (kind == "STRING") | kind.startswith("OBJECT")
    return F.when(empty, F.lit("")).when(as_is, text).otherwise(text_of_type(at, kind, text))


def _with_leaf_texts(parsed: DataFrame, kept: list[Column | str], leaves: list[Leaf]) -> DataFrame:
    """``kept`` and the text of each leaf of the parsed cells ``_<source>``.

    Texts are projected first, then the types of those whose print depends on it.
    """
    cells = sorted({f"_{leaf.source}" for leaf in leaves})

    def at(leaf: Leaf, kind: str) -> Column:
        return F.try_variant_get(F.col(f"_{leaf.source}"), _json_path(leaf.path), kind)

    found = parsed.select(*kept, *cells, *[at(leaf, "string").alias(f"_text{i}") for i, leaf in enumerate(leaves)])
    kinds = {
        f"_kind{i}": F.when(print_depends(F.col(f"_text{i}")), variant_type(at(leaf, "variant"))) for i, leaf in enumerate(leaves)
    }
    texts = [
        leaf_text(at(leaf, "variant"), F.col(f"_text{i}"), F.col(f"_kind{i}"), leaf.whole).alias(leaf.column)
        for i, leaf in enumerate(leaves)
    ]
    return found.withColumns(kinds).select(*kept, *texts)


def flatten_json(df: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """Replace the JSON cells by one text column per leaf."""
    allow_equal_keys(df.sparkSession)
    sources = sorted({leaf.source for leaf in leaves})
    kept = [F.col(f"`{c}`") for c in df.columns if c not in sources]
    parsed = df.select(*kept, *[parse_json_object(F.col(c)).alias(f"_{c}") for c in sources])
    return _with_leaf_texts(parsed, kept, leaves)


def add_hit_metrics(
    df: DataFrame, totals: Column | None = None, revenue_keys: list[str] | None = None
) -> DataFrame:
    """Product, price, category and revenue metrics of the ``hits`` cell.

    ``totals`` is the parsed totals object for the revenue fallback.
    """
    return _hit_metrics(listed_literals(df, {"hits": "_cell"}), totals, revenue_keys)


def _hit_metrics(
    parsed: DataFrame, totals: Column | None = None, revenue_keys: list[str] | None = None
) -> DataFrame:
    """Metrics of the ``hits`` cell, listed in ``_cell``, which goes."""
    cell, text = F.col("_cell"), F.when(F.col("_cell_read"), F.col("hits"))
    fields = parsed.withColumn("_fields", hit_fields(cell, LISTED))
    listed = fields.withColumn("_products", products_of(F.col("_fields")))
    parts = listed.withColumns(
        {
            "_prices": prices_usd(cell, F.col("_products"), LISTED),
            "categories_viewed": categories_of(F.col("_products")),
            "_revenue": revenue_usd(cell, F.col("_fields"), revenue_keys, LISTED, text),
        }
    )
    revenue = F.col("_revenue")
    if totals is not None:
        texts = ("_total0", "_total1")
        parts = parts.withColumns(dict(zip(texts, total_revenue_texts(totals), strict=True)))
        parts = parts.withColumn("_fallback", F.when(revenue == 0, total_revenue(totals, tuple(F.col(c) for c in texts)))).drop(*texts)
        revenue = revenue_with_fallback(revenue, F.col("_fallback"))
    return parts.withColumns(
        {
            "total_product_viewed": F.size("_products").cast("bigint"),
            "average_price_product_viewed": mean_or_zero(F.col("_prices")),
            "total_category_viewed": F.size("categories_viewed").cast("bigint"),
            "total_revenue": revenue,
        }
    ).drop("_cell", "_cell_read", "_fields", "_products", "_prices", "_revenue", "_fallback")


def category_width(df: DataFrame, most: int = MOST_CATEGORIES) -> int:
    """Largest number of categories in one session, at most ``most``: one odd session must not make a table of any width.

    ``categories_past`` counts what lies beyond.
    """
    return min(df.agg(F.max("total_category_viewed")).first()[0] or 0, most)


def categories_past(df: DataFrame, width: int) -> DataFrame:
    """``(sessions, categories)`` that a spread over ``width`` columns leaves out."""
    past = F.greatest(F.col("total_category_viewed") - width, F.lit(0))
    return df.agg(
        F.count_if(past > 0).alias("sessions"), F.coalesce(F.sum(past), F.lit(0)).alias("categories")
    )


def spread_categories(df: DataFrame, width: int, keep_array: bool = False) -> DataFrame:
    """``categories_viewed_0..width-1``, empty text past the end of the list."""
    names = F.col("categories_viewed")
    spread = df.withColumns(
        {
            f"categories_viewed_{i}": F.coalesce(F.get(names, F.lit(i)), F.lit(""))
            for i in range(width)
        }
    )
    return spread if keep_array else spread.drop("categories_viewed")


def flatten_sessions(
    df: DataFrame, leaves: list[Leaf], width: int | None = None, observation: Observation | None = None
) -> DataFrame:
    """One flat row per session; ``width`` None keeps the categories as an array.

    With an ``observation`` the action that reads the result also counts its rows and its lost cells by column and
    reason (``observed_counts``) and, with a width, the ``sessions_past`` and ``categories_past`` it; nothing is
    parsed again for that.
    """
    sources = sorted({*(leaf.source for leaf in leaves), "totals"})
    kept = [c for c in PASS_THROUGH if c in df.columns]
    literals = {"hits": "_cell", "customDimensions": "_dimensions"}
    objects = {c: f"_{c}" for c in sources}
    parsed = df.select(
        *kept, *literals, *(sources if observation else []), *[parse_json_object(F.col(c)).alias(v) for c, v in objects.items()]
    )
    parsed = listed_literals(parsed, literals)
    if observation:
        parsed = parsed.withColumns({f"_why_{c}": why for c, why in lost_reasons(objects, literals).items()})
    metrics = _hit_metrics(parsed, totals=F.col("_totals")).withColumn(
        "customDimensions", dimension_values(list_or_empty(F.col("_dimensions"), LISTED))
    )
    if observation:
        past = F.greatest(F.col("total_category_viewed") - F.lit(width), F.lit(0)) if width is not None else F.lit(0)
        more = {"sessions_past": F.count_if(past > 0), "categories_past": F.sum(past)}
        metrics = observe_reasons(metrics, observation, {c: f"_why_{c}" for c in (*objects, *literals)}, **more)
    measured = ["customDimensions", "total_product_viewed", "average_price_product_viewed",
                "total_category_viewed", "categories_viewed", "total_revenue"]
    flat = _with_leaf_texts(metrics, [*kept, *measured], leaves)
    if width is not None:
        flat = spread_categories(flat, width)
    return flat.select(*[F.col(f"`{c}`") for c in sorted(flat.columns)])
