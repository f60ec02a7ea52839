"""Categories to indices and one-hot columns, with a fitted vocabulary."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions.text import trim_ws
from visitflow.operators.clean import ID_COLUMNS, LABEL

LITERAL_ENTRIES = 256  # larger vocabularies are joined, not written into the plan
BROADCAST_BYTES = 64 << 20  # of texts and indices, before they are sent to every executor
HOT_SALTS = 4096  # rows of frequent texts are dealt over so many keys
SKETCH_ENTRIES, MOST_SKETCH_ENTRIES = 64, 1_000_000  # for each shuffle partition; at most, as Spark's sketch demands


def _lookup_text(c: Column) -> Column:
    """Text looked up in the vocabulary; missing values and their prints are empty."""
    text = c.cast("string")
    return F.when(text.isNull() | text.isin("nan", "None"), F.lit("")).otherwise(text)


def category_index(c: Column, value_to_index: dict[str, int], others_index: int) -> Column:
    """Index of the text, else of the stripped text, else ``others_index``."""
    # A constant: the optimizer turns it into a map literal.
    table = F.from_json(F.lit(json.dumps(value_to_index)), "map<string,bigint>")
    text = _lookup_text(c)
    return F.coalesce(
        F.try_element_at(table, text),
        F.try_element_at(table, trim_ws(text)),
        F.lit(others_index).cast("bigint"),
    )


def encode_categories(df: DataFrame, dictionary: dict) -> DataFrame:
    """Replace every categorical column by its index."""
    encoded, large = {}, []
    for name, spec in (dictionary.get("columns") or {}).items():
        if name not in df.columns or not spec.get("value_to_index"):
            continue
        others = spec.get("others_index", 1)
        if len(spec["value_to_index"]) <= LITERAL_ENTRIES:
            encoded[name] = category_index(F.col(f"`{name}`"), spec["value_to_index"], others)
        else:
            large.append((name, spec["value_to_index"], others))
    result = df.withColumns(encoded) if encoded else df
    for name, entries, others in large:
        result = _encode_by_join(result, name, entries, others)
    return result


def _encode_by_join(df: DataFrame, name: str, entries: dict[str, int], others: int) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(entries.items()), "_value string, _index bigint")
    size = sum(len(text.encode()) + 8 for text in entries)
    if size <= BROADCAST_BYTES:
        return join_index(df, name, table, others, broadcast=True)
    return join_index(df, name, table, others, hot=hot_index(df, name, table, others))


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the texts and indices of a lookup table are few enough bytes to broadcast."""
    size = table.agg(F.sum(F.octet_length("_value") + 8)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def frequent_texts(df: DataFrame, name: str) -> list[str]:
    """The texts of a column that may hold more than a share of 1 / (4 * shuffle partitions) of the rows.

    One pass with a sketch of bounded size, which misses none of them; at most 8 for each partition.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(SKETCH_ENTRIES * partitions, MOST_SKETCH_ENTRIES)
    texts = df.select(_lookup_text(F.col(f"`{name}`")).alias("text"))
    found = texts.agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(text, {min(8 * partitions, tracked)}, {tracked})").alias("top")
    ).first()
    return [entry["item"] for entry in found["top"] or [] if entry["count"] * 4 * partitions >= found["rows"]]


def hot_index(df: DataFrame, name: str, table: DataFrame, others: int) -> dict[str, int]:
    """Index of each frequent text of a column, looked up in ``table`` (``_value``, ``_index``)."""
    texts = frequent_texts(df, name)
    if not texts:
        return {}
    frequent = df.sparkSession.createDataFrame([(t,) for t in texts], "text string").withColumn("stripped", trim_ws(F.col("text")))
    asked = frequent.select(F.explode(F.array("text", "stripped")).alias("_value")).distinct()
    found = {r["_value"]: r["_index"] for r in table.join(F.broadcast(asked), "_value").collect()}
    return {r["text"]: found.get(r["text"], found.get(r["stripped"], others)) for r in frequent.collect()}


def join_index(
    df: DataFrame,
    name: str,
    table: DataFrame,
    others: int,
    broadcast: bool = False,
    hot: dict[str, int] | None = None,
) -> DataFrame:
    """Dimension lookup by value: ``table`` has ``_value``, each once, and ``_index``.

    One join by the stripped text, which finds the entry of the text itself and that of the stripped one. Set
    ``broadcast`` only for a table of checked size. For a shuffled join pass as ``hot`` the index of frequent texts, as
    :func:`hot_index` gives it: their rows take it from a literal, and are dealt evenly instead of by text.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("_value", "_index")))
    keyed = table.groupBy(trim_ws(F.col("_value")).alias("_lookup_key")).agg(entries.alias("_lookup_entries"))
    text = _lookup_text(F.col(f"`{name}`"))
    key, known = trim_ws(text), F.lit(None).cast("bigint")
    if hot:
        known = F.try_element_at(F.from_json(F.lit(json.dumps(hot)), "map<string,bigint>"), text)
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS)).cast("string")
        key = F.when(known.isNull(), key).otherwise(F.concat(F.lit("\x00"), salt))  # what it finds, if anything, does not count
    asked = df.withColumns({"_lookup_key": key, "_lookup_known": known})
    joined = asked.join(F.broadcast(keyed) if broadcast else keyed, "_lookup_key", "left")
    held = F.col("_lookup_entries")
    index = F.coalesce(
        F.col("_lookup_known"), F.try_element_at(held, text), F.try_element_at(held, F.col("_lookup_key")), F.lit(others)
    )
    return joined.withColumn(name, index.cast("bigint")).select(*[F.col(f"`{c}`") for c in df.columns])


def category_label(index: Column, index_to_value: dict[str, str]) -> Column:
    """Label or category of an index, for reports."""
    table = F.from_json(F.lit(json.dumps(index_to_value)), "map<string,string>")
    return F.try_element_at(table, index.cast("string"))


def clamp_index(index: Column, vocab_size: int) -> Column:
    """Missing -> 0, then limited to the vocabulary."""
    last = max(0, vocab_size - 1)
    return F.greatest(F.lit(0), F.least(F.lit(last), F.coalesce(index.cast("bigint"), F.lit(0))))


def one_hot(df: DataFrame, sizes: dict[str, int], numeric: list[str] | None = None) -> DataFrame:
    """Identifiers, label, numeric columns and one byte column per category index.

    An absent categorical column gives zeros only; a missing index counts as 0.
    """
    names = df.columns
    if numeric is None:
        numeric = [c for c in names if c not in {*ID_COLUMNS, LABEL, *sizes}]
    kept = [c for c in [*ID_COLUMNS, LABEL] if c in names]
    kept += [c for c in numeric if c in names and c != LABEL]
    present = {c: v for c, v in sizes.items() if c in names}
    clamped = df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[clamp_index(F.col(f"`{c}`"), v).alias(f"_{c}") for c, v in present.items()],
    )
    blocks = []
    for c, v in sizes.items():
        for i in range(v):
            hot = (F.col(f"`_{c}`") == i) if c in present else F.lit(False)
            blocks.append(hot.cast("tinyint").alias(f"{c}_{i}"))
    return clamped.select(*[F.col(f"`{c}`") for c in kept], *blocks)
