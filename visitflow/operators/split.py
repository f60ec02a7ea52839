"""Exact splits by rank: time split, first N rows, sample of N rows.

No global sort and no global row number: the key at the cut rank is found with
bounded aggregates, and both sides are plain filters against it. Rows that tie
with that key are ranked by a hash of the row; whole copies of one row are
interchangeable, so they are counted and dealt out by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.operators.order_stats import SORTED_ROWS, values_at_ranks

CHUNK_BYTES = 6  # 48 bits: every chunk is exact as a double
COPIES_PER_TASK = 100_000
LOW_BITS = 26  # a bigint is compared by its high and its low bits
LAST_TEXT = "\U0010ffff"  # sorts after every other text; stands for null


@dataclass(frozen=True)
class _Key:
    """One sort key; nulls come last."""

    raw: Column
    ordered: Column  # nulls replaced by ``last``
    last: object

    def compared(self, bound: object) -> Column:
        """The column to compare with a bound: as it is, where filters can reach the scan."""
        return self.ordered if bound == self.last else self.raw


@dataclass
class _Cut:
    """Rows before the cut: those less than the bounds and ``ties_before`` of their equals."""

    bounds: list[tuple[_Key, object]]
    ties: int
    ties_before: int

    def before(self) -> Column:
        condition, prefix = F.lit(False), F.lit(True)
        for key, bound in self.bounds:
            c = key.compared(bound)
            condition = condition | (prefix & (c < F.lit(bound)))
            prefix = prefix & (c == F.lit(bound))
        return F.coalesce(condition, F.lit(False)) if self.has_nulls() else condition

    def tied(self) -> Column:
        condition = F.lit(True)
        for key, bound in self.bounds:
            condition = condition & (key.compared(bound) == F.lit(bound))
        return condition

    def after(self) -> Column:
        return ~F.coalesce(self.before() | self.tied(), F.lit(False))

    def has_nulls(self) -> bool:
        return any(bound == key.last for key, bound in self.bounds)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """53-bit hash of the whole row, exact as a double."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), 11)


def split_rows(
    df: DataFrame,
    keys: list[Column],
    cut: int,
    total: int,
    seed: int = 0,
    sorted_rows: int = SORTED_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """First ``cut`` rows in the order of ``keys``, and the other rows.

    ``df`` should be a table or a deterministic query: its keys are scanned a
    few times for the cut, then the rows once per side.
    """
    if cut <= 0:
        return df.limit(0), df
    if cut >= total:
        return df, df.limit(0)
    found = _find_cut(df, [p for k in keys for p in _keys_of(df, k)], cut, total, sorted_rows)
    if 0 < found.ties_before < found.ties:
        hashed = row_hash(df, seed)
        inner = _find_cut(
            df.filter(found.tied()), [_Key(hashed, hashed, None)], found.ties_before, found.ties, sorted_rows
        )
        found = _Cut(found.bounds + inner.bounds, inner.ties, inner.ties_before)
    first, tied, rest = (df.filter(c) for c in (found.before(), found.tied(), found.after()))
    if found.ties_before == found.ties:
        return first.unionByName(tied), rest
    if found.ties_before == 0:
        return first, df.filter(~F.coalesce(found.before(), F.lit(False)))
    head, tail = _deal_copies(tied, found.ties_before)
    return first.unionByName(head), tail.unionByName(rest)


def _keys_of(df: DataFrame, key: Column) -> list[_Key]:
    """Sort keys of one column, each exact as a text or as a double."""
    dtype = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(dtype, T.StringType):
        return [_Key(key, F.coalesce(key, F.lit(LAST_TEXT)), LAST_TEXT)]
    if isinstance(dtype, T.LongType):
        parts = [F.shiftright(key, LOW_BITS), key.bitwiseAND(F.lit((1 << LOW_BITS) - 1))]
    elif isinstance(dtype, (T.IntegralType, T.FloatType, T.DoubleType)):
        parts = [key]
    else:
        raise ValueError(f"rows cannot be split by a key of type {dtype.simpleString()}")
    numbers = [p.cast("double") for p in parts]
    return [_Key(n, F.coalesce(n, F.lit(float("inf"))), float("inf")) for n in numbers]


def _find_cut(df: DataFrame, keys: list[_Key], cut: int, total: int, sorted_rows: int) -> _Cut:
    """Bounds of the row at rank ``cut``, found on the key columns alone."""
    if not keys:
        return _Cut([], total, cut)
    table = df.select(*[k.ordered.alias(f"k{i}") for i, k in enumerate(keys)])
    rank, left = cut, total  # rank of the first row after the cut among the rows left
    bounds: list[object] = []
    rows = table
    for i in range(len(keys)):
        if left <= sorted_rows:
            rest = [f"k{j}" for j in range(i, len(keys))]
            bounds.extend(rows.select(*rest).orderBy(*rest).offset(rank).limit(1).first())
            break
        name = f"k{i}"
        if isinstance(table.schema[name].dataType, T.StringType):
            bound = _text_at_rank(rows, name, rank, left, sorted_rows)
        else:
            bound = values_at_ranks(
                rows, {name: F.col(name)}, {name: [rank]}, {name: left}, sorted_rows
            )[name, rank]
        bounds.append(bound)
        counted = rows.agg(
            F.count_if(F.col(name) < F.lit(bound)).alias("below"),
            F.count_if(F.col(name) == F.lit(bound)).alias("equal"),
        ).first()
        rank, left = rank - counted["below"], counted["equal"]
        rows = rows.filter(F.col(name) == F.lit(bound))
    names = [_Key(F.col(f"k{i}"), F.col(f"k{i}"), k.last) for i, k in enumerate(keys)]
    found = _Cut(list(zip(names, bounds, strict=True)), 0, 0)
    counted = table.agg(
        F.count_if(found.before()).alias("before"), F.count_if(found.tied()).alias("ties")
    ).first()
    return _Cut(
        list(zip(keys, bounds, strict=True)), counted["ties"], cut - counted["before"]
    )


def _text_at_rank(rows: DataFrame, name: str, rank: int, total: int, sorted_rows: int) -> str:
    """Text at a rank, byte chunk by byte chunk; text order is byte order."""
    data = F.encode(F.col(name), "UTF-8")
    longest = rows.agg(F.max(F.octet_length(F.col(name)))).first()[0]
    levels: list[Column] = []
    for start in range(1, longest + 1, CHUNK_BYTES):
        chunk = F.rpad(F.substring(data, start, CHUNK_BYTES), CHUNK_BYTES, F.lit(b"\x00"))
        levels.append(F.conv(F.hex(chunk), 16, 10).cast("bigint"))
    levels.append(F.octet_length(F.col(name)).cast("bigint"))  # padded texts of other length
    for level in levels:
        if total <= sorted_rows:
            return rows.select(name).orderBy(name).offset(rank).limit(1).first()[0]
        bound = values_at_ranks(rows, {"c": level}, {"c": [rank]}, {"c": total}, sorted_rows)["c", rank]
        counted = rows.agg(
            F.count_if(level < F.lit(bound)).alias("below"),
            F.count_if(level == F.lit(bound)).alias("equal"),
        ).first()
        rank, total = rank - counted["below"], counted["equal"]
        rows = rows.filter(level == F.lit(bound))
    return rows.select(F.min(name)).first()[0]


def _deal_copies(tied: DataFrame, n_first: int) -> tuple[DataFrame, DataFrame]:
    """Deal out rows with equal keys and hash: copies are counted, then repeated."""
    copies = tied.groupBy(*[f"`{c}`" for c in tied.columns]).agg(F.count(F.lit(1)).alias("_n"))
    # Distinct rows sharing a 53-bit hash: hardly ever more than one.
    order = Window.orderBy(*[F.col(f"`{c}`") for c in tied.columns])
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = copies.withColumn("_before", upto - F.col("_n"))
    first = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(n_first) - F.col("_before")))
    head = _repeat_rows(dealt.withColumn("_copies", first), tied.columns)
    tail = _repeat_rows(dealt.withColumn("_copies", F.col("_n") - first), tied.columns)
    return head, tail


def _repeat_rows(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Emit ``_copies`` rows each, in batches that tasks can share."""
    batches = F.ceil(F.col("_copies") / COPIES_PER_TASK)
    spread = (
        dealt.filter(F.col("_copies") > 0)
        .withColumn("_batch", F.explode(F.sequence(F.lit(1).cast("bigint"), batches)))
        .repartition("_batch")
    )
    in_batch = F.least(
        F.lit(COPIES_PER_TASK), F.col("_copies") - (F.col("_batch") - 1) * COPIES_PER_TASK
    )
    repeated = spread.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), in_batch)))
    return repeated.select(*[F.col(f"`{c}`") for c in columns])


def time_split(
    df: DataFrame,
    train_frac: float = 0.9,
    key: str = "visitId",
    then_by: str = "fullVisitorId",
    sorted_rows: int = SORTED_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """First ``int(n * train_frac)`` rows in key order for training, the rest for validation."""
    total = df.count()
    return split_rows(
        df, _keys(df, key, then_by), int(total * train_frac), total, sorted_rows=sorted_rows
    )


def first_rows(
    df: DataFrame,
    n: int,
    key: str = "visitId",
    then_by: str = "fullVisitorId",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """First ``n`` rows in key order."""
    return split_rows(df, _keys(df, key, then_by), n, df.count(), sorted_rows=sorted_rows)[0]


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, sorted_rows: int = SORTED_ROWS, keys: list[str] | None = None
) -> DataFrame:
    """Exactly ``n`` rows picked by a seeded hash; the whole table when it has no more.

    With ``keys`` the rows go by the first 60 bits of the MD5 of the seed and the
    keys' texts, joined by slashes (null: empty), which other engines can compute too.
    """
    order = []
    if keys is not None:
        texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys]
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *texts).cast("binary"))
        order = [F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")]
    return split_rows(df, order, n, df.count(), seed, sorted_rows)[0]


def _keys(df: DataFrame, key: str, then_by: str) -> list[Column]:
    return [F.col(c) for c in (key, then_by) if c in df.columns]
