"""Queries for parsing, flattening and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.functions.literals import (
    custom_dimension_value,
    dimension_values,
    list_or_empty,
    parse_json_object,
)
from visitflow.functions.numbers import float_or_zero, text_to_double, text_to_long
from visitflow.functions.sentinels import is_none, is_other, is_reserved, is_unknown
from visitflow.functions.text import last_leaf
from visitflow.operators.clean import cast_ids, cast_totals, drop_columns
from visitflow.operators.flatten import (
    Leaf,
    add_hit_metrics,
    category_width,
    cell_objects,
    discover_leaves,
    flatten_json,
    flatten_sessions,
    key_counts,
    objects_in,
    spread_categories,
)
from visitflow.operators.literals import parse_literals, unparsed_cells
from visitflow.operators.profile import single_valued_columns
from visitflow.session import materialize
from visitflow.sources.tables import spread_rows
from workload.registry import query
from workload.sessions import event_sessions, line_sessions, order_sessions, table

LINES = """
    select l_orderkey, l_partkey, l_linenumber, p_type, p_name, l_returnflag,
           1 + l_linenumber % 3 as n, round(l_extendedprice * 100) / 100 as usd
    from lineitem join part on l_partkey = p_partkey
"""


@query(f"""
    select l_orderkey, l_partkey, l_linenumber,
           cast(n as bigint) as total_product_viewed,
           round(usd * (n + 1) / 2, 4) as average_price_product_viewed,
           cast(len(list_distinct(case n when 1 then [p_name] when 2 then [p_name, p_type]
                else [p_name, p_type, 'unknown'] end)) as bigint) as total_category_viewed,
           round(case when l_returnflag = 'R' then usd * n else 0 end, 4) as total_revenue
    from ({LINES})
""")
def hit_metrics_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product, price, category and revenue metrics of literal hits cells."""
    return add_hit_metrics(line_sessions(spark, sf_dir)).select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "total_product_viewed",
        F.round("average_price_product_viewed", 4).alias("average_price_product_viewed"),
        "total_category_viewed",
        F.round("total_revenue", 4).alias("total_revenue"),
    )


@query(f"""
    select l_orderkey, l_partkey, l_linenumber,
           coalesce(c[1], '') as categories_viewed_0,
           coalesce(c[2], '') as categories_viewed_1,
           coalesce(c[3], '') as categories_viewed_2
    from (select *, list_sort(list_distinct(case n when 1 then [p_name] when 2 then [p_name, p_type]
                 else [p_name, p_type, 'unknown'] end)) as c
          from ({LINES}))
""")
def categories_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted categories spread over positional columns."""
    # Written once: the width and the spread read it, the cells are parsed once.
    metrics = materialize(
        add_hit_metrics(line_sessions(spark, sf_dir)).select(
            "l_orderkey", "l_partkey", "l_linenumber", "categories_viewed", "total_category_viewed"
        ),
        "categories",
    )
    width = category_width(metrics)
    return spread_categories(metrics, width).select(
        "l_orderkey", "l_partkey", "l_linenumber", *[f"categories_viewed_{i}" for i in range(width)]
    )


@query("""
    select o_orderkey,
           round(case when o_orderpriority like '1%' then cents
                      when o_orderstatus = 'O' then cents * 2
                      when o_orderstatus = 'F' then cents * 3
                      else 0 end / 100, 4) as total_revenue
    from (select *, round(o_totalprice * 100) as cents from orders)
""")
def revenue_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of purchase hits, else of the totals object."""
    sessions = order_sessions(spark, sf_dir).withColumn("_totals", parse_json_object(F.col("totals")))
    return add_hit_metrics(sessions, totals=F.col("_totals")).select(
        "o_orderkey", F.round("total_revenue", 4).alias("total_revenue")
    )


@query(f"""
    select l_orderkey, l_partkey, l_linenumber, cast(i as string) as hit_number,
           cast(null as string) as referer, false as is_entrance,
           case when l_returnflag = 'R' then '6' else '2' end as action_type
    from (select *, unnest(generate_series(1, n)) as i from ({LINES}))
""")
def literal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python literal cells parsed to VARIANT and read field by field."""
    cells = parse_literals(line_sessions(spark, sf_dir), {"hits": "_cell"})
    # One cast reads the fields of all hits of a cell; a part of another shape is null.
    fields = "array<struct<hitNumber:string,referer:string,isEntrance:boolean,eCommerceAction:struct<action_type:string>>>"
    hits = cells.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.explode(F.try_variant_get(F.col("_cell"), "$", fields)).alias("h")
    )
    return hits.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("h.hitNumber").alias("hit_number"),
        F.col("h.referer").alias("referer"),
        F.col("h.isEntrance").alias("is_entrance"),
        F.col("h.eCommerceAction.action_type").alias("action_type"),
    )


@query("""
    select event_id,
           json_extract_string(props, '$.k') as props_k,
           case event_type when 'error' then '' when 'click' then 'True' else 'False' end as detail_ok,
           case event_type when 'error' then '' else event_type end as detail_sub_type,
           case event_type when 'error' then '' when 'view' then '1.0' else '2' end as detail_score,
           case event_type when 'purchase' then '[''a'', 1, None]' else '' end as detail_tags
    from events
""")
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON cells flattened to columns that are discovered in the data."""
    kind = F.col("event_type")
    detail = F.when(kind == "error", "not json").otherwise(
        F.concat(
            F.lit('{"ok":'),
            F.when(kind == "click", "true").otherwise("false"),
            F.lit(',"empty":{},"sub":{"type":"'),
            kind,
            F.lit('"},"score":'),
            F.when(kind == "view", "1.0").otherwise("2"),
            F.lit(',"tags":'),
            F.when(kind == "purchase", '["a",1,null]').otherwise("[]"),
            F.lit("}"),
        )
    )
    events = spread_rows(table(spark, sf_dir, "events").select("event_id", "props", "event_type"))
    cells = events.select("event_id", "props", detail.alias("detail"))
    return flatten_json(cells, discover_leaves(cells, ["props", "detail"]))


@query("""
    select unnest(['props', 'props', 'props', 'props']) as source, unnest(['k', 'm', 'm.a', 'n']) as path,
           unnest(['BIGINT', 'OBJECT', 'BOOLEAN', 'VOID']) as kind, unnest([count(*), count(*), count(*), count(*) filter (event_type = 'view')]) as rows
    from events
    union all
    select 'props', 'n', case event_type when 'click' then 'STRING' when 'purchase' then 'DECIMAL' else 'ARRAY' end, count(*)
    from events where event_type <> 'view' group by all
""")
def key_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key of JSON cells has a value of each kind, two levels deep."""
    kind = F.col("event_type")
    n = F.when(kind == "view", "null").when(kind == "click", '"1"').when(kind == "purchase", "1.5").otherwise("[1]")
    cell = F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit(',"m":{"a":true},"n":'), n, F.lit("}"))
    objects = cell_objects(spread_rows(table(spark, sf_dir, "events")).select(cell.alias("props")), ["props"])
    inner = objects_in(objects)
    rows = key_counts(objects).unionByName(key_counts(inner))
    return rows.select("source", F.array_join("path", ".").alias("path"), "kind", "rows")


@query("""
    select event_id, event_type as cell_kind, '{"u' || event_id || '":' || user_id || '}' as "cell_byUser" from events
""")
def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object whose keys are data is found by its key counts, and stays one column of JSON text."""
    user = F.concat(F.lit('{"u'), F.col("event_id").cast("string"), F.lit('":'), F.col("user_id").cast("string"), F.lit("}"))
    cell = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('","byUser":'), user, F.lit("}"))
    cells = spread_rows(table(spark, sf_dir, "events")).select("event_id", cell.alias("cell"))
    return flatten_json(cells, discover_leaves(cells, ["cell"]))


@query("""
    select c_custkey, case when c_mktsegment = 'BUILDING' then ''
                           when c_mktsegment = 'MACHINERY' then r_name || ', ' || n_name
                           else r_name end as customDimensions
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def custom_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined values of custom-dimension literals."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    one = F.concat(F.lit("{'index': '4', 'value': '"), F.col("r_name"), F.lit("'}"))
    two = F.concat(F.lit(", {'index': '5', 'value': ' "), F.col("n_name"), F.lit(" '}"))
    segment = F.col("c_mktsegment")
    cell = (
        F.when(segment == "BUILDING", "[]")
        .when(segment == "MACHINERY", F.concat(F.lit("["), one, two, F.lit("]")))
        .otherwise(F.concat(F.lit("["), one, F.lit("]")))
    )
    return customers.select("c_custkey", custom_dimension_value(cell).alias("customDimensions"))


@query("""
    select page_id, list_filter(string_split(trim(url), '/'), lambda x: x <> '')[-1] as leaf from pages
""")
def last_leaf_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last path segment of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", last_leaf(F.col("url")).alias("leaf"))


@query("""
    select p_partkey, case when p_type = 'PROMO' then 'unknown'
                           when p_type = 'SMALL' then p_type else p_name end as leaf
    from part
""")
def last_leaf_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-leaf categories, with trailing slashes and placeholders."""
    path = (
        F.when(F.col("p_type") == "PROMO", "(not set)/")
        .when(F.col("p_type") == "SMALL", F.concat(F.lit(" Home/"), F.col("p_type"), F.lit("//")))
        .otherwise(F.concat(F.lit("Home/"), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("/ ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", last_leaf(path).alias("leaf"))


@query("""
    select cast(event_id as string) as visitId,
           cast(case event_type when 'view' then event_id when 'click' then 12 end as bigint) as totals_hits,
           case event_type when 'view' then value when 'click' then -0.5 when 'signup' then 1000.0 end
               as totals_transactionRevenue
    from events
""")
def coerce_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to numbers: bad texts become null, identifiers stay text."""
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("visitId"),
        F.when(kind == "view", F.concat(F.col("event_id").cast("string"), F.lit(".0")))
        .when(kind == "click", " 12 ")
        .when(kind == "signup", "12d")
        .when(kind == "error", "1.5")
        .otherwise("")
        .alias("totals_hits"),
        F.when(kind == "view", F.col("value").cast("string"))
        .when(kind == "click", "-.5")
        .when(kind == "signup", "1e3")
        .when(kind == "error", "1_000")
        .otherwise("n/a")
        .alias("totals_transactionRevenue"),
    )
    return cast_ids(cast_totals(raw))


@query("""
    select event_id, case event_type when 'view' then 1 end::bigint as whole,
           case event_type when 'view' then 1.0 when 'click' then 1500000.0 end::double as number,
           case event_type when 'view' then 1.0 when 'click' then 1500000.0
                           when 'error' then 1000.0 else 0.0 end::double as or_zero
    from events
""")
def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules for numbers in texts."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "1.0")
        .when(kind == "click", "+1.5E6")
        .when(kind == "error", "1_000")
        .when(kind == "signup", "1f")
        .otherwise("1,000")
    )
    whole = F.when(kind != "click", text)
    return table(spark, sf_dir, "events").select(
        "event_id",
        text_to_long(whole).alias("whole"),
        text_to_double(text).alias("number"),
        float_or_zero(text).alias("or_zero"),
    )


@query("""
    select event_id, value, event_type from events
""")
def drop_low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with one value found in the data and dropped."""
    wide = table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        "event_type",
        F.lit("not available in demo dataset").alias("device_language"),
        F.lit(None).cast("double").alias("nothing"),
        F.lit(1).alias("visits"),
    )
    return drop_columns(wide, single_valued_columns(wide))


@query("""
    select event_id, event_type from events
""")
def drop_listed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the fixed list dropped where they exist."""
    wide = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.col("props").alias("device_browserSize"),
        F.col("value").alias("geoNetwork_latitude"),
    )
    return drop_columns(wide)


@query("""
    with t as (select o_orderkey, case o_orderpriority when '1-URGENT' then '  '
                   when '2-HIGH' then 'NONE' when '3-MEDIUM' then 'UNKNOWN'
                   when '4-NOT SPECIFIED' then ' (not set) ' else
                   case o_orderstatus when 'F' then '(Other)' when 'O' then null else 'A' end end as v
               from orders)
    select o_orderkey, v is null or trim(v) = '' or lower(v) = 'none' as missing,
           coalesce(trim(v) in ('UNKNOWN', '(not set)'), false) as unknown,
           coalesce(v = '(Other)', false) as other, coalesce(v <> 'A', true) as reserved
    from t
""")
def sentinel_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholder texts told apart: missing, unknown, other."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    v = (
        F.when(priority == "1-URGENT", "  ")
        .when(priority == "2-HIGH", "NONE")
        .when(priority == "3-MEDIUM", "UNKNOWN")
        .when(priority == "4-NOT SPECIFIED", " (not set) ")
        .when(status == "F", "(Other)")
        .when(status != "O", "A")
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", v.alias("v"))
        .select(
            "o_orderkey",
            is_none(F.col("v")).alias("missing"),
            is_unknown(F.col("v")).alias("unknown"),
            is_other(F.col("v")).alias("other"),
            is_reserved(F.col("v")).alias("reserved"),
        )
    )


FLAT = """
    select event_type as channelGrouping,
           cast(strftime(ts, '%Y%m%d') as bigint) as date,
           lpad(cast(user_id as string), 8, '0') as fullVisitorId,
           cast(event_id as string) as visitId,
           1 + user_id % 7 as visitNumber,
           cast(floor(epoch(ts)) as bigint) as visitStartTime,
           'Not Socially Engaged' as socialEngagementType,
           case when event_type = 'error' then '' else upper(event_type) end as customDimensions,
           event_type as device_browser,
           case when event_id % 2 = 0 then 'True' else 'False' end as device_isMobile,
           'not available in demo dataset' as device_browserSize,
           'C' || (user_id % 20) as geoNetwork_country,
           '1' as totals_visits,
           cast(n as string) as totals_hits,
           cast(1 + event_id % 17 as string) as totals_pageviews,
           case event_type when 'click' then '0' else '' end as totals_transactionRevenue,
           case event_type when 'click' then '7' when 'signup' then cast(cents * 20000 as string)
                           else '' end as totals_totalTransactionRevenue,
           '(direct)' as trafficSource_source,
           case event_type when 'view' then cast(n as string) else '' end
               as trafficSource_adwordsClickInfo_page,
           n as total_product_viewed,
           cents * (n + 1) / 200 as average_price_product_viewed,
           cast(len(c) as bigint) as total_category_viewed,
           coalesce(c[1], '') as categories_viewed_0,
           coalesce(c[2], '') as categories_viewed_1,
           coalesce(c[3], '') as categories_viewed_2,
           case event_type when 'purchase' then cents * n / 100
                           when 'signup' then cents * 2 / 100 else 0.0 end as total_revenue
    from (select *, case n when 1 then ['unknown'] when 2 then list_sort([event_type, 'unknown'])
                             else list_sort(['Third', event_type, 'unknown']) end as c
          from (select *, 1 + event_id % 3 as n, cast(round(value * 100) as bigint) as cents
                from events))
"""


ROUNDED = """
    select * replace (round(average_price_product_viewed, 4) as average_price_product_viewed,
                      round(total_revenue, 4) as total_revenue)
"""


def _rounded(flat: DataFrame) -> DataFrame:
    return flat.withColumns(
        {c: F.round(c, 4) for c in ("average_price_product_viewed", "total_revenue")}
    )


def _spread_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sessions, written once, with as many category columns as any session needs."""
    raw = event_sessions(spark, sf_dir)
    flat = materialize(flatten_sessions(raw, discover_leaves(raw)), "flat-sessions")
    return spread_categories(flat, category_width(flat))


@query(f"{ROUNDED} from ({FLAT})")
def session_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sessions to flat rows: JSON leaves, custom dimensions, hit metrics."""
    return _rounded(_spread_sessions(spark, sf_dir))


CLEAN = f"""
    select * exclude (device_browserSize)
           replace (cast(totals_visits as bigint) as totals_visits,
                    cast(totals_hits as bigint) as totals_hits,
                    cast(totals_pageviews as bigint) as totals_pageviews,
                    try_cast(totals_transactionRevenue as double) as totals_transactionRevenue,
                    try_cast(totals_totalTransactionRevenue as double) as totals_totalTransactionRevenue)
    from ({FLAT})
"""


@query(f"{ROUNDED} from ({CLEAN})")
def clean_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sessions with the listed columns dropped and totals and identifiers cast."""
    return _rounded(cast_ids(cast_totals(drop_columns(_spread_sessions(spark, sf_dir)))))


# A literal cell in every form, what Python reads in it, and a JSON cell with what becomes of it.
DIRTY = [
    (r"[{'value': 'a\x41\v\101\U0001F600'}]", "aA\x0bA\U0001F600", '{"a":1,"a":2}', "2"),
    (r"[{'value': u'p', 'value': 'last'}]", "last", '{"a":"x"} junk', ""),
    ("[{'value': ('t', 1)}]", "('t', 1)", '{"a":"x"}{"a":"y"}', ""),
    ("[{'value': 'one' 'two'}]", "onetwo", '{"a":"x"},{"a":"y"}', ""),
    ("[{'value': 1_000}, {1: 2, 'value': 0x10}]", "1000, 16", '{"a":{"k":"v"}}', ""),
    (r"[{'value': 'it\'s'}, {'value': r'\d'}]", "it's, \\d", '{"a":[]}', ""),
    ("[{'value': True}, {'value': None}, {'value': 2.50}]", "True, None, 2.5", '{"a":1.0}', "1.0"),
    ("[{'value': 'x: True, y'}]", "x: True, y", '{"a":["b",null]}', "['b', None]"),
    ("[{'value': 'lost'}] junk", "", '{"a":"b]"}', "b]"),
    ("({'value': 'no list'},)", "", '{"a":"x"}], [{"a":"y"}', ""),
    ("[{'value': 'cut", "", "[1]", ""),
    (" ", "", "", ""),
    ("[{'value': 0xfFfFfFfFfFfFfFfFfFfF}]", "1208925819614629174706175", "{}", ""),
    (f"[{{'value': 0b{'1' * 66}}}, {{'value': 0o{'7' * 30}}}]", f"{2**66 - 1}, {8**30 - 1}", "", ""),
    (r"[{'value': '\U0010FFFF \x41'}]", "\U0010ffff A", "", ""),
    (r"[{'value': 'kept'}, {'value': '\U00110000'}]", "", "", ""),
    (r"[{'value': '\ud800'}]", "", "", ""),
    (f"[{{'value': -{'9' * 38}}}]", f"-{'9' * 38}", "", ""),
    (f"[{{'value': {'9' * 42}}}]", "", "", ""),
    (f"[{{'value': 0x{'f' * 4000}}}]", "", "", ""),
]
UNPARSED = {"dimensions malformed": [8, 10, 15, 16, 18, 19], "dimensions no_list": [9],
            "props malformed": [1, 2], "props no_object": [3, 9, 10]}


def dirty_cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a literal and a JSON cell each, in all forms in turn."""
    form = F.pmod("event_id", F.lit(len(DIRTY))).cast("int")
    literals, objects = (F.array(*[F.lit(row[k]) for row in DIRTY]) for k in (0, 2))
    events = spread_rows(table(spark, sf_dir, "events").select("event_id"))
    return events.select(
        "event_id", F.get(literals, form).alias("dimensions"), F.get(objects, form).alias("props")
    )


def _sql_text(text: str) -> str:
    quoted = text.replace("'", "''")
    return "'" + "' || chr(11) || '".join(quoted.split("\x0b")) + "'"


def _dirty_sql(column: int) -> str:
    cases = " ".join(f"when {k} then {_sql_text(row[column])}" for k, row in enumerate(DIRTY))
    return f"case event_id % {len(DIRTY)} {cases} end"


@query(f"select event_id, {_dirty_sql(1)} as dimensions, {_dirty_sql(3)} as props_a from events")
def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal but unusual cells are read as Python reads them; the others are empty."""
    cells = parse_literals(dirty_cells_of(spark, sf_dir), {"dimensions": "_dimensions"})
    read = cells.withColumn("dimensions", dimension_values(list_or_empty(F.col("_dimensions")))).drop("_dimensions")
    return flatten_json(read, [Leaf("props", ("a",))])


def _unparsed_sql() -> str:
    kinds = " union all ".join(
        f"select '{name.split()[0]}' as \"column\", '{name.split()[1]}' as reason, {k} as kind"
        for name, held in UNPARSED.items()
        for k in held
    )
    return f"""
        select "column", reason, count(*) as cells
        from events join ({kinds}) on event_id % {len(DIRTY)} = kind
        group by all
    """


UNPARSED_SQL = _unparsed_sql()


@query(UNPARSED_SQL)
def unparsed_cells_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that give nothing, by column and reason."""
    return unparsed_cells(dirty_cells_of(spark, sf_dir), ["props"], ["dimensions"])
