"""Queries for mergeable profiles, tables in versions and in buckets, streams, and counts made while writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from visitflow.functions.literals import parse_json_object
from visitflow.operators.evaluate import compare_visitors, visitor_actuals, visitor_predictions, write_by_visitor
from visitflow.operators.flatten import discover_leaves, flatten_sessions
from visitflow.operators.literals import lost_reasons, observe_reasons, observed_counts, parse_literals
from visitflow.operators.model import PREDICTION
from visitflow.operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    add_part,
    profile_of_states,
    profile_state,
    read_states,
)
from visitflow.plans.pipeline import fit_pipeline
from visitflow.session import materialize, new_table_path
from visitflow.sources.versions import drop_old_versions, publish, read_current, rewrite
from visitflow.streaming.sessions import read_sink, session_stream, transform_stream
from workload.flatten_queries import UNPARSED_SQL, dirty_cells_of
from workload.model_queries import MODEL_INPUT_SQL, VISITORS_SQL, logs_rounded, scored_events
from workload.registry import query
from workload.sessions import event_sessions, table

FRACTIONS = [0.25, 0.5, 0.99]
PROFILED = ["l_quantity", "l_extendedprice", "l_discount"]


def _profile_sql(c: str) -> str:
    return f"""
        select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as exact_different,
               true as different_within, round(avg({c}), 6) as mean, round(stddev_samp({c}), 4) as std,
               cast(min({c}) as double) as least, cast(max({c}) as double) as most, true as quantiles_within
        from lineitem
    """


@query(" union all ".join(_profile_sql(c) for c in PROFILED))
def profile_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of parts, merged: counts and sums are exact, estimates lie within the stated bounds of exact values."""
    lines = table(spark, sf_dir, "lineitem")
    path = new_table_path(spark, "profile-states")
    for flag in ("A", "N", "R"):  # a part each
        add_part(profile_state(lines.where(F.col("l_returnflag") == flag), flag, PROFILED, []), path)
    found = profile_of_states(read_states(spark, path), FRACTIONS)
    # Exact ranks of the estimated quantiles: the rows below, and up to each.
    estimates = {r["column"]: r["quantiles"] for r in found.select("column", "quantiles").collect()}
    exact = lines.agg(
        *[F.count_distinct(c).alias(f"d_{c}") for c in PROFILED],
        *[
            F.struct(F.avg((F.col(c) < v).cast("double")).alias("below"), F.avg((F.col(c) <= v).cast("double")).alias("upto")).alias(f"r{i}_{c}")
            for c in PROFILED
            for i, v in enumerate(estimates[c])
        ],
    ).first()
    checks = [
        (
            c,
            exact[f"d_{c}"],
            all(exact[f"r{i}_{c}"]["below"] - RANK_ERROR <= q <= exact[f"r{i}_{c}"]["upto"] + RANK_ERROR for i, q in enumerate(FRACTIONS)),
        )
        for c in PROFILED
    ]
    beside = spark.createDataFrame(checks, "column string, exact_different bigint, quantiles_within boolean")
    within = F.abs(F.col("different") - F.col("exact_different")) <= F.ceil(F.col("exact_different") * DISTINCT_ERROR)
    return found.join(F.broadcast(beside), "column").select(
        "column", "rows", "missing", "exact_different", within.alias("different_within"),
        F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "least", "most", "quantiles_within",
    )


@query("""
    select cast(event_id as string) as event_id, event_type, value * 2 as value from events where event_type <> 'error'
""")
def rewritten_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten twice in place: readers follow its pointer to the last version."""
    path = new_table_path(spark, "rewritten")
    publish(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    rewrite(spark, path, lambda old: old.withColumn("event_id", F.col("event_id").cast("string")))
    rewrite(spark, path, lambda old: old.where("event_type <> 'error'").withColumn("value", F.col("value") * 2))
    drop_old_versions(spark, path)
    return read_current(spark, path)


@query(f"""select fullVisitorId, round(p, 4) as "PredictedLogRevenue", round(a, 4) as actual from ({VISITORS_SQL})""")
def bucketed_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per visitor and their join over a table in buckets of visitors: no shuffle."""
    name = f"by_visitor_{new_table_path(spark, 'x').rsplit('-', 1)[-1]}"
    write_by_visitor(scored_events(spark, sf_dir), name, 8, new_table_path(spark, "by-visitor"))
    scored = spark.table(name)
    compared = compare_visitors(visitor_predictions(scored), visitor_actuals(scored))
    return compared.withColumns({c: F.round(c, 4) for c in (PREDICTION, "actual")})


@query(UNPARSED_SQL)
def observed_unparsed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost cells by column and reason, counted in the pass that writes the parsed cells."""
    literals, objects = {"dimensions": "_dimensions"}, {"props": "_props"}
    parsed = parse_literals(dirty_cells_of(spark, sf_dir), literals).withColumn("_props", parse_json_object(F.col("props")))
    why = {f"_why_{c}": reason for c, reason in lost_reasons(objects, literals).items()}
    observation = Observation()
    watched = observe_reasons(parsed.withColumns(why), observation, {c: f"_why_{c}" for c in (*objects, *literals)})
    materialize(watched.select("event_id", F.to_json("_dimensions").alias("dimensions"), F.to_json("_props").alias("props")), "parsed-cells")
    return observed_counts(spark, observation)


@query("""
    select (select count(*) from events) as rows, count(*) as sessions_past, count(*) as categories_past
    from events where event_id % 3 = 2
""")
def observed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with more categories than columns, counted in the pass that writes the flat table."""
    raw = event_sessions(spark, sf_dir)
    observation = Observation()
    flat = flatten_sessions(raw, discover_leaves(raw, ["totals"]), 2, observation)
    materialize(flat, "flat-observed")
    return spark.createDataFrame(
        [tuple(observation.get[c] for c in ("rows", "sessions_past", "categories_past"))],
        "rows bigint, sessions_past bigint, categories_past bigint",
    )


@query(MODEL_INPUT_SQL)
def streamed_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that arrive as files, through a fitted pipeline as a stream, into a parquet sink."""
    raw = materialize(event_sessions(spark, sf_dir), "arriving-sessions")
    fitted = fit_pipeline(raw)
    sink, checkpoint = new_table_path(spark, "model-input-sink"), new_table_path(spark, "stream-checkpoint")
    arriving = session_stream(spark, raw.inputFiles()[0].rsplit("/", 1)[0], raw.schema)
    transform_stream(arriving, fitted, sink, checkpoint).awaitTermination()
    return logs_rounded(read_sink(spark, sink))
