import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from visitflow import FittedPipeline, fit_pipeline, fit_transform
from visitflow.plans.training import train_and_evaluate
from visitflow.session import materialize, new_table_path, shared_folder, temporary_tables
from visitflow.sources.params import load_json, load_version, save_version
from visitflow.sources.tables import (
    read_parts_relaxed,
    read_sessions_csv,
    read_table,
    rows_per_part,
    union_relaxed,
    write_csv,
    write_table,
)
from workload.sessions import event_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return event_sessions(spark, SF)


@pytest.fixture(scope="module")
def fitted(raw):
    return fit_pipeline(raw)


def test_transform_has_no_shuffle(raw, fitted):
    plan = fitted.transform(raw.sparkSession.createDataFrame([], raw.schema))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_parameters_survive_storage(spark, raw, fitted, tmp_path):
    path = str(tmp_path / "params")
    assert fitted.save(spark, path) == 1
    assert fitted.save(spark, path) == 2
    again = FittedPipeline.load(spark, path)
    assert again == fitted
    one = raw.limit(20)
    assert again.transform(one).exceptAll(fitted.transform(one)).count() == 0


def test_fit_transform_is_fit_then_transform(raw, fitted):
    again, table = fit_transform(raw)
    assert again == fitted
    assert table.columns == fitted.transform(raw).columns
    assert table.exceptAll(fitted.transform(raw)).count() == 0
    assert list(fitted.dictionary["columns"]) == sorted(fitted.dictionary["columns"])


def test_new_sessions_use_frozen_parameters(spark, raw, fitted):
    new = raw.limit(1).withColumns(
        {"channelGrouping": F.lit("never seen"), "device": F.lit('{"other":"x"}'), "totals": F.lit("bad")}
    )
    r = fitted.transform(new).first()
    assert r["channelGrouping"] == fitted.dictionary["columns"]["channelGrouping"]["others_index"]
    assert r["device_browser"] == 0 and r["totals_hits"] == 0


def test_fit_does_not_depend_on_partitions(raw, fitted):
    other = fit_pipeline(raw.repartition(3), sorted_rows=50)
    assert other.dictionary == fitted.dictionary and other.leaves == fitted.leaves
    caps = [[f.get("cap_value") for f in p.policy["features"]] for p in (other, fitted)]
    assert caps[0] == pytest.approx(caps[1])


def test_transform_accepts_a_stream(spark, raw, fitted, tmp_path):
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path)
    query = (
        fitted.transform(stream)
        .writeStream.format("memory")
        .queryName("model_input_stream")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    streamed = spark.table("model_input_stream")
    batch = fitted.transform(spark.read.parquet(path))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_csv_keeps_identifiers_and_quotes(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "hits,fullVisitorId,date,channelGrouping,device\n"
        '"[{\'a\': ""x, y""}]",00123,20180131,NA,"{""b"": ""1""}"\n'
        "[],None,bad,Direct,\n"
    )
    rows = [tuple(r) for r in read_sessions_csv(spark, str(path)).collect()]
    assert rows == [
        ("[{'a': \"x, y\"}]", "00123", 20180131, None, '{"b": "1"}'),
        ("[]", "None", None, "Direct", None),
    ]
    multi = tmp_path / "multi.csv"
    multi.write_text('hits,visitId\n"[1,\n2]",7\n')
    assert tuple(read_sessions_csv(spark, str(multi), multi_line=True).first()) == ("[1,\n2]", "7")


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(25).coalesce(1), path, rows_per_file=10)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 3
    assert read_table(spark, path).count() == 25
    assert sorted(r["rows"] for r in rows_per_part(spark, path).collect()) == [5, 10, 10]
    write_csv(spark.createDataFrame([('a "b", c',)], "x string"), str(tmp_path / "c"))
    assert read_sessions_csv(spark, str(tmp_path / "c")).first()[0] == 'a "b", c'
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="(?i)infer|parquet"):
        read_table(spark, str(tmp_path / "empty"))


def test_relaxed_union(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "x int, y bigint")
    b = spark.createDataFrame([("q", 0.5)], "x string, z double")
    out = union_relaxed(a, b)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "bigint", "double"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == [("1", 2, None), ("q", None, 0.5)]
    path = str(tmp_path / "parts")
    a.write.parquet(path)
    b.write.mode("append").parquet(path)
    assert read_parts_relaxed(spark, path).select("x", "y", "z").exceptAll(out).count() == 0
    same = str(tmp_path / "same")
    a.write.parquet(same)
    a.withColumn("more", F.lit(1)).write.mode("append").parquet(same)
    assert sorted(r["more"] or 0 for r in read_parts_relaxed(spark, same).collect()) == [0, 1]


def test_json_documents(spark, tmp_path):
    document = {"columns": {"c": {"value_to_index": {"é\n": 2}}}}
    (tmp_path / "policy.json").write_text(json.dumps(document, indent=2))
    assert load_json(spark, str(tmp_path / "policy.json")) == document
    path = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        load_version(spark, path)
    for i in range(1, 11):
        assert save_version(spark, {"n": i}, path) == i
    assert load_version(spark, path) == {"n": 10}
    assert load_version(spark, path, 2) == {"n": 2}


def test_materialized_table_is_in_the_shared_folder(spark):
    table = materialize(spark.range(3), "three")
    assert shared_folder(spark) in table.inputFiles()[0]
    assert table.count() == 3


def tables_in(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return {p.name for p in Path(folder).iterdir() if not re.fullmatch(r"[0-9a-f-]{36}", p.name)}


def test_fits_leave_no_tables(spark, raw):
    before = tables_in(spark)
    fit_pipeline(raw)
    rows = raw.selectExpr("fullVisitorId", "visitId", "visitNumber + 0.5 as total_revenue", "visitNumber")
    train_and_evaluate(rows, rows, kind="linear").report.collect()
    assert tables_in(spark) == before
    with temporary_tables(spark):
        _, features = fit_transform(raw)
        assert features.count() == raw.count() and len(tables_in(spark)) == len(before) + 1
    assert tables_in(spark) == before
    with pytest.raises(RuntimeError), temporary_tables(spark):
        materialize(raw.limit(1), "lost")
        new_table_path(spark, "never-written")
        raise RuntimeError
    assert tables_in(spark) == before
