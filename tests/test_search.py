import datetime

import pytest
from acervo.functions.sql import register_anomaly_search, register_functions
from acervo.streaming import ingest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_functions_of_sql_text(spark):
    assert "cosine_similarity" in register_functions(spark)
    row = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) AS a, cosine_similarity(array(1D), array(1D, 1D)) AS b, cosine_similarity(array(0D), array(1D)) AS c, cosine_similarity(CAST(NULL AS ARRAY<DOUBLE>), array(1D)) AS d, token_estimate('abcde') AS e, project_key('x 21pu2025H0155.') AS f, project_key('none') AS g").first()
    assert round(row.a, 6) == 0.707107 and (row.b, row.c, row.d, row.e, row.f, row.g) == (0.0, 0.0, 0.0, 2, "21PU2025H0155", None)


def test_table_function(spark):
    spark.createDataFrame([(1, 1, "gap", "a", [1.0, 0.0]), (2, 1, "gap", "b", [1.0, 1.0]), (3, 9, "gap", "no vessel", [1.0, 0.0]), (4, 2, "speed", "c", [1.0, 0.0]), (5, 2, "speed", "d", None), (6, 2, "speed", "e", [-1.0, 0.0])], "id long, vessel_id long, anomaly_type string, description string, embedding array<float>").createOrReplaceTempView("some_anomalies")
    spark.createDataFrame([(1, "Ana"), (2, "Bea")], "id long, name string").createOrReplaceTempView("some_vessels")
    register_anomaly_search(spark, "some_anomalies", "some_vessels", "nearest")
    got = spark.sql("SELECT id, vessel_name, round(similarity, 3) AS s FROM nearest(array(1D, 0D), 0.1D, 2)").collect()
    assert sorted(map(tuple, got)) == [(1, "Ana", 1.0), (4, "Bea", 1.0)]
    assert spark.sql("SELECT * FROM nearest(array(1D, 0D), -2D, 99)").count() == 5
    plan = spark.sql("SELECT * FROM nearest(array(1D, 0D), 0.1D, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan  # each task passes on two rows at most


def test_repeats_within_the_watermark_go_and_state_stays_bounded(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    day = lambda n: datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=n)

    def arrive(n, *rows):
        (source / f"{n}.json").write_text("\n".join(f'{{"sha": "{k}", "at": "{day(d).isoformat()}"}}' for k, d in rows))
        stream = ingest.dedup_stream(spark.readStream.schema("sha string, at timestamp").json(str(source)), "sha", "at", "2 days")
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        return sorted(r.sha for r in spark.read.parquet(out).collect()), run.lastProgress["stateOperators"][0]["numRowsTotal"] if run.lastProgress and run.lastProgress["stateOperators"] else None

    assert arrive(0, ("a", 0), ("b", 0), ("a", 1))[0] == ["a", "b"]
    assert arrive(1, ("a", 1), ("c", 1))[0] == ["a", "b", "c"]  # a new run, the same checkpoint
    kept = arrive(2, *[(f"x{i}", 10 + i) for i in range(20)])[1]
    rows, kept = arrive(3, ("late", 1), ("y", 31))
    assert "late" not in rows and "y" in rows
    assert kept is not None and kept < 10  # of 24 keys


def test_stages_are_counted_in_their_own_jobs(spark, tmp_path):
    stages = [("all", lambda d: d, 30), ("even", lambda d: d.where("id % 2 = 0"), 70), ("none", lambda d: d.limit(0), 100)]
    last, events = ingest.run_stages(spark.range(10), stages, str(tmp_path / "a"))
    assert last.count() == 0
    assert [tuple(r) for r in events.orderBy("place").collect()] == [(0, "all", "done", 30, 10), (1, "even", "done", 70, 5), (2, "none", "done", 100, 0)]
    bad = [("all", lambda d: d, 30), ("bad", lambda d: d.select(F.raise_error("stop")), 60), ("never", lambda d: d, 100)]
    last, events = ingest.run_stages(spark.range(3), bad, str(tmp_path / "b"))
    assert last.count() == 3
    assert [tuple(r) for r in events.orderBy("place").collect()] == [(0, "all", "done", 30, 3), (1, "bad", "failed", 30, None)]
    with pytest.raises(PySparkException):
        spark.range(1).select("missing")
