import json

import pytest
from pyspark.sql import functions as F

from labelaudit.operators.tracking import best_step, best_trial, log_throughput, param_grid, top_trials
from labelaudit.sources import schemas as S, tables as T


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ('say "hi", you', 1, 1, 0.5),
        ('two\nlines and a ""doubled"" quote', 0, 1, 0.25),
        ("ünï çødé", 0, 0, 0.1),
    ]
    df = spark.createDataFrame(rows, S.PREDICTIONS)
    T.write_table(df, str(tmp_path / "p"), "csv")
    back = T.read_csv(spark, str(tmp_path / "p"), S.PREDICTIONS)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_csv_stops_on_bad_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text("text,true_label,predicted_label,probability\nx,one,0,0.5\n")
    with pytest.raises(Exception):
        T.read_csv(spark, str(tmp_path / "p.csv"), S.PREDICTIONS).collect()


def test_read_or_empty(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert T.read_or_empty(spark, path, S.PREDICTIONS).count() == 0
    T.write_table(spark.createDataFrame([("x", 1, 1, 0.5)], S.PREDICTIONS), path)
    assert T.read_or_empty(spark, path, S.PREDICTIONS).count() == 1


def test_split_reads_its_partition_only(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "val").otherwise("train"))
    T.write_table(df, str(tmp_path / "t"), partition_by=["split"])
    val = T.read_split(spark, str(tmp_path / "t"), "val")
    assert val.count() == 3 and val.columns == ["id"]
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_training_log(spark, tmp_path):
    log = {
        "best_metric": 0.7,
        "best_model_checkpoint": "run/checkpoint-200",
        "log_history": [
            {"epoch": 0.1, "step": 100, "loss": 0.6},
            {"epoch": 0.1, "step": 100, "eval_f1": 0.6, "eval_runtime": 2.0, "eval_samples_per_second": 10.0, "eval_steps_per_second": 1.0},
            {"epoch": 0.2, "step": 200, "eval_f1": 0.7, "eval_runtime": 4.0, "eval_samples_per_second": 5.0, "eval_steps_per_second": 0.5},
            {"epoch": 0.3, "step": 300, "eval_f1": 0.7},
            {"epoch": 0.4, "step": 400, "eval_f1": float("nan")},
        ],
    }
    (tmp_path / "log.json").write_text(json.dumps(log, indent=1).replace("NaN", '"NaN"'))
    read = T.read_training_log(spark, str(tmp_path / "log.json"))
    assert read.count() == 5
    assert read.where("loss IS NOT NULL").count() == 1
    best = best_step(read).first()
    assert (best.best_step, best.best_metric) == (200, 0.7)
    speed = {r.figure: (r.n, r["mean"]) for r in log_throughput(read).collect()}
    assert speed["eval_runtime"] == (2, 3.0)


def test_conform(spark):
    df = spark.createDataFrame(
        [("1", "x", float("nan")), ("1.0", "2.5", 1.0), ("bad", None, None), ("1.7", "3", None)], "label string, score string, p double"
    )
    schema = S.fields(label="int", score="double", p="double")
    assert [tuple(r) for r in S.conform(df, schema).collect()] == [(1, None, None), (1, 2.5, 1.0), (None, None, None), (None, 3.0, None)]
    lost = {r.column_name: (r.n_present, r.n_lost) for r in S.conform_losses(df, schema).collect()}
    assert lost == {"label": (4, 2), "score": (3, 1), "p": (2, 1)}


def test_columns(spark):
    df = spark.createDataFrame([("a", 1)], "text string, lable int")
    assert S.normalize_columns(df).columns == ["content", "label"]
    both = spark.createDataFrame([("a", "b")], "text string, content string")
    assert S.normalize_columns(both).columns == ["text", "content"]
    with pytest.raises(ValueError, match="definition"):
        S.require_columns(df, ["text", "definition"])


def test_trials(spark):
    nan = float("nan")
    trials = spark.createDataFrame([(1, 0.5), (2, nan), (3, 0.9), (4, None), (5, 0.9)], "trial int, f1 double")
    assert [r.trial for r in top_trials(trials, 3).collect()] == [3, 5, 1]
    assert [r.trial for r in best_trial(trials).collect()] == [3]
    assert best_trial(trials.where("trial IN (2, 4)")).count() == 0


def test_param_grid(spark):
    grid = param_grid(spark, {"m": ["x", "y"], "lr": [1.0, 2.0, 3.0]}).orderBy("trial").collect()
    assert [tuple(r) for r in grid][:4] == [(1, "x", 1.0), (2, "x", 2.0), (3, "x", 3.0), (4, "y", 1.0)]
    assert len(grid) == 6
