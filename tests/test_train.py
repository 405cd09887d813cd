"""Training in rounds: gradients, planted data, early stop, history, runs that go on."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import learn, train


@pytest.fixture(scope="module")
def rows(spark):
    a, b = (F.rand(s) * 2 - 1 for s in (1, 2))
    df = spark.range(4000).repartition(4).select("id", (a * 5 + 3).alias("a"), F.when(F.col("id") % 50 == 0, None).otherwise(b).alias("b"), (F.col("id") % 4 == 0).alias("held"))
    df = df.withColumns({"quality_score": 50 + 6 * (F.col("a") - 3) - 4 * F.coalesce("b", F.lit(0.0)), "blue_water_severity": F.when(F.col("id") % 3 != 0, 5 - F.coalesce("b", F.lit(0.0)))})
    return df.persist()


OPTIONS = {"severity": "blue_water_severity", "held_out": "held", "features": ["a", "b"]}


def test_gradients_are_slopes_of_the_losses():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 2))
    x[3, 1], y[5, 1] = np.nan, np.nan
    for hidden in (0, 4):
        net = train.Network(["a", "b", "c"], [0.1, 0.0, 0.2], [1.0, 2.0, 0.5], hidden).begin(7)
        _, slopes = net.judged(x, y)
        for k in range(len(net.weights)):
            kept, change = net.weights[k], 1e-6
            ends = []
            for d in (change, -change):
                net.weights[k] = kept + d
                ends.append(net.judged(x, y)[0][:2])
            net.weights[k] = kept
            assert slopes[:, k] == pytest.approx((ends[0] - ends[1]) / (2 * change), rel=1e-4, abs=1e-5)


def test_planted_scores_are_learnt_and_the_run_stops(spark, rows, tmp_path):
    state = train.train(rows, 400, str(tmp_path / "run"), rate=0.1, patience=6, **OPTIONS)
    log = train.history(spark, state).orderBy("epoch").collect()
    assert [r.epoch for r in log] == list(range(1, state.epoch + 1)) and state.epoch < 400
    assert min(r.val_loss for r in log) == state.best < 0.01 * log[0].train_loss
    assert [r.val_loss for r in log[-6:]] == sorted(r.val_loss for r in log[-6:]) or min(r.val_loss for r in log[-6:]) >= state.best
    assert log[-1].learning_rate <= log[0].learning_rate
    best = train.State.load(str(tmp_path / "run/best_model.json"))
    assert best.best == state.best and best.epoch == state.epoch - 6
    found = train.predict(best.model, rows)
    assert learn.evaluate(found).first().mae < 0.5 and found.columns == [*rows.columns, "dl_score", "dl_severity"]
    assert json.load(open(tmp_path / "run/training_history.json")) == state.history
    assert {f"checkpoint_epoch_{n}.json" for n in range(5, state.epoch, 5)} <= set(os.listdir(tmp_path / "run"))


def test_a_run_that_goes_on_equals_one_that_never_stopped(rows, tmp_path):
    whole = train.train(rows, 12, str(tmp_path / "a"), hidden=3, **OPTIONS)
    train.train(rows, 7, str(tmp_path / "b"), hidden=3, **OPTIONS)
    went_on = train.train(rows, 12, str(tmp_path / "b"), resume=str(tmp_path / "b/checkpoint_epoch_7.json"), **OPTIONS)
    assert went_on == whole and len(whole.history) == 12


def test_plateau_and_bounds():
    state = train.State(train.Network(["a"], [0.0], [1.0]).begin(1), rate=0.8)
    for loss in [1.0] * 7:
        state.plateau(loss)
    assert state.rate == 0.4
    state.step(np.array([1e9, 0, 0, 0.0]))
    assert abs(np.array(state.model.weights)).max() <= 0.41


def test_odd_tables(rows, tmp_path):
    with pytest.raises(ValueError):
        train.train(rows, 0, str(tmp_path))
    with pytest.raises(RuntimeError):
        train.train(rows.withColumn("quality_score", F.lit(None).cast("double")), 2, str(tmp_path), **OPTIONS)
    with pytest.raises(RuntimeError):
        train.train(rows.limit(0), 2, str(tmp_path), **OPTIONS)
    flat = train.train(rows.withColumn("a", F.lit(1.0)), 3, str(tmp_path / "flat"), features=["a"])  # no validation, no severity, no spread
    assert len(flat.history) == 3 and all(np.isfinite(h["val_loss"]) for h in flat.history)
