"""Training of the small network."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import train, vectors as vec


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(5, 3)), rng.normal(size=5)), (rng.normal(size=(4, 5)), rng.normal(size=4)), (rng.normal(size=(1, 4)), rng.normal(size=1))]
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.uniform(0.5, 2, 20)
    found = train._flat(train.gradients(x, y, w, layers)[0])
    flat = train._flat(layers)
    for i in rng.choice(len(flat), 25, replace=False):
        moved = [train.gradients(x, y, w, train._shaped(flat + s * 1e-6 * np.eye(len(flat))[i], layers))[1] for s in (1, -1)]
        assert found[i] == pytest.approx((moved[0] - moved[1]) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("batch", [10_000, 150])
def test_network_learns_and_agrees_over_reruns(spark, batch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] * v[1] > 0), 1.0) for i, v in enumerate(x)] + [(900, None, 1, 1.0), (901, [1.0, 2.0], None, 1.0), (902, [1.0, float("nan")], 1, 1.0)], "id long, v array<double>, y int, w double").repartition(3)
    epochs = 50 if batch > 400 else 12
    mean, deviation, layers, losses = train.fit_network(rows, "id", "v", "y", "w", hidden=(16, 16), epochs=epochs, batch=batch, rate=0.03)
    again = train.fit_network(rows.repartition(2), "id", "v", "y", "w", hidden=(16, 16), epochs=2, batch=batch, rate=0.03)
    assert again[3] == pytest.approx(losses[:2])
    assert losses[-1] < 0.25 < 0.6 < losses[0]
    scored = rows.filter("id < 400").withColumn("p", vec.network_score(F.col("v"), mean, deviation, layers)).collect()
    assert sum((r.p >= 0.5) == bool(r.y) for r in scored) > 370 and all(math.isfinite(r.p) for r in scored)
    with pytest.raises(ValueError):
        train.fit_network(rows.limit(0), "id", "v", "y")


def test_a_step_is_one_job_on_its_minibatch_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(rng.normal(size=(400, 2)))], "id long, v array<double>, y int").repartition(3)
    spark.sparkContext.setJobGroup("steps of training", "")
    losses = train.fit_network(rows, "id", "v", "y", hidden=(4,), epochs=5, batch=50)[3]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("steps of training")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5 * 8 + 20
    monkeypatch.setattr(train, "COMPONENTS", 30)  # a minibatch in several blocks
    assert train.fit_network(rows, "id", "v", "y", hidden=(4,), epochs=5, batch=50)[3] == pytest.approx(losses)
