"""The network's gradient, its distributed fit and its use."""

import numpy as np
import pytest

from gridsieve.operators.models import gate, gate_fit

SCHEMA = "prob_autoencoder double, prob_iforest double, prob_kmeans double, arch_similarity double, label int"


def labelled(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [1000, 0, 5, -3]
    y = ((x[:, 0] - 1000) * x[:, 1] > 0).astype(int)
    return x, y


def frame(spark, x, y, parts=5):
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    flat = gate_fit.start_weights(3)
    _, gradient = gate_fit.loss_and_gradient(flat, x, y)
    for k in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (gate_fit.loss_and_gradient(flat + s, x, y)[0] for s in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fit_equals_the_same_steps_in_one_place(spark):
    """Partial sums of five partitions against NumPy over all rows."""
    x, y = labelled()
    model = gate_fit.fit_network(frame(spark, x, y), rounds=4, shrink=0.01)
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], x.std(axis=0))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    flat = gate_fit.start_weights(42)
    m, v, losses = np.zeros_like(flat), np.zeros_like(flat), []
    for t in range(1, 5):
        loss, g = gate_fit.loss_and_gradient(flat, z, y)
        losses.append(loss / len(y) + 0.005 * flat @ flat)
        g = g / len(y) + 0.01 * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model["losses"], losses)


def test_learns_what_a_line_cannot(spark):
    x, y = labelled()
    rows = frame(spark, x, y)
    model = gate_fit.fit_network(rows, rounds=60)
    assert min(model["losses"]) < 0.5 * np.log(2)
    scored = gate.gate_score(rows, model, into="p").toPandas()
    assert ((scored.p > 0.5) == (scored.label == 1)).mean() > 0.9
    again = gate.forward(scored[list(gate.FEATURES)].to_numpy(), model)
    assert np.allclose(again, scored.p)


def test_odd_rows(spark):
    """Nulls and values that are not finite are left out, a constant feature does no harm, an
    empty table gives no model, further columns are ignored."""
    x, y = labelled(60)
    x[:, 3] = 7.0
    good = frame(spark, x, y)
    bad = spark.createDataFrame(
        [(None, 1.0, 1.0, 1.0, 1), (1.0, float("nan"), 1.0, 1.0, 0), (1.0, 1.0, float("inf"), 1.0, 0),
         (1.0, 1.0, 1.0, 1.0, None)], SCHEMA,
    )
    from pyspark.sql import functions as F

    both = good.unionByName(bad).withColumn("x0", F.lit("clash")).withColumn("y", F.lit(None).cast("string"))
    model = gate_fit.fit_network(both, rounds=2)
    assert model["rows"] == 60 and model["scale"][3] == 1.0
    assert np.isfinite(model["losses"]).all()
    assert gate_fit.fit_network(good.limit(0)) is None
    with pytest.raises(ValueError):
        gate_fit.fit_network(good, features=gate.FEATURES[:2])
