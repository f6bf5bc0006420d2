"""Stored networks against loops over single numbers; gradients and training of autoencoders."""

import math

import numpy as np
import pytest

from skyweave.functions import sums
from skyweave.operators import networks, represent
from skyweave.operators.networks import Layer

RNG = np.random.default_rng(21)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "obj_id long, features array<double>")


def test_a_stored_network_runs_as_its_layers_say(spark, tmp_path):
    """Convolution, elu, pooling and a dense bottleneck of ten samples, number by number."""
    kernel, shift, dense = RNG.normal(size=(3, 1, 2)), RNG.normal(size=2), RNG.normal(size=(10, 2))
    back = RNG.normal(size=(2, 10))
    path = str(tmp_path / "network")
    networks.network_table(spark, [Layer("conv", "elu", 1, kernel, shift), Layer("pool", size=2), Layer("flatten"), Layer("dense", "tanh", 1, dense), Layer("dense", "linear", 1, back)]).write.parquet(path)
    layers = networks.layers_of(spark.read.parquet(path))
    x = RNG.normal(size=(600, 10))
    got = {r.obj_id: r for r in networks.run_network(frame(spark, x), layers, 4).collect()}
    assert len(got) == 600
    for i in (0, 7, 599):
        padded = [0.0, *x[i].tolist(), 0.0]
        wide = [[sum(padded[t + k] * kernel[k, 0, c] for k in range(3)) + shift[c] for c in range(2)] for t in range(10)]
        wide = [[v if v > 0 else math.exp(v) - 1 for v in row] for row in wide]
        flat = [max(wide[2 * t][c], wide[2 * t + 1][c]) for t in range(5) for c in range(2)]
        z = [math.tanh(sum(flat[j] * dense[j, k] for j in range(10))) for k in range(2)]
        assert got[i].bottleneck == pytest.approx(z)
        assert got[i].reconstruction == pytest.approx([sum(z[k] * back[k, j] for k in range(2)) for j in range(10)])


def test_layers_that_change_length():
    x = RNG.normal(size=(2, 7))
    assert np.allclose(Layer("mean_pool", size=2).apply(x)[:, :, 0], [[(r[0] + r[1]) / 2, (r[2] + r[3]) / 2, (r[4] + r[5]) / 2, r[6]] for r in x])
    assert Layer("conv", size=2, weights=np.ones((3, 1, 1))).apply(x).shape == (2, 4, 1)
    up = Layer("upsample", size=3).apply(x)
    assert up.shape == (2, 21, 1) and up[0, 5, 0] == x[0, 1]
    assert Layer("reshape", size=7).apply(x).shape == (2, 1, 7)
    assert np.allclose(Layer("norm", weights=[[2.0] * 7, [1.0] * 7]).apply(x), 2 * x + 1)
    with pytest.raises(ValueError):
        Layer("attention")


def test_a_network_that_is_too_large_is_refused(spark, monkeypatch):
    table = networks.network_table(spark, networks.dense_autoencoder(6, [3]))
    monkeypatch.setattr(networks, "NETWORK_BYTES", 100)
    with pytest.raises(ValueError):
        networks.layers_of(table)


@pytest.mark.parametrize("activation", sorted(networks.ACTIVATIONS))
def test_gradients_are_differences(activation):
    layers, x = networks.dense_autoencoder(5, [4, 2], activation, 3), RNG.normal(size=(9, 5))
    at = networks.flattened(layers) + RNG.normal(0, 0.1, len(networks.flattened(layers)))  # no unit stands at a bend
    layers = networks.unflattened(layers, at)
    slope, step = networks.gradients(layers, x)[1], 1e-6
    for k in range(0, len(at), 3):
        ends = [networks.gradients(networks.unflattened(layers, at + s * step * np.eye(len(at))[k]), x)[0] for s in (1, -1)]
        assert slope[k] == pytest.approx((ends[0] - ends[1]) / (2 * step), rel=1e-4, abs=1e-6)


def test_training_beats_the_linear_encoder(spark, monkeypatch):
    """Points on a bent line have one number each, which no straight line through them tells."""
    rng = np.random.default_rng(4)
    t = rng.uniform(-1, 1, 300)
    x = np.stack([t, t * t, np.sin(2 * t)], 1) + rng.normal(0, 0.01, (300, 3))
    table = frame(spark, x).cache()
    start = networks.dense_autoencoder(3, [8, 1], "tanh", 1)
    monkeypatch.setattr(sums, "BLOCK", 50)
    one, eight = (networks.loss_and_gradient(table.repartition(n), start) for n in (1, 8))
    assert one[0] == pytest.approx(eight[0]) and np.allclose(one[1], eight[1], rtol=1e-10, atol=1e-12)
    assert np.allclose(one[1], networks.gradients(start, x)[1] / 300)
    trained = networks.train(table, start, rounds=20)
    straight = represent.encode(table, *represent.linear_encoder(table, 1)).toPandas()
    linear = np.mean([np.mean((np.array(a) - np.array(b)) ** 2) for a, b in zip(straight.features, straight.reconstruction)])
    assert networks.loss_and_gradient(table, trained)[0] < 0.6 * linear
    assert networks.loss_and_gradient(table.limit(0), trained)[0] == 0
