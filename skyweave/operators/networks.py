"""Networks over feature vectors: stored ones run on Arrow batches, and autoencoders trained by summed gradients.

A network is a table of layers in order (see SCHEMA); an encoder is its first layers. It is sent to all tasks, NETWORK_BYTES
at most. Vectors of T numbers enter a convolution as T samples of one channel. Training goes over all rows each time: tasks
sum loss and gradients of their rows, blocks of the sums meet in two steps, and the driver, which holds a few vectors of
the network's size, takes a step of L-BFGS. The start follows from a seed and the rows from nothing but their values, so
the split of the table changes no more than the last digits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import stacked
from ..functions.sums import summed

#: kind: dense, conv (padding same), norm, pool (max), mean_pool, upsample, flatten, reshape; size: stride of a convolution,
#: width of a pool, times of upsampling, channels of reshape; shape: of the weights, (inputs, outputs) of a dense layer,
#: (samples, inputs, outputs) of a convolution, (2, channels) of norm, whose rows scale and shift; bias may be empty.
SCHEMA = "layer int, kind string, activation string, size int, shape array<int>, weights array<double>, bias array<double>"
#: Fixed slope and scale of selu.
ALPHA, SCALE = 1.6732632423543772, 1.0507009873554805
NETWORK_BYTES = 64 << 20
#: Rows at once.
BATCH = 256


def _elu(x):
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


#: Each with its derivative, by input and output.
ACTIVATIONS = {
    "linear": (lambda x: x, lambda x, y: np.ones_like(x)),
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "elu": (_elu, lambda x, y: np.where(x > 0, 1.0, y + 1)),
    "selu": (lambda x: SCALE * np.where(x > 0, x, ALPHA * np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, SCALE, y + SCALE * ALPHA)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))), lambda x, y: y * (1 - y)),
    "softplus": (lambda x: np.logaddexp(0, x), lambda x, y: 1 / (1 + np.exp(-np.clip(x, -500, 500)))),
}


class Layer:
    def __init__(self, kind: str, activation: str = "linear", size: int = 1, weights=None, bias=None):
        if kind not in ("dense", "conv", "norm", "pool", "mean_pool", "upsample", "flatten", "reshape"):
            raise ValueError(f"no such layer: {kind}")
        self.kind, self.activation, self.size = kind, activation, size
        self.weights = None if weights is None else np.asarray(weights, float)
        self.bias = None if bias is None or not len(bias) else np.asarray(bias, float)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """A batch (rows, numbers) or (rows, samples, channels) before the activation."""
        n = len(x)
        if self.kind in ("conv", "pool", "mean_pool", "upsample") and x.ndim == 2:
            x = x[:, :, None]
        if self.kind == "dense":
            x = x.reshape(n, -1) @ self.weights
        elif self.kind == "conv":
            width, step, samples = len(self.weights), self.size, x.shape[1]
            out = -(-samples // step)
            pad = max(0, (out - 1) * step + width - samples)
            padded = np.pad(x, ((0, 0), (pad // 2, pad - pad // 2), (0, 0)))
            x = sum(padded[:, k : k + (out - 1) * step + 1 : step] @ self.weights[k] for k in range(width))
        elif self.kind == "norm":
            return x * self.weights[0] + self.weights[1]
        elif self.kind in ("pool", "mean_pool"):
            out = -(-x.shape[1] // self.size)
            pad = out * self.size - x.shape[1]
            padded = np.pad(x, ((0, 0), (pad // 2, pad - pad // 2), (0, 0)), constant_values=np.nan)
            x = (np.nanmax if self.kind == "pool" else np.nanmean)(padded.reshape(n, out, self.size, -1), axis=2)
        elif self.kind == "upsample":
            x = np.repeat(x, self.size, axis=1)
        elif self.kind == "flatten":
            x = x.reshape(n, -1)
        elif self.kind == "reshape":
            x = x.reshape(n, -1, self.size)
        return x if self.bias is None else x + self.bias


def forward(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = ACTIVATIONS[layer.activation][0](layer.apply(x))
    return x


def network_table(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    flat = lambda a: [] if a is None else a.ravel().tolist()
    rows = [(i, x.kind, x.activation, x.size, [] if x.weights is None else list(x.weights.shape), flat(x.weights), flat(x.bias)) for i, x in enumerate(layers)]
    return spark.createDataFrame(rows, SCHEMA)


def layers_of(table: DataFrame) -> list[Layer]:
    """The layers of a stored network, whose size is looked at first."""
    size = table.agg(F.sum(F.size("weights") + F.size("bias"))).first()[0] or 0
    if 8 * size > NETWORK_BYTES:
        raise ValueError(f"a network of {8 * size} bytes; {NETWORK_BYTES} is the most that is sent to all tasks")
    return [Layer(r.kind, r.activation, r["size"], np.reshape(r.weights, r["shape"]) if r.weights else None, r.bias) for r in table.orderBy("layer").collect()]


def _vectors(x: np.ndarray) -> pa.ListArray:
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(x.ravel()))


def run_network(features: DataFrame, layers: list[Layer], bottleneck: int, key: str = "obj_id") -> DataFrame:
    """(key, features, bottleneck, reconstruction); the bottleneck is what the first so many layers give. Vectors are
    of one length; a null vector is left out."""
    shared = features.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = stacked(batch.column("features")).astype(float)
                z = forward(shared.value[:bottleneck], x)
                out = forward(shared.value[bottleneck:], z)
                yield pa.record_batch([batch.column(key), batch.column("features"), _vectors(z), _vectors(out)], [key, "features", "bottleneck", "reconstruction"])

    rows = features.filter("features is not null").select(F.col(key).cast("long").alias(key), F.col("features").cast("array<double>").alias("features"))
    return rows.mapInArrow(run, f"{key} long, features array<double>, bottleneck array<double>, reconstruction array<double>")


def dense_autoencoder(width: int, hidden: list[int], activation: str = "elu", seed: int = 0) -> list[Layer]:
    """Dense layers down to the last of `hidden` and back; start weights are drawn from a seed."""
    rng, widths = np.random.default_rng(seed), [width, *hidden, *hidden[-2::-1], width]
    kinds = ["linear" if i in (len(hidden) - 1, len(widths) - 2) else activation for i in range(len(widths) - 1)]
    return [Layer("dense", k, 1, rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b)) for a, b, k in zip(widths[:-1], widths[1:], kinds)]


def flattened(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([np.r_[x.weights.ravel(), x.bias] for x in layers])


def unflattened(layers: list[Layer], values: np.ndarray) -> list[Layer]:
    out, at = [], 0
    for x in layers:
        w, b = x.weights.size, x.bias.size
        out.append(Layer(x.kind, x.activation, x.size, values[at : at + w].reshape(x.weights.shape), values[at + w : at + w + b]))
        at += w + b
    return out


def gradients(layers: list[Layer], x: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of the mean squared error of the reconstruction, and its gradient; dense layers."""
    seen, inputs = [x], []
    for layer in layers:
        inputs.append(layer.apply(seen[-1]))
        seen.append(ACTIVATIONS[layer.activation][0](inputs[-1]))
    gap = seen[-1] - x
    back, parts = 2 * gap / x.shape[1], []
    for layer, own, before, after in zip(layers[::-1], inputs[::-1], seen[-2::-1], seen[:0:-1]):
        back = back * ACTIVATIONS[layer.activation][1](own, after)
        parts.append(np.r_[(before.T @ back).ravel(), back.sum(0)])
        back = back @ layer.weights.T
    return float((gap * gap).mean(1).sum()), np.concatenate(parts[::-1])


def loss_and_gradient(features: DataFrame, layers: list[Layer]) -> tuple[float, np.ndarray]:
    """Mean loss over all rows and its gradient: a pass over the table."""
    shared, size = features.sparkSession.sparkContext.broadcast(layers), len(flattened(layers))

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x, total = stacked(batch.column("features")).astype(float), np.zeros(size + 2)
        for at in range(0, len(x), BATCH):
            loss, gradient = gradients(shared.value, x[at : at + BATCH])
            total += np.r_[loss, len(x[at : at + BATCH]), gradient]
        return total

    total = summed(features.filter("features is not null").select("features"), part, size + 2)
    n = max(total[1], 1.0)
    return float(total[0] / n), total[2:] / n


def train(features: DataFrame, layers: list[Layer], rounds: int = 40, memory: int = 8, tol: float = 1e-9) -> list[Layer]:
    """Layers after so many steps of L-BFGS, each with a search along its direction; stops when the loss no longer falls."""
    at = flattened(layers)
    loss, slope = loss_and_gradient(features, unflattened(layers, at))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, weights = slope.copy(), []
        for s, y in reversed(steps):
            weights.append((s @ way) / (y @ s))
            way -= weights[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), w in zip(steps, weights[::-1]):
            way += (w - (y @ way) / (y @ s)) * s
        length, falls = 1.0, slope @ way
        while length > 1e-6:
            new = at - length * way
            new_loss, new_slope = loss_and_gradient(features, unflattened(layers, new))
            if new_loss <= loss - 1e-4 * length * falls:
                break
            length /= 2
        else:
            break
        s, y = new - at, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = loss - new_loss < tol * max(1.0, abs(loss))
        at, loss, slope = new, new_loss, new_slope
        if done:
            break
    return unflattened(layers, at)
