"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (ASCII letters lower-cased, ASCII punctuation separates) and their first 3 to 6
bytes; each counts once a text and is hashed to 2**BITS slots. A linear weight for each slot misses what only pairs
say, such as an insult beside a mention of a group; the machine adds an inner product of learned factors for each pair
of terms, summed in time linear in the terms. It is fitted with AdaGrad on at most FIT_ROWS labelled rows (those of
smallest hash of doc_id), a bounded sample; every text is scored whole.

Cases: null or empty texts have no terms and get the score of the bias alone; rows without a label are not learned
from; a null doc_id is scored (held out, as its remainder is unknown); no labelled rows at all give the score 0. Rows
that repeat a doc_id are each scored, and the least of their texts is learned from, once; of its labels the largest
counts. Other columns stay, but one named as the score is replaced.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_VALUES, Words, slices, span_hash

BITS, FACTORS, PREFIXES = 18, 4, (3, 4, 5, 6)
#: Labelled rows that the machine is fitted on, at most.
FIT_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 64, 0.1, 2e-4, 7
#: A slot takes part if so many fitted texts have it and its presence depends on the label (chi-squared statistic):
#: else the many rare terms of a text learn single labels by heart.
LEAST_TEXTS, LEAST_CHI2 = 4, 12.0
#: A word's slot takes part too if its product with another one's tells, by so many deviations, what a machine of the
#: slots above leaves of the labels; words of so large a share of the texts are paired, no prefixes.
PAIR_SHARE, LEAST_DEVIATIONS = 0.02, 10.0
#: Texts that are scored, and texts and words on either side that are paired, at once: arrays of a task are of this size.
PAIR_ROWS, PAIR_WORDS = 500, 2048
SEPARATORS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def terms(column: pa.Array, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text, one after another, and their len + 1 offsets."""
    words = Words(column, lower=True, separators=SEPARATORS)
    values = BYTE_VALUES[words.data]
    _, pick, which = np.unique(span_hash(values, words.start, words.end), return_index=True, return_inverse=True)
    start, end = words.start[pick], words.end[pick]
    mask = np.uint64((1 << BITS) - 1)
    slots = [span_hash(values, start, end) & mask]
    for n in prefixes:
        slots.append(np.where(end - start >= n, span_hash(values, start, np.minimum(start + n, end)) & mask ^ np.uint64(n), slots[0]))
    once = np.unique((words.row.astype(np.uint64) << np.uint64(32)) | which.astype(np.uint64))
    rows, kinds = once >> np.uint64(32), (once & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pairs = np.unique(np.concatenate([(rows << np.uint64(BITS)) | s[kinds] for s in slots])) if len(once) else once
    return (pairs & mask).astype(np.int64), np.searchsorted(pairs >> np.uint64(BITS), np.arange(len(words.counts) + 1).astype(np.uint64))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def logits(model: dict, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(offsets) - 1, PAIR_ROWS):
        own = offsets[a : a + PAIR_ROWS + 1]
        x, at = slots[own[0] : own[-1]], own - own[0]
        v = model["factors"][x]
        out.append(model["bias"] + sums(model["weights"][x], at) + 0.5 * (sums(v, at) ** 2 - sums(v * v, at)).sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def telling_pairs(slots: np.ndarray, offsets: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Slots that tell in a pair: what a machine leaves of the labels goes along with the product of two presences, by
    LEAST_DEVIATIONS of what it would by chance."""
    n = len(rest)
    share = np.bincount(slots, minlength=1 << BITS) / max(n, 1)
    some = np.flatnonzero((share >= PAIR_SHARE) & (share <= 1 - PAIR_SHARE))
    if not len(some):
        return some
    place = np.full(1 << BITS, -1)
    place[some] = np.arange(len(some))
    left, mean, tells = (rest - rest.mean()).astype(np.float32), share[some].astype(np.float32), np.zeros(len(some), bool)

    def present(a: int, k: int) -> np.ndarray:
        """Presences of the words from the k-th on in the texts from the a-th on, less their means."""
        b = min(n, a + PAIR_ROWS)
        row, column = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), place[slots[offsets[a] : offsets[b]]] - k
        x = np.zeros((b - a, min(PAIR_WORDS, len(some) - k)), np.float32)
        inside = (column >= 0) & (column < x.shape[1])
        x[row[inside], column[inside]] = 1
        return x - mean[k : k + x.shape[1]]

    for i in range(0, len(some), PAIR_WORDS):
        for j in range(i, len(some), PAIR_WORDS):
            along = chance = np.float32(0)
            for a in range(0, n, PAIR_ROWS):
                x, y = present(a, i), present(a, j) * left[a : a + PAIR_ROWS, None]
                along = along + x.T @ y
                chance = chance + (x * x).T @ (y * y)
            beyond = np.abs(along) > LEAST_DEVIATIONS * np.sqrt(chance)
            if i == j:
                np.fill_diagonal(beyond, False)
            tells[i : i + PAIR_WORDS] |= beyond.any(1)
            tells[j : j + PAIR_WORDS] |= beyond.any(0)
    return some[tells]


def fit(slots: np.ndarray, offsets: np.ndarray, labels: np.ndarray, pairs: np.ndarray | tuple = ()) -> dict:
    size = 1 << BITS
    n, n1 = len(labels), labels.sum()
    texts = np.bincount(slots, minlength=size)
    toxic = np.bincount(slots, np.repeat(labels, np.diff(offsets)), size)
    spread = np.maximum(texts * (n - texts) * n1 * (n - n1), 1.0)
    used = (texts >= LEAST_TEXTS) & (n * (n * toxic - texts * n1) ** 2 >= LEAST_CHI2 * spread)
    paired = used.copy()
    pairs = np.asarray(pairs, np.int64)
    paired[pairs] = True
    start, rate = np.full(size, 0.01), np.full(size, 0.2 * RATE)
    start[pairs], rate[pairs] = 0.1, RATE
    rng = np.random.default_rng(SEED)
    share = np.clip(labels.mean() if len(labels) else 0, 1e-3, 1 - 1e-3)
    model = {"bias": float(np.log(share / (1 - share))), "weights": np.zeros(size, np.float32), "factors": (rng.normal(0, 1, (size, FACTORS)) * (start * paired)[:, None]).astype(np.float32)}
    w, v = model["weights"], model["factors"]
    gw, gv, gb = np.full(size, 1e-3), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            parts = [slots[offsets[r] : offsets[r + 1]] for r in rows]
            x = np.concatenate(parts)
            row = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
            keep = paired[x]
            x, row = x[keep], row[keep]
            off = np.searchsorted(row, np.arange(len(rows) + 1))
            vx = v[x]
            s = sums(vx, off)
            z = model["bias"] + sums(w[x], off) + 0.5 * (s**2 - sums(vx * vx, off)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            slot, where = np.unique(x, return_inverse=True)
            dw = np.bincount(where, g[row], len(slot)) + DECAY * w[slot]
            gv_rows = g[row][:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(where, gv_rows[:, k], len(slot)) for k in range(FACTORS)], 1) + DECAY * v[slot]
            gw[slot] += dw * dw
            gv[slot] += dv * dv
            w[slot] -= (RATE * dw / np.sqrt(gw[slot])).astype(np.float32)
            v[slot] -= (rate[slot][:, None] * dv / np.sqrt(gv[slot])).astype(np.float32)
            gb += g.sum() ** 2
            model["bias"] -= float(RATE * 0.2 * g.sum() / np.sqrt(gb))
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _terms_of(text: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    parts = [terms(text.slice(a, b - a), prefixes) for a, b in slices(text)]
    sizes = np.concatenate([np.diff(o) for _, o in parts])
    return np.concatenate([s for s, _ in parts]), np.r_[0, np.cumsum(sizes)]


def _fit_rows(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
    text, labels = table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(float)
    slots, offsets = _terms_of(text, PREFIXES)
    model = fit(slots, offsets, labels)
    pairs = telling_pairs(*_terms_of(text, ()), labels - 1 / (1 + np.exp(-np.clip(logits(model, slots, offsets), -30, 30))))
    model = fit(slots, offsets, labels, pairs) if len(pairs) else model
    used = np.flatnonzero((model["weights"] != 0) | (model["factors"] != 0).any(1))
    packed = b"".join((np.float64(model["bias"]).tobytes(), used.astype("<i4").tobytes(), model["weights"][used].tobytes(), model["factors"][used].tobytes()))
    return pa.table({"model": pa.array([zlib.compress(packed, 1)], pa.binary()), "used": pa.array([len(used)], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """The machine, fitted in one task on a bounded sample; its size is bounded by 2**BITS slots."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    ids = marked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    once = marked.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(once), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic"))
    got = rows.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_fit_rows, "model binary, used long").collect()
    if not got:
        return None
    raw, n = zlib.decompress(got[0].model), got[0].used
    used, weights, factors = np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<f4", n, 8 + 4 * n), np.frombuffer(raw, "<f4", n * FACTORS, 8 + 8 * n)
    model = {"bias": float(np.frombuffer(raw, "<f8", 1)[0]), "weights": np.zeros(1 << BITS, np.float32), "factors": np.zeros((1 << BITS, FACTORS), np.float32)}
    model["weights"][used], model["factors"][used] = weights, factors.reshape(n, FACTORS)
    return model


def score(docs: DataFrame, model: dict | None, column: str = "toxicity_score") -> DataFrame:
    """All columns of docs and the score, from 0 to 1; the machine is broadcast (5 MB at most)."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def machine(text: pa.Array) -> pa.Array:
        out = []
        for a, b in slices(text):
            out.append(1 / (1 + np.exp(-np.clip(logits(shared.value, *terms(text.slice(a, b - a))), -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(column, machine(F.col("text")))
