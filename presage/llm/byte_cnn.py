"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. Bytes are
embedded; filters WIDTH bytes wide run over each chunk at a stride; each
filter's greatest activation is the chunk's feature. The means and maxima of
the features over a document's chunks, with the log of its length, pass through
one hidden layer into one probability.

The network is fitted on about `rows` labelled documents of at most
`sample_bytes` together, taken in the order of a hash of the id; a text that
would exceed the bytes is left out of the sample and the next ones are tried.
Scoring reads every byte of every document, with a chunk in memory at a time.

Defined results: a null text counts as empty; an empty text is scored from the
zero features; without usable labels every score is 0.5; of labels that differ
for one doc_id the least counts; of equal hashes at the sample's bounds the lesser
doc_id, and then the lesser hash of the text, is taken first; rows repeated whole count once in the sample
and score alike; rows that share a doc_id and differ in text share its label; an
empty table gives no rows; extra columns pass through, but for one of the
score's name, which the score replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import crc_mod

CHUNK, OVERLAP = 4096, 256
STEP, STEPS = 4, 3  # stride in bytes, and strides to a filter
WIDTH = STEP * STEPS
EMBED, FILTERS, HIDDEN = 8, 48, 24
#: Bounds of the labelled sample.
ROWS, SAMPLE_BYTES = 5000, 24 << 20


class Network:
    """Parameters, and scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS + 1, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }

    def chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest activation over a chunk of bytes, and where it is."""
        n = max(STEPS, -(-len(data) // STEP))
        padded = np.zeros(n * STEP, np.uint8)
        padded[: len(data)] = data
        steps = self.p["embed"][padded].reshape(n, STEP * EMBED)
        w = self.p["filters"].reshape(STEPS, STEP * EMBED, FILTERS)
        out = steps[: n - STEPS + 1] @ w[0]
        for i in range(1, STEPS):
            out += steps[i : n - STEPS + 1 + i] @ w[i]
        at = out.argmax(axis=0)
        return np.maximum(out[at, np.arange(FILTERS)] + self.p["bias"], 0), at

    @staticmethod
    def chunks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP):
            yield at, data[at : at + CHUNK]

    def features(self, data: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
        """(document features, chunks, pooled chunk features, argmax places)."""
        parts = list(self.chunks(data))
        if len(data):
            pooled, places = zip(*(self.chunk(x) for _, x in parts))
        else:
            pooled, places = (np.zeros(FILTERS, np.float32),), (np.zeros(FILTERS, np.int64),)
        pooled, places = np.array(pooled), np.array(places)
        scale = np.float32(np.log1p(len(data)) / 10)
        return np.concatenate((pooled.mean(axis=0), pooled.max(axis=0), [scale])).astype(np.float32), parts, pooled, places

    def score(self, text: str | None) -> float:
        data = np.frombuffer((text or "").encode(), np.uint8)
        mean, top, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0
        if len(data):
            for _, x in self.chunks(data):
                pooled, _ = self.chunk(x)
                mean, top, n = mean + pooled, np.maximum(top, pooled), n + 1
        f = np.concatenate((mean / max(n, 1), top, [np.log1p(len(data)) / 10])).astype(np.float32)
        h = np.maximum(f @ self.p["w1"] + self.p["b1"], 0)
        return float(1 / (1 + np.exp(-np.clip(float(h @ self.p["w2"] + self.p["b2"][0]), -30, 30))))

    def gradient(self, data: np.ndarray, label: int, weight: float = 1.0) -> tuple[dict[str, np.ndarray], float]:
        p = self.p
        f, parts, pooled, places = self.features(data)
        z = f @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        y = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30)))
        d = np.float32((y - label) * weight)
        dz = d * p["w2"] * (z > 0)
        df = p["w1"] @ dz
        g = {"w2": d * h, "b2": np.array([d]), "w1": np.outer(f, dz), "b1": dz}
        dpool = np.repeat(df[None, :FILTERS] / len(parts), len(parts), axis=0)
        dpool[pooled.argmax(axis=0), np.arange(FILTERS)] += df[FILTERS : 2 * FILTERS]
        dpool *= pooled > 0
        g["filters"], g["embed"], g["bias"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"]), dpool.sum(axis=0)
        if len(data):
            for (_, x), dp, at in zip(parts, dpool, places):
                byte = at[:, None] * STEP + np.arange(WIDTH)  # filters x bytes that they saw
                seen = np.where(byte < len(x), x[np.minimum(byte, len(x) - 1)], 0)
                flat = p["embed"][seen].reshape(FILTERS, -1)
                g["filters"] += (flat * dp[:, None]).T
                back = (p["filters"].T * dp[:, None]).reshape(-1, EMBED)
                np.add.at(g["embed"], seen.ravel(), back)
        return g, float(y)


def fit(texts: list[str], labels: list[int], epochs: int | None = None, batch: int = 16, rate: float = 4e-3, seed: int = 7) -> Network | None:
    """Adam on the log loss; None without examples. epochs None: 600 steps at least, in 8 to 40 epochs."""
    if not texts:
        return None
    epochs = epochs or max(8, min(40, 600 * batch // len(texts)))
    net, rng = Network(seed), np.random.default_rng(seed)
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    share = sum(labels) / len(labels)
    weights = (min(4.0, max(1.0, share / max(1 - share, 1e-9))), 1.0)  # the rarer label 0 counts more, up to 4 times
    step, total = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sums = {k: np.zeros_like(x) for k, x in net.p.items()}
            for i in chosen:
                for k, x in net.gradient(data[i], labels[i], weights[labels[i]])[0].items():
                    sums[k] += x
            step += 1
            now = rate * (1 - 0.95 * step / total)
            for k, x in sums.items():
                x /= len(chosen)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    _settle(net, data, np.array(labels), np.array(weights))
    return net


def _settle(net: Network, data: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, penalty: float = 0.02) -> None:
    """Brings the last layer to its optimum on the learned features, by Newton steps on the penalised weighted log loss."""
    f = np.array([net.features(x)[0] for x in data])
    h = np.maximum(f @ net.p["w1"] + net.p["b1"], 0).astype(np.float64)
    scale = h.std(axis=0) + 1e-6
    x = np.column_stack((h / scale, np.ones(len(h))))
    w, ridge, beta = weights[labels], np.eye(x.shape[1]) * penalty * np.sqrt(len(x)), np.zeros(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        y = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - labels)) + ridge @ beta
        curve = (x * (w * y * (1 - y))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    net.p["w2"], net.p["b2"] = (beta[:-1] / scale).astype(np.float32), beta[-1:].astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most `rows` labels' documents and `sample_bytes`, by hash of the id."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    chosen = known.select("*", order.alias("rank")).orderBy("rank", "doc_id").limit(rows)
    # At most `rows` short rows: bounded by the parameter, so they are broadcast.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    sizes = found.where(F.col("n") <= sample_bytes).select("rank", "doc_id", "key", "n").distinct().orderBy("rank", "doc_id", "key").limit(2 * rows).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["n"] <= sample_bytes:
            total += r["n"]
            taken.append((r["doc_id"], r["key"]))
    if not taken:
        return [], []
    wanted = spark.createDataFrame(taken, found.select("doc_id", "key").schema)
    got = found.join(F.broadcast(wanted), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("rank", "doc_id", "key", "text", "quality").collect()
    got.sort(key=lambda r: (r["rank"], r["doc_id"], r["key"]))
    return [r["text"] for r in got], [r["quality"] for r in got]


def classify(docs: DataFrame, net: Network | None, out: str = "score") -> DataFrame:
    """docs with the score in column `out`, which replaces one of that name."""
    from pyspark.sql.types import DoubleType, StructType

    docs = docs.drop(out)
    shared, names = docs.sparkSession.sparkContext.broadcast(net), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = names.index("text")
        for b in batches:
            scores = [model.score(t.as_py()) if model else 0.5 for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def quality(docs: DataFrame, labels: DataFrame, held_out: int | None = 5, rows: int = ROWS, out: str = "score") -> DataFrame:
    """docs with the score in column `out`, fitted on labelled rows whose crc32(doc_id) mod held_out is not 0 (None: all)."""
    known = labels if held_out is None else labels.where(crc_mod("doc_id", held_out) != 0)
    texts, marks = sample(docs, known, rows)
    return classify(docs, fit(texts, marks), out)
