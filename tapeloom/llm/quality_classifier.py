"""Quality classifier: gated attention over all passages of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, table
from tapeloom.llm.labels import held_out, training_texts

#: Labelled rows to learn from, at most; all passages of each (see also ``labels.MAX_TRAIN_BYTES``).
MAX_TRAIN_ROWS = 4_000

#: Bytes of UTF-8 in a passage.
PASSAGE_BYTES = 1024

#: Bytes of text that are encoded at a time: bounds the memory of one very long text.
BLOCK_BYTES = PASSAGE_BYTES * 1024

THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte -> one of 12 classes."""
    table_ = np.full(256, 11, np.int64)
    table_[0x80:] = 0  # parts of letters beyond ASCII
    for chars, c in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), ("\n", 5), (".,;:'\"-()", 6), ("!?", 7), ("*#", 8), ("$%&@^~", 9), ("|<>/\\=+_[]{}", 10)):
        table_[list(chars.encode())] = c
    return table_


CLASSES = _classes()
N_CLASSES = 12
N_FEATURES = N_CLASSES * N_CLASSES + 2


def encode(text: str) -> np.ndarray:
    """(passages, features) of a whole text: rates of neighbouring byte classes and of repeated words."""
    data = text.encode()
    blocks = [_encode_block(np.frombuffer(data, np.uint8, min(BLOCK_BYTES, len(data) - at), at)) for at in range(0, len(data), BLOCK_BYTES)]
    return np.concatenate(blocks) if blocks else np.zeros((1, N_FEATURES), np.float32)


def _encode_block(b: np.ndarray) -> np.ndarray:
    n = -(-len(b) // PASSAGE_BYTES)
    kind = CLASSES[b]
    passage = np.arange(len(b)) // PASSAGE_BYTES
    pair = kind[:-1] * N_CLASSES + kind[1:]
    counts = np.bincount(passage[:-1] * (N_CLASSES * N_CLASSES) + pair, minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1)
    out = np.empty((n, N_FEATURES), np.float32)
    size = np.bincount(passage, minlength=n)[:, None]
    out[:, :-2] = np.sqrt(counts / np.maximum(size, 1))
    # words by a hash of their first bytes: how many of a passage's are new, how many repeat the last
    gap = (kind == 4) | (kind == 5)
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    padded = np.concatenate([b, np.full(12, 32, np.uint8)])
    word = np.zeros(len(first), np.uint64)
    alive = np.ones(len(first), bool)
    for k in range(12):
        c = padded[first + k]
        alive &= CLASSES[c] // 2 != 2
        word = word * np.uint64(1099511628211) + np.where(alive, c, 0).astype(np.uint64)
    at = passage[first] if len(first) else np.zeros(0, np.int64)
    words = np.maximum(np.bincount(at, minlength=n), 1)
    order = np.lexsort((word, at))
    same = (word[order][1:] == word[order][:-1]) & (at[order][1:] == at[order][:-1])
    out[:, -2] = np.bincount(at[order][1:][same], minlength=n) / words
    echo = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    out[:, -1] = np.bincount(at[1:][echo], minlength=n) / words
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """Bag of passages -> weight of each by a gated attention -> score of their weighted mean."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict

    @classmethod
    def start(cls, rows: np.ndarray, hidden: int = 16, gates: int = 8, seed: int = 5) -> GatedAttention:
        g = np.random.default_rng(seed)
        init = lambda *s: g.normal(0, s[0] ** -0.5, s)
        p = {"w": init(N_FEATURES, hidden), "b": np.zeros(hidden), "v": init(hidden, gates), "u": init(hidden, gates), "a": init(gates), "c": init(hidden), "d": np.zeros(1)}
        return cls(rows.mean(0), rows.std(0) + 1e-2, p)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Scores of bags whose passages begin at ``starts`` in x, with what the gradient needs."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["d"]), (x, h, t, s, att, z, sizes)

    def gradient(self, x, starts, y, weight):
        p = self.p
        score, (x, h, t, s, att, z, sizes) = self.forward(x, starts)
        dl = weight * (score - y) / len(y)
        dz = dl[:, None] * p["c"]
        dzr = np.repeat(dz, sizes, axis=0)
        dh = att[:, None] * dzr
        datt = (dzr * h).sum(1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
        dg = de[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh += dt @ p["v"].T + ds @ p["u"].T
        da = dh * (1 - h * h)
        return {"w": x.T @ da, "b": da.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = 800, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> GatedAttention:
    """Adam on the logistic loss, both labels weighing the same."""
    model = GatedAttention.start(np.concatenate(bags), seed=seed)
    g = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        pick = g.integers(0, len(bags), min(batch, len(bags)))
        x = np.concatenate([bags[i] for i in pick])
        starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
        for k, d in model.gradient(x, starts, y[pick], weight[pick]).items():
            d = d + decay * model.p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_bags(texts: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """All encoded passages of the training texts, made on the executors.

    A passage of 1,024 bytes becomes 584 bytes, so the bound on the texts'
    bytes bounds what the driver gets.
    """
    def scan(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                x = encode(text or "")
                rows.append(x.astype(np.float32).tobytes())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])

    found = texts.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(scan, "doc_id long, label int, bag binary")
    got = sorted((r.doc_id, r.label, bytes(r.bag)) for r in found.collect())
    return [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, _, b in got], np.array([y for _, y, _ in got], float)


def train(docs: DataFrame, labels: DataFrame) -> GatedAttention | None:
    bags, y = training_bags(training_texts(docs, labels, "quality", MAX_TRAIN_ROWS))
    return fit(bags, y) if len(set(y)) > 1 else None


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row of ``docs``.

    Every passage of a text takes part in its score. A null or empty text is
    one passage without features. Repeated rows get equal scores, an empty
    table gives no rows. Without labelled rows of both kinds all scores are 0.5.
    """
    model = train(docs, labels)
    def scan(batches):
        import pyarrow as pa

        for b in slices(batches):
            scores, n = [], []
            for t in b.column(1):
                x = encode(t.as_py() or "")
                n.append(len(x))
                scores.append(float(model.forward(x, np.array([0]))[0][0]) if model else 0.5)
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, score double, n_passages long")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
