"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

1. Random indexing: every token has a sparse random index vector made from its hash. Over all documents each token's
   context vector gathers the index vectors of its neighbours. Tokens share 2**13 rows by hash, so what tasks add up
   is a table of fixed size, whatever the corpus holds.
2. A document is the mean of its tokens' vectors, with the share of some token classes and its length.
3. A two-layer network (numpy) learns ``quality`` from a bounded sample of the labelled rows that are not held out,
   and a temperature fitted on a part it has not seen calibrates its probabilities.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are never read. Labels, lang, source and
doc_id are never inputs of a score. Tokens are runs of letters and digits or of other signs; a word in capitals and a
word said again count as tokens of their own kind.

Nulls: a null text is empty; empty texts get a score as well. A null doc_id is never held out and has no label. A
null quality is no label. Rows that repeat an id are scored one by one. Without any label of both classes every score
is the share of label 1 (0.5 without labels). Empty tables give empty results. Extra columns are ignored by
``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prefix_hash, text_slices

ROWS_BITS = 13
ROWS = 1 << ROWS_BITS
DIMS = 64
NONZERO = 4
FEW = 3  # a mean over few tokens is drawn to zero, as if so many tokens that say nothing stood beside them
BLOCKS = 32
#: At most so many labelled rows are used for fitting (a sample by hash of the id).
MAX_LABELLED = 20_000
HIDDEN = 24
EPOCHS = 30
SEED = 7

_CLASS = np.full(256, 2, np.uint8)  # 0 blank, 1 letter or digit, 2 other sign
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[97:123] = 1
CAPITALS, AGAIN = np.uint64(0x1111111111111111), np.uint64(0x2222222222222222)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(columns, signs) of each row's sparse index vector."""
    h = np.stack([mix64(np.arange(ROWS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1)) for k in range(NONZERO)], 1)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number of each token, first token of each text, kind of each token: 0 word, 1 sign, 2 capitals, 3 again)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, np.zeros(len(offs), np.int64), z
    c = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    change = np.ones(len(data), bool)
    change[1:] = c[1:] != c[:-1]
    starts = np.flatnonzero((c > 0) & (change | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = c[1:] != c[:-1]
    ends = np.flatnonzero((c > 0) & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offs)
    acc, inv = prefix_hash(data)
    h = mix64((acc[ends] - acc[starts]) * inv[starts])
    kind = (c[starts] == 2).astype(np.int64)
    up, low = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_LOWER[data])])
    caps = (up[ends] - up[starts] >= 1) & (low[ends] == low[starts]) & (ends - starts >= 3)
    word = np.flatnonzero(kind == 0)
    again = np.zeros(len(h), bool)
    if len(word) > 1:
        text = np.searchsorted(first, word, side="right")  # a word is said again only inside its own text
        again[word[1:]] = (h[word[1:]] == h[word[:-1]]) & (text[1:] == text[:-1])
    kind[caps] = 2
    kind[again] = 3
    h = np.where(again, AGAIN, np.where(caps, CAPITALS, h))
    return (mix64(h) >> np.uint64(64 - ROWS_BITS)).astype(np.int64), first, kind


def _contexts(batches):
    columns, signs = index_vectors()
    total = np.zeros(ROWS * DIMS, np.float64)
    count = np.zeros(ROWS, np.int64)
    for _, data, offs in text_slices(batches, "doc_id", "text"):
        t, first, _ = tokens_of(data, offs)
        if not len(t):
            continue
        count += np.bincount(t, minlength=ROWS)
        pair = np.ones(len(t), bool)
        pair[first[:-1][first[:-1] < len(t)]] = False  # no neighbour across texts
        right = np.flatnonzero(pair)
        for a, b in ((t[right], t[right - 1]), (t[right - 1], t[right])):
            for k in range(NONZERO):
                total += np.bincount(a * DIMS + columns[b, k], weights=signs[b, k], minlength=ROWS * DIMS)
    vectors = total.astype(np.int64).reshape(BLOCKS, -1)
    counts = count.reshape(BLOCKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([v.astype("<i4").tobytes() for v in vectors], pa.binary()), pa.array([x.astype("<i8").tobytes() for x in counts], pa.binary())], ["block", "vectors", "counts"])


def _add(key, table):
    v = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in table.column("vectors").to_pylist())
    c = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"block": [key[0].as_py()], "vectors": [v.astype("<i8").tobytes()], "counts": [c.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("vectors", pa.binary()), ("counts", pa.binary())]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """ROWS x DIMS context vectors of the whole corpus: BLOCKS rows of fixed size reach the driver."""
    kind = "block int, vectors binary, counts binary"
    rows = {r["block"]: r for r in docs.select("doc_id", "text").mapInArrow(_contexts, kind).groupBy("block").applyInArrow(_add, kind).collect()}
    v = np.zeros((ROWS, DIMS))
    n = np.zeros(ROWS)
    per = ROWS // BLOCKS
    for b, r in rows.items():
        v[b * per : (b + 1) * per] = np.frombuffer(r["vectors"], "<i8").reshape(per, DIMS)
        n[b * per : (b + 1) * per] = np.frombuffer(r["counts"], "<i8")
    # the expected context of any token is taken off, so what is left tells tokens apart
    mean = v.sum(0) / max(1.0, n.sum())
    v = v / np.maximum(n, 1)[:, None] - mean
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    t, first, kind = tokens_of(data, offs)
    n = np.diff(first)
    out = np.zeros((len(n), DIMS + 6), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        for a in range(0, len(some), 256):  # a few texts at a time, so the gathered vectors stay small
            part = some[a : a + 256]
            lo, hi = first[part[0]], first[part[-1] + 1]
            out[part, :DIMS] = np.add.reduceat(vectors[t[lo:hi]], first[part] - lo, axis=0) / (n[part, None] + FEW)
        for k in range(4):
            out[some, DIMS + k] = np.add.reduceat((kind == k).astype(np.float32), first[some]) / (n[some] + FEW)
    size = np.diff(offs)
    out[:, DIMS + 4] = np.log1p(n) / 10
    out[:, DIMS + 5] = size / np.maximum(n, 1) / 10
    return out


@dataclass
class Network:
    """Two layers, standardised inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Before the temperature."""
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train with Adam on four fifths, fit the temperature on the rest."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    used = order[len(y) // 5 :]
    if y[used].min() == y[used].max():
        used = order
    m, s = x[used].mean(0), x[used].std(0) + 1e-3
    net = Network(m, s, rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), float(np.log(y[used].mean() / (1 - y[used].mean()))))
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m1, m2, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - m) / s
    rounds = max(EPOCHS, 2000 // max(1, len(used) // 64))
    for e in range(min(rounds, 400)):
        rate = 0.01 * (0.5 * (1 + np.cos(np.pi * e / min(rounds, 400)))) + 1e-4
        for a in range(0, len(used), 64):
            b = used[(a + 64 * e + np.arange(min(64, len(used)))) % len(used)]
            h = np.tanh(z[b] @ p[0] + p[1])
            o = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60)))
            g = (o - y[b]) / len(b)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[b].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            step += 1
            for k in range(4):
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        logit = net.logits(x[held])
        loss = lambda t: float(np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t))
        net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MAX_LABELLED) -> Network:
    """Fit on at most ``most`` labelled rows, chosen by hash of the id among those not held out."""
    gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    gold = gold.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches):
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "text"])
            done = 0
            for ids, data, offs in text_slices(iter([texts]), "doc_id", "text"):
                x = pool(data, offs, vectors).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(ids)), b.column(2).slice(done, len(ids)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])
                done += len(ids)

    rows = docs.join(F.broadcast(gold), "doc_id").select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, x binary")
    # repeated ids could give more rows than labels; the bound on what reaches the driver holds all the same
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).collect()
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in got]) if got else np.zeros((0, DIMS + 6), np.float32)
    return fit(x, np.array([r["quality"] for r in got], np.float64))


def _model(docs: DataFrame, labels: DataFrame):
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = word_vectors(base)
    return vectors, train(base, labels, vectors)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    vectors, net = _model(docs, labels)

    def run(batches):
        for ids, data, offs in text_slices(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(net.predict(pool(data, offs, vectors)), pa.float64())], ["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``threshold``."""
    vectors, net = _model(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            keep = []
            texts = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at)], ["doc_id", "text"])
            for _, data, offs in text_slices(iter([texts]), "doc_id", "text"):
                keep += (net.predict(pool(data, offs, vectors)) >= threshold).tolist()
            if any(keep):
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
