"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets features of its own (shares of symbols, bars, capitals, digits, repeated words, its length and
ending) and of its neighbours. A two-state chain (good, bad) is fitted to labelled documents, whose lines all take the
document's label; the mean of the forward-backward marginals of a document's lines, weighted by their length, is its
quality, which a logistic curve fitted to the same documents turns into the probability of the label, the score.

Fitting takes at most ``TRAIN_DOCS`` labelled documents of up to ``TRAIN_BYTES`` (smallest hash of the id first): their
features, computed by the executors, come to the driver, where the likelihood is maximised in full batches. The weights,
some 30 numbers, go with the scoring function, which runs on whole texts, row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read
from quire.llm.wordhash import _BLANK, pieces, words

#: Bounds of the fit: labelled documents, bytes of one of them, steps, and the weight of the squared parameters.
TRAIN_DOCS, TRAIN_BYTES, STEPS, RIDGE = 3000, 100_000, 150, 1e-4

_SETS = [b"#*$%&<>~^=_{}[]\\@+", b"|", b"!", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b",;:?()\"'"]
_CLASS = np.full(256, len(_SETS), dtype=np.uint8)
for _k, _s in enumerate(_SETS):
    _CLASS[list(_s)] = _k
_ENDING = np.zeros(256, dtype=bool)
_ENDING[list(b".!?:;\"')")] = True
OWN = 12  # features of a line itself


class Model(NamedTuple):
    """Weights of the chain, the curve from quality to score, and the score of texts without a word."""

    weights: np.ndarray
    slope: float
    offset: float
    empty: float


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word: the number of the text, the length in bytes, and the features with the neighbours'."""
    docs, sizes, rows = [np.empty(0, np.int64)], [np.empty(0)], [np.empty((0, OWN))]
    for buffer, edges, numbers in pieces(texts, b"\n"):
        breaks = np.flatnonzero(buffer == 10) + 1
        starts = np.unique(np.concatenate([edges[:-1], breaks[breaks < len(buffer)]]))
        ends = np.append(starts[1:], len(buffer))
        begin, end, h = words(buffer, starts)
        line = np.searchsorted(starts, begin, side="right") - 1
        n_words = np.bincount(line, minlength=len(starts))
        kept = np.flatnonzero(n_words)
        if not len(kept):
            continue
        size = (ends - starts).astype(np.float64)
        counts = np.bincount(np.repeat(np.arange(len(starts)), ends - starts) * (len(_SETS) + 1) + _CLASS[buffer],
                             minlength=len(starts) * (len(_SETS) + 1)).reshape(len(starts), -1).astype(np.float64)
        solid = np.bincount(line, weights=end - begin, minlength=len(starts))
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        repeats = np.bincount(line[same], minlength=len(starts))
        tail = np.zeros(len(starts), dtype=np.int64)
        tail[line] = end - 1  # the last word's last byte: words come in order
        w, s = np.maximum(n_words, 1), np.maximum(solid, 1)
        letters = np.maximum(counts[:, 3] + counts[:, 4], 1)
        f = np.stack([np.ones(len(starts)), np.minimum(counts[:, 0] / s * 4, 2), np.minimum(counts[:, 1] / w * 2, 2),
                      np.minimum(counts[:, 2] / w, 2), counts[:, 3] / letters, counts[:, 5] / s, counts[:, 6] / w,
                      repeats / w, _ENDING[buffer[tail]], np.log1p(solid) / 8, np.minimum(solid / w / 12, 2),
                      n_words == 1], axis=1)
        docs.append(numbers[np.searchsorted(edges, starts[kept], side="right") - 1])
        sizes.append(size[kept])
        rows.append(f[kept])
    doc, size, own = np.concatenate(docs), np.concatenate(sizes), np.concatenate(rows)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(doc) > 1:
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * joined, own[1:] * joined
    return doc, size, np.concatenate([own, before, after], axis=1)


def chains(doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows by their place in the document: the order of documents by falling length, and the rows of each place."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(doc)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    longer = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # chains longer than t
    return order, [start[:n] + t for t, n in enumerate(longer)]


def forward_backward(emit: np.ndarray, trans: np.ndarray, steps: list[np.ndarray]):
    """Log forward and backward sums of all chains side by side; ``emit``: (lines, 2) log factors, ``trans``: (2, 2)."""
    a, b = emit.copy(), np.zeros_like(emit)
    for before, now in zip(steps, steps[1:]):
        p = a[before[: len(now)]]
        a[now] += np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    for now, after in zip(steps[-2::-1], steps[:0:-1]):
        q = emit[after] + b[after]
        b[now[: len(after)]] = np.logaddexp(q[:, :1] + trans[:, 0], q[:, 1:] + trans[:, 1])
    return a, b


def marginals(x: np.ndarray, doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability that a line is good, for all lines of all documents."""
    if not len(x):
        return np.empty(0)
    n = x.shape[1]
    emit = np.stack([np.zeros(len(x)), x @ weights[:n]], axis=1)
    a, b = forward_backward(emit, weights[n:].reshape(2, 2), chains(doc)[1])
    both = a + b
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


def fit(x: np.ndarray, doc: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights (features, then the four transitions) that maximise the mean log-likelihood of the lines' labels.

    ``good``: 0 or 1 per line. Adam steps over all lines, so equal input gives equal weights."""
    n = x.shape[1]
    w = np.zeros(n + 4)
    if not len(x):
        return w
    steps = chains(doc)[1]
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair_of = good[inner] * 2 + good[inner + 1]
    seen = np.concatenate([x.T @ good, np.bincount(pair_of, minlength=4)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        emit = np.stack([np.zeros(len(x)), x @ w[:n]], axis=1)
        trans = w[n:].reshape(2, 2)
        a, b = forward_backward(emit, trans, steps)
        both = a + b
        total = np.logaddexp(both[:, 0], both[:, 1])
        expected = x.T @ np.exp(both[:, 1] - total)
        q = emit[inner + 1] + b[inner + 1]
        pairs = np.exp(a[inner][:, :, None] + trans[None] + q[:, None, :] - total[inner][:, None, None]).sum(axis=0)
        g = (seen - np.concatenate([expected, pairs.ravel()])) / len(x) - RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def qualities(x: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Length-weighted mean probability of the lines' being good, per document; nan without lines."""
    total = np.bincount(doc, weights=size, minlength=n)
    got = np.bincount(doc, weights=size * marginals(x, doc, weights), minlength=n)
    return np.where(total > 0, got / np.maximum(total, 1e-9), np.nan)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def calibrate(q: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of the logistic curve from the logit of a quality to the label's probability."""
    n = good.sum()
    target = np.where(good == 1, (n + 1) / (n + 2), 1 / (len(good) - n + 2))  # keeps separable labels finite
    z = np.stack([_logit(q), np.ones(len(q))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _logistic(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, z.T @ (target - p) - 1e-3 * (w - [1, 0])), -1, 1)
    return max(float(w[0]), 0.0), float(w[1])


def scores(texts: Iterable[bytes], model: Model, together: int = 4 << 20) -> np.ndarray:
    """The score of each text, some megabytes of text at a time."""
    out, held, size = [np.empty(0)], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > together:
            out.append(_scores(held, model))
            held, size = [], 0
    return np.concatenate([*out, _scores(held, model)])


def _scores(texts: list[bytes], model: Model) -> np.ndarray:
    doc, size, x = line_features(texts)
    q = qualities(x, doc, size, len(texts), model.weights)
    return np.where(np.isnan(q), model.empty, _logistic(model.slope * _logit(np.nan_to_num(q, nan=0.5)) + model.offset))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    """The model; texts without a word score the share of good labels (0.5 without labels).

    ``labels``: key and a 0/1 label; other labels, and rows with nulls, are left out; a key labelled in several ways takes
    the smallest. Labels without a document count for the share alone. No labelled text: weights of 0, scores of 0.5."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.min(label).cast("int").alias("good"))
    rows = rows.orderBy(F.xxhash64("key"), "key").limit(max_docs)  # each task keeps at most max_docs rows
    share = rows.agg(F.avg("good")).first()[0]
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") <= max_bytes).join(
        F.broadcast(rows), "key").select("good", "text")

    def features(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            doc, size, x = line_features(texts)
            x = np.concatenate([x, size[:, None]], axis=1)
            lines = [x[a:b].astype(np.float32).tobytes() for a, b in zip(
                np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(len(texts)), side="right"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.binary())], ["good", "x"])

    got = [r for r in some.mapInArrow(features, "good int, x binary").collect() if len(r["x"])]
    if not got:
        return Model(np.zeros(3 * OWN + 4), 1.0, 0.0, 0.5 if share is None else float(share))
    got.sort(key=lambda r: (r["good"], bytes(r["x"])))  # the order of arrival must not matter
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, 3 * OWN + 1).astype(np.float64) for r in got]
    doc = np.repeat(np.arange(len(x)), [len(f) for f in x])
    good = np.array([r["good"] for r in got])
    x = np.concatenate(x)
    x, size = x[:, :-1], x[:, -1]
    weights = fit(x, doc, good[doc])
    return Model(weights, *calibrate(qualities(x, doc, size, len(good), weights), good), float(share))


def quality_score(text: Column, model: Model) -> Column:
    """The score (0 to 1) of a whole text; null and empty texts, and such without a word, get the share of good labels."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(((t.as_py() or "").encode() for t in texts), model))

    return score(text)


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model for ``docs`` from the ``labels`` that aren't held out."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    return train(docs, labels.where(~held_out("doc_id")))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = docs.withColumn("score", quality_score(F.col("text"), fitted(spark, docs, sf_dir))).drop("text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
