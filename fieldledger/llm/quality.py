"""A byte-level convolutional network in numpy that gives each document one probability of good quality.

Every byte has a learned vector. Filters of ``WIDTH`` bytes slide over the whole document in steps of ``STEP``;
their positive part is max-pooled over chunks of ``CHUNK`` bytes that overlap by half. A document is the mean,
the largest and the smallest value of each filter over its chunks, combined by one logistic unit. The same text
is cut the same way whatever stands beside it; the end of a document is padded with zero bytes.

Training (on the driver) takes at most ``SAMPLE`` labelled documents of each class of at most ``SAMPLE_CHARS``
characters, chosen by a hash of the doc_id; scoring runs in Arrow batches over all documents and whole texts.

Cases: a null text is an empty one and is scored (all padding); labels that are null or belong to no document do
not count; documents whose doc_id is null have no label; with labels of one class only, or none, the score is the
share of good labels, (good + 1) / (all + 2); other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import lean, record_batch, slices, text_buffers

VECTOR, WIDTH, STEP, FILTERS, CHUNK = 6, 8, 2, 32, 128
HALF = CHUNK // 2
SAMPLE, SAMPLE_CHARS = 1500, 8192
# Rounds over the sample, and steps at least, so that few documents are gone over more often.
ROUNDS, LEAST_STEPS, DOCUMENTS_A_STEP, RATE, SEED = 8, 250, 32, 0.01, 7
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Network:
    """``vectors`` 256 x VECTOR, ``filters`` (WIDTH * VECTOR) x FILTERS, ``weights`` of the pooled values.

    Without filters it is the constant ``prior``."""

    vectors: np.ndarray | None = None
    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0
    prior: float = 0.5


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids that no label is learned from."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(FOLDS))
    return F.coalesce(fold == 0, F.lit(False))


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each on a multiple of HALF bytes and two halves long at least, and the first half
    of each text (one more at the end). A half of zeros follows each, so that no filter reaches the next text."""
    lengths = np.diff(offsets)
    halves = np.maximum(2, -(-lengths // HALF)) + 1
    firsts = np.concatenate(([0], np.cumsum(halves)))
    out = np.zeros(int(firsts[-1]) * HALF + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(firsts[:-1] * HALF - offsets[:-1], lengths)] = data
    return out, firsts


def _half_peaks(net: Network, padded: np.ndarray, halves: int, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each half chunk and, if asked for, its place in the half."""
    rows = net.vectors[padded]
    per = HALF // WIDTH
    peaks = places = None
    for phase in range(0, WIDTH, STEP):
        # From each phase on, consecutive groups of WIDTH vectors are the rows of one product; nothing is copied.
        part = rows[phase : phase + halves * HALF].reshape(-1, WIDTH * VECTOR) @ net.filters
        part = part.reshape(halves, per, FILTERS)
        high = part.max(axis=1)
        if where:
            place = part.argmax(axis=1) * WIDTH + phase
            places = place if peaks is None else np.where(high > peaks, place, places)
        peaks = high if peaks is None else np.maximum(peaks, high)
    return np.maximum(peaks + net.bias, 0), places


def _chunks(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first half of each chunk (the other is the next one) and the first chunk of each text."""
    count = np.diff(firsts) - 2
    begin = np.concatenate(([0], np.cumsum(count)))
    return np.arange(begin[-1]) + np.repeat(firsts[:-1] - begin[:-1], count), begin


def _pooled(peaks: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, begin = _chunks(firsts)
    chunk = np.maximum(peaks[first], peaks[first + 1])
    mean = np.add.reduceat(chunk, begin[:-1]) / np.diff(begin)[:, None]
    high = np.maximum.reduceat(chunk, begin[:-1])
    low = np.minimum.reduceat(chunk, begin[:-1])
    return np.concatenate([mean, high, low], axis=1), chunk, first, begin


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text; ``offsets`` has one more entry than there are texts."""
    if net.filters is None:
        return np.full(len(offsets) - 1, net.prior)
    padded, firsts = _padded(data, offsets)
    peaks, _ = _half_peaks(net, padded, int(firsts[-1]), where=False)
    pooled = _pooled(peaks, firsts)[0]
    return 1 / (1 + np.exp(-np.clip(pooled.astype(np.float64) @ net.weights + net.offset, -30, 30)))


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, good: np.ndarray, share: np.ndarray) -> list:
    padded, firsts = _padded(data, offsets)
    peaks, places = _half_peaks(net, padded, int(firsts[-1]), where=True)
    pooled, chunk, first, begin = _pooled(peaks, firsts)
    score = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.offset, -30, 30)))
    error = (score - good) * share / share.sum()
    d_pooled = error[:, None] * net.weights[None, :]
    mean, high, low = np.split(d_pooled, 3, axis=1)
    owner = np.repeat(np.arange(len(good)), np.diff(begin))
    _, top, bottom = np.split(pooled, 3, axis=1)
    d_chunk = (mean / np.diff(begin)[:, None])[owner]
    # Chunks that hold the same extreme value (neighbours share a half) share its gradient.
    for gradient, extreme in ((high, top), (low, bottom)):
        holds = (chunk == extreme[owner]).astype(np.float64)
        d_chunk = d_chunk + (gradient / np.add.reduceat(holds, begin[:-1]))[owner] * holds
    d_peaks = np.zeros_like(peaks)
    left = peaks[first] >= peaks[first + 1]
    np.add.at(d_peaks, first, d_chunk * left)
    np.add.at(d_peaks, first + 1, d_chunk * ~left)
    d_peaks *= peaks > 0
    half, which = np.nonzero(d_peaks)
    value = d_peaks[half, which]
    at = half * HALF + places[half, which]
    window = padded[at[:, None] + np.arange(WIDTH)]
    rows = net.vectors[window].reshape(len(at), WIDTH * VECTOR)
    d_filters = np.zeros_like(net.filters)
    d_vectors = np.zeros_like(net.vectors)
    for f in range(FILTERS):
        d_filters[:, f] = value[which == f] @ rows[which == f]
    back = (value[:, None] * net.filters.T[which]).reshape(-1, WIDTH, VECTOR)
    for v in range(VECTOR):
        d_vectors[:, v] = np.bincount(window.ravel(), back[:, :, v].ravel(), 256)
    return [d_vectors, d_filters, d_peaks.sum(axis=0), pooled.T @ error, error.sum()]


def train(texts: list[bytes], labels: list[int]) -> Network:
    """Fits a network by Adam; both classes weigh the same in the loss, then the offset is set back by their odds."""
    good = np.array(labels, np.float64)
    prior = float((good.sum() + 1) / (len(good) + 2))
    if len(set(labels)) < 2:
        return Network(prior=prior)
    rng = np.random.default_rng(SEED)
    parts = [rng.normal(0, 0.5, (256, VECTOR)), rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS))]
    parts = [p.astype(np.float32) for p in (*parts, np.zeros(FILTERS), np.zeros(3 * FILTERS))] + [np.zeros(1)]
    share = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    a_round = -(-len(texts) // DOCUMENTS_A_STEP)
    rounds = max(ROUNDS, -(-LEAST_STEPS // a_round))
    step, steps = 0, rounds * a_round
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), DOCUMENTS_A_STEP):
            chosen = order[i : i + DOCUMENTS_A_STEP]
            data = np.frombuffer(b"".join(texts[j] for j in chosen), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(texts[j]) for j in chosen])))
            net = Network(*parts[:4], float(parts[4][0]))
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, d in enumerate(_gradients(net, data, offsets, good[chosen], share[chosen])):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * np.square(d)
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                parts[k] = (parts[k] - rate * move).astype(parts[k].dtype)
    return Network(*parts[:4], float(parts[4][0]), prior)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Trains on documents whose label may be learned from (those not :func:`held_out`)."""
    known = labels.where(~held_out("doc_id") & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for quality, size in sorted(sizes.items()):
        every = max(1, -(-size // SAMPLE))
        spread = known.where((F.col("quality") == quality) & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
        spread = spread.limit(2 * SAMPLE)
        chosen = spread if chosen is None else chosen.union(spread)
    if chosen is None:
        return Network()
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", "text")
        .limit(4 * SAMPLE)
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows])


@lean
def _score(batches: Iterable[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        for part in slices(batch, "text"):
            score = probabilities(net, *text_buffers(part.column("text")))
            kept = [c for c in part.schema.names if c != "text"]
            schema = schema or pa.schema([part.schema.field(c) for c in kept] + [("score", pa.float64())])
            yield record_batch(schema, *(part.column(c) for c in kept), score)


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and ``score`` of every document."""
    return docs.select("doc_id", "text").mapInArrow(partial(_score, net=net), "doc_id bigint, score double")


@lean
def _keep(batches: Iterable[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            score = probabilities(net, *text_buffers(part.column("text")))
            yield part.filter(pa.array(score >= THRESHOLD))


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least the threshold."""
    return docs.mapInArrow(partial(_keep, net=net), docs.schema)
