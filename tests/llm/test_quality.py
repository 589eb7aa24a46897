import numpy as np

from fieldledger.llm import quality
from fieldledger.llm.common import table
from tests.llm.helpers import documents, ordered, prose

DATA = "/root/testdata/sf0.1"


def network():
    texts = [prose(i, 60).encode() for i in range(60)] + [b"buy!! now!! $$$ " * 20 for _ in range(60)]
    return quality.train(texts, [1] * 60 + [0] * 60)


def plain_score(net, text):
    """The network written out for one text, without batches or phases."""
    if net.filters is None:
        return net.prior
    halves = max(2, -(-len(text) // quality.HALF))
    data = np.zeros(halves * quality.HALF + quality.WIDTH, np.uint8)
    data[: len(text)] = list(text)
    responses = []
    for i in range(0, halves * quality.HALF, quality.STEP):
        row = net.vectors[data[i : i + quality.WIDTH]].ravel()
        responses.append(np.maximum(row @ net.filters + net.bias, 0))
    per = quality.HALF // quality.STEP
    peaks = np.array(responses).reshape(halves, per, -1).max(axis=1)
    chunks = np.array([np.maximum(peaks[i], peaks[i + 1]) for i in range(halves - 1)])
    pooled = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)])
    return 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.offset, -30, 30)))


def scored(net, texts):
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return quality.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), offsets)


def test_scores_equal_the_written_out_network():
    net = network()
    texts = [b"", b"a", prose(1, 300).encode(), b"x" * 64, b"y" * 65, b"buy!! " * 90]
    got = scored(net, texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
    assert got[2] > 0.9 and got[5] < 0.1
    assert np.allclose(got, [scored(net, [t])[0] for t in texts])


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    shape = quality.WIDTH * quality.VECTOR
    net = quality.Network(
        rng.normal(size=(256, quality.VECTOR)), rng.normal(size=(shape, quality.FILTERS)) / 5,
        rng.normal(size=quality.FILTERS), rng.normal(size=3 * quality.FILTERS) / 9, 0.1,
    )
    texts = [prose(i, 40 + 30 * i).encode() for i in range(4)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    good, share = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = quality.probabilities(net, data, offsets)
        return float((-(good * np.log(p) + (1 - good) * np.log(1 - p)) * share).sum() / share.sum())

    grads = quality._gradients(net, data, offsets, good, share)
    spots = [(net.vectors, grads[0], (ord("e"), 2)), (net.filters, grads[1], (7, 3)), (net.bias, grads[2], (5,))]
    for values, grad, at in [*spots, (net.weights, grads[3], (40,))]:
        old = values[at]
        values[at] = old + 1e-6
        up = loss()
        values[at] = old - 1e-6
        down = loss()
        values[at] = old
        assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    net = quality.fit(docs, labels)
    rows = (
        quality.scores(docs, net).join(labels, "doc_id").where(quality.held_out("doc_id"))
        .selectExpr("quality", "score >= 0.3 as good").collect()
    )
    assert sum(r["good"] == bool(r["quality"]) for r in rows) >= 0.98 * len(rows)
    assert sum(r["good"] for r in rows if r["quality"]) >= 0.99 * sum(r["quality"] for r in rows)


def test_edges(spark):
    docs = documents(spark, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scores(docs, quality.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(9, 1), (None, 0), (10, None), (999, 0), (11, 1)], "doc_id long, quality int")
    net = quality.fit(docs, odd)
    assert net.filters is None and net.prior > 0.5
    got = quality.scores(docs, network())
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    net = network()
    kept = quality.accepted(docs, net)
    assert kept.columns == docs.columns
    good = [r for r in docs.collect() if scored(net, [(r["text"] or "").encode()])[0] >= quality.THRESHOLD]
    assert ordered(kept, "doc_id", "text") == sorted(((r["doc_id"], r["text"]) for r in good), key=repr)
    empty = documents(spark, [])
    assert quality.scores(empty, quality.fit(empty, none)).count() == 0
