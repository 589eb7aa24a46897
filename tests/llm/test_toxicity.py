import random

import numpy as np

from fieldledger.llm import toxicity
from fieldledger.llm.common import table
from fieldledger.llm.words import LETTERS, hash_of
from tests.llm.helpers import documents, prose

DATA = "/root/testdata/sf0.1"


def scored(model, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    return toxicity.probabilities(model, np.frombuffer(b"".join(raw), np.uint8), offsets)


def labelled(seed, count, insults=("scumbag", "dimwit"), mention=0.0):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(count):
        words = prose(seed * 1000 + i, 60).split(" ")
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(insults)
        if rng.random() < (mention if toxic else 0.02):
            words[rng.randrange(60)] = rng.choice(["muslims", "jews"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def trained(texts, labels, **more):
    return toxicity.train([t.encode() for t in texts], labels, **more)


def plain_score(model, text):
    """The model written out for one text."""
    total, data = 0.0, text.encode().lower()
    sentence: list[bytes] = []
    sentences = [sentence]
    word = b""
    for byte in [*data, 0x20]:
        if LETTERS[byte]:
            word += bytes([byte])
            continue
        if word:
            if len(sentence) == toxicity.WINDOW:
                sentence = []
                sentences.append(sentence)
            sentence.append(word)
            word = b""
        if byte in b".!?\n":
            sentence = []
            sentences.append(sentence)
    for words in sentences:
        if words:
            value = 0.0
            for w in set(words):
                parts = [(w, 0)] + [(w[:k], i) for i, k in enumerate(toxicity.BEGINNINGS, 1) if len(w) > k]
                for part, i in parts:
                    data = np.frombuffer(part, np.uint8)
                    h = toxicity.span_hash(toxicity.prefix_hash(data), np.array([0]), np.array([len(data)]))
                    value += model.weights[int(toxicity.mix(h ^ toxicity._SALTS[i])[0]) >> (64 - toxicity.BITS)]
            total += float(toxicity._evidence(np.array([value]))[0])
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def test_scores_equal_the_written_out_model():
    model = trained(*labelled(1, 90))
    texts = ["", "   ", "scumbag", "a. b! Dimwit\nc", prose(7, 200), prose(8, 90).replace(" ", "."), "é dimwits 日本 " * 20]
    got = scored(model, texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-6)
    assert np.allclose(got, [scored(model, [t])[0] for t in texts])


def test_one_sentence_in_a_long_text_and_runs(monkeypatch):
    model = trained(*labelled(2, 300))
    clean = ". ".join(prose(500 + i, 12) for i in range(3000))
    cut = clean.index(". ", len(clean) // 2)
    toxic = clean[:cut] + ". You are a scumbag" + clean[cut:]
    whole = scored(model, [clean])[0], scored(model, [toxic])[0]
    assert whole[0] < toxicity.THRESHOLD <= whole[1]
    monkeypatch.setattr(toxicity, "RUN", 4000)
    assert np.allclose(whole, [scored(model, [clean])[0], scored(model, [toxic])[0]])
    assert 0 <= scored(model, ["x" * 9000 + " scumbag"])[0] <= 1


def test_gradients_equal_differences():
    texts, _ = labelled(3, 12)
    corpus = toxicity._Corpus([t.encode() for t in texts], [1, 0] * 6)
    rng = np.random.default_rng(1)
    weights = rng.uniform(0, 0.2, (1 << toxicity.BITS) + 1)
    words, sentences, places = corpus.of(np.arange(12))
    logit, way = toxicity._logits(corpus, weights, -1.0, words, sentences, places)
    side = rng.normal(size=12)
    grad = toxicity._gradient(corpus, len(weights), side, way)
    for at in rng.choice(np.flatnonzero(grad), 8):
        old, out = weights[at], []
        for step in (1e-5, -1e-5):
            weights[at] = old + step
            out.append(side @ toxicity._logits(corpus, weights, -1.0, words, sentences, places)[0])
        weights[at] = old
        assert abs((out[0] - out[1]) / 2e-5 - grad[at]) < 1e-4


def test_swapped_texts_differ_in_terms_of_one_kind_only():
    texts = ["the muslims came", "nothing of the sort", "jews and women"]
    corpus = toxicity._Corpus([t.encode() for t in texts], [0, 1, 0])
    words, sentences, places = corpus.of(np.arange(3))
    one, other = corpus.swapped(words, sentences[places], np.random.default_rng(3))
    kinds = [set(map(int, k)) for k in corpus.kinds]
    ends = [*sentences[places], len(words)]
    first, second = slice(*ends[:2]), slice(*ends[1:3])
    changed = np.flatnonzero(other[first] != words[first])
    assert list(one[first]) == list(words[first]) and len(changed) == 1
    assert int(other[first][changed[0]]) in kinds[corpus.of_word[int(words[first][changed[0]])]]
    changed = np.flatnonzero(one[second] != other[second])
    assert len(changed) == 1 and any({int(one[second][changed[0]]), int(other[second][changed[0]])} <= k for k in kinds)
    assert hash_of("muslims") != hash_of("muslim")


def test_counterfactuals_spare_neutral_mentions():
    """Toxic texts often name a group here, so a plain classifier takes the name for an insult."""
    insults = [w + "zqx" for w in set(prose(77, 60).split(" ")) if len(w) > 3][:16]
    texts, labels = labelled(4, 600, insults, mention=0.95)
    insulted = [" ".join(prose(9000 + i, 20).split(" ") + [w]) for i, w in enumerate(insults)]
    neutral = [" ".join(prose(8000 + i, 20).split(" ") + [w]) for i in range(20) for w in ("muslims", "jews")]
    fair, plain = trained(texts, labels), trained(texts, labels, fairness=0.0)
    caught = [(scored(m, insulted) >= toxicity.THRESHOLD).mean() for m in (fair, plain)]
    wrong = [(scored(m, neutral) >= toxicity.THRESHOLD).mean() for m in (fair, plain)]
    assert caught[0] >= 0.9
    assert wrong[0] <= 0.05 < 0.5 <= wrong[1]
    # Names of one kind score alike.
    pairs = [(f"the {a} of it", f"the {b} of it") for a, b in (("muslims", "jews"), ("muslims", "catholics"))]
    apart = [np.abs(np.diff([scored(m, list(p)) for p in pairs], axis=1)).max() for m in (fair, plain)]
    assert apart[0] < 0.1 < apart[1]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels)
    rows = (
        toxicity.scores(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
        .selectExpr("toxic", "score >= 0.3 as found").collect()
    )
    caught = sum(r["found"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["found"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    assert caught >= 0.8 and wrong <= 0.02


def test_edges(spark):
    docs = documents(spark, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(9, 1), (None, 0), (10, None), (999, 0), (11, 1), (12, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, odd)
    assert model.weights is None and model.prior > 0.5
    got = toxicity.scores(docs, trained(*labelled(5, 60)))
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    empty = documents(spark, [])
    assert toxicity.scores(empty, toxicity.fit(empty, none)).count() == 0
    # Texts without a word, of both classes.
    assert toxicity.train([b"", b" "], [0, 1]).weights is not None
