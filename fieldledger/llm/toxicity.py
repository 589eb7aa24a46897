"""A toxicity classifier that does not take the mere mention of a group for an insult.

A text is cut into sentences (at ``.``, ``!``, ``?`` and line ends, and after every ``WINDOW`` words). A word adds the
learned weights of itself and of its beginnings of 3 to 9 bytes, all hashed into ``1 << BITS`` places, once in a
sentence. Weights are never negative: there are words that speak for toxicity, none that excuse it. What the sum of a
sentence exceeds ``MARGIN`` by is added to the logit of its text, so one toxic sentence in a long clean text
counts in full, and clean sentences add nothing however many they are.

Training (:func:`train`, numpy on the driver) starts from the log odds of the features and is regularised by
counterfactuals: in labelled texts the terms of ``IDENTITIES`` are swapped for others of their group, and the squared change
of the text's logit is added to the loss (weight ``FAIRNESS``). A text without such a term lends one of its words:
two terms of a group take its place, and the two versions have to score alike. Every group holds
neutral words, so terms are drawn to what those weigh, not only to each other.

It takes at most ``SAMPLE`` labelled documents of each class of at most ``SAMPLE_CHARS`` characters, the first by a
hash of the doc_id. Scoring runs in Arrow batches over all documents and whole texts; texts of more than ``RUN`` bytes
go through in runs that end behind a sentence (or a space, or after ``RUN`` bytes, if there is none), so memory does not
grow with a text.

Cases: a null text is an empty one; texts without words get the score of the bias alone; labels that are null, not 0
or 1, or of no document do not count, repeated ones count once; documents whose doc_id is null have no label, and are
scored; with labels of one class only, or none, the score is (toxic + 1) / (all + 2); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import record_batch, slices, text_buffers
from fieldledger.llm.words import LETTERS, hash_of, lower, mix, prefix_hash, span_hash, word_spans

BITS, WINDOW, MARGIN = 18, 32, 1.5
BEGINNINGS = range(3, 10)
SAMPLE, SAMPLE_CHARS = 2000, 8192
# A feature is learned if so many labelled texts have it.
SEEN = 8
ROUNDS, LEAST_STEPS, DOCUMENTS_A_STEP, SWAPPED_A_STEP = 12, 300, 64, 16
RATE, DECAY, FAIRNESS, SEED = 0.03, 1e-4, 0.5, 11
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
RUN = 1 << 20

# Terms that name a group of people, by kind; the first of each kind are neutral.
IDENTITIES = (
    ("person", "people", "women", "woman", "men", "man", "girls", "boys", "transgender", "nonbinary"),
    ("people", "citizens", "immigrants", "refugees", "foreigners", "africans", "asians", "americans", "europeans",
     "arabs", "latinos", "mexicans", "chinese", "indians", "turks", "poles", "black", "white"),
    ("people", "believers", "muslims", "muslim", "christians", "christian", "jews", "jewish", "hindus", "buddhists",
     "catholics", "atheists"),
    ("people", "couples", "gay", "lesbian", "bisexual", "queer", "straight", "homosexual"),
    ("people", "adults", "elderly", "old", "young", "disabled", "blind", "deaf", "autistic"),
    ("menschen", "leute", "frauen", "männer", "ausländer", "flüchtlinge", "muslime", "juden", "christen", "türken",
     "schwule", "lesben", "behinderte"),
    ("gens", "personnes", "femmes", "hommes", "étrangers", "réfugiés", "musulmans", "juifs", "chrétiens", "noirs",
     "blancs", "arabes", "homosexuels", "handicapés"),
    ("personas", "gente", "mujeres", "hombres", "extranjeros", "refugiados", "musulmanes", "judíos", "cristianos",
     "negros", "blancos", "gitanos", "homosexuales", "discapacitados"),
)

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in (0, *BEGINNINGS)]


@dataclass
class Model:
    """``weights`` of the hashed features (the last place is for absent ones and zero) and the bias of a text.

    Without weights it is the constant ``prior``."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    prior: float = 0.5


def held_out(doc_id: str) -> Column:
    """True for the quarter of the ids that no label is learned from."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


# --- texts ----------------------------------------------------------------------------------------------------------


def _features(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of each word's features: itself and its proper beginnings."""
    out = np.full((len(starts), len(_SALTS)), 1 << BITS, np.int32)
    out[:, 0] = mix(span_hash(prefix, starts, ends) ^ _SALTS[0]) >> np.uint64(64 - BITS)
    for i, k in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts > k)
        part = span_hash(prefix, starts[longer], starts[longer] + k)
        out[longer, i] = mix(part ^ _SALTS[i]) >> np.uint64(64 - BITS)
    return out


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct words of lower-cased texts, as features, the words of all sentences, each once in a sentence, as
    places of these, the first word of each sentence, and its text; and the words' hashes."""
    starts, ends, owner = word_spans(data, offsets, LETTERS)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros((0, len(_SALTS)), np.int32), none, none, none, none.astype(np.uint64)
    prefix = prefix_hash(data)
    closed = np.cumsum(_ENDS[data])[starts]
    change = np.ones(len(starts), bool)
    change[1:] = (closed[1:] != closed[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(starts))
    first = np.maximum.accumulate(np.where(change, at, 0))
    new = change | ((at - first) % WINDOW == 0)
    hashes, one, which = np.unique(span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    once = np.unique((np.cumsum(new) - 1) * len(hashes) + which)
    begins = np.flatnonzero(np.diff(once // len(hashes), prepend=-1))
    return _features(prefix, starts[one], ends[one]), once % len(hashes), begins, owner[new], hashes


def _evidence(sums: np.ndarray) -> np.ndarray:
    """What a sentence adds to the logit of its text: nothing for clean ones, however many they are."""
    return np.maximum(sums - MARGIN, 0)


def _runs(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one text of at most RUN bytes that end behind a sentence, else a word, if one ends in the last half."""
    start = 0
    while len(data) - start > RUN:
        part = data[start : start + RUN]
        late = RUN // 2
        for stops in (_ENDS[part[late:]], ~LETTERS[lower(part[late:])]):
            found = np.flatnonzero(stops)
            if len(found):
                part = part[: late + int(found[-1]) + 1]
                break
        yield part
        start += len(part)
    yield data[start:]


def _sums(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each sentence and its text."""
    features, words, begins, owner, _ = _sentences(lower(data), offsets)
    if len(words) == 0:
        return np.zeros(0), owner
    value = model.weights[features].sum(axis=1, dtype=np.float64)
    return np.add.reduceat(value[words], begins), owner


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text; ``offsets`` has one more entry than there are texts."""
    texts = len(offsets) - 1
    if model.weights is None:
        return np.full(texts, model.prior)
    total = np.zeros(texts)
    if texts == 1 and len(data) > RUN:
        for part in _runs(data):
            total[0] += _evidence(_sums(model, part, np.array([0, len(part)]))[0]).sum()
    else:
        sums, owner = _sums(model, data, offsets)
        total = np.bincount(owner, _evidence(sums), texts)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


# --- training -------------------------------------------------------------------------------------------------------


class _Corpus:
    """The words of the labelled texts as numbers, with their sentences, and the identity terms as further words."""

    def __init__(self, texts: list[bytes], labels: list[int]):
        data = lower(np.frombuffer(b"".join(texts), np.uint8))
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        features, self.word, begins, owner, known = _sentences(data, offsets)
        terms = [t.encode() for kind in IDENTITIES for t in kind]
        place = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        extra = _features(prefix_hash(np.frombuffer(b"".join(terms), np.uint8)), place[:-1], place[1:])
        self.features = np.concatenate([features, extra])
        number = {int(h): i for i, h in enumerate(known)}
        self.kinds, self.of_word = [], {}
        at = len(known)
        for kind in IDENTITIES:
            self.kinds.append(np.arange(at, at + len(kind)))
            for term in kind:
                self.of_word.setdefault(number.get(hash_of(term), -1), len(self.kinds) - 1)
            at += len(kind)
        self.named = np.zeros(at, bool)
        self.named[[w for w in self.of_word if w >= 0]] = True
        # The words of sentence i are sentence[i] to sentence[i + 1], the sentences of text j text[j] to text[j + 1].
        self.sentence = np.append(begins, len(self.word))
        self.text = np.searchsorted(owner, np.arange(len(texts) + 1))
        # In how many texts of each class each feature occurs.
        self.seen = np.zeros((2, (1 << BITS) + 1))
        for j in range(len(texts)):
            words = np.unique(self.word[self.sentence[self.text[j]] : self.sentence[self.text[j + 1]]])
            self.seen[labels[j], np.unique(self.features[words])] += 1

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, first word of each sentence and first sentence of each text of the chosen texts, all with words."""
        sentences = np.concatenate([np.arange(self.text[j], self.text[j + 1]) for j in chosen])
        lengths = self.sentence[sentences + 1] - self.sentence[sentences]
        firsts = np.concatenate(([0], np.cumsum(lengths)))
        places = np.arange(firsts[-1]) + np.repeat(self.sentence[sentences] - firsts[:-1], lengths)
        counts = self.text[chosen + 1] - self.text[chosen]
        return self.word[places], firsts[:-1], np.concatenate(([0], np.cumsum(counts)))[:-1]

    def swapped(self, words: np.ndarray, texts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Two versions of some texts that differ only in terms that name a group; ``texts`` are their first words."""
        one, other = words.copy(), words.copy()
        ends = np.append(texts[1:], len(words))
        for start, end in zip(texts, ends, strict=True):
            places = start + np.flatnonzero(self.named[words[start:end]])
            if len(places):
                for place in places:
                    other[place] = rng.choice(self.kinds[self.of_word[int(words[place])]])
            else:
                kind = self.kinds[rng.integers(len(self.kinds))]
                place = rng.integers(start, end)
                one[place], other[place] = rng.choice(kind, 2, replace=False)
        return one, other


def _logits(
    corpus: _Corpus, weights: np.ndarray, bias: float, words: np.ndarray, sentences: np.ndarray, texts: np.ndarray
) -> tuple[np.ndarray, tuple]:
    used, which = np.unique(words, return_inverse=True)
    value = weights[corpus.features[used]].sum(axis=1)
    sums = np.add.reduceat(value[which], sentences)
    evidence = _evidence(sums)
    total = np.add.reduceat(evidence, texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, len(sentences))))
    lengths = np.diff(np.append(sentences, len(words)))
    return total + bias, (used, which, np.repeat(evidence > 0, lengths), np.repeat(owner, lengths))


def _gradient(corpus: _Corpus, size: int, of_logit: np.ndarray, way: tuple) -> np.ndarray:
    used, which, share, owner = way
    of_word = np.bincount(which, share * of_logit[owner], len(used))
    width = corpus.features.shape[1]
    return np.bincount(corpus.features[used].ravel(), np.repeat(of_word, width), size)


def train(texts: list[bytes], labels: list[int], fairness: float = FAIRNESS, odds: float | None = None) -> Model:
    """Fits the weights by Adagrad (words are rare, and each keeps a rate of its own); both classes weigh the same in the loss, then the bias is moved by the ``odds`` of a
    toxic text (by default those of the labels)."""
    toxic = np.array(labels, np.float64)
    prior = float((toxic.sum() + 1) / (len(toxic) + 2))
    if len(set(labels)) < 2:
        return Model(prior=prior)
    rng = np.random.default_rng(SEED)
    corpus = _Corpus(texts, labels)
    worded = np.flatnonzero(np.diff(corpus.text) > 0)
    share = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    size = (1 << BITS) + 1
    bias = -2.0
    squares = np.zeros(size + 1, np.float32)
    a_round = -(-len(worded) // DOCUMENTS_A_STEP)
    rounds = max(ROUNDS, -(-LEAST_STEPS // max(a_round, 1)))
    learned = np.append(corpus.seen.sum(axis=0) >= SEEN, True)
    learned[corpus.features[corpus.kinds[0][0] :]] = True
    learned[size - 1] = False
    # Weights begin as what the log odds of their features surely are, spread over about as many as a word has.
    clean, foul = (corpus.seen + 0.5) / (np.bincount(np.array(labels), minlength=2)[:, None] + 1)
    unsure = 2 * np.sqrt((1 / (corpus.seen + 0.5)).sum(axis=0))
    weights = (np.clip(np.log(foul / clean) - unsure, 0, None) / 4 * learned[:-1]).astype(np.float32)
    for _ in range(rounds if len(worded) else 0):
        order = rng.permutation(worded)
        for i in range(0, len(order), DOCUMENTS_A_STEP):
            chosen = order[i : i + DOCUMENTS_A_STEP]
            words, sentences, places = corpus.of(chosen)
            logit, way = _logits(corpus, weights, bias, words, sentences, places)
            weight = share[chosen] / share[chosen].sum()
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[chosen]) * weight
            change = _gradient(corpus, size, error, way)
            if fairness:
                some = chosen[:: len(chosen) // SWAPPED_A_STEP + 1]
                words, sentences, places = corpus.of(some)
                pair = corpus.swapped(words, sentences[places], rng)
                sides = [_logits(corpus, weights, bias, version, sentences, places) for version in pair]
                apart = 2 * fairness * (sides[0][0] - sides[1][0]) / len(some)
                change += _gradient(corpus, size, apart, sides[0][1]) - _gradient(corpus, size, apart, sides[1][1])
            change = np.append(change + DECAY * weights, error.sum()).astype(np.float32) * learned
            squares += np.square(change)
            move = RATE * change / np.sqrt(squares + 1e-10)
            weights = np.maximum(weights - move[:-1], 0)
            bias -= float(move[-1])
    odds = toxic.mean() / (1 - toxic.mean()) if odds is None else odds
    return Model(weights, bias + float(np.log(odds)), prior)


def fit(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model:
    """Trains on documents whose label may be learned from (those not :func:`held_out`)."""
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    sizes = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    classes = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(reduce(DataFrame.unionByName, classes)), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text")
        .limit(2 * SAMPLE)
        .collect()
    )
    return train([r["text"].encode() for r in rows], [int(r["toxic"]) for r in rows], fairness, (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        for part in slices(batch, "text"):
            yield record_batch(schema, part.column("doc_id"), probabilities(model, *text_buffers(part.column("text"))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score`` of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_score, model=model), "doc_id bigint, score double")
