import math
import re

from fieldledger.llm import license_scan as scan
from tests.llm.helpers import cases, documents, lowered, ordered, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    templates = [(label, set(WORD.findall(lowered(t)))) for label, t in scan.TEMPLATES]
    out = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(lowered(text))
        places, base = [], set()
        for phrase, label in scan.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += here
            base |= {label} if here else set()
        labels, score = set(base), float(bool(places))
        for b in range(max(1, math.ceil((len(words) - 32) / 32))):
            block = set(words[32 * b : 32 * b + 64])
            for label, own in templates:
                share = len(block & own) / len(own)
                if len(block & own) >= math.ceil(scan.THRESHOLD * len(own)):
                    labels.add(label)
                    score = max(score, share)
        first, last = (min(places), max(places)) if places else (None, None)
        labelled = (",".join(sorted(base)), ",".join(sorted(labels)))
        out.append((doc_id, len(words), len(places), first, last, *labelled, score))
    return sorted(out, key=repr)


def found(docs):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return ordered(scan.scan(docs), *names)


def notices():
    texts = [t for _, t in scan.TEMPLATES]
    for i, (_, t) in enumerate(scan.TEMPLATES):
        words = t.split()
        texts.append(" ".join(words[1:]))
        texts.append(prose(i, 31 + 9 * i) + " " + " ".join(reversed(words)) + " " + prose(50 + i, 40))
        texts.append(prose(i, 20) + "\n" + " und ".join(words) + prose(70 + i, 5))
    texts += ["under the MIT license under the mit-license UNDER, THE MIT LICENSE", "cc by nc cc by nc", "under the mit"]
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_notices_equal_brute_force(spark):
    got = found(documents(spark, notices()))
    assert got == brute(notices())
    assert {label for r in got for label in r[6].split(",")} >= {label for label, _ in scan.TEMPLATES}


def test_cases(spark):
    assert found(documents(spark, clashing=True)) == brute(cases())
    assert found(documents(spark, [])) == []


def test_order_of_frequencies_does_not_change_the_result(spark):
    docs = documents(spark, notices())
    counts = scan.frequencies(docs, scan.TEMPLATES)
    assert len(counts) == len(scan.vocabulary(scan.TEMPLATES)) and min(counts.values()) > 0
    index = scan.build_index(scan.TEMPLATES, counts, scan.THRESHOLD)
    assert [counts[i] for i in index.rank.argsort()] == sorted(counts.values())
