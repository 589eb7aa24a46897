import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from fieldledger.llm import pieces, sentencepiece_codec, token_counts, token_store
from fieldledger.session import fresh_dir
from tests.llm.helpers import cases, documents, ordered

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [r[1] for r in cases() if r[1] is not None]
TEXTS += ["  a  b ", "a ", " a", "\n", "a\n\n b", "日本語 x", "😀😀 😀", "▁", "a▁b", "<s> <unk>", "<0x0A>", "a  b", "\x00"]
ANY = st.text(st.one_of(st.sampled_from(" \n\t'abét1.▁"), st.characters(exclude_categories=["Cs"])), max_size=40)


def whole():
    out = Tokenizer.from_file(BYTES)
    out.encode_special_tokens = True
    return out


def unigram():
    model = pieces.load(PIECES)
    out = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=True))
    out.normalizer = normalizers.Sequence([normalizers.Prepend(" "), normalizers.Replace(" ", pieces.MARK)])
    return out


BYTE_BPE, UNIGRAM = whole(), unigram()
SENTENCES = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_ids(text):
    return np.frombuffer(token_store.encoder(BYTES).ids(text), "<u4").tolist()


def check_all(text):
    assert byte_ids(text) == BYTE_BPE.encode(text, add_special_tokens=False).ids
    assert token_counts.count_tokens(text, PIECES) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)
    coded = np.frombuffer(sentencepiece_codec.codec(PIECES).encode([text])[0], "<i4")
    assert coded.tolist() == SENTENCES.encode(text)
    assert sentencepiece_codec.codec(PIECES).decode(coded) == SENTENCES.decode(coded.tolist())


@pytest.mark.parametrize("text", TEXTS)
def test_texts_equal_the_libraries(text):
    check_all(text)


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_any_text_equals_the_libraries(text):
    check_all(text)


def test_words_join_to_the_text():
    for text in TEXTS:
        assert "".join(pieces.words(text)) == (" " + text if text else "")


def test_ties_take_the_longest_last_piece():
    """Scores of the model are whole numbers, so equal totals are common; compare many."""
    words = ["".join(p) for p in zip("abcde" * 40, "tinre" * 40, "xstno" * 40, "aeiou" * 40, strict=True)]
    for w in {a + b for a in words[:25] for b in words[:25]}:
        assert token_counts.count_tokens(w, PIECES) == len(UNIGRAM.encode(w, add_special_tokens=False).ids)


def test_counts_and_codec_on_tables(spark):
    docs = documents(spark, clashing=True)
    got = ordered(token_counts.token_counts(docs, PIECES), "doc_id", "n_tokens")
    assert got == sorted(((r[0], len(UNIGRAM.encode(r[1] or "", add_special_tokens=False).ids)) for r in cases()), key=repr)
    sentencepiece_codec.verify(docs, PIECES)
    coded = sentencepiece_codec.encoded(docs, PIECES)
    assert coded.columns == [*docs.columns, "n_pieces", "piece_ids", "ids_crc32", "decoded"]
    want = []
    for doc_id, text, *_ in cases():
        ids = None if text is None else SENTENCES.encode(text)
        crc = None if text is None else zlib.crc32(np.array(ids, "<i4").tobytes())
        want.append((doc_id, 0 if ids is None else len(ids), ids, crc, None if text is None else SENTENCES.decode(ids)))
    assert ordered(coded, "doc_id", "n_pieces", "piece_ids", "ids_crc32", "decoded") == sorted(want, key=repr)
    assert sentencepiece_codec.encoded(documents(spark, []), PIECES).count() == 0
    assert token_counts.token_counts(documents(spark, []), PIECES).count() == 0


def test_every_text_is_compared_with_the_library(monkeypatch):
    """A difference in one word of the last of many texts, beyond any sample, fails."""
    tool = sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(sentencepiece_codec, "codec", lambda path: tool)
    texts = [f"text number {i}" for i in range(700)] + ["x " * 5000 + "zebra"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = pa.Table.from_batches(sentencepiece_codec._encoded([batch], PIECES, ["text", "decoded"]))
    assert rows["decoded"].to_pylist() == texts
    tool.known.clear()
    wrong, right = SENTENCES.piece_to_id("a"), SENTENCES.encode("zebra")[0]
    words = tool._words
    monkeypatch.setattr(tool, "_words", lambda new: [[wrong if i == right else i for i in w] for w in words(new)])
    with pytest.raises(ValueError, match="differs from the model"):
        list(sentencepiece_codec._encoded([batch], PIECES, ["text", "decoded"]))


SPACES = " \t\n\x0b\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u180e\ufeff"
MIXED = st.text(st.sampled_from(SPACES + "ab1.,'s’\x00\x7fßàö×÷ªµ²½ɏɐЖ日😀"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(MIXED, ANY, st.just("<|endoftext|>")), max_size=8))
def test_texts_of_a_batch_equal_the_library(texts):
    """Pieces are cut and looked up over a whole batch; texts, white space and marks must not run together."""
    plain = Tokenizer.from_file(BYTES)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        got = token_store.encoder(BYTES).encode(pa.array(["x", *texts, None], kind).slice(1))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [*want, []]


def test_new_words_of_a_batch_go_to_the_library_together():
    """10,000 words that were not met before took as many calls."""
    words = token_store._Words(BYTES)
    calls, library = [], words.parts

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(texts)
            return library.encode_batch_fast(texts, **more)

    words.parts = Counted()
    texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}x{i * j:x}" for j in range(100)) for i in range(100)])
    want = [np.array(BYTE_BPE.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts.to_pylist()]
    assert words.encode(texts) == want and 0 < len(calls) <= 50
    before = len(calls)
    assert words.encode(texts) == want and len(calls) == before


@pytest.mark.parametrize("most", [0, 3, 60])
def test_pieces_that_were_forgotten_are_encoded_again(monkeypatch, most):
    monkeypatch.setattr(token_store, "CACHED_WORDS", most)
    words = token_store._Words(BYTES)
    texts = TEXTS + ["a b 日本 c", None, "a " * 50]
    for text in texts * 2:
        want = BYTE_BPE.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(words.encode(pa.array([text], pa.string()))[0], "<u4").tolist() == want
        assert len(words.pieces) <= most


def test_ids_that_do_not_spell_a_text_fail():
    words = token_store._Words(BYTES)
    words.lengths = words.lengths + 1
    with pytest.raises(ValueError, match="do not spell"):
        words.ids("some words")


def plain_store(rows):
    """Documents in order (null ids first, repeats by the hash of their text are taken as they come)."""
    out, start = [], 0
    for doc_id, text, *_ in rows:
        ids = BYTE_BPE.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), ids))
        start += len(ids)
    return out


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PACK_DOCUMENTS", 4)
    rows = [r for r in cases() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    path = fresh_dir(spark, "store")
    token_store.write_store(documents(spark, rows, clashing=True), path, BYTES)
    want = sorted(plain_store(sorted(rows, key=lambda r: r[0])))
    assert sorted(tuple(r) for r in token_store.read_store(spark, path).collect()) == want
    few = token_store.read_documents(spark, path, [3, 12, 999])
    assert sorted(tuple(r) for r in few.collect()) == [w for w in want if w[0] in (3, 12)]
    digests = {r["doc_id"]: r["ids_crc32"] for r in token_store.read_digests(spark, path).collect()}
    assert digests == {w[0]: zlib.crc32(np.array(w[3], "<u4").tobytes()) for w in want}


def test_store_with_nulls_and_repeats(spark):
    path = fresh_dir(spark, "store")
    rows = cases() + [(7, f"text {i}", None, None, None) for i in range(30)]
    token_store.write_store(documents(spark, rows), path, BYTES)
    got = sorted((tuple(r) for r in token_store.read_store(spark, path).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = plain_store(rows)
    assert sorted(map(repr, ((r[0], r[3]) for r in got))) == sorted(map(repr, ((w[0], w[3]) for w in want)))


def test_store_of_nothing_and_wrong_dictionary(spark):
    path = fresh_dir(spark, "store")
    token_store.write_store(documents(spark, []), path, BYTES)
    assert token_store.read_store(spark, path).count() == 0
    spark.createDataFrame([("00", bytearray(b"x"))], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_store(spark, path)


def test_added_tokens_equal_the_unchanged_library(spark):
    plain = Tokenizer.from_file(BYTES)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "日本 <|endoftext|>語", "<|endoftext| >", "tail"]
    for text in texts:
        assert byte_ids(text) == plain.encode(text, add_special_tokens=False).ids
    path = fresh_dir(spark, "store")
    token_store.write_store(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), path, BYTES)
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.read_store(spark, path).collect()) == want
