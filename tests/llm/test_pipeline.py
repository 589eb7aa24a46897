import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import sentencepiece
from fieldledger.llm import jaccard_join, mixing, quality, sentencepiece_codec, suffix_dedup
from fieldledger.llm.common import BATCH_BYTES, saved, table
from tests.llm.helpers import CLASHES, documents, edited, ordered, prose, spaced
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_quality import plain_score
from tests.llm.test_suffix_dedup import brute as brute_repeats

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, DATA, "documents")
    start = docs.collect()
    net = quality.fit(docs, table(spark, DATA, "labels"))

    docs = saved(stages["quality classifier"](spark, docs, DATA), "stage")
    score = {r: plain_score(net, (r["text"] or "").encode()) for r in start}
    assert {r for r in start if score[r] >= 0.3 + 1e-4} <= set(docs.collect()) <= {r for r in start if score[r] >= 0.3 - 1e-4}

    rows = [tuple(r) for r in docs.collect()]
    docs = saved(stages["n-gram Jaccard join"](spark, docs, DATA), "stage")
    stays = {i for i, _, c in brute_groups(rows) if i == c}
    assert ordered(docs, *docs.columns) == sorted((r for r in rows if r[0] in stays), key=repr)

    rows = [tuple(r) for r in docs.collect()]
    docs = saved(stages["suffix-array dedup"](spark, docs, DATA), "stage")
    assert docs.columns == table(spark, DATA, "documents").columns
    left = {i: (n - gone, runs) for i, n, gone, runs, _ in brute_repeats(rows, corpus_pipeline.PASSAGE_BYTES)}
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(left)
    # What is left of a character that a cut falls into goes too.
    assert all(left[i][0] - 6 * left[i][1] <= len(t.encode()) <= left[i][0] for i, t in got.items())
    assert docs.where("n_chars <> length(text)").count() == 0

    before = {r["doc_id"]: r for r in docs.collect()}
    copies = {r["row"]["doc_id"]: r["copies"] for r in mixing.weighed(docs, mixing.plan(docs)).collect()}
    docs = saved(stages["mixing sources to target weights"](spark, docs, DATA), "stage")
    rows = docs.collect()
    assert all(r == before[r["doc_id"]] for r in rows)
    assert {i: sum(r["doc_id"] == i for r in rows) for i in before} == copies

    docs = stages["SentencePiece encoding and decoding"](spark, docs, DATA)
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.collect():
        assert r["piece_ids"] == plain.encode(r["text"]) and r["decoded"] == r["text"]


def test_odd_rows_go_through_every_stage(spark):
    docs = documents(spark, clashing=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, DATA), "odd")
        assert out.columns == docs.columns, name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert set(last.columns) == {*docs.columns, "n_pieces", "piece_ids", "ids_crc32", "decoded"}
    assert last.count() == docs.count() and set(CLASHES) <= set(last.columns)


def test_empty_table_goes_through_every_stage(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DATA), "none")
        assert docs.count() == 0


def test_one_of_each_handles_repeats_and_null_ids(spark):
    docs = documents(spark)
    out = corpus_pipeline.one_of_each(spark, docs, DATA)
    ids = [r["doc_id"] for r in out.collect()]
    known = [i for i in ids if i is not None]
    assert len(known) == len(set(known)) and ids.count(None) == 2
    groups = ordered(jaccard_join.similar(docs), "doc_id", "component_id")
    assert set(known) == {c for i, c in groups if i is not None}


def test_same_columns_from_cleaned(spark):
    docs = documents(spark, clashing=True)
    assert suffix_dedup.cleaned(docs).columns == docs.columns


def near_groups(rows):
    """Brute force of the near-copy stage: five-word shingles, similarity of 0.8 or more."""
    sets = {}
    for i, text, *_ in rows:
        w = spaced(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_copies_of_five_word_shingles_go(spark):
    texts = []
    for i in range(6):
        base = prose(200 + i, 104)
        texts += [base, f"{base} {prose(300 + i, 18 + 2 * i)}"]  # 0.85 to 0.78
        words = prose(400 + i, 48 + i).split(" ")
        texts += [" ".join(words), " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])]
    texts += [prose(500, 700), edited(prose(500, 700), 1, 12), edited(prose(500, 700), 2, 16), prose(501, 3), prose(501, 4)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    label = near_groups(rows)
    stays = [i for i, c in label.items() if i == c]
    assert len(stays) < len({c for _, _, c in brute_groups(rows)})
    out = corpus_pipeline.one_of_each(spark, documents(spark, rows), DATA)
    assert sorted(r["doc_id"] for r in out.collect()) == stays


def test_texts_that_share_a_doc_id_are_judged_by_themselves(spark):
    a, b, c = (prose(600 + i, 80) for i in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "de", "s", 1), (2, c, "en", "s", 1), (3, b, "en", "s", 1), (0, c, None, None, 0)]
    out = corpus_pipeline.one_of_each(spark, documents(spark, rows), DATA)
    assert ordered(out, "doc_id", "text", "lang") == sorted([(1, a, "en"), (1, b, "de"), (0, c, None)], key=repr)


def test_passages_of_51_words_go(spark):
    passage = prose(700, 51)
    rows = [(i, f"{prose(710 + i, 30)}\n{passage}\n{prose(720 + i, 30)}", "en", "s", 0) for i in range(6)]
    rows += [(9, prose(730, 90), "en", "s", 0)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, documents(spark, rows), DATA).collect()}
    assert out[9] == rows[-1][1]
    assert all(passage[5:-5] not in out[i] and rows[i][1][:100] in out[i] for i in range(6))


def test_near_copy_stage_shuffles_few_texts(spark):
    """Only texts of rows that repeat go through a shuffle when the stage's result is made."""
    rows = [(i, prose(800 + i, 60), "en", "s", 0) for i in range(40)]
    rows += [rows[0], (50, rows[1][1], "en", "s", 0), (51, edited(prose(802, 60), 1, 1), "en", "s", 0)]
    out = corpus_pipeline.one_of_each(spark, documents(spark, rows), DATA)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Of the branches of the union the first one has no exchange but of broadcasts.
    branches = plan[plan.index("Union") :].split("Scan ExistingRDD")
    assert "hashpartitioning" not in branches[0]


def test_stages_send_workers_batches_of_bounded_bytes(spark):
    """A thousand rows that are long, as texts and packed postings may be, are no single batch."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    for _, stage in corpus_pipeline.STAGES:
        stage(spark, documents(spark, []), DATA)
        long_rows = spark.range(0, 800, 1, 1).selectExpr("repeat('x', 20000) as text")
        assert max(r["n"] for r in long_rows.mapInArrow(sizes, "n long").collect()) < 1.1 * BATCH_BYTES


def test_a_worker_forgets_the_words_of_a_task():
    """A Python worker lives on through other stages, beside others."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = [r for part in sentencepiece_codec._encoded([batch], path, ["decoded"]) for r in part.column("decoded").to_pylist()]
    assert out == texts
    assert len(sentencepiece_codec.codec(path).known) <= 50_000
