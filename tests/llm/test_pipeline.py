import corpus_pipeline as pipeline
from cardwarden.llm import language
from sentencepiece import SentencePieceProcessor

from tests.llm import test_contamination, test_simhash, test_substrings
from tests.llm.conftest import sha
from tests.llm.test_sentence_pieces import PATH

SF = "/root/testdata/sf0.001"
LIBRARY = SentencePieceProcessor(model_file=PATH)


def test_stages_have_effect_and_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = language.train(docs.where(~language.held_out()))
    rejected = {r.doc_id for r in language.identify(docs, model).where("rejected").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    left = {d: t for d, t in rows.items() if d not in rejected}
    groups, _ = test_simhash.brute(sorted(left.items()))
    left = {d: left[d] for d, _, c in groups if d == c}
    out = test_substrings.brute(sorted(left.items()))
    words = {d: n for d, n, _, _ in out}
    gone = {d: n for d, _, n, _ in out}
    digests = {d: s for d, _, _, s in out}
    after = None
    for name, function in pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_dedup":
            assert after == left and len(left) < len(rows)
        if name == "substring_dedup":
            assert after.keys() == {d for d in left if not gone[d] or gone[d] < words[d]}
            for d, t in after.items():
                assert t == left[d] if not gone[d] else sha(t) == digests[d]
            cut = after
        if name == "decontaminate":
            hits = {d for d, _, h, _ in test_contamination.brute(sorted(cut.items()), items) if h}
            assert after == {d: t for d, t in cut.items() if d not in hits} and hits
    last = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == after.keys() and all(r.round_trip for r in last)
    assert all(r.ids_sha256 == sha(",".join(map(str, LIBRARY.encode(after[r.doc_id])))) for r in last)


def test_edge_rows_pass_all_stages(spark, documents, tmp_path):
    rows = [(1, "the of and to in " * 30, "en"), (1, "der die das und ist " * 30, "de"), (1, "der die das und ist " * 30, "de"), (2, None), (3, ""), (None, "the and of to is", "en"), (5, "12 34")]
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = documents(given)
        for _, function in pipeline.STAGES:
            names = docs.columns
            docs = function(spark, docs, str(tmp_path))
            if function is not pipeline.sentence_pieces:
                assert docs.columns == names
        got = sorted(((r.doc_id, r.round_trip) for r in docs.collect()), key=str)
        assert got == ([(1, True), (1, True), (None, True)] if given else [])


def test_near_dedup_keeps_texts_that_only_share_an_id(spark, documents):
    texts = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "abcdefgh"}
    rows = [
        (3, texts["a"]), (5, texts["a"]), (5, texts["b"]), (5, texts["c"]), (5, texts["c"]), (5, texts["d"]), (6, texts["d"]),
        *[(7, texts[c]) for c in "efgh"], (7, texts["e"].upper()), (None, texts["a"]), (None, texts["a"]),
    ]
    docs = documents(rows)
    got = [(r.doc_id, r.text.lower()) for r in pipeline.near_dedup(spark, docs, SF).collect()]
    want = [(3, "a"), *[(5, c) for c in "bcd"], *[(7, c) for c in "efgh"], (None, "a"), (None, "a")]
    assert sorted(got, key=str) == sorted([(d, texts[c]) for d, c in want], key=str)
    assert pipeline.near_dedup(spark, documents([]), SF).count() == 0
