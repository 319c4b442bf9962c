import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from cardwarden.llm import sentence_pieces as sp
from cardwarden.llm.queries import op10_sentence_pieces
from tests.llm.conftest import sha

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)

TEXTS = [
    None, "", " ", "  a  b  ", "Hello world\n\tfoo é ́", "▁x ▁▁ y", "日本語한국어 😀😀", "<0x0A> <s> </s> <unk>", "a" * 500,
    " \n " * 5, "=" * 90 + "-" * 70, "\x00\x01 ", "don't www.example.com/a_b?c=d", " " * 40 + "x", "ⅷ½́", "long " * 40_000, "é" * 2000,
]


def test_edge_texts(documents):
    rows = [(i // 2, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (1, "x"), (1, "x")]
    encoded = sp.encode(documents(rows).drop("source"), PATH)
    assert "text" not in encoded.columns and "shard" in encoded.columns
    back = sp.decode(encoded, PATH).collect()
    want = sorted(((d, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in back), key=str) == want
    assert sp.decode(sp.encode(documents([]), PATH), PATH).count() == 0


def test_query_on_the_whole_table(spark, small):
    got = {r.doc_id: (r.n_ids, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in op10_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for r in small.collect():
        ids = LIBRARY.encode(r.text)
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(r.text), True)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeinorst h▁=\n.,0éÉ日😀'"), max_size=50), max_size=6))
def test_random_texts(texts):
    model = sp.pieces(PATH)
    ids, counts = model.encode(texts)
    assert ids.tolist() == [i for t in texts for i in LIBRARY.encode(t)] and counts.tolist() == [len(LIBRARY.encode(t)) for t in texts]


@pytest.mark.parametrize("name", ["WORDS", "PAIRS"])
def test_what_is_kept_may_be_dropped(monkeypatch, name):
    monkeypatch.setattr(sp, name, 3)
    model = sp.Pieces(PATH)
    for t in TEXTS[:-2]:
        assert model.encode([t])[0].tolist() == LIBRARY.encode(t or "")
