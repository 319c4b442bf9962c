import os

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cardwarden.llm import bpe_transducer as bt
from cardwarden.llm.queries import op1_token_counts
from cardwarden.llm.token_counts import count_tokens, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


TEXTS = [
    None, "", " \n", "Don't I'll we're they'VE 'very ''s !!'s it'd'm", "<|startoftext|>a<|endoftext|>b c", "<|startoftext",
    "İstanbul ΑΣ ΣΑΣ ß é é 한국어 日本語 123 4½ ٣ ​x\u0085y", "aaaa" * 30 + "!" * 40, "a\x1cb \x00 \x7f", "😀😀 👍🏽 " * 5,
    "'", "''", "'r", "'re", "x'r e 'l 'll'll", "Ǆ Ŀ ﬁ ſ K Å", "word " * 40_000, "x" * 3000,
]


def test_edge_texts(documents):
    rows = [(i // 2, t) for i, t in enumerate(TEXTS)]
    got = count_tokens(documents(rows), PATH).collect()
    want = [(d, len((t or "").encode()), library(t), library(t) > 2048) for d, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    assert count_tokens(documents([]), PATH).count() == 0


def test_query_on_the_whole_table(spark, small):
    got = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: library(r.text) for r in small.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeilnorstv'dm 12!.éÉ́日ÀΣ<|>"), max_size=40), max_size=6))
def test_random_texts(texts):
    assert transducer(PATH).count(texts).tolist() == [library(t) for t in texts]


def test_every_code_point_between_words():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    texts = [" ".join(f"a{chr(c)}b" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    assert transducer(PATH).count(texts).tolist() == [library(t) for t in texts]


def test_states_may_be_dropped(monkeypatch):
    monkeypatch.setattr(bt, "STATES", 5)
    texts = [t for t in TEXTS if t and len(t) < 5000]
    own = bt.Transducer(PATH)
    assert [int(own.count([t])[0]) for t in texts] == [library(t) for t in texts]


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_scan_over_chunks_equals_one_pass(n):
    kinds = np.random.default_rng(n).integers(0, 6, n).astype(np.uint8)
    to, begins = bt._first_machine()
    state, want = 0, []
    for k in kinds:
        want.append(bool(begins[state, k]))
        state = to[state, k]
    assert bt.word_starts(kinds).tolist() == want
