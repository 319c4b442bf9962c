import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cardwarden.llm import substrings
from cardwarden.llm.fm_index import FMIndex, WaveletMatrix
from cardwarden.llm.queries import op4_substrings
from tests.llm.conftest import sha

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=50):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if d is not None and least[tuple(w[k : k + width])] < d:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in substrings.deduplicate(df, **options).collect()), key=str)


def planted(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    line = " ".join(word() for _ in range(20))
    rows = []
    for d in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 90)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice([*passages, line, line]), " ".join(word() for _ in range(rng.randint(0, 60)))]
        rows.append((d, "\n".join(parts)))
    rows += [(100 + d, rows[d][1]) for d in range(0, 20, 3)]
    return rows


EDGES = [
    (None, "x " * 60), (None, None), (1, None), (1, ""), (7, "x " * 60), (7, "x " * 60), (7, "x " * 70 + "y"), (9, "x " * 50),
    (10, "a b " * 4000), (11, "a b " * 3000), (12, " ".join(f"é{i}" for i in range(50))), (13, "q\x1cz " + " ".join(f"é{i}" for i in range(50))),
    (14, " ".join(f"é{i}" for i in range(49))),
]


@pytest.mark.parametrize("options", [{}, {"heavy": 2, "shard_words": 40}, {"heavy": 0}])
def test_planted_passages(documents, options):
    rows = planted()
    got = result(documents(rows), **options)
    assert got == brute(rows) and sum(r[2] > 0 for r in got) > 20


@pytest.mark.parametrize("rows", [EDGES, [], [(1, None)], [(2, "a b c")]])
def test_edge_rows(documents, rows):
    assert result(documents(rows)) == brute(rows)


def test_kept_text_comes_along(documents):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "head " + " ".join(f"w{i}" for i in range(60)) + "\ttail")]
    kept = {r.doc_id: (r.kept, r.row.text) for r in substrings.deduplicate(documents(rows), carry=True).collect()}
    assert kept[2] == ("head tail", rows[1][1]) and kept[1][0] == rows[0][1]


def test_query_on_the_whole_table(spark, small):
    got = op4_substrings(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_extending_counts_smaller_symbols_and_occurrences():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 16, 17, 300):
        symbols = rng.integers(0, alphabet, 777)
        tree = WaveletMatrix(symbols, alphabet)
        ask, place = rng.integers(0, alphabet, 200), rng.integers(0, 778, 200)
        want = [int((symbols < c).sum() + (symbols[:p] == c).sum()) for c, p in zip(ask, place, strict=True)]
        assert tree.extend(ask, place).tolist() == want


def occurrences(lists, run):
    return {(i, k) for i, ws in enumerate(lists) for k in range(len(ws) - len(run) + 1) if ws[k : k + len(run)] == run}


@pytest.mark.parametrize("depth", [1, 2, 5, 6, 8])
@pytest.mark.parametrize("alphabet", [2, 4, 9])
def test_matching_statistics(depth, alphabet):
    rng = np.random.default_rng(depth)
    sizes, asked = rng.integers(1, 40, 30), rng.integers(1, 40, 30)
    words, stream = rng.integers(1, alphabet, sizes.sum()), rng.integers(1, alphabet + 1, asked.sum())
    index = FMIndex(words, sizes, depth, owners=True)
    length, lo, hi = index.statistics(stream, asked)
    lists = [ws.tolist() for ws in np.split(words, np.cumsum(sizes)[:-1])]
    first = index.least_owner(lo, hi)
    at = 0
    for ws in np.split(stream, np.cumsum(asked)[:-1]):
        for k in range(len(ws)):
            m = next(m for m in range(min(depth, len(ws) - k), -1, -1) if m == 0 or occurrences(lists, ws[k : k + m].tolist()))
            assert length[at] == m
            if m:
                found = occurrences(lists, ws[k : k + m].tolist())
                assert hi[at] - lo[at] == len(found) and first[at] == min(i for i, _ in found)
            at += 1


def test_an_index_takes_less_room_than_its_words():
    rng = np.random.default_rng(1)
    words, sizes = rng.integers(1, 1 << 15, 80 * 3000), np.full(3000, 80)
    assert FMIndex(words, sizes, 50).nbytes() < 4 * len(words)


@pytest.mark.parametrize("window", [2, 5, 8])
def test_least_weights(window):
    rng = np.random.default_rng(window)
    lists, anchors = [], []
    for a in range(12):
        core = [100 + a, *rng.integers(1, 4, window - 1).tolist()]
        for _ in range(int(rng.integers(1, 40))):
            lists.append([*rng.integers(1, 3, rng.integers(0, window)).tolist(), *core, *rng.integers(1, 3, rng.integers(0, window)).tolist()])
            anchors.append(a)
    weights = rng.permutation(len(lists)) // 2
    sizes = np.array([len(ws) for ws in lists])
    own = lambda ws, k: 100 <= max(ws[k : k + window]) if k + window <= len(ws) else False
    least = {}
    for w, ws in zip(weights, lists, strict=True):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            least[key] = min(least.get(key, 999), w)
    got = substrings.least_weights(np.concatenate(lists), sizes, np.array(anchors), weights, rng.random(len(lists)) < 0.5, window)
    at = 0
    for ws in lists:
        for k in range(len(ws)):
            # A window without an anchor's word may stand under several anchors, which the operator rules out.
            if own(ws, k):
                assert got[at] == least[tuple(ws[k : k + window])]
            at += 1


def test_segments_hold_every_window_once():
    rows = planted(8)
    found = substrings.segments_of(pa.array([t for _, t in rows]))
    seen = sorted((int(r), int(s) + k) for r, s, n in zip(found["row"], found["start"], found["n"], strict=True) for k in range(n))
    assert seen == [(i, k) for i, (_, t) in enumerate(rows) for k in range(max(0, len(t.split()) - 49))]
