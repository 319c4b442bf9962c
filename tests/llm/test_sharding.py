from collections import defaultdict

import numpy as np
import pytest

from cardwarden.llm import sharding
from tests.llm.conftest import crc


def check(df, rows, shards=16):
    got = sharding.shard_rows(df, shards=shards).collect()
    want = sorted(((d, len((t or "").encode()) + 1, crc(t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    slots, texts = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert texts.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < shards for r in got)
    sums = np.zeros(shards)
    for r in got:
        sums[r.shard] += r["size"]
    return sums


def test_whole_small_table_is_balanced(small):
    sums = check(small, [(r.doc_id, r.text) for r in small.collect()])
    assert sums.max() <= 1.1 * sums.mean()


def test_many_rounds(small, monkeypatch):
    monkeypatch.setattr(sharding.assign, "__defaults__", (16, 7))
    sums = check(small, [(r.doc_id, r.text) for r in small.collect()])
    assert sums.max() <= 1.3 * sums.mean()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, "é"), (2, "é"), (None, "x")], [(i, "same") for i in range(50)] + [(99, "long " * 50_000)]])
def test_edge_rows(documents, rows):
    check(documents(rows), rows)


def test_difference_beats_rounds_of_dealing():
    rng = np.random.default_rng(3)
    sizes = rng.lognormal(8, 1, 600).astype(np.int64)
    total, went = sharding.difference(np.pad(sizes[:, None], ((0, 0), (0, 15))))
    assert total.sum() == sizes.sum() and total.max() - total.min() <= 0.001 * sizes.sum() / 16
    again = np.zeros(16, np.int64)
    np.add.at(again, went[:, 0], sizes)
    assert (again == total).all()
    assert all(sorted(w) == list(range(16)) for w in went.tolist())
