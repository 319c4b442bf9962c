import zlib

import pytest
from cardwarden.llm import merkle, queries
from cardwarden.llm.queries import merkle_rows
from pyspark.sql import functions as F

from tests.llm.conftest import sha

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def leaf_of(row):
    d, text, lang, source, n = row
    values = [d, source, lang, n, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The top of a tree and the siblings of each leaf on the way up, as (before, after)."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, all_ = [], []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = climb([leaf_of(r) for r in own])
        tops.append(top)
        all_.append((own, paths))
    root, above = climb(tops) if tops else (None, [])
    out = []
    for top, more, (own, paths) in zip(tops, above, all_, strict=True):
        for row, path in zip(own, paths, strict=True):
            leaf, path = leaf_of(row), path + more
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                node = leaf_of((row[0], row[1].encode().lower().decode(), *row[2:]))
            for a, b in path:
                node = sha(a + node + b)
            out.append((row[0], leaf, top, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_given_documents(spark, small):
    want = brute(rows_of(small))
    got = found(queries.op13_merkle(spark, "/root/testdata/sf0.001"))
    assert got == sorted(want, key=str) and 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (8, 9), (64, 65, 63), (513, 512, 1), (4097, 5, 520)])
def test_sizes_round_the_stored_levels(documents, sizes):
    rows = [(d * 7 + k, f"Text {d}", f"l{k}") for k, n in enumerate(sizes) for d in range(n)]
    df = documents(rows)
    assert found(merkle_rows(df)) == sorted(brute(rows_of(df)), key=str)


def test_many_trees(documents):
    rows = [(d, "A", f"l{d}") for d in range(600)] + [(d, "b", f"l{d}") for d in range(0, 600, 7)]
    df = documents(rows)
    assert found(merkle_rows(df)) == sorted(brute(rows_of(df)), key=str)


def test_edge_rows(documents):
    rows = [
        (1, "A"), (1, "A"), (1, "B"), (None, "A"), (None, None), (2, None, None), (3, "", ""), (4, "ÉA", "é"), (5, "x", "\U0001f600"), (6, "x", "￿"), (7, "x", "z"), (-3, "Neg", None),
        *[(9, "same", "hot")] * 200,
    ]
    df = documents(rows)
    assert found(merkle_rows(df)) == sorted(brute(rows_of(df)), key=str)


def test_empty_table(documents):
    assert found(merkle_rows(documents([]))) == []


def test_long_text(documents):
    rows = [(0, "Long Text " * 3_000_000), (1, "x")]
    df = documents(rows)
    assert found(merkle_rows(df)) == sorted(brute(rows_of(df)), key=str)


def test_carried_columns_and_another_order(spark):
    rows = spark.range(100).select(F.lit("t").alias("tree"), (-F.col("id")).alias("by"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("left_over"))
    got = merkle.manifest(rows, ["by"], ["left_over"]).orderBy("pos").collect()
    assert [r.left_over for r in got] == list(range(99, -1, -1))
    top, paths = climb([sha(str(i)) for i in range(99, -1, -1)])
    assert all(r.root.hex() == top and list(zip(r.left, r.right, strict=True)) == p for r, p in zip(got, paths, strict=True))
