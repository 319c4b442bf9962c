import hashlib
import re

import pytest

from cardwarden.llm import contamination
from cardwarden.llm.queries import op8_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    windows = [(i, tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, pattern in windows:
            n = len(pattern)
            for k in range(len(w) - n + 1):
                if w[k] == pattern[0] and tuple(w[k : k + n]) == pattern:
                    hit.update(range(k, k + n))
                    if i is not None:
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def scanned(df, items):
    return sorted(((r[0], r.n_words, r.n_hit, list(r["items"])) for r in contamination.scan(df, items).collect()), key=str)


ROWS = [
    (1, None), (2, ""), (3, "Ab-c d3 é x"), (4, "The quick brown FOX jumps over the lazy dog again, and then some"),
    (4, "ab c"), (None, "ab c"), (5, "xab c"), (6, "ab c " * 3000), (7, "a b " * 9), (8, "KK ab\x00c"),
]
ITEMS = [
    (10, "the quick brown fox jumps over the lazy dog again and"), (9, "AB c!"), (2, "ab-C"), (None, "d3"),
    (7, None), (8, "?!"), (3, "a b a b a b a b a b a"),
]


@pytest.mark.parametrize("patterns", [1, contamination.PATTERNS])
def test_edge_rows_in_one_and_in_many_blocks(spark, documents, monkeypatch, patterns):
    monkeypatch.setattr(contamination, "PATTERNS", patterns)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert scanned(documents(ROWS), items) == brute(ROWS, ITEMS)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert scanned(documents(ROWS), none) == brute(ROWS, [])
    assert scanned(documents([]), none) == []


def test_spans_point_at_the_original(spark, documents):
    items = spark.createDataFrame([(1, "c d")], "item_id long, text string")
    text = "é b -- C,\nD e"
    row = contamination.scan(documents([(1, text)]), items, carry=True).first()
    assert [text[s.start : s.end] for s in row.spans] == ["C,\nD"] and row.row.text == text


def test_query_on_the_whole_table(spark, small):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([(r.doc_id, r.text) for r in small.collect()], items)
    got = op8_contamination(spark, sf).collect()
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted(((d, n, h, len(i), digest(i), h > 0) for d, n, h, i in want), key=str)
    assert any(r.contaminated for r in got)
