from collections import defaultdict

import pytest
from cardwarden.llm import line_dedup

from tests.llm.conftest import sha

LONG = "a line that is long enough"


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        gone = [d is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d < max(holders[key(x)]) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def test_given_documents(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    want = sorted(brute(rows), key=str)
    assert found(line_dedup.drop_lines(small)) == want and sum(r[2] for r in want) > 0


def test_edge_rows(documents):
    rows = [
        (1, f"{LONG}\nown of one\n{LONG}"), (2, f"  {LONG.upper()}\t\nown of two"), (3, f"{LONG}\r\n\n{LONG}"), (4, None), (5, ""), (6, "\n"), (7, "\n\n"),
        (None, LONG), (None, LONG), (1, f"{LONG}\nown of one\n{LONG}"), (1, f"x\n{LONG}"),
        # Short keys, by code points and not bytes; 19 and 20 of them.
        *[(i, "short\n" + "é" * 19 + "\n" + "é" * 20) for i in (10, 11, 12)],
        # A-Z alone have lower case: these are three keys.
        (13, "ÉTAGE " * 5), (14, "étage " * 5), (15, "Étage " * 5),
        # U+00A0 is no white space of a key.
        (16, f" {LONG}"), (17, f"{LONG} "), (18, "\0" + LONG),
    ]
    assert found(line_dedup.drop_lines(documents(rows))) == sorted(brute(rows), key=str)


def test_rows_of_one_id_are_one_document(documents):
    rows = [(1, LONG), (1, f"{LONG}\nb"), (1, f"{LONG}\nc"), (2, LONG)]
    assert all(r[2] == 0 for r in found(line_dedup.drop_lines(documents(rows))))
    assert sum(r[2] for r in found(line_dedup.drop_lines(documents([*rows, (3, LONG)])))) == 4


def test_repeated_rows_and_a_line_of_all(documents):
    rows = [(i % 50, f"{LONG}\nrow {i % 50} has a line of its own") for i in range(600)]
    assert found(line_dedup.drop_lines(documents(rows))) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("chars, least", [(1, 2), (5, 4)])
def test_thresholds(documents, chars, least):
    rows = [(i, "\n".join("abcdefgh"[:k] for k in range(i % 9 + 1))) for i in range(30)]
    want = defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            want[line].add(d)
    go = {x for x, who in want.items() if len(x) >= chars and len(who) >= least}
    got = {r[0]: r[2] for r in found(line_dedup.drop_lines(documents(rows), least_chars=chars, least_documents=least))}
    assert got == {d: sum(x in go and d < max(want[x]) for x in text.split("\n")) for d, text in rows}


def test_empty_table(documents):
    assert found(line_dedup.drop_lines(documents([]))) == []


def test_long_texts(documents):
    """One line of 30 MB, and a million lines."""
    line = "x" * 30_000_000
    many = "\n".join(f"{LONG} {i}" for i in range(1_000_000))
    rows = [(1, line), (2, line), (3, line), (4, many), (5, f"{LONG} 7\n{LONG} 8"), (6, f"{LONG} 8")]
    got = [(r[0], r[1], r[2], sha(r[3])) for r in found(line_dedup.drop_lines(documents(rows)))]
    left = many.replace(f"\n{LONG} 8\n", "\n")
    assert got == [(1, 1, 1, sha("")), (2, 1, 1, sha("")), (3, 1, 0, sha(line)), (4, 1_000_000, 1, sha(left)), (5, 2, 1, sha(f"{LONG} 7")), (6, 1, 0, sha(f"{LONG} 8"))]
