import hashlib
import random
import zlib

import pytest
from cardwarden.llm import conversation_trie, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes as a dictionary of starts, by the contract and nothing else."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()[:32]
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], digest(t)))] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt = tuple(own.get(leader, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append((c, len(rebuilt) == d))
    children, subtree = {}, {}
    for node, who in members.items():
        children[node] = 0
        for d in range(len(node) + 1):
            subtree.setdefault(node[:d], []).append((node, (len(who) - 1) * len(words(node[-1][1]) if node else [])))
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c, end in sorted(who) if end)
        parent = min(members[node[:-1]])[0] if node else None
        below = subtree[node]
        out.append((min(who)[0], len(node), parent, len(who), children[node], sum(not children[v] for v, _ in below), sum(s for _, s in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def found(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


@pytest.fixture(scope="session")
def conversations(spark):
    def build(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return df.select("*", *[F.lit("x").alias(c) for c in ("conv", "path", "words", "group", "turns", "digest", "key", "depth", "kind")])

    return build


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(found(queries.op11_conversation_trie(spark, SF)), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("ranges", [1, 2, 13])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_in_any_number_of_ranges(spark, conversations, ranges, seed):
    """Few different turns, so paths branch at all depths; copies, ends inside paths, and lengths beyond several matrices."""
    draw = random.Random(seed)
    rows = []
    for c in range(150):
        n = draw.choice([0, 1, 2, 5, 9, 20, 60])
        if n == 0:
            rows.append((c, None, None, None))
        depth = [draw.choice("ab") if draw.random() < 0.2 else "a" for _ in range(n)]
        rows += [(c, i, "user", f"{t} {i} é\t" * (i % 4)) for i, t in enumerate(depth)]
    got = conversation_trie.trie(queries.branched(conversations(rows)), ranges=ranges)
    assert sorted(found(got), key=str) == sorted(brute(rows), key=str)


def test_one_sequence_for_most_conversations_is_cut_into_ranges(spark, conversations, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = [(c * 20, t, "user", f"hello {t}") for c in range(300) for t in range(4)] + [(c * 20 + 7, 0, "user", "other") for c in range(40)]
    got = conversation_trie.trie(queries.branched(conversations(rows)), ranges=9)
    assert sorted(found(got), key=str) == sorted(brute(rows), key=str)


def test_edge_rows(spark, conversations):
    rows = [
        (None, 1, "user", "nobody's turn"), (1, None, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "", ""), (2, 1, "system", "tie"), (2, 1, "user", "tie"),
        (-5, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, "user", "  "), (3, 1, "us", "er"), (4, 1, "user", ""), (9_000_000_000_000_000_000, 1, "user", "x"),
    ]
    got = found(conversation_trie.trie(queries.branched(conversations(rows))))
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_no_conversations_have_no_nodes(spark, conversations):
    assert found(conversation_trie.trie(queries.branched(conversations([])))) == []
    assert found(conversation_trie.trie(queries.branched(conversations([(None, 1, "user", "x")])))) == []


def test_conversations_without_turns_end_in_the_root(spark):
    paths = spark.createDataFrame([(3, b"", []), (4, b"", [])], "conv long, path binary, words array<int>")
    ends = hashlib.sha256(b"3,4").hexdigest()
    assert found(conversation_trie.trie(paths, ranges=2)) == [(3, 0, None, 2, 0, 1, 0, ends)]


def test_long_conversation_and_long_text(spark, conversations):
    rows = [(0, t, "user", f"w{t} " * 2) for t in range(3000)] + [(20, t, "user", f"w{t} " * 2) for t in range(2990)]
    rows += [(40, 0, "user", "long text " * 3_000_000)]
    got = found(conversation_trie.trie(queries.branched(conversations(rows)), ranges=3))
    root = next(r for r in got if r[1] == 0)
    assert len(got) == 3002 and root[3:6] == (3, 2, 2) and root[6] == 2 * 2990
    assert max(r[1] for r in got) == 3000
