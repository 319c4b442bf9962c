from collections import Counter

import numpy as np

from cardwarden.llm import weighted_sampling as ws
from cardwarden.llm.queries import op9_fingerprints
from tests.llm.conftest import sha


def weights(text):
    return {w: n * len(w.encode()) for w, n in Counter(w.decode() for w in (text or "").encode().lower().split()).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys) if keys else 1.0


def check(df, rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else ws.FIRST_ID), r[1] is not None, r[1] or ""))
    got = ws.fingerprint_rows(df).collect()
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = ws.edited(t, n)
        p, q, r = ws.signatures([t, e, n])
        want.append((d, len(t), sha(e), p.astype(">u2").tobytes().hex(), q.astype(">u2").tobytes().hex(), float((p == q).mean()), float((p == r).mean())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_small_table(spark, small):
    check(small, [(r.doc_id, r.text) for r in small.collect()])
    rows = op9_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == small.count()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_edge_rows(documents):
    check(documents([(1, "one")]), [(1, "one")])
    rows = [(None, "last é text here"), (5, None), (4, ""), (4, "tie a"), (3, "x"), (-7, "é" * 10), (9, "long word " * 40_000), (9, "long word " * 40_000)]
    check(documents(rows), rows)
    assert ws.fingerprint_rows(documents([])).count() == 0


def test_collision_rate_is_the_weighted_similarity():
    rng = np.random.default_rng(4)
    vocabulary = ["w" * n + str(i) for i in range(60) for n in (1, 3)]
    errors = []
    for _ in range(40):
        a = list(rng.choice(vocabulary, 80))
        b = a[: rng.integers(10, 80)] + list(rng.choice(vocabulary, rng.integers(1, 60)))
        a, b = " ".join(a), " ".join(b)
        p, q = ws.signatures([a, b], 2048)
        errors.append((p == q).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.02


def test_empty_is_like_empty_only():
    p = ws.signatures(["", None, " \n", "a"])
    assert (p[0] == p[1]).all() and (p[0] == p[2]).all() and not (p[0] == p[3]).any()


def test_a_hot_id_is_split(spark, documents):
    """One id has most rows, some of them the same: every row is compared once, in many tasks."""
    from pyspark.sql import functions as F

    rows = [(7, f"text {i % 150:03d} of the hot id") for i in range(400)] + [(None, "same")] * 300 + [(i, f"own {i}") for i in range(8, 20)]
    df = documents(rows)
    check(df, rows)
    # Without merging small parts: so many would be large.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = ws._in_order(df, "doc_id", "text").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in tasks) < 0.5 * len(rows) and len(tasks) == 4


def scalar_samples(text, samples):
    """The samples of a text, one term and one sample at a time, by the published formulas."""
    import math

    from cardwarden.llm.substrings import _mix, _range_hash

    mask, out = (1 << 24) - 1, []
    mix = lambda x: int(_mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    uniform = lambda bits, shift: ((bits >> shift & mask) + 0.5) / (1 << 24)
    for k in range(1, samples + 1):
        best = None
        for word, weight in weights(text).items():
            data = np.frombuffer(word.encode(), np.uint8)
            term = int(_range_hash(data, np.array([0]), np.array([len(data)]))[0])
            first = mix(term ^ k * 0xD1B54A32D192ED03 & (1 << 64) - 1)
            second = mix(first + 0x9E3779B97F4A7C15)
            third = mix(second + 0x9E3779B97F4A7C15)
            # Gamma(2, 1) variables as sums of two exponential ones, and a uniform offset.
            r = -math.log(uniform(first, 40) * uniform(first, 16))
            c = -math.log(uniform(second, 40) * uniform(second, 16))
            beta = uniform(third, 40)
            t = math.floor(math.log(weight) / r + beta)
            a = math.log(c) - r * (t - beta) - r
            if best is None or a < best[0]:
                best = a, word, t
        out.append(best[1:])
    return out


def test_samples_equal_where_the_scalar_ones_do():
    """The same (term, step) in two texts by the plain formulas gives the same 16 bits, and others almost never."""
    texts = ["one two three three four", "one two three four four five", "six seven one one one", "One TWO three three four"]
    plain = [scalar_samples(t, 48) for t in texts]
    prints = ws.signatures(texts, 48)
    for i in range(len(texts)):
        for j in range(i):
            same = np.array([a == b for a, b in zip(plain[i], plain[j], strict=True)])
            assert ((prints[i] == prints[j]) == same).mean() > 0.97
    assert (prints[0] == prints[3]).all()
