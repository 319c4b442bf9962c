import re

import numpy as np
import xxhash

from cardwarden.llm import simhash


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    return sorted(((d, f"{p:016x}", min(groups[find(i)]) if d is not None else None) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=key), key


def check(df, rows):
    want, key = brute(rows)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=key) == want


def test_whole_small_table(small):
    check(small, [(r.doc_id, r.text) for r in small.collect()])


def test_edge_rows(documents):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (5, None), (4, ""), (9, " \t\n"), (1, "One two"), (1, "one  TWO"), (2, "one"), (None, "one"), (None, None),
        (30, base), (31, base + " tail"), (12, base.replace("word7 ", "other ")), (12, "É\x0bx\x1cy \x85z"), (12, "É\x0bx\x1cy \x85z"),
        (40, "long " * 60_000),
    ]
    check(documents(rows), rows)
    check(documents([]), [])


def test_pairs_on_planes_equal_popcounts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, np.uint64)
    values = np.unique(np.concatenate([base, *[base[:20] ^ np.uint64((1 << a) | (1 << b)) for a, b in rng.integers(0, 64, (12, 2)).tolist()]]))
    rng.shuffle(values)
    for sizes in ([len(values)], [2, 3, 64, 65, len(values) - 134]):
        for radius in (1, 2, 3):
            found = {tuple(sorted(p)) for a, b in simhash.close_pairs(values, np.array(sizes), radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
            want, at = set(), 0
            for n in sizes:
                want |= {(i, j) for i in range(at, at + n) for j in range(i + 1, at + n) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
                at += n
            assert found == want


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    rows = simhash.components(spark.createDataFrame(chain + hub, "u long, v long")).collect()
    assert sorted(map(tuple, rows)) == [(i, 0) for i in range(41)] + [(1000 + i, 1000) for i in range(60)]
