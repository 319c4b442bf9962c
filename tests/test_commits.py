"""The commit log, and the tables kept by it, under replays, races and readers."""

import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden import sources as src
from cardwarden.operators.dictionary import build_dictionary
from cardwarden.sources import commits
from cardwarden.sources.change_tables import change_schema, event_states
from cardwarden.streaming.features import extend_stored, load_dictionary, save_dictionary

VERDICT = T.StructType([T.StructField("txn_num", T.StringType()), T.StructField("txn_status", T.StringType())])


def parallel(*calls):
    """Run the calls at once; their results in order. Errors are raised."""
    results, errors = [None] * len(calls), []

    def run(i, call):
        try:
            results[i] = call()
        except BaseException as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=run, args=(i, c)) for i, c in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return results


@pytest.mark.parametrize("local", [True, False])
def test_a_version_is_made_once(spark, tmp_path, local):
    files = commits.Files(spark, str(tmp_path / "t"))
    assert files.local
    files.local = local
    assert files.create("_log/a", "first") and not files.create("_log/a", "second")
    assert files.read("_log/a") == "first" and files.names("_log") == ["a"]


def test_versions_of_many_writers_have_one_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "PER_FOLDER", 7)
    monkeypatch.setattr(commits, "PER_STATE", 3)

    def write(writer):
        log = commits.CommitLog(spark, str(tmp_path))
        for batch in range(10):
            state = log.state()
            while not log.commit(state, {f"{writer}-{batch}": None}, drop=[f"{writer}-{batch - 1}"], writer=writer, batch_id=batch):
                state = log.state()

    parallel(*[lambda w=w: write(w) for w in "abc"])
    log = commits.CommitLog(spark, str(tmp_path))
    state = log.state()
    assert state.version == 29 and set(state.live) == {"a-9", "b-9", "c-9"} and state.writers == dict.fromkeys("abc", 9)
    assert sorted(log.state(v).version for v in range(30)) == list(range(30))
    # The same from the entries alone.
    replayed = commits.State()
    for v in range(30):
        import json

        replayed.apply(v, json.loads(log.files.read(log._name(v))))
    assert replayed == state
    assert len(log.files.names("_log")) == 5


def test_replays_in_every_interleaving_leave_the_table(spark, tmp_path):
    """Two writers commit two batches each; a replay of any batch at any later point changes nothing."""
    order = [("a", 0), ("b", 0), ("a", 1), ("b", 1)]
    for i, steps in enumerate(sorted(set(itertools.permutations(order)))):
        if steps.index(("a", 0)) > steps.index(("a", 1)) or steps.index(("b", 0)) > steps.index(("b", 1)):
            continue
        target, rows = str(tmp_path / f"{i}"), lambda w, b: spark.createDataFrame([("t", f"{w}{b}")], VERDICT).coalesce(1)
        for n, (writer, batch) in enumerate(steps):
            assert src.append_batch(rows(writer, batch), target, batch, writer)
            for old in steps[: n + 1]:
                assert not src.append_batch(rows(*old), target, old[1], old[0])
        assert src.read_latest(spark, target, VERDICT, "txn_num", []).collect() == [("t", "".join(map(str, steps[-1])))]


def test_a_later_verdict_stands_against_a_replay(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks = {w: src.upsert_sink(target, "txn_num", ["txn_status"], w) for w in "AB"}
    for writer, status in (("A", "REJECTED"), ("B", "AUTHORIZED"), ("A", "REJECTED")):
        sinks[writer](spark.createDataFrame([("t", status)], VERDICT), 0)
    assert src.read_latest(spark, target, VERDICT, "txn_num", []).first()["txn_status"] == "AUTHORIZED"


def test_readers_see_committed_batches_only(spark, tmp_path):
    target = str(tmp_path / "t")
    assert src.read_latest(spark, target, VERDICT, "txn_num", []).count() == 0
    src.append_batch(spark.createDataFrame([("t", "x")], VERDICT), target, 0)
    # Written, as far as it came, and never committed.
    spark.createDataFrame([("u", "y")], VERDICT).write.parquet(f"{target}/writer=batch/batch_id=1")
    assert [r[0] for r in src.read_batches(spark, target, VERDICT).collect()] == ["t"]
    src.append_batch(spark.createDataFrame([("v", "z")], VERDICT), target, 1)
    assert sorted(r[0] for r in src.read_batches(spark, target, VERDICT).collect()) == ["t", "v"]


def test_a_reader_survives_compaction_until_vacuum(spark, tmp_path):
    target = str(tmp_path / "t")
    for batch in range(3):
        src.append_batch(spark.createDataFrame([("t", str(batch))], VERDICT), target, batch)
    before = src.read_latest(spark, target, VERDICT, "txn_num", [])
    assert src.compact(spark, target, VERDICT, "txn_num", []) == 3
    assert before.collect() == [("t", "2")] and src.vacuum(spark, target, 1) == 0
    assert before.collect() == [("t", "2")] and src.vacuum(spark, target, 0) == 3 and src.vacuum(spark, target, 0) == 0
    src.append_batch(spark.createDataFrame([("t", "0")], VERDICT), target, 2)
    assert src.read_latest(spark, target, VERDICT, "txn_num", []).collect() == [("t", "2")]


def test_two_queries_extend_one_dictionary_at_once(spark, tmp_path):
    path = str(tmp_path / "d")
    values = lambda names: spark.createDataFrame([(n,) for n in names], "category string")
    save_dictionary(build_dictionary(values(["a", "b"]), "category", "cat_id"), path)
    batches = {w: [[f"{w}{i}", f"both{i}", "a"] for i in range(3)] for w in "xyz"}
    results = parallel(*[
        lambda w=w: [extend_stored(values(names), path, "category", "cat_id", i, w).collect() for i, names in enumerate(batches[w])] for w in "xyz"
    ])
    entries = {r["category"]: r["cat_id"] for r in load_dictionary(spark, path, "category", "cat_id").collect()}
    assert load_dictionary(spark, path, "category", "cat_id").count() == 2 + 9 + 3
    assert sorted(entries.values()) == list(range(14)) and (entries["a"], entries["b"]) == (0, 1)
    for writer, seen in zip("xyz", results, strict=True):
        for names, rows in zip(batches[writer], seen, strict=True):
            assert set(names) <= {r["category"] for r in rows} and all(entries[r["category"]] == r["cat_id"] for r in rows)
    # A replay, also one that brings a value more, gives the same ids.
    again = extend_stored(values([*batches["x"][0], "late"]), path, "category", "cat_id", 0, "x")
    assert {r["category"]: r["cat_id"] for r in again.collect()} == entries | {"late": 14}


ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("v", T.StringType())])


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    table = src.MergedTable(spark, str(tmp_path), ROW, "k", src.keep_latest(["t"]), buckets=8)
    assert table.read().count() == 0
    rows = [(f"k{i}", 1, "old") for i in range(100)] + [(None, 1, "old"), (None, 2, "older")]
    assert table.merge(spark.createDataFrame(rows, ROW), "w", 0)
    reader, version, before = table.read(), table.version(), dict(table.log.state().live)
    assert len(before) == 8
    assert table.merge(spark.createDataFrame([("k1", 1, "new"), ("k2", 0, "late"), ("k1", 0, "x")], ROW), "w", 1)
    after = table.log.state().live
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2
    files = {b: sorted(p.name for p in (tmp_path / after[b][1]).glob("*.parquet")) for b in after}
    assert all(len(f) == 1 for f in files.values())
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 101 and got["k1"] == "new" and got["k2"] == "old" and got[None] == "older"
    assert {r["k"]: r["v"] for r in reader.collect()}["k1"] == "old"
    assert {r["k"]: r["v"] for r in table.read(version).collect()}["k1"] == "old"
    # A replay, a batch without rows, and the end of the old files.
    assert not table.merge(spark.createDataFrame([("k1", 9, "replay")], ROW), "w", 1)
    assert table.merge(spark.createDataFrame([], ROW), "w", 2) and table.log.state().live == after
    assert table.vacuum(0) == len(changed) and {r["k"]: r["v"] for r in table.read().collect()} == got


def test_merges_at_once_lose_nothing(spark, tmp_path):
    """Four writers add to the same few keys; in every order the sums are those of all batches, each once."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("amount", T.DecimalType(28, 8))])
    batches = {w: [[(f"k{(i * w + j) % 5}", 1, None if j % 7 == 0 else j) for j in range(20)] for i in range(3)] for w in range(1, 5)}

    def work(writer):
        table = src.MergedTable(spark, str(tmp_path), schema, "k", src.add_up, buckets=3)
        for i, rows in enumerate(batches[writer]):
            df = spark.createDataFrame(rows, "k string, n long, amount int").withColumn("amount", F.col("amount").cast("decimal(28,8)"))
            assert table.merge(df, f"w{writer}", i) and not table.merge(df, f"w{writer}", i)

    parallel(*[lambda w=w: work(w) for w in batches])
    want = {}
    for k, n, amount in itertools.chain.from_iterable(itertools.chain.from_iterable(batches.values())):
        a, b = want.get(k, (0, 0))
        want[k] = a + n, b + (amount or 0)
    table = src.MergedTable(spark, str(tmp_path), schema, "k", src.add_up)
    assert {r["k"]: (r["n"], int(r["amount"])) for r in table.read().collect()} == want


DOCUMENT = T.StructType([T.StructField("city", T.StringType()), T.StructField("amt", T.DoubleType())])
EVENT = change_schema(DOCUMENT, T.LongType())


def fold(events):
    """Events one after the other by their place: the documents a collection would have."""
    out, known = {}, {}
    for op, key, at, doc, changed in sorted(set_of(events), key=lambda e: e[2]):
        if op in ("insert", "replace"):
            out[key] = list(doc)
        elif op == "update" and key in out:
            if doc is not None:
                out[key] = list(doc)
            for name, value in (changed or {}).items():
                if name in ("city", "amt"):
                    out[key][("city", "amt").index(name)] = value if name == "city" or value is None else float(value)
        elif op == "delete":
            out.pop(key, None)
    return {k: tuple(v) for k, v in out.items()}


def set_of(events):
    seen = {}
    for e in events:
        seen[(e[1], e[2])] = e
    return list(seen.values())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_a_mixed_feed_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    events, at = [], 0
    for key in (f"k{i}" for i in range(40)):
        alive = False
        for _ in range(draw.randrange(1, 9)):
            at += 1
            kind = draw.choice(["update", "update", "replace", "delete", "whole"]) if alive else "insert"
            doc = (draw.choice("abc"), float(draw.randrange(9)))
            if kind == "whole":
                events.append(("update", key, at, doc, None))
            elif kind == "update":
                events.append((kind, key, at, None, draw.choice([{"city": "new"}, {"amt": "7.5"}, {"amt": None, "city": "both"}, {"other": "x"}, {}])))
            else:
                events.append((kind, key, at, None if kind == "delete" else doc, None))
            alive = kind != "delete"
    want = fold(events)
    arriving = events + draw.sample(events, len(events) // 3)
    draw.shuffle(arriving)
    table = src.change_table(spark, str(tmp_path), DOCUMENT, T.LongType(), buckets=4)
    step = len(arriving) // 3 + 1
    for batch in range(3):
        some = spark.createDataFrame(arriving[batch * step : (batch + 1) * step], EVENT)
        src.apply_changes(table, some, DOCUMENT, "feed", batch)
        src.apply_changes(table, some, DOCUMENT, "feed", batch)
    got = {r["key"]: (r["city"], r["amt"]) for r in src.documents_of(table.read()).collect()}
    assert got == want and 0 < len(got) < 40


def test_edges_of_a_feed(spark, tmp_path):
    table = src.change_table(spark, str(tmp_path), DOCUMENT, T.LongType(), buckets=2)
    batches = [
        [("update", "early", 2, None, {"city": "late"}), ("delete", "gone", 5, None, None), ("insert", None, 1, ("x", 1.0), None), ("insert", "n", None, ("x", 1.0), None), ("drop", "d", 1, None, None)],
        [("insert", "early", 1, ("first", 1.0), None), ("insert", "gone", 1, ("x", 1.0), None), ("update", "gone", 4, None, {"amt": "2"}), ("update", "never", 1, None, {"amt": "2"})],
        [("insert", "gone", 6, (None, None), None), ("update", "early", 3, None, {"amt": "no number"})],
    ]
    for i, rows in enumerate(batches):
        src.apply_changes(table, spark.createDataFrame(rows, EVENT), DOCUMENT, "w", i)
    got = {r["key"]: (r["city"], r["amt"]) for r in src.documents_of(table.read()).collect()}
    assert got == {"early": ("late", None), "gone": (None, None)}
    assert event_states(spark.createDataFrame([], EVENT), DOCUMENT).count() == 0
