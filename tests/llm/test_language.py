import zlib

import numpy as np
import pyarrow as pa

from cardwarden.llm import language
from cardwarden.llm.queries import op7_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark, documents):
    rows = [(1, "der die das und ist", "de"), (2, "the and of is that", "en"), (3, None), (4, ""), (5, "12 !?"), (None, "the and"), (2, "the and of is that", "en"), (7, "the of " * 50_000, "en"), (8, "und der", None)]
    df = documents(rows)
    model = language.train(df)
    assert model.languages == ["de", "en"]
    found = {(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(df, model, carry=True).collect()}
    assert {(3, "und", True), (4, "und", True), (5, "und", True)} <= found
    assert {(1, "de", False), (2, "en", False), (7, "en", False), (None, "en", False), (8, "de", False)} <= found
    assert language.identify(documents([]), model).count() == 0


def test_no_labels_and_one_language(documents):
    none = language.train(documents([(1, "a", None), (2, None, "en")]))
    assert none.predict(pa.array(["abc", None]))[0] == ["und", "und"]
    one = language.train(documents([(1, "a", "en")]))
    assert one.predict(pa.array(["abc", None]))[0] == ["en", "und"]


def test_subwords_stay_inside_words():
    points, bounds = language.code_points(pa.array(["Ab c", "", None, "d"]))
    grams = list(language.subwords(points, bounds))
    edges = bounds + range(len(bounds))
    count = [int(v[edges[0] : edges[1]].sum()) for _, v in grams]
    # "<ab>" and "<c>": letters; pairs <a ab b> <c c>; triples <ab ab> <c>
    assert count == [3, 5, 3]


OTHERS = [
    "Сегодня утром в городе прошёл сильный дождь, и многие улицы оказались затоплены водой.", "Вчера мы ходили в театр и смотрели новую пьесу известного автора.",
    "今日は朝から雨が降っていて、電車がとても混んでいました。", "昨日友達と新しい映画を見に行きました。とても面白かったです。",
    "Wczoraj wieczorem poszliśmy na długi spacer wzdłuż rzeki, żeby zobaczyć zachód słońca.", "Dziękuję bardzo za wszystkie książki, które przysłałeś mi w zeszłym tygodniu.",
    "Bugün hava çok güzel olduğu için çocuklarla birlikte parkta uzun bir yürüyüş yaptık.", "Yarın sabah erkenden kalkıp köydeki büyükannemizi ziyaret edeceğiz.",
]


def test_rejection_is_calibrated(spark):
    """Of held-out texts few are rejected; sentences of languages that were not learned are, whatever their score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    assert 0.001 < model.heat < 20 and 0 < model.least < 1 and 0 <= model.usual < 0.2
    held = [r.text for r in docs.where(language.held_out()).where("text rlike '[a-z]'").collect()]
    _, _, rejected = model.predict(pa.array(held))
    assert rejected.mean() <= 0.02
    _, score, rejected = model.predict(pa.array(OTHERS))
    assert rejected.mean() >= 0.9 and score.max() > 0.4


def test_every_label_is_learned():
    assert language.quotas({"a": 1_000_000, "b": 3, "c": 700}, 900) == {"b": 3, "c": 449, "a": 448}
    assert sum(language.quotas({str(i): 10 for i in range(7)}, 30).values()) == 30
    assert language.quotas({"a": 5}, 900) == {"a": 5} and language.quotas({}, 9) == {}


def test_a_rare_language_is_in_the_sample(spark, documents):
    rows = [(i, f"the of and number {i} is to be", "en") for i in range(400)] + [(1000 + i, f"der die das nummer {i} ist und", "de") for i in range(3)]
    model = language.train(documents(rows), rows=40)
    assert model.languages == ["de", "en"]
    assert model.predict(pa.array(["und das ist der", "the number is of"]))[0] == ["de", "en"]


def test_long_texts_are_taken_in_steps(monkeypatch):
    """The same sums, counts and bags in one step and in many."""
    text = "The quick 12 fox über den Zäunen, naïve! " * 300 + "a"
    table = np.random.default_rng(3).normal(size=(language.BUCKETS, 4))
    mean, count, letters = language.mean_rows(table, pa.array([text]))
    bag = language.bags_of(pa.array([text]))[0]
    for step in (1, 2, 3, 7, 100, 4999, len(text) - 1):
        monkeypatch.setattr(language, "STEP", step)
        other, n, _ = language.mean_rows(table, pa.array([text]))
        assert n[0] == count[0] and np.allclose(mean, other)
        ids, counts = language.bags_of(pa.array([text]))[0]
        assert (ids == bag[0]).all() and (counts == bag[1]).all()
        if step > 50:
            break_ = language.mean_rows(table, pa.array([text, "short"]))
            assert np.allclose(break_[0][0], mean[0])


def test_softmax_scores_by_brute_force():
    """Subwords one by one in a dictionary, and a plain softmax of their mean."""
    model = language.Model(["x", "y"], np.random.default_rng(5).normal(size=(language.BUCKETS, 2)))
    model.heat = 0.5
    for text in ("Ab c", "hello wörld 42 x", "a"):
        points, bounds = language.code_points(pa.array([text]))
        buckets = [int(b) for ids, valid in language.subwords(points, bounds) for b, v in zip(ids, valid, strict=True) if v]
        mean = np.mean([model.table[b, :2].astype(float) for b in buckets], axis=0) / 0.5
        chance = np.exp(mean) / np.exp(mean).sum()
        names, score, _ = model.predict(pa.array([text]))
        assert names == [["x", "y"][int(chance.argmax())]] and abs(score[0] - chance.max()) < 1e-6
