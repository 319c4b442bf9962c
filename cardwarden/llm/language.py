"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of one to three code points inside its words, a word being a run of letters in lower case with a
mark at either end. Each is hashed to a row of an embedding table; their mean goes through a
linear softmax. Both are trained by stochastic gradient descent in numpy on the driver, from a sample of at most ``SAMPLE``
labelled texts and ``SAMPLE_BYTES``, in equal parts for all labels as far as they have texts, chosen by a hash of the text.

A fifth of the sample is set aside. It fits the temperature of the softmax, and two limits for rejection: a prediction is rejected if its score is below that of every text
set aside, or if the text has more subwords that were never seen in training, for its length, than any of these. So of texts like the sample one in as many as were set aside is
rejected, on average, by either limit, while a language that was not learned fails the second however sure the softmax is. From a sample of under 500 texts none are set aside, and only texts without letters are rejected.

As the softmax is linear, the product of both tables is sent to the tasks: one short row of logits per bucket, and whether the bucket was seen.

Defined cases: a text that is NULL or without letters is ``und`` with score 0 and rejected; rows without a label are not learned from; with no
labelled rows, or one language, every text with letters gets ``und`` or that language;
repeated rows are repeated, ties of probability go to the first language in order. Extra columns are ignored. A very long text is one row and taken in steps of
``STEP`` code points that overlap by a subword, so a task needs its bytes a few times and not a table of all its subwords.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, code_points, row_sums, slices

SAMPLE = 3000
BUCKETS = 1 << 15
DIM = 16
EPOCHS = 12
RATE = 0.5
GRAMS = 3
#: Bytes of counts of the sample that come to the driver.
SAMPLE_BYTES = 256_000_000
#: One in so many texts of the sample is set aside.
ASIDE = 5
#: Texts set aside that limits can be fitted on; with fewer none are.
LEAST_ASIDE = 100
#: Bytes of the texts that are taken together; each needs some 80 in arrays.
BYTES = 500_000
#: Code points of a text that are taken at a time.
STEP = 500_000
UNKNOWN = "und"
MARK = 32
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: its lower case if it is a letter, else the mark between words."""
    table = np.full(0x110000, MARK, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def subwords(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the bucket at every place and whether a subword of one word starts there.

    Texts are set apart by marks: place ``i`` of row ``r`` is at ``i + r + 1``.
    """
    low = np.full(len(points) + len(bounds), MARK, np.uint32)
    place = np.arange(len(points)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 1
    low[place] = _letters()[points]
    mark = low == MARK
    state = np.zeros(len(low), np.uint32)
    inner = np.zeros(len(low), bool)
    for n in range(GRAMS):
        end = len(low) - n
        state = (state[:end] ^ low[n:]) * _MIX[n % 3]
        state ^= state >> np.uint32(15)
        # Marks may only stand at the ends of a subword, and not alone.
        valid = ~mark if n == 0 else ~(mark[:end] & mark[1:]) if n == 1 else ~inner[:end]
        yield state & np.uint32(BUCKETS - 1), valid
        inner = inner[:end] | mark[n:] if n else inner


def features(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    points, bounds = code_points(texts)
    grams = list(subwords(points, bounds))
    edges = bounds + np.arange(len(bounds))
    n_letters = row_sums(_letters()[points] != MARK, bounds)
    return grams, edges, n_letters


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts as they are, or a single long one as pieces: the place of its first code point, and each piece."""
    if len(texts) > 1 or (len(texts) == 1 and (pc.utf8_length(texts)[0].as_py() or 0) <= STEP):
        yield 0, texts
        return
    text = texts[0].as_py() or "" if len(texts) else ""
    for at in range(0, max(len(text), 1), STEP):
        # One point more on the left and GRAMS - 1 on the right, as a subword may end there.
        yield at, pa.array([text[max(at - 1, 0) : at + STEP + GRAMS - 1]], pa.large_string())


def sums_of(grams, edges: np.ndarray, at: int, table: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows, and numbers, of the subwords of each text; of a piece, those that begin in it."""
    total = np.zeros((len(edges) - 1, table.shape[1]), np.float64)
    count = np.zeros(len(edges) - 1, np.int64)
    for bucket, valid in grams:
        valid = _own(valid, at, long)
        upto = np.minimum(edges, len(bucket))
        total += row_sums(table[bucket] * valid[:, None], upto)
        count += row_sums(valid, upto)
    return total, count


def _own(valid: np.ndarray, at: int, long: bool) -> np.ndarray:
    """Without the subwords that begin in another piece: place 0 is the mark before the text, or the point before the piece."""
    if not long:
        return valid
    valid = valid.copy()
    # A piece after the first begins with a mark and the point before it, whose subwords are the last piece's.
    valid[: 2 if at else 0] = False
    valid[(2 if at else 1) + STEP :] = False
    return valid


def mean_rows(table: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of the table's rows over the subwords of each text, its number of subwords and of letters."""
    parts = list(_parts(table, texts))
    total, count, letters = (sum(p[i] for p in parts) for i in range(3))
    return total / np.maximum(count, 1)[:, None], count, letters


def _parts(table: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    long = len(texts) == 1 and (pc.utf8_length(texts)[0].as_py() or 0) > STEP
    for at, piece in pieces(texts):
        grams, edges, letters = features(piece)
        yield *sums_of(grams, edges, at, table, long), letters


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Languages in order, the logits of each bucket and whether it was seen, temperature, least accepted score, and how many unseen subwords are usual and too many."""

    def __init__(self, languages: list[str], logits: np.ndarray, seen: np.ndarray | None = None):
        seen = np.ones(BUCKETS, bool) if seen is None else seen
        self.languages, self.table = languages, np.column_stack([logits, seen]).astype(np.float32)
        self.heat, self.least, self.usual, self.strange = 1.0, 0.0, 0.0, np.inf

    def strangeness(self, unseen: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How far the share of unseen subwords is above the usual one; chance, which counts in short texts, is no strangeness."""
        return (unseen - self.usual) * count / (np.maximum(self.usual, 0.01) * count + np.sqrt(np.maximum(count, 1)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the prediction is rejected."""
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        mean, count, n_letters = mean_rows(self.table, texts)
        chance = softmax(mean[:, :-1] / self.heat)
        strange = self.strangeness(1 - mean[:, -1], count) > self.strange
        best = chance.argmax(axis=1)
        known = n_letters > 0
        score = np.where(known, chance[np.arange(len(best)), best], 0.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, score, ~known | (score < self.least) | strange


Bag = tuple[np.ndarray, np.ndarray]


def bags_of(texts: pa.Array) -> list[Bag]:
    """For each text its buckets and how many subwords are in each; never more than there are buckets."""
    long = len(texts) == 1 and (pc.utf8_length(texts)[0].as_py() or 0) > STEP
    if long:
        counts = np.zeros(BUCKETS, np.int64)
        for at, piece in pieces(texts):
            for ids, valid in features(piece)[0]:
                counts += np.bincount(ids[_own(valid, at, True)], minlength=BUCKETS)
        there = np.flatnonzero(counts)
        return [(there.astype(np.uint32), counts[there])]
    grams, edges, _ = features(texts)
    bags = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        bags.append(np.unique(np.concatenate([ids[a:b][valid[a:b]] for ids, valid in grams]), return_counts=True))
    return bags


def fit(bags: list[Bag], labels: list[str], seed: int = 7) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    want = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight = np.zeros((DIM, len(languages)))
    aside = (np.arange(len(bags)) % ASIDE == ASIDE - 1) & (len(bags) >= ASIDE * LEAST_ASIDE)
    train = np.flatnonzero(~aside)
    share = len(train) / (len(languages) * np.maximum(np.bincount(want[train], minlength=len(languages)), 1))
    steps = EPOCHS * max(len(train), 1)
    for epoch in range(EPOCHS):
        for k, r in enumerate(rng.permutation(train)):
            ids, counts = bags[r]
            if not len(ids):
                continue
            rate = RATE * (1 - (epoch * len(train) + k) / steps)
            part = counts / counts.sum()
            mean = part @ table[ids]
            error = softmax((mean @ weight)[None])[0]
            error[want[r]] -= 1
            error *= min(share[want[r]], 4.0)
            back = weight @ error
            weight -= rate * np.outer(mean, error)
            # The mean spreads a gradient over hundreds of rows; this undoes the spreading.
            table[ids] -= rate * (part * min(len(ids), 50))[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for r in train:
        seen[bags[r][0]] = True
    model = Model(languages, table @ weight, seen)
    check = [r for r in np.flatnonzero(aside) if len(bags[r][0])]
    if check:
        mean = np.stack([bags[r][1] / bags[r][1].sum() @ model.table[bags[r][0]] for r in check])
        count = np.array([bags[r][1].sum() for r in check])
        rows, right = np.arange(len(check)), want[check]
        heats = np.geomspace(0.001, 20, 120)
        # As in Platt scaling, one more text counts as wrong, so that even without a wrong one no score is certain.
        slack = 1 / (len(check) + 2)
        aim = np.full((len(check), len(languages)), slack / max(len(languages) - 1, 1))
        aim[rows, right] = 1 - slack
        loss = [-(aim * np.log(softmax(mean[:, :-1] / h) + 1e-300)).sum(axis=1).mean() for h in heats]
        model.heat = float(heats[int(np.argmin(loss))])
        unseen = 1 - mean[:, -1].astype(np.float64)
        model.usual = float((unseen * count).sum() / count.sum())
        model.least = float(softmax(mean[:, :-1] / model.heat).max(axis=1).min())
        model.strange = float(model.strangeness(unseen, count).max())
    return model


def quotas(there: dict[str, int], rows: int) -> dict[str, int]:
    """So many texts of each label: equal parts, and what a rare one leaves goes to the others."""
    out, left = {}, rows
    for done, (label, n) in enumerate(sorted(there.items(), key=lambda e: (e[1], e[0]))):
        out[label] = min(n, -(-left // (len(there) - done)))
        left -= out[label]
    return out


def train(df: DataFrame, label: str = "lang", text: str = "text", rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` distinct labelled texts, for each label those with the least hashes.

    The hashes to ask for follow from the number of distinct texts of a label, so that no task sends many more than are taken. What comes to
    the driver are counts per bucket, in bytes too no more than ``SAMPLE_BYTES``. Of more labels than ``rows`` the most frequent are learned.
    """
    spark = df.sparkSession
    hashed = F.xxhash64(F.col(text), F.lit("sample"))
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(text).alias("text"), F.col(label).alias("l"), hashed.alias("h"))
    found = known.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "l").limit(rows).collect()
    there = {r["l"]: max(r["n"], 1) for r in found}
    share = quotas(there, rows)
    least = lambda x: min(int(min(2.0 * share[x] / there[x], 1.0) * 2**64), 2**64 - 1) - 2**63
    wanted = spark.createDataFrame([(x, least(x), share[x]) for x in there], "l string, most long, quota long")
    near = known.join(F.broadcast(wanted), "l").where(F.col("h") <= F.col("most")).select("text", "l", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BYTES):
            bags = bags_of(part.column("text"))
            ids = [b[0].astype("<u4").tobytes() for b in bags]
            counts = [b[1].astype("<i8").tobytes() for b in bags]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("l"), pa.array(ids), pa.array(counts)], ["h", "l", "ids", "counts"])

    bags = arrow_map(near, run, "h long, l string, ids binary, counts binary")
    once = bags.groupBy("h").agg(F.min(F.struct("l", "ids", "counts")).alias("s")).select("h", "s.*").join(F.broadcast(wanted), "l")
    # Some twice the sample's rows: the first of each label, within the label's part of the bytes.
    first = Window.partitionBy("l").orderBy("h")
    size = F.sum(F.length("ids") + F.length("counts")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = once.withColumns({"nth": F.row_number().over(first), "bytes": size})
    taken = ranked.where((F.col("nth") <= F.col("quota")) & (F.col("bytes") <= F.col("quota") * F.lit(SAMPLE_BYTES / rows))).select("h", "l", "ids", "counts").collect()
    taken = sorted(taken, key=lambda r: r["h"])
    found = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["counts"], "<i8")) for r in taken]
    return fit(found, [r["l"] for r in taken])


def held_out(id_: str = "doc_id") -> Column:
    """A third of the ids, by checksum, that training never sees. A row without id is not held out."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, model: Model, id_: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``id_``, ``lang_pred``, ``score`` and ``rejected``; with ``carry`` the input row as struct ``row``."""
    kind = df.schema[id_].dataType.simpleString()
    row = df.schema.simpleString() if carry else "boolean"
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BYTES):
            names, score, rejected = sent.value.predict(part.column("text"))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "row": part.column("row"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score), "rejected": pa.array(rejected),
            })

    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if carry else F.lit(True)
    plain = df.select(F.col(id_).alias("id"), F.col(text).alias("text"), whole.alias("row"))
    made = arrow_map(plain, run, f"id {kind}, row {row}, lang_pred string, score double, rejected boolean")
    return made.select(F.col("id").alias(id_), *["row"][: int(carry)], "lang_pred", "score", "rejected")
