"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the training folds drawn
without regard to labels are the unlabelled ones. With class prior p, the risk of a scorer f is

    p * R(f | toxic, called toxic) + max(0, R(f | unlabelled, called clean) - p * R(f | toxic, called clean))

where the last two terms estimate the risk on clean texts and may not fall below zero: when they would, that
step climbs out of the over-fit instead. Features are the presence of words and of word beginnings, hashed, as far
as they are significantly more frequent in confirmed toxic texts than in unlabelled ones, counted over the whole of both samples. A
sign must stand in a few texts that are no near copies of each other, whatever the size of the samples, so a small
group's own words count, too. A few numpy classifiers are trained side by side on the same signs, one task each, on
disjoint parts of the bounded samples; the mean of their weights scores every whole text, slice by slice, wherever it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.words import coded, hashed, mixed, ngrams, slices, split_words
from faultline.operators.shared import written

POSITIVES = 8_000  # confirmed toxic texts used for training, at most
UNLABELLED = 24_000  # unlabelled texts used for training, at most
CLASSIFIERS = 8  # at most; one for each PER_CLASSIFIER positives
PER_CLASSIFIER = 1_000
FEATURES = 20_000  # at most: the most significant ones
LEAST_Z = 5.0  # standard errors between a feature's shares of toxic and of unlabelled texts
LEAST_TEXTS = 5  # toxic texts that hold it, near copies counted once: they share their rare words
BANDS, ROWS = 8, 3  # minima of five-word shingles; texts of similarity 0.8 share a band with probability 0.997
LEAST_LIFT = 3.0  # times a feature's share of unlabelled texts; half of what a sure sign reaches if that is less
SLICE_BYTES = 4 << 20
BEGINNING = 5  # characters of a word's beginning
ROUNDS = 300
RATE = 0.1
SHRINK = 1e-5
THRESHOLD = 0.3
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~`+="


@dataclass(frozen=True)
class Model:
    """Log-odds weights of some feature slots, in ascending order, and the log-odds of a text without any of them."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _slot(word: str, kind: int) -> int:
    return xxhash.xxh32_intdigest(word.encode(), kind)


def features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the features of each text start, and all of them: distinct slots of words and word beginnings.

    With ``known`` slots, only those, as positions in ``known``.
    """
    starts, words = split_words(texts)
    codes, distinct = coded(words)
    plain = [w.strip(_STRIP) for w in pc.utf8_lower(distinct).to_pylist()]
    table = np.array([(_slot(w, 1), _slot(w[:BEGINNING], 2)) if w else (-1, -1) for w in plain], np.int64).reshape(-1, 2)
    if known is not None:
        place = np.searchsorted(known, table)
        place[place == len(known)] = 0
        table = np.where(known[place] == table, place, -1) if len(known) else np.full_like(table, -1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    used = (table >= 0).any(1)[codes]
    pairs = np.unique((owner[used] << 32) | codes[used])
    owner, found = pairs >> 32, table[pairs & 0xFFFFFFFF]
    pairs = np.concatenate([((owner << 32) | found[:, k])[found[:, k] >= 0] for k in (0, 1)])
    pairs = np.unique(pairs)
    return np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)), pairs & 0xFFFFFFFF


def _sums(weights: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[found], dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _z(in_p: np.ndarray, in_u: np.ndarray, groups: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """How many standard errors more often toxic texts hold a slot than unlabelled ones; 0 if that is no sign.

    ``groups`` counts the toxic texts that hold it, near copies once.
    """
    share = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share) * (1 / n_p + 1 / n_u), 1e-12))
    weak = in_p / n_p < min(LEAST_LIFT, 0.5 / prior) * in_u / n_u
    return np.where(weak | (z < LEAST_Z) | (groups < LEAST_TEXTS), 0.0, z)


def _counted(positive: pa.Array, unlabelled: pa.Array, classes: np.ndarray) -> list[np.ndarray]:
    """Slots in ascending order, and the toxic texts, unlabelled texts and classes of toxic texts that hold each."""
    p_starts, p_found = _all_features(positive)
    in_u, u_counts = np.unique(_all_features(unlabelled)[1], return_counts=True)
    in_p, p_counts = np.unique(p_found, return_counts=True)
    held = np.repeat(np.unique(classes, return_inverse=True)[1], np.diff(p_starts))
    in_class, class_counts = np.unique(np.unique((p_found.astype(np.int64) << 31) | held) >> 31, return_counts=True)
    slots = np.union1d(in_p, in_u).astype(np.int64)
    out = [slots]
    for own, counts in ((in_p, p_counts), (in_u, u_counts), (in_class, class_counts)):
        column = np.zeros(len(slots), np.int64)
        column[np.searchsorted(slots, own)] = counts
        out.append(column)
    return out


def _bands(texts: pa.Array) -> np.ndarray:
    """For each text, ``BANDS`` hashes of ``ROWS`` minima over its five-word shingles each."""
    starts, words = split_words(texts)
    begins, grams = ngrams(starts, hashed(words), 5)
    out = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        for band in range(BANDS):
            for row in range(ROWS):
                seed = np.uint64((band * ROWS + row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                least = np.minimum.reduceat(mixed(grams ^ seed), begins[:-1][some])
                out[some, band] = mixed(out[some, band] ^ least)
    return out


def _classes(bands: np.ndarray) -> np.ndarray:
    """The smallest index among texts that are linked by equal bands."""
    label = np.arange(len(bands))
    keys = [np.unique(bands[:, k], return_inverse=True)[1] for k in range(bands.shape[1])]
    while True:
        before = label.copy()
        for key in keys:
            least = np.full(len(bands), len(bands))
            np.minimum.at(least, key, label)
            label = label[least[key]]
        if (label == before).all():
            return label


def _placed(slots: np.ndarray, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features as positions in ``slots``, others left out."""
    place = np.searchsorted(slots, found)
    place[place == len(slots)] = 0
    hit = slots[place] == found if len(slots) else np.zeros(len(found), bool)
    return np.concatenate([[0], np.cumsum(hit)])[starts], place[hit]


def _all_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many texts, slice by slice, as 32-bit slots."""
    starts, found = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", 2 << 20):
        begins, own = features(part.column("text"))
        starts.append(begins[1:] + starts[-1][-1])
        found.append(own.astype(np.uint32))
    return np.concatenate(starts), np.concatenate(found)


Placed = tuple[np.ndarray, np.ndarray]


def risk(weights: np.ndarray, bias: float, p: Placed, u: Placed, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk on toxic text, the unbounded estimate of that on clean text, and the slope of the step to take.

    The slope ends in the bias. While the estimate is below zero it is that of its negative: the step climbs out.
    """
    on_p, on_u = (_sums(weights, *side) + bias for side in (p, u))
    n_p, n_u = len(on_p), len(on_u)
    toxic_risk = prior * np.logaddexp(0, -on_p).mean()
    clean_risk = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
    # Slopes of the losses: called toxic, -sigmoid(-x); called clean, sigmoid(x).
    g_u = _sigmoid(on_u) / n_u
    g_p = -prior * _sigmoid(on_p) / n_p
    if clean_risk < 0:
        g_u, g_p = -g_u, -g_p
    else:
        g_p = g_p - prior * _sigmoid(-on_p) / n_p
    slope = sum(np.bincount(found, np.repeat(g, np.diff(starts)), len(weights)) for g, (starts, found) in ((g_p, p), (g_u, u)))
    return toxic_risk, clean_risk, np.append(slope, g_p.sum() + g_u.sum())


def fit(positive: pa.Array, unlabelled: pa.Array, prior: float, rounds: int = ROUNDS, slots: np.ndarray | None = None) -> Model:
    """One classifier by Adam on the non-negative risk with logistic loss, on given signs or those of its own texts."""
    if slots is None:
        found, *counts = _counted(positive, unlabelled, np.arange(len(positive)))
        z = _z(*counts, len(positive), len(unlabelled), prior)
        best = np.argsort(-z, kind="stable")[:FEATURES]
        slots = np.sort(found[best[z[best] > 0]])
    n = len(slots)
    p, u = _placed(slots, *_all_features(positive)), _placed(slots, *_all_features(unlabelled))
    weights, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        slope = risk(weights, bias, p, u, prior)[2] + SHRINK * np.append(weights, 0)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        # All slots speak for toxicity, so a text without any is no likelier toxic than one unseen.
        bias = min(bias - float(move[-1]), float(np.log(prior / (1 - prior))))
    return Model(slots.astype(np.int64), weights, bias)


def mean(models: list[Model]) -> Model:
    """The mean log-odds. ``train`` fits all of them on the same slots; a slot that one lacks weighs nothing there."""
    slots = np.unique(np.concatenate([m.slots for m in models]))
    weights = np.zeros(len(slots))
    for m in models:
        weights[np.searchsorted(slots, m.slots)] += m.weights / len(models)
    return Model(slots, weights, float(np.mean([m.bias for m in models])))


def fold(id_col: str = "doc_id") -> Column:
    """Four folds by the checksum of the id's text; fold 2 is held out. A null id has none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most so many ids, in hash order."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(most)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> Model | None:
    """The mean of the classifiers, or None without any confirmed toxic text in the training folds.

    Labels count only in the training folds; a document is toxic if any of its labels says so. ``prior`` is the
    share of toxic documents, by default their share among labelled ones. Samples are bounded by
    ``positives`` and ``unlabelled`` rows; only ids are ranked for them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows = rows.where(fold() != 2)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    known = written(known.where(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    if prior is None:
        share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
        prior = min(max(share or 0.0, 1e-3), 0.5)
    toxic = known.where("toxic = 1").select("doc_id")
    ids = rows.select("doc_id").distinct()
    # Unlabelled text is drawn without regard to labels, so that it holds its share of toxic text.
    sides = [_sample(ids.join(toxic, "doc_id"), positives), _sample(ids, unlabelled)]
    taken = sides[0].withColumn("positive", F.lit(True)).unionByName(sides[1].withColumn("positive", F.lit(False)))
    taken = written(taken, "taken")
    n_positive = taken.where("positive").count()
    if not n_positive:
        return None
    parts = min(CLASSIFIERS, max(1, n_positive // PER_CLASSIFIER))
    # One row per id, its smallest text: a repeated id weighs no more than another.
    texts = rows.join(taken, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    texts = written(texts.where("text is not null"), "sample")
    classes = texts.where("positive").mapInArrow(_banded, "doc_id long, bands array<long>")
    # One group of POSITIVES rows of BANDS numbers.
    classes = classes.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_class_rows, "doc_id long, class long").withColumn("positive", F.lit(True))
    texts = texts.join(classes, ["doc_id", "positive"], "left").withColumn("class", F.coalesce("class", "doc_id"))
    # Near copies share a part, so classes of parts add up.
    texts = written(texts.withColumn("part", F.pmod(F.xxhash64("class", F.lit(80)), F.lit(parts))), "parts")

    def count(group: pa.Table) -> pa.Table:
        toxic, own, rest = _sides(group)
        columns = _counted(toxic, rest, own)
        columns = [np.append(c, x) for c, x in zip(columns, (-1, len(toxic), len(rest), len(toxic)), strict=True)]  # slot -1: all texts
        return pa.table(columns, ["slot", "in_p", "in_u", "classes"])

    counts = texts.groupBy("part").applyInArrow(count, "slot long, in_p long, in_u long, classes long")
    counts = written(counts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("in_p", "in_u", "classes")]), "signs")
    total = counts.where("slot = -1").first()
    if total is None or not total.in_p or not total.in_u:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            z = _z(*columns[1:], total.in_p, total.in_u, prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z)], ["slot", "z"])

    signs = counts.where(f"slot >= 0 and classes >= {LEAST_TEXTS}").mapInArrow(measure, "slot long, z double")
    best = signs.where("z > 0").orderBy(F.desc("z"), "slot").limit(FEATURES)
    slots = np.sort(np.array([r.slot for r in best.select("slot").collect()], np.int64))

    def one(group: pa.Table) -> pa.Table:
        schema = pa.schema([("bias", pa.float64()), ("weights", pa.list_(pa.float64()))])
        toxic, _, rest = _sides(group)
        if not len(toxic) or not len(rest):
            return schema.empty_table()
        model = fit(toxic, rest, prior, slots=slots)
        return pa.Table.from_pylist([{"bias": model.bias, "weights": model.weights.tolist()}], schema)

    # At most CLASSIFIERS rows of FEATURES numbers reach the driver.
    found = texts.groupBy("part").applyInArrow(one, "bias double, weights array<double>").collect()
    models = [Model(slots, np.array(r.weights, np.float64), r.bias) for r in found]
    return mean(models) if models else None


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 2 << 20):
        bands = pa.array(_bands(part.column("text")).view(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), bands], ["doc_id", "bands"])


def _class_rows(group: pa.Table) -> pa.Table:
    group = group.sort_by("doc_id").combine_chunks()
    ids = group.column("doc_id").to_numpy()
    bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
    return pa.table({"doc_id": ids, "class": ids[_classes(bands)]})


def _sides(group: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Toxic texts, their classes, and unlabelled texts of a part; copies are one example."""
    is_toxic = group.column("positive")
    toxic, rest = group.filter(is_toxic), group.filter(pc.invert(is_toxic))
    codes, distinct = coded(pa.array(toxic.column("text").to_pylist(), pa.string()))
    own = toxic.column("class").to_numpy()[np.unique(codes, return_index=True)[1]]
    return distinct, own, pc.unique(rest.column("text").combine_chunks()) if len(rest) else pa.array([], pa.string())


def score(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), columns of these names replaced.

    A null or empty text scores by the bias alone. Without a model every score is 0. Repeated rows score alike;
    labels, languages and sources are never looked at.
    """
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLASSIFIERS * FEATURES slots at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, text_col, SLICE_BYTES):
            starts, found = features(part.column(text_col), known.slots)
            yield part.append_column("score", pa.array(_sigmoid(_sums(known.weights, starts, found) + known.bias)))

    out = docs.mapInArrow(run, docs.selectExpr("*", "0D as score").schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")
