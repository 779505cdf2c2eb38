"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Documents of the same words are one class, so copies cost one row. Classes that share a band hash
are candidates; the components of "shares a band" group them. A component of ordinary size is
verified in one task, every pair of it on its full n-gram sets. A larger one is never gathered: its
bands are cut into blocks, pairs of blocks go to different tasks, and a pair counts at its first
common band only. Pairs are compared inside tasks and leave them as counts and spanning edges,
so a group of near copies never becomes rows by the square of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.components import components
from faultline.llm.words import hashed, mixed, ngrams, slices, split_words
from faultline.operators.shared import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK = 256  # classes of one component, or of one block of a larger one, that a task compares at once
STRIDE = 1 << 16  # n-grams hashed at once

_SIGNED = "doc_id long, k1 long, k2 long, bands array<long>"
_SETS = "k1 long, k2 long, bands array<long>, grams binary"


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the fewest false candidates that ``most`` hashes allow while a pair at the threshold is
    found with probability ``recall``; a pair above it is found more surely."""
    for rows in range(8, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most // 2:
            return bands, rows
    raise ValueError("no banding of so many hashes reaches this recall")


def _keys(starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """128 bits for each text's word sequence, as two longs."""
    raw = words.tobytes()
    digests = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def _bands(begins: np.ndarray, grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each text; those of a text without n-grams mean nothing."""
    n = len(begins) - 1
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.zeros((bands * rows, n), np.uint64)
    some = np.flatnonzero(np.diff(begins))
    at = 0
    while at < len(some):
        upto = max(at + 1, int(np.searchsorted(begins[some + 1], begins[some[at]] + STRIDE, side="right")))
        docs = some[at:upto]
        piece = grams[begins[docs[0]] : begins[docs[-1] + 1]]
        cuts = begins[docs] - begins[docs[0]]
        for k in range(bands * rows):
            least[k, docs] = np.minimum.reduceat((piece ^ flips[k]) * factors[k], cuts)
        at = upto
    out = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        total = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + least[b * rows + r])
        out[:, b] = total
    return out.view(np.int64)


def _sign(n_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            starts, words = split_words(part.column("text"))
            words = hashed(words)
            keys = _keys(starts, words)
            begins, grams = ngrams(starts, words, n_words)
            table = _bands(begins, grams, bands, rows)
            full = np.diff(begins) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[full].reshape(-1))),
                ],
                ["doc_id", "k1", "k2", "bands"],
            )

    return run


def _gather(n_words: int):
    """Full n-gram sets (sorted distinct hashes) of the texts whose words are those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            starts, words = split_words(part.column("text"))
            words = hashed(words)
            keys = _keys(starts, words)
            begins, grams = ngrams(starts, words, n_words)
            same = (keys[:, 0] == part.column("k1").to_numpy()) & (keys[:, 1] == part.column("k2").to_numpy())
            sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            out = part.append_column("grams", pa.array(sets, pa.binary())).filter(pa.array(same))
            yield out.select([*[c for c in part.schema.names if c != "text"], "grams"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each left set shares with each right one. Memory is bounded by a stretch of the vocabulary."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float64)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    for at in range(0, len(shared), 8192):
        stretch = shared[at : at + 8192]
        sides = []
        for values, rows, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            place = np.searchsorted(stretch, values)
            place[place == len(stretch)] = 0
            hit = stretch[place] == values
            side = np.zeros((n, len(stretch)), np.float32)
            side[rows[hit], place[hit]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    common = _common(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return common >= threshold * (sizes - common) - 1e-9


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Runs of equal keys in a partition sorted by them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[-1][k] != row[k] for k in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _within(threshold: float):
    """Small components: each class's label and the copies linked to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["comp"]):
            sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
            links = _linked(sets, sets, threshold)
            np.fill_diagonal(links, False)
            roots = _roots(links)
            copies = np.array([r["copies"] for r in rows])
            first: dict[int, int] = {}
            for root, r in zip(roots, rows, strict=True):
                if r["first_doc"] is not None:
                    first[root] = min(first.get(root, r["first_doc"]), r["first_doc"])
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": pa.array([r["k1"] for r in rows], pa.int64()),
                    "k2": pa.array([r["k2"] for r in rows], pa.int64()),
                    "class_id": pa.array([first.get(x) for x in roots], pa.int64()),
                    "linked": pa.array((links * copies[None, :]).sum(1).tolist(), pa.int64()),
                }
            )

    return run


def _across(threshold: float):
    """One pair of blocks of one band bucket: linked copies per class and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["slot", "x", "y"]):
            left = [r for r in rows if r["own"] == r["x"]]
            right = left if rows[0]["x"] == rows[0]["y"] else [r for r in rows if r["own"] == r["y"]]
            if not left or not right:
                continue
            links = _linked(*[[np.frombuffer(r["grams"], np.uint64) for r in side] for side in (left, right)], threshold)
            bands = [np.array([r["bands"] for r in side]) for side in (left, right)]
            slot, undecided = rows[0]["slot"], np.ones(links.shape, bool)
            for b in range(bands[0].shape[1]):
                same = undecided & (bands[0][:, b][:, None] == bands[1][:, b][None, :])
                links &= ~same | (bands[0][:, b] == slot)[:, None]
                undecided &= ~same
            if left is right:
                np.fill_diagonal(links, False)
            out = []
            for side, other, part in ((left, right, links), (right, left, links.T)):
                weights = np.array([r["copies"] for r in other])
                found = (part * weights[None, :]).sum(1)
                out += [(r["k1"], r["k2"], r["k1"], int(n)) for r, n in zip(side, found, strict=True) if n]
                if left is right:
                    break
            square = np.zeros((len(left) + len(right),) * 2, bool)
            square[: len(left), len(left) :] = links
            square |= square.T
            nodes = [r["k1"] for r in [*left, *right]]
            out += [(nodes[i], None, nodes[root], 0) for i, root in enumerate(_roots(square)) if i != root]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["k1", "k2", "to", "linked"]
                )

    return run


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, rep_id, class_id, n_links.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-grams is ``threshold`` or
    more. A shorter text has one n-gram, all its words; texts without a word, null ones included, are alike.
    ``rep_id`` is the smallest id among documents of exactly the same words, ``class_id`` the smallest among
    all that are connected through links, ``n_links`` the number of other rows linked directly, copies
    included. ``text_key`` is xxhash64 of the text. A candidate is missed with probability ``1 - recall`` at the
    threshold and less above it; every candidate is verified on full sets. Null ids stay null and count as
    documents; an id that repeats with other texts is treated row by row. Extra columns are ignored; an
    empty table gives no rows.
    """
    bands, rows = banding(threshold, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = docs.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text")
    sign = _sign(words, bands, rows)
    seen = written(signed.mapInArrow(_with_key(sign), f"{_SIGNED}, text_key long"), "signed")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "bands"))
    classes = seen.groupBy("k1", "k2").agg(lead.alias("lead"), F.count(F.lit(1)).alias("copies"))
    key = F.col("lead.text_key").alias("key")
    classes = written(classes.select("k1", "k2", F.col("lead.doc_id").alias("first_doc"), key, "lead.bands", "copies"), "classes")

    slots = seen.select("k1", F.explode("bands").alias("slot")).distinct()
    buckets = slots.groupBy("slot").agg(F.min("k1").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(buckets, "buckets")
    stars = slots.join(buckets, "slot").where("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b"))
    comps = components(stars).select(F.col("node").alias("k1"), F.col("label").alias("comp"))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    wanted = classes.join(comps, "k1").join(sizes, "comp")
    texts = docs.withColumn("text_key", F.xxhash64("text")).withColumnRenamed("doc_id", "id")
    found = wanted.join(texts, F.col("id").eqNullSafe(F.col("first_doc")) & (F.col("text_key") == F.col("key")))
    found = found.dropDuplicates(["k1", "k2"])  # a row that repeats brings its text more than once
    kept = ["k1", "k2", "first_doc", "copies", "comp", "members", "bands"]
    schema = "k1 long, k2 long, first_doc long, copies long, comp long, members long, bands array<long>, grams binary"
    sets = written(found.select(*kept, "text").mapInArrow(_gather(words), schema), "sets")

    small = sets.where(F.col("members") <= block).select("comp", "k1", "k2", "first_doc", "copies", "grams")
    small = small.repartition("comp").sortWithinPartitions("comp")
    ordinary = small.mapInArrow(_within(threshold), "k1 long, k2 long, class_id long, linked long")

    large = sets.where(F.col("members") > block)
    cut = large.select("k1", "k2", "copies", "bands", "grams", F.explode("bands").alias("slot")).join(buckets, "slot")
    cut = cut.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("k2"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("n", "low", "blocks", "other")
    cut = cut.repartition("slot", "x", "y").sortWithinPartitions("slot", "x", "y")
    partial = written(cut.mapInArrow(_across(threshold), "k1 long, k2 long, to long, linked long"), "partial")
    edges = partial.where("k2 is null").select(F.col("k1").alias("a"), F.col("to").alias("b"))
    labels = components(edges).select(F.col("node").alias("k1"), "label")
    counts = partial.where("k2 is not null").groupBy("k1", "k2").agg(F.sum("linked").alias("linked"))
    members = large.select("k1", "k2", "first_doc").distinct().join(labels, "k1")
    firsts = members.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    hot = members.join(firsts, "label").join(counts, ["k1", "k2"]).select("k1", "k2", "class_id", "linked")

    info = classes.join(ordinary.unionByName(hot), ["k1", "k2"], "left")
    info = info.select(
        "k1", "k2", F.col("first_doc").alias("rep_id"),
        F.coalesce("class_id", "first_doc").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    return seen.join(info, ["k1", "k2"]).select("doc_id", "text_key", "rep_id", "class_id", "n_links")


def _with_key(run):
    """``run`` over the batches, each row's ``text_key`` carried along."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for out in run(iter([part])):
                yield out.append_column("text_key", part.column("text_key"))

    return both


def one_of_each(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``chosen`` (doc_id, text_key), each once."""

    def place(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))  # null ids meet, too

    keys = chosen.select(place("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.withColumns({"_id": place(id_col), "_key": F.xxhash64(text_col)}).join(keys, ["_id", "_key"])
    first = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))
    return rows.withColumn("_nth", first).where("_nth = 1").select(docs.columns)
