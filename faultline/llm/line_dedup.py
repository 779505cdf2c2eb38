"""Line dedup by a deletion-neighbourhood join over words.

Two lines are near equal when one word inserted, deleted or replaced turns one into the other.
Each line emits its variants with one word deleted, as 128-bit hashes. Two lines of a variant in common that
was made by deleting the same position differ by a replacement there; a line that equals another's
variant differs by a deletion. So the earliest line under a key stands for all of them: a key with many lines
costs one comparison per line, never one per pair, and each comparison is verified on the words.

Only lines that can have a partner emit variants. If two lines are one edit apart, either their first
halves or their last halves are equal; lines that share no half with any other are left out without loss.

Where long lines may differ in more words, deletions of several words would grow with a power of the line. There,
a line emits its 4k + 1 smallest hashed four-word grams, k being its bound: k edits change at most 4k grams of either
line, so the smallest one in common is among these. Under a gram, lines are compared by sketches, 256 bits that each word
of a line flips one of: k edits flip 2k at most. Only lines whose sketches are that close are verified, on the
words: each with the earliest such line first, and those that it does not settle with all others.

Up to that point a line is its hashes, sketch and place. Texts are read again for lines that share a half and for lines with
a close sketch only, and each part's tables go when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.words import hashed_twice, mixed, ngrams, slices, split_lines, split_words
from faultline.operators.ordered import ordered_features, position
from faultline.operators.shared import scratch, written

MIN_WORDS = 8  # shorter lines are only compared exactly: one word of seven is too much to ignore
GROWING = (20, 40)  # words of the shorter line from which one more edit is allowed: 2 from 20, 3 from 40
GRAM = 4  # words of a gram
BLOCK = 2048  # lines of one gram that a task compares with as many others
SKETCH = 4  # times 64 bits

_LINES = "array<struct<line:int,h1:long,h2:long,n:int,a1:long,a2:long,a3:long,a4:long{}>>"
_SIDES = [f"s{k}" for k in range(SKETCH)]
_NEAR = "h1 long, h2 long"
_VARIANTS = "h1 long, h2 long, place decimal(38,0), v1 long, v2 long, pos int"
# Bases of the two polynomial hashes, and their inverses modulo 2**64.
_BASES = [0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95 | 1]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _prefixes(words: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """Sums of word * base**position over all words before each place, running through all lines; unsigned overflow
    is arithmetic modulo 2**64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words))[: len(words)], dtype=np.uint64)])


def _span(prefix: np.ndarray, lift: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of words a..b as if they began at position 0."""
    return (prefix[b] - prefix[a]) * lift[a]


def _tagged(x: np.ndarray, *tags) -> np.ndarray:
    for tag in tags:
        x = mixed(x + np.asarray(tag).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return x


def _grams(starts: np.ndarray, words: np.ndarray, grow: tuple[int, ...]) -> pa.ListArray:
    """The smallest hashes of each line's grams, one more than its edits can change. A gram that a line holds several
    times is hashed with its turn. Lines that may differ in one word only have none."""
    n = np.diff(starts)
    begins, grams = ngrams(starts, words, GRAM)
    owner = np.repeat(np.arange(len(n)), np.diff(begins))
    long = n[owner] >= grow[0]
    owner, grams = owner[long], grams[long]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    at = np.arange(len(owner))
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    grams = _tagged(grams, at - np.maximum.accumulate(np.where(fresh, at, 0)))
    grams = grams[np.lexsort((grams, owner))]
    counts = np.bincount(owner, minlength=len(n))
    turn = at - (np.cumsum(counts) - counts)[owner]
    most = np.where(n >= grow[0], GRAM * (1 + np.searchsorted(grow, n, side="right")) + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(np.minimum(counts, most))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[turn < most[owner]].view(np.int64)))


def _sketches(starts: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The sides of each line's sketch: a bit for each of its words, flipped."""
    bits = np.zeros((len(starts) - 1) * SKETCH, np.uint64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    side = ((words >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)
    np.bitwise_xor.at(bits, owner * SKETCH + side, np.uint64(1) << (words & np.uint64(63)))
    return [np.ascontiguousarray(bits[k::SKETCH]) for k in range(SKETCH)]


def _read(grow: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of each text that hold a word: number, hash, word count, the four half keys and, with ``grow``, the grams
        and the sketch."""
        for part in slices(batches, "text"):
            line_starts, lines = split_lines(part.column("text"))
            starts, words = split_words(lines)
            a, b = starts[:-1], starts[1:]
            n = b - a
            wide = hashed_twice(words)
            hashes = []
            for base, inverse, w in zip(_BASES, _INVERSES, wide, strict=True):
                prefix, lift = _prefixes(w, starts, base), _powers(inverse, len(w))
                hashes.append(_tagged(_span(prefix, lift, a, b), n))
                if len(hashes) == 1:
                    halves = []
                    for short in (n, np.maximum(n - 1, 0)):  # the word count of the shorter line of a pair
                        half = short // 2
                        halves.append(_tagged(_span(prefix, lift, a, a + half), short, 1))
                        halves.append(_tagged(_span(prefix, lift, b - (short - half), b), short, 2))
            owner = np.repeat(np.arange(part.num_rows), np.diff(line_starts))
            number = np.arange(len(lines)) - line_starts[:-1][owner]
            full = n > 0
            counts = np.bincount(owner[full], minlength=part.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [number[full].astype(np.int32), *[h[full].view(np.int64) for h in hashes], n[full].astype(np.int32)]
            columns += [h[full].view(np.int64) for h in halves]
            arrays, names = [pa.array(c) for c in columns], ["line", "h1", "h2", "n", "a1", "a2", "a3", "a4"]
            if grow:
                arrays.append(_grams(starts, wide[0], grow).filter(pa.array(full)))
                arrays += [pa.array(side[full].view(np.int64)) for side in _sketches(starts, wide[1])]
                names += ["grams", *_SIDES]
            records = pa.StructArray.from_arrays(arrays, names)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "text_key")], pa.ListArray.from_arrays(offsets, records)],
                ["doc_id", "text_key", "lines"],
            )

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line itself (pos -1) and without each of its words."""
    for part in slices(batches, "line", 1 << 20):
        starts, words = split_words(part.column("line"))
        n = np.diff(starts)
        owner = np.repeat(np.arange(part.num_rows), n)
        at = np.arange(len(words))
        sides = []
        for w, base, inverse in zip(hashed_twice(words), _BASES, _INVERSES, strict=True):
            prefix, lift = _prefixes(w, starts, base), _powers(inverse, len(w) + 1)
            a, b = starts[:-1], starts[1:]
            whole = _tagged(_span(prefix, lift, a, b), n)
            first = starts[:-1][owner]
            less = (prefix[at] - prefix[first] + (prefix[b[owner]] - prefix[at + 1]) * np.uint64(inverse)) * lift[first]
            sides.append(np.concatenate([whole, _tagged(less, n[owner] - 1)]).view(np.int64))
        rows = np.concatenate([np.arange(part.num_rows), owner])
        pos = np.concatenate([np.full(part.num_rows, -1), at - starts[:-1][owner]]).astype(np.int32)
        own = part.select(["h1", "h2", "place"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [*own.columns, pa.array(sides[0]), pa.array(sides[1]), pa.array(pos)], ["h1", "h2", "place", "v1", "v2", "pos"]
        )


def _place() -> Column:
    """Order of a line: document id, text, line number, as one number that combines map-side.

    Null ids are last, in order of their text's digest; texts of one id are told apart by 28 bits of it.
    """
    wide = "decimal(20,0)"
    digest = F.col("text_key").cast(wide) + F.lit("9223372036854775808").cast(wide)
    own = F.coalesce(F.col("doc_id").cast("decimal(21,0)"), F.lit("9223372036854775808").cast("decimal(21,0)") + digest)
    within = F.pmod("text_key", F.lit(1 << 28)) * F.lit(1 << 31) + F.col("line")
    return (own * F.lit(1 << 59).cast("decimal(18,0)") + within.cast("decimal(18,0)")).cast("decimal(38,0)")


def _one_edit(a: Column, b: Column) -> Column:
    """At most one word inserted, deleted or replaced: what is left between the common head and tail is one word long."""
    short = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), short - 1), lambda i: F.get(a, i) != F.get(b, i))
    head = F.coalesce(F.get(differ, F.lit(0)), short)
    differ = F.filter(
        F.sequence(F.lit(0), short - 1), lambda i: F.get(a, F.size(a) - 1 - i) != F.get(b, F.size(b) - 1 - i)
    )
    tail = F.coalesce(F.get(differ, F.lit(0)), short)
    return (F.greatest(F.size(a), F.size(b)) - F.least(head + tail, short) <= 1) & (F.abs(F.size(a) - F.size(b)) <= 1)


def _within(a: list, b: list, most: int) -> bool:
    """Whether ``most`` words inserted, deleted or replaced turn one into the other: the furthest place on each
    diagonal, edit by edit."""
    goal = len(b) - len(a)

    def slide(i: int, d: int) -> int:
        while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
            i += 1
        return i

    far = {0: slide(0, 0)}
    for _ in range(most):
        if far.get(goal) == len(a):
            return True
        step = {}
        for d in range(min(far) - 1, max(far) + 2):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -1), far.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                step[d] = slide(i, d)
        far = step
    return far.get(goal) == len(a)


def _bound(n, grow: tuple[int, ...]):
    """Words in which lines may differ, the shorter of which has ``n``."""
    return 1 + np.searchsorted(grow, n, side="right")


def _closer(grow: tuple[int, ...], every: bool):
    """(turn, first): for each open line of a pair of blocks the earliest line, or ``every`` one, whose sketch is close enough."""
    names = ["gram", "x", "y", "own", "turn", "n", "open", *_SIDES]

    def near(rows: dict[str, np.ndarray], across: bool) -> tuple[np.ndarray, np.ndarray]:
        late = np.flatnonzero(rows["open"])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(late), 256):
            own = late[at : at + 256]
            differ = sum(np.bitwise_count(rows[k][own, None] ^ rows[k][None, :]).astype(np.int16) for k in _SIDES)
            short = np.minimum(rows["n"][own, None], rows["n"][None, :])
            most = _bound(short, grow)
            close = (differ <= 2 * most) & (most > 1) & (np.maximum(rows["n"][own, None], rows["n"][None, :]) - short <= most)
            close &= rows["turn"][None, :] < rows["turn"][own, None]
            if across:
                close &= rows["own"][own, None] != rows["own"][None, :]
            if every:
                i, j = np.nonzero(close)
            else:  # rows are in order of their turns
                i = np.flatnonzero(close.any(axis=1))
                j = close[i].argmax(axis=1)
            found.append((rows["turn"][own[i]], rows["turn"][j]))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def blocks(batches):
        """Arrays of the rows of one pair of blocks; blocks bound them."""
        left: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            # Unsigned: of a negative number, numpy counts the bits of its absolute value.
            rows |= {k: rows[k].view(np.uint64) for k in _SIDES}
            if left is not None:
                rows = {c: np.concatenate([left[c], rows[c]]) for c in names}
            if not len(rows["gram"]):
                continue
            fresh = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("gram", "x", "y")])
            ends = np.flatnonzero(fresh) + 1
            begins = np.concatenate([[0], ends])
            for a, b in zip(begins[:-1], ends, strict=True):
                yield {c: rows[c][a:b] for c in names}
            left = {c: rows[c][begins[-1] :] for c in names}
        if left is not None:
            yield left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            late, early = near(rows, rows["x"][0] != rows["y"][0])
            if len(late):
                yield pa.RecordBatch.from_arrays([pa.array(late), pa.array(early)], ["turn", "first"])

    return run


def _verified(grow: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[x.split(" ") for x in batch.column(c).to_pylist()] for c in ("late", "early")]
            good = [_within(a, b, int(_bound(min(len(a), len(b)), grow))) for a, b in zip(*lines, strict=True)]
            yield batch.select(["h1", "h2"]).filter(pa.array(good, pa.bool_()))

    return run


def _texts(docs: DataFrame, each: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h1, h2, place, ...), unique, with the words of each line, from the earliest of its places. ``docs`` (doc_id,
    text_key, text); ``each`` their lines."""
    places = each.select("doc_id", "text_key", "line", "h1", "h2").withColumn("own", _place())
    places = places.join(wanted, ["h1", "h2"]).where("own = place").groupBy("doc_id", "text_key")
    places = written(places.agg(F.collect_set(F.struct("line", *wanted.columns)).alias("wanted")), "wanted")
    meet = docs.doc_id.eqNullSafe(places.doc_id) & (docs.text_key == places.text_key)
    found = docs.join(places, meet).select(F.split("text", "\n", -1).alias("all"), "wanted")
    line = F.trim(F.regexp_replace(F.get("all", F.col("w.line")), "[\\x20\\x09-\\x0D]+", " "))
    found = found.select("all", F.explode("wanted").alias("w"))
    found = found.select(*[F.col(f"w.{c}") for c in wanted.columns], F.split(line, " ").alias("words"))
    return found.dropDuplicates(["h1", "h2"])  # a row that repeats brings its lines more than once


def _by_word(docs: DataFrame, each: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2) of lines that are one edit from an earlier one."""
    with scratch() as keep:
        halves = distinct.where(F.col("n") >= min_words - 1).select("h1", "h2", F.explode(F.array("a1", "a2", "a3", "a4")).alias("half"))
        shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
        partners = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
        partners = written(distinct.join(partners, ["h1", "h2"]).select("h1", "h2", "place"), "partners")
        lines = written(_texts(docs, each, partners), "partner-lines")

        keys = lines.select("h1", "h2", "place", F.array_join("words", " ").alias("line"))
        keys = written(keys.mapInArrow(_variants, _VARIANTS), "variants")
        # The earliest line under a variant: made by deleting the same word, whole, or by deleting any word.
        same = keys.groupBy("v1", "v2", "pos").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        same = same.where("pos >= 0 and n > 1").drop("n")
        by_word = keys.join(same, ["v1", "v2", "pos"]).where("first < place").select("h1", "h2", "first")
        whole = keys.where("pos = -1").select("v1", "v2", F.col("place").alias("whole"))
        any_word = keys.where("pos >= 0").join(whole, ["v1", "v2"])
        longer = any_word.where("whole < place").select("h1", "h2", F.col("whole").alias("first"))
        shorter = any_word.groupBy("v1", "v2", "whole").agg(F.min("place").alias("first")).where("first < whole")
        shorter = shorter.select(F.col("v1").alias("h1"), F.col("v2").alias("h2"), "first")

        pairs = by_word.unionByName(longer).unionByName(shorter).distinct()
        left = lines.select("h1", "h2", F.col("words").alias("left"))
        right = lines.select(F.col("place").alias("first"), F.col("words").alias("right"))
        checked = pairs.join(left, ["h1", "h2"]).join(right, "first").where(_one_edit(F.col("left"), F.col("right")))
        long_enough = F.least(F.size("left"), F.size("right")) >= min_words
        return keep(checked.where(long_enough).select("h1", "h2").distinct(), "near")


def _by_gram(docs: DataFrame, each: DataFrame, distinct: DataFrame, near: DataFrame, grow: tuple[int, ...]) -> DataFrame:
    """``near`` and the (h1, h2) of further lines that are near an earlier one. Under a gram, a line is a number and a sketch; only
    lines with a close sketch are read, once per verification."""
    with scratch() as keep:
        long = each.where(F.col("n") >= grow[0])
        keyed = long.select("h1", "h2", F.explode("grams").alias("gram"))
        common = keyed.groupBy("gram").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
        keyed = written(keyed.join(written(common.select("gram"), "grams"), "gram").distinct(), "keyed")
        sketches = long.select("h1", "h2", "n", *_SIDES).join(keyed.select("h1", "h2").distinct(), ["h1", "h2"]).distinct()
        sketches = sketches.join(distinct.select("h1", "h2", "place"), ["h1", "h2"])
        # The order of lines as a long: places are wider. Equal places are equal lines' only.
        sketches = written(ordered_features(sketches, [], [F.col("place")], [position("turn")], unique=True), "sketches")
        rows = keyed.join(sketches.drop("place"), ["h1", "h2"]).join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        rows = written(rows.withColumn("open", F.col("near").isNull()).drop("near", "h1", "h2"), "gram-lines")
        named = sketches.select("h1", "h2", "place", "turn")
        closed = named.select("h1", "h2").where("false")
        for every in (False, True):
            found = written(_candidates(rows, grow, every), "candidates")
            found = found if every else found.groupBy("turn").agg(F.min("first").alias("first"))
            close = found.select(F.explode(F.array("turn", "first")).alias("turn")).distinct()
            lines = _texts(docs, each, written(named.join(close, "turn").select(named.columns), "close"))
            lines = written(lines.withColumn("line", F.array_join("words", " ")).drop("words", "place"), "close-lines")
            late = found.join(lines.withColumnRenamed("line", "late"), "turn")
            early = lines.select(F.col("turn").alias("first"), F.col("line").alias("early"))
            pairs = late.join(early, "first").select("h1", "h2", "late", "early")
            closed = written(closed.unionByName(pairs.mapInArrow(_verified(grow), _NEAR).distinct()), "closed")
            if every:
                break
            # Second time: lines that have a candidate, but not the earliest one.
            still = found.select("turn").distinct().join(closed.join(named, ["h1", "h2"]), "turn", "left_anti")
            still = written(still, "still-open")
            if still.isEmpty():
                break
            rows = rows.drop("open").join(still.withColumn("open", F.lit(True)), "turn", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        return keep(near.unionByName(closed.distinct()), "near-by-gram")


def _candidates(rows: DataFrame, grow: tuple[int, ...], every: bool) -> DataFrame:
    """(turn, first) of open lines and earlier ones with a gram in common and close sketches."""
    sizes = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("lines"), F.min("turn").alias("low"), F.max(F.when(F.col("open"), F.col("turn"))).alias("high"))
    sizes = sizes.where("high > low").select("gram", F.ceil(F.col("lines") / BLOCK).cast("long").alias("blocks"), "high")
    cut = rows.join(sizes, "gram").where("turn <= high").withColumn("own", F.pmod(F.xxhash64("turn"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("high", "blocks", "other")
    cut = cut.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y", "turn")
    return cut.mapInArrow(_closer(grow, every), "turn long, first long").distinct()


def read_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grow: tuple[int, ...] = ()
) -> DataFrame:
    """(doc_id, text_key, lines), written once: the hashes of every line that holds a word. ``grow`` as for
    ``duplicate_lines``."""
    for k, least in enumerate(grow, 2):
        if least < GRAM * (k + 1):
            raise ValueError(f"{k} edits of {least} words may leave no gram in common")
    if list(grow) != sorted(grow):
        raise ValueError("the word counts of grow must rise")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    schema = _LINES.format("".join([",grams:array<long>", *[f",{c}:long" for c in _SIDES]]) if grow else "")
    return written(rows.mapInArrow(_read(tuple(grow)), f"doc_id long, text_key long, lines {schema}"), "lines")


def duplicate_lines(
    docs: DataFrame,
    read: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    grow: tuple[int, ...] = (),
) -> DataFrame:
    """(doc_id, text_key, n_lines, n_exact, n_near, dropped): the lines that an earlier one makes superfluous.

    Lines are compared as sequences of words. A line without a word stays. Of equal lines the earliest (by
    document id, then text, then line number) stays. A line of ``min_words`` words or more also goes if an earlier one,
    itself kept or not, is one word inserted, deleted or replaced away; each entry of ``grow`` that the shorter
    of the two reaches in words allows one edit more (``read`` needs the same ``grow``, each entry at least
    ``min_words``). ``dropped`` lists line numbers from 0.
    Null texts have no line with a word. Null ids come last, in the order of their texts' digests. Rows that repeat id and text are one place: their lines
    stay or go together. Every row of ``docs`` gives a row.
    """
    each = read.select("doc_id", "text_key", F.inline("lines"))
    distinct = each.groupBy("h1", "h2").agg(
        F.min(_place()).alias("place"), *[F.max(c).alias(c) for c in ("n", "a1", "a2", "a3", "a4")]
    )
    distinct = written(distinct, "distinct")

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    near = _by_word(texts, each, distinct, min_words)
    if grow:
        near = _by_gram(texts, each, distinct, near, tuple(grow))

    verdicts = each.select("doc_id", "text_key", "line", "h1", "h2").withColumn("own", _place())
    verdicts = verdicts.join(distinct.select("h1", "h2", "place"), ["h1", "h2"]).join(
        near.withColumn("near", F.lit(True)), ["h1", "h2"], "left"
    )
    exact = F.col("own") > F.col("place")
    gone = verdicts.where(exact | F.col("near").isNotNull()).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set("line")).alias("dropped"),
        F.size(F.collect_set(F.when(~exact, F.col("line")))).alias("n_near"),
    )
    rows = read.select("doc_id", "text_key", F.size("lines").alias("n_lines"))
    meet = rows.doc_id.eqNullSafe(gone.doc_id) & (rows.text_key == gone.text_key)
    n_near = F.coalesce("n_near", F.lit(0))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.join(gone, meet, "left").select(
        rows.doc_id, rows.text_key, "n_lines", (F.size(dropped) - n_near).alias("n_exact"), n_near.alias("n_near"),
        dropped.alias("dropped"),
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    grow: tuple[int, ...] = (),
) -> DataFrame:
    """``docs`` with the superfluous lines taken out of their texts; other columns as they are.

    A text that loses all its lines becomes empty; its row stays. A null text stays null.
    """
    with scratch() as keep:
        found = duplicate_lines(docs, read_lines(docs, id_col, text_col, grow), id_col, text_col, min_words, grow)
        found = found.where(F.size("dropped") > 0).select("doc_id", "text_key", "dropped").distinct()
        found = keep(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("dropped").alias("_dropped")), "dropped")
    meet = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("_dropped", i))
    text = F.when(F.col("_dropped").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(found, meet, "left").withColumn(text_col, text).select(docs.columns)
