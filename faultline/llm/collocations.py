"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

Level by level, from words to longer prefixes, every bounded slice of texts gives one stripe per prefix: its next words with
their counts, and ``rest``, the occurrences whose next word is not counted. Stripes are shuffled by prefix and merged elementwise, sorted, in
batches. A merged stripe holds a prefix's frequent extensions, its total (all counts and the rest) and its best extension, which
subsumes it if it is frequent enough. Words go as 64-bit names of (language, word); names are checked to be distinct.

An extension is only counted if the phrase without its first word, too, occurs often enough, as far as a filter of
fixed size over the level below can tell: what it lets through needlessly is counted and dropped later, so its size
changes the work, never a result. Stripes of hot prefixes are cut into segments by next word; a prefix is hot with one in
SEGMENTS of all words, so the list of hot ones is bounded.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.words import coded, hashed, mixed, slices
from faultline.operators.shared import written

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a phrase
SUBSUMED = 50  # percent of a phrase's occurrences within one longer phrase that make it superfluous
TOP = 2000  # phrases per language
SCALE = 1_000_000  # of scores
FILTER_BITS = 25  # the filter has 2**25 bits, 4 MB
SEGMENTS = 1024  # a prefix with more than this fraction of all words is cut
SLICE_BYTES = 6 << 20
WORDS_HELD = 200_000  # distinct words that a task counts before it hands them on
_PROBES = 4

_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(_BLANKS)], kinds[list(_BREAKS)] = 1, 2
    return kinds


def word_names(langs: pa.Array, texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Per word: its name, whether the next word continues its piece, and its text's row; and all words."""
    texts = pa.concat_arrays([pc.ascii_lower(pc.fill_null(texts, ""))])
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    kinds = _kinds()[raw]
    apart = kinds > 0
    first = np.ones(len(raw) + 1, bool)  # bytes before which a word ends, if there is one
    first[1:] = np.concatenate([apart[:-1], [True]]) if len(raw) else True
    first[ends] = True
    starts = np.flatnonzero(first[:-1] & ~apart)
    letters = np.flatnonzero(~apart)
    offsets = np.append(np.searchsorted(letters, starts), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[letters]))
    row = np.searchsorted(ends, starts, side="right") - 1
    broken = np.concatenate([[0], np.cumsum(kinds == 2)])[starts] + row  # grows with each break and each text
    follows = np.zeros(len(starts), bool)
    follows[:-1] = broken[1:] == broken[:-1]
    lang = mixed(hashed(langs, seed) + np.uint64(seed))
    return mixed(hashed(words, seed) ^ lang[row]), follows, row, words


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    """One number for the names of a prefix."""
    total = parts[0]
    for p in parts[1:]:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + p)
    return total


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mixed(keys) | np.uint64(1)
    for k in range(_PROBES):
        yield (keys + np.uint64(k) * step) & np.uint64((1 << bits) - 1)


def _held(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _probes(keys, bits):
        found &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def _filter_bits(names: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _combined([batch.column(c).to_numpy().view(np.uint64) for c in names])
            at = np.unique(np.concatenate([*_probes(keys, bits)]))
            word, begins = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begins) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(ones.view(np.int64))], ["word", "ones"])

    return run


def _membership(phrases: DataFrame, names: list[str], bits: int) -> np.ndarray:
    """A Bloom filter of the phrases: at most 2**bits bits, merged on executors, which pass the driver as words of 64."""
    rows = phrases.select(names).mapInArrow(_filter_bits(names, bits), "word long, ones long")
    merged = rows.groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[merged.column("word").to_numpy()] = merged.column("ones").to_numpy().view(np.uint64)
    return words


def _word_counts(seed: int):
    schema = ["name", "lang", "word", "n"]

    def batch(held: pa.Table) -> pa.RecordBatch:
        summed = held.group_by(["name", "lang", "word"]).aggregate([("n", "sum")]).rename_columns(schema)
        return summed.combine_chunks().to_batches()[0] if summed.num_rows else pa.RecordBatch.from_pylist([], held.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches, "text", SLICE_BYTES):
            names, _, row, words = word_names(part.column("lang"), part.column("text"), seed)
            distinct, at, n = np.unique(names, return_index=True, return_counts=True)
            langs = part.column("lang").take(pa.array(row[at]))
            columns = [pa.array(distinct.view(np.int64)), langs, words.take(pa.array(at)), pa.array(n.astype(np.int64))]
            # Words of one name are told apart, should there be any.
            codes = coded(words)[0]
            if len(names) and (codes != codes[at][np.searchsorted(distinct, names)]).any():
                columns = [pa.array(names.view(np.int64)), part.column("lang").take(pa.array(row)), words, pa.array(np.ones(len(names), np.int64))]
            held.append(pa.table(columns, names=schema))
            if sum(t.num_rows for t in held) > WORDS_HELD:
                yield batch(pa.concat_tables(held))
                held = []
        if held:
            yield batch(pa.concat_tables(held))

    return run


def words_of(rows: DataFrame) -> tuple[int, DataFrame]:
    """A seed under which no two words of a language share a name, and (name, lang, word, n) of all words of ``rows``
    (lang, text)."""
    for seed in itertools.count(1):
        counts = rows.mapInArrow(_word_counts(seed), "name long, lang string, word string, n long")
        words = written(counts.groupBy("name", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed, words


def _stripes(seed: int, size: int, bits: int, filter_, hot: tuple[np.ndarray, np.ndarray]):
    """The stripes of each slice for prefixes of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_.value
        for part in slices(batches, "text", SLICE_BYTES):
            names, follows, _, _ = word_names(part.column("lang"), part.column("text"), seed)
            # Where a phrase of ``size`` words begins that occurs often enough.
            whole = np.ones(len(names), bool)
            for k in range(size - 1):
                whole &= np.concatenate([follows[k:], np.zeros(min(k, len(names)), bool)])
            padded = np.concatenate([names, np.zeros(size, np.uint64)])
            often = np.zeros(len(names) + 1, bool)
            at = np.flatnonzero(whole)
            often[at] = _held(known, _combined([padded[at + k] for k in range(size)]), bits)
            at = np.flatnonzero(often)
            if not len(at):
                continue
            last = at + size - 1
            extends = follows[last] & often[at + 1]
            prefix = _combined([padded[at + k] for k in range(size)])
            _, begins, code = np.unique(prefix, return_index=True, return_inverse=True)
            n = len(begins)
            rest = np.bincount(code[~extends], minlength=n)
            following, of = padded[last[extends] + 1], code[extends]
            nexts, next_code = np.unique(following, return_inverse=True)
            pairs, counts = np.unique(of * max(len(nexts), 1) + next_code, return_counts=True)
            of, following = pairs // max(len(nexts), 1), nexts[pairs % max(len(nexts), 1)]
            place = np.searchsorted(hot[0], prefix[begins])
            place[place == len(hot[0])] = 0
            cut = np.where(hot[0][place] == prefix[begins], hot[1][place], 1) if len(hot[0]) else np.ones(n, np.int64)
            segment = (mixed(following) % cut[of].astype(np.uint64)).astype(np.int64)
            if (cut > 1).any():
                order = np.lexsort((following, segment, of))
                of, following, segment, counts = of[order], following[order], segment[order], counts[order]
            # One row per prefix and segment; a prefix's rest, and a prefix without extension, goes with segment 0.
            of, segment = np.concatenate([of, np.arange(n)]), np.concatenate([segment, np.zeros(n, np.int64)])
            rows, row = np.unique(of * (int(cut.max()) + 1) + segment, return_inverse=True)
            own, segment = rows // (int(cut.max()) + 1), rows % (int(cut.max()) + 1)
            sizes = np.bincount(row[: len(counts)], minlength=len(rows))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            first = at[begins][own]
            columns = [pa.array(padded[first + k].view(np.int64)) for k in range(size)]
            columns += [pa.array(segment.astype(np.int32)), pa.array(np.where(segment == 0, rest[own], 0).astype(np.int64))]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(following.view(np.int64))))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*[f"p{k + 1}" for k in range(size)], "segment", "rest", "next", "count"])

    return run


def _merged(size: int, least: int):
    """Sorted stripes merged elementwise: per prefix and segment its total, and the extensions that occur often enough."""
    keys = [*[f"p{k + 1}" for k in range(size)], "segment"]

    def merge(part: pa.Table) -> tuple[np.ndarray, ...]:
        """Where each key's rows begin, the number of each row's key, its entries summed by key and next word."""
        columns = [part.column(c).combine_chunks().to_numpy() for c in keys]
        fresh = np.ones(part.num_rows, bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        begins = np.flatnonzero(fresh)
        rest = np.add.reduceat(part.column("rest").combine_chunks().to_numpy(), begins)
        lists, counts = part.column("next").combine_chunks(), part.column("count").combine_chunks()
        following, counts = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        of = np.repeat(np.cumsum(fresh) - 1, lists.value_lengths().to_numpy())
        order = np.lexsort((following, of))
        of, following, counts = of[order], following[order], counts[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (following[1:] != following[:-1])
        at = np.flatnonzero(first)
        counts = np.add.reduceat(counts, at) if len(at) else counts
        return [c[begins] for c in columns], rest, of[at], following[at], counts

    def table(columns, rest, of, following, counts) -> pa.Table:
        sizes = np.bincount(of, minlength=len(rest))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (following, counts)]
        return pa.table([*map(pa.array, columns), pa.array(rest), *lists], names=[*keys, "rest", "next", "count"])

    def finished(columns, rest, of, following, counts) -> pa.RecordBatch:
        total = rest + np.bincount(of, counts, len(rest)).astype(np.int64)
        best = np.zeros(len(rest), np.int64)
        often = counts >= least
        np.maximum.at(best, of[often], counts[often])
        held = table(columns, rest, of[often], following[often], counts[often])
        held = held.drop_columns(["rest"]).append_column("total", pa.array(total)).append_column("best", pa.array(best))
        return held.select([*keys, "total", "best", "next", "count"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None  # the last key so far, merged
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part.set_column(part.schema.get_field_index("count"), "count", part.column("count").cast(pa.list_(pa.int64())))
            if left is not None:
                part = pa.concat_tables([left, part.select(left.schema.names).cast(left.schema)])
            columns, rest, of, following, counts = merge(part)
            whole = len(rest) - 1
            done = of < whole
            if whole:
                yield finished([c[:whole] for c in columns], rest[:whole], of[done], following[done], counts[done])
            left = table([c[whole:] for c in columns], rest[whole:], of[~done] - whole, following[~done], counts[~done])
        if left is not None:
            yield finished(*merge(left))

    return run


def stripes(rows: DataFrame, words: int, seed: int, frequent: DataFrame, size: int, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """(p1.., segment, total, best, next, count): the merged stripes of all prefixes of ``size`` words in ``rows`` (lang, text).

    ``frequent`` (p1.., n): the phrases of that size that occur ``least`` times or more, others may have no stripe;
    ``words``: the number of all words. ``total`` is of the segment; ``next`` lists its extensions that occur ``least`` times
    or more, ``count`` their occurrences, ``best`` the most of these.
    """
    keys = [f"p{k + 1}" for k in range(size)]
    hot = frequent.where(F.col("n") * SEGMENTS > words).select(*keys, "n").toArrow()  # at most SEGMENTS rows
    names = _combined([hot.column(k).to_numpy().view(np.uint64) for k in keys])
    order = np.argsort(names)
    cut = hot.column("n").to_numpy() * SEGMENTS // max(words, 1) + 1
    filter_ = rows.sparkSession.sparkContext.broadcast(_membership(frequent, keys, bits))
    kinds = ", ".join(f"{k} long" for k in keys)
    made = rows.mapInArrow(
        _stripes(seed, size, bits, filter_, (names[order], cut[order])), f"{kinds}, segment int, rest long, next array<long>, count array<int>"
    )
    dealt = made.repartition(*keys, "segment").sortWithinPartitions(*keys, "segment")
    merged = dealt.mapInArrow(_merged(size, least), f"{kinds}, segment int, total long, best long, next array<long>, count array<long>")
    return written(merged.where(F.col("total") > 0), "stripes")


def _extensions(found: DataFrame, size: int) -> DataFrame:
    """(p1.., n) of the extensions that stripes of ``size`` words list."""
    keys = [f"p{k + 1}" for k in range(size)]
    each = found.select(*keys, F.explode(F.arrays_zip("next", "count")).alias("e"))
    return each.select(*keys, F.col("e.next").alias(f"p{size + 1}"), F.col("e.count").alias("n"))


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * a / (left * right)), exactly."""
    wide = [c.cast("decimal(19,0)") for c in (a, a, left, right)]
    top = (wide[0] * wide[1]).cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)")).cast("long")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    subsumed: int = SUBSUMED,
    top: int = TOP,
    scale: int = SCALE,
) -> DataFrame:
    """The ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces
    and tabs. A phrase of 2 to ``longest`` words is a candidate with ``a`` >= ``least`` occurrences; it may overlap
    itself. Of its cuts into two parts, with l and r occurrences, the one with the smallest floor(scale * a * a / (l * r)) is
    its score, the earliest of equal ones. A candidate goes if a longer one holds it with ``subsumed`` percent of its
    occurrences or more. Rank is by score and a (descending), then phrase in byte order. A null language is ``und``; ``n``
    counts its words. Repeated rows count as often as they are there; other columns are ignored. No phrase: no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seed, words = words_of(rows)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    all_words = totals.agg(F.sum("n")).first()[0] or 0

    # phrases[k]: phrases of k words that occur often enough.
    phrases = {1: words.where(F.col("n") >= least).select(F.col("name").alias("p1"), "n")}
    found = {}
    for size in range(1, longest):
        found[size] = stripes(rows, all_words, seed, phrases[size], size, least)
        phrases[size + 1] = written(_extensions(found[size], size), "phrases")
        # The prefix totals of the stripes are the occurrences of the prefixes themselves.
        keys = [f"p{k + 1}" for k in range(size)]
        phrases[size] = found[size].groupBy(*keys).agg(F.sum("total").alias("n"), F.max("best").alias("best")).where(F.col("n") >= least)
        phrases[size] = written(phrases[size], "prefixes")

    parts = [_scored(phrases, size, longest, subsumed, scale, words) for size in range(2, longest + 1)]
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = functools.reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: dict[int, DataFrame], size: int, longest: int, subsumed: int, scale: int, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of ``size`` words that no longer one subsumes."""
    keys = [f"p{k + 1}" for k in range(size)]
    rows = phrases[size].select(*keys, F.col("n").alias("a"), *(["best"] if size < longest else []))
    if size < longest:
        # Whatever holds a phrase with some of its occurrences extends it by one word with no fewer: after it (best) or before it.
        before = phrases[size + 1].groupBy(*[F.col(f"p{k + 2}").alias(f"p{k + 1}") for k in range(size)]).agg(F.max("n").alias("before"))
        held = F.greatest("best", F.coalesce("before", F.lit(0)))
        rows = rows.join(before, keys, "left").where(100 * held < subsumed * F.col("a")).select(*keys, "a")
    cuts = []
    for k in range(1, size):
        for name, cut in ((f"l{k}", keys[:k]), (f"r{k}", keys[k:])):
            part = phrases[len(cut)].select(*[F.col(f"p{i + 1}").alias(c) for i, c in enumerate(cut)], F.col("n").alias(name))
            rows = rows.join(part, cut)
        cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}"), scale).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select(*keys, "a", "cut.score", "cut.l", "cut.r")
    for k, key in enumerate(keys):
        text = words.select(F.col("name").alias(key), F.col("word").alias(f"w{k}"), *(["lang"] if k == 0 else []))
        rows = rows.join(text, key)
    return rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(size)]).alias("phrase"), "a", "l", "r", "score")
