"""Quality rules on repeated passages within a text, by suffix arrays over words.

The suffix array of a slice of texts comes from prefix doubling: ranks of all windows of 1, 2, 4, ...
words, each text ending in a sentinel of its own, until every suffix has its own rank. The longest common
prefix of neighbouring suffixes is read off the same ranks, from the widest window down. A suffix's
deepest interval of common prefixes is as long as the larger of its two neighbours' values; shallower
intervals of that suffix lie inside it, so the union of these spans is the union of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from faultline.llm.words import coded, slices, split_lines, split_words

LEAST_WORDS = 50
REPEAT_SHARE = 50  # percent of the words that may lie in repeated three-word windows
LEAST_SPAN = 10  # words; shorter repeats are ordinary language
COVERED_SHARE = 30  # percent of the words that maximal repeats of that length may cover
LONGEST = 100  # words of the longest repeat allowed
SLICE_BYTES = 8 << 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, n_spans long, spans array<struct<start:int,end:int>>"
)


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rank of each row by its keys, the order, and whether all ranks differ."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, order, bool(new[1:].all())


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One sortable number for two ranks, both below 2**31."""
    return (left << 32) | right


def repeats(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each word, how many words from there on are found again, in the same order, elsewhere in its text."""
    sizes = np.diff(starts)
    n_docs, n = len(sizes), len(codes)
    # Words in one row, a sentinel after each text; sentinels differ, so no window spans two texts unnoticed.
    place = np.arange(n) + np.repeat(np.arange(n_docs), sizes)
    total = n + n_docs
    text = np.empty(total, np.int64)
    owner = np.repeat(np.arange(n_docs), sizes)
    text[place] = codes
    ends = starts[1:] + np.arange(n_docs)
    text[ends] = (codes.max() + 1 if n else 0) + np.arange(n_docs)
    # The same word in two texts is two letters.
    text[place], _, _ = _dense(_paired(owner, codes)) if n else (codes, None, None)
    text[ends] = (int(text[place].max()) + 1 if n else 0) + np.arange(n_docs)
    levels, width = [], 1
    rank, order, done = _dense(text)
    while True:
        levels.append(rank.astype(np.int32))
        if done:
            break
        ahead = np.zeros(total, np.int64)
        ahead[:-width] = rank[width:] + 1 if width < total else 0
        rank, order, done = _dense(_paired(rank, ahead))
        width *= 2
    # Longest common prefix of each suffix and the one before it.
    common = np.zeros(total, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    length = np.zeros(max(total - 1, 0), np.int64)
    for level in range(len(levels) - 2, -1, -1):
        size = 1 << level
        inside = np.flatnonzero(np.maximum(a, b) < total)
        same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        length[same] += size
        a[same] += size
        b[same] += size
    if total > 1:
        common[order[1:]] = length
        common[order[:-1]] = np.maximum(common[order[:-1]], length)
    return common[place]


def _per_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _covered(starts: np.ndarray, lengths: np.ndarray, at_least: int) -> np.ndarray:
    """Which words lie in a span that starts somewhere and is long enough."""
    n = len(lengths)
    long = lengths >= at_least
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.flatnonzero(long), 1)
    np.add.at(marks, np.flatnonzero(long) + lengths[long], -1)
    return np.cumsum(marks[:n]) > 0


def _three_word_windows(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that its text holds twice or more."""
    n = len(codes)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = np.flatnonzero(np.arange(n) + 3 <= starts[1:][owner])
    two, _, _ = _dense(_paired(codes[whole], codes[whole + 1]))
    three, _, _ = _dense(_paired(two, codes[whole + 2]))
    window, _, _ = _dense(_paired(owner[whole], three))
    often = np.zeros(n, np.int64)
    if len(whole):
        often[whole] = np.where(np.bincount(window)[window] > 1, 3, 0)
    return _covered(starts, often, 3)


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    starts, lines = split_lines(texts)
    codes, distinct = coded(lines)
    word_starts, _ = split_words(distinct)
    worded = np.diff(word_starts) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    _, first = np.unique(_paired(owner, codes), return_index=True)
    again = np.ones(len(codes), bool)
    again[first] = False
    return _per_doc(again & worded[codes], starts)


def _symbols(texts: pa.Array) -> np.ndarray:
    binary = pa.array(pc.fill_null(texts, "")).cast(pa.binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int32, len(binary) + 1, binary.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(binary), np.int64)
    raw = np.frombuffer(binary.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return _per_doc(_SYMBOLS[raw], offsets - offsets[0])


def _measure(least_span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = part.column("text")
            starts, words = split_words(texts)
            codes, _ = coded(words)
            chars = np.asarray(pc.utf8_length(words), dtype=np.int64)
            lengths = repeats(starts, codes)
            covered = _covered(starts, lengths, least_span)
            longest = np.zeros(part.num_rows, np.int64)
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                longest[some] = np.maximum.reduceat(lengths, starts[some])
            owner = np.repeat(np.arange(part.num_rows), np.diff(starts))
            edge = np.ones(len(covered), bool)
            edge[1:] = ~covered[:-1] | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(covered & edge)
            edge = np.ones(len(covered), bool)
            edge[:-1] = ~covered[1:] | (owner[1:] != owner[:-1])
            end = np.flatnonzero(covered & edge) + 1
            n_spans = np.bincount(owner[begin], minlength=part.num_rows)
            spans = pa.StructArray.from_arrays(
                [pa.array((x - starts[:-1][owner[begin]]).astype(np.int32)) for x in (begin, end)], ["start", "end"]
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32))
            counts = [
                np.diff(starts),
                _per_doc(chars, starts),
                _symbols(texts),
                _duplicate_lines(texts),
                _per_doc(_three_word_windows(starts, codes), starts),
                _per_doc(covered, starts),
                longest,
                n_spans,
            ]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_spans"]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.ListArray.from_arrays(offsets, spans)],
                ["doc_id", *names, "spans"],
            )

    return run


def repetition_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_span: int = LEAST_SPAN,
    covered_share: int = COVERED_SHARE,
    longest: int = LONGEST,
) -> DataFrame:
    """One row per document: counts, the spans of words that maximal repeats cover, and whether it is kept.

    A document fails the base rules with fewer than 50 words or with over half of its words in repeated
    three-word windows. It fails the suffix-array rules if maximal repeats of ``least_span`` words or more cover over
    ``covered_share`` percent of its words, or if the longest repeat has over ``longest`` words. Spans are word
    positions, end exclusive, every occurrence included. Null and empty texts have no words and fail the base.
    Repeated rows give a row each; extra columns are ignored. A text is measured whole, in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_measure(least_span), _SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    repeated = (100 * F.col("covered_words") > covered_share * F.col("n_words")) | (F.col("longest_repeat") > longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeated)
