"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library's model is built from a rank file: bytes become printable characters, and the merges of a token are all
its splits into two known tokens, in rank order. A text is cut before every space that a non-space
follows. The split pattern never joins what such a cut parts, so the pieces encode separately and
the library sees each distinct piece of a slice once while it is remembered, many joined to one text; the bytes of
their tokens tell where each piece's ids end. Ids are then spread over all texts by index.
Decoding reverses the byte table, so ids that split a character still give back its exact bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.llm.words import coded, slices

SLICE_BYTES = 4 << 20
AT_ONCE = 1 << 18  # bytes of pieces given to the library at once
ROWS = 256  # rows decoded at once
KNOWN_PIECES = 500_000  # pieces whose ids a task remembers; beyond that it starts afresh

# What may be white space after a space: one byte, or the first two of a longer character. Others among these only
# cost a cut.
_BLANK = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_BLANK_PAIRS = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def codec(path: str):
    """(tokenizer, bytes of each id) for a rank file; built once per Python process."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores; the library's threads would spin beside them
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    letters = byte_characters()

    def spelled(token: bytes) -> str:
        return "".join(map(letters.__getitem__, token))

    merges = [
        (spelled(token[:i]), spelled(token[i:]))
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={spelled(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    tokenizer.decoder = decoders.ByteLevel()
    table = [b""] * (max(ranks.values()) + 1)
    back = {c: b for b, c in letters.items()}
    for token, rank in ranks.items():
        table[rank] = bytes(back[c] for c in spelled(token))
    return tokenizer, table


def _pieces(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """How many pieces each text has, and all of them: the text before the first space that a non-space follows, and
    the text after each such space up to the next one."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    cuts = np.flatnonzero(raw == 0x20)
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    padded = np.concatenate([raw, np.full(2, 0x20, np.uint8)])
    pair = padded[cuts + 1].astype(np.uint16) << 8 | padded[cuts + 2]
    good = (cuts + 1 < offsets[owner + 1]) & ~_BLANK[padded[cuts + 1]] & ~np.isin(pair, _BLANK_PAIRS)
    cuts, owner = cuts[good], owner[good]
    counts = 1 + np.bincount(owner, minlength=len(texts))
    last = np.cumsum(counts) - 1
    ends = np.empty(len(texts) + len(cuts), np.int64)
    inner = np.ones(len(ends), bool)
    inner[last] = False
    ends[last], ends[inner] = offsets[1:], cuts
    ends -= np.arange(len(ends)) - np.repeat(np.arange(len(texts)), counts)  # the spaces cut out before
    kept = np.ones(len(raw), bool)
    kept[cuts] = False
    ends = np.concatenate([[0], ends]).astype(np.int32)
    return counts, pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw[kept]))


def _groups(pieces: pa.StringArray) -> Iterator[list[str]]:
    """The pieces by lists of ``AT_ONCE`` bytes, or of one more piece."""
    ends = np.cumsum(np.asarray(pc.binary_length(pieces), np.int64) + 1)
    begins = np.flatnonzero(np.diff(ends // AT_ONCE, prepend=-1))
    for a, b in zip(begins, [*begins[1:], len(pieces)], strict=False):  # no group without a piece
        yield pieces.slice(a, b - a).to_pylist()


class _Encoder:
    def __init__(self, path: str):
        self.tokenizer, self.table = codec(path)
        self.widths = np.array([len(t) for t in self.table], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _spaced(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has with its space put back, and all these ids."""
        lists = [np.zeros(0, np.int32)]
        for some in _groups(pieces):
            [found] = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            lists.append(np.array(found.ids, np.int32))
        ids = np.concatenate(lists)
        ends = np.cumsum(np.asarray(pc.binary_length(pieces), np.int64) + 1)
        return np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right"), prepend=0), ids

    def _bare(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that no space precedes; nothing parts them but texts of their own."""
        lists = [np.zeros(0, np.int32)]
        for some in _groups(pieces):
            lists += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return np.array([len(x) for x in lists[1:]], np.int64), np.concatenate(lists)

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """Where the pieces, put behind a space, are among the known ones; those that are new become known."""
        places = pc.index_in(pieces, value_set=self.known)
        if len(self.known) + places.null_count > KNOWN_PIECES:
            self._forget()
            places = pa.nulls(len(pieces), pa.int32())
        fresh = pieces.filter(places.is_null())
        new = places.is_null().to_numpy(zero_copy_only=False)
        places = np.array(pc.fill_null(places, 0))
        places[new] = len(self.known) + np.arange(len(fresh))
        sizes, ids = self._spaced(fresh)
        self.known = pa.concat_arrays([self.known, fresh])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start, and all ids."""
        counts, flat = _pieces(texts)
        codes, distinct = coded(flat)
        # The first piece of a text has no space before it; all others get theirs back.
        first = np.cumsum(counts) - counts
        later = np.ones(len(codes), bool)
        later[first] = False
        spaced = np.zeros(len(distinct), bool)
        spaced[codes[later]] = True
        places = np.zeros(len(distinct), np.int64)
        places[spaced] = self._places(distinct.filter(pa.array(spaced)))
        picks = places[codes]
        bare, bare_code = np.unique(codes[first], return_inverse=True)
        sizes, ids = self._bare(distinct.take(pa.array(bare)))
        picks[first] = len(self.sizes) + bare_code
        sizes, pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        begins = np.cumsum(sizes) - sizes
        each = sizes[picks]
        ends = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(begins[picks] - ends[:-1], each) + np.arange(ends[-1])
        return np.concatenate([ends[first], ends[-1:]]), pool[where]


def _encode(path: str, column: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        widths = encoder.widths
        for part in slices(batches, column, SLICE_BYTES):
            texts = pc.fill_null(part.column(column), "")
            starts, ids = encoder(texts)
            at = pa.array(starts.astype(np.int32))
            out = [*part.columns, pa.ListArray.from_arrays(at, pa.array(ids))]
            if offsets:
                ends = np.cumsum(widths[ids])
                before = np.concatenate([[0], ends])[starts[:-1]]
                ends -= np.repeat(before, np.diff(starts))
                begins = ends - widths[ids]
                spans = pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in _in_characters(texts, starts, begins, ends)], ["start", "end"]
                )
                out.append(pa.ListArray.from_arrays(at, spans))
            yield pa.RecordBatch.from_arrays(out, [*part.schema.names, "ids", "offsets"][: len(out)])

    return run


def _in_characters(texts: pa.Array, starts, begins, ends) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans as character spans; a token that holds part of a character spans all of it."""
    left, right = np.empty_like(begins), np.empty_like(ends)
    for i, text in enumerate(texts.to_pylist()):
        raw = np.frombuffer(text.encode(), np.uint8)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        own = slice(starts[i], starts[i + 1])
        left[own] = np.maximum(lead[np.minimum(begins[own] + 1, len(raw))] - 1, 0)
        right[own] = lead[ends[own]]
    return left, right


def _decode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = codec(path)
        for batch in batches:
            # A few rows at a time, and one row's ids at a time as Python numbers.
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = [b"".join(map(table.__getitem__, ids.values.tolist() if ids.is_valid else [])) for ids in part.column(column)]
                yield part.append_column("decoded", pa.array(raw, pa.binary()))

    return run


def _digests(spelled: pa.LargeBinaryArray, ids: np.ndarray, starts: np.ndarray, skip: int = 0) -> list[str]:
    """SHA-256 of each text's ids as they are spelled, one after another, without the first ``skip`` bytes."""
    joined = spelled.take(pa.array(ids))
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1)[starts].tolist()
    raw = memoryview(joined.buffers()[2] or b"")
    return [hashlib.sha256(raw[a + skip : b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _round_trip(path: str, kept: list[str], with_ids: bool):
    """Counts and digests straight from the ids of a slice, without Python objects for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        numbers = pa.array([b",%d" % i for i in range(len(encoder.table))], pa.large_binary())
        table = pa.array(encoder.table, pa.large_binary())
        for part in slices(batches, "text", SLICE_BYTES):
            starts, ids = encoder(pc.fill_null(part.column("text"), ""))
            out = [_digests(numbers, ids, starts, 1), _digests(table, ids, starts)]
            columns = [*[part.column(c) for c in kept], pa.array(np.diff(starts).astype(np.int64)), *map(pa.array, out)]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(df: DataFrame, path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, if asked for, ``offsets`` (character start and end of each token).

    Texts are encoded whole, without special tokens; their strings are ordinary text. A null or empty text has no
    ids. All other columns pass through; columns named like the new ones are replaced. Row order does not matter
    and repeated rows are encoded alike. ``path`` must be readable on every executor.
    """
    df = df.drop("ids", "offsets")
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        extra.append(T.StructField("offsets", T.ArrayType(span)))
    return df.mapInArrow(_encode(path, text_col, offsets), T.StructType([*df.schema.fields, *extra]))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of the ids. Null ids give no bytes."""
    df = df.drop("decoded")
    return df.mapInArrow(
        _decode(path, ids_col), T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    )


def decoded_text(decoded: str = "decoded") -> Column:
    """The bytes as text; parts of characters become U+FFFD."""
    return F.decode(decoded, "UTF-8")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns to ``keep``, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (the bytes that the ids decode to) and, if asked for, ids. Encoding and decoding are one pass.
    Null and empty texts have no ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return rows.mapInArrow(_round_trip(path, kept, with_ids), schema + (", ids array<int>" if with_ids else ""))
