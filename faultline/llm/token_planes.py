"""Token ids as binary files: fixed-size blocks of ids, transposed into byte or bit planes, each compressed.

A file is a row of segments. A segment holds whole documents, in ascending order of their ids:

    head      MAGIC, then little-endian: length of the segment, part, number in the part, documents, token ids (5 x u64),
              ids of a block (u32), planes of a block (u32), bytes of the document table (u32), blocks (u32)
    documents zstandard frame: doc_id (i64 each), 1 if it is known and 0 if null (u8 each), number of ids (u64 each)
    chunks    per block, per plane: a zstandard frame; a plane of zeros only has no bytes
    index     per block, per plane: bytes of the chunk (u32); per block: CRC-32 of its ids (u32)

and is followed by MARK. Planes: with four, plane k holds byte k of each id; with 32, bit k of each id, eight ids a
byte. With the index any block is found and decoded without the others (``ids_between``).

Writing: rows are dealt to parts by ranges of doc_id, sorted inside the part, encoded and packed; nothing but texts
is shuffled. Every part writes its own bounded files. Reading: files are read whole, segments are decoded one at a time;
where a document's ids begin among all ids follows from running sums over parts, then over the segments of a part.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm.words import coded, slices
from faultline.operators.shared import new_path, written

END_ID = 2
BLOCK = 1 << 16  # ids of a block
SEGMENT = 1 << 20  # ids from which a segment is closed; a longer document has one of its own
FILE_SEGMENTS = 8  # segments of a file
LEVEL = 1  # of compression
BYTES, BITS = 4, 32  # planes of a block
KNOWN_WORDS = 600_000  # words whose ids a process remembers; beyond that it starts afresh
AT_ONCE, LISTS = 1024, 16  # words given to the library as one text, and such texts at once

SLICE_BYTES = 12 << 20  # of texts encoded together

MAGIC, MARK = b"IDPLANE1", b"\n--end of segment--\n"
_HEAD = struct.Struct("<8s5Q4I")


_TAIL = ".,;:!?"


def _gather(starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each picked run begins (one more entry than picks), and the runs one after another."""
    each = sizes[picks]
    ends = np.concatenate([[0], np.cumsum(each)])
    small = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64
    where = np.repeat((starts[picks] - ends[:-1]).astype(small), each)
    where += np.arange(ends[-1], dtype=small)
    return ends, pool[where]


def _parted(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each word up to the marks after its last letter, and those marks: the tokenizer always parts them there.

    Lower case before normalisation is the same for ASCII only.
    """
    words = pa.concat_arrays([words])
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    bare = np.asarray(pc.binary_length(pc.ascii_rtrim(words, _TAIL)), np.int32)
    last = letters[np.maximum(ends[:-1] + bare - 1, 0)] | 32 if len(letters) else bare
    cut = (bare > 0) & (last >= ord("a")) & (last <= ord("z"))
    stem_sizes = np.where(cut, bare, np.diff(ends))
    own = np.arange(len(words))
    stems = pa.StringArray.from_buffers(len(words), *_texts(ends[:-1], stem_sizes, own, letters))
    tails = pa.StringArray.from_buffers(len(words), *_texts(ends[:-1] + stem_sizes, np.diff(ends) - stem_sizes, own, letters))
    return pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems), tails


def _texts(starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray, letters: np.ndarray) -> tuple[pa.Buffer, pa.Buffer]:
    ends, flat = _gather(starts, sizes, picks, letters)
    return pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, never joins what white space parts, and ends words visibly.

    So words encode separately, and each distinct one is given to the library once while it is remembered. Strings
    of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.places, self.ids, self.sizes = {"": 0}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per word, words given as separate ones."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def _encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        lists = [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        ids, sizes = [], []
        for at in range(0, len(lists), LISTS):
            some = lists[at : at + LISTS]
            for own, found in zip(some, self.tokenizer.encode_batch_fast(list(map(" ".join, some)), add_special_tokens=False), strict=True):
                flat = np.array(found.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[flat]) + 1
                # Every word ends at least once; if some end more often, their ids are counted word by word.
                one, n = (flat, np.diff(ends, prepend=0)) if len(ends) == len(own) else self._each(own)
                ids.append(one)
                sizes.append(n)
        return ids, sizes

    def _places(self, parts: pa.Array) -> np.ndarray:
        codes, distinct = coded(parts)
        parts = distinct.to_pylist()
        new = [p for p in parts if p not in self.places]
        if new:
            plain = [p for p in new if p.isalpha()]
            other = [p for p in new if not p.isalpha()]
            ids, sizes = self._encode(plain)
            for at in range(0, len(other), AT_ONCE):
                one, n = self._each(other[at : at + AT_ONCE])
                ids.append(one)
                sizes.append(n)
            self.places.update(zip([*plain, *other], range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])
        return np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))[codes]

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start (one more entry than texts), and all ids; each text ends with ``end``."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        codes, distinct = coded(lists.values)
        if len(self.places) > KNOWN_WORDS:
            self._forget()
        stems, tails = map(self._places, _parted(distinct))
        # The ids of each distinct word, then of each word.
        ends, pool = _gather(np.cumsum(self.sizes) - self.sizes, self.sizes, np.stack([stems, tails], axis=1).reshape(-1), self.ids)
        begins, sizes = ends[:-1:2], np.diff(ends[::2])
        starts = lists.offsets.to_numpy().astype(np.int64)
        if end is not None:  # one more word for each text, whose only id is the end
            codes = np.insert(codes, starts[1:], len(sizes))
            starts = starts + np.arange(len(starts))
            begins, sizes, pool = np.append(begins, len(pool)), np.append(sizes, 1), np.append(pool, np.uint32(end))
        ends, ids = _gather(begins, sizes, codes, pool)
        return ends[starts], ids


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One per Python process: what it remembers serves the next tasks, too."""
    return WordEncoder(path)


def planes_of(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block of ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTES:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    by_byte = [np.unpackbits(np.ascontiguousarray(raw[:, k])[:, None], axis=1, bitorder="little") for k in range(4)]
    return [np.packbits(by_byte[k // 8][:, k % 8], bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes; an empty plane is all zeros."""
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if len(planes) == BYTES:
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return raw.view("<u4").reshape(n)


def pack(part: int, number: int, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray, planes: int, block: int, level: int) -> bytes:
    """One segment, without the mark that follows it."""
    press = zstandard.ZstdCompressor(level=level).compress
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    names = doc_ids.fill_null(0).to_numpy()
    table = press(names.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + sizes.astype("<u8").tobytes())
    chunks, checks = [], []
    for at in range(0, len(ids), block):
        own = np.ascontiguousarray(ids[at : at + block], "<u4")
        checks.append(zlib.crc32(own))
        chunks += [press(p) if p.strip(b"\0") else b"" for p in planes_of(own, planes)]
    index = np.array([*map(len, chunks), *checks], "<u4").tobytes()
    size = _HEAD.size + len(table) + sum(map(len, chunks)) + len(index)
    head = _HEAD.pack(MAGIC, size, part, number, len(sizes), len(ids), block, planes, len(table), len(checks))
    return b"".join([head, table, *chunks, index])


class Segment:
    """A packed segment: ``doc_ids``, ``sizes`` and, on demand, ids."""

    def __init__(self, data: memoryview):
        magic, size, self.part, self.number, n, self.n_ids, self.block, self.planes, table, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or size > len(data):
            raise ValueError("not a whole segment of token ids")
        self._data, self._press = data[:size], zstandard.ZstdDecompressor()
        raw = self._press.decompress(data[_HEAD.size : _HEAD.size + table], max_output_size=17 * n)
        known = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(raw, "<i8", n), mask=~known)
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        index = np.frombuffer(data, "<u4", blocks * (self.planes + 1), size - 4 * blocks * (self.planes + 1))
        self._lengths, self._checks = index[: blocks * self.planes].astype(np.int64), index[blocks * self.planes :]
        self._starts = _HEAD.size + table + np.cumsum(self._lengths) - self._lengths

    def block_ids(self, b: int) -> np.ndarray:
        """The ids of block ``b``, checked."""
        n = min(self.block, self.n_ids - b * self.block)
        own = range(b * self.planes, (b + 1) * self.planes)
        plane = n if self.planes == BYTES else -(-n // 8)
        chunks = [bytes(self._data[self._starts[k] : self._starts[k] + self._lengths[k]]) for k in own]
        ids = ids_of([self._press.decompress(c, max_output_size=plane) if c else b"" for c in chunks], n)
        if zlib.crc32(ids) != self._checks[b]:
            raise ValueError("a block of token ids is damaged")
        return ids

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the segment, from the blocks that hold them."""
        first, last = start // self.block, -(-stop // self.block)
        found = [self.block_ids(b) for b in range(first, last)] if stop > start else []
        return np.concatenate([*found, np.zeros(0, "<u4")])[start - first * self.block : stop - first * self.block]


def segments_of(content: memoryview) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(content):
        (size,) = struct.unpack_from("<Q", content, at + len(MAGIC))
        yield Segment(content[at : at + size])
        at += size + len(MARK)
        if bytes(content[at - len(MARK) : at]) != MARK:
            raise ValueError("a segment of token ids does not end where it should")


def _packed(path: str, end: int, planes: int, block: int, segment: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, part = word_encoder(path), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays([x[0] for x in held])
            data = pack(part, number, names, *[np.concatenate([x[k] for x in held]) for k in (1, 2)], planes, block, level)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for piece in slices(batches, "text", SLICE_BYTES):
            part = piece.column("part")[0].as_py()
            starts, ids = encoder(piece.column("text"), end)
            sizes, at = np.diff(starts), 0
            while at < len(sizes):
                room = segment - sum(len(x[2]) for x in held)
                upto = max(at + 1, int(np.searchsorted(starts, starts[at] + room, side="right")) - 1)
                held.append((piece.column("doc_id").slice(at, upto - at), sizes[at:upto], ids[starts[at] : starts[upto]]))
                at = upto
                if at < len(sizes) or sum(len(x[2]) for x in held) >= segment:
                    yield close()
                    held, number = [], number + 1
        if held:
            yield close()

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END_ID,
    planes: int = BYTES,
    block: int = BLOCK,
    segment: int = SEGMENT,
    level: int = LEVEL,
) -> None:
    """Files of the ids of every whole text, each ended by ``end``, in ascending order of ids, under ``path``.

    Null ids come last, rows of equal id in an order that depends on the digest of their text, so equal rows are spread over parts when there
    are many. Null and empty texts have the end only. Texts of special tokens are ordinary text. Columns other than
    the two are ignored, whatever their names. No rows: no segment. A text is encoded, and a document stored, as one piece.
    """
    if planes not in (BYTES, BITS):
        raise ValueError(f"{planes} planes: {BYTES} (bytes) or {BITS} (bits)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"_digest": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("_digest"), F.col("_copy")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    packed = dealt.mapInArrow(_packed(tokenizer_path, end, planes, block, segment, level), "segment binary")
    # Written byte for byte: the text writer does not look into its strings.
    lines = packed.select(F.col("segment").cast("string")).write.option("lineSep", MARK.decode())
    lines.option("maxRecordsPerFile", FILE_SEGMENTS).option("compression", "none").text(path)


def _unpacked(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for s in segments_of(memoryview(content.as_buffer())):
                    ids = s.ids_between(0, s.n_ids)
                    ends = np.cumsum(s.sizes)
                    starts = ends - s.sizes
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                    n = len(ends)
                    columns = [pa.array(np.full(n, s.part, np.int64)), pa.array(np.full(n, s.number, np.int64)), s.doc_ids]
                    columns += [pa.array(starts), pa.array(s.sizes), pa.array(np.array(crcs, np.int64))]
                    if with_ids:
                        places = pa.array(np.append(starts, s.n_ids).astype(np.int32))
                        columns.append(pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["part", "number", "doc_id", "own_start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(part, number, doc_id, own_start, n_tokens, ids_crc32) and, if asked for, ``ids``: a row per document of the files
    under ``path``; ``own_start`` counts from the segment's first id. Every block is checked; a damaged file raises."""
    schema = "part long, number long, doc_id long, own_start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_unpacked(with_ids), schema + (", ids array<int>" if with_ids else ""))


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_ids`` with ``start``: the ids of all documents before. Sums run over parts, then over the segments
    of a part."""
    segments = written(rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("total")), "segments")
    parts = segments.groupBy("part").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before_part"))
    inside = F.sum("total").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.select("part", "number", F.coalesce(inside, F.lit(0)).alias("before")).join(parts, "part")
    joined = rows.join(segments, ["part", "number"])
    return joined.withColumn("start", F.col("before_part") + F.col("before") + F.col("own_start")).drop("before", "before_part")


def stored(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``docs``, read back from files written for them in the shared
    folder; options as for ``write_ids``."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path, **options)
    rows = written(read_ids(docs.sparkSession, path), "read-back")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
