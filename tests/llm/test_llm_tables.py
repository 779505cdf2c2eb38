"""Search, archives, chat and the pipeline."""

import gzip
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from faultline.llm import chat_events, multi_index, warc
from llm_tables import awkward


def test_search_finds_most_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 12)).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [1.0] * 3), (None, [1.0] * 12), (2400, [None] * 12)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in multi_index.search(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 1500, 100))
    exact = vectors.astype(np.float64)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == list(range(1, 11)) and all(s == pytest.approx(d[v], rel=1e-12) for v, s in found.values())
        assert [x[::-1] for _, x in sorted(found.items())] == sorted(x[::-1] for x in found.values())
    assert hits >= 0.9 * 10 * len(got)


def test_search_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 3, 5, 100)], schema)
    got = [tuple(r) for r in multi_index.search(same).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 5, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 5, 0.0)]
    assert multi_index.search(same.where("false")).collect() == []
    assert multi_index.search(spark.createDataFrame([(1, None)], schema)).collect() == []


def test_unusable_vectors_do_not_choose_the_length(spark):
    schema = "vec_id long, embedding array<float>"
    sound = [(100 * i, [float(i), 1.0, 2.0]) for i in range(3)]
    for bad in ([], [0.0, 0.0], [float("nan")] * 4, [None]):
        table = spark.createDataFrame(sound + [(1000 + i, bad) for i in range(9)], schema)
        got = [tuple(r) for r in multi_index.search(table, k=1).orderBy("query_id").collect()]
        assert got == [(0, 1, 100, 1.0), (100, 1, 0, 1.0), (200, 1, 100, 1.0)]
    assert multi_index.search(spark.createDataFrame([(1, []), (2, [])], schema)).collect() == []


def test_vectors_of_one_component(spark):
    table = spark.createDataFrame([(100 * i, [float(x)]) for i, x in enumerate((1, 2, 4, 8))], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in multi_index.search(table, k=1).orderBy("query_id").collect()]
    assert got == [(0, 1, 100, 1.0), (100, 1, 0, 1.0), (200, 1, 100, 2.0), (300, 1, 200, 4.0)]


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    first, second = rng.random(6), rng.random(5)
    counts = rng.integers(0, 3, (6, 5))
    order = sorted(((first[i] + second[j], i, j) for i in range(6) for j in range(5) if counts[i, j]))
    assert multi_index.traverse(first, second, counts, 10**9) == [(i, j) for _, i, j in order]


def test_archives_give_back_every_page(spark):
    html = ["same" * 9000, "same" * 9000, None, "", "0\r\n\r\nWARC/1.1\r\n\r\n", "ü" * 30000, "one"]
    rows = [(i, f"http://x/{i}\r\ny" if i % 2 else None, h, "clash") for i, h in enumerate(html)]
    rows += [(None, "u", "nul", "c"), rows[1]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = Counter(map(tuple, warc.archived(pages, segment=4096).collect()))
    top = {h or "": max(i for i, _, x, _ in rows if (x or "") == (h or "") and i is not None) for h in html}
    want = Counter()
    for i, _, h, _ in rows:
        payload, last = (h or "").encode(), top.get(h or "", i)
        kind = "response" if last == i else "revisit"
        want[(i, len(payload), warc.payload_digest(payload), kind, None if last == i else last, True)] += 1
    assert got == want
    assert warc.archived(pages.where("false")).collect() == []


def test_segments_in_any_order(spark):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(bytes(range(256)) * 50, 100)
    cuts = [body[i : i + 1000] for i in range(0, len(body), 1000)]

    def record(origin, n, total, block):
        return (f"{origin}{n}", None, "response" if n == 1 else "continuation", origin, n, total, "u", None, None, block)

    def parts(origin, total):
        return [record(origin, n, total if n == len(cuts) else None, c) for n, c in enumerate(cuts, 1)]

    whole, short, odd = parts("a", len(body)), parts("b", len(body)), parts("c", len(body) + 1)
    rows = [*whole[::-1], whole[2], *short[:3], *short[4:], *odd]
    records = spark.createDataFrame(rows, warc.RECORD).repartition(4)
    got = {r.record_id: (r.complete, r.payload) for r in warc.payloads(warc.reassemble(records)).collect()}
    assert got["a1"][0] and bytes(got["a1"][1]) == bytes(range(256)) * 50
    assert [got[k] for k in ("b1", "c1")] == [(False, None)] * 2


def test_framing():
    for body in (b"", b"a", b"x" * 20000):
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.dechunked(b"5\r\nhel") is None and warc.dechunked(b"zz\r\n") is None


def stored(name, body, length=None, *extra):
    length = len(body) if length is None else length
    head = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: " + name, *extra, b"Content-Length: %s" % str(length).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


A, B, C = (stored(n, n * 500) for n in (b"a", b"b", b"c"))
QUOTED = stored(b"q", b"x\r\n\r\nWARC/1.1 quoted")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (A + B + QUOTED + C, "a b q c"),
        (b"", ""),
        (A + b"\r\n\r\n" + B.rstrip(), "a b"),
        (A + B[:-200] + C, "a - c"),  # a cut block
        (A + B[:40] + b"\r\n" + C, "a - c"),  # a cut header
        (A + stored(b"b", b"long", 9) + C, "a - c"),
        (A + stored(b"b", b"long", 2) + C, "a - c"),
        (A + stored(b"b", b"long", 10**17) + C, "a - c"),
        (A + stored(b"b", b"long", "four") + C, "a - c"),
        (A + stored(b"b", b"long", "4", b"WARC-Segment-Number: one") + C, "a - c"),
        (A + stored(b"b", b"long", "4", b"WARC-Segment-Number: 1", b"WARC-Segment-Total-Length: -1") + C, "a - c"),
        (A + b"garbage\nWARC/ no\n" + B + C[:90], "a - b -"),
        (C[:90], "-"),
        (b"\0" * 100, "-"),
        (gzip.compress(A) + gzip.compress(B) + gzip.compress(C), "a b c"),
        (gzip.compress(A) + gzip.compress(B)[:-30] + gzip.compress(C), "a - c"),
        (gzip.compress(A) + gzip.compress(B) + gzip.compress(C)[:20], "a b -"),
        (gzip.compress(A)[:20] + gzip.compress(B)[:20] + gzip.compress(C), "- c"),
    ],
)
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_reading_goes_on_after_damage(raw, want, size):
    pieces = (p if p is None else p[i : i + size] for p in warc._inflated(memoryview(raw)) for i in range(0, len(p or b"x"), size))
    found = list(warc._parse(pieces))
    assert " ".join("-" if r["type"] == warc.DAMAGED else r["record_id"] for r in found) == want
    assert all(r["block"] == r["record_id"].encode() * 500 for r in found if r["record_id"] in ("a", "b", "c"))


def test_a_broken_byte_costs_what_follows_it_only(spark, tmp_path):
    rng = random.Random(5)
    records = [stored(b"r%d" % i, rng.randbytes(2000)) for i in range(60)]
    first, second = gzip.compress(b"".join(records[:50]), 1), gzip.compress(b"".join(records[50:]), 1)
    broken = bytearray(first)
    broken[60_000:60_400] = b"\xff" * 400  # stored bytes at this level: shown by the checksum or the block only
    (tmp_path / "x.warc.gz").write_bytes(bytes(first[: len(first) * 2 // 3]) + second)
    (tmp_path / "y.warc.gz").write_bytes(bytes(broken) + second)
    (tmp_path / "z.warc").write_bytes(records[0])
    rows = warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()
    got = Counter(r.record_id for r in rows if r.complete)
    assert all(got[f"r{i}"] >= 2 for i in (*range(20), *range(50, 60))) and got["r0"] == 3
    assert sum(not r.complete for r in rows) >= 1 and all(r.type == warc.DAMAGED for r in rows if not r.complete)


def test_events_fold_to_the_last_version(spark):
    log = [
        (1, 0, 1, "open", "user", ""), (1, 1, 1, "delta", "user", "hel"), (1, 2, 1, "delta", "user", "lo"),
        (1, 3, 2, "open", "assistant", ""), (1, 4, 2, "delta", "assistant", "bad"), (1, 5, 1, "edit", "user", "hi"),
        (1, 6, 2, "regenerate", "assistant", ""), (1, 7, 2, "delta", "assistant", "go"), (1, 8, 2, "delta", "assistant", "od"),
        (1, 9, 1, "delta", "user", "!"), (1, 10, 2, "delta", "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, event string, role string, text string").repartition(4)
    folded = chat_events.fold_messages(events)
    assert [tuple(r)[1:] for r in folded.orderBy("message").collect()] == [(0, "user", "hi!"), (3, "assistant", "good")]
    shown = chat_events.render(folded).first()
    assert shown.formatted == "<|im_start|>user\nhi!<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    assert [shown.formatted[m.start : m.end] for m in shown["mask"]] == ["good"]


def test_control_strings_come_back(spark):
    turns = [
        (1, 0, "user", "<|im_end|><\\|<\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\nx<|nl|>\\"), (1, 1, "assistant", "tie"),
        (1, None, "a\nb<|", None), (None, 3, None, "é😀"), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
    ]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, seq string")
    read = chat_events.read_back(chat_events.render(chat_events.fold_messages(chat_events.event_log(table, 3))))
    got = Counter((r.conv_id, r.role, r.text, r.masked) for r in read.collect())
    assert got == Counter((c, r or "", t or "", (t or "") if r == "assistant" else None) for c, _, r, t in turns)
    assert chat_events.formatted_digests(table.where("false")).collect() == []


def test_pipeline_stages_take_effect(spark):
    docs = awkward(spark)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(stage(spark, kept[-1], SMALL))
        assert kept[-1].columns == list(corpus_pipeline.COLUMNS)
    toxic, lines, near, mixed = (k.select("doc_id", "text").collect() for k in kept[1:])
    assert len(toxic) == len(lines) == docs.count()  # nothing here is toxic, and lines go without their documents
    seen = Counter(x for r in lines for x in (r.text or "").split("\n") if x.strip())
    # Rows that repeat an id and text are one place, so only they may hold a line twice.
    repeated = {x for r in lines if r.doc_id == 0 for x in r.text.split("\n")}
    assert all(n == 1 for x, n in seen.items() if x not in repeated)
    assert len({r.doc_id for r in near}) == len(near) < len(lines)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mixed).values()) <= 2
    tokens = corpus_pipeline.STAGES[4][1](spark, kept[-1], SMALL).collect()
    import hashlib

    assert Counter((r.doc_id, r.decoded_sha256) for r in tokens) == Counter(
        (r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed
    )


def test_pipeline_of_nothing(spark):
    docs = awkward(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == [] and "ids" in docs.columns


def test_masks_follow_the_role(spark):
    messages = spark.createDataFrame([(1, 0, "tool", "a"), (1, 1, "user", "b")], "conv_id long, message long, role string, text string")
    shown = chat_events.render(messages, trained="user").select("formatted", F.explode("mask").alias("m")).first()
    assert shown.formatted[shown.m.start : shown.m.end] == "b"
