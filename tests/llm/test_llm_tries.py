"""The prefix trie, phrase collocations and token files against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.llm import collocations, prefix_trie, token_planes
from faultline.llm.queries import words_path
from faultline.operators.shared import new_path
from llm_tables import awkward, plain, words


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, children = defaultdict(list), Counter()
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for prefix, own_members in members.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += (len(own_members) - 1) * len(prefix[-1][1].encode()) if prefix else 0
    out = []
    for prefix, m in members.items():
        ends = ",".join(str(c) for c in m if len(new[c]) == len(prefix))
        parent = members[prefix[:-1]][0] if prefix else None
        out.append((m[0], len(prefix), parent, len(m), children[prefix], leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(turns):
    return sorted(map(plain, prefix_trie.regrouped_trie(turns).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_random_conversations(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é"])) for c in range(-7, 60) for t in range(rng.choice([1, 2, 3, 9, 17]))]
    got = trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got == brute_trie(rows) and len(got) > 100


def test_trie_of_awkward_turns(spark):
    rows = [(5, 0, "user", "hi"), (5, 0, "user", "hi"), (5, None, None, None), (6, None, "", ""), (8, 1, None, "x" * 5000), (8, 1, "user", None)]
    rows += [(None, 0, "user", "left out"), (12, 3, "user", "hi"), (10**15, 0, "user", "hi"), (10**15 + 1, 0, "user", "hi"), (-3, 0, "a\nb", "c"), (-3, 0, "a", "b\nc")]
    rows += [(77, t, "user", f"{t}") for t in range(20)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("pos", "name", "parent", "b", "d1", "weight")})
    assert trie(turns) == brute_trie(rows)
    assert trie(turns.where("false")) == []
    # Only members without turns: the root is the one leaf.
    got = prefix_trie.prefix_trie(spark.range(3).select(F.col("id").alias("conv")), spark.createDataFrame([], "conv long, pos long, d1 long, d2 long, size long"))
    assert [plain(r)[:7] for r in got.collect()] == [(0, 0, None, 3, 0, 1, 0)]


def test_trie_of_a_hot_conversation_in_runs(spark, monkeypatch):
    from faultline.operators import ordered

    rows = [(5, t, "user", f"t{t // 2}") for t in range(60)] + [(c, t, "user", "t0") for c in range(20, 30) for t in range(3)]
    want = brute_trie(rows)
    plain_rows = prefix_trie.ordered_features
    monkeypatch.setattr(prefix_trie, "ordered_features", lambda *a, **k: plain_rows(*a, **k, hot_rows=20))
    assert ordered.HOT_ROWS > 60 and trie(spark.createDataFrame(rows, TURNS).repartition(4)) == want


def test_end_digests_of_many_ids(spark):
    """Lists of ids longer than a piece, negative ones included, over several batches."""
    ends = spark.range(-9000, 9000).select(F.lit(1).alias("depth"), F.pmod("id", F.lit(2)).alias("name"), F.col("id").alias("conv"))
    got = {r.name: r.ends_sha256 for r in prefix_trie._end_digests(ends).collect()}
    for name in (0, 1):
        assert got[name] == hashlib.sha256(",".join(str(c) for c in range(-9000, 9000) if c % 2 == name).encode()).hexdigest()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, longest=3, least=10, subsumed=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    held = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * held[lang, p] < subsumed * a or not held[lang, p]:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top], 1)
    )


def phrases_of(rows, count, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "new", "york", "city", "x.y", "end.", "a,", " b", "st\u0085ate", "3"]
    for _ in range(rows):
        text = " ".join(rng.choice(vocabulary) if rng.random() < 0.6 else "New York city" for _ in range(count))
        yield rng.choice(["en", None, "und", "de"]), text.replace(" 3 ", rng.choice([" 3\n", "\t3\x0b", "!3 "]))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations(spark, longest):
    rows = [*phrases_of(60, 40, longest), ("en", None), ("en", ""), (None, " \t\n.,"), ("fr", "one two"), ("en", "a a " * 40), ("de", "w" * 30000)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "p1", "word", "name", "rank")}).repartition(4)
    got = collocations.collocations(docs, longest=longest, least=7, top=50)
    assert sorted(map(plain, got.collect())) == brute_collocations(rows, longest, 7, 50, 50)
    assert collocations.collocations(docs.where("false")).collect() == []


def test_collocations_whatever_the_filter_and_the_slices(spark, monkeypatch):
    """A filter that lets everything through, prefixes cut into many segments, a slice per text: the same rows."""
    rows = [*phrases_of(80, 30, 5)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "SEGMENTS", 100_000)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1)
    monkeypatch.setattr(collocations, "WORDS_HELD", 3)
    monkeypatch.setattr(collocations.stripes, "__defaults__", (collocations.LEAST, 6))
    assert sorted(map(plain, collocations.collocations(docs).collect())) == brute_collocations(rows)


def test_words_that_share_a_name_change_the_seed(spark, monkeypatch):
    names = collocations.word_names
    monkeypatch.setattr(collocations, "word_names", lambda langs, texts, seed: (names(langs, texts, seed)[0] * np.uint64(seed > 1), *names(langs, texts, seed)[1:]))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["one two two"]})
    found = [x for b in collocations._word_counts(1)([batch]) for x in b.to_pylist()]
    assert sorted((x["name"], x["word"], x["n"]) for x in found) == [(0, "one", 1), (0, "two", 2)]


def test_scores_beyond_64_bits(spark):
    row = spark.sql("select 4000000000000L as a, 5000000000000L as l, 6000000000001L as r")
    score = row.select(collocations._score(F.col("a"), F.col("l"), F.col("r"), 1_000_000)).first()[0]
    assert score == 1_000_000 * (4 * 10**12) ** 2 // (5 * 10**12 * (6 * 10**12 + 1))


TEXTS = ["Hello, WORLD's 'sun' it's. don't!!", "", " ", "a.b,c;d", "x've. y'll", "é É. J̌ H̱, K", "İstanbul. İ, ß", "<|endoftext|> <|startoftext|>x",
         "…. a…", "漢字。 ٣٤. 1234", "\x1c a\x85b c", "word" * 400 + ".", "##", "\U0001f600. a\U0001f600!", "naïve, café. Über", "\x00a", "'s 't. 'S"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé É'sT.,!?1 \n\t́̌J#"), max_size=40), max_size=6))
def test_word_encoder_equals_the_library(texts):
    encoder = token_planes.word_encoder(words_path())
    texts = [*texts, *TEXTS]
    starts, ids = encoder(pa.array(texts, pa.string()), 2)
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([token_planes.BYTES, token_planes.BITS]), st.integers(1, 20), st.data())
def test_segments_round_trip(ids, planes, block, data):
    ids = np.array(ids, np.uint32)
    cut = data.draw(st.integers(0, len(ids)))
    raw = token_planes.pack(3, 4, pa.array([7, None], pa.int64()), np.array([cut, len(ids) - cut]), ids, planes, block, 1)
    files = [*token_planes.segments_of(memoryview((raw + token_planes.MARK) * 2))]
    assert len(files) == 2 and (files[1].part, files[1].number, files[1].doc_ids.to_pylist()) == (3, 4, [7, None])
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert files[1].ids_between(a, b).tolist() == ids[a:b].tolist() and files[0].sizes.tolist() == [cut, len(ids) - cut]


def test_damage_is_seen():
    raw = bytearray(token_planes.pack(0, 0, pa.array([1]), np.array([3]), np.array([1, 2, 300], np.uint32), token_planes.BYTES, 8, 1))
    raw[-1] ^= 1  # of the index
    with pytest.raises(ValueError):
        token_planes.Segment(memoryview(bytes(raw))).block_ids(0)
    with pytest.raises(ValueError):
        token_planes.Segment(memoryview(bytes(raw[:-4])))


@pytest.mark.parametrize("planes", [token_planes.BYTES, token_planes.BITS])
def test_stored_ids(spark, planes):
    docs = awkward(spark)
    library = token_planes.word_encoder(words_path()).tokenizer
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sizes, want = defaultdict(list), Counter()
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        sizes[r.doc_id].append(len(ids))
        want[r.doc_id, len(ids), zlib.crc32(ids)] += 1
    got = token_planes.stored(docs, words_path(), planes=planes, block=64, segment=500).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    # Starts are gapless, and ids ascend along them, null last.
    at = 0
    for r, w in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        assert (r.start, r.doc_id) == (at, w.doc_id)
        at += r.n_tokens
    assert token_planes.stored(docs.where("false"), words_path()).collect() == []


def test_ids_read_back(spark):
    docs = spark.createDataFrame([(2, "Hello there"), (1, None)], "doc_id long, text string")
    path = new_path(spark, "ids")
    token_planes.write_ids(docs, path, words_path(), end=9)
    found = {r.doc_id: r.ids for r in token_planes.read_ids(spark, path, with_ids=True).collect()}
    assert found == {1: [9], 2: [*token_planes.word_encoder(words_path()).tokenizer.encode("Hello there").ids, 9]}
