"""Repetition rules, byte-level BPE, toxicity, secrets and mixing."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline.llm import blob_ledger, byte_bpe, pareto_mix, pu_toxicity, repetition
from faultline.llm.queries import ranks_path
from llm_tables import awkward, words


def lengths(w):
    out = [0] * len(w)
    for b in range(len(w)):
        for a in range(b):
            k = 0
            while b + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            out[a], out[b] = max(out[a], k), max(out[b], k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), max_size=5))
def test_repeats_equal_their_definition(texts):
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([c for t in texts for c in t], np.int64)
    assert repetition.repeats(starts, codes).tolist() == [x for t in texts for x in lengths(t)]


def test_repetition_rules(spark):
    rng = random.Random(2)
    passage = words(rng, 130)
    texts = {
        1: words(rng, 200),
        2: f"{passage} {words(rng, 600)} {passage}",  # a long repeat in a text that is mostly new
        3: " ".join([words(rng, 40)] * 9),
        4: words(rng, 49),
        5: " ".join(words(rng, 12) for _ in range(6)) + (" " + "one two three four five six seven eight nine ten") * 5,
    }
    rows = {r.doc_id: r for r in repetition.repetition_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [rows[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert [rows[i].base_failed for i in range(1, 6)] == [False, False, True, True, False]
    assert rows[2].longest_repeat >= 130 and [(s.start, s.end) for s in rows[2].spans][0] == (0, 130)
    out = repetition.repetition_rules(awkward(spark)).collect()
    assert len(out) == awkward(spark).count() and not any(r.kept for r in out if r.n_words < 50)
    assert repetition.repetition_rules(awkward(spark).where("false")).collect() == []


ODD = [None, "", " ", "a  b", "a \n", "\n\n x", "it's 's", "\x1c x \x85z", "😀é 漢字　a", "<|endoftext|> hi", " " * 50 + "q", "x" * 3000]


def test_tokens_equal_the_reference_library(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [*ODD, *["".join(rng.choice(" \n\tab1'!sé漢😀　") for _ in range(40)) for _ in range(200)]]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode(df, ranks_path(), offsets=True)
    rows = byte_bpe.decode(encoded, ranks_path()).withColumn("back", byte_bpe.decoded_text()).collect()
    table = byte_bpe.codec(ranks_path())[1]
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == other.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.back == text
        assert all(table[i] in text[o.start : o.end].encode() for i, o in zip(r.ids, r.offsets, strict=True))
    assert byte_bpe.round_trip(awkward(spark), ranks_path()).count() == awkward(spark).count()


def test_the_library_sees_each_piece_once_in_few_texts(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer, table = byte_bpe.codec(ranks_path())
    given: list[str] = []

    class Counted:
        def encode_batch_fast(self, some, **kind):
            given.extend(some)
            return tokenizer.encode_batch_fast(some, **kind)

    monkeypatch.setattr(byte_bpe, "codec", lambda path: (Counted(), table))
    rng = random.Random(4)
    blanks = "\t\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    texts = ["".join(rng.choice("  ab1'!é漢“、" + blanks) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["", " ", "漢字" * 500, " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(3000, 0, -1))]
    encoder = byte_bpe._Encoder(ranks_path())
    for at in (0, 200, 400, 400):  # the last slice again: its pieces behind a space are known
        some, before = texts[at : at + (5 if at == 400 else 200)], len(given)
        starts, ids = encoder(pa.array(["cut off", *some]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [other.encode_ordinary(t) for t in some]
    assert sum(map(len, given[before:])) < 1100  # first pieces only
    assert sum(t.count("漢字" * 500) for t in given) == 2 and len(given) < 1000
    assert sum(t.count(" w1500 ") for t in given) == 1

    # A memory that is too small changes nothing.
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 10)
    encoder = byte_bpe._Encoder(ranks_path())
    for some in (texts[:200], texts[200:], ["", "a"], ["a b"]):
        starts, ids = encoder(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [other.encode_ordinary(t) for t in some]


def test_ids_that_split_a_character(spark):
    ids = byte_bpe.codec(ranks_path())[0].encode("漢").ids
    table = byte_bpe.codec(ranks_path())[1]
    half = next(i for i, t in enumerate(table) if t == "漢".encode()[:1])
    df = spark.createDataFrame([(ids,), ([half],), ([],), (None,)], "ids array<int>")
    got = [bytes(r.decoded) for r in byte_bpe.decode(df, ranks_path()).collect()]
    assert got == ["漢".encode(), "漢".encode()[:1], b"", b""]


def toxic_table(spark, n=600):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        toxic = i % 8 == 0
        text = words(rng, rng.randint(20, 200)).split()
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vileword", "nastyword,", "Foulword"]))
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 16 < 9], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = toxic_table(spark)
    rows = pu_toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 100 < len(held) < 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_a_small_group_is_found_and_near_copies_are_no_signs(spark):
    """Two toxic texts in a hundred are of a small language; forty near copies of one toxic text share a harmless word."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(9000):
        toxic = i % 8 == 0
        small = i % 800 < 16 if toxic else i % 20 == 1  # the language has clean texts, too
        text = [rng.choice("uma duas tres quatro cinco".split()) + str(rng.randint(0, 90)) for _ in range(60)] if small else words(rng, 60).split()
        if toxic:
            text.insert(rng.randrange(60), "palavrao" if small else rng.choice(["vileword", "nastyword"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    base = (words(rng, 80) + " harmless vileword").split()
    for i in range(9000, 9040):
        rows.append((i, " ".join([*base[: i % 70], "x", *base[i % 70 :]])))
        labels.append((i, 1))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = pu_toxicity.train(docs, known)
    starts, found = pu_toxicity.features(pa.array(["palavrao", "vileword", "harmless", "alpha1"]), model.slots)
    scores = pu_toxicity._sigmoid(pu_toxicity._sums(model.weights, starts, found) + model.bias)
    assert min(scores[:2]) >= 0.3 > max(scores[2:])


def test_a_repeated_id_is_one_example(spark):
    docs, labels, _ = toxic_table(spark, 200)
    again = spark.range(3000).selectExpr("1L as doc_id", "concat('copy of row ', id) as text")
    assert pu_toxicity.train(docs.where("doc_id <> 1").unionByName(again), labels) is not None
    first = docs.where("doc_id = 8").select("doc_id", "text")
    one, many = (pu_toxicity.train(docs.unionByName(first.crossJoin(spark.range(n)).drop("id")), labels) for n in (0, 500))
    assert one.slots.tolist() == many.slots.tolist() and np.allclose(one.weights, many.weights)


@pytest.mark.parametrize("bias", [-2.0, 0.0, 3.0, -9.0])
def test_risk_and_slopes_equal_a_plain_loop(bias):
    rng = np.random.default_rng(4)
    toxic = [sorted(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(9)]
    rest = [sorted(rng.choice(6, rng.integers(0, 3), replace=False)) for _ in range(25)]
    weights = rng.normal(size=6)

    def placed(texts):
        return np.cumsum([0, *map(len, texts)]), np.array([x for t in texts for x in t], np.int64)

    def plain(w, b, prior=0.2):
        f = [[b + sum(w[x] for x in t) for t in side] for side in (toxic, rest)]
        called_toxic = [prior * np.log(1 + np.exp(-x)) / len(toxic) for x in f[0]]
        clean = sum(np.log(1 + np.exp(x)) / len(rest) for x in f[1]) - sum(prior * np.log(1 + np.exp(x)) / len(toxic) for x in f[0])
        return sum(called_toxic), clean

    on_toxic, on_clean, slope = pu_toxicity.risk(weights, bias, placed(toxic), placed(rest), 0.2)
    assert np.allclose((on_toxic, on_clean), plain(weights, bias))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        (a, b), (c, d) = (plain(weights + s * step[:6], bias + s * step[6]) for s in (1, -1))
        want = (a + b - c - d) / 2e-6 if on_clean >= 0 else (d - b) / 2e-6
        assert abs(slope[k] - want) < 1e-6


def test_toxicity_without_examples(spark):
    docs, labels, _ = toxic_table(spark, 40)
    assert pu_toxicity.train(docs, labels.where("toxic = 0")) is None
    scored = pu_toxicity.toxicity(awkward(spark), labels.where("false")).collect()
    assert len(scored) == awkward(spark).count() and {r.predicted for r in scored} == {0}
    model = pu_toxicity.train(docs, labels)
    assert pu_toxicity.score(awkward(spark), model).count() == awkward(spark).count()


def test_nonnegative_risk_ignores_neutral_words():
    rng = random.Random(9)
    clean = [words(rng, 50) for _ in range(300)]
    toxic = [words(rng, 50) + " vileword" for _ in range(60)]
    model = pu_toxicity.fit(pa.array(toxic[:40]), pa.array([*clean, *toxic[40:]]), 0.06)
    starts, found = pu_toxicity.features(pa.array(["vileword", "alpha1 beta2", ""]), model.slots)
    scores = pu_toxicity._sums(model.weights, starts, found) + model.bias
    assert scores[0] > 0 > scores[1] and scores[2] == model.bias


KEY = "AKIA" + "A1B2C3D4E5F6G7H8"


def test_spans_in_code_points(spark):
    texts = ["é password = 'hunter22' x", f"{KEY} secret: abc token=abcdef", "secret: token: abcdef1", "0123456789abcdef01234567", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    names = blob_ledger.named(docs)
    _, findings = blob_ledger.commit(docs, names, blob_ledger.empty_ledger(spark))
    found = {r.doc_id: [(f.kind, f.start, f.end) for f in r.found] for r in blob_ledger.findings_by_path(names, findings).collect()}
    assert found == {
        0: [("assign", 2, 22)], 1: [("access", 0, 20), ("assign", 33, 45)], 2: [], 3: [("hex", 0, 24)], 4: [], 5: [], 6: [("assign", 2, 22)],
    }


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    names = blob_ledger.named(first)
    ledger, findings = blob_ledger.commit(first, names, blob_ledger.empty_ledger(spark), blob_ledger.BASE)
    assert ledger.count() == 2 * 3 and findings.count() == 1
    second = spark.createDataFrame([(1, "token=abcdef"), (4, "secret=ghijkl")], "doc_id long, text string")
    names = blob_ledger.named(second)
    again, new = blob_ledger.commit(second, names, ledger, blob_ledger.BASE)
    assert again.select("blob").distinct().count() == 1 and new.count() == 1
    newer = [blob_ledger.Rule("assign", blob_ledger.BASE[0].pattern, 6, 1, version=2), *blob_ledger.BASE[1:]]
    rescanned, _ = blob_ledger.commit(second, names, ledger.unionByName(again), newer)
    assert {(r.rule, r.rule_version) for r in rescanned.collect()} == {("assign", 2)} and rescanned.count() == 2
    everywhere = blob_ledger.findings_by_path(names, findings.unionByName(new), blob_ledger.BASE).collect()
    assert sorted((r.doc_id, len(r.found)) for r in everywhere) == [(1, 1), (4, 1)]


@pytest.mark.parametrize("most_sorted", [20_000, 3])
def test_mix_comes_near_its_targets(spark, monkeypatch, most_sorted):
    monkeypatch.setattr(pareto_mix, "SORTED", most_sorted)
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pareto_mix.mix(docs).collect()
    total = sum(r.size for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    level = {s: t / w for s, w in zip(["a", "b", "c", None], [3, 1, 2, 3]) for t in [sources[s][1]] if t < 2 * sources[s][0]}
    assert max(level.values()) == pytest.approx(min(level.values())) and all(t <= 2 * n for n, t in sources.values())
    for s, (_, target) in sources.items():
        assert abs(sum(r.copies * r.size for r in got if r.source == s) - target) <= 15
    assert max(r.copies for r in got) <= 2
    assert Counter(map(tuple, got)) == Counter(map(tuple, pareto_mix.mix(docs.repartition(7)).collect()))


def test_mix_prefers(spark):
    rows = [(i, "w " * 10, "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pareto_mix.mix(docs, preference=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0), share=0.4).collect()
    taken = [sum(r.copies for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert sum(taken) == 1200 and taken[0] / taken[1] == pytest.approx(3, rel=0.2)


@pytest.mark.parametrize("equal", [False, True])
def test_mix_of_many_rows_without_or_with_one_id(spark, equal):
    """Of rows alike, as many are taken as the target asks for."""
    for key in (None, 7):
        rows = [(key, "w " * 10 + ("" if equal else f"x{i}"), "a", i) for i in range(600)] + [(i, "w " * 20, "b", i) for i in range(50)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, nth int").repartition(5)
        got = pareto_mix.mix(docs).collect()
        for source in "ab":
            own = [r for r in got if r.source == source]
            assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 20
        assert len({(r.source, r.nth) for r in got}) == 650 == len(got)


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    got = pareto_mix.mix(docs)
    assert got.columns == [*[c for c in docs.columns if c not in ("size", "copies")], "size", "source_size", "target", "copies"]
    assert got.count() == docs.count() and got.where("copies is null").count() == 0
    assert pareto_mix.mix(docs.where("false")).collect() == []
