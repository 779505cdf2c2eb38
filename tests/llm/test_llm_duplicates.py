"""N-gram join and line dedup against brute force."""

import os
import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import line_dedup, ngram_join, words as word_tools
from faultline.llm.components import components
from faultline.operators import shared
from llm_tables import awkward, words


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_links(rows):
    """(doc_id, class_id, n_links) of (doc_id, text) rows, every pair compared."""
    by_words = defaultdict(list)
    for d, t in rows:
        by_words[tuple((t or "").encode().split())].append(d)
    keys = list(by_words)
    sets = {k: grams(b" ".join(k).decode()) for k in keys}
    near = {k: {k} for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                near[a].add(b)
                near[b].add(a)
    out = []
    for k in keys:
        group, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        ids = [d for x in group for d in by_words[x] if d is not None]
        links = sum(len(by_words[x]) for x in near[k]) - 1
        out += [(d, min(ids) if ids else None, links) for d in by_words[k]]
    return Counter(out)


@pytest.mark.parametrize("block", [256, 2])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(1)
    first = words(rng, 80).split()
    copies = [" ".join([*first[:i], "new", *first[i + 1 :]]) for i in rng.sample(range(80), 9)]
    twice = [" ".join([*c.split()[:40], "again", *c.split()[41:]]) for c in copies[:4]]
    extra = [(100 + i, t) for i, t in enumerate([*copies, *twice, copies[0], copies[0]])]
    docs = awkward(spark).select("doc_id", "text", "label", "k1").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    )
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = ngram_join.ngram_join(docs, block=block).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, found)) == brute_links(rows)


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    found = ngram_join.ngram_join(docs)
    chosen = found.where("doc_id <=> class_id").select("doc_id", "text_key").distinct()
    kept = ngram_join.one_of_each(docs, chosen)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.class_id for r in found.collect() if r.class_id is not None})


@pytest.mark.parametrize("block", [1, 256])
def test_a_class_of_repeated_rows_is_read_once(spark, monkeypatch, block):
    """A thousand rows of one id and text, as many without id, and a near copy: one gram set for each class."""
    words = [f"word{i}" for i in range(60)]
    near, other = [*words[:-1], "last"], [f"other{i}" for i in range(60)]
    rows = [(7, " ".join(words))] * 1000 + [(None, " ".join(near))] * 1000
    rows += [(3, " ".join(["first", *words[1:]])), (4, " ".join(other)), (5, "  ".join(words))]
    seen, write = {}, ngram_join.written

    def counted(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(ngram_join, "written", counted)
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    got = {tuple(r) for r in found.select("doc_id", "rep_id", "class_id", "n_links").collect()}
    # 56 grams each; a changed end costs one gram, two changed ends share 54 of 58
    assert got == {(7, 5, 3, 2001), (5, 5, 3, 2001), (None, None, 3, 2001), (3, 3, 3, 2001), (4, 4, 4, 0)}
    assert seen["sets"].count() == 3
    assert found.count() == len(rows)


def test_no_documents(spark):
    none = awkward(spark).where("false")
    assert ngram_join.ngram_join(none).collect() == []
    assert line_dedup.drop_lines(none).collect() == []


def test_banding_reaches_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 5)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{300 + i: 300 for i in range(40)}}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - head - tail <= 1


def digests(docs):
    return dict(map(tuple, docs.select("text", F.xxhash64("text")).distinct().collect()))


def brute_lines(rows, keys, least=8):
    def place_of(d, t, i):
        return (1, keys[t]) if d is None else (0, d), keys[t] % (1 << 28), i

    places = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().split())
            if w:
                place = place_of(d, t, i)
                places[w] = min(places.get(w, place), place)
    near = {
        w for w in places if len(w) >= least
        and any(places[x] < places[w] and len(x) >= least and one_edit(x, w) for x in places if x != w)
    }
    out = Counter()
    for d, t in rows:
        lines = [(i, tuple(x.encode().split())) for i, x in enumerate((t or "").split("\n"))]
        own = [(i, w, places[w] < place_of(d, t, i)) for i, w in lines if w]
        dropped = tuple(i for i, w, exact in own if exact or w in near)
        out[(d, len(own), sum(e for *_, e in own), len(dropped) - sum(e for *_, e in own), dropped)] += 1
    return out


def test_equal_lines_of_documents_without_or_with_one_id(spark):
    """Lines of one number in different texts are told apart: one of each three stays."""
    line = "one line that stands in all of these documents"
    for ids in ((None, None, None), (4, 4, 4)):
        docs = spark.createDataFrame([(d, f"{line}\nown words {k}") for k, d in enumerate(ids)], "doc_id long, text string")
        rows = [tuple(r) for r in docs.collect()]
        found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs)).drop("text_key").collect()
        assert sorted(r.n_exact for r in found) == [0, 1, 1]
        assert Counter((r.doc_id, r.n_lines, r.n_exact, r.n_near, tuple(r.dropped)) for r in found) == brute_lines(rows, digests(docs))


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    lines = [words(rng, n) for n in (3, 7, 8, 9, 12, 12, 30)]
    made = []
    for line in lines:
        w = line.split()
        for _ in range(6):
            i = rng.randrange(len(w))
            made += [" ".join([*w[:i], *w[i + 1 :]]), " ".join([*w[:i], "new", *w[i:]]), " ".join([*w[:i], f"r{rng.randint(0, 2)}", *w[i + 1 :]])]
    rng.shuffle(made)
    extra = [(50 + i, "\n".join([*made[i::9], lines[i % 7], "", "  " + lines[i % 7].replace(" ", " \t")])) for i in range(9)]
    docs = awkward(spark).select("doc_id", "text", "rank", "n").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    )
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs)).drop("text_key").collect()
    assert Counter((r.doc_id, r.n_lines, r.n_exact, r.n_near, tuple(r.dropped)) for r in found) == brute_lines(rows, digests(docs))
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).where("doc_id >= 50").collect()}
    gone = {k[0]: k[4] for k in brute_lines(rows, digests(docs))}
    assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in extra}


def test_each_distinct_word_is_hashed_once(monkeypatch):
    real, given = word_tools.xxhash, []

    class Counted:
        def __getattr__(self, name):
            return lambda value, *seed: given.append(value) or getattr(real, name)(value, *seed)

    monkeypatch.setattr(word_tools, "xxhash", Counted())
    texts = ["not read", "der Tag kam spät\n\nder Tag\tkam  spät 漢字", "", None, "kam\nder Tag kam spät"]
    columns = [pa.array(range(5)), pa.array(range(5)), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "text"]).slice(1)
    [out] = line_dedup._read(())(iter([batch]))
    assert sorted(given) == sorted(w.encode() for w in ("der", "Tag", "kam", "spät", "漢字"))
    lines = [[(x["line"], x["h1"], x["h2"], x["n"]) for x in r] for r in out.column("lines").to_pylist()]
    assert [[(x[0], x[3]) for x in r] for r in lines] == [[(0, 4), (2, 5)], [], [], [(0, 1), (1, 4)]]
    assert lines[0][0][1:3] == lines[3][1][1:3]
    hashes = {h for r in lines for x in r for h in x[1:3]}
    assert len(hashes) == 6  # three different lines, two hashes each

    given.clear()
    columns = [*[pa.array([k, k]) for k in range(3)], pa.array(["a b c a", "a c"])]
    assert next(line_dedup._variants(iter([pa.RecordBatch.from_arrays(columns, ["h1", "h2", "place", "line"])]))).num_rows == 8
    assert sorted(given) == [b"a", b"b", b"c"]
    assert [len(x) for x in word_tools.hashed_twice(pa.array([], pa.string()))] == [0, 0]


def test_a_text_may_lose_all_its_lines(spark):
    docs = spark.createDataFrame([(1, "same line"), (2, "same line"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_lines(docs).collect())) == [(1, "same line"), (2, ""), (3, None)]


def edits(a, b):
    """Words inserted, deleted or replaced, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_dropped(rows):
    """(doc_id, dropped) with the bound that grows with the shorter line, every pair compared; ids are unique."""
    each = [((d, i), tuple(line.split())) for d, t in sorted(rows) for i, line in enumerate(t.split("\n")) if line.split()]
    out = {d: [] for d, _ in rows}
    for at, ((d, i), w) in enumerate(each):
        for _, x in each[:at]:
            short = min(len(w), len(x))
            most = 0 if short < 8 else 1 + (short >= 20) + (short >= 40)
            if w == x or (abs(len(w) - len(x)) <= most and edits(w, x) <= most):
                out[d].append(i)
                break
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_the_bound_grows_with_the_line(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(7)
    made = []
    for n in (8, 18, 19, 20, 21, 38, 39, 40, 41, 60, 150, 20, 40):
        base = ["same"] * n if n == 21 else words(rng, n).split()
        made.append(" ".join(base))
        for k in (1, 2, 3, 4, 2, 3, 4):
            w = list(base)
            for turn in range(k):
                i = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[i : i + (kind != 1)] = [] if kind == 0 else [f"new{rng.randint(0, 99)}"]
            made.append(" ".join(w))
    rng.shuffle(made)
    rows = [(i, "\n".join(made[i::11])) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    grow = line_dedup.GROWING
    found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs, grow=grow), grow=grow)
    assert {r.doc_id: r.dropped for r in found.collect()} == brute_dropped(rows)


def test_the_pipeline_drops_long_lines_of_two_changed_words(spark):
    rng = random.Random(8)
    w = words(rng, 60).split()
    other = " ".join([*w[:10], "new", *w[11:45], "again", *w[46:]])
    rows = [(1, " ".join(w), "en", "a", 1), (2, other, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: " ".join(w), 2: ""}


def test_no_pair_of_long_lines_is_lost(spark):
    """300 pairs of lines that differ in two words, so that every bit of the sketches differs in some of them."""
    rows = []
    for k in range(300):
        w = [f"w{k}x{i}" for i in range(30)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:9], "new", *w[10:20], f"again{k}", *w[21:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grow = line_dedup.GROWING
    found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs, grow=grow), grow=grow)
    assert {r.doc_id: r.n_near for r in found.collect()} == {d: d % 2 for d, _ in rows}


def test_texts_are_read_for_close_lines_only(spark, monkeypatch):
    """A hundred lines of one opening, two of which are two edits apart: no table holds the others' words."""
    opening = "all of these lines begin with the same words"
    rows = [(k, f"{opening} " + " ".join(f"own{k}x{i}" for i in range(20))) for k in range(100)]
    rows.append((100, rows[7][1].replace("own7x3", "new").replace("own7x9", "again")))
    held, write = [], line_dedup.written

    def counted(df, name):
        table = write(df, name)
        held.extend([table.count()] if {"line", "words"} & set(table.columns) else [])
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grow = line_dedup.GROWING
    found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs, grow=grow), grow=grow)
    assert {r.doc_id for r in found.collect() if r.n_near} == {100}
    assert max(held) == 2


def staged_tables(spark):
    return set(os.listdir(shared.shared_folder(spark).removeprefix("file:")))


def test_the_tables_of_line_dedup_go_but_one(spark):
    docs = awkward(spark).select(*corpus_pipeline.COLUMNS)
    shared.written(docs.limit(1), "first")
    before = staged_tables(spark)
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert [x.split("-")[0] for x in staged_tables(spark) - before] == ["dropped"]
    assert kept.count() == docs.count()


def test_a_scope_removes_its_tables_after_a_failure(spark):
    shared.written(spark.range(3), "first")
    before = staged_tables(spark)
    with pytest.raises(ValueError), shared.scratch() as keep:
        kept = keep(spark.range(5), "kept")
        with shared.scratch():
            shared.written(spark.range(4), "inner")
        shared.written(kept, "own")
        raise ValueError
    assert [x.split("-")[0] for x in staged_tables(spark) - before] == ["kept"]
    assert kept.count() == 5


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    setting = spark.conf.get(shared._CLEANUP, None)
    before = shuffles()
    table = shared.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == 7
    assert spark.conf.get(shared._CLEANUP, None) == setting
