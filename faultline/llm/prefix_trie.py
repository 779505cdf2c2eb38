"""Prefix trie of conversations by van Emde Boas recursion, on DataFrame functions.

A sequence of turns is kept as rows, never as one value: its aligned blocks of 1, 2, 4, ... turns, each with a 128-bit digest
made from those of its halves. Equal sequences are one, with a weight.

Going down, a trie of height 2k is cut at half depth: all sequences of one root and one first half share that cut prefix,
which is named by its smallest member. The first halves make the upper trie, and what follows a cut prefix the lower trie
below it. All tries of one height are cut in one step, so log2(depth) steps name the parent of every turn. No
row is ever compared with another, and a block is one row per step whatever its length.

Going up, totals of a trie of height 2k are those of its halves: the total of every lower trie is grafted on its cut
prefix and on that prefix's ancestors in the upper trie, k at most, which are on one member's path. Again one step
serves all tries of one height.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.operators.ordered import ordered_features, position
from faultline.operators.shared import written

ID_BITS = 12  # ids that agree but for so many last bits are joined together before they are digested


def turn_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, d1, d2, size): each turn's place from 0, the digests of its role and text, and the bytes of its text.

    Turns are in order of turn (null first), then role and text; null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. Long conversations are numbered in runs, not in one task.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    # Equal turns may take their places in any order, so texts need not be ordered beyond what their ties ask for.
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = [F.xxhash64(F.lit(k), "role", "text").alias(f"d{k}") for k in (1, 2)]
    rows = rows.select("conv", "turn", "role", "text", *digest, F.octet_length("text").cast("long").alias("size"))
    numbered = ordered_features(rows, ["conv"], order, [position("nth")])
    return numbered.select("conv", (F.col("nth") - 1).alias("pos"), "d1", "d2", "size")


def regrouped(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv), (conv, pos, d1, d2, size): every conversation c with its first h turns taken from conversation
    c - c mod ``group`` instead, h being crc32(c as text) mod ``most``.

    If that conversation is shorter or absent, only what it has is taken. c mod ``group`` is never negative.
    """
    lengths = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.pmod("conv", F.lit(group))
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    plan = lengths.select("conv", heads, base.alias("base"))
    firsts = lengths.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("there"))
    plan = written(plan.join(firsts, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "regrouping")
    head = rows.where(F.col("pos") < most).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "h"), "base").where("pos < h")
    tail = rows.join(plan.select("conv", "h", "taken"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    names = ["conv", "pos", "d1", "d2", "size"]
    return plan.select("conv"), head.select(names).unionByName(tail.select(names))


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """Per height k, (conv, b, d1, d2): the digest of turns b * 2**k up to (b + 1) * 2**k of each conversation, or as many as
    there are."""
    blocks = [rows.select("conv", F.col("pos").alias("b"), "d1", "d2")]
    longest = rows.agg(F.max("pos")).first()[0]
    while longest:
        halves = blocks[-1].groupBy("conv", F.shiftright("b", 1).alias("b")).agg(
            *[F.max(F.when(F.col("b") % 2 == side, F.struct("d1", "d2"))).alias(name) for side, name in enumerate(("left", "right"))]
        )
        digests = [F.xxhash64(F.lit(k), "left", "right", F.col("right").isNull()).alias(f"d{k}") for k in (1, 2)]
        blocks.append(written(halves.select("conv", "b", *digests), "blocks"))
        longest >>= 1
    return blocks


def _descend(blocks: list[DataFrame], classes: DataFrame, root: int) -> DataFrame:
    """(conv, pos, parent): for every turn of the smallest member of each class, the name of the prefix before it."""
    tries = classes.select("conv", F.lit(0).cast("long").alias("b"), F.lit(root).cast("long").alias("parent"))
    for half in reversed(blocks[:-1]):
        left = tries.select("conv", (F.col("b") * 2).alias("b"), "parent").join(half, ["conv", "b"])
        left = written(left, "upper")
        cuts = left.groupBy("b", "parent", "d1", "d2").agg(F.min("conv").alias("name"))
        right = half.where("b % 2 = 1").select("conv", (F.col("b") - 1).alias("b"))
        right = left.join(right, ["conv", "b"]).join(cuts, ["b", "parent", "d1", "d2"])
        lower = right.select("conv", (F.col("b") + 1).alias("b"), F.col("name").alias("parent"))
        tries = written(left.select("conv", "b", "parent").unionByName(lower), "tries")
    return tries.withColumnRenamed("b", "pos")


def _graft(paths: DataFrame, nodes: DataFrame, heights: int, totals: list[str]) -> DataFrame:
    """(pos, name, *totals): every node's totals over its subtree. ``paths`` (conv, pos, name, parent), ``nodes`` (pos, name,
    parent, *totals): ``pos`` is the depth less one."""
    parts = [nodes.select("pos", "name", "parent", *totals)]
    for k in range(heights):
        # Tries of height 2**k that stand on a cut: their top nodes, at depths that are an odd multiple of 2**k and one.
        tops = [p.where(F.col("pos") % (2 << k) == (1 << k)) for p in parts]
        grown = tops[0]
        for t in tops[1:]:
            grown = grown.unionByName(t)
        grown = grown.groupBy("pos", "parent").agg(*[F.sum(c).alias(c) for c in totals])
        grown = grown.select(F.col("parent").alias("conv"), (F.shiftright("pos", k) - 1).alias("run"), *totals)
        above = paths.withColumn("run", F.shiftright("pos", k)).where("run % 2 = 0")
        above = grown.join(above, ["conv", "run"]).groupBy("pos", "name", "parent").agg(*[F.sum(c).alias(c) for c in totals])
        parts.append(written(above, "grafted"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("pos", "name").agg(*[F.sum(c).alias(c) for c in totals])


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, name, ids): pieces of a list of ids, in order, as one digest per list."""
    import hashlib

    at, digest, out = None, None, []
    for batch in batches:
        for depth, name, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (depth, name) == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (depth, name), hashlib.sha256()
            digest.update(ids.encode())
        yield _rows(out)
        out = []
    yield _rows([(*at, digest.hexdigest())] if at is not None else [])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["depth", "name", "ends_sha256"]
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) from (depth, name, conv). A hot list is joined in pieces of bounded size, which one task
    reads one after another."""
    piece = F.shiftright("conv", ID_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "name", piece.alias("piece")).agg(ids.alias("ids"))
    sorted_ = pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "piece").select("depth", "name", "ids")
    return sorted_.mapInArrow(_digest_ids, "depth long, name long, ends_sha256 string")


def prefix_trie(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of all members' sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (all long but the last).

    ``members`` (conv), each once; ``rows`` (conv, pos, d1, d2, size), a row per turn, places from 0 without gaps.
    A node is a distinct prefix, named by its depth and its smallest member; the root is the empty prefix. Members
    without turns are the root's. ``n_leaves`` counts childless nodes of its subtree, the node itself included;
    ``saved_tokens`` sums (n_convs - 1) times the bytes of the last turn's text over it; ``ends_sha256`` digests the
    ids of members that end there. No members: no rows. Prefixes are equal if their 128-bit digests are.
    """
    spark: SparkSession = members.sparkSession
    root, n_members = members.agg(F.min("conv"), F.count(F.lit(1))).first()
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = written(rows, "turns")
    blocks = _blocks(rows)
    # Members of equal sequences are a class; its smallest one stands for all of them.
    tops = written(blocks[-1].groupBy("d1", "d2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")), "classes")
    classes = tops.select("conv", "weight")
    parents = _descend(blocks, classes, root)

    turns = parents.join(rows, ["conv", "pos"]).join(classes, "conv")
    turns = written(turns, "named-turns")
    nodes = turns.groupBy("pos", "parent", "d1", "d2").agg(F.min("conv").alias("name"), F.sum("weight").alias("n_convs"), F.max("size").alias("size"))
    nodes = written(nodes, "nodes")
    paths = turns.select("conv", "pos", "parent", "d1", "d2").join(nodes.select("pos", "parent", "d1", "d2", "name"), ["pos", "parent", "d1", "d2"])
    paths = written(paths.select("conv", "pos", "name", "parent"), "paths")

    children = nodes.groupBy((F.col("pos") - 1).alias("pos"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    nodes = nodes.select("pos", "name", "parent", "n_convs", saved).join(children, ["pos", "name"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "counted")
    totals = ["n_leaves", "saved_tokens"]
    grown = written(_graft(paths, nodes, len(blocks) - 1, totals), "totals")
    inner = nodes.drop(*totals).join(grown, ["pos", "name"])
    inner = inner.select(F.col("name"), (F.col("pos") + 1).alias("depth"), "parent", "n_convs", "n_children", *totals)

    first = nodes.where("pos = 0").select("pos", "name").join(grown, ["pos", "name"])
    first = first.agg(F.count(F.lit(1)).alias("n_children"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals])
    first = first.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long")))
    first = first.select(
        F.lit(root).cast("long").alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(n_members).cast("long").alias("n_convs"), "n_children", *totals,
    )

    lasts = paths.groupBy("conv").agg(F.max(F.struct("pos", "name")).alias("last"))
    lasts = lasts.select(F.col("conv").alias("rep"), (F.col("last.pos") + 1).alias("depth"), F.col("last.name").alias("name"))
    of_class = blocks[-1].join(tops.select("d1", "d2", F.col("conv").alias("rep")), ["d1", "d2"]).select("conv", "rep")
    ends = of_class.join(lasts, "rep").select("depth", "name", "conv")
    turnless = members.join(rows.select("conv").where("pos = 0"), "conv", "left_anti")
    ends = ends.unionByName(turnless.select(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name"), "conv"))
    found = inner.unionByName(first).join(_end_digests(ends), ["depth", "name"], "left")
    return found.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", *totals,
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def regrouped_trie(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """The trie of all conversations of ``turns`` (conv_id, turn, role, text) after ``regrouped``."""
    rows = written(turn_rows(turns), "turn-rows")
    members, rebuilt = regrouped(rows, group, most)
    return prefix_trie(members, rebuilt)
