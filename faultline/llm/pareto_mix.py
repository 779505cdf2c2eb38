"""Mixing sources to target weights by Pareto order sampling.

A source's target, shared out by size and preference, is the number of copies expected of each of its documents.
Whole copies are certain. For the rest, u being a document's random number and p the fraction left, documents
are ranked by the odds of u divided by the odds of p, and the first ones are taken until their words fill
what is missing: a sample of fixed size with unequal probabilities. Random numbers are digests of id and text,
so reruns agree.

No source is sorted in one task. The logarithms of the ranks of a source are cut into even slots; words per slot
show which slot holds the end of the sample; that slot is cut again until it is small enough to be sorted.
What remains is one row per source, the last document taken, and every row is compared with it in place. Rows of
equal rank, id and size are counted first, so however many there are, they are one row there, and as many of them are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.ordered import ordered_features, position
from faultline.operators.shared import written

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = 1.5  # words of the mix by words of the input
MOST = 2.0  # copies of a document, at most
SLOTS = 4096  # per source and pass
SORTED = 20_000  # documents of a slot that one task sorts
SEED = 9


def word_count(text: str | Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 for each id and text, null ones like empty ones: 48 bits of a digest."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row per source, from (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until none is above: all
    targets are their cap or their weight times one common level. Sources sorted by cap over weight are capped
    up to the last one whose cap is below the level that the words and weights left give.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    weighed = each.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = weighed.withColumn("level", left / F.sum("weight").over(after))
    # From the first source on that its level does not fill, levels only fall; that first one is the common level.
    free = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("common", F.max(free).over(Window.partitionBy(F.lit(0))))
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("common")), "cap")
    return ranked.select("source", "source_size", target.alias("target"))


def _ends(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """(of, low, end_rank, end_id, end_size, end_n, end_taken): the last documents of each source's sample, in order of rank, id
    and size, their number, and how many of them are taken.

    A document is in the sample if the middle of its words lies before the missing words' end. Sources without
    a sample have no row. ``rows`` (source, rank, doc_id, size, n): n documents alike; ``missing`` (of, missing).
    """
    pool = rows.where("rank is not null").withColumn("x", F.log("rank")).withColumn("words", F.col("n") * F.col("size"))
    span = pool.groupBy("source").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("docs"))
    span = written(span.select(F.col("source").alias("of"), "low", "high", "docs", F.lit(0).cast("long").alias("before")), "span")
    same = F.col("source").eqNullSafe(F.col("of"))
    # Below this width, or this number of rows, a slot is sorted.
    wide = (F.col("docs") > SORTED) & (F.col("high") > F.col("low"))
    while not span.where(wide).isEmpty():
        slot = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * SLOTS), F.lit(SLOTS - 1))
        inside = pool.join(span, same).where(wide & F.col("x").between(F.col("low"), F.col("high"))).withColumn("slot", slot)
        slots = inside.groupBy("of", "slot", "before").agg(
            F.min("x").alias("low"), F.max("x").alias("high"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("docs")
        )
        running = Window.partitionBy("of").orderBy("slot")
        slots = slots.withColumn("upto", F.col("before") + F.sum("words").over(running))
        slots = slots.join(missing.withColumnRenamed("of", "from"), F.col("of").eqNullSafe(F.col("from")))
        holds = F.col("upto") >= F.col("missing")
        last = F.max("slot").over(Window.partitionBy("of"))
        chosen = F.min(F.when(holds, F.col("slot"))).over(Window.partitionBy("of"))
        slots = slots.withColumn("chosen", F.coalesce(chosen, last)).where("slot = chosen")
        narrowed = slots.select("of", "low", "high", "docs", (F.col("upto") - F.col("words")).alias("before"))
        span = written(span.where(~wide).unionByName(narrowed), "span")
    inside = pool.join(span, same).where(F.col("x").between(F.col("low"), F.col("high")))
    order = Window.partitionBy("of").orderBy("rank", "doc_id", "size")
    upto = F.col("before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.select("of", "rank", "doc_id", "size", "n", "words", upto.alias("upto"))
    inside = inside.join(missing.withColumnRenamed("of", "from"), F.col("of").eqNullSafe(F.col("from")))
    # Of n documents alike, the i-th is taken if (i - 1/2) * size lies before the end.
    room = F.col("missing") - (F.col("upto") - F.col("words"))
    fit = F.when(room <= 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.ceil(room / F.col("size") + 0.5) - 1)
    taken = inside.withColumn("taken", F.least(fit, "n").cast("long")).where("taken > 0")
    first = Window.partitionBy("of").orderBy(F.desc("rank"), F.desc_nulls_last("doc_id"), F.desc("size"))
    ends = taken.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    # A slot of which nothing is taken ends just below its first document.
    found = ends.select("of", *[F.col(c).alias(f"end_{d}") for c, d in (("rank", "rank"), ("doc_id", "id"), ("size", "size"), ("n", "n"), ("taken", "taken"))])
    low = span.select(F.col("of").alias("from"), "low")
    return low.join(found, F.col("of").eqNullSafe(F.col("from")), "left").drop("of").withColumnRenamed("from", "of")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (long); columns of these names are replaced.

    Expected copies of a document are its source's target times its ``preference`` (1 by default), divided by the sum of
    preference times size over the source, ``most`` at most. Whole copies go to all; of the rest, documents first
    in Pareto order get one more, up to the source's target in words. Null texts are of size 0, and so are texts
    without words; they may be copied, too. Rows of one id and text share a random number, null ids included; where the
    sample ends among such rows, only as many of them as fit are taken, any of them. A null source is a source, last
    in order. An empty table gives no rows. Preferences are positive; a null one counts as 1.
    """
    liking = F.coalesce(preference.cast("double"), F.lit(1.0)) if preference is not None else F.lit(1.0)
    wide = docs.withColumns(
        {
            "_mix_id": F.col(id_col).cast("long"),
            "_mix_source": F.col(source_col).cast("string"),
            "_mix_size": word_count(text_col),
            "_mix_u": uniform(id_col, text_col, seed),
            "_mix_liking": liking,
        }
    ).drop("size", "source_size", "target", "copies")
    kept = [c for c in wide.columns if not c.startswith("_mix_")]
    sizes = wide.select(F.col("_mix_id").alias("doc_id"), *[F.col(f"_mix_{c}").alias(c) for c in ("source", "size", "u", "liking")])
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most)
    liked = sizes.groupBy("source").agg(F.sum(F.col("liking") * F.col("size")).alias("liked"))
    liked = liked.select(F.col("source").alias("of"), "liked")
    plan = written(targets.join(liked, F.col("source").eqNullSafe(F.col("of"))).drop("source"), "plan")
    alike = sizes.groupBy("source", "doc_id", "size", "u", "liking").agg(F.count(F.lit(1)).alias("n"))
    rows = _ranked(alike.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of"), most)
    rows = written(rows.select("source", "target", "doc_id", "size", "n", "whole", "rank"), "ranked")
    given = rows.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size") * F.col("n")).alias("given"))
    missing = written(given.select(F.col("source").alias("of"), (F.col("target") - F.col("given")).alias("missing")), "missing")
    ends = _ends(rows, missing)
    plan = plan.join(ends.withColumnRenamed("of", "from"), F.col("of").eqNullSafe(F.col("from")), "left").drop("from")
    plan = written(plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns]), "ends")
    joined = _ranked(wide.join(plan, F.col("_mix_source").eqNullSafe(F.col("_mix_of"))), most, "_mix_")
    own, end = (F.struct(*[F.col(f"_mix_{c}") for c in names]) for names in (("rank", "id", "size"), ("end_rank", "end_id", "end_size")))
    below = F.when(F.col("_mix_end_rank").isNull(), F.log("_mix_rank") < F.col("_mix_low")).otherwise(own < end)
    last = F.col("_mix_rank").isNotNull() & F.col("_mix_end_rank").isNotNull() & (own <= end) & (own >= end)
    # Rows alike of which some only are taken are numbered; there are none if rows differ.
    some = last & (F.col("_mix_end_taken") < F.col("_mix_end_n"))
    if plan.where("_mix_end_taken < _mix_end_n").isEmpty():
        joined = joined.withColumn("_mix_nth", F.lit(1).cast("long"))
    else:
        edge = joined.where(some).withColumn("_mix_place", F.monotonically_increasing_id())
        edge = ordered_features(edge, ["_mix_of"], [F.col("_mix_place")], [position("_mix_nth")]).drop("_mix_place")
        joined = joined.where(~F.coalesce(some, F.lit(False))).withColumn("_mix_nth", F.lit(1).cast("long")).unionByName(edge)
    more = F.col("_mix_rank").isNotNull() & (F.coalesce(below, F.lit(False)) | F.coalesce(last & (F.col("_mix_nth") <= F.col("_mix_end_taken")), F.lit(False)))
    copies = (F.col("_mix_whole") + more.cast("int")).cast("long")
    return joined.select(
        *kept, F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), copies.alias("copies"),
    )


def _ranked(rows: DataFrame, most: float, prefix: str = "") -> DataFrame:
    """``rows`` (u, liking, target, liked) with whole copies and the Pareto rank of the fraction left."""
    u, liking, target, liked = (F.col(prefix + c) for c in ("u", "liking", "target", "liked"))
    expected = F.when(liked > 0, F.least(F.lit(most), target * liking / liked)).otherwise(F.lit(0.0))
    rows = rows.withColumn(prefix + "whole", F.floor(expected))
    part = expected - F.col(prefix + "whole")
    return rows.withColumn(prefix + "rank", F.when(part > 0, (u / (1 - u)) / (part / (1 - part))))
