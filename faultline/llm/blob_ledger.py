"""Secret scans with an incremental blob ledger, on DataFrame functions only.

Every version of every path is named by the digest of its content. The ledger holds the (blob, rule, rule
version) triples that were scanned before. Only triples that it lacks are scanned, each blob once however many
paths and versions hold it; findings are then joined back to all of them.

The place of a match comes from two passes of one pattern: the text split at the matches and the
matches themselves, whose lengths add up. Only texts that match at all are taken apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.shared import written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches whose ``group`` is shorter than ``least`` fail."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1


# The three base kinds, in order.
BASE = (
    Rule("assign", "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Added by this operator.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", "(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}"),
)
RULES = (*BASE, *MORE)
LEDGER = "blob string, rule string, rule_version int"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def content_address(text_col: str = "text") -> Column:
    """The digest that names a text; a null text is an empty one."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def named(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob), written once: which path holds which blob, one row per version."""
    return written(versions.select(F.col(id_col).cast("long").alias("doc_id"), content_address(text_col).alias("blob")), "named")


def unseen(names: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, least_id, rules): for each distinct blob the rules whose present version the ledger does not have."""
    now = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("done"))
    todo = F.array_except(now, F.coalesce("done", F.array().cast(done.schema["done"].dataType)))
    blobs = names.groupBy("blob").agg(F.min("doc_id").alias("least_id"))
    return blobs.join(done, "blob", "left").select("blob", "least_id", todo.alias("rules")).where(F.size("rules") > 0)


def scan(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, kind, nth, start, end) of every finding in ``texts`` (blob, text, rules); places in code points."""
    text = F.col("text")

    def pieces(rule: Rule) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
        found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length)
        value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
        rows = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
        asked = F.exists("rules", lambda r: (r["rule"] == rule.kind) & (r["rule_version"] == rule.version))
        rows = F.when(asked & text.rlike(rule.pattern), rows)
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), rows.alias("rows"))

    each = texts.select("blob", F.inline(F.array(*[pieces(r) for r in rules])))
    each = each.where("rows is not null").select("blob", "kind", "least", F.posexplode("rows").alias("nth", "p"))
    order = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = F.sum(F.col("p.gap") + F.coalesce("p.found", F.lit(0))).over(order)
    each = each.withColumn("end", passed.cast("long"))
    found = each.where("p.found is not null and p.value >= least")
    return found.select("blob", "kind", "nth", (F.col("end") - F.col("p.found")).alias("start"), "end")


def commit(
    versions: DataFrame,
    names: DataFrame,
    ledger: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, new findings) of the versions' blobs that the ledger lacks; ``names`` from ``named``.

    One version stands for all that hold its blob: the one with the smallest id. Append both results to the stored
    tables; a later call with that ledger scans nothing again unless a blob or a rule version is new.
    """
    todo = unseen(names, ledger, rules)
    def same_id(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))  # null ids meet, too

    wanted = todo.select(same_id("least_id").alias("id"), "blob", "rules")
    texts = versions.select(same_id(id_col).alias("id"), content_address(text_col).alias("blob"), F.col(text_col).alias("text"))
    # A version that repeats is scanned once; the join has already brought its rows together.
    again = F.row_number().over(Window.partitionBy("id", "blob").orderBy("id"))
    texts = texts.join(wanted, ["id", "blob"]).withColumn("again", again).where("again = 1")
    findings = scan(texts.select("blob", "text", "rules"), rules)
    return todo.select("blob", F.inline("rules")), findings


def findings_by_path(names: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``names`` with ``found``: (start, order of its kind, kind, end) of every finding, by start, then kind.

    A version without findings has an empty array. Repeated rows of a version give a row each.
    """
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    row = F.struct("start", place[F.col("kind")].alias("turn"), "kind", "end")
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(row)).alias("found"))
    joined = names.join(per_blob, "blob", "left")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(per_blob.schema["found"].dataType)))
