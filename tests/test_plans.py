"""What the physical plans must show."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from faultline.operators.ranking import value_ranks, with_percent_rank
from faultline.plans import charts, probes, registry, reports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("report", [reports.q12, reports.q13, reports.q15, reports.q16])
def test_semi_joins(tables, report):
    assert "LeftSemi" in plan(report(tables))


@pytest.mark.parametrize("name", ["q03", "q07", "q08", "q11", "q13", "q15", "t_topk", "t_nlargest"])
def test_top_k_never_sorts_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.queries()[name](spark, SMALL))


def test_percent_rank_keeps_rows_spread(tables):
    text = plan(with_percent_rank(reports.rated(tables), "OVERALL_STARS", "p"))
    assert "SinglePartition" not in text and "BroadcastHashJoin" in text


def test_unkeyed_ranks_are_summed_in_runs(tables):
    """The windows over the values are dealt by run; only the carried rows, two per run, meet in one task."""
    text = plan(value_ranks(tables.recalls, [], "POTAFF", hot_rows=3))
    assert "hashpartitioning(_run" in text and text.count("SinglePartition") == 1


@pytest.mark.parametrize("probe", [probes.w_first_per_key, probes.w_keep_first])
def test_first_rows_are_picked_before_the_shuffle(tables, probe):
    assert plan(probe(tables)).count("WindowGroupLimit") == 2


def test_scans_read_only_what_is_asked(tables):
    text = plan(tables.complaints.groupBy("MAKETXT").agg(F.sum("DEATHS")))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert read == {"l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_discount:double", "p_partkey:bigint,p_brand:string"}


def test_filters_reach_the_scan(tables):
    text = plan(tables.ratings.filter("RATING_ID > 3 AND MODEL = 'x'").groupBy("MAKE").count())
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThan(p_partkey,3)" in pushed and "EqualTo(p_name,x)" in pushed


def test_chart_of_linked_campaigns_forms_no_pairs(tables):
    """Pairs of recall and investigation rows would be an inner join of the two scans."""
    assert "Inner" not in plan(charts.linked_campaigns(tables).select("CAMPNO")).split("LeftSemi")[0]
