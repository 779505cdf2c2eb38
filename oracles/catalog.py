"""Expected results as DuckDB SQL.

Each entry names the select statements it builds on; ``oracle_sql`` turns them into CTEs.
Joins are written row by row and subtotals as GROUPING SETS over raw rows, unlike the Spark
code, which groups before it joins or expands. Ratios are rounded as decimals, half up.
"""

from __future__ import annotations

from oracles.literals import (
    BODY_STYLE_CATEGORIES,
    COMPLAINT_NOISE,
    COMPONENT_GROUPS,
    FAILURE_PATTERNS,
    RECALL_NOISE,
    RECALL_TYPES,
)
from oracles.views import VIEWS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _map(values) -> str:
    return "map {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in values.items()) + "}"


def _round(expression: str, digits: int) -> str:
    return f"cast(round(cast({expression} as decimal(38,12)), {digits}) as double)"


def _pct(part: str, whole: str, digits: int, scale: str = "100e0") -> str:
    return _round(f"({scale} * {part}) / nullif({whole}, 0)", digits)


def _big(expression: str) -> str:
    return f"cast({expression} as bigint)"


def _year(c: str) -> str:
    return _big(f"try_cast({c} as decimal(38,0))").replace("cast(try", "try_cast(try", 1)


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def _component(c: str, anywhere: bool) -> str:
    head = f"upper(trim(split_part({c}, ':', 1)))"
    parts = {p: label for label, names in COMPONENT_GROUPS.items() for p in names}
    found = f"{_map(parts)}[{head}]"
    named = f"coalesce({found}, {head}, 'OTHER / UNKNOWN')"
    if not anywhere:
        return named
    first_five = _list(list(COMPONENT_GROUPS)[:5])
    return (
        f"case when {found} in {first_five} then {found} "
        f"when upper({c}) like '%LIGHTING%' then 'LIGHTING SYSTEMS' else {named} end"
    )


def _failure(c: str) -> str:
    rules = " ".join(
        f"when regexp_matches({_strip(c)}, {_text(p)}) then {_text(name)}" for p, name in FAILURE_PATTERNS.items()
    )
    return f"case {rules} else {c} end"


def _title(c: str) -> str:
    return (
        f"case when {c} = '' then '' else array_to_string(list_transform(generate_series(1, length({c})), lambda i: "
        f"if(i > 1 and regexp_matches(substr({c}, i - 1, 1), '[A-Za-z]'), lower(substr({c}, i, 1)), "
        f"upper(substr({c}, i, 1)))), '') end"
    )


def _thousands(c: str) -> str:
    return f"format('{{:,}}', cast({c} as bigint))"


_TREND = "order by MODEL_YR nulls last, MODEL nulls last, RATING_ID"
_MAKE_WINDOW = f"partition by MAKE {_TREND}"
_RECALL_REST = (
    "YEARTXT nulls last, POTAFF nulls last, COMPNAME nulls last, RCLTYPECD nulls last, "
    "DO_NOT_DRIVE nulls last, PARK_OUTSIDE nulls last, DESC_DEFECT nulls last"
)
_BINS = "case when {x} > -0.01 and {x} <= 0.25 then '{0}' when {x} > 0.25 and {x} <= 0.5 then '{1}' " \
        "when {x} > 0.5 and {x} <= 0.75 then '{2}' when {x} > 0.75 and {x} <= 1 then '{3}' end"
_TEST_MAKES = "('BRAND 1', 'BRAND 2', 'BRAND 3', 'BRAND 4', 'BRAND 5')"
_COLORS = _map({f"BRAND {i}": f"#0000{i:02d}" for i in range(1, 13)})

# name -> (statements it needs, select)
STATEMENTS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), sql) for name, sql in VIEWS.items()}


def _add(name: str, needs: str, sql: str) -> None:
    STATEMENTS[name] = (tuple(needs.split()), sql)


# ---------------------------------------------------------------- reports

_add("rated", "v_ratings", "select * from v_ratings where OVERALL_STARS is not null")

_add("q01", "rated", f"""
select BODY_STYLE, count(*) as VEHICLES_RATED, {_round('avg(OVERALL_STARS)', 2)} as AVG_OVERALL_STARS,
 {_round('avg(OVERALL_FRNT_STARS)', 2)} as AVG_FRONTAL_STARS, {_round('avg(OVERALL_SIDE_STARS)', 2)} as AVG_SIDE_STARS,
 {_round('avg(ROLLOVER_STARS)', 2)} as AVG_ROLLOVER_STARS,
 {_round('avg(ROLLOVER_POSSIBILITY)', 2)} as AVG_ROLLOVER_PROBABILITY
from rated group by all having VEHICLES_RATED >= 5""")

_add("q02", "rated", f"""
select MAKE, MODEL, MODEL_YR, OVERALL_STARS, ROLLOVER_POSSIBILITY,
 {_round('percent_rank() over (order by OVERALL_STARS desc nulls last)', 6)} as SAFETY_PERCENTILE,
 lag(OVERALL_STARS) over make_order as PREV_YEAR_STARS,
 OVERALL_STARS - PREV_YEAR_STARS as STAR_CHANGE,
 {_round('avg(OVERALL_STARS) over (' + _MAKE_WINDOW + ' rows 2 preceding)', 6)} as ROLLING_3YR_AVG,
 rank() over (partition by MODEL_YR order by OVERALL_STARS desc nulls last) as RANK_IN_YEAR,
 count(*) over (partition by MAKE) as TOTAL_MODELS_BY_MAKE,
 {_big('count(*) filter (where OVERALL_STARS >= 4) over (' + _MAKE_WINDOW + ' rows unbounded preceding)')}
  as CUMULATIVE_HIGH_RATINGS
from rated window make_order as ({_MAKE_WINDOW})""")

_add("make_complaints", "v_complaints", f"""
select MAKETXT as MAKE, count(*) as TOTAL_COMPLAINTS, {_big('sum(DEATHS)')} as TOTAL_DEATHS,
 {_big('sum(INJURED)')} as TOTAL_INJURIES, count(*) filter (where CRASH = 'Y') as CRASH_COUNT,
 count(*) filter (where FIRE = 'Y') as FIRE_COUNT,
 {_pct('sum(DEATHS)', 'count(*)', 4)} as DEATH_RATE_PER_COMPLAINT
from v_complaints group by all""")

_add("q03", "make_complaints", "select * from make_complaints order by TOTAL_COMPLAINTS desc, MAKE nulls last limit 20")

_add("q04", "v_complaints", f"""
with per_year as (select MAKETXT, YEARTXT, count(distinct CMPLID) as n from v_complaints group by all)
select MAKETXT as MAKE, YEARTXT as MODEL_YEAR, n as COMPLAINTS,
 {_big('sum(n) over (partition by MAKETXT order by YEARTXT nulls last)')} as RUNNING_TOTAL_COMPLAINTS,
 rank() over (partition by YEARTXT order by n desc) as RANK_IN_YEAR
from per_year""")

_Q05 = f"""
select {{make}} as MAKE, {{text}} as COMPONENT, count(*) as COMPLAINT_COUNT, {_big('sum(DEATHS)')} as TOTAL_DEATHS,
 {_big('sum(INJURED)')} as TOTAL_INJURIES
from v_complaints group by grouping sets ((MAKETXT, CDESCR), (MAKETXT), ())"""

_add("q05", "v_complaints", _Q05.format(
    make="coalesce(MAKETXT, '-- ALL MAKES --')", text="coalesce(CDESCR, '-- ALL COMPONENTS --')"))
_add("q05_labelled", "v_complaints", _Q05.format(
    make="if(grouping(MAKETXT) = 1, '-- ALL MAKES --', MAKETXT)",
    text="if(grouping(CDESCR) = 1, '-- ALL COMPONENTS --', CDESCR)"))

_add("q06", "v_complaints v_ratings", f"""
select MAKETXT as MAKE, MODELTXT as MODEL, YEARTXT as MODEL_YEAR, count(*) as COMPLAINT_COUNT,
 {_big('sum(DEATHS)')} as TOTAL_DEATHS, {_big('sum(INJURED)')} as TOTAL_INJURIES, OVERALL_STARS, ROLLOVER_STARS
from v_complaints, v_ratings
where upper(MAKE) = upper(MAKETXT) and upper(MODEL) = upper(MODELTXT) and MODEL_YR = {_year('YEARTXT')}
group by all""")

_add("q07", "v_investigations", """
select MAKE, MODEL, COMPNAME as COMPONENT, count(distinct ACTION_NUMBER) as INVESTIGATION_COUNT,
 count(distinct CAMPNO) as RELATED_CAMPAIGNS, min(YEAR) as EARLIEST_YEAR, max(YEAR) as LATEST_YEAR
from v_investigations group by all
order by INVESTIGATION_COUNT desc, MAKE nulls last, MODEL nulls last, COMPONENT nulls last limit 20""")

# Fully equal rows share a rank, so any of them may stand for the campaign's first row.
_add("q08", "v_recalls", f"""
with marked as (
 select *,
  rank() over (partition by CAMPNO order by MAKETXT nulls last, SRC_LINE, POTAFF nulls last, COMPNAME nulls last,
   DO_NOT_DRIVE nulls last, PARK_OUTSIDE nulls last, MODELTXT nulls last) as in_campaign,
  row_number() over (partition by CAMPNO, MAKETXT order by MODELTXT nulls last, SRC_LINE, POTAFF nulls last,
   COMPNAME nulls last, DO_NOT_DRIVE nulls last, PARK_OUTSIDE nulls last) as in_make
 from v_recalls)
select MAKETXT as MAKE, count(distinct CAMPNO) as TOTAL_RECALLS,
 {_big('sum(if(in_campaign = 1, POTAFF, 0))')} as TOTAL_VEHICLES_AFFECTED,
 count(distinct COMPNAME) as COMPONENTS_RECALLED, count(*) filter (where DO_NOT_DRIVE = 'Y') as DO_NOT_DRIVE_RECALLS,
 count(*) filter (where PARK_OUTSIDE = 'Y') as PARK_OUTSIDE_RECALLS
from marked where in_make = 1 group by all order by TOTAL_VEHICLES_AFFECTED desc nulls last, MAKE nulls last limit 20""")

_add("q08_dedup", "v_recalls", f"""
with kept as (
 select *, row_number() over (partition by CAMPNO, MAKETXT order by MODELTXT nulls last, SRC_LINE, POTAFF nulls last,
   COMPNAME nulls last, DO_NOT_DRIVE nulls last, PARK_OUTSIDE nulls last) as in_make,
  dense_rank() over (partition by CAMPNO order by MAKETXT nulls last) as make_no,
  max(POTAFF) over (partition by CAMPNO) as vehicles
 from v_recalls)
select MAKETXT as MAKE, count(distinct CAMPNO) as TOTAL_RECALLS,
 {_big('sum(if(make_no = 1, vehicles, 0))')} as TOTAL_VEHICLES_AFFECTED,
 count(distinct COMPNAME) as COMPONENTS_RECALLED, count(*) filter (where DO_NOT_DRIVE = 'Y') as DO_NOT_DRIVE_RECALLS,
 count(*) filter (where PARK_OUTSIDE = 'Y') as PARK_OUTSIDE_RECALLS
from kept where in_make = 1 group by all order by TOTAL_VEHICLES_AFFECTED desc nulls last, MAKE nulls last limit 20""")

_add("q09", "v_recalls", f"""
select coalesce(COMPNAME, '-- ALL COMPONENTS --') as COMPONENT, coalesce(MAKETXT, '-- ALL MAKES --') as MAKE,
 count(distinct CAMPNO) as RECALL_COUNT, {_big('sum(POTAFF)')} as TOTAL_AFFECTED
from v_recalls where MAKETXT in {_TEST_MAKES}
group by grouping sets ((COMPNAME, MAKETXT), (COMPNAME), (MAKETXT), ())""")

_add("q10", "v_recalls v_investigations", """
select r.MAKETXT as MAKE, CAMPNO as CAMPAIGN_NUMBER, r.COMPNAME as RECALL_COMPONENT, POTAFF as VEHICLES_AFFECTED,
 DESC_DEFECT, ACTION_NUMBER, SUBJECT as INVESTIGATION_SUBJECT, SUMMARY as INVESTIGATION_SUMMARY
from v_recalls r join v_investigations i using (CAMPNO)""")

_add("complaint_recall_pairs", "v_complaints v_recalls", """
select c.MAKETXT, c.CMPLID, c.DEATHS, c.INJURED, r.CAMPNO
from v_complaints c left join v_recalls r
 on upper(r.MAKETXT) = upper(c.MAKETXT) and upper(r.MODELTXT) = upper(c.MODELTXT) and r.YEARTXT = c.YEARTXT
where upper(trim(c.MAKETXT)) not in ('UNKNOWN', 'OTHER', '')""")

_add("q19_base", "complaint_recall_pairs", f"""
select MAKETXT as MAKE, count(distinct CMPLID) as COMPLAINT_COUNT, count(distinct CAMPNO) as RELATED_RECALLS,
 {_big('sum(DEATHS)')} as DEATHS_FROM_COMPLAINTS, {_big('sum(INJURED)')} as INJURIES_FROM_COMPLAINTS
from complaint_recall_pairs group by all""")

_add("q19", "q19_base", "select * from q19_base where COMPLAINT_COUNT > 10")
_add("q11", "q19_base", """
select * from q19_base where COMPLAINT_COUNT > 100 order by COMPLAINT_COUNT desc, MAKE nulls last limit 20""")
_add("q11_exact", "q11 v_complaints", f"""
select MAKE, COMPLAINT_COUNT, RELATED_RECALLS, {_big('sum(DEATHS)')} as DEATHS_FROM_COMPLAINTS,
 {_big('sum(INJURED)')} as INJURIES_FROM_COMPLAINTS
from q11 join v_complaints on MAKETXT = MAKE group by all""")
_add("q18", "q06", "select * from q06")

_add("top_makes", "v_complaints", """
select MAKETXT from v_complaints where PROD_TYPE = 'V' and MAKETXT is not null
group by all order by count(*) desc, MAKETXT limit 5""")

_CASUALTY = f"""{_pct("count(*) filter (where CRASH = 'Y')", 'count(*)', 2)} as CRASH_RATE_PCT,
 {_pct('(sum(DEATHS) + sum(INJURED))', 'count(*)', 2)} as CASUALTY_RATE_PCT"""
_TOLL = f"""count(*) as TOTAL_COMPLAINTS, {_big('sum(DEATHS)')} as TOTAL_DEATHS, {_big('sum(INJURED)')} as TOTAL_INJURIES,
 count(*) filter (where CRASH = 'Y') as TOTAL_CRASHES"""

_add("q12", "v_complaints top_makes", f"""
with chosen as (
 select upper(trim(c.MAKETXT)) as mk, {_component('COMPDESC', True)} as part, DEATHS, INJURED, CRASH
 from v_complaints c join top_makes m on m.MAKETXT = upper(trim(c.MAKETXT)) where PROD_TYPE = 'V')
select if(grouping(mk) = 1, '--- ALL MAKES (GRAND TOTAL) ---', mk) as VEHICLE_MAKE,
 case grouping(mk, part) when 3 then '--- ALL COMPONENTS (GRAND TOTAL) ---'
  when 1 then '--- ALL COMPONENTS (SUBTOTAL) ---' else part end as PRIMARY_COMPONENT,
 {_TOLL}, {_CASUALTY}
from chosen group by grouping sets ((mk, part), (mk), ())""")

_add("q13_cube", "v_recalls top_makes", f"""
with chosen as (
 select upper(trim(r.MAKETXT)) as mk, {_component('COMPNAME', False)} as part, upper(trim(RCLTYPECD)) as kind,
  upper(trim(CAMPNO)) as campaign, max(POTAFF) as vehicles
 from v_recalls r join top_makes m on m.MAKETXT = upper(trim(r.MAKETXT)) where RCLTYPECD <> 'X' group by all)
select if(grouping(mk) = 1, '--- ALL MAKES ---', mk) as VEHICLE_MAKE,
 if(grouping(part) = 1, '--- ALL COMPONENTS ---', part) as PRIMARY_COMPONENT,
 if(grouping(kind) = 1, '--- ALL RECALL TYPES ---', coalesce({_map(RECALL_TYPES)}[kind], kind)) as RECALL_CLASSIFICATION,
 count(distinct campaign) as TOTAL_RECALL_CAMPAIGNS, {_big('sum(vehicles)')} as TOTAL_VEHICLES_AFFECTED,
 {_pct('sum(vehicles)', 'count(distinct campaign)', 0, '1e0')} as AVG_VEHICLES_PER_RECALL,
 grouping(mk) as g1, grouping(part) as g2, grouping(kind) as g3
from chosen group by grouping sets ((mk, part, kind), (mk, part), (mk, kind), (part, kind), (mk), (part), (kind), ())""")
_add("q13_all", "q13_cube", "select * exclude (g1, g2, g3) from q13_cube")
_add("q13", "q13_cube", """
select * exclude (g1, g2, g3) from q13_cube
order by g1, g2, g3, TOTAL_VEHICLES_AFFECTED desc nulls last, VEHICLE_MAKE, PRIMARY_COMPONENT, RECALL_CLASSIFICATION
limit 40""")

_add("q14", "v_complaints", f"""
with brands as (
 select replace(upper(trim(MAKETXT)), '-', ' ') as VEHICLE_MAKE, {_TOLL}, {_CASUALTY}
 from v_complaints where PROD_TYPE = 'V' and upper(trim(MAKETXT)) <> 'UNKNOWN' group by all)
select *, {_round('(select avg(TOTAL_COMPLAINTS) from brands)', 0)} as NATIONAL_BRAND_AVERAGE
from brands where TOTAL_COMPLAINTS > (select avg(TOTAL_COMPLAINTS) from brands)""")


def _low_rated(year: str) -> str:
    return f"""
with per_campaign as (
 select upper(trim(MAKETXT)) as VEHICLE_MAKE, upper(trim(MODELTXT)) as VEHICLE_MODEL, {year} as MODEL_YEAR,
  {_component('COMPNAME', True)} as PRIMARY_COMPONENT, upper(trim(CAMPNO)) as campaign, max(POTAFF) as vehicles
 from v_recalls r
 where COMPNAME <> '' and RCLTYPECD <> 'X' and exists (
  from v_ratings s where s.OVERALL_STARS <= 2 and upper(trim(s.MAKE)) = upper(trim(r.MAKETXT))
   and upper(trim(s.MODEL)) = upper(trim(r.MODELTXT)) and s.MODEL_YR = {year})
 group by all)
select VEHICLE_MAKE, VEHICLE_MODEL, MODEL_YEAR, PRIMARY_COMPONENT,
 count(distinct campaign) as RECALL_CAMPAIGNS_ISSUED, {_big('sum(vehicles)')} as TOTAL_VEHICLES_RECALLED
from per_campaign group by all
order by TOTAL_VEHICLES_RECALLED desc nulls last, VEHICLE_MAKE, VEHICLE_MODEL, MODEL_YEAR, PRIMARY_COMPONENT limit 25"""


_add("q15", "v_recalls v_ratings", _low_rated(_year("regexp_replace(YEARTXT, '[^0-9]', '', 'g')")))
_add("q16", "v_recalls v_ratings", _low_rated(_year("YEARTXT")))

_add("q17", "v_recalls", f"""
with per_campaign as (
 select replace(upper(trim(MAKETXT)), '-', ' ') as mk, upper(trim(CAMPNO)) as campaign, max(POTAFF) as vehicles,
  count(*) filter (where upper(trim(DO_NOT_DRIVE)) in ('Y', 'YES', '1', 'TRUE')
   or upper(trim(PARK_OUTSIDE)) in ('Y', 'YES', '1', 'TRUE')) > 0 as severe
 from v_recalls where RCLTYPECD = 'V' and upper(trim(MAKETXT)) not in ('UNKNOWN', 'OTHER', 'ALL', '') group by all),
per_make as (
 select mk as VEHICLE_MAKE, count(distinct campaign) as TOTAL_SAFETY_CAMPAIGNS,
  {_big('sum(vehicles)')} as TOTAL_VEHICLES_RECALLED,
  {_big('sum(if(severe, vehicles, 0))')} as SEVERE_VEHICLES_RECALLED
 from per_campaign group by all having sum(vehicles) > 282000000)
select *, {_pct('SEVERE_VEHICLES_RECALLED', 'TOTAL_VEHICLES_RECALLED', 2)} as SEVERE_RECALL_PCT,
 case when SEVERE_VEHICLES_RECALLED = 0 and TOTAL_VEHICLES_RECALLED > 5000000
   then 'LOW RISK (Software / OTA Dominant Profile)'
  when SEVERE_VEHICLES_RECALLED / TOTAL_VEHICLES_RECALLED > 0.25 then 'HIGH RISK (Monitor Closely - Capital Intensive)'
  when SEVERE_VEHICLES_RECALLED / TOTAL_VEHICLES_RECALLED > 0.23 then 'MODERATE RISK (Standard Warranty Outlay)'
  else 'LOW RISK (Routine Maintenance Variance)' end as INVESTMENT_RISK_TIER
from per_make""")

# ---------------------------------------------------------------- chart frames

_CATEGORY = f"coalesce({_map(BODY_STYLE_CATEGORIES)}[BODY_STYLE], BODY_STYLE)"
_add("plot_q01", "q01", f"""
select {_CATEGORY} as BODY_STYLE_CLEAN, {_big('sum(VEHICLES_RATED)')} as VEHICLES_RATED,
 {_round('avg(AVG_OVERALL_STARS)', 6)} as AVG_OVERALL_STARS, {_round('avg(AVG_FRONTAL_STARS)', 6)} as AVG_FRONTAL_STARS,
 {_round('avg(AVG_SIDE_STARS)', 6)} as AVG_SIDE_STARS, {_round('avg(AVG_ROLLOVER_STARS)', 6)} as AVG_ROLLOVER_STARS
from q01 group by 1""")
_add("plot_q02a", "q02", """
select MODEL_YR, count(*) filter (where STAR_CHANGE > 0) as "Improved",
 count(*) filter (where STAR_CHANGE = 0) as "No Change", count(*) filter (where STAR_CHANGE < 0) as "Declined"
from q02 where STAR_CHANGE is not null group by all""")
_PLACED = "['#e94560', '#f5a623', '#00d2d3', '#a29bfe', '#55efc4'][{}]"
_add("trend_makes", "rated", f"""
with counted as (select MAKE, row_number() over (order by count(*) desc, MAKE) as place from rated where MAKE is not null group by MAKE)
select MAKE, {_PLACED.format('place')} as COLOR from counted where place <= 5""")
_add("plot_q02b", "q02 trend_makes", f"""
select MAKE, MODEL_YR, {_round('avg(ROLLING_3YR_AVG)', 4)} as ROLLING_AVG, COLOR
from q02 join trend_makes using (MAKE) group by all""")
_add("plot_q02c", "q02", f"""
with tiers as (select MODEL_YR, {_BINS.format('a', 'b', 'c', 'd', x='SAFETY_PERCENTILE')} as tier from q02)
select MODEL_YR, {_pct("count(*) filter (where tier = 'a')", 'count(*)', 6)} as "Top 25%",
 {_pct("count(*) filter (where tier = 'b')", 'count(*)', 6)} as "25–50%",
 {_pct("count(*) filter (where tier = 'c')", 'count(*)', 6)} as "50–75%",
 {_pct("count(*) filter (where tier = 'd')", 'count(*)', 6)} as "Bottom 25%"
from tiers group by all""")
_add("plot_q02d", "q02 trend_makes", """
select MAKE, MODEL_YR, max(CUMULATIVE_HIGH_RATINGS) as CUMULATIVE_HIGH_RATINGS, COLOR
from q02 join trend_makes using (MAKE) group by all""")
_add("plot_q02e", "q02", "select MODEL_YR, count(*) as RANK1_VEHICLES from q02 where RANK_IN_YEAR = 1 group by all")
_add("plot_q03", "q03", f"""
select MAKE, TOTAL_COMPLAINTS, {_thousands('TOTAL_COMPLAINTS')} as BAR_LABEL,
 'Deaths/Complaint: ' || printf('%.4f%%', DEATH_RATE_PER_COMPLAINT) as DEATH_LABEL from q03""")
_add("plot_q04", "q04", f"""
with proper as (
 select MAKE, try_cast(MODEL_YEAR as double) as MODEL_YEAR, RANK_IN_YEAR, COMPLAINTS from q04
 where try_cast(MODEL_YEAR as double) <= 2000),
leaders as (
 select MAKE, row_number() over (order by sum(COMPLAINTS) desc, MAKE) as place from proper where MAKE is not null group by MAKE)
select proper.*, {_PLACED.format('place')} as COLOR from proper join leaders using (MAKE) where place <= 5""")
_add("plot_q05a", "q05", """
select MAKE, COMPLAINT_COUNT from q05 where COMPONENT = '-- ALL COMPONENTS --' and MAKE <> '-- ALL MAKES --'
order by COMPLAINT_COUNT desc, MAKE limit 10""")
_SILENT = "('-- all components --', '-- all makes --', 'unknown', 'unspecified')"
_add("plot_q05b", "q05", f"""
with telling as (
 select {_failure('COMPONENT')} as failure, COMPLAINT_COUNT from q05
 where lower({_strip('COMPONENT')}) not in {_SILENT} and lower({_strip('MAKE')}) not in {_SILENT}
  and not regexp_matches({_strip('COMPONENT')}, {_text(COMPLAINT_NOISE)}))
select substr(failure, 1, 35) as COMPONENT, {_big('sum(COMPLAINT_COUNT)')} as COMPLAINT_COUNT
from telling group by failure order by 2 desc, failure limit 10""")
_add("plot_q06a", "q06", """
select MAKE || ' ' || MODEL as LABEL, COMPLAINT_COUNT from q06
order by COMPLAINT_COUNT desc, MAKE, MODEL, MODEL_YEAR, OVERALL_STARS nulls last, ROLLOVER_STARS nulls last limit 15""")
_add("plot_q06b", "q06", """
select OVERALL_STARS, COMPLAINT_COUNT, coalesce(TOTAL_INJURIES, 0) * 2 + 20 as BUBBLE_SIZE, ROLLOVER_STARS
from q06 where OVERALL_STARS is not null""")
_add("plot_q07", "q07", """
select MAKE || ' ' || MODEL || ' (' || COMPONENT || ')' as LABEL, INVESTIGATION_COUNT from q07
where MAKE is not null and MODEL is not null and COMPONENT is not null
order by INVESTIGATION_COUNT desc, MAKE, MODEL, COMPONENT limit 15""")
_add("plot_q08", "q08", f"""
select MAKE, TOTAL_VEHICLES_AFFECTED, {_thousands('TOTAL_VEHICLES_AFFECTED')} as BAR_LABEL from q08
order by TOTAL_VEHICLES_AFFECTED desc nulls last, MAKE nulls last limit 15""")
_add("q09_detail", "q09", f"""
select * from q09 where MAKE <> '-- ALL MAKES --' and COMPONENT <> '-- ALL COMPONENTS --'
 and not regexp_matches(COMPONENT, {_text(RECALL_NOISE)})""")
_add("plot_q09a", "q09_detail", f"""
select substr(grp, 1, 30) as COMPONENT_GROUP, {_big('sum(RECALL_COUNT)')} as RECALL_COUNT
from (select {_strip("split_part(COMPONENT, ':', 1)")} as grp, RECALL_COUNT from q09_detail)
group by grp order by 2 desc, grp limit 10""")
_add("plot_q09b", "q09_detail", f"""
select MAKE, {_big('sum(RECALL_COUNT)')} as RECALL_COUNT from q09_detail group by all""")
_Q10_ORDER = (
    "VEHICLES_AFFECTED desc nulls last, CAMPAIGN_NUMBER, MAKE nulls last, ACTION_NUMBER, RECALL_COMPONENT nulls last"
)
_add("q10_campaigns", "q10", f"""
select * from q10 qualify row_number() over (partition by CAMPAIGN_NUMBER order by {_Q10_ORDER}) = 1""")
_add("q10_actions", "q10", f"""
select * from q10 qualify row_number() over (partition by ACTION_NUMBER order by {_Q10_ORDER}) = 1""")
_add("actions_per_make", "q10_actions", """
select MAKE, count(distinct ACTION_NUMBER) as INVESTIGATIONS from q10_actions where MAKE is not null group by all""")
_add("plot_q10a", "actions_per_make", "select * from actions_per_make order by INVESTIGATIONS desc, MAKE limit 10")
_add("plot_q10b", "q10_campaigns", f"""
with parts as (
 select RECALL_COMPONENT as part, coalesce({_big('sum(VEHICLES_AFFECTED)')}, 0) as n from q10_campaigns
 where part is not null group by all order by n desc, part limit 10)
select substr(part, 1, 28) as COMPONENT, n as VEHICLES_AFFECTED,
 if(n >= 1000000, printf('%.0fM', n / 1e6), printf('%.0fK', n / 1e3)) as AXIS_LABEL from parts""")
_add("plot_q10c", "q10_campaigns actions_per_make", """
with top as (
 select MAKE, count(distinct CAMPAIGN_NUMBER) as RECALLS from q10_campaigns where MAKE is not null
 group by all order by RECALLS desc, MAKE limit 10)
select MAKE, RECALLS, coalesce(INVESTIGATIONS, 0) as INVESTIGATIONS from top left join actions_per_make using (MAKE)""")


def _histogram(source: str, x: str, bins: int) -> str:
    return f"""
with xs as (select {x} as x from {source}),
ends as (select min(x) as lo, (max(x) - min(x)) / {bins} as w from xs where x is not null),
counted as (
 select list_position(list_transform(generate_series(0, {bins - 1}), lambda i: x >= lo + i * w
  and (i = {bins - 1} or x < lo + (i + 1) * w)), true) - 1 as BIN, count(*) as N
 from xs, ends where x is not null group by 1)
select {_big('b')} as BIN, {_round('lo + b * w', 6)} as BIN_LOW, {_round('lo + (b + 1) * w', 6)} as BIN_HIGH,
 coalesce(N, 0) as N
from generate_series(0, {bins - 1}) s(b) cross join ends left join counted on BIN = b"""


_add("q10_sizes", "q10_campaigns", "select VEHICLES_AFFECTED as n from q10_campaigns where VEHICLES_AFFECTED > 0")
_add("plot_q10d", "q10_sizes", _histogram("q10_sizes", "log10(n)", 30))
_add("plot_q10d_median", "q10_sizes", f"""
select median(n) as MEDIAN, {_round('log10(median(n))', 6)} as LOG10_MEDIAN,
 'Median: ' || {_thousands('floor(median(n))')} as LABEL from q10_sizes""")
_add("plot_q11", "q11", f"""
select MAKE, COMPLAINT_COUNT, {_thousands('RELATED_RECALLS')} || ' recalls' as RECALL_LABEL
from q11 order by COMPLAINT_COUNT desc, MAKE limit 15""")
_add("plot_q12", "q12", f"""
select VEHICLE_MAKE, PRIMARY_COMPONENT, CRASH_RATE_PCT, CASUALTY_RATE_PCT,
 {_round('TOTAL_COMPLAINTS * 0.04', 6)} as BUBBLE_SIZE, {_COLORS}[VEHICLE_MAKE] as COLOR
from q12 where PRIMARY_COMPONENT not in
 ('OTHER / UNKNOWN', '--- ALL COMPONENTS (SUBTOTAL) ---', '--- ALL COMPONENTS (GRAND TOTAL) ---')""")
_add("plot_q13", "q13", f"""
select VEHICLE_MAKE, PRIMARY_COMPONENT, RECALL_CLASSIFICATION, TOTAL_RECALL_CAMPAIGNS,
 {_round('TOTAL_VEHICLES_AFFECTED / 1e6', 6)} as MILLIONS_AFFECTED,
 {_round('AVG_VEHICLES_PER_RECALL * 0.002', 6)} as BUBBLE_SIZE, {_COLORS}[VEHICLE_MAKE] as COLOR
from q13 where VEHICLE_MAKE <> '--- ALL MAKES ---' and PRIMARY_COMPONENT <> '--- ALL COMPONENTS ---'
 and RECALL_CLASSIFICATION <> '--- ALL RECALL TYPES ---'""")
_add("plot_q14a", "q14", """
select VEHICLE_MAKE, TOTAL_COMPLAINTS from q14 order by TOTAL_COMPLAINTS desc, VEHICLE_MAKE desc limit 15""")
_add("plot_q14b", "q14", """
select VEHICLE_MAKE, CRASH_RATE_PCT from q14 order by CRASH_RATE_PCT desc, VEHICLE_MAKE limit 15""")
_LOW_ORDER = "TOTAL_VEHICLES_RECALLED desc nulls last, VEHICLE_MAKE, VEHICLE_MODEL, MODEL_YEAR, PRIMARY_COMPONENT"
_CAR = "VEHICLE_MAKE || ' ' || VEHICLE_MODEL || ' (' || MODEL_YEAR || ')'"
_MILLIONS = f"{_round('TOTAL_VEHICLES_RECALLED / 1e6', 6)} as MILLIONS_RECALLED"
_add("plot_q15a", "q15", f"select {_CAR} as LABEL, {_MILLIONS} from q15 order by {_LOW_ORDER} limit 15")
_add("plot_q15b", "q15", f"""
select PRIMARY_COMPONENT, {_MILLIONS} from (
 select PRIMARY_COMPONENT, coalesce(sum(TOTAL_VEHICLES_RECALLED), 0) as TOTAL_VEHICLES_RECALLED from q15 group by all)
order by TOTAL_VEHICLES_RECALLED desc, PRIMARY_COMPONENT limit 10""")
_add("plot_q16", "q16", f"""
select {_CAR} || ' — ' || {_title('PRIMARY_COMPONENT')} as LABEL, {_MILLIONS},
 RECALL_CAMPAIGNS_ISSUED || ' campaigns' as BAR_LABEL
from q16 where TOTAL_VEHICLES_RECALLED is not null order by {_LOW_ORDER} limit 20""")
_add("risk_card", "q17", """
select * replace (substr(VEHICLE_MAKE, 1, 20) as VEHICLE_MAKE),
 trim(if(INVESTMENT_RISK_TIER like '%LOW RISK%', 'LOW RISK', split_part(INVESTMENT_RISK_TIER, '(', 1))) as RISK_TIER
from q17 where SEVERE_RECALL_PCT is not null""")
_add("plot_q17a", "risk_card", """
select VEHICLE_MAKE, SEVERE_RECALL_PCT, INVESTMENT_RISK_TIER, RISK_TIER,
 case RISK_TIER when 'HIGH RISK' then '#e94560' when 'MODERATE RISK' then '#f5a623' when 'LOW RISK' then '#55efc4' else 'gray' end as COLOR
from risk_card order by SEVERE_RECALL_PCT desc, VEHICLE_MAKE limit 15""")
_add("plot_q17b", "risk_card", f"""
select RISK_TIER, count(*) as N, {_round('count(*) / (select count(*) from risk_card)', 6)} as SHARE,
 printf('%.0f%%', count(*) * 100 / (select count(*) from risk_card)) as SHARE_LABEL,
 case RISK_TIER when 'HIGH RISK' then '#e94560' when 'MODERATE RISK' then '#f5a623' when 'LOW RISK' then '#55efc4' else 'gray' end as COLOR
from risk_card group by all""")

# ---------------------------------------------------------------- models: frames, and metrics of a fixed rule


def _train(*keys: str) -> str:
    return f"substr(md5(concat_ws('|', {', '.join(keys)})), 1, 2) < 'b3'"


_add("ml_frame", "q18", f"""
select {_train('MAKE', 'MODEL', 'MODEL_YEAR')} as TRAIN, MAKE, MODEL, MODEL_YEAR,
 columns(['COMPLAINT_COUNT', 'OVERALL_STARS', 'ROLLOVER_STARS', 'TOTAL_INJURIES', 'TOTAL_DEATHS'])::double
from q18 where OVERALL_STARS is not null and ROLLOVER_STARS is not null and TOTAL_INJURIES is not null
 and TOTAL_DEATHS is not null""")
_add("ml_split", "ml_frame", "select MAKE, TRAIN, count(*) as N from ml_frame group by all")
_add("ml_recall_frame", "q19", f"""
with complete as (
 select *, {_train('MAKE')} as train from q19
 where INJURIES_FROM_COMPLAINTS is not null and DEATHS_FROM_COMPLAINTS is not null)
select *, cast(RELATED_RECALLS > (select median(RELATED_RECALLS) from complete) as int) as y from complete""")
_add("ml_high_flag", "ml_recall_frame", """
select MAKE, RELATED_RECALLS::double as RELATED_RECALLS, y as HIGH_RECALLS from ml_recall_frame""")

def _least_squares(y: str) -> str:
    """Three-feature least squares of ``y`` on the training rows, by Cramer's rule on centred moments."""
    xs = ["COMPLAINT_COUNT", "OVERALL_STARS", "ROLLOVER_STARS"]
    moments = [f"covar_pop({a}, {b}) as s{i}{j}" for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    moments += [f"covar_pop({a}, {y}) as t{i}, avg({a}) as m{i}, stddev_pop({a}) as d{i}" for i, a in enumerate(xs)]

    def determinant(swapped: int | None) -> str:
        def at(i: int, j: int) -> str:
            return f"t{i}" if j == swapped else f"s{min(i, j)}{max(i, j)}"

        terms = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
        plus = [f"{at(0, a)}*{at(1, b)}*{at(2, c)}" for a, b, c in terms]
        minus = [f"{at(0, c)}*{at(1, b)}*{at(2, a)}" for a, b, c in terms]
        return f"({' + '.join(plus)} - {' - '.join(minus)})"

    slopes = ", ".join(f"{determinant(i)} / {determinant(None)} as b{i}" for i in range(3))
    return f"""
with m as (select {', '.join(moments)}, avg({y}) as my from {{frame}} where TRAIN),
b as (select *, {slopes} from m)
select b0, b1, b2, my - b0*m0 - b1*m1 - b2*m2 as a, d0, d1, d2 from b"""


def _score_metrics(name: str) -> str:
    return f"""
with m as (
 select 1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)) as R2, sqrt(avg((y - p) * (y - p))) as RMSE,
  avg(abs(y - p)) as MAE from {{scored}}, (select avg(y) as mean from {{scored}}))
select '{name}' as MODEL, name as METRIC, {_round('value', 6)} as VALUE
from (unpivot m on R2, RMSE, MAE into name name value value)"""


_add("injury_rule", "ml_frame", """
select TOTAL_INJURIES as y, COMPLAINT_COUNT * 25 as p from ml_frame where not TRAIN""")
_add("ml_reg_metrics", "injury_rule", _score_metrics("rule").replace("{scored}", "injury_rule"))
_add("deaths_frame", "q06", f"""
select {_train('MAKE', 'MODEL', 'MODEL_YEAR')} as TRAIN, * from q06
where OVERALL_STARS is not null and ROLLOVER_STARS is not null and TOTAL_DEATHS is not null""")
for _name, _frame, _target in (
    ("injuries", "ml_frame", "TOTAL_INJURIES"),
    ("deaths", "deaths_frame", "TOTAL_DEATHS"),
):
    _add(f"{_name}_model", _frame, _least_squares(_target).replace("{frame}", _frame))
    _add(f"{_name}_scored", f"{_frame} {_name}_model", f"""
select {_target}::double as y, a + b0*COMPLAINT_COUNT + b1*OVERALL_STARS + b2*ROLLOVER_STARS as p
from {_frame}, {_name}_model where not TRAIN""")
    _add(f"ml_ols_{_name}", f"{_name}_scored", _score_metrics(f"ols_{_name}").replace("{scored}", f"{_name}_scored"))
    _add(f"{_name}_coefs", f"{_name}_model", f"""
select 'ols_{_name}' as MODEL, unnest(['COMPLAINT_COUNT', 'OVERALL_STARS', 'ROLLOVER_STARS', 'Intercept']) as FEATURE,
 unnest([{', '.join(_round(x, 6) for x in ('b0', 'b1', 'b2', 'a'))}]) as COEFFICIENT,
 unnest([{', '.join(_round(x, 6) for x in ('b0*d0', 'b1*d1', 'b2*d2'))}, null]) as PER_STDDEV from {_name}_model""")
_add("ml_coefs_ols", "injuries_coefs deaths_coefs", """
select * from injuries_coefs union all select * from deaths_coefs""")
_add("plot_q18a", "injuries_scored", f"select y as LABEL, {_round('p', 6)} as PREDICTION from injuries_scored")
_add("ml_residual_hist", "injuries_scored", _histogram("injuries_scored", "y - p", 8))


def _newton(frame: str, label: str, features: list[str], steps: int) -> str:
    """Newton's steps for the log loss plus half the squared coefficients, intercept free.

    Features are divided by their largest value and the penalty adjusted, so the minimum is that
    of the unscaled problem. Each step sums gradient and Hessian over the training rows and solves
    the small linear system by elimination.
    """
    ids = range(len(features) + 1)
    weights = ", ".join(f"w{i}" for i in ids)
    upper = [(i, j) for i in ids for j in ids if j >= i]
    score = " + ".join(f"w{i}*x{i}" for i in ids)
    hessian = [f"sum(p*(1-p)*x{i}*x{j}){f' + max(q{i})' if i == j and i else ''} as a{i}_{j}" for i, j in upper]
    gradient = [f"sum((p - y)*x{i}){f' + max(q{i})*w{i}' if i else ''} as b{i}" for i in ids]
    step = (
        f"select k, {weights}, {', '.join(hessian + gradient)} "
        f"from (select *, 1/(1 + exp(-({score}))) as p from steps, scaled where k < {steps}) group by k, {weights}"
    )
    for p in ids[:-1]:
        rows = [f"a{i}_{j} - a{p}_{i}*a{p}_{j}/a{p}_{p} as a{i}_{j}" for i, j in upper if i > p]
        rows += [f"b{i} - a{p}_{i}*b{p}/a{p}_{p} as b{i}" for i in ids if i > p]
        step = f"select * replace ({', '.join(rows)}) from ({step})"
    for p in reversed(ids):
        known = "".join(f" - a{p}_{j}*d{j}" for j in ids if j > p)
        step = f"select *, (b{p}{known})/a{p}_{p} as d{p} from ({step})"
    scaled = ", ".join(
        f"{f}/(max({f}) over ()) as x{i}, 1/(max({f}) over ())^2 as q{i}, max({f}) over () as m{i}"
        for i, f in enumerate(features, 1)
    )
    moved = ", ".join(f"w{i} - d{i}" for i in ids)
    slopes = ", ".join(f"w{i}/m{i} as b{i}" for i in ids if i)
    return f"""
with recursive scaled as (select {label} as y, 1e0 as x0, {scaled} from {frame} where train),
steps as (select 0 as k, {', '.join(f'0e0 as w{i}' for i in ids)} union all select k + 1, {moved} from ({step}))
select distinct w0 as a, {slopes} from steps, scaled where k = {steps}"""


_RECALL_FEATURES = ["COMPLAINT_COUNT", "INJURIES_FROM_COMPLAINTS", "DEATHS_FROM_COMPLAINTS"]
_DEATH_FEATURES = ["TOTAL_COMPLAINTS", "CRASH_COUNT", "FIRE_COUNT", "TOTAL_INJURIES"]
_add("ml_death_flag_frame", "q03", f"""
with complete as (
 select *, {_train('MAKE')} as train from q03
 where MAKE is not null and TOTAL_DEATHS is not null and TOTAL_INJURIES is not null)
select *, cast(TOTAL_DEATHS > (select median(TOTAL_DEATHS) from complete) as int) as y from complete""")


def _accuracy(name: str, rows: str) -> str:
    return f"""
select '{name}' as MODEL, 'ACCURACY' as METRIC, {_round('avg(cast(y = p as int))', 6)} as VALUE from {rows}"""


def _confusion(rows: str) -> str:
    return f"""
with cells(ACTUAL, PREDICTED, CELL) as (
 values (0, 0, 'True Negative'), (0, 1, 'False Positive'), (1, 0, 'False Negative'), (1, 1, 'True Positive')),
counted as (
 select ACTUAL, PREDICTED, CELL, count(y) as N from cells left join {rows} on y = ACTUAL and p = PREDICTED group by all),
shared as (select *, {_round(f'N / (select count(*) from {rows})', 6)} as SHARE from counted)
select *, '(' || printf('%.1f%%', SHARE * 100) || ')' as SHARE_LABEL from shared"""


def _report(rows: str, classes: tuple[str, str]) -> str:
    return f"""
with per_class as (
 select c, count(*) filter (where y = c and p = c) as hit, count(*) filter (where p = c) as guessed,
  count(*) filter (where y = c) as support from {rows}, (values (0), (1)) v(c) group by c),
s as (
 select c, hit, support, coalesce(hit / nullif(guessed, 0), 0) as pr, coalesce(hit / nullif(support, 0), 0) as re,
  coalesce(2 * hit / nullif(guessed + support, 0), 0) as f1 from per_class),
lines as (
 select ['{classes[0]}', '{classes[1]}'][c + 1] as CLASS, pr, re, f1, support from s
 union all select 'accuracy', null, null, sum(hit) / sum(support), sum(support) from s
 union all select 'macro avg', avg(pr), avg(re), avg(f1), sum(support) from s
 union all select 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) from s)
select CLASS, {_round('pr', 6)} as PRECISION, {_round('re', 6)} as RECALL, {_round('f1', 6)} as F1,
 {_big('support')} as SUPPORT from lines"""


_add("rule_scored", "ml_recall_frame", """
select y, cast(COMPLAINT_COUNT > 500 as int) as p from ml_recall_frame where not train""")
_add("ml_cls_metrics", "rule_scored", _accuracy("rule", "rule_scored"))
_add("ml_confusion", "rule_scored", _confusion("rule_scored"))
_add("ml_cls_report", "rule_scored", _report("rule_scored", ("Low Recalls", "High Recalls")))
for _name, _frame, _features in (
    ("recalls", "ml_recall_frame", _RECALL_FEATURES),
    ("deaths", "ml_death_flag_frame", _DEATH_FEATURES),
):
    _add(f"logit_{_name}_model", _frame, _newton(_frame, "y", _features, 60))
    _line = " + ".join(f"b{i}*{f}" for i, f in enumerate(_features, 1))
    _add(f"logit_{_name}_scored", f"{_frame} logit_{_name}_model", f"""
select y, cast(a + {_line} > 0 as int) as p from {_frame}, logit_{_name}_model where not train""")
    _add(f"ml_logit_{_name}", f"logit_{_name}_scored", _accuracy(f"logit_{_name}", f"logit_{_name}_scored"))
    _add(f"ml_logit_{_name}_report", f"logit_{_name}_scored", _report(f"logit_{_name}_scored", (f"Low {_name.title()}", f"High {_name.title()}")))
    _slopes = ", ".join(f"b{i}" for i, _ in enumerate(_features, 1))
    _spreads = ", ".join(f"b{i} * (select stddev_pop({f}) from {_frame} where train)" for i, f in enumerate(_features, 1))
    _names = ", ".join(_text(f) for f in _features)
    _add(f"logit_{_name}_coefs", f"{_frame} logit_{_name}_model", f"""
select 'logit_{_name}' as MODEL, unnest([{_names}, 'Intercept']) as FEATURE,
 cast(printf('%.3e', unnest([{_slopes}, a])) as double) as COEFFICIENT,
 cast(printf('%.3e', unnest([{_spreads}, null])) as double) as PER_STDDEV from logit_{_name}_model""")
_add("ml_coefs", "injuries_coefs deaths_coefs logit_recalls_coefs logit_deaths_coefs", """
select * from injuries_coefs union all select * from deaths_coefs
union all select * from logit_recalls_coefs union all select * from logit_deaths_coefs""")
_add("plot_q19b", "logit_recalls_model", """
select unnest(['Complaint Count', 'Injuries', 'Deaths']) as FEATURE, cast(printf('%.3e', unnest([b1, b2, b3])) as double) as COEFFICIENT,
 case when unnest([b1, b2, b3]) < 0 then '#e94560' else '#55efc4' end as COLOR from logit_recalls_model""")
_add("plot_q19a", "logit_recalls_scored", _confusion("logit_recalls_scored"))

# ---------------------------------------------------------------- single operators

_add("f_codes", "v_recalls", "select RCLTYPECD, count(*) as N from v_recalls where RCLTYPECD <> 'X' group by all")
_add("f_regex_noise", "v_complaints", f"""
select CDESCR, count(*) as N from v_complaints
where CDESCR is null or not regexp_matches({_strip('CDESCR')}, {_text(COMPLAINT_NOISE)}) group by all""")
_add("f_dropna", "v_complaints", f"""
select MAKETXT, count(*) as N, {_big('sum(DEATHS)')} as DEATHS from v_complaints
where MAKETXT is not null and CDESCR is not null and DEATHS is not null group by all""")


def _shown(view: str, source: str, **columns: str) -> tuple[str, str]:
    made = ", ".join(f"{expression} as {name}" for name, expression in columns.items())
    return view, f"select {source}, {made}, count(*) as N from {view} group by all"


_add("x_norm_text", *_shown("v_complaints", "MAKETXT", CLEAN="upper(trim(MAKETXT))",
     CLEAN_MAKE="replace(upper(trim(MAKETXT)), '-', ' ')"))
_add("x_component_group", *_shown("v_complaints", "COMPDESC", BY_PREFIX=_component("COMPDESC", False),
     ANYWHERE=_component("COMPDESC", True)))
_add("x_regex_consolidate", *_shown("v_complaints", "CDESCR", FAILURE=_failure("CDESCR")))
_add("x_lookup_map", *_shown("v_ratings", "BODY_STYLE", CATEGORY=_CATEGORY))
_add("x_digits_year", *_shown("v_complaints", "YEARTXT", YEAR=_year("regexp_replace(YEARTXT, '[^0-9]', '', 'g')")))
_add("x_try_year", *_shown("v_complaints", "YEARTXT", YEAR=_year("YEARTXT")))
_add("x_to_numeric", *_shown("v_recalls", "YEARTXT", YEAR="try_cast(YEARTXT as double)"))
_add("x_fillna", "v_recalls", f"""
select coalesce(r.RCLTYPECD, 'NONE') as RCLTYPECD, count(*) as N, {_big('sum(coalesce(r.POTAFF, 0))')} as POTAFF
from v_recalls r group by 1""")
_add("x_safe_pct", "v_complaints", f"""
select MAKETXT, {_pct("count(*) filter (where CRASH = 'Y')", 'count(*)', 2)} as CRASH_PCT,
 {_pct("count(*) filter (where CRASH = 'Y')", "count(*) filter (where YEARTXT is null and FIRE = 'Y')", 2)} as SPARSE_PCT
from v_complaints group by all""")
_add("x_sign_bucket", "v_ratings", """
select OVERALL_STARS - ROLLOVER_STARS as CHANGE,
 map {1: 'Improved', 0: 'No Change', -1: 'Declined'}[cast(sign(CHANGE) as int)] as DIRECTION, count(*) as N
from v_ratings group by all""")
_add("x_right_closed_bins", "v_ratings", f"""
with xs as (select (OVERALL_STARS - 1) / 4 + if(MODEL_YR = 1995, 0.25e0, 0) as X from v_ratings)
select X, {_BINS.format('a', 'b', 'c', 'd', x='X')} as BIN, count(*) as N from xs group by all""")
_add("x_lower_strip", *_shown("v_complaints", "CDESCR", CLEAN=f"lower({_strip('CDESCR')})"))
_add("x_label", "v_investigations", """
select MAKE || ' ' || MODEL || ' (' || COMPNAME || ')' as LABEL,
 MAKE || ' ' || MODEL || ' (' || coalesce(COMPNAME, '<NA>') || ')' as SHOWN_LABEL, count(*) as N
from v_investigations group by all""")
_add("x_truncate", *_shown("v_recalls", "COMPNAME", SHORT="substr(COMPNAME, 1, 12)"))
_add("x_title", *_shown("v_recalls", "COMPNAME", TITLE=_title("COMPNAME")))
_add("x_tier_group", "risk_card", """
select VEHICLE_MAKE, INVESTMENT_RISK_TIER, RISK_TIER as TIER from risk_card""")
_add("x_human_number", "make_complaints", f"""
select MAKE, {_thousands('TOTAL_INJURIES')} as THOUSANDS,
 if(TOTAL_INJURIES >= 1000, printf('%.0fM', TOTAL_INJURIES / 1e3), printf('%.0fK', TOTAL_INJURIES / 1e0)) as SHORT,
 printf('%.4f%%', DEATH_RATE_PER_COMPLAINT) as PERCENT,
 printf('%.1f%%', {_pct('CRASH_COUNT', 'TOTAL_COMPLAINTS', 3, '1e0')} * 100) as SHARE
from make_complaints""")
_add("a_count", "v_complaints", "select MAKETXT, count(*) as N from v_complaints group by all")
_add("a_count_distinct", "v_complaints", """
select MAKETXT, count(distinct CMPLID) as COMPLAINTS from v_complaints group by all""")
_add("a_avg_of_counts", "a_count", f"select {_round('avg(N)', 6)} as AVG_ROWS from a_count")
_add("a_dedupe_sum", "v_recalls", f"""
select MAKETXT, count(*) as CAMPAIGNS, {_big('sum(p)')} as POTAFF
from (select MAKETXT, CAMPNO, max(POTAFF) as p from v_recalls group by all) group by all""")
_CODES = ["V", "E", "T", "X"]
_add("a_pivot_count", "v_recalls", f"""
select MAKETXT, {', '.join(f"count(*) filter (where RCLTYPECD = '{c}') as {c}" for c in _CODES)}
from v_recalls where MAKETXT is not null and RCLTYPECD is not null group by all""")
_add("a_pivot_share", "a_pivot_count", f"""
select MAKETXT, {', '.join(f"{_pct(c, '(V + E + T + X)', 6)} as {c}" for c in _CODES)} from a_pivot_count""")
_add("a_median", "v_recalls", """
select RCLTYPECD, median(POTAFF) as MEDIAN from v_recalls where POTAFF is not null group by all""")
_add("a_histogram", "v_recalls", _histogram("v_recalls", "if(POTAFF > 0, log10(POTAFF), null)", 30))
_add("a_value_share", "v_recalls", f"""
select RCLTYPECD, count(*) as N, {_round('count(*) / (select count(RCLTYPECD) from v_recalls)', 6)} as SHARE
from v_recalls where RCLTYPECD is not null group by all""")
_add("a_extent", "v_recalls", f"""
select max(POTAFF) as "MAX", min(POTAFF) as "MIN", {_big('sum(POTAFF)')} as TOTAL from v_recalls""")
_add("a_top_makes", "top_makes", "select * from top_makes")
_add("w_percent_rank", "q02", "select MAKE, MODEL, MODEL_YR, OVERALL_STARS, SAFETY_PERCENTILE from q02")
_add("w_rank", "q02", "select MAKE, MODEL, MODEL_YR, OVERALL_STARS, RANK_IN_YEAR from q02")
_add("w_part_count", "q02", "select MAKE, MODEL, MODEL_YR, TOTAL_MODELS_BY_MAKE from q02")
_IDENT = "RATING_ID, MAKE, MODEL, MODEL_YR, OVERALL_STARS"
_add("w_lag", "rated", f"select {_IDENT}, lag(OVERALL_STARS) over ({_MAKE_WINDOW}) as PREV_YEAR_STARS from rated")
_add("w_lag_diff", "rated", f"""
select {_IDENT}, OVERALL_STARS - lag(OVERALL_STARS) over ({_MAKE_WINDOW}) as STAR_CHANGE from rated""")
_add("w_moving_avg", "rated", f"""
select {_IDENT}, {_round('avg(OVERALL_STARS) over (' + _MAKE_WINDOW + ' rows 2 preceding)', 6)} as ROLLING_3YR_AVG
from rated""")
_add("w_cum_flag", "rated", f"""
select {_IDENT}, count(*) filter (where OVERALL_STARS >= 4) over ({_MAKE_WINDOW} rows unbounded preceding)
 as CUMULATIVE_HIGH_RATINGS from rated""")
_add("w_row_number", "v_recalls", f"""
select *, row_number() over (partition by CAMPNO order by MAKETXT nulls last, SRC_LINE, MODELTXT nulls last, {_RECALL_REST}) as RN
from v_recalls""")
_add("w_first_per_key", "v_recalls", f"""
select * from v_recalls qualify row_number() over (
 partition by CAMPNO, MAKETXT order by MODELTXT nulls last, SRC_LINE, {_RECALL_REST}) = 1""")
_add("w_keep_first", "v_recalls", """
select CAMPNO, MAKETXT, MODELTXT, POTAFF, COMPNAME from v_recalls qualify row_number() over (
 partition by CAMPNO order by POTAFF desc nulls last, SRC_LINE, MAKETXT nulls last, MODELTXT nulls last,
  YEARTXT nulls last, COMPNAME nulls last) = 1""")
_add("t_topk", "v_recalls", f"""
select CAMPNO, MAKETXT, MODELTXT, POTAFF from v_recalls
order by POTAFF desc nulls last, CAMPNO, SRC_LINE, MAKETXT nulls last, MODELTXT nulls last, {_RECALL_REST} limit 25""")
_add("t_nlargest", "make_complaints", """
select MAKE, CRASH_COUNT from make_complaints order by CRASH_COUNT desc, MAKE nulls last limit 15""")
_add("t_head_tail", "make_complaints", """
with numbered as (
 select MAKE, TOTAL_COMPLAINTS, row_number() over (order by TOTAL_COMPLAINTS desc, MAKE nulls last) as i,
  count(*) over () as n from make_complaints)
select MAKE, TOTAL_COMPLAINTS, 'head' as PART from numbered where i <= 15
union all select MAKE, TOTAL_COMPLAINTS, 'tail' from numbered where i > n - 15""")
_add("t_topk_semi", "v_complaints a_count", """
select MAKETXT, YEARTXT, count(*) as N from v_complaints
semi join (select MAKETXT from a_count where MAKETXT is not null order by N desc, MAKETXT limit 5) using (MAKETXT)
group by all""")

# Helper statements that are no query of their own.
_HELPERS = {
    *VIEWS, "rated", "make_complaints", "complaint_recall_pairs", "q19_base", "top_makes", "q13_cube", "trend_makes",
    "q09_detail", "q10_campaigns", "q10_actions", "actions_per_make", "q10_sizes", "risk_card", "ml_recall_frame",
    "rule_scored", "injury_rule", "deaths_frame",
    *[f"{n}_{part}" for n in ("injuries", "deaths") for part in ("model", "scored", "coefs")],
    "ml_death_flag_frame", *[f"logit_{n}_{part}" for n in ("recalls", "deaths") for part in ("model", "scored", "coefs")],
}


def _needs_of(name: str, seen: list[str]) -> list[str]:
    for need in STATEMENTS[name][0]:
        if need not in seen:
            _needs_of(need, seen)
            seen.append(need)
    return seen


def _statement(name: str) -> str:
    ctes = ",\n".join(f"{n} as ({STATEMENTS[n][1]})" for n in _needs_of(name, []))
    return f"with {ctes}\nselect * from ({STATEMENTS[name][1]}) result"


def oracle_sql() -> dict[str, str]:
    return {name: _statement(name) for name in STATEMENTS if name not in _HELPERS}
