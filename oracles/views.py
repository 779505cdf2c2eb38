"""The four subject tables over the star-schema tables, as DuckDB select statements (FIXTURES.md)."""

from __future__ import annotations


def _brand(sep: str) -> str:
    return f"upper(replace(p_brand, '#', '{sep}'))"


def _make(k: str) -> str:
    b = _brand(" ")
    return (
        f"case when {k}%53=0 then null when {k}%47=0 then 'UNKNOWN' when {k}%29=0 then {_brand('-')} "
        f"when {k}%23=0 then concat(' ', {b}, ' ') when {k}%19=0 then lower({b}) else {b} end"
    )


def _year(k: str, d: str) -> str:
    y = f"cast(year({d}) as varchar)"
    return (
        f"case when {k}%41=0 then null when {k}%37=0 then 'N/A' when {k}%31=0 then concat('MY', {y}) else {y} end"
    )


_COMPONENT = """case p_size%14 when 0 then 'SERVICE BRAKES, HYDRAULIC:FOUNDATION' when 1 then 'PARKING BRAKE'
 when 2 then 'ENGINE AND ENGINE COOLING:ENGINE' when 3 then 'FUEL SYSTEM, GASOLINE'
 when 4 then 'Electronic Stability Control' when 5 then 'VISIBILITY/WIPER' when 6 then 'EXTERIOR LIGHTING:HEADLIGHTS'
 when 7 then ' tires :TREAD' when 8 then 'AIR BAGS:FRONTAL' when 9 then 'STEERING' when 10 then null
 when 11 then 'UNKNOWN OR OTHER' when 12 then 'ELECTRICAL SYSTEM:LIGHTING RELAY' else '' end"""

_NARRATIVE = """case l_partkey%9 when 0 then 'No summary given' when 1 then 'SEE ATTACHED' when 2 then 'Transmission will fail'
 when 3 then 'brakes failed' when 4 then 'AIR BAG light' when 5 then 'steering pulls' when 6 then null
 when 7 then ' seat belt stuck ' else 'paint peels' end"""

VIEWS = {
    "v_ratings": f"""
select p_partkey as RATING_ID, {_brand(' ')} as MAKE, p_name as MODEL,
 case p_type when 'SMALL' then '2 DR' when 'ECONOMY' then '5 HB' when 'MEDIUM' then '4 DR' when 'STANDARD' then '4DR'
  when 'LARGE' then 'SUV' else 'XX' end as BODY_STYLE,
 cast(1995 + p_partkey%7 as int) as MODEL_YR,
 case when p_partkey%11=0 then null else cast(1 + p_size%5 as int) end as OVERALL_STARS,
 cast(1 + (p_size+1)%5 as int) as OVERALL_FRNT_STARS, cast(1 + (p_size+2)%5 as int) as OVERALL_SIDE_STARS,
 case when p_partkey%13=0 then null else cast(1 + (p_size+3)%5 as int) end as ROLLOVER_STARS,
 p_retailprice as ROLLOVER_POSSIBILITY
from part""",
    "v_complaints": f"""
select l_orderkey*10 + l_linenumber as CMPLID, {_make('l_orderkey')} as MAKETXT, upper(p_name) as MODELTXT,
 {_year('l_orderkey', 'l_shipdate')} as YEARTXT,
 case when l_linenumber=7 then null else cast(round(l_discount*100) as int) end as DEATHS,
 cast(l_quantity as int) as INJURED, if(l_returnflag='R', 'Y', 'N') as CRASH, if(l_returnflag='A', 'Y', 'N') as FIRE,
 if(l_linestatus='O', 'V', 'E') as PROD_TYPE, {_COMPONENT} as COMPDESC, {_NARRATIVE} as CDESCR
from lineitem join part on l_partkey = p_partkey""",
    "v_recalls": f"""
select cast(o_orderkey as varchar) as CAMPNO, {_make('o_orderkey')} as MAKETXT, upper(p_name) as MODELTXT,
 {_year('o_orderkey', 'o_orderdate')} as YEARTXT,
 case when o_orderkey%17=0 then null else cast(floor(o_totalprice) as bigint) end as POTAFF, {_COMPONENT} as COMPNAME,
 case when o_orderkey%43=0 then null when o_orderkey%9=0 then 'X' when o_orderstatus='P' then 'E' else 'V' end as RCLTYPECD,
 case when o_orderpriority='1-URGENT' and o_orderkey%2=0 then 'Y' when o_orderpriority='1-URGENT' then ' yes'
  else 'N' end as DO_NOT_DRIVE,
 case when o_orderpriority='2-HIGH' and o_orderkey%5=0 then 'Y' end as PARK_OUTSIDE,
 concat('defect ', p_type) as DESC_DEFECT, l_linenumber as SRC_LINE
from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "v_investigations": """
select concat('PE', cast(event_id%500 as varchar)) as ACTION_NUMBER, concat('BRAND ', cast(1 + user_id%25 as varchar)) as MAKE,
 event_type as MODEL, case when event_id%21=0 then null else event_type end as COMPNAME,
 case when event_id%3=0 then null else cast(event_id%1500 as varchar) end as CAMPNO,
 cast(1995 + user_id%7 as int) as YEAR, event_type as SUBJECT, props as SUMMARY
from events""",
}
