"""Views over the given tables that play the business tables; the same text serves Spark and the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "business": """
select c_custkey business_id, c_name name, n_name county, r_name state,
  case c_mktsegment
    when 'AUTOMOBILE' then case c_custkey % 3 when 0 then '484'  when 1 then '493'  else '4841' end
    when 'BUILDING'   then case c_custkey % 3 when 0 then '5415' when 1 then '511'  else '541'  end
    when 'FURNITURE'  then case c_custkey % 3 when 0 then '3254' when 1 then '325'  else '621'  end
    when 'HOUSEHOLD'  then case c_custkey % 3 when 0 then '332'  when 1 then '333'  else '336'  end
    else                   case c_custkey % 3 when 0 then '311'  when 1 then '3253' else '112'  end
  end naics_code,
  cast(coalesce(n,0) * (1 + c_custkey % 50) as int) employees,
  round(cast(coalesce(rev,0) as double), 2) revenue_estimate,
  cast(1980 + c_custkey % 45 as int) year_established,
  cast(38.2 as double)  + cast(c_custkey*37 % 1500 as double)/cast(1000 as double) latitude,
  cast(-95.2 as double) + cast(c_custkey*53 % 1200 as double)/cast(1000 as double) longitude,
  cast(c_custkey % 7 as int) patent_count, cast(c_custkey % 3 as int) sbir_awards
from {customer} join {nation} on c_nationkey = n_nationkey
  join {region} on n_regionkey = r_regionkey
  left join (select o_custkey, count(*) n, sum(o_totalprice) rev from {orders} group by o_custkey) o on o_custkey = c_custkey
""",
    "member": """
select concat(state, ':', substr(naics_code, 1, 2)) cluster_id, business_id, name, county, state, naics_code, employees,
  revenue_estimate, year_established, latitude, longitude, patent_count, sbir_awards
from {business}
""",
    "messy": """
select business_id,
  case business_id % 6 when 0 then concat(name, ', Inc.') when 1 then concat(upper(name), ' LLC #', cast(business_id as varchar(20)))
    when 2 then concat(name, ' & Sons Company') when 3 then concat('  ', name, '   Corp ') when 4 then concat('The ', name, ' Group, Ltd.') else '' end raw_name,
  concat(cast(business_id % 900 as varchar(20)), case business_id % 4 when 0 then ' North Main Street Suite 5' when 1 then ' Oak Avenue' when 2 then ' West 9th Road, Apt 12' else ' Elm Place' end) raw_address,
  case business_id % 4 when 0 then concat('(816) 555-', cast(1000 + business_id % 9000 as varchar(20))) when 1 then concat('1-913-555-', cast(1000 + business_id % 9000 as varchar(20)))
    when 2 then '555-1212' else 'none' end raw_phone,
  case business_id % 3 when 0 then concat(cast(64000 + business_id % 200 as varchar(20)), '-1234') when 1 then cast(66000 + business_id % 200 as varchar(20)) else '6411' end raw_zip,
  case business_id % 7 when 0 then concat(naics_code, '.0') when 1 then 'nan' when 2 then '' when 3 then concat(naics_code, '10') when 4 then '0' else naics_code end raw_naics,
  case business_id % 5 when 0 then concat('$', cast(business_id % 97 as varchar(20)), ',500') when 1 then concat('$', cast(business_id % 90 as varchar(20)), '.5M') when 2 then concat(cast(business_id % 40 as varchar(20)), 'K') when 3 then 'abc' else '' end raw_amount,
  case business_id % 4 when 0 then concat(cast(business_id % 50 as varchar(20)), '-', cast(business_id % 50 + 40 as varchar(20))) when 1 then concat(cast(business_id % 700 as varchar(20)), ' people') when 2 then 'many' else '' end raw_range,
  case business_id % 5 when 0 then concat(cast(1990 + business_id % 30 as varchar(20)), '-03-04') when 1 then concat('03/04/', cast(1990 + business_id % 30 as varchar(20))) when 2 then concat('FY ', cast(1990 + business_id % 30 as varchar(20))) when 3 then 'soon' else '' end raw_date,
  county, state
from {business}
""",
    "award": """
select o_orderkey award_id, c_name company, c_custkey business_id, o_orderpriority agency, o_totalprice amount,
  cast(extract(year from o_orderdate) as int) award_year,
  case o_orderstatus when 'F' then 'Phase I' when 'O' then 'Phase II' else 'Phase III' end phase
from {orders} join {customer} on o_custkey = c_custkey
""",
    "patent": """
select l_orderkey * 10 + l_linenumber patent_id, s_name assignee, p_type cpc1, p_brand cpc2, p_name title,
  cast(l_quantity as int) citations, cast(extract(year from l_shipdate) as int) grant_year
from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey
""",
    "crime": """
select event_id, cast(user_id % 20 as int) zip, event_type category, ts, value from {events}
""",
    "outcome": """
select n_name program, sum(l_extendedprice) projected, sum(l_extendedprice * (1 - l_discount)) actual
from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
group by n_name
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = set(re.findall(r"{(\w+)}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{p: view(spark, sf_dir, p) for p in parts})
