"""Queries for cleaning, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import cleaning as C
from regiolith.plans.registry import query
from regiolith.plans.views import view


@query(
    "E1_winsorize",
    """with q as (select quantile_cont(revenue_estimate, 0.25) a, quantile_cont(revenue_estimate, 0.75) b, quantile_cont(employees, 0.25) c, quantile_cont(employees, 0.75) d from business)
    select business_id, round(least(greatest(revenue_estimate, greatest(10000, a - 1.5 * (b - a))), least(1e9, b + 1.5 * (b - a))), 2) revenue_estimate,
      cast(least(greatest(employees, greatest(1, trunc(c - 1.5 * (d - c)))), least(50000, trunc(d + 1.5 * (d - c)))) as int) employees from business, q""",
)
def winsorize(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    out = C.winsorized(C.winsorized(b, "revenue_estimate", 10_000.0, 1e9), "employees", 1, 50_000, whole=True)
    return out.select("business_id", F.round("revenue_estimate", 2).alias("revenue_estimate"), "employees")


@query(
    "E2_outlier_ratio",
    """select business_id, coalesce(revenue_estimate / nullif(employees, 0) > 20000, false) suspicious,
    round(case when revenue_estimate / nullif(employees, 0) > 50000 then employees * 30000.0 else revenue_estimate end, 2) revenue_estimate from business""",
)
def outlier_ratio(spark, sf_dir):
    out = C.fixed_outlier_ratio(view(spark, sf_dir, "business"), impossible=50_000.0, suspicious=20_000.0, each=30_000.0)
    return out.select("business_id", "suspicious", F.round("revenue_estimate", 2).alias("revenue_estimate"))


@query(
    "F1_keep_best",
    "select business_id, county, naics_code from (select *, row_number() over (partition by county, naics_code order by revenue_estimate desc, business_id) n from business) where n = 1",
)
def keep_best(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    return C.keep_best(b, ["county", "naics_code"], [F.desc("revenue_estimate"), F.asc("business_id")]).select("business_id", "county", "naics_code")


def user_rules():
    return [
        ("state", F.col("state").isin("ASIA", "EUROPE", "AFRICA")),
        ("employees", F.col("employees").between(20, 600)),
        ("revenue", F.col("revenue_estimate") >= 500_000),
        ("age", F.lit(2010) - F.col("year_established") >= 3),
        ("industry", ~F.col("naics_code").startswith("112")),
    ]


REASON = """case when state not in ('ASIA', 'EUROPE', 'AFRICA') then 'state' when employees not between 20 and 600 then 'employees'
 when revenue_estimate < 500000 then 'revenue' when 2010 - year_established < 3 then 'age' when naics_code like '112%' then 'industry' end"""


@query("C1_user_filters", f"select business_id, {REASON} reject_reason from business")
def user_filters(spark, sf_dir):
    return C.reject_reasons(view(spark, sf_dir, "business"), user_rules()).select("business_id", "reject_reason")


@query(
    "F11_stage_counts",
    f"""with r as (select {REASON} reason from business), s(stage, name) as (values (1, 'state'), (2, 'employees'), (3, 'revenue'), (4, 'age'), (5, 'industry')),
    c as (select stage, name, (select count(*) from r where reason = name) rejected from s)
    select stage, name, rejected, cast((select count(*) from r) - sum(rejected) over (order by stage) as bigint) remaining from c""",
)
def stage_counts(spark, sf_dir):
    return C.stage_counts(view(spark, sf_dir, "business"), user_rules())


@query("C3_region_filter", "select event_id, zip from crime where zip between 5 and 9 or lower(category) like '%click%'")
def region_filter(spark, sf_dir):
    return view(spark, sf_dir, "crime").where(F.col("zip").between(5, 9) | F.lower("category").rlike("click")).select("event_id", "zip")


@query("C4_select_by_prefixes", "select business_id, naics_code from business where naics_code like '484%' or naics_code like '493%' or naics_code like '3254%'")
def select_by_prefixes(spark, sf_dir):
    return C.with_prefixes(view(spark, sf_dir, "business"), "naics_code", ["484", "493", "3254"]).select("business_id", "naics_code")


@query(
    "C5_near_top",
    "select business_id, state from (select *, max(revenue_estimate) over (partition by state) m from business) where revenue_estimate >= m * (1 - 0.2)",
)
def near_top(spark, sf_dir):
    return C.near_top(view(spark, sf_dir, "business"), "revenue_estimate", 0.2, ["state"]).select("business_id", "state")


@query(
    "C6_patent_keywords",
    "select patent_id, assignee, grant_year from patent where grant_year >= 1998 and (regexp_matches(lower(concat(title, ' ', cpc1)), 'steel|large'))",
)
def patent_keywords(spark, sf_dir):
    p = view(spark, sf_dir, "patent")
    return p.where((F.col("grant_year") >= 1998) & F.lower(F.concat_ws(" ", "title", "cpc1")).rlike("steel|large")).select("patent_id", "assignee", "grant_year")


@query("H2_top_k", "select business_id, revenue_estimate from business order by revenue_estimate desc, business_id limit 20")
def top_k(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", "revenue_estimate").orderBy(F.desc("revenue_estimate"), "business_id").limit(20)


@query("H3_recent_history", "select event_id, ts from events where user_id = 7 order by ts desc, event_id limit 10")
def recent_history(spark, sf_dir):
    return view(spark, sf_dir, "events").where("user_id = 7").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


@query("H5_balance", """with g as (select business_id, case when naics_code like '484%' then '484' when naics_code like '3254%' then '3254' end grp, revenue_estimate from business),
    r as (select *, row_number() over (partition by grp order by revenue_estimate desc, business_id) n from g)
    select business_id from r where grp is null or n <= case grp when '484' then 50 else 30 end""")
def balance(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    return C.balanced(b, "naics_code", {"484": 50, "3254": 30}, [F.desc("revenue_estimate"), F.asc("business_id")]).select("business_id")


@query(
    "H6_jaccard",
    """with m as (select distinct county cluster, naics_code code from business), n as (select cluster, count(*) k from m group by cluster),
    i as (select x.cluster a, y.cluster b, count(*) k from m x join m y on x.code = y.code and x.cluster < y.cluster group by x.cluster, y.cluster)
    select a, b, i.k shared, round(i.k / (p.k + q.k - i.k), 6) jaccard from i join n p on p.cluster = a join n q on q.cluster = b""",
)
def jaccard(spark, sf_dir):
    from regiolith.operators.clusters import member_jaccard

    m = view(spark, sf_dir, "business").select(F.col("county").alias("cluster"), F.col("naics_code").alias("code"))
    return member_jaccard(m, "cluster", "code").select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("H7_union_members", "select distinct company from award where phase = 'Phase I' union select distinct company from award where agency like '1-%'")
def union_members(spark, sf_dir):
    a = view(spark, sf_dir, "award")
    return a.where("phase = 'Phase I'").select("company").union(a.where("agency like '1-%'").select("company")).distinct()


@query(
    "H8_set_overlap",
    """with s as (select county, list_sort(list(distinct substr(naics_code, 1, 3))) codes from business group by county)
    select county, len(list_filter(['484', '541', '999'], lambda x: list_contains(codes, x))) shared, len(list_filter(['484', '541', '999'], lambda x: not list_contains(codes, x))) missing from s""",
)
def set_overlap(spark, sf_dir):
    wanted = F.array(F.lit("484"), F.lit("541"), F.lit("999"))
    s = view(spark, sf_dir, "business").groupBy("county").agg(F.collect_set(F.substring("naics_code", 1, 3)).alias("codes"))
    return s.select("county", F.size(F.array_intersect(wanted, "codes")).cast("long").alias("shared"), F.size(F.array_except(wanted, "codes")).cast("long").alias("missing"))


@query("D21_unassigned", "select business_id from business where business_id not in (select business_id from award where phase = 'Phase II') and county in (select n_name from nation where n_regionkey = 2)")
def unassigned(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    second = view(spark, sf_dir, "award").where("phase = 'Phase II'").select("business_id")
    local = view(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("county"))
    return b.join(second, "business_id", "left_anti").join(F.broadcast(local), "county", "left_semi").select("business_id")


@query("A21_unify_sources", "select business_id id, name, 'customer' source from business union all select s_suppkey, s_name, 'supplier' from supplier")
def unify_sources(spark, sf_dir):
    from regiolith.sources.readers import unified

    b = view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "name")
    s = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return unified({"customer": b, "supplier": s})
