"""Queries for scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import ranking as RK
from regiolith.operators import scorecards as C
from regiolith.operators import scores as S
from regiolith.operators.reports import NEEDS, TYPE_OF_CODE
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.views import view

GROWTH = """coalesce(case substr(naics_code, 1, 4) when '3254' then 0.07::double when '5415' then 0.09::double when '3253' then 0.05::double end,
  case substr(naics_code, 1, 3) when '484' then 0.06::double when '493' then 0.08::double when '332' then 0.04::double end, 0.05::double)"""
INNOVATION = """least(100.0, 40.0::double * least(1.0, ln(1 + patent_count) / ln(51)) + 40.0::double * least(1.0, ln(1 + sbir_awards) / ln(11)) +
  case when naics_code like '5417%' then 20.0 when naics_code like '3254%' then 15.0 when naics_code like '5415%' or naics_code like '5112%' then 10.0 else 0.0 end)"""
MARKET = f"""least(100.0, 40.0::double * {GROWTH} / 0.09::double + 15.0::double * least(1.0, ln(1 + revenue_estimate) / ln(10000000001)) + 15.0::double * least(1.0, ln(1 + greatest(employees, 1)) / ln(100001))
  + least(30.0, 30.0::double * case when 2024 - year_established <= 5 then 1.0::double when 2024 - year_established <= 10 then 2.0::double / 3 else 1.0::double / 3 end * {GROWTH} / 0.1::double))"""
POSITION = "case when {0} >= 5 then 20.0::double when {0} >= 2 then 15.0::double when {0} >= 1 then 10.0::double else 5.0::double * {0} end"
ER = "(case when me > 0 then employees / me else 1.0::double end)"
RR = "(case when mr > 0 then revenue_estimate / mr else 1.0::double end)"
COMPETITION = f"""least(100.0, greatest(0.0, {POSITION.format(ER)} + {POSITION.format(RR)}
  + least(30, case when patent_count > 5 then 20 when patent_count > 0 then 10 + patent_count * 2 else 0 end + case when sbir_awards > 0 then least(10, sbir_awards * 5) else 0 end)
  + case when n < 50 then 30 when n < 100 then 20 when n < 200 then 10 else 5 end + case when n < 50 then 10 when n > 200 then -10 else 0 end))"""
REGIONAL = "case when naics_code like '3254%' then 1.25::double when naics_code like '112%' then 1.3::double when naics_code like '54%' then 1.2::double when naics_code like '484%' or naics_code like '493%' or naics_code like '52%' then 1.15::double when naics_code like '31%' or naics_code like '32%' or naics_code like '33%' then 1.1::double else 1.0::double end"
STATS = "stats as (select substr(naics_code, 1, 3) code3, count(*) n, median(employees) me, median(revenue_estimate) mr from business group by 1)"
SCORED = f"scored as (select b.*, {INNOVATION} innovation_score, {MARKET} market_score, {COMPETITION} competition_score from business b join stats on code3 = substr(naics_code, 1, 3))"
FINAL = f"(innovation_score * 0.3::double + market_score * 0.4::double + competition_score * 0.3::double) * {REGIONAL}"


@query("J1_innovation_score", f"select business_id, round({INNOVATION}, 6) score from business")
def innovation(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", F.round(S.innovation_score(), 6).alias("score"))


@query("J2_market_potential", f"select business_id, round({MARKET}, 6) score from business")
def market(spark, sf_dir):
    out = S.scored(view(spark, sf_dir, "business"), AS_OF)
    return out.select("business_id", F.round("market_score", 6).alias("score"))


@query("J3_competition", f"with {STATS} select business_id, round({COMPETITION}, 6) score from business join stats on code3 = substr(naics_code, 1, 3)")
def competition(spark, sf_dir):
    return S.scored(view(spark, sf_dir, "business"), AS_OF).select("business_id", F.round("competition_score", 6).alias("score"))


@query("J5_regional_multiplier", f"select business_id, {REGIONAL} multiplier from business")
def regional(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", S.regional_multiplier().alias("multiplier"))


@query(
    "J6_quick_score",
    """select business_id, round(least(30.0, 5 * log10(1 + revenue_estimate)) + least(30.0, 10 * log10(1 + employees)) + least(20, patent_count * 4) + least(10, sbir_awards * 5) + case when 2024 - year_established between 3 and 20 then 10 else 5 end, 6) score from business""",
)
def quick(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", F.round(S.quick_score(AS_OF), 6).alias("score"))


@query("J7_composite", f"with {STATS}, {SCORED} select business_id, round(innovation_score * 0.3::double + market_score * 0.4::double + competition_score * 0.3::double, 6) composite_score, round({FINAL}, 6) final_score from scored")
def composite(spark, sf_dir):
    return rounded(S.scored(view(spark, sf_dir, "business"), AS_OF).select("business_id", "composite_score", "final_score"))


TYPE = "case substr(naics_code, 1, 3) " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_OF_CODE.items()) + " else 'manufacturing' end"
REVENUE = "employees * case when naics_code like '5415%' then 200000.0::double when naics_code like '3254%' then 400000.0::double when naics_code like '484%' then 180000.0::double else 150000.0::double end * case when employees < 10 then 0.8::double when employees > 250 then 1.2::double else 1.0::double end"
PERCENTILES = ", ".join(f"quantile_cont(s, {k / 100}) p{k}" for k in RK.LEVELS)
GAPS = ", ".join(f"struct_pack(g := round(p{a} - p{b}, 9), l := {a})" for a, b in zip(RK.LEVELS, RK.LEVELS[1:]))


@query(
    "H1_rank_businesses",
    f"""with filled as (select * replace (case when coalesce(revenue_estimate, 0) = 0 then {REVENUE} else revenue_estimate end as revenue_estimate) from (select * replace (case when business_id % 6 = 0 then 0 else revenue_estimate end as revenue_estimate) from business)),
    needs(type, e, p) as (values {", ".join(f"('{k}', {e}, {p})" for k, (e, p) in NEEDS.items())}), typed as (select *, {TYPE} type from filled), kept as (select typed.* exclude (type) from typed left join needs using (type) where not coalesce(employees < e, false) and not coalesce(patent_count < p, false)),
    {STATS.replace('from business', 'from kept')}, {SCORED.replace('from business', 'from kept')}, f as (select *, round({FINAL}, 6) s from scored),
    t as (select count(*) n, max(s) best, {PERCENTILES} from f), u as (select *, case when n < 1000 then 0.30::double else 0.45::double end base, case when n < 1000 then 100 else 500 end needed, (100 - list_max([{GAPS}]).l) / 100 gap_part from t),
    v as (select *, case when gap_part < base then (base + gap_part) / 2 else base end part from u),
    w as (select best, greatest(0.05::double, least(0.70::double, case when floor(n * (1 - part) + 0.000000001) < needed then case when needed / n < 0.95 then 1 - needed / n * 1.1::double else 0.05::double end else part end)) part from v)
    select business_id, round(revenue_estimate, 2) revenue_estimate, s final_score, row_number() over (order by s desc, business_id) place, s >= best * (1 - part) passes, round(part, 6) threshold_part from f, w""",
)
def rank_businesses(spark, sf_dir):
    """Every sixth business has no revenue of its own."""
    b = view(spark, sf_dir, "business").withColumn("revenue_estimate", F.when(F.col("business_id") % 6 == 0, 0.0).otherwise(F.col("revenue_estimate")))
    out = RK.rank_businesses(b, AS_OF).select("business_id", "revenue_estimate", "final_score", "place", "passes", "threshold_part")
    return rounded(out, revenue_estimate=2)


@query(
    "J9_longevity",
    """with g as (select cluster_id, count(*) n, avg(2024 - year_established) age, sum(patent_count) patents, count(distinct substr(naics_code, 1, 3)) codes from member group by 1)
    select cluster_id, cast(least(10, 5 + case when n >= 50 then 2 when n >= 20 then 1 else 0 end + case when age >= 15 then 1 else 0 end + case when patents >= 100 then 1 else 0 end + case when codes >= 3 then 1 else -1 end) as int) longevity from g""",
)
def longevity(spark, sf_dir):
    return S.longevity(view(spark, sf_dir, "member"), AS_OF)


@query(
    "J11_success_probability",
    """with g as (select cluster_id, count(*) n, count(distinct substr(naics_code, 1, 3)) codes, avg(2024 - year_established) age, stddev_samp(revenue_estimate) / nullif(avg(revenue_estimate), 0) cv, quantile_cont(employees, 0.75) upper from member group by 1)
    select cluster_id, round(least(0.8, greatest(0.35, 0.3 * least(1.0, upper / 500) + 0.2 * least(1.0, n / 50) + 0.2 * least(1.0, codes / 5) + 0.15 * least(1.0, age / 20) + 0.15 * greatest(0.0, 1 - coalesce(cv, 1.0) / 2))), 6) success from g""",
)
def success(spark, sf_dir):
    return rounded(S.success_probability(view(spark, sf_dir, "member"), AS_OF))


@query(
    "J12_intra_synergy",
    """with c as (select distinct cluster_id, substr(naics_code, 1, 3) code from member union select distinct cluster_id, substr(naics_code, 1, 4) from member),
    t(a, b, points) as (values ('484', '493', 30), ('332', '484', 20), ('3254', '5417', 25), ('5415', '5416', 20)),
    p as (select x.cluster_id, sum(points) points from t join c x on x.code = a join c y on y.code = b and y.cluster_id = x.cluster_id group by 1),
    g as (select cluster_id, count(distinct county) counties, stddev_samp(employees) spread from member group by 1)
    select cluster_id, cast(coalesce(points, 0) + case when counties <= 3 then 20 else 0 end + case when spread > 50 then 15 else 0 end as bigint) synergy from g left join p using (cluster_id)""",
)
def synergy(spark, sf_dir):
    return S.intra_synergy(view(spark, sf_dir, "member"))


@query(
    "J13_cluster_risk",
    """with t as (select cluster_id, max(k) top, count(*) codes from (select cluster_id, substr(naics_code, 1, 3) code, count(*) k from member group by 1, 2) group by 1),
    g as (select cluster_id, count(*) n, avg(2024 - year_established) age, count(*) filter (where employees < 20) small, count(*) filter (where substr(naics_code, 1, 3) in ('484', '332')) volatile from member group by 1)
    select cluster_id, round(case when codes = 1 then 30 when top / n > 0.7 then 20 else 0 end + case when age < 3 then 20 else 0 end + case when small / n > 0.7 then 15 else 0 end + volatile / n * 20, 6) risk from g join t using (cluster_id)""",
)
def risk(spark, sf_dir):
    return rounded(S.cluster_risk(view(spark, sf_dir, "member"), AS_OF))


@query(
    "J16_network_metrics",
    """with p as (select cluster_id, county, count(*) k from member group by 1, 2), g as (select cluster_id, sum(k) n, sum(k * (k - 1) / 2) links, max(k) largest from p group by 1)
    select cluster_id, cast(links as bigint) links, round(coalesce(links / nullif(n * (n - 1) / 2, 0), 0), 6) density, round(1 - largest / n, 6) resilience from g""",
)
def network(spark, sf_dir):
    return rounded(S.network_metrics(view(spark, sf_dir, "member")))


CLUSTER_TYPE = "case substr(cluster_id, length(cluster_id) - 1) when '48' then 'logistics' when '49' then 'logistics' when '54' then 'technology' when '51' then 'technology' when '62' then 'biosciences' when '32' then 'biosciences' else 'manufacturing' end"
FAVOR = """points as (select cluster_id, sum(revenue_estimate) * 1.85::double gdp, count(*) n, avg(patent_count * 10 + sbir_awards * 20) innovation, count(distinct county) * 10 synergy from member group by 1),
  favor as (select cluster_id, gdp, least(1.0::double, 0.5::double + case when gdp > 1e9 then 0.2::double when gdp > 5e8 then 0.1::double else 0 end + case when n > 30 then 0.1::double else 0 end + case when innovation > 70 then 0.1::double else 0 end + case when synergy > 80 then 0.05::double else 0 end) market_score from points)"""


def cluster_type():
    two = F.substring_index("cluster_id", ":", -1)
    return F.when(two.isin("48", "49"), "logistics").when(two.isin("54", "51"), "technology").when(two.isin("62", "32"), "biosciences").otherwise("manufacturing")


def favored(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(
        (F.sum("revenue_estimate") * 1.85).alias("gdp"), F.count(F.lit(1)).alias("n"), F.avg(F.col("patent_count") * 10 + F.col("sbir_awards") * 20).alias("innovation"), (F.count_distinct("county") * 10).alias("synergy")
    )
    return g.select("cluster_id", "gdp", C.favorability().alias("market_score"))


@query("J22_market_favorability", f"with {FAVOR} select cluster_id, round(market_score, 6) score from favor")
def favorability(spark, sf_dir):
    return rounded(favored(spark, sf_dir).select("cluster_id", F.col("market_score").alias("score")))


@query(
    "J23_award_score",
    """with g as (select cluster_id, count(award_id) awards, coalesce(sum(amount), 0) funding, count(*) filter (where phase = 'Phase II') second_phase, count(*) filter (where award_year >= 1997) recent from member left join award using (business_id) group by 1)
    select cluster_id, awards, round(funding, 2) funding, second_phase, recent, round(100 * (0.25::double * least(awards / 10, 1) + 0.35::double * least(funding / 5000000.0::double, 1) + 0.25::double * least(second_phase / 5, 1) + 0.15::double * coalesce(recent / nullif(awards, 0), 0)), 6) score from g""",
)
def award_score(spark, sf_dir):
    return rounded(C.award_score(view(spark, sf_dir, "member"), view(spark, sf_dir, "award"), "Phase II", 1997), funding=2)
