"""Queries for projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import projections as P
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.text import INDUSTRY
from regiolith.plans.views import view

IMPACT = """counts as (select cluster_id, substr(naics_code, 1, 4) code, count(*) n from member group by 1, 2),
top as (select *, row_number() over (partition by cluster_id order by n desc, code) i from counts),
best as (select cluster_id, max(case when code like '3254%' then 1.25::double when code like '54%' then 1.2::double when code like '484%' or code like '493%' or code like '52%' then 1.15::double else 1.0::double end) strategic from top where i <= 5 group by 1),
base as (select cluster_id, count(*) businesses, sum(revenue_estimate) revenue, sum(employees) employees from member group by 1),
jobs as (select *, employees * (pow(1 + 0.06::double * 0.8::double, 5) - 1) fresh, revenue * pow(1.06::double, 5) * 1.85::double * strategic gdp from base join best using (cluster_id)),
impact as (select *, cast(round_even((employees + fresh * 2.2::double) * strategic, 0) as bigint) total_jobs, cast(round_even((employees + fresh) * strategic, 0) as bigint) direct_jobs from jobs)"""


@query(
    "K1_economic_impact",
    f"""with {IMPACT} select cluster_id, businesses, round(revenue, 2) revenue, cast(employees as bigint) employees, strategic, round(gdp, 1) gdp_impact, total_jobs, direct_jobs, greatest(0, total_jobs - direct_jobs) indirect_jobs,
    round(gdp * (1 - 0.15::double), 1) gdp_lower, round(gdp * (1 + 0.15::double), 1) gdp_upper from impact""",
)
def economic_impact(spark, sf_dir):
    return rounded(P.economic_impact(view(spark, sf_dir, "member")), revenue=2, gdp_impact=1, gdp_lower=1, gdp_upper=1)


def lookup(table, size):
    return "case " + " ".join(f"when industry = '{n}' then case {size} when 'small' then {v[0]}::double when 'medium' then {v[1]}::double else {v[2]}::double end" for n, v in table.items()) + " end"


PROJECTED = f"""b as (select business_id, revenue_estimate now, employees, {INDUSTRY} industry, case when employees < 50 then 'small' when employees < 500 then 'medium' else 'large' end size,
  greatest(0, 2024 - year_established) age, 40.0::double + business_id % 50 q from business),
r as (select *, case industry when 'logistics' then 0.067::double when 'technology' then 0.085::double when 'biosciences' then 0.072::double else 0.038::double end * {lookup(P.SIZE_FACTORS, 'size')}
  * case industry when 'technology' then case when age < 3 then 1.5::double when age < 7 then 1.2::double when age < 15 then 1.0::double else 0.8::double end when 'logistics' then case when age < 3 then 0.8::double when age < 10 then 1.3::double else 0.9::double end
    when 'biosciences' then case when age < 5 then 0.5::double when age < 12 then 1.5::double else 1.0::double end else 1.0::double end
  * case when q >= 80 then 1.3::double when q >= 65 then 1.15::double when q >= 50 then 1.0::double when q >= 35 then 0.85::double else 0.7::double end rate, {lookup(P.REVENUE_EACH, 'size')} each_one from b),
l as (select *, unnest(range(1, 6)) k from r),
projected as (select business_id, 2024 + k y, industry, employees, each_one, case industry when 'technology' then now * pow(1 + rate, k) when 'logistics' then now * 10 / (1 + exp(-rate * 2.0::double * (age + k - 10)))
  when 'biosciences' then now * 20 / (1 + exp(-rate * 1.5::double * (age + k - 15))) else now * (1 + rate * k) end revenue from l)"""


def projected(spark, sf_dir):
    b = view(spark, sf_dir, "business").withColumn("composite_score", F.lit(40.0) + F.col("business_id") % 50)
    return P.business_projection(b, 5, AS_OF)


@query(
    "K2_business_projection",
    f"""with {PROJECTED} select business_id, cast(y as int) "year", industry, round(revenue, 2) revenue, cast(floor(employees * 0.7::double + floor(revenue / each_one) * 0.3::double) as bigint) employees,
    round(revenue * (1 - 1.96::double * 0.15::double), 2) lower, round(revenue * (1 + 1.96::double * 0.15::double), 2) upper from projected""",
)
def business_projection(spark, sf_dir):
    return rounded(projected(spark, sf_dir), 2)


@query(
    "K3_cluster_projection",
    f"""with {PROJECTED}, t as (select cluster_id, y, sum(revenue) revenue from projected join (select business_id, cluster_id from member) m using (business_id) group by 1, 2)
    select cluster_id, cast(y as int) "year", round(revenue, 1) revenue, round(revenue / lag(revenue) over (partition by cluster_id order by y) - 1, 6) growth from t""",
)
def cluster_projection(spark, sf_dir):
    return rounded(P.cluster_projection(projected(spark, sf_dir), view(spark, sf_dir, "member")).drop("employees"), revenue=1)


CURVES = ["exponential", "sigmoid", "delayed_sigmoid", "linear"]


def curve_at(k):
    return f"""(case business_id % 4 when 0 then v * pow(1 + r, {k}) when 1 then v * 10 / (1 + exp(-r * 2.0::double * (age + {k} - 10)))
      when 2 then v * 20 / (1 + exp(-r * 1.5::double * (age + {k} - 15))) else v * (1 + r * {k}) end)"""


@query(
    "F12_growth_path",
    f"""with b as (select business_id, revenue_estimate v, (1 + business_id % 5) / 97.0::double r, 2024 - year_established age, unnest(range(1, 6)) k from business),
    p as (select business_id id, 2024 + k y, {curve_at("k")} x, case when k = 1 then v else {curve_at("(k - 1)")} end x0 from b)
    select id, cast(y as int) "year", round(x, 2) "value", round(x / nullif(x0, 0) - 1, 6) growth, round(x * (1 - 1.96::double * 0.15::double), 2) lower, round(x * (1 + 1.96::double * 0.15::double), 2) upper from p""",
)
def growth_path(spark, sf_dir):
    key = F.col("business_id")
    b = view(spark, sf_dir, "business").select(
        key.alias("id"), F.col("revenue_estimate").alias("value"), ((1 + key % 5) / 97.0).alias("rate"), (AS_OF - F.col("year_established")).alias("age"),
        F.get(F.array(*[F.lit(c) for c in CURVES]), (key % 4).cast("int")).alias("curve"),
    )
    return rounded(P.yearly_growth_path(b, 5, AS_OF), 2, growth=6)


@query("K5_forecast_demand", "select program, cast(k as int) k, round(actual * pow(1.04::double, k), 1) demand from outcome, (select unnest(range(0, 4)) k)")
def forecast_demand(spark, sf_dir):
    o = view(spark, sf_dir, "outcome").withColumn("growth", F.lit(0.04))
    return rounded(P.demand_path(o, "actual", "growth", 3).select("program", "k", "demand"), 1)


@query(
    "K7_backtest",
    """with r as (select avg(actual / projected) rate from outcome where actual <> 0 and projected <> 0)
    select round(max(rate), 6) rate, round(avg(100 * abs(actual - projected) / abs(actual)), 6) before, round(avg(100 * abs(actual - projected * rate) / abs(actual)), 6) "after" from outcome, r where actual <> 0 and projected <> 0""",
)
def backtest(spark, sf_dir):
    return rounded(P.backtest(view(spark, sf_dir, "outcome")))


@query(
    "K8_what_if",
    """with g as (select cluster_id, sum(revenue_estimate) revenue, sum(employees) employees from member group by 1), s(setting, m, k, f) as (values ('calibrated', 1.85::double, 2.2::double, 0.8::double), ('no_friction', 1.85::double, 2.2::double, 1.0::double), ('uncalibrated', 1.0::double, 1.0::double, 1.0::double)),
    a as (select setting, avg(revenue * m * f) gdp, avg(round_even(employees * k * f, 0)) jobs from g, s group by 1), u as (select gdp g0, jobs j0 from a where setting = 'uncalibrated')
    select setting, round(gdp, 1) gdp, round(jobs, 4) jobs, round(case when g0 > 0 then (gdp - g0) / g0 * 100 else 0 end, 6) gdp_delta, round(case when j0 > 0 then (jobs - j0) / j0 * 100 else 0 end, 6) jobs_delta from a, u""",
)
def what_if(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.sum("revenue_estimate").alias("revenue"), F.sum("employees").alias("employees"))
    return rounded(P.what_if(g, P.SETTINGS, "uncalibrated"), gdp=1, jobs=4)


@query("K9_heuristic_outcomes", "select cluster_id, round(sum(revenue_estimate) * 1.85::double, 2) gdp, cast(floor(sum(employees) * 1.2::double) as bigint) jobs, round(1 + least(0.5, count(*) / 100.0::double), 6) roi from member group by 1")
def heuristic_outcomes(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.sum("revenue_estimate").alias("r"), F.sum("employees").alias("e"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("cluster_id", (F.col("r") * P.GDP_MULTIPLIER).alias("gdp"), F.floor(F.col("e") * 1.2).alias("jobs"), (1 + F.least(F.lit(0.5), F.col("n") / 100.0)).alias("roi")), gdp=2)


@query(
    "E22_unique_impact",
    "with u as (select distinct name, revenue_estimate, employees from member) select count(*) businesses, round(sum(revenue_estimate) * 1.85::double, 1) impact, cast(sum(employees) as bigint) jobs from u",
)
def unique_impact(spark, sf_dir):
    m = view(spark, sf_dir, "member").dropDuplicates(["name"])
    return m.agg(F.count(F.lit(1)).alias("businesses"), F.round(F.sum("revenue_estimate") * P.GDP_MULTIPLIER, 1).alias("impact"), F.sum("employees").alias("jobs"))


@query(
    "E23_total_impact",
    f"with {IMPACT} select count(*) clusters, round(sum(gdp), 0) gdp, cast(sum(total_jobs) as bigint) jobs, round(pow(sum(gdp) / sum(revenue), 0.2::double) - 1, 6) cagr, sum(gdp) >= 1000000000 reached from impact",
)
def total_impact(spark, sf_dir):
    i = P.economic_impact(view(spark, sf_dir, "member"))
    return i.agg(
        F.count(F.lit(1)).alias("clusters"), F.round(F.sum("gdp_impact"), 0).alias("gdp"), F.sum("total_jobs").alias("jobs"),
        F.round(F.pow(F.sum("gdp_impact") / F.sum("revenue"), F.lit(0.2)) - 1, 6).alias("cagr"), (F.sum("gdp_impact") >= 1e9).alias("reached"),
    )


WAGE = "coalesce(case substr(naics_code, 1, 4) when '5415' then 95000 when '3254' then 85000 end, case substr(naics_code, 1, 3) when '484' then 52000 when '493' then 45000 when '332' then 55000 end, 50000)"


@query("E24_wage_impact", f"select cluster_id, round(sum(employees * {WAGE} * 1.1::double), 2) wages from member group by 1")
def wage_impact(spark, sf_dir):
    from regiolith.operators.enrich import constant_table, prefix_lookup

    table = constant_table(spark, {"5415": 95_000, "3254": 85_000, "484": 52_000, "493": 45_000, "332": 55_000})
    m = prefix_lookup(view(spark, sf_dir, "member"), "naics_code", table, 50_000.0, "wage")
    return rounded(m.groupBy("cluster_id").agg(F.sum(F.col("employees") * F.col("wage") * 1.1).alias("wages")), 2)
