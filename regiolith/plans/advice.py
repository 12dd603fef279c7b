"""Queries for recommendations, findings and market conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import advice as A
from regiolith.plans.aggregates import rounded
from regiolith.plans.portfolio import SIX, six_objectives
from regiolith.plans.registry import query
from regiolith.plans.scores import CLUSTER_TYPE, cluster_type
from regiolith.plans.strategy import values
from regiolith.plans.views import view

METRICS = ["gdp", "innovation", "jobs", "synergy", "risk", "critical_mass", "patents", "awards", "counties", "small_share", "annual_return"]
RANKED = ["gdp", "jobs", "revenue", "patents"]


def cluster_facts(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    g = m.groupBy("cluster_id").agg(
        F.sum("patent_count").alias("patents"), F.sum("sbir_awards").alias("awards"), F.count_distinct("county").alias("counties"), F.round(F.sum("revenue_estimate"), 2).alias("revenue"),
        F.round(F.count_if(F.col("employees") < 50) / F.count(F.lit(1)), 6).alias("small_share"),
    )
    j = six_objectives(spark, sf_dir).join(g, "cluster_id").withColumn("type", cluster_type())
    j = j.withColumn("annual_return", F.round(F.try_divide(F.col("gdp") / 5, F.col("revenue") * 0.2) * 100, 4))
    return A.facts(j, METRICS, RANKED)


def sql_value(v):
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


def table_sql(name, columns, rows):
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + ")"


FACTS = f"""{SIX}, agg as (select cluster_id, sum(patent_count) patents, sum(sbir_awards) awards, count(distinct county) counties, round(sum(revenue_estimate), 2) revenue, round(count(*) filter (employees < 50) / count(*), 6) small_share from member group by 1),
    whole as (select *, round(gdp / 5 / nullif(revenue * 0.2::double, 0) * 100, 4) annual_return, {CLUSTER_TYPE} "type", row_number() over (order by gdp desc, cluster_id) gdp_rank, row_number() over (order by jobs desc, cluster_id) jobs_rank,
      row_number() over (order by revenue desc, cluster_id) revenue_rank, row_number() over (order by patents desc, cluster_id) patents_rank from six join agg using (cluster_id)),
    facts as ({" union all ".join(f"select cluster_id, type, '{c}' metric, {c}::double val from whole" for c in [*METRICS, *(f"{c}_rank" for c in RANKED)])})"""
MET = "case sign when '>=' then val >= bound when '>' then val > bound when '<=' then val <= bound when '<' then val < bound end"


@query(
    "J27_recommendations",
    f"""with {FACTS}, {table_sql("rules", "audience, priority, rule_type, metric, sign, bound, words", A.RULES)}
    select cluster_id, audience, cast(priority as int) priority, words recommendation, facts.metric, round(val, 6) "value" from facts join rules on rules.metric = facts.metric and (rule_type is null or rule_type = type) where {MET}""",
)
def recommendations(spark, sf_dir):
    return rounded(A.recommendations(cluster_facts(spark, sf_dir), spark.createDataFrame(A.RULES, A.RULE)))


@query(
    "J28_key_findings",
    f"""with {FACTS}, {table_sql("found", "kind, metric, sign, bound, unit, finding", A.FINDINGS)},
    rated as (select cluster_id, kind, finding, abs(val - bound::double) * unit::double strength from facts join found on found.metric = facts.metric where {MET}),
    placed as (select *, row_number() over (partition by cluster_id, kind order by strength desc, finding) place from rated)
    select cluster_id, kind, cast(place as int) place, finding, round(strength, 6) strength from placed where place <= case kind when 'opportunity' then 2 else 1 end""",
)
def key_findings(spark, sf_dir):
    return rounded(A.key_findings(cluster_facts(spark, sf_dir)))


@query(
    "J28_emerging_classes",
    """with p as (select p_brand cpc1, cast(extract(year from l_shipdate) as int) y from lineitem join part on l_partkey = p_partkey),
    c as (select cpc1, count(*) filter (y in (1999, 2000)) recent, count(*) filter (y in (1997, 1998)) earlier from p group by 1),
    g as (select *, (recent + 5) / (earlier + 5) growth from c where recent + earlier > 0), r as (select *, row_number() over (order by growth desc, recent desc, cpc1) place from g)
    select cpc1, recent, earlier, round(growth, 6) growth, cast(place as int) place from r where place <= 10""",
)
def emerging_classes(spark, sf_dir):
    """Brands stand for classes of patents, of which there are more than types."""
    p = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(A.emerging_classes(p.select(F.col("p_brand").alias("cpc1"), F.year("l_shipdate").alias("grant_year")), 2000))


DATES = ["2024-01-03", "2024-01-11", "2024-01-20", "2024-02-01"]
TYPES = [("logistics", 71.0, 22.5), ("technology", 80.0, 31.0), ("biosciences", 64.0, 18.0), ("manufacturing", 55.0, 27.0), ("mixed", 50.0, 25.0)]


@query(
    "J29_market_context",
    f"""with {table_sql("d", "as_of", [(d,) for d in DATES])}, {table_sql("t", "type, market_score, risk", TYPES)}, {table_sql("w", "type, indicator, part", A.DEPENDS)},
    r as (select event_type indicator, ts, event_id, value val from events where value is not null), i as (select distinct indicator from r),
    v as (select indicator, as_of, (select max_by(val, struct_pack(a := ts, b := event_id)) from r where r.indicator = i.indicator and r.ts <= cast(as_of as timestamp)) val from i, d),
    m as (select *, lag(val) over (partition by indicator order by as_of) earlier from v),
    k as (select type, as_of, sum(val * part::double) / sum(case when val is not null then part::double end) pressure, count(*) filter ((val - earlier) / abs(earlier) > 0.05) rising, count(*) filter ((val - earlier) / abs(earlier) < -0.05) falling
      from m join w using (indicator) group by 1, 2)
    select t.type, d.as_of, market_score::double market_score, risk::double risk, round(pressure, 6) pressure, coalesce(rising, 0) rising, coalesce(falling, 0) falling, coalesce(pressure > 50, false) volatile,
      case when rising > falling then 'rising' when rising < falling then 'falling' else 'stable' end trend, true election_year, round(market_score::double - risk::double - case when pressure > 50 then 10 else 0 end, 6) outlook
    from t cross join d left join k on k.type = t.type and k.as_of = d.as_of""",
)
def market_context(spark, sf_dir):
    readings = view(spark, sf_dir, "events").select(F.col("event_type").alias("indicator"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    return rounded(A.market_context(readings, DATES, spark.createDataFrame(TYPES, "type string, market_score double, risk double")))
