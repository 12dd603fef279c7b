"""Queries of strategic clusters: membership, multipliers, market, longevity, and the choice of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import learning as L
from regiolith.operators import strategy as S
from regiolith.plans.aggregates import rounded
from regiolith.plans.learning import wide
from regiolith.plans.registry import query
from regiolith.plans.views import view

KIND = "case when substr(naics_code, 1, 3) in ('484', '493') then 'logistics' when substr(naics_code, 1, 3) in ('541', '511') then 'technology' when substr(naics_code, 1, 3) in ('325', '621') then 'biosciences' else 'manufacturing' end"
CENTRAL = ["CANADA", "UNITED STATES", "FRANCE"]


def values(table: str, columns: str, rows) -> str:
    """A table of constants as SQL, for the oracles."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return f"{table}({columns}) as (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


@query(
    "A13_detect_columns",
    "select c_custkey id, c_mktsegment code, coalesce(c_acctbal, 0) revenue, 1 employees, 2000 \"year\" from customer",
)
def detect_columns(spark, sf_dir):
    raw = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("NAICS_2022"), F.col("c_acctbal").alias("Annual Sales"))
    patterns = {"code": "naics|sic|industry", "employees": "emp|staff|size", "revenue": "revenue|sales", "year": "year|established|founded"}
    return S.detect_columns(raw, patterns, {"employees": 1, "revenue": 0.0, "year": 2000})


ASSETS = ["rail_capacity", "highway_access", "warehouse_space", "university_research", "lab_space", "broadband_speed", "tech_workforce", "skilled_manufacturing", "industrial_power"]
ASSET_SQL = "asset as (select n_name county, (['" + "','".join(ASSETS) + "'])[cast(s_suppkey % 9 + 1 as int)] asset, sum(s_acctbal) amount from supplier join nation on s_nationkey = n_nationkey group by 1, 2)"
REGION_SQL = "labour as (select county, sum(employees) * 50 workforce_availability, count(*) filter (where length(naics_code) >= 4) / count(*) skilled_share, 85 + ascii(county) % 25 cost_index from business group by 1)"


def assets(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in ASSETS])
    s, n = view(spark, sf_dir, "supplier"), view(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("county"), F.get(names, (F.col("s_suppkey") % 9).cast("int")).alias("asset")).agg(F.sum("s_acctbal").alias("amount"))


@query(
    "J4_resource_fit",
    f"""with {ASSET_SQL}, {REGION_SQL}, {values("need", "code3, asset", [(c, a) for c, wanted in S.NEEDS.items() for a in wanted])},
    has as (select distinct county, asset from asset where amount > 0), counties as (select distinct county from asset),
    met as (select c.county, code3, avg(case when h.asset is null then 0.0::double else 1.0::double end) met from counties c cross join need left join has h on h.county = c.county and h.asset = need.asset group by 1, 2),
    j as (select b.*, substr(naics_code, 1, 3) c3, met, workforce_availability w, skilled_share k, cost_index x from business b left join met m on m.county = b.county and m.code3 = substr(naics_code, 1, 3) left join labour l on l.county = b.county)
    select business_id, round(least(100.0::double, case when c3 in (select code3 from need) then 40.0 * coalesce(met, 0) else 20.0 end
      + least(30.0::double, case when employees > 100 and w > 50000 then 30.0 when employees > 50 and w > 20000 then 25.0 when w > 10000 then 20.0 else 10.0 end * case when c3 in ('541', '511', '325') and k > 0.4 then 1.2::double else 1.0::double end)
      + case when x < 90 then 30 when x < 95 then 25 when x < 100 then 20 when x < 105 then 15 else 10 end), 6) resource_fit from j""",
)
def resource_fit(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    regions = b.groupBy("county").agg(
        (F.sum("employees") * 50).alias("workforce_availability"), (F.count_if(F.length("naics_code") >= 4) / F.count(F.lit(1))).alias("skilled_share"),
        (85 + F.ascii(F.first("county")) % 25).alias("cost_index"),
    )
    return rounded(S.resource_fit(b, assets(spark, sf_dir), regions).select("business_id", "resource_fit"))


CRITICAL_MASS = f"""with {values("chain", "name, parts, code", [(n, len(cs), c) for n, cs in S.CHAINS.items() for c in cs])},
    cells as (select county, substr(naics_code, 1, 3) code, count(*) k from business group by 1, 2), cc as (select distinct cluster_id, county from member), ck as (select distinct cluster_id, substr(naics_code, 1, 3) code from member),
    p as (select cc.cluster_id, sum(k) potential from cc join cells on cells.county = cc.county join ck on ck.cluster_id = cc.cluster_id and ck.code = cells.code group by 1),
    h as (select cluster_id, name, parts, count(*) k from ck join chain on chain.code = ck.code group by 1, 2, 3 having count(*) >= 2), s as (select cluster_id, least(25.0::double, sum(k / parts * 10)) chains from h group by 1),
    g as (select cluster_id, count(*) n, count(*) filter (where employees < 50) small, count(*) filter (where employees between 50 and 499) medium, count(*) filter (where employees >= 500) large, count(distinct county) counties from member group by 1)
    select cluster_id, round(least(100.0::double, least(30.0::double, 30.0::double * n / greatest(coalesce(potential, 1), 1)) + coalesce(chains, 0) + least(small / n, 0.6::double) / 0.6::double * 10 + least(medium / n, 0.3::double) / 0.3::double * 10
      + least(large / n, 0.1::double) / 0.1::double * 5 + case when counties <= 2 then 20 when counties <= 4 then 15 when counties <= 6 then 10 else 5 end), 6) critical_mass
    from g left join p using (cluster_id) left join s using (cluster_id)"""


@query("J14_critical_mass", CRITICAL_MASS)
def critical_mass(spark, sf_dir):
    return rounded(S.critical_mass(view(spark, sf_dir, "member"), view(spark, sf_dir, "business")))


def typed_members(spark, sf_dir):
    """Members with their cluster's type, which its two-digit code gives."""
    two = F.substring("naics_code", 1, 2)
    kind = F.when(two.isin("48", "49"), "logistics").when(two.isin("54", "51"), "technology").when(two.isin("62"), "biosciences").otherwise("manufacturing")
    return view(spark, sf_dir, "member").withColumn("type", kind)


TYPED = "typed as (select *, case when substr(naics_code, 1, 2) in ('48', '49') then 'logistics' when substr(naics_code, 1, 2) in ('54', '51') then 'technology' when substr(naics_code, 1, 2) = '62' then 'biosciences' else 'manufacturing' end type from member)"


@query(
    "J8_cluster_scores",
    f"""with {TYPED}, g as (select cluster_id, type, count(*) n, count(*) filter (where county in ('{"','".join(CENTRAL)}')) central, sum(employees) e, sum(patent_count * 10 + sbir_awards * 20) i, count(distinct substr(naics_code, 1, 3)) k from typed group by 1, 2),
    s as (select cluster_id, case type when 'logistics' then 90.0::double when 'biosciences' then 70.0::double else 75.0::double end natural_assets_score, least(100.0::double, 60 + central / n * 40) infrastructure_score,
      least(100.0::double, 50 + e / 100 * 5) workforce_score, least(100.0::double, i / 10) innovation_capacity_score, case when type in ('logistics', 'manufacturing') then 85.0::double else 75.0::double end market_access_score,
      80.0::double geopolitical_score, least(100.0::double, 50.0::double + k * 10) resilience_score from g)
    select cluster_id, round(natural_assets_score, 6) natural_assets_score, round(infrastructure_score, 6) infrastructure_score, round(workforce_score, 6) workforce_score, round(innovation_capacity_score, 6) innovation_capacity_score,
      round(market_access_score, 6) market_access_score, round(geopolitical_score, 6) geopolitical_score, round(resilience_score, 6) resilience_score,
      round({" + ".join(f"{w!r}::double * {k}" for k, w in S.CLUSTER_WEIGHTS.items())}, 6) total_score from s""",
)
def cluster_scores(spark, sf_dir):
    return rounded(S.component_scores(typed_members(spark, sf_dir), CENTRAL))


NEAR = "near_by as (select n_name county, concat('university ', cast(n_regionkey as varchar(9))) university from nation where n_nationkey % 3 <> 0)"
GRANTS = f"typed_business as (select *, {KIND} type from business), grants as (select concat('university ', cast(n_regionkey as varchar(9))) university, type, sum(revenue_estimate) / 20 funding, count(*) grants from typed_business join nation on n_name = county where sbir_awards > 0 group by 1, 2)"


def university(region):
    return F.concat(F.lit("university "), region.cast("string"))


def research_inputs(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    b = view(spark, sf_dir, "business").withColumn("type", S.cluster_type_of(F.col("naics_code")))
    near = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("county"), university(F.col("n_regionkey")).alias("university"))
    region = F.broadcast(n.select(F.col("n_name").alias("county"), university(F.col("n_regionkey")).alias("university")))
    grants = b.where("sbir_awards > 0").join(region, "county").groupBy("university", "type").agg((F.sum("revenue_estimate") / 20).alias("funding"), F.count(F.lit(1)).alias("grants"))
    return b, near, grants


RESEARCH = "(case when f > 10000000 then 1.25::double when f > 5000000 then 1.15::double when f > 1000000 then 1.05::double else 1.0::double end * case when g > 10 then 1.1::double else 1.0::double end)"
STRENGTH = "strength as (select county, type, sum(funding) f, sum(grants) g from near_by join grants using (university) group by 1, 2)"


@query("D18_research_multiplier", f"with {NEAR}, {GRANTS}, {STRENGTH} select business_id, round({RESEARCH}, 6) research_multiplier from typed_business b left join strength s on s.county = b.county and s.type = b.type")
def research_multiplier(spark, sf_dir):
    return rounded(S.research_multiplier(*research_inputs(spark, sf_dir)).select("business_id", "research_multiplier"))


REQUIRED = [("logistics", "rail_capacity", 1.5), ("logistics", "highway_access", 1.4), ("biosciences", "university_research", 1.3), ("biosciences", "lab_space", 1.2), ("technology", "broadband_speed", 1.25), ("manufacturing", "industrial_power", 1.15), ("manufacturing", "rail_capacity", 1.1)]
BONUS = [("CANADA", "logistics", 1.2), ("UNITED STATES", "logistics", 1.2), ("FRANCE", "biosciences", 1.15)]
PRODUCTS = f"{ASSET_SQL}, {values('required', 'type, asset, multiplier', REQUIRED)}, {values('bonus', 'county, type, bonus', BONUS)}, products as (select county, type, product(multiplier) p from (select distinct county, asset from asset) join required using (asset) group by 1, 2)"


def with_assets(spark, sf_dir, business):
    required, bonus = spark.createDataFrame(REQUIRED, "type string, asset string, multiplier double"), spark.createDataFrame(BONUS, "county string, type string, bonus double")
    return S.asset_multiplier(business, assets(spark, sf_dir), required, bonus)


@query("D19_asset_multiplier", f"with {PRODUCTS}, typed_business as (select *, {KIND} type from business) select business_id, round(coalesce(p, 1) * coalesce(bonus, 1), 6) asset_multiplier from typed_business b left join products p on p.county = b.county and p.type = b.type left join bonus o on o.county = b.county and o.type = b.type")
def asset_multiplier(spark, sf_dir):
    return rounded(with_assets(spark, sf_dir, research_inputs(spark, sf_dir)[0]).select("business_id", "asset_multiplier"))


TYPES = [("logistics", "484"), ("logistics", "493"), ("biosciences", "3254"), ("biosciences", "325"), ("biosciences", "621"), ("technology", "541"), ("technology", "511"), ("manufacturing", "33")]
QUOTAS = [("logistics", "484", 60), ("logistics", "493", 40), ("technology", "541", 50), ("manufacturing", "33", 80)]


@query(
    "I9_strategic_clusters",
    f"""with {NEAR}, {GRANTS}, {STRENGTH}, {PRODUCTS}, {values("kinds", "type, prefix", TYPES)}, {values("quotas", "type, prefix, quota", QUOTAS)},
    b as (select b.business_id, naics_code, round(ln(1 + revenue_estimate) * {RESEARCH} * coalesce(p, 1) * coalesce(bonus, 1), 6) score from typed_business b left join strength s on s.county = b.county and s.type = b.type
      left join products p on p.county = b.county and p.type = b.type left join bonus o on o.county = b.county and o.type = b.type),
    one as (select type, business_id, score, max(prefix) prefix from b join kinds on starts_with(naics_code, prefix) group by 1, 2, 3),
    elite as (select * from (select *, max(score) over (partition by type) best from one) where score >= best * 0.5),
    placed as (select *, row_number() over (partition by type, prefix order by score desc, business_id) i from elite),
    kept as (select placed.* from placed left join quotas using (type, prefix) where i <= coalesce(quota, 2147483647))
    select type, business_id, score from kept where type in (select type from kept group by 1 having count(*) >= 5)""",
)
def strategic_clusters(spark, sf_dir):
    b, near, grants = research_inputs(spark, sf_dir)
    scored = with_assets(spark, sf_dir, S.research_multiplier(b, near, grants)).drop("type")
    score = F.round(F.log1p("revenue_estimate") * F.col("research_multiplier") * F.col("asset_multiplier"), 6)
    types, quotas = spark.createDataFrame(TYPES, "type string, prefix string"), spark.createDataFrame(QUOTAS, "type string, prefix string, quota int")
    return S.strategic_clusters(scored, types, score, 0.5, quotas, 5)


RISK_ROWS = [
    (kind, category, weight, part, profile.get(part, 0.5) * (1.3 if part == "trade_policy_exposure" else 1.2 if part == "interest_rate_sensitivity" else 1.0))
    for kind, profile in [*S.PROFILES.items(), ("", {})] for category, (weight, parts) in S.RISKS.items() for part in parts
]
BANDS = lambda bands, other: "case " + " ".join(f"when score >= {a} then '{n}'" for a, n in bands) + f" else '{other}' end"


@query(
    "J10_longevity_risk",
    f"""with {TYPED}, {values("risks", "kind, category, weight, component, base", RISK_ROWS)}, g as (select cluster_id, type, count(*) n, count(distinct substr(naics_code, 1, 3)) codes from typed group by 1, 2),
    p as (select cluster_id, category, weight, component, least(1.0::double, least(1.0::double, base) * case when n > 100 then 0.9::double when n < 20 then 1.1::double else 1.0::double end * case when component in ('market_diversification', 'adaptability') and codes > 10 then 0.8::double else 1.0::double end) risk from g join risks on kind = type),
    c as (select cluster_id, category, weight, avg(risk) risk from p group by 1, 2, 3), t as (select cluster_id, component, row_number() over (partition by cluster_id order by round(risk, 6) desc, component) i from p),
    s as (select cluster_id, {", ".join(f"round(max(risk) filter (where category = '{c}'), 6) {c}_risk" for c in S.RISKS)}, round((1 - sum(risk * weight)) * 100, 1) score from c group by 1)
    select s.*, (select string_agg(component, ',' order by i) from t where t.cluster_id = s.cluster_id and i <= 3) top_risks, {BANDS(S.GRADES, "F")} grade, {BANDS(S.HORIZONS, "<1 year")} horizon from s""",
)
def longevity_risk(spark, sf_dir):
    return rounded(S.longevity_risk(cluster_sizes(spark, sf_dir), {"trade_tensions", "rising_rates"}))


def cluster_sizes(spark, sf_dir):
    return typed_members(spark, sf_dir).groupBy("cluster_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("naics_code", 1, 3)).alias("codes"), F.sum("revenue_estimate").alias("revenue"))


INDICATORS = "i as (select avg(p_size) / 10 gdp, avg(l_tax) * 100 unemployment, avg(p_size) / 8 diesel, avg(p_retailprice) / 10 tonnage, avg(l_quantity) * 4 health, avg(l_quantity) * 3.5 tech, avg(p_retailprice) / 14 production from lineitem join part on l_partkey = p_partkey)"


@query(
    "J19_market_score",
    f"""with {INDICATORS}, b as (select *, 0.5::double + case when gdp > 3 then 0.1::double when gdp < 1 then -0.1::double else 0 end + case when unemployment > 6 then -0.1::double when unemployment < 4 then 0.1::double else 0 end base from i)
    select 'logistics' type, round(least(1.0, greatest(0.0, base + case when diesel > 4 then -0.15::double when diesel < 3 then 0.15::double else 0 end + case when tonnage > 110 then 0.1::double else 0 end)), 6) market_score from b
    union all select 'biosciences', round(least(1.0, greatest(0.0, base + case when health > 100 then 0.15::double else 0 end)), 6) from b
    union all select 'technology', round(least(1.0, greatest(0.0, base + case when tech > 100 then 0.1::double else 0 end)), 6) from b
    union all select 'manufacturing', round(least(1.0, greatest(0.0, base + case when production > 105 then 0.15::double when production < 95 then -0.15::double else 0 end)), 6) from b""",
)
def market_score(spark, sf_dir):
    return rounded(S.market_score(spark, market_indicators(spark, sf_dir)))


def market_indicators(spark, sf_dir):
    j = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    made = {
        "gdp_growth": F.avg("p_size") / 10, "unemployment": F.avg("l_tax") * 100, "diesel": F.avg("p_size") / 8, "truck_tonnage": F.avg("p_retailprice") / 10,
        "healthcare_employment": F.avg("l_quantity") * 4, "tech_employment": F.avg("l_quantity") * 3.5, "manufacturing_production": F.avg("p_retailprice") / 14,
    }
    one = j.agg(*[v.cast("double").alias(k) for k, v in made.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(k).alias("value")) for k in made])).alias("x")).select("x.*")


@query("J19_scaled_growth", f"with {INDICATORS} select segment type, growth_rate, round(growth_rate * gdp / 2.5::double, 6) scaled from (select c_mktsegment segment, round(avg(c_acctbal) / 100000, 6) growth_rate from customer group by 1), i")
def scaled_growth(spark, sf_dir):
    """Segments of customers stand for types, their mean balances for growth rates."""
    rates = view(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("type")).agg(F.round(F.avg("c_acctbal") / 100000, 6).alias("growth_rate"))
    return rounded(S.scaled_growth(rates, market_indicators(spark, sf_dir)))


MARKET = [("logistics", 2.3e12, 0.045, 1200, 3, 2), ("biosciences", 6.8e11, 0.074, 1800, 3, 1), ("technology", 1.9e12, 0.065, 2600, 1, 1), ("manufacturing", 2.9e12, 0.02, 1400, 1, 2)]
MARKET_COLUMNS = "type, market_size, growth_rate, concentration, opportunities, threats"
FUNNEL = f"""{TYPED}, {values("market", MARKET_COLUMNS, MARKET)}, g as (select cluster_id, type, sum(revenue_estimate) revenue from typed group by 1, 2),
    funnel as (select cluster_id, market_size total_market, market_size * 0.02::double geographic_market, market_size * 0.02::double * 0.5 serviceable_market, market_size * 0.02::double * 0.5 * 0.3::double obtainable_market,
      revenue / (market_size * 0.02::double) * 100 current_share, market_size * 0.02::double * 0.05::double / revenue - 1 growth_required, growth_rate, concentration, opportunities, threats from g join market using (type)),
    market_scores as (select cluster_id, total_market, geographic_market, serviceable_market, obtainable_market, current_share, growth_required, least(100.0::double, least(growth_rate * 300, 30.0::double) + case when total_market > 1e12 then 20 when total_market > 1e11 then 15 when total_market > 1e10 then 10 else 5 end
      + case when obtainable_market > 1e9 then 20 when obtainable_market > 1e8 then 15 when obtainable_market > 1e7 then 10 else 5 end + case when concentration < 1500 then 15 when concentration < 2500 then 10 else 5 end
      + case when opportunities > 2 * threats then 15 when opportunities > threats then 10 else 5 end) market_score from funnel)"""


def opportunities(spark, sf_dir):
    market = spark.createDataFrame(MARKET, "type string, market_size double, growth_rate double, concentration int, opportunities int, threats int")
    return S.market_opportunity(cluster_sizes(spark, sf_dir), market)


@query(
    "J21_market_opportunity",
    f"""with {FUNNEL} select cluster_id, round(total_market, 2) total_market, round(geographic_market, 2) geographic_market, round(serviceable_market, 2) serviceable_market, round(obtainable_market, 2) obtainable_market,
    round(current_share, 6) current_share, round(growth_required, 6) growth_required, round(market_score, 6) market_score from market_scores""",
)
def market_opportunity(spark, sf_dir):
    return rounded(opportunities(spark, sf_dir), total_market=2, geographic_market=2, serviceable_market=2, obtainable_market=2)


@query(
    "J28_topic_reports",
    f"""with {FUNNEL}, t as (select 'innovation' topic, cluster_id, cast(sum(sbir_awards) as double) "value" from member group by 1, 2 union all select 'market', cluster_id, market_score from market_scores
      union all select 'patents', cluster_id, cast(sum(patent_count) as double) from member group by 1, 2 union all select 'size', cluster_id, cast(count(*) as double) from member group by 1, 2)
    select topic, cluster_id, round("value", 6) "value", round("value" / sum("value") over (partition by topic), 6) share, cast(row_number() over (partition by topic order by "value" desc, cluster_id) as int) place from t""",
)
def topic_reports(spark, sf_dir):
    m = view(spark, sf_dir, "member").groupBy("cluster_id")
    topics = {
        "innovation": m.agg(F.sum("sbir_awards").alias("value")), "market": opportunities(spark, sf_dir).select("cluster_id", F.col("market_score").alias("value")),
        "patents": m.agg(F.sum("patent_count").alias("value")), "size": m.agg(F.count(F.lit(1)).alias("value")),
    }
    return rounded(S.topic_reports(topics))


SAVED = """saved as (select cluster_id, business_id row_id, case when business_id % 25 = 8 then concat('nobody ', cast(business_id as varchar(20))) when business_id % 5 = 3 then concat(upper(name), '?') else upper(name) end name,
    case when business_id % 5 in (1, 3) then '' else county end county, case when business_id % 5 = 0 then state else 'elsewhere' end city, latitude,
    case when business_id % 5 = 4 or business_id % 10 = 3 or business_id % 25 = 8 then longitude + 9 else longitude end longitude, case when business_id % 5 = 2 then concat(naics_code, ':', cast(business_id as varchar(20))) end code_key from member)"""
RESOLVED = f"""{SAVED}, b as (select *, concat(naics_code, ':', cast(business_id as varchar(20))) code_key from business),
    k as (select code_key k, min(business_id) i from b group by 1), a3 as (select upper(name) n, county c, state s, min(business_id) i from b group by 1, 2, 3), a2 as (select upper(name) n, county c, min(business_id) i from b group by 1, 2),
    a1 as (select upper(name) n, min(business_id) i from b group by 1), g as (select round(latitude, 4) y, round(longitude, 4) x, min(business_id) i from b group by 1, 2),
    resolved as (select cluster_id, row_id, coalesce(k.i, a3.i, a2.i, a1.i, g.i, f.i) business_id, case when k.i is not null then 'key' when a3.i is not null then 'name_county_city' when a2.i is not null then 'name_county' when a1.i is not null then 'name'
      when g.i is not null then 'geo' when f.i is not null then 'fuzzy' end tier
    from saved s left join k on k.k = s.code_key left join a3 on a3.n = s.name and a3.c = s.county and a3.s = s.city left join a2 on a2.n = s.name and a2.c = s.county left join a1 on a1.n = s.name
    left join g on g.y = round(s.latitude, 4) and g.x = round(s.longitude, 4) left join a1 f on concat(f.n, '?') = s.name)"""


def resolved(spark, sf_dir):
    """Members as a saved cluster might hold them: by key, under other places, with a letter more, far off, or unknown."""
    i = F.col("row_id")
    n, unknown = i % 5, i % 25 == 8
    m = view(spark, sf_dir, "member").withColumnRenamed("business_id", "row_id")
    key = F.concat_ws(":", "naics_code", i.cast("string"))
    rows = m.select(
        "cluster_id", "row_id", F.when(unknown, F.concat(F.lit("nobody "), i.cast("string"))).when(n == 3, F.concat(F.upper("name"), F.lit("?"))).otherwise(F.upper("name")).alias("name"),
        F.when(n.isin(1, 3), "").otherwise(F.col("county")).alias("county"), F.when(n == 0, F.col("state")).otherwise("elsewhere").alias("city"), "latitude",
        F.when((n == 4) | (i % 10 == 3) | unknown, F.col("longitude") + 9).otherwise(F.col("longitude")).alias("longitude"), F.when(n == 2, key).alias("code_key"),
    )
    b = view(spark, sf_dir, "business").select(
        "business_id", F.upper("name").alias("name"), "county", F.col("state").alias("city"), "latitude", "longitude", F.concat_ws(":", "naics_code", F.col("business_id").cast("string")).alias("code_key")
    )
    name, county, city = F.col("name"), F.col("county"), F.col("city")
    tiers = [("key", [F.col("code_key")]), ("name_county_city", [name, county, city]), ("name_county", [name, county]), ("name", [name]), ("geo", [F.round("latitude", 4), F.round("longitude", 4)])]
    return S.resolve_by_name(S.resolve_membership(rows, b, tiers), b)


@query("D14_resolve_membership", f"with {RESOLVED} select * from resolved")
def resolve_membership(spark, sf_dir):
    """The last tier takes names alike by matching blocks; a name with one letter more is nearest to itself (0.97), other names of its length reach 0.919."""
    return resolved(spark, sf_dir).select("cluster_id", "row_id", "business_id", "tier")


@query(
    "D14_membership_report",
    f"with {RESOLVED} select cluster_id, count(*) members, count(business_id) matched, count(*) filter (tier = 'fuzzy') fuzzy, count(*) filter (business_id is null) unmatched from resolved group by 1",
)
def membership_report(spark, sf_dir):
    return S.membership_report(resolved(spark, sf_dir))


@query(
    "G6_correct_coordinates",
    """with p as (select business_id id, case when business_id % 4 = 0 then 95.0::double + business_id else latitude end y, longitude x, case business_id % 3 when 0 then 'west' when 1 then 'east' else 'none' end ring from business),
    r(ring, s, w, n, e) as (values ('west', 38.3::double, -95.1::double, 39.2::double, -94.7::double), ('east', 38.3::double, -94.7::double, 39.2::double, -94.2::double)),
    j as (select p.*, s, w, n, e, case when s is null then null when not (y between -90 and 90) then 'centre' when not (y > s and y < n and x > w and x < e) then 'edge' end moved from p left join r using (ring))
    select id, round(case moved when 'centre' then (s + n) / 2 when 'edge' then least(n, greatest(s, y)) else y end, 6) latitude, round(case moved when 'centre' then (w + e) / 2 when 'edge' then least(e, greatest(w, x)) else x end, 6) longitude, moved from j""",
)
def correct_coordinates(spark, sf_dir):
    rows = []
    for name, (s, w, n, e) in {"west": (38.3, -95.1, 39.2, -94.7), "east": (38.3, -94.7, 39.2, -94.2)}.items():
        corners = [(s, w), (s, e), (n, e), (n, w), (s, w)]
        rows.append((name, [(*a, *b) for a, b in zip(corners, corners[1:])]))
    rings = spark.createDataFrame(rows, "ring string, edges array<struct<lat1: double, lon1: double, lat2: double, lon2: double>>")
    i = F.col("business_id")
    p = view(spark, sf_dir, "business").select(
        i.alias("id"), F.when(i % 4 == 0, 95.0 + i).otherwise(F.col("latitude")).alias("latitude"), "longitude", F.when(i % 3 == 0, "west").when(i % 3 == 1, "east").otherwise("none").alias("ring")
    )
    return rounded(S.correct_coordinates(p, rings))


def cluster_vectors(spark, sf_dir):
    total = assets(spark, sf_dir).groupBy("county").agg(F.sum("amount").alias("infrastructure"), F.count(F.lit(1)).cast("double").alias("kinds"), F.max("amount").alias("largest"))
    return S.clustering_features(view(spark, sf_dir, "business"), total)


@query("I5_clustering_features")
def clustering_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    return cluster_vectors(spark, sf_dir).select("business_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@query("I6_choose_k")
def choose_k(spark, sf_dir):
    return rounded(S.choose_k(cluster_vectors(spark, sf_dir), view(spark, sf_dir, "business").select("business_id", "employees", "revenue_estimate"), 2, 6))


@query("L5_importance_share")
def importance_share(spark, sf_dir):
    """Importances of the features of the outcome model, without those of scale, as shares of the rest."""
    model, _ = L.train(wide(spark, sf_dir), "target", "cluster_id")
    return rounded(L.debiased(L.importances(model, spark), ["employees", "revenue"]))
