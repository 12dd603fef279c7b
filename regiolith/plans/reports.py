"""Queries for lookups, derived indices and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import reports as R
from regiolith.operators import scorecards as C
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.scores import FAVOR, favored
from regiolith.plans.strategy import values
from regiolith.plans.views import view
from regiolith.streaming.runs import shared_folder

TYPE = "case substr(naics_code, 1, 3) when '484' then 'logistics' when '493' then 'logistics' when '541' then 'technology' when '511' then 'technology' when '325' then 'biosciences' when '621' then 'biosciences' when '311' then 'food' when '112' then 'animal_health' else 'manufacturing' end"


@query("A2_read_prepared", "select business_id, revenue_estimate, latitude, cast(2024 - year_established as int) years_in_business from business")
def read_prepared(spark, sf_dir):
    path = shared_folder(spark, "prepared")
    b = view(spark, sf_dir, "business")
    b.select("business_id", F.col("revenue_estimate").alias("revenue"), F.col("latitude").alias("lat"), "year_established").write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path).withColumnsRenamed({"revenue": "revenue_estimate", "lat": "latitude"})
    year = F.col("year_established").try_cast("int")
    return raw.select(F.col("business_id").try_cast("long").alias("business_id"), F.col("revenue_estimate").try_cast("double").alias("revenue_estimate"), F.col("latitude").try_cast("double").alias("latitude"), (F.lit(AS_OF) - year).alias("years_in_business"))


@query("A9_read_awards", "select award_id, company, round(amount, 2) amount, award_year from award")
def read_awards(spark, sf_dir):
    path = shared_folder(spark, "awards")
    a = view(spark, sf_dir, "award").select("award_id", "company", F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount"), F.format_string("%d-05-01", "award_year").alias("date"))
    half = F.col("award_id") % 2 == 0
    a.where(half).select(F.array(F.struct("award_id", "company", "amount", "date")).alias("results")).write.json(path)
    a.where(~half).write.mode("append").json(path)
    item = "award_id: long, company: string, amount: string, date: string"
    raw = spark.read.schema(f"results array<struct<{item}>>, award_id long, company string, amount string, date string").json(path)
    rows = raw.select(F.explode(F.coalesce("results", F.array(F.struct("award_id", "company", "amount", "date")))).alias("r")).select("r.*")
    from regiolith.functions import text as T

    return rows.select("award_id", "company", T.parse_amount(F.col("amount")).alias("amount"), T.parse_year(F.col("date"), AS_OF).alias("award_year"))


@query("A10_read_grants", "select award_id, company from award where award_year >= 1999 and (company like '%01' or company like '%7')")
def read_grants(spark, sf_dir):
    path = shared_folder(spark, "grants")
    view(spark, sf_dir, "award").select("award_id", "company", F.format_string("01/02/%d", "award_year").alias("start")).write.json(path)
    rows = spark.read.schema("award_id long, company string, start string").json(path)
    return rows.where(F.col("company").rlike("01$|7$") & (F.regexp_extract("start", r"(\d{4})$", 1).try_cast("int") >= 1999)).select("award_id", "company")


@query("A11_read_patents", "select patent_id, assignee, 2 codes, substr(title, 1, 12) abstract from patent where citations > 40")
def read_patents(spark, sf_dir):
    path = shared_folder(spark, "patents")
    p = view(spark, sf_dir, "patent").where("citations > 40")
    p.select("patent_id", F.array(F.struct(F.col("assignee").alias("organization"))).alias("assignees"), F.array("cpc1", "cpc2").alias("cpc_codes"), F.col("title").alias("abstract")).write.json(path)
    raw = spark.read.schema("patent_id long, assignees array<struct<organization: string>>, cpc_codes array<string>, abstract string").json(path)
    return raw.select("patent_id", F.get("assignees", F.lit(0))["organization"].alias("assignee"), F.size(F.slice("cpc_codes", 1, 10)).alias("codes"), F.left("abstract", F.lit(12)).alias("abstract"))


@query("A14_type_lookup", f"select business_id, {TYPE} type from business")
def type_lookup(spark, sf_dir):
    b = view(spark, sf_dir, "business").withColumn("code", F.substring("naics_code", 1, 3))
    return b.join(F.broadcast(R.type_lookup(spark)), "code", "left").select("business_id", F.coalesce("type", F.lit("manufacturing")).alias("type"))


@query("A20_scenarios", "select n_nationkey id, n_name scenario from nation where n_regionkey = 1 order by n_nationkey desc limit 3")
def scenarios(spark, sf_dir):
    path = shared_folder(spark, "scenarios")
    n = view(spark, sf_dir, "nation").where("n_regionkey = 1")
    n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("scenario")).write.parquet(path)
    return spark.read.parquet(path).orderBy(F.desc("id")).limit(3)


@query(
    "B6_county_name",
    r"""with c as (select business_id, case business_id % 3 when 0 then concat(lower(county), ' county, ks') when 1 then concat('  ', county, '  ') else '' end raw, substr(state, 1, 2) st from business)
    select business_id, case business_id % 3 when 0 then concat(upper(substr(raw, 1, 1)), lower(substr(regexp_replace(raw, ' county, ks$', ''), 2)), ' County, KS')
      when 1 then concat(upper(substr(trim(raw), 1, 1)), lower(substr(trim(raw), 2)), ' County, ', upper(st)) end county_name from c""",
)
def county_name(spark, sf_dir):
    k = F.col("business_id") % 3
    raw = F.when(k == 0, F.concat(F.lower("county"), F.lit(" county, ks"))).when(k == 1, F.concat(F.lit("  "), "county", F.lit("  "))).otherwise("")
    b = view(spark, sf_dir, "business").select("business_id", raw.alias("raw"), F.substring("state", 1, 2).alias("st"))
    return b.select("business_id", R.county_name(F.col("raw"), F.col("st")).alias("county_name"))


@query("B19_estimated_revenue", "select business_id, employees * case when naics_code like '5415%' then 200000.0::double when naics_code like '3254%' then 400000.0::double when naics_code like '484%' then 180000.0::double else 150000.0::double end * case when employees < 10 then 0.8::double when employees > 250 then 1.2::double else 1.0::double end revenue from business")
def estimated_revenue(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", R.estimated_revenue(F.col("employees"), F.col("naics_code")).alias("revenue"))


PLACE = "p as (select business_id, cast(employees % 101 as double) safety, cast(business_id % 97 as double) infrastructure, cast(business_id % 89 as double) access, cast(employees % 83 as double) development, cast(business_id % 71 as double) demographics from business)"
INDICES = """i as (select *, 0.4::double * safety + 0.3::double * infrastructure + 0.3::double * access location_quality, 0.5::double * development + 0.5::double * demographics growth_potential,
  0.25::double * safety + 0.25::double * development + 0.25::double * demographics + 0.25::double * infrastructure environment from p)"""


def places(spark, sf_dir):
    e, i = F.col("employees"), F.col("business_id")
    return view(spark, sf_dir, "business").select("business_id", *[x.cast("double").alias(n) for n, x in (("safety", e % 101), ("infrastructure", i % 97), ("access", i % 89), ("development", e % 83), ("demographics", i % 71))])


@query(
    "B20_location_indices",
    f"with {PLACE}, {INDICES} select business_id, round(location_quality, 6) location_quality, round(growth_potential, 6) growth_potential, round(environment, 6) environment, round(growth_potential * (safety / 100), 6) adjusted_opportunity, round(0.3::double * infrastructure + 0.3::double * access + 0.2::double * demographics + 0.2::double * environment, 6) readiness from i",
)
def location_indices(spark, sf_dir):
    out = R.location_indices(places(spark, sf_dir))
    return rounded(out.select("business_id", "location_quality", "growth_potential", "environment", "adjusted_opportunity", "readiness"))


@query(
    "B21_ml_columns",
    f"""with {PLACE}, {INDICES}, t as (select *, case when environment > 0 and environment <= 60 then 'low' when environment > 60 and environment <= 75 then 'medium' when environment > 75 and environment <= 90 then 'high' when environment > 90 and environment <= 100 then 'premium' end tier from i)
    select business_id, round(safety * infrastructure / 100, 6) safety_x_infrastructure, tier, case when tier = 'low' then 1 else 0 end tier_low, case when tier = 'medium' then 1 else 0 end tier_medium from t""",
)
def ml_columns(spark, sf_dir):
    out = R.ml_columns(R.location_indices(places(spark, sf_dir)), ["safety", "infrastructure", "access", "development", "demographics", "environment"])
    return rounded(out.select("business_id", "safety_x_infrastructure", "tier", "tier_low", "tier_medium"))


@query("B23_flat_params", "select n_nationkey id, unnest(['name', 'limits.low', 'limits.high']) name, unnest([n_name, cast(n_regionkey as varchar), cast(n_nationkey as varchar)]) as value from nation")
def flat_params(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    nested = F.struct(F.col("n_regionkey").cast("string").alias("low"), F.col("n_nationkey").cast("string").alias("high"))
    return R.flat_params(n.select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"), nested.alias("limits"))).alias("params")), "id", "params")


@query("B24_placeholders", "select business_id from business where business_id % 10 <> 3")
def placeholders(spark, sf_dir):
    b = view(spark, sf_dir, "business").select("business_id", F.when(F.col("business_id") % 10 == 3, F.concat(F.lit("Sample "), "name")).otherwise(F.col("name")).alias("name"))
    return R.without_placeholders(b, "name").select("business_id")


@query(
    "C2_industry_filters",
    f"with t as (select business_id, employees, patent_count, {TYPE} type from business), n(type, e, p) as (values ('logistics', 40, 5), ('technology', 20, 2), ('biosciences', 30, 3), ('manufacturing', 50, 4)) select business_id, case when employees < e then 'employees' when patent_count < p then 'patents' end reject_reason from t left join n using (type)",
)
def industry_filters(spark, sf_dir):
    return R.industry_filters(view(spark, sf_dir, "business")).select("business_id", "reject_reason")


NEEDS_BY_TYPE = [("logistics", "freight", 40.0), ("logistics", "sites", 25.0), ("technology", "talent", 900.0), ("technology", "patents", 60.0), ("biosciences", "patents", 80.0), ("biosciences", "talent", 600.0), ("manufacturing", "sites", 30.0), ("manufacturing", "talent", 700.0)]
TWO = "case substr(cluster_id, length(cluster_id) - 1) when '48' then 'logistics' when '49' then 'logistics' when '54' then 'technology' when '51' then 'technology' when '62' then 'biosciences' else 'manufacturing' end"


@query(
    "C7_missing_needs",
    f"""with needs(type, item, least) as (values {", ".join(f"('{t}', '{i}', {v!r}::double)" for t, i, v in NEEDS_BY_TYPE)}),
    m as (select cluster_id, {TWO} type, count(*) * 1.0::double sites, sum(patent_count) * 1.0::double patents, sum(employees) / 1.0::double talent, count(distinct county) * 8.0::double freight from member group by 1),
    u as (unpivot m on sites, patents, talent, freight into name item value amount)
    select m.cluster_id, coalesce((select string_agg(n.item, ',' order by n.item) from needs n join u on u.item = n.item and u.cluster_id = m.cluster_id where n.type = m.type and u.amount < n.least), '') missing from m""",
)
def missing_needs(spark, sf_dir):
    two = F.substring("naics_code", 1, 2)
    kind = F.when(two.isin("48", "49"), "logistics").when(two.isin("54", "51"), "technology").when(two.isin("62"), "biosciences").otherwise("manufacturing")
    m = view(spark, sf_dir, "member").groupBy("cluster_id", kind.alias("type")).agg(
        F.count(F.lit(1)).alias("sites"), F.sum("patent_count").alias("patents"), F.sum("employees").alias("talent"), (F.count_distinct("county") * 8).alias("freight")
    )
    return R.missing_needs(m, spark.createDataFrame(NEEDS_BY_TYPE, "type string, item string, least double"), ["sites", "patents", "talent", "freight"])


@query(
    "D15_join_macro",
    """with i as (select event_type indicator, avg(value) as value from events group by 1), w as (select max(value) filter (where indicator = 'click') unemployment, max(value) filter (where indicator = 'purchase') gdp_growth, max(value) filter (where indicator = 'view') electricity from i),
    t as (select (['technology', 'biosciences', 'manufacturing'])[cast(user_id % 3 + 1 as int)] sector, avg(value) momentum from events group by 1),
    b as (select *, case when naics_code like '325%' then 'biosciences' when naics_code like '54%' then 'technology' when naics_code like '33%' or naics_code like '52%' then 'manufacturing' end sector from business)
    select business_id, round(unemployment, 6) macro_unemployment, round(gdp_growth, 6) macro_gdp_growth, round(electricity, 6) energy_cost_index, round(momentum, 6) sector_momentum from b left join t using (sector) cross join w""",
)
def join_macro(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for pair in (("click", "unemployment"), ("purchase", "gdp_growth"), ("view", "electricity")) for x in pair])
    indicators = e.groupBy("event_type").agg(F.avg("value").alias("value")).select(F.try_element_at(name, F.col("event_type")).alias("indicator"), "value")
    sector = F.get(F.array(F.lit("technology"), F.lit("biosciences"), F.lit("manufacturing")), (F.col("user_id") % 3).cast("int"))
    momentum = e.groupBy(sector.alias("sector")).agg(F.avg("value").alias("momentum"))
    out = C.join_macro(view(spark, sf_dir, "business").select("business_id", "naics_code"), indicators, momentum)
    return rounded(out.drop("naics_code"))


@query(
    "D17_alignment",
    f"""with c as (select cluster_id, {TWO} type, county from member group by 1, 2, 3), u as (select s_suppkey id, n_name county, (['logistics', 'technology', 'biosciences', 'manufacturing'])[cast(s_suppkey % 4 + 1 as int)] strength, s_acctbal * 1000 funding, s_suppkey % 50 * 20 graduates, s_suppkey % 9 patents from supplier join nation on n_nationkey = s_nationkey),
    g as (select cluster_id, count(*) institutions, sum(graduates) graduates, round(sum(funding), 2) funding, sum(patents) patents from c join u on u.county = c.county and u.strength = c.type group by 1),
    s as (select *, least(1.0::double, graduates / 5000.0::double * 0.4::double + least(1.0::double, greatest(0, funding) / 10000000.0::double) * 0.4::double + patents / 100.0::double * 0.2::double) score from g)
    select cluster_id, institutions, cast(graduates as bigint) graduates, funding, cast(patents as bigint) patents, round(score, 6) score, round(score, 6) > 0.5 recommended from s""",
)
def alignment(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    two = F.substring("naics_code", 1, 2)
    kind = F.when(two.isin("48", "49"), "logistics").when(two.isin("54", "51"), "technology").when(two.isin("62"), "biosciences").otherwise("manufacturing")
    c = m.select("cluster_id", kind.alias("type"), "county").distinct()
    n = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("county"))
    k = F.col("s_suppkey")
    strengths = F.array(*[F.lit(t) for t in ("logistics", "technology", "biosciences", "manufacturing")])
    u = view(spark, sf_dir, "supplier").join(F.broadcast(n), "s_nationkey").select(
        "county", F.array(F.get(strengths, (k % 4).cast("int"))).alias("strengths"), (F.col("s_acctbal") * 1000).alias("funding"), (k % 50 * 20).alias("graduates"), (k % 9).alias("patents")
    )
    return rounded(R.alignment(c, u))


@query(
    "E21_county_growth",
    f"""with {FAVOR}, g as (select county, count(*) businesses, avg(2024 - year_established) average_age, sum(patent_count) patents, count(distinct cluster_id) clusters, sum((40.0::double + business_id % 50) * case when gdp > 0 then 1.1::double else 1.05::double end) / count(*) growth, max(market_score) market from member join favor using (cluster_id) group by 1),
    p as (select *, round(0.3::double * growth + 20 * greatest(0, (10 - average_age) / 10) + 20 * least(patents / 10, 1) + 30 * market, 6) potential from g)
    select county, businesses, round(average_age, 6) average_age, cast(patents as bigint) patents, clusters, round(growth, 6) growth, round(market, 6) market, potential, case when potential >= 70 then 'hot growth' when potential >= 50 then 'high potential' when potential >= 30 then 'emerging' else 'developing' end as "zone" from p""",
)
def county_growth(spark, sf_dir):
    m = view(spark, sf_dir, "member").withColumn("composite_score", F.lit(40.0) + F.col("business_id") % 50)
    return rounded(C.county_growth(m, favored(spark, sf_dir), AS_OF))


@query(
    "J25_validate_targets",
    """with g as (select cluster_id, sum(revenue_estimate) * 1.85::double gdp, sum(employees) jobs, sum(patent_count) p, count(*) n from member group by 1), t as (select sum(gdp) all_gdp, sum(jobs) all_jobs from g)
    select cluster_id, gdp >= 50000000 meets_gdp, jobs >= 5000 meets_jobs, gdp / greatest(n * 2000000.0::double, 1) >= 1.5 meets_roi, n >= 20 and p >= 50 has_infrastructure, gdp / 1.85::double / greatest(jobs, 1) >= 60000 raises_wages,
      round(gdp / all_gdp, 8) gdp_contribution, round(jobs / all_jobs, 8) jobs_contribution from g cross join t""",
)
def validate_targets(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(
        (F.sum("revenue_estimate") * 1.85).alias("gdp"), F.sum("employees").alias("jobs"), F.sum("patent_count").alias("p"), F.count(F.lit(1)).alias("n")
    )
    return rounded(R.validate_targets(g), 8)


@query(
    "K4_revenue_report",
    """with g as (select cluster_id, round(sum(revenue_estimate), 2) revenue from member group by 1), r as (select *, revenue / sum(revenue) over () share, row_number() over (order by revenue desc, cluster_id) place, count(*) over () n from g)
    select cluster_id, revenue, round(share, 6) share, cast(place as int) place, case ceil(place * 3 / n) when 1 then 'high' when 2 then 'medium' else 'low' end priority from r""",
)
def revenue_report(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.round(F.sum("revenue_estimate"), 2).alias("revenue"))
    return rounded(R.cluster_report(g, "revenue"), revenue=2)


@query(
    "K6_workforce_needs",
    """with m as (select cluster_id, sum(employees) employees, case when cluster_id like '%:48' or cluster_id like '%:49' then 'logistics' when cluster_id like '%:5%' then 'technology' else 'manufacturing' end type from member group by 1),
    o(type, occupation, share, wage) as (values ('logistics', 'drivers', 0.45::double, 48000), ('logistics', 'handlers', 0.30::double, 36000), ('logistics', 'planners', 0.10::double, 70000), ('technology', 'developers', 0.50::double, 98000), ('technology', 'analysts', 0.20::double, 82000), ('technology', 'support', 0.15::double, 52000),
      ('manufacturing', 'machinists', 0.35::double, 47000), ('manufacturing', 'assemblers', 0.30::double, 39000), ('manufacturing', 'engineers', 0.10::double, 88000))
    select cluster_id, occupation, round(employees * share, 4) need, round(employees * share * pow(1.05::double, 5), 4) future_need, round(employees * share * (pow(1.05::double, 5) - 1), 4) gap, round(employees * share * wage, 2) wages from m join o using (type)""",
)
def workforce_needs(spark, sf_dir):
    c = F.col("cluster_id")
    kind = F.when(c.endswith(":48") | c.endswith(":49"), "logistics").when(c.rlike(":5"), "technology").otherwise("manufacturing")
    m = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.sum("employees").alias("employees")).withColumn("type", kind)
    return rounded(R.workforce_needs(m, 5), 4, wages=2)


@query(
    "K10_innovation_by_type",
    f"""with {values("r", "kind, rd, per_million, per_hundred, award_size, rate", [(k, *v) for k, v in C.RESEARCH.items()])}, g as (select {TYPE} type, count(*) businesses from business group by 1)
    select type, businesses, rd rd_intensity, round(per_million * rd * 10, 6) patents_each, round(per_million * rd * 10 * businesses, 6) patents, round(least(100.0::double, per_million * rd * 500), 6) innovation_score, round(businesses * per_hundred / 100, 6) awards, round(businesses * per_hundred / 100 * award_size, 2) award_funding, rate success_rate
    from g join r on kind = case when type in (select kind from r) then type else 'mixed' end""",
)
def innovation_by_type(spark, sf_dir):
    g = view(spark, sf_dir, "business").groupBy(R.type_of(F.col("naics_code")).alias("type")).agg(F.count(F.lit(1)).alias("businesses"))
    return rounded(C.innovation_by_type(spark, g), award_funding=2)
