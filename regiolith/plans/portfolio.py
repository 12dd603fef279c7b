"""Queries that compare clusters, scenarios and types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regiolith.operators import clusters as K
from regiolith.operators import communities as D
from regiolith.operators import evaluation as E
from regiolith.operators import scorecards as C
from regiolith.operators import scores as S
from regiolith.operators.profiles import dominant_place
from regiolith.operators.reports import flat_params, type_of
from regiolith.operators.strategy import critical_mass
from regiolith.plans import registry
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.scores import CLUSTER_TYPE, cluster_type
from regiolith.plans.strategy import ASSETS, CENTRAL, CRITICAL_MASS, values
from regiolith.plans.views import view


@query(
    "G3_jitter_point",
    """with u as (select business_id, cast(('0x' || substr(sha256(concat(name, '|', county)), 1, 8)) as bigint) / 4294967295.0::double a, cast(('0x' || substr(sha256(concat(name, '|', county)), 9, 8)) as bigint) / 4294967295.0::double b, latitude, longitude from business)
    select business_id, round(latitude + (a - 0.5) * 0.02, 8) latitude, round(longitude + (b - 0.5) * 0.02, 8) longitude from u""",
)
def jitter_point(spark, sf_dir):
    digest = F.sha2(F.concat_ws("|", "name", "county"), 256)
    unit = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 4294967295.0
    b = view(spark, sf_dir, "business")
    return b.select("business_id", F.round(F.col("latitude") + (unit(1) - 0.5) * 0.02, 8).alias("latitude"), F.round(F.col("longitude") + (unit(9) - 0.5) * 0.02, 8).alias("longitude"))


@query(
    "I12_cluster_name",
    """with s as (select cluster_id, county, count(*) n, count(*) / sum(count(*)) over (partition by cluster_id) p from member group by 1, 2),
    r as (select *, row_number() over (partition by cluster_id order by n desc, county) i, count(*) over (partition by cluster_id) k from s),
    place as (select a.cluster_id, case when a.p > 0.6 then a.county when b.p > 0.25 then concat(a.county, '-', b.county) when a.k > 3 then 'metro' else a.county end place from r a left join r b on b.cluster_id = a.cluster_id and b.i = 2 where a.i = 1),
    c as (select cluster_id, substr(naics_code, 1, 3) code, count(*) n from member group by 1, 2), t as (select *, row_number() over (partition by cluster_id order by n desc, code) i from c)
    select place.cluster_id, concat(place, ' ', code, ' cluster') name from place join t using (cluster_id) where i = 1""",
)
def cluster_name(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    top = K.top_share(m, "cluster_id", F.substring("naics_code", 1, 3))
    return dominant_place(m).join(top, "cluster_id").select("cluster_id", F.concat_ws(" ", "place", "top", F.lit("cluster")).alias("name"))


OUTPUT_OF = "coalesce(case substr(naics_code, 1, 4) " + " ".join(f"when '{k}' then {v}" for k, v in E.OUTPUT.items() if len(k) == 4) + " end, case substr(naics_code, 1, 3) " + " ".join(f"when '{k}' then {v}" for k, v in E.OUTPUT.items() if len(k) == 3) + f" end, {E.OTHER_OUTPUT})::double"
JOBS_OF = "(case substr(naics_code, 1, 3) " + " ".join(f"when '{k}' then {v}" for k, v in E.EMPLOYMENT_MULTIPLIERS.items() if len(k) == 3) + f" else {E.OTHER_JOBS} end)::double"
SIX = f"""g as (select cluster_id, sum(revenue_estimate * {OUTPUT_OF}) base, sum(patent_count * 10 + sbir_awards * 20) innovation, sum(employees) direct, avg({JOBS_OF}) follow from member group by 1),
    tops as (select cluster_id, code from (select cluster_id, substr(naics_code, 1, 3) code, row_number() over (partition by cluster_id order by count(*) desc, substr(naics_code, 1, 3)) i from member group by 1, 2) where i = 1),
    rates as (select cluster_id, least(0.15, 0.05 * (case code when '511' then 1.5 when '518' then 1.4 when '493' then 1.2 else 1.0 end))::double rate from tops),
    six as (select g.cluster_id, round(base * pow(1 + rate, 5) * 1.2::double * success, 2) gdp, cast(innovation as bigint) innovation, cast(floor(direct + direct * (pow(1 + rate * 0.8::double, 5) - 1) * follow + 0.000001) as bigint) jobs, synergy, risk, critical_mass
      from g join rates using (cluster_id) join ({registry.sql_of("J11_success_probability")}) using (cluster_id) join ({registry.sql_of("J12_intra_synergy")}) using (cluster_id) join ({registry.sql_of("J13_cluster_risk")}) using (cluster_id) join ({CRITICAL_MASS}) using (cluster_id))"""


def six_objectives(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    parts = [rounded(x) for x in (S.success_probability(m, AS_OF), S.intra_synergy(m), S.cluster_risk(m, AS_OF), critical_mass(m, view(spark, sf_dir, "business")))]
    return rounded(E.objectives(m, *parts), gdp=2)


@query("I13_evaluate_cluster", f"with {SIX} select * from six")
def evaluate_cluster(spark, sf_dir):
    return six_objectives(spark, sf_dir)


BETTER, WORSE = ("gdp", "innovation", "jobs", "synergy", "critical_mass"), ("risk",)
AS_GOOD = " and ".join([f"b.{c} >= a.{c}" for c in BETTER] + [f"b.{c} <= a.{c}" for c in WORSE])
IS_BETTER = " or ".join([f"b.{c} > a.{c}" for c in BETTER] + [f"b.{c} < a.{c}" for c in WORSE])


@query("I8_pareto_objectives", f"with {SIX} select a.cluster_id, a.gdp, a.risk from six a where not exists (select 1 from six b where {AS_GOOD} and ({IS_BETTER}))")
def pareto_objectives(spark, sf_dir):
    """The front over the six objectives."""
    return D.pareto_front(six_objectives(spark, sf_dir), "cluster_id", list(BETTER), list(WORSE)).select("cluster_id", "gdp", "risk")


@query("I8_pick_clusters")
def pick_clusters(spark, sf_dir):
    """Clusters by state and industry beside those by county, picked by output less risk without a business in two of them."""
    m = view(spark, sf_dir, "member")
    every = m.unionByName(m.withColumn("cluster_id", F.concat_ws("/", "county", F.substring("naics_code", 1, 1))))
    scores = every.groupBy("cluster_id").agg((F.sum("revenue_estimate") / 1e6 - F.count_if(F.col("employees") < 20)).alias("score"))
    return D.pick_without_overlap(every.select("cluster_id", F.col("business_id").alias("member")), rounded(scores), least=20)


SUSTAINABILITY = f"""with mass as ({CRITICAL_MASS}), c as (select cluster_id, county k, count(*) n from member group by 1, 2), s as (select cluster_id, n / sum(n) over (partition by cluster_id) p from c), h as (select cluster_id, sum(p * p) density from s group by 1),
    d as (select cluster_id, case when employees < 50 then 1 when employees < 500 then 2 else 3 end k, count(*) n from member group by 1, 2), e as (select cluster_id, n / sum(n) over (partition by cluster_id) p from d), v as (select cluster_id, -sum(p * ln(p)) / 1.099::double diversity from e group by 1),
    t(chain, code) as (values ('l', '484'), ('l', '488'), ('l', '493'), ('m', '332'), ('m', '333'), ('m', '336'), ('b', '325'), ('b', '3254'), ('b', '541'), ('t', '511'), ('t', '518'), ('t', '541')),
    x as (select cluster_id, max(k) / 3 supply_chain from (select cluster_id, chain, count(distinct code) k from member join t on code = substr(naics_code, 1, 3) group by 1, 2) group by 1)
    select h.cluster_id, round(coalesce(supply_chain, 0), 4) supply_chain, round(density, 4) density, round(diversity, 4) diversity, round(least(100.0::double, 1.2::double * (0.5::double * critical_mass + 20 * coalesce(supply_chain, 0) + 15 * density + 15 * diversity)), 4) sustainability
    from h join v on v.cluster_id = h.cluster_id left join x on x.cluster_id = h.cluster_id join mass on mass.cluster_id = h.cluster_id"""


@query("J15_sustainability", SUSTAINABILITY)
def sustainability(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    return rounded(C.sustainability(m, critical_mass(m, view(spark, sf_dir, "business"))), 4)


PARTNERS = [("logistics", "manufacturing"), ("biosciences", "technology"), ("manufacturing", "technology"), ("logistics", "technology")]
REQUIRED = [("logistics", "rail_capacity"), ("logistics", "highway_access"), ("technology", "broadband_speed"), ("technology", "tech_workforce"), ("biosciences", "lab_space"), ("biosciences", "university_research"), ("manufacturing", "industrial_power"), ("manufacturing", "skilled_manufacturing")]
STRATEGIC = [(t, c) for t in C.STRATEGIC_TYPES for c in (*CENTRAL, "JAPAN", "CHINA", "GERMANY", "KENYA", "EGYPT")]
LESS_PART = "select n_name county, (['" + "','".join(ASSETS) + "'])[cast(p_partkey % 9 + 1 as int)] asset from part join nation on n_nationkey = p_partkey % 20 where p_partkey % 25 <> n_nationkey % 7"


def typed_members(spark, sf_dir):
    return view(spark, sf_dir, "member").withColumn("type", cluster_type())


@query(
    "J18_strategic_alignment",
    f"""with typed as (select *, {CLUSTER_TYPE} type from member), asset as (select distinct county, asset from ({LESS_PART})), {values("required", "type, asset", REQUIRED)}, {values("strategic", "type, county", STRATEGIC)}, {values("pairs", "x, y", PARTNERS)},
    g as (select cluster_id, type, count(*) n, count(distinct substr(naics_code, 1, 3)) codes, stddev_samp(employees) spread from typed group by 1, 2),
    met as (select cluster_id, count(*) met from (select t.cluster_id, r.asset from typed t join required r on r.type = t.type join asset a on a.asset = r.asset and a.county = t.county join g on g.cluster_id = t.cluster_id group by 1, 2 having count(*) / max(g.n) > 0.7::double) group by 1),
    central as (select cluster_id, count(*) central from typed join strategic using (type, county) group by 1)
    select g.cluster_id, cast(least(100, 50 + 10 * coalesce(met, 0) + case when coalesce(central, 0) / n > 0.6::double then 15 else 0 end + case when n >= 50 then 10 when n >= 30 then 5 else 0 end) as int) alignment,
      cast(least(100, 50 + case when codes > 3 then 10 else 0 end + case when spread > 50 then 10 else 0 end + 5 * (select count(*) from pairs where x = g.type or y = g.type)) as int) synergy_potential
    from g left join met on met.cluster_id = g.cluster_id left join central on central.cluster_id = g.cluster_id""",
)
def strategic_alignment(spark, sf_dir):
    n = view(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    names = F.array(*[F.lit(a) for a in ASSETS])
    p = view(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 20).alias("n_nationkey")).join(F.broadcast(n), "n_nationkey").where(F.col("p_partkey") % 25 != F.col("n_nationkey") % 7)
    has = p.select(F.col("n_name").alias("county"), F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("asset"))
    required, strategic = spark.createDataFrame(REQUIRED, "type string, asset string"), spark.createDataFrame(STRATEGIC, "type string, county string")
    partners = spark.createDataFrame([(t, sum(t in pair for pair in PARTNERS)) for t in sorted({t for pair in PARTNERS for t in pair})], "type string, partners int")
    return C.strategic_alignment(typed_members(spark, sf_dir), has, required, strategic, partners)


@query(
    "J18_strategic_pair_synergy",
    f"""with {values("pairs", "x, y", PARTNERS)}, g as (select cluster_id, {CLUSTER_TYPE} type, count(*) n from member group by 1), c as (select distinct cluster_id, county from member),
    s as (select p.cluster_id a, q.cluster_id b, count(*) shared from c p join c q on p.county = q.county and p.cluster_id < q.cluster_id group by 1, 2)
    select p.cluster_id a, q.cluster_id b, cast(least(100, case when (least(p.type, q.type), greatest(p.type, q.type)) in (('logistics', 'manufacturing'), ('animal_health', 'biosciences'), ('manufacturing', 'technology')) then 30 else 0 end + 10 * coalesce(shared, 0) + case when abs(p.n - q.n) between 10 and 30 then 15 else 0 end) as int) synergy
    from pairs join g p on p.type in (x, y) join g q on q.type in (x, y) and q.type <> p.type and p.cluster_id < q.cluster_id left join s on s.a = p.cluster_id and s.b = q.cluster_id""",
)
def strategic_pair_synergy(spark, sf_dir):
    return C.strategic_pair_synergy(typed_members(spark, sf_dir), spark.createDataFrame(PARTNERS, "type string, other string"))


@query(
    "J24_workforce_scores",
    f"""with {values("gaps", "type, skill_gaps", C.SKILL_GAPS.items())}, g as (select cluster_id, {CLUSTER_TYPE} type, sum(employees) employees from member group by 1), s as (select *, case when employees > 100 then 70.0::double else 50.0::double end a, case when type in ('technology', 'biosciences') then 60.0::double else 40.0::double end p from g)
    select cluster_id, cast(employees as bigint) employees, a skills_availability, p talent_pipeline, 65.0::double wage_competitiveness, coalesce(skill_gaps, '') skill_gaps, round(0.4::double * a + 0.4::double * p + 13, 6) score from s left join gaps using (type)""",
)
def workforce_scores(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.sum("employees").alias("employees"))
    return rounded(C.workforce_scores(g.withColumn("type", cluster_type())))


@query(
    "J26_scenario_compare",
    """with c as (select state scenario, cluster_id, count(*) k from member group by 1, 2), s as (select state scenario, round(sum(revenue_estimate) * 1.85::double, 2) gdp, sum(employees) jobs from business group by 1),
    t as (select s.*, (select max(k) from c where c.scenario = s.scenario) top_score from s), r as (select scenario, gdp, jobs, top_score, 100 * gdp / 3000000000.0::double gdp_achievement, 100 * jobs / 200000.0::double jobs_achievement, max(gdp) over () a, max(jobs) over () b, max(top_score) over () d from t),
    p as (select *, round(40 * gdp / a + 30 * jobs / b + 10 * least(gdp_achievement / 100, 1) + 10 * least(jobs_achievement / 100, 1) + 10 * top_score / d, 1) score from r)
    select scenario, gdp, cast(jobs as bigint) jobs, top_score, round(gdp_achievement, 6) gdp_achievement, round(jobs_achievement, 6) jobs_achievement, score, concat_ws(',', case when gdp = a then 'gdp' end, case when jobs = b then 'jobs' end, case when top_score = d then 'top_score' end) best,
      cast(row_number() over (order by score desc, scenario) as int) "rank" from p""",
)
def scenario_compare(spark, sf_dir):
    s = view(spark, sf_dir, "business").groupBy(F.col("state").alias("scenario")).agg(F.round(F.sum("revenue_estimate") * 1.85, 2).alias("gdp"), F.sum("employees").alias("jobs"))
    top = view(spark, sf_dir, "member").groupBy(F.col("state").alias("scenario"), "cluster_id").count().groupBy("scenario").agg(F.max("count").alias("top_score"))
    return rounded(C.scenario_compare(s.join(top, "scenario"), 3e9, 200_000.0), gdp=2)


@query(
    "J26_parameter_differences",
    """with p as (select n_nationkey id, unnest(['name', 'limits.low', 'limits.high', 'extra']) name, unnest([n_name, cast(n_regionkey as varchar), '25', case when n_regionkey = 0 then 'yes' end]) as value from nation)
    select id, name, coalesce(value, 'Not set') as value from p where name <> 'limits.high'""",
)
def parameter_differences(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    nested = F.struct(F.col("n_regionkey").cast("string").alias("low"), F.lit("25").alias("high"))
    params = F.to_json(F.struct(F.col("n_name").alias("name"), nested.alias("limits"), F.when(F.col("n_regionkey") == 0, "yes").alias("extra")))
    return C.parameter_differences(flat_params(n.select(F.col("n_nationkey").alias("id"), params.alias("params")), "id", "params"))


@query(
    "J20_concentration_risk",
    """with c as (select agency, county, sum(amount) v from award join (select business_id, county from business) b using (business_id) group by 1, 2), s as (select agency, v / sum(v) over (partition by agency) p, row_number() over (partition by agency order by v desc, county) i from c)
    select agency, round(sum(p), 6) top_three, case when sum(p) > 0.18 then 'high' when sum(p) > 0.15 then 'medium' else 'low' end risk from s where i <= 3 group by 1""",
)
def concentration_risk(spark, sf_dir):
    a = view(spark, sf_dir, "award").join(view(spark, sf_dir, "business").select("business_id", "county"), "business_id")
    c = a.groupBy("agency", "county").agg(F.sum("amount").alias("v"))
    w = Window.partitionBy("agency")
    s = c.withColumn("p", F.col("v") / F.sum("v").over(w)).withColumn("i", F.row_number().over(w.orderBy(F.desc("v"), "county"))).where("i <= 3")
    g = s.groupBy("agency").agg(F.sum("p").alias("top_three"))
    return rounded(g.withColumn("risk", F.when(F.col("top_three") > 0.18, "high").when(F.col("top_three") > 0.15, "medium").otherwise("low")))


@query("L4_predict_business")
def predict_business(spark, sf_dir):
    """Two forests on the logarithms of revenue and employees, read back and not under 0; unknown places and codes are kept."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    b = view(spark, sf_dir, "business").select(
        "business_id", F.coalesce("county", F.lit("Unknown")).alias("county"), F.rpad(F.substring("naics_code", 1, 4), 4, "0").alias("code"), F.coalesce("state", F.lit("Other")).alias("region"),
        F.coalesce(type_of(F.col("naics_code")), F.lit("Other")).alias("type"), F.greatest(F.lit(0), F.coalesce(F.lit(AS_OF) - F.col("year_established"), F.lit(0))).alias("age"),
        F.log1p("revenue_estimate").alias("log_revenue"), F.log1p("employees").alias("log_employees"),
    )
    places = ["county", "code", "region", "type"]
    index = StringIndexer(inputCols=places, outputCols=[f"{c}_i" for c in places], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in places], outputCols=[f"{c}_v" for c in places], handleInvalid="keep")
    forests = [RandomForestRegressor(labelCol=f"log_{c}", predictionCol=f"predicted_{c}", numTrees=10, seed=42) for c in ("revenue", "employees")]
    found = Pipeline(stages=[index, hot, VectorAssembler(inputCols=["age", *[f"{c}_v" for c in places]], outputCol="features"), *forests]).fit(b).transform(b)
    back = lambda c: F.greatest(F.lit(0.0), F.expm1(c))
    return rounded(found.select("business_id", back("predicted_revenue").alias("revenue"), F.round(back("predicted_employees")).cast("long").alias("employees")), 2)


def told(kind):
    return "concat_ws('; ', " + ", ".join(f"case when coalesce({c}, 0) {sign} {limit} then '{text}' end" for k, c, sign, limit, text in C.EXPLANATIONS if k == kind) + f") {kind}"


@query(
    "L8_explain_rules",
    f"""with mass as ({CRITICAL_MASS}), sus as ({SUSTAINABILITY}),
    m as (select cluster_id, sum(employees) jobs, round(avg(patent_count) * 10, 4) roi, round(avg(case when patent_count > 0 then 100.0::double else 0.0::double end), 4) infrastructure, round(avg(case when sbir_awards > 0 then 100.0::double else 0.0::double end), 4) safety from member group by 1),
    f as (select m.*, round(critical_mass, 4) critical_mass, supply_chain, diversity, sustainability strategic_score, round(100 * (1 - density), 2) market_access from m join mass using (cluster_id) join sus using (cluster_id))
    select cluster_id, {told("key_drivers")}, {told("strengths")}, {told("risks")}, {told("recommendations")} from f""",
)
def explain_rules(spark, sf_dir):
    """Shares of members with patents and with awards stand for infrastructure and safety, which the tables do not have."""
    m = view(spark, sf_dir, "member")
    mass = critical_mass(m, view(spark, sf_dir, "business"))
    share = lambda c: F.avg(F.when(F.col(c) > 0, 100.0).otherwise(0.0))
    g = m.groupBy("cluster_id").agg(F.sum("employees").alias("jobs"), (F.avg("patent_count") * 10).alias("roi"), share("patent_count").alias("infrastructure"), share("sbir_awards").alias("safety"))
    f = rounded(g.join(mass, "cluster_id").join(C.sustainability(m, mass).withColumnRenamed("sustainability", "strategic_score"), "cluster_id"), 4)
    return C.explain_rules(f.withColumn("market_access", F.round(100 * (1 - F.col("density")), 2)))
