"""Scorecards of clusters, counties and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.operators import clusters as K

# Chains of codes, gaps in skills, research by type, sectors of codes, pairs of types that supply each other.
CHAINS = {"logistics": ["484", "488", "493"], "manufacturing": ["332", "333", "336"], "biotech": ["325", "3254", "541"], "tech": ["511", "518", "541"]}
SIZE_ENTROPY = 1.099
SKILL_GAPS = {
    "technology": "AI/ML specialists, Cybersecurity experts, Cloud architects",
    "biosciences": "Clinical researchers, Biostatisticians, Lab technicians",
    "logistics": "Supply chain analysts, Warehouse automation specialists, CDL drivers",
}
#: type: share of revenue for research, patents a million of it, awards for 100 businesses, size of an award, success rate.
RESEARCH = {
    "technology": (0.15, 0.8, 2.5, 750_000.0, 0.12), "biosciences": (0.12, 1.2, 3.2, 850_000.0, 0.15), "manufacturing": (0.03, 0.5, 0.8, 500_000.0, 0.08),
    "logistics": (0.01, 0.1, 0.2, 400_000.0, 0.05), "mixed": (0.04, 0.4, 1.0, 600_000.0, 0.10),
}
SECTORS = {"54": "technology", "325": "biosciences", "33": "manufacturing", "52": "manufacturing"}
SUPPLY_TYPES = [("logistics", "manufacturing"), ("animal_health", "biosciences"), ("manufacturing", "technology")]
#: What a cluster is told, in order: kind, column, comparison, limit, text.
EXPLANATIONS = [
    ("key_drivers", "critical_mass", ">", 70, "critical mass carries the cluster"), ("key_drivers", "strategic_score", ">", 80, "strong strategic position"),
    ("key_drivers", "market_access", ">", 80, "good access to markets"), ("key_drivers", "infrastructure", ">", 85, "infrastructure for growth"),
    ("strengths", "roi", ">", 20, "high return"), ("strengths", "jobs", ">", 10_000, "many jobs"),
    ("risks", "critical_mass", "<", 50, "low critical mass"), ("risks", "safety", "<", 60, "low safety"),
    ("recommendations", "supply_chain", "<", 0.5, "complete the supply chain"), ("recommendations", "diversity", "<", 0.5, "mix sizes of businesses"),
]
STRATEGIC_TYPES = ("logistics", "biosciences", "technology")


def favorability() -> Column:
    """Of 0.5 to 1: columns gdp, n, innovation and synergy of a cluster against fixed steps."""
    step = lambda c, most, points: F.when(F.col(c) > most, points).otherwise(0.0)
    gdp = F.when(F.col("gdp") > 1e9, 0.2).otherwise(step("gdp", 5e8, 0.1))
    return F.least(F.lit(1.0), 0.5 + gdp + step("n", 30, 0.1) + step("innovation", 70, 0.1) + step("synergy", 80, 0.05))


def award_score(members: DataFrame, awards: DataFrame, second: str, recent_from: int) -> DataFrame:
    """(cluster_id, awards, funding, second_phase, recent, score): number, funding, second phases and recency of the awards
    of a cluster's businesses, each up to its bound; 0 without an award. Awards are summed by business before they meet the clusters."""
    own = awards.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("awards"), F.sum("amount").alias("funding"), F.count_if(F.col("phase") == second).alias("second_phase"), F.count_if(F.col("award_year") >= recent_from).alias("recent")
    )
    columns = ("awards", "funding", "second_phase", "recent")
    g = members.select("cluster_id", "business_id").join(own, "business_id", "left").groupBy("cluster_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    up_to = lambda c, most: F.least(F.col(c) / most, F.lit(1.0))
    fresh = F.coalesce(F.try_divide("recent", "awards"), F.lit(0.0))
    return g.withColumn("score", 100 * (0.25 * up_to("awards", 10) + 0.35 * up_to("funding", 5e6) + 0.25 * up_to("second_phase", 5) + 0.15 * fresh))


def workforce_scores(clusters: DataFrame) -> DataFrame:
    """Scores of clusters (cluster_id, type, employees), their weighted sum, and the skills that the type lacks."""
    skills = F.when(F.col("employees") > 100, 70.0).otherwise(50.0)
    pipeline = F.when(F.col("type").isin("technology", "biosciences"), 60.0).otherwise(40.0)
    gaps = F.lit("")
    for kind, names in SKILL_GAPS.items():
        gaps = F.when(F.col("type") == kind, names).otherwise(gaps)
    scored = clusters.select("cluster_id", "employees", skills.alias("skills_availability"), pipeline.alias("talent_pipeline"), F.lit(65.0).alias("wage_competitiveness"), gaps.alias("skill_gaps"))
    return scored.withColumn("score", 0.4 * F.col("skills_availability") + 0.4 * F.col("talent_pipeline") + 0.2 * F.col("wage_competitiveness"))


def sustainability(members: DataFrame, critical_mass: DataFrame) -> DataFrame:
    """(cluster_id, supply_chain, density, diversity, sustainability): the fullest chain, the concentration over counties,
    the entropy of three sizes, and their sum with the critical mass (cluster_id, critical_mass), 100 at most."""
    code = F.substring("naics_code", 1, 3)
    table = members.sparkSession.createDataFrame([(name, c, len(codes)) for name, codes in CHAINS.items() for c in codes], "chain string, code string, parts int")
    present = members.select("cluster_id", code.alias("code")).distinct().join(F.broadcast(table), "code").groupBy("cluster_id", "chain", "parts").count()
    chains = present.groupBy("cluster_id").agg(F.max(F.col("count") / F.col("parts")).alias("supply_chain"))
    size = F.when(F.col("employees") < 50, "small").when(F.col("employees") < 500, "medium").otherwise("large")
    spread = K.shares(members, "cluster_id", size).groupBy("cluster_id").agg((-F.sum(F.col("share") * F.log("share")) / SIZE_ENTROPY).alias("diversity"))
    j = K.hhi(members, "cluster_id", F.col("county")).withColumnRenamed("hhi", "density").join(spread, "cluster_id").join(chains, "cluster_id", "left").join(critical_mass, "cluster_id", "left")
    chain, mass = F.coalesce("supply_chain", F.lit(0.0)), F.coalesce("critical_mass", F.lit(50.0))
    total = 0.5 * mass + 20 * chain + 15 * F.col("density") + 15 * F.col("diversity")
    return j.select("cluster_id", chain.alias("supply_chain"), "density", "diversity", F.least(F.lit(100.0), 1.2 * total).alias("sustainability"))


def strategic_alignment(members: DataFrame, assets: DataFrame, required: DataFrame, strategic: DataFrame, partners: DataFrame) -> DataFrame:
    """(cluster_id, alignment, synergy_potential) of members with a type, each 50 and more points up to 100.

    ``assets`` (county, asset), ``required`` (type, asset), ``strategic`` (type, county) and ``partners`` (type, partners) are
    dimensions. Members are counted by cluster and county before they meet them."""
    code = F.substring("naics_code", 1, 3)
    cells = members.groupBy("cluster_id", "type", "county").agg(F.count(F.lit(1)).alias("k"))
    sizes = members.groupBy("cluster_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(code).alias("codes"), F.stddev_samp("employees").alias("spread"))
    has = required.join(assets.select("county", "asset").distinct(), "asset")
    met = cells.join(has, ["type", "county"]).groupBy("cluster_id", "asset").agg(F.sum("k").alias("k")).join(sizes.select("cluster_id", "n"), "cluster_id")
    infrastructure = met.groupBy("cluster_id").agg(F.count_if(F.col("k") / F.col("n") > 0.7).alias("met"))
    central = cells.join(strategic.distinct(), ["type", "county"]).groupBy("cluster_id").agg(F.sum("k").alias("central"))
    j = sizes.join(infrastructure, "cluster_id", "left").join(central, "cluster_id", "left").join(F.broadcast(partners), "type", "left")  # a row for each type
    zero = F.lit(0)
    alignment = 50 + 10 * F.coalesce("met", zero) + F.when(F.coalesce("central", zero) / F.col("n") > 0.6, 15).otherwise(0) + F.when(F.col("n") >= 50, 10).when(F.col("n") >= 30, 5).otherwise(0)
    potential = 50 + F.when(F.col("codes") > 3, 10).otherwise(0) + F.when(F.col("spread") > 50, 10).otherwise(0) + 5 * F.coalesce("partners", zero)
    return j.select("cluster_id", F.least(F.lit(100), alignment).cast("int").alias("alignment"), F.least(F.lit(100), potential).cast("int").alias("synergy_potential"))


def strategic_pair_synergy(members: DataFrame, partners: DataFrame) -> DataFrame:
    """(a, b, synergy) of clusters whose types are partners (type, other), a before b: supply between the types, 10 for each
    shared county, and a difference in size from 10 to 30; 100 at most. Other pairs are never made."""
    sizes = members.groupBy("cluster_id", "type").agg(F.count(F.lit(1)).alias("n"))
    x, y = (sizes.select([F.col(c).alias(f"{c}_{side}") for c in sizes.columns]) for side in "ab")
    both = partners.select("type", "other").union(partners.select("other", "type")).distinct()
    pairs = x.join(both.withColumnsRenamed({"type": "type_a", "other": "type_b"}), "type_a").join(y, "type_b").where("cluster_id_a < cluster_id_b")
    shared = K.member_jaccard(members, "cluster_id", "county").select(F.col("a").alias("cluster_id_a"), F.col("b").alias("cluster_id_b"), "shared")
    supply = F.lit(False)
    for p, q in SUPPLY_TYPES:
        supply = supply | (F.least("type_a", "type_b") == p) & (F.greatest("type_a", "type_b") == q)
    points = F.when(supply, 30).otherwise(0) + 10 * F.coalesce("shared", F.lit(0)) + F.when(F.abs(F.col("n_a") - F.col("n_b")).between(10, 30), 15).otherwise(0)
    joined = pairs.join(shared, ["cluster_id_a", "cluster_id_b"], "left")
    return joined.select(F.col("cluster_id_a").alias("a"), F.col("cluster_id_b").alias("b"), F.least(F.lit(100), points).cast("int").alias("synergy"))


def county_growth(members: DataFrame, clusters: DataFrame, as_of: int) -> DataFrame:
    """(county, businesses, average_age, patents, clusters, growth, market, potential, zone) of members with a composite_score.

    ``clusters`` has (cluster_id, gdp, market_score). Members are summed by cluster and county first."""
    cells = members.groupBy("cluster_id", "county").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.lit(as_of) - F.col("year_established")).alias("ages"), F.sum("patent_count").alias("patents"), F.sum("composite_score").alias("scores")
    )
    rate = F.when(F.col("gdp") > 0, 0.1).otherwise(0.05)
    g = cells.join(clusters, "cluster_id").groupBy("county").agg(
        F.sum("n").alias("businesses"), (F.sum("ages") / F.sum("n")).alias("average_age"), F.sum("patents").alias("patents"), F.count_distinct("cluster_id").alias("clusters"),
        (F.sum(F.col("scores") * (1 + rate)) / F.sum("n")).alias("growth"), F.max("market_score").alias("market"),
    )
    youth = F.greatest(F.lit(0.0), (10 - F.col("average_age")) / 10)
    potential = 0.3 * F.col("growth") + 20 * youth + 20 * F.least(F.col("patents") / 10, F.lit(1.0)) + 30 * F.col("market")
    p = F.col("potential")
    zone = F.when(p >= 70, "hot growth").when(p >= 50, "high potential").when(p >= 30, "emerging").otherwise("developing")
    return g.withColumn("potential", F.round(potential, 6)).withColumn("zone", zone)


def join_macro(df: DataFrame, indicators: DataFrame, momentum: DataFrame) -> DataFrame:
    """Adds one column for each of three indicators (indicator, value), and the momentum (sector, momentum) of the code's
    sector; the longest prefix counts. Both tables have a few rows."""
    names = {"unemployment": "macro_unemployment", "gdp_growth": "macro_gdp_growth", "electricity": "energy_cost_index"}
    wide = indicators.groupBy().pivot("indicator", list(names)).agg(F.max("value")).withColumnsRenamed(names)
    sector = F.lit(None).cast("string")
    for prefix in sorted(SECTORS, key=len):
        sector = F.when(F.col("naics_code").startswith(prefix), SECTORS[prefix]).otherwise(sector)
    j = df.withColumn("sector", sector).join(F.broadcast(momentum.withColumnRenamed("momentum", "sector_momentum")), "sector", "left")
    return j.crossJoin(F.broadcast(wide)).drop("sector")  # one row


def innovation_by_type(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Patents and awards expected of types (type, businesses) from what their research costs; unknown types count as mixed."""
    table = spark.createDataFrame([(k, *v) for k, v in RESEARCH.items()], "kind string, rd_intensity double, per_million double, per_hundred double, award_size double, success_rate double")
    kind = F.when(F.col("type").isin(list(RESEARCH)), F.col("type")).otherwise("mixed")
    j = counts.withColumn("kind", kind).join(F.broadcast(table), "kind")
    each, awards = F.col("per_million") * F.col("rd_intensity") * 10, F.col("businesses") * F.col("per_hundred") / 100
    return j.select(
        "type", "businesses", "rd_intensity", each.alias("patents_each"), (each * F.col("businesses")).alias("patents"), F.least(F.lit(100.0), each * 50).alias("innovation_score"),
        awards.alias("awards"), (awards * F.col("award_size")).alias("award_funding"), "success_rate",
    )


def scenario_compare(scenarios: DataFrame, gdp_target: float, jobs_target: float) -> DataFrame:
    """Adds to scenarios (scenario, gdp, jobs, top_score) the shares of the targets in percent, a score of 40 parts output, 30
    jobs, 20 targets and 10 best cluster, its place, and the metrics in which no other scenario is better. Scenarios are few."""
    metrics = ("gdp", "jobs", "top_score")
    most = scenarios.agg(*[F.max(c).alias(f"most_{c}") for c in metrics])
    part = lambda c: F.when(F.col(f"most_{c}") > 0, F.col(c) / F.col(f"most_{c}")).otherwise(0.0)
    reached = {"gdp_achievement": 100 * F.col("gdp") / gdp_target, "jobs_achievement": 100 * F.col("jobs") / jobs_target}
    targets = sum(10 * F.least(F.col(c) / 100, F.lit(1.0)) for c in reached)
    best = F.concat_ws(",", *[F.when(F.col(c) == F.col(f"most_{c}"), c) for c in metrics])
    j = scenarios.crossJoin(F.broadcast(most)).withColumns(reached)  # one row
    scored = j.withColumn("score", F.round(40 * part("gdp") + 30 * part("jobs") + targets + 10 * part("top_score"), 1)).withColumn("best", best)
    return K.ranked(scored.drop(*[f"most_{c}" for c in metrics]), [F.desc("score"), F.asc("scenario")])


def parameter_differences(params: DataFrame, missing: str = "Not set") -> DataFrame:
    """(id, name, value) of the parameters (id, name, value) that are not the same in all scenarios; scenarios without one have
    the ``missing`` value. Parameters of scenarios are a small table."""
    ids = params.select("id").distinct()
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    names = params.groupBy("name").agg(F.count_distinct("value").alias("values"), F.count_distinct("id").alias("ids")).crossJoin(F.broadcast(total))
    differ = names.where("values > 1 or ids < total").select("name")
    every = ids.crossJoin(F.broadcast(differ))  # scenarios and their parameters
    return every.join(params, ["id", "name"], "left").select("id", "name", F.coalesce("value", F.lit(missing)).alias("value"))


def explain_rules(clusters: DataFrame) -> DataFrame:
    """(cluster_id, key_drivers, strengths, risks, recommendations): what the rules say of each cluster, joined by semicolons.

    Rules read the columns named in EXPLANATIONS; a missing value counts as 0."""
    def said(kind: str) -> Column:
        fits = lambda c, sign, limit: F.coalesce(c, F.lit(0)) > limit if sign == ">" else F.coalesce(c, F.lit(0)) < limit
        return F.concat_ws("; ", *[F.when(fits(F.col(c), sign, limit), text) for k, c, sign, limit, text in EXPLANATIONS if k == kind]).alias(kind)

    return clusters.select("cluster_id", *[said(k) for k in ("key_drivers", "strengths", "risks", "recommendations")])
