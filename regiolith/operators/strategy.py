"""Strategic clusters by industry type: multipliers, critical mass, market and longevity scores, membership."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.operators.scores import clamped

# Needs of codes, weights, chains, risk profiles and market tables of the scores.
NEEDS = {
    "484": ["rail_capacity", "highway_access"], "493": ["rail_capacity", "warehouse_space"], "325": ["university_research", "lab_space"],
    "541": ["broadband_speed", "tech_workforce"], "333": ["skilled_manufacturing", "industrial_power"], "511": ["broadband_speed", "tech_workforce"],
}
CHAINS = {"manufacturing": ["332", "333", "336"], "logistics": ["484", "488", "493"], "tech": ["511", "518", "541"], "life_sciences": ["325", "3254", "5417"]}
CLUSTER_WEIGHTS = {
    "natural_assets_score": 0.20, "infrastructure_score": 0.20, "workforce_score": 0.15, "innovation_capacity_score": 0.15,
    "market_access_score": 0.15, "geopolitical_score": 0.10, "resilience_score": 0.05,
}
RISKS = {
    "political": (0.25, ["trade_policy_exposure", "regulatory_change_risk", "government_dependency", "political_stability"]),
    "market": (0.30, ["demand_volatility", "commodity_price_risk", "technology_disruption", "competitive_intensity"]),
    "financial": (0.20, ["capital_intensity", "credit_availability", "interest_rate_sensitivity", "currency_risk"]),
    "operational": (0.15, ["supply_chain_risk", "workforce_availability", "infrastructure_dependency", "climate_vulnerability"]),
    "strategic": (0.10, ["innovation_capacity", "market_diversification", "strategic_partnerships", "adaptability"]),
}
PROFILES = {
    "logistics": {"trade_policy_exposure": 0.8, "technology_disruption": 0.7, "workforce_availability": 0.6, "infrastructure_dependency": 0.9, "commodity_price_risk": 0.7, "climate_vulnerability": 0.4},
    "biosciences": {"regulatory_change_risk": 0.9, "government_dependency": 0.6, "capital_intensity": 0.9, "innovation_capacity": 0.9, "technology_disruption": 0.3, "market_diversification": 0.7},
    "technology": {"technology_disruption": 0.5, "competitive_intensity": 0.9, "innovation_capacity": 0.9, "workforce_availability": 0.7, "adaptability": 0.8, "capital_intensity": 0.6},
    "manufacturing": {"trade_policy_exposure": 0.7, "commodity_price_risk": 0.8, "infrastructure_dependency": 0.7, "workforce_availability": 0.5, "technology_disruption": 0.6, "regulatory_change_risk": 0.5},
    "animal_health": {"regulatory_change_risk": 0.8, "market_diversification": 0.8, "innovation_capacity": 0.7, "climate_vulnerability": 0.6, "trade_policy_exposure": 0.6, "strategic_partnerships": 0.8},
}
#: Factors of a component's risk under a condition of the market or of politics.
CONDITIONS = {"trade_tensions": ("trade_policy_exposure", 1.3), "regulatory_activity": ("regulatory_change_risk", 1.2), "election_year": ("political_stability", 1.1),
              "volatile_demand": ("demand_volatility", 1.2), "volatile_commodities": ("commodity_price_risk", 1.3), "rising_rates": ("interest_rate_sensitivity", 1.2)}
HORIZONS = [(80, "10+ years"), (60, "5-10 years"), (40, "3-5 years"), (20, "1-3 years")]
GRADES = [(90, "A+"), (85, "A"), (80, "A-"), (75, "B+"), (70, "B"), (65, "B-"), (60, "C+"), (55, "C"), (50, "C-"), (40, "D")]


def cluster_type_of(code: Column) -> Column:
    three = F.substring(code, 1, 3)
    return F.when(three.isin("484", "493"), "logistics").when(three.isin("541", "511"), "technology").when(three.isin("325", "621"), "biosciences").otherwise("manufacturing")


def banded(value: Column, bands: list[tuple[float, object]], other: object) -> Column:
    """The first band whose lower bound the value reaches."""
    out = F.when(value >= bands[0][0], F.lit(bands[0][1]))
    for least, name in bands[1:]:
        out = out.when(value >= least, F.lit(name))
    return out.otherwise(F.lit(other))


def detect_columns(df: DataFrame, patterns: dict[str, str], fill: dict[str, object]) -> DataFrame:
    """Renames the first column whose name matches each pattern (any case), and fills what is missing; reads names only."""
    for name, pattern in patterns.items():
        found = next((c for c in df.columns if re.search(pattern, c, re.IGNORECASE)), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
        elif not found:
            df = df.withColumn(name, F.lit(fill.get(name)))
    return df.fillna({k: v for k, v in fill.items() if k in patterns})


def resource_fit(df: DataFrame, assets: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds resource_fit: needs of the code met in the county, workforce, and the cost index.

    ``assets`` has (county, asset, amount), ``regions`` (county, workforce_availability, skilled_share, cost_index); both
    are dimensions of counties."""
    spark = df.sparkSession
    needs = spark.createDataFrame([(code, asset) for code, wanted in NEEDS.items() for asset in wanted], "code3 string, asset string")
    has = assets.where("amount > 0").select("county", "asset").distinct().withColumn("has", F.lit(1.0))
    pairs = needs.crossJoin(F.broadcast(assets.select("county").distinct())).join(has, ["county", "asset"], "left")  # codes x counties
    met = pairs.groupBy("county", "code3").agg(F.avg(F.coalesce("has", F.lit(0.0))).alias("met"))
    ruled = F.broadcast(spark.createDataFrame([(c,) for c in NEEDS], "code3 string").withColumn("ruled", F.lit(True)))
    j = (
        df.withColumn("code3", F.substring("naics_code", 1, 3)).join(ruled, "code3", "left")
        .join(F.broadcast(met), ["county", "code3"], "left").join(F.broadcast(regions), "county", "left")
    )
    infrastructure = F.when(F.col("ruled"), 40.0 * F.coalesce("met", F.lit(0.0))).otherwise(20.0)
    people, skilled = F.coalesce("workforce_availability", F.lit(10_000)), F.coalesce("skilled_share", F.lit(0.30))
    workforce = F.when((F.col("employees") > 100) & (people > 50_000), 30.0).when((F.col("employees") > 50) & (people > 20_000), 25.0).when(people > 10_000, 20.0).otherwise(10.0)
    workforce = workforce * F.when(F.col("code3").isin("541", "511", "325") & (skilled > 0.40), 1.2).otherwise(1.0)
    cost = F.coalesce("cost_index", F.lit(100))
    points = F.when(cost < 90, 30.0).when(cost < 95, 25.0).when(cost < 100, 20.0).when(cost < 105, 15.0).otherwise(10.0)
    score = F.least(F.lit(100.0), infrastructure + F.least(F.lit(30.0), workforce) + points)
    return j.withColumn("resource_fit", score).select(*df.columns, "resource_fit")


def critical_mass(members: DataFrame, business: DataFrame) -> DataFrame:
    """(cluster_id, critical_mass): share of the potential peers, completeness of supply chains, mix of sizes, density.

    Peers are counted by county and code before they meet the clusters, so no business row is joined to a cluster."""
    code = F.substring("naics_code", 1, 3)
    cells = business.groupBy("county", code.alias("code")).agg(F.count(F.lit(1)).alias("k"))
    counties = members.select("cluster_id", "county").distinct()
    codes = members.select("cluster_id", code.alias("code")).distinct()
    potential = counties.join(cells, "county").join(codes, ["cluster_id", "code"]).groupBy("cluster_id").agg(F.sum("k").alias("potential"))
    table = members.sparkSession.createDataFrame([(chain, len(cs), c) for chain, cs in CHAINS.items() for c in cs], "chain string, parts int, code string")
    present = codes.join(F.broadcast(table), "code").groupBy("cluster_id", "chain", "parts").count().where("count >= 2")
    chains = present.groupBy("cluster_id").agg(F.least(F.lit(25.0), F.sum(F.col("count") / F.col("parts") * 10)).alias("chains"))
    g = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("employees") < 50).alias("small"), F.count_if((F.col("employees") >= 50) & (F.col("employees") < 500)).alias("medium"),
        F.count_if(F.col("employees") >= 500).alias("large"), F.count_distinct("county").alias("counties"),
    )
    j = g.join(potential, "cluster_id", "left").join(chains, "cluster_id", "left")
    n, near = F.col("n"), F.col("counties")
    size = F.least(F.lit(30.0), 30.0 * n / F.greatest(F.coalesce("potential", F.lit(1)), F.lit(1)))
    mix = sum((F.least(F.col(c) / n, F.lit(best)) / best * points for c, best, points in (("medium", 0.3, 10.0), ("large", 0.1, 5.0))), F.least(F.col("small") / n, F.lit(0.6)) / 0.6 * 10.0)
    density = F.when(near <= 2, 20.0).when(near <= 4, 15.0).when(near <= 6, 10.0).otherwise(5.0)
    return j.select("cluster_id", F.least(F.lit(100.0), size + F.coalesce("chains", F.lit(0.0)) + mix + density).alias("critical_mass"))


def component_scores(members: DataFrame, central: list[str], weights: dict[str, float] = CLUSTER_WEIGHTS) -> DataFrame:
    """Seven component scores of each cluster (cluster_id, type, ...) and their weighted total."""
    g = members.groupBy("cluster_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("county").isin(central)).alias("central"), F.sum("employees").alias("employees"),
        F.sum(F.col("patent_count") * 10 + F.col("sbir_awards") * 20).alias("innovation"), F.count_distinct(F.substring("naics_code", 1, 3)).alias("codes"),
    )
    kind, most = F.col("type"), F.lit(100.0)
    scores = {
        "natural_assets_score": F.when(kind == "logistics", 90.0).when(kind == "biosciences", 70.0).otherwise(75.0),
        "infrastructure_score": F.least(most, 60 + F.col("central") / F.col("n") * 40),
        "workforce_score": F.least(most, 50 + F.col("employees") / 100 * 5),
        "innovation_capacity_score": F.least(most, F.col("innovation") / 10),
        "market_access_score": F.when(kind.isin("logistics", "manufacturing"), 85.0).otherwise(75.0),
        "geopolitical_score": F.lit(80.0),
        "resilience_score": F.least(most, 50.0 + F.col("codes") * 10),
    }
    total = sum((scores[k] * w for k, w in weights.items()), F.lit(0.0))
    return g.select("cluster_id", *[c.alias(k) for k, c in scores.items()], total.alias("total_score"))


def research_multiplier(business: DataFrame, near: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds research_multiplier by the funding and number of grants of the type at universities near the county.

    ``near`` has (county, university), ``grants`` (university, type, funding, grants); both are dimensions."""
    strength = near.join(grants, "university").groupBy("county", "type").agg(F.sum("funding").alias("funding__"), F.sum("grants").alias("grants__"))
    j = business.join(F.broadcast(strength), ["county", "type"], "left")
    money = F.when(F.col("funding__") > 10_000_000, 1.25).when(F.col("funding__") > 5_000_000, 1.15).when(F.col("funding__") > 1_000_000, 1.05).otherwise(1.0)
    many = F.when(F.col("grants__") > 10, 1.1).otherwise(1.0)
    return j.withColumn("research_multiplier", money * many).select(*business.columns, "research_multiplier")


def asset_multiplier(business: DataFrame, assets: DataFrame, required: DataFrame, bonus: DataFrame) -> DataFrame:
    """Adds asset_multiplier: the product over required assets that the county has, times the county's bonus for the type.

    ``assets`` has (county, asset), ``required`` (type, asset, multiplier), ``bonus`` (county, type, bonus)."""
    product = assets.select("county", "asset").distinct().join(required, "asset").groupBy("county", "type").agg(F.product("multiplier").alias("product__"))
    j = business.join(F.broadcast(product), ["county", "type"], "left").join(F.broadcast(bonus), ["county", "type"], "left")
    return j.withColumn("asset_multiplier", F.coalesce("product__", F.lit(1.0)) * F.coalesce("bonus", F.lit(1.0))).select(*business.columns, "asset_multiplier")


def strategic_clusters(business: DataFrame, types: DataFrame, score: Column, share: float, quotas: DataFrame, smallest: int) -> DataFrame:
    """(type, business_id, score): members of a cluster for each type, all types in one job.

    ``types`` has (type, prefix): a business goes with every type that one of its prefixes matches. Of each type the
    businesses within ``share`` of the best score stay; ``quotas`` (type, prefix, quota) bounds the members by prefix, in
    order of score. Types with fewer than ``smallest`` members are left out."""
    lengths = sorted(r[0] for r in types.select(F.length("prefix")).distinct().collect())  # lengths of prefixes: a few
    keyed = business.withColumn("score", score).withColumn("prefix", F.explode(F.array_distinct(F.array(*[F.substring("naics_code", 1, n) for n in lengths]))))
    chosen = keyed.join(F.broadcast(types), "prefix")
    one = chosen.groupBy("type", "business_id").agg(F.max("score").alias("score"), F.max_by("prefix", F.length("prefix")).alias("prefix"))
    best = one.groupBy("type").agg(F.max("score").alias("best__"))
    elite = one.join(F.broadcast(best), "type").where(F.col("score") >= F.col("best__") * (1 - share))
    place = F.row_number().over(Window.partitionBy("type", "prefix").orderBy(F.desc("score"), "business_id"))
    kept = elite.withColumn("place__", place).join(F.broadcast(quotas), ["type", "prefix"], "left").where(F.col("place__") <= F.coalesce("quota", F.lit(2**31 - 1)))
    sizes = kept.groupBy("type").count().where(F.col("count") >= smallest)
    return kept.join(F.broadcast(sizes), "type", "left_semi").select("type", "business_id", "score")


def longevity_risk(clusters: DataFrame, conditions: set[str] = frozenset()) -> DataFrame:
    """(cluster_id, <category>_risk, score, grade, horizon, top_risks) of clusters (cluster_id, type, n, codes).

    A type without a profile has 0.5 for each component."""
    spark = clusters.sparkSession
    factors = {CONDITIONS[c][0]: CONDITIONS[c][1] for c in conditions}
    rows = [
        (kind, category, weight, part, min(1.0, profile.get(part, 0.5) * factors.get(part, 1.0)))
        for kind, profile in [*PROFILES.items(), ("", {})] for category, (weight, parts) in RISKS.items() for part in parts
    ]
    table = F.broadcast(spark.createDataFrame(rows, "kind string, category string, weight double, component string, base double"))
    kinds = F.when(F.col("type").isin(list(PROFILES)), F.col("type")).otherwise("")
    size = F.when(F.col("n") > 100, 0.9).when(F.col("n") < 20, 1.1).otherwise(1.0)
    spread = F.when(F.col("component").isin("market_diversification", "adaptability") & (F.col("codes") > 10), 0.8).otherwise(1.0)
    parts = clusters.withColumn("kind", kinds).join(table, "kind").withColumn("risk", clamped(F.col("base") * size * spread, 0.0, 1.0))
    by = parts.groupBy("cluster_id", "category", "weight").agg(F.avg("risk").alias("risk"))
    wide = by.groupBy("cluster_id").agg(
        *[F.max(F.when(F.col("category") == c, F.col("risk"))).alias(f"{c}_risk") for c in RISKS], ((1 - F.sum(F.col("risk") * F.col("weight"))) * 100).alias("score")
    )
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("risk", 6)), "component"))
    top = parts.withColumn("place", place).where("place <= 3").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "component"))).alias("top"))
    named = wide.join(top, "cluster_id").withColumn("top_risks", F.concat_ws(",", F.transform("top", lambda x: x["component"]))).drop("top")
    return named.withColumn("score", F.round("score", 1)).withColumn("grade", banded(F.col("score"), GRADES, "F")).withColumn("horizon", banded(F.col("score"), HORIZONS, "<1 year"))


def market_score(spark: SparkSession, indicators: DataFrame) -> DataFrame:
    """(type, market_score) of four types under the indicators (indicator, value), a table of a few rows."""
    wide = indicators.groupBy().pivot("indicator", ["gdp_growth", "unemployment", "diesel", "truck_tonnage", "healthcare_employment", "tech_employment", "manufacturing_production"]).agg(F.max("value"))
    types = spark.createDataFrame([(t,) for t in ("logistics", "biosciences", "technology", "manufacturing")], "type string")

    def step(c: str, high: float, up: float, low: float | None = None, down: float = 0.0) -> Column:
        out = F.when(F.col(c) > high, up)
        return (out.when(F.col(c) < low, down) if low is not None else out).otherwise(0.0)

    kind = F.col("type")
    own = F.when(kind == "logistics", step("diesel", 4.0, -0.15, 3.0, 0.15) + step("truck_tonnage", 110, 0.1)).when(kind == "biosciences", step("healthcare_employment", 100, 0.15))
    own = own.when(kind == "technology", step("tech_employment", 100, 0.1)).otherwise(step("manufacturing_production", 105, 0.15, 95, -0.15))
    score = clamped(0.5 + step("gdp_growth", 3.0, 0.1, 1.0, -0.1) + step("unemployment", 6.0, -0.1, 4.0, 0.1) + own, 0.0, 1.0)
    return types.crossJoin(F.broadcast(wide)).select("type", score.alias("market_score"))


#: Growth of output at which growth rates of types are as given.
USUAL_GROWTH = 2.5


def scaled_growth(rates: DataFrame, indicators: DataFrame) -> DataFrame:
    """(type, growth_rate, scaled): growth rates of types times the growth of output over its usual one; as given if that is unknown.

    ``indicators`` (indicator, value) is a table of a few rows."""
    gdp = indicators.agg(F.max(F.when(F.col("indicator") == "gdp_growth", F.col("value"))).alias("gdp"))  # one row
    return rates.crossJoin(F.broadcast(gdp)).select("type", "growth_rate", (F.col("growth_rate") * F.coalesce(F.col("gdp") / USUAL_GROWTH, F.lit(1.0))).alias("scaled"))


def market_opportunity(clusters: DataFrame, market: DataFrame) -> DataFrame:
    """Market funnel, share and a 100-point score of clusters (cluster_id, type, revenue).

    ``market`` has (type, market_size, growth_rate, concentration, opportunities, threats), a row for each type."""
    j = clusters.join(F.broadcast(market), "type")
    size, growth = F.col("market_size"), F.col("growth_rate")
    local, obtainable = size * 0.02, size * 0.02 * 0.5 * 0.3
    score = (
        F.least(growth * 300, F.lit(30.0)) + F.when(size > 1e12, 20).when(size > 1e11, 15).when(size > 1e10, 10).otherwise(5)
        + F.when(obtainable > 1e9, 20).when(obtainable > 1e8, 15).when(obtainable > 1e7, 10).otherwise(5)
        + F.when(F.col("concentration") < 1500, 15).when(F.col("concentration") < 2500, 10).otherwise(5)
        + F.when(F.col("opportunities") > F.col("threats") * 2, 15).when(F.col("opportunities") > F.col("threats"), 10).otherwise(5)
    )
    return j.select(
        "cluster_id", size.alias("total_market"), local.alias("geographic_market"), (local * 0.5).alias("serviceable_market"), obtainable.alias("obtainable_market"),
        (F.col("revenue") / local * 100).alias("current_share"), (F.try_divide(local * 0.05, F.col("revenue")) - 1).alias("growth_required"), F.least(score, F.lit(100.0)).alias("market_score"),
    )


def topic_reports(topics: dict[str, DataFrame]) -> DataFrame:
    """(topic, cluster_id, value, share, place) for frames of (cluster_id, value): shares of the topic's total and places."""
    every = [df.select(F.lit(t).alias("topic"), "cluster_id", F.col("value").cast("double").alias("value")) for t, df in topics.items()]
    rows = every[0]
    for df in every[1:]:
        rows = rows.unionByName(df)
    w = Window.partitionBy("topic")  # clusters are few
    return rows.withColumn("share", F.try_divide("value", F.sum("value").over(w))).withColumn("place", F.row_number().over(w.orderBy(F.desc("value"), "cluster_id")))


def resolve_membership(rows: DataFrame, business: DataFrame, tiers: list[tuple[str, list[Column]]]) -> DataFrame:
    """Adds business_id and the tier that found it to cluster rows (row_id, ...); both are null if none did.

    A tier is a name and key columns that both sides can compute; a null key finds nothing. Of businesses with an equal key
    the least id counts. Only rows that no earlier tier found go to the next one."""
    out, left = None, rows
    for name, keys in tiers:
        known = F.lit(True)
        for k in keys:
            known = known & k.isNotNull()
        key = F.when(known, F.concat_ws("\u0001", *[k.cast("string") for k in keys]))
        index = business.withColumn("key__", key).where("key__ is not null").groupBy("key__").agg(F.min("business_id").alias("business_id"))
        hits = left.withColumn("key__", key).join(index, "key__").drop("key__").withColumn("tier", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select("row_id"), "row_id", "left_anti")
    rest = left.withColumn("business_id", F.lit(None).cast("long")).withColumn("tier", F.lit(None).cast("string"))
    return rest if out is None else out.withColumn("business_id", F.col("business_id").cast("long")).unionByName(rest)


def resolve_by_name(rest: DataFrame, business: DataFrame, least: float = 0.92) -> DataFrame:
    """Rows (row_id, name, ...) that no exact tier found, by the business name of the highest matching-block ratio, ``least``
    or more; of names with an equal ratio the last one, of businesses with an equal name the least id.

    Candidates come from the index of alike names: a ratio of matching blocks is at most the indel ratio."""
    from regiolith.operators.matching import sequence_ratio_column
    from regiolith.operators.names import likely_pairs

    names = rest.where("business_id is null").select(F.col("name").alias("id"), F.lit("").alias("block"), "name").distinct()
    known = business.groupBy("name").agg(F.min("business_id").alias("id")).select("id", F.lit("").alias("block"), "name")
    pairs = likely_pairs(names, known, 100 * least).withColumn("ratio", sequence_ratio_column()("right_name", "left_name")).where(F.col("ratio") >= least)
    found = pairs.groupBy(F.col("left_name").alias("name")).agg(F.max_by("right_id", F.struct("ratio", "right_name")).alias("near"))
    j = rest.join(found, "name", "left")
    by_name = F.col("business_id").isNull() & F.col("near").isNotNull()
    return j.withColumn("tier", F.when(by_name, "fuzzy").otherwise(F.col("tier"))).withColumn("business_id", F.coalesce("business_id", "near")).select(rest.columns)


def membership_report(resolved: DataFrame) -> DataFrame:
    """(cluster_id, members, matched, fuzzy, unmatched): how the rows of each cluster were found."""
    count = lambda c: F.count(F.when(c, 1))
    return resolved.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("members"), count(F.col("business_id").isNotNull()).alias("matched"),
        count(F.col("tier") == "fuzzy").alias("fuzzy"), count(F.col("business_id").isNull()).alias("unmatched"),
    )


def correct_coordinates(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points (id, latitude, longitude, ring): not usable ones move to the mean of the ring's corners, ones outside of
    their ring to the nearest place of its edges; others, and those without a known ring, stay.

    ``rings`` has (ring, edges array<struct<lat1, lon1, lat2, lon2>>), a dimension."""
    corners = F.transform("edges", lambda e: e["lat1"]), F.transform("edges", lambda e: e["lon1"])
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    table = rings.select("ring", "edges", mean(corners[0]).alias("mid_lat"), mean(corners[1]).alias("mid_lon"))
    j = points.join(F.broadcast(table), "ring", "left")
    lat, lon = F.col("latitude"), F.col("longitude")
    usable = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))

    def crosses(e: Column) -> Column:
        at = e["lon1"] + (lat - e["lat1"]) * F.try_divide(e["lon2"] - e["lon1"], e["lat2"] - e["lat1"])
        return ((e["lat1"] > lat) != (e["lat2"] > lat)) & F.coalesce(lon < at, F.lit(False))

    def nearest(e: Column) -> Column:
        dy, dx = e["lat2"] - e["lat1"], e["lon2"] - e["lon1"]
        t = clamped(F.coalesce(F.try_divide((lat - e["lat1"]) * dy + (lon - e["lon1"]) * dx, dy * dy + dx * dx), F.lit(0.0)), 0.0, 1.0)
        y, x = e["lat1"] + t * dy, e["lon1"] + t * dx
        return F.struct(((lat - y) * (lat - y) + (lon - x) * (lon - x)).alias("d"), y.alias("y"), x.alias("x"))

    inside = F.size(F.filter("edges", crosses)) % 2 == 1
    j = j.withColumn("moved", F.when(F.col("edges").isNull(), None).when(~usable, "centre").when(~inside, "edge"))
    j = j.withColumn("snap", F.when(F.col("moved") == "edge", F.array_min(F.transform("edges", nearest))))
    pick = lambda mid, snap, old: F.when(F.col("moved") == "centre", mid).when(F.col("moved") == "edge", snap).otherwise(old)
    return j.select("id", pick(F.col("mid_lat"), F.col("snap.y"), lat).alias("latitude"), pick(F.col("mid_lon"), F.col("snap.x"), lon).alias("longitude"), "moved")


def clustering_features(df: DataFrame, assets: DataFrame, top: int = 10) -> DataFrame:
    """(business_id, features): logarithms of metrics, the county's infrastructure, and the commonest codes as one-hot,
    all standardised. ``assets`` has (county, and numeric columns), a dimension."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    code = F.substring("naics_code", 1, 3)
    common = [r["code"] for r in df.groupBy(code.alias("code")).count().orderBy(F.desc("count"), "code").limit(top).collect()]
    extra = [c for c in assets.columns if c != "county"]
    j = df.join(F.broadcast(assets), "county", "left").select(
        "business_id", *[F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in ("employees", "revenue_estimate", "patent_count", "sbir_awards")],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in extra], *[(code == c).cast("double").alias(f"code_{c}") for c in common],
    )
    stages = [VectorAssembler(inputCols=[c for c in j.columns if c != "business_id"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    return Pipeline(stages=stages).fit(j).transform(j).select("business_id", "features")


#: Rows that a task of the search for k takes; each of its many passes sends one small result a task to the driver.
ROWS_A_TASK = 50_000


def choose_k(features: DataFrame, economy: DataFrame, least: int = 2, most: int = 10, targets: bool = False) -> DataFrame:
    """(k, silhouette, davies_bouldin, calinski_harabasz, viability, combined, chosen) for each number of groups.

    Dispersion comes from sums by group and the centres, which the model holds. ``economy`` has (business_id, employees,
    revenue_estimate); viability is the share of groups of 15 businesses and a fair share of jobs and revenue.

    Rows are dealt by id to so many tasks as their number asks for, in the order of their ids: the passes then have no
    nearly empty tasks, and the result does not depend on how the input lies."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array

    from regiolith.operators.graph import materialised

    spark = features.sparkSession
    features = materialised(features.join(economy, "business_id"))
    n = features.count()
    features = features.repartition(max(1, -(-n // ROWS_A_TASK)), "business_id").sortWithinPartitions("business_id").cache()
    rows = []
    try:
        for k in range(least, max(least, min(most, n // 15)) + 1):
            model = KMeans(k=k, seed=42, maxIter=20).fit(features)
            found = model.transform(features)
            silhouette = ClusteringEvaluator().evaluate(found)
            centres = np.array([c.tolist() for c in model.clusterCenters()])
            table = F.broadcast(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "prediction int, centre array<double>"))
            squared = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
            sums = found.join(table, "prediction").withColumn("d2", squared).groupBy("prediction").agg(
                F.count(F.lit(1)).alias("n"), F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("scatter"), F.sum("employees").alias("jobs"), F.sum("revenue_estimate").alias("revenue"))
            g = sums.orderBy("prediction").toPandas()  # k rows
            mine = centres[g["prediction"]]
            gap = np.sqrt(((mine[:, None] - mine[None]) ** 2).sum(-1)) + np.where(np.eye(len(g)) > 0, np.inf, 0)
            scatter = g["scatter"].to_numpy()
            db = float(((scatter[:, None] + scatter[None]) / gap).max(axis=1).mean())
            middle = (g["n"].to_numpy()[:, None] * mine).sum(0) / n
            between = float((g["n"].to_numpy() * ((mine - middle) ** 2).sum(1)).sum())
            ch = between / max(len(g) - 1, 1) / max(float(g["within"].sum()) / max(n - len(g), 1), 1e-12)
            fair = [(g[c] >= 0.5 * g[c].sum() / len(g)) for c in ("jobs", "revenue")]
            viable = float(((g["n"] >= 15) & fair[0] & fair[1]).mean())
            combined = 0.3 * (silhouette + 1) / 2 + 0.2 / (1 + db) + 0.2 * min(ch / 1000, 1) + 0.3 * viable + (0.05 * (k - 2) / 8 if 5 <= k <= 10 else 0.0)
            rows.append((k, float(silhouette), db, ch, viable, combined))
    finally:
        features.unpersist()
    pool = [r for r in rows if targets and r[4] > 0.8] or rows
    best = max(pool, key=lambda r: (r[5], -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, davies_bouldin double, calinski_harabasz double, viability double, combined double, chosen boolean")
