"""Lookups, filters by industry, derived indices and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type of a code, and what a type needs.
TYPE_OF_CODE = {"484": "logistics", "493": "logistics", "541": "technology", "511": "technology", "325": "biosciences", "621": "biosciences", "311": "food", "112": "animal_health"}
NEEDS = {"logistics": (40, 5), "technology": (20, 2), "biosciences": (30, 3), "manufacturing": (50, 4)}
OCCUPATIONS = {
    "logistics": (("drivers", 0.45, 48_000), ("handlers", 0.30, 36_000), ("planners", 0.10, 70_000)),
    "technology": (("developers", 0.50, 98_000), ("analysts", 0.20, 82_000), ("support", 0.15, 52_000)),
    "manufacturing": (("machinists", 0.35, 47_000), ("assemblers", 0.30, 39_000), ("engineers", 0.10, 88_000)),
}


def type_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TYPE_OF_CODE.items()), "code string, type string")


def type_of(code: Column) -> Column:
    out = F.lit("manufacturing")
    for prefix, kind in TYPE_OF_CODE.items():
        out = F.when(F.substring(code, 1, 3) == prefix, kind).otherwise(out)
    return out


def county_name(county: Column, state: Column) -> Column:
    """One form "X County, ST": an embedded state wins over the column, a missing word County is added."""
    text = F.regexp_replace(F.trim(F.coalesce(county, F.lit(""))), r"\s+", " ")
    embedded = F.regexp_extract(text, r",\s*([A-Za-z]{2})$", 1)
    base = F.initcap(F.regexp_replace(F.regexp_replace(text, r",\s*[A-Za-z]{2}$", ""), r"(?i)\s+county$", ""))
    code = F.upper(F.when(embedded != "", embedded).otherwise(F.coalesce(state, F.lit(""))))
    return F.when(base == "", None).otherwise(F.concat(base, F.lit(" County"), F.when(code != "", F.concat(F.lit(", "), code)).otherwise("")))


def estimated_revenue(employees: Column, code: Column) -> Column:
    """Revenue from employees: a value per employee by code, less for small businesses and more for large ones."""
    each = F.when(code.startswith("5415"), 200_000.0).when(code.startswith("3254"), 400_000.0).when(code.startswith("484"), 180_000.0).otherwise(150_000.0)
    factor = F.when(employees < 10, 0.8).when(employees > 250, 1.2).otherwise(1.0)
    return employees * each * factor


def location_indices(df: DataFrame) -> DataFrame:
    """Five weighted indices of a location from safety, infrastructure, access, development and demographics."""
    s, i, a, d, g = (F.col(c) for c in ("safety", "infrastructure", "access", "development", "demographics"))
    environment = 0.25 * s + 0.25 * d + 0.25 * g + 0.25 * i
    growth = 0.5 * d + 0.5 * g
    return df.withColumns({
        "location_quality": 0.4 * s + 0.3 * i + 0.3 * a, "growth_potential": growth, "environment": environment,
        "adjusted_opportunity": growth * (s / 100), "readiness": 0.3 * i + 0.3 * a + 0.2 * g + 0.2 * environment,
    })


def ml_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clips columns to 0..100, adds two products, a tier of the environment and its indicator columns."""
    out = df.withColumns({c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(60.0)))) for c in columns})
    e = F.col("environment")
    tier = F.when((e > 0) & (e <= 60), "low").when((e > 60) & (e <= 75), "medium").when((e > 75) & (e <= 90), "high").when((e > 90) & (e <= 100), "premium")
    out = out.withColumn("safety_x_infrastructure", F.col("safety") * F.col("infrastructure") / 100).withColumn("growth_x_access", F.col("development") * F.col("access") / 100).withColumn("tier", tier)
    return out.withColumns({f"tier_{t}": F.coalesce(F.col("tier") == t, F.lit(False)).cast("int") for t in ("low", "medium", "high", "premium")})


def flat_params(df: DataFrame, key: str, params: str) -> DataFrame:
    """(key, name, value) from JSON texts of one nested level: names are joined by a dot."""
    outer = df.select(key, F.explode(F.from_json(params, "map<string,string>")).alias("a", "v"))
    inner = outer.select(key, "a", "v", F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), "map<string,string>").alias("m"))
    nested = inner.where("m is not null").select(key, "a", F.explode("m").alias("b", "value")).select(key, F.concat_ws(".", "a", "b").alias("name"), "value")
    return inner.where("m is null").select(key, F.col("a").alias("name"), F.col("v").alias("value")).unionByName(nested)


def without_placeholders(df: DataFrame, column: str, markers: tuple[str, ...] = ("test", "sample", "placeholder", "lorem", "n/a")) -> DataFrame:
    return df.where(~F.lower(F.coalesce(F.col(column), F.lit(""))).rlike("|".join(markers)))


def industry_filters(df: DataFrame, needs: dict[str, tuple[int, int]] = NEEDS) -> DataFrame:
    """Adds the reason why a business fails the least employees and patents of its type; types without needs pass."""
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in needs.items()], "type string, least_employees int, least_patents int")
    joined = df.withColumn("type", type_of(F.col("naics_code"))).join(F.broadcast(table), "type", "left")
    reason = F.when(F.col("employees") < F.col("least_employees"), "employees").when(F.col("patent_count") < F.col("least_patents"), "patents")
    return joined.withColumn("reject_reason", reason).drop("least_employees", "least_patents")


def missing_needs(clusters: DataFrame, needs: DataFrame, items: list[str]) -> DataFrame:
    """(cluster_id, missing): names of the items under the least value that the cluster's type needs, in order of name.

    ``needs`` has (type, item, least), a dimension."""
    amounts = clusters.select("cluster_id", "type", F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("amount")) for i in items])).alias("x")).select("cluster_id", "type", "x.*")
    short = amounts.join(F.broadcast(needs), ["type", "item"], "left").select("cluster_id", F.when(F.coalesce("amount", F.lit(0.0)) < F.col("least"), F.col("item")).alias("item"))
    return short.groupBy("cluster_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("item"))).alias("missing"))


def alignment(clusters: DataFrame, universities: DataFrame) -> DataFrame:
    """Universities of a cluster's counties with the cluster's type among their strengths: sums, a capped score, and
    whether the pairing is recommended. ``clusters`` has (cluster_id, type, county), ``universities`` (county, strengths, funding, graduates, patents)."""
    u = universities.withColumn("type", F.explode("strengths"))
    g = clusters.join(u, ["county", "type"]).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("institutions"), F.sum("graduates").alias("graduates"), F.round(F.sum("funding"), 2).alias("funding"), F.sum("patents").alias("patents")
    )
    money = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("funding")) / 10_000_000)
    score = F.least(F.lit(1.0), F.col("graduates") / 5_000 * 0.4 + money * 0.4 + F.col("patents") / 100 * 0.2)
    return g.withColumn("score", F.round(score, 6)).withColumn("recommended", F.col("score") > 0.5)


def validate_targets(clusters: DataFrame, gdp: float = 50e6, jobs: int = 5_000, roi: float = 1.5, wage: float = 60_000.0) -> DataFrame:
    """Whether clusters (cluster_id, gdp, jobs, p, n) meet the targets, and their share of all GDP and jobs."""
    total = clusters.agg(F.sum("gdp").alias("all_gdp"), F.sum("jobs").alias("all_jobs"))
    return clusters.crossJoin(F.broadcast(total)).select(
        "cluster_id", (F.col("gdp") >= gdp).alias("meets_gdp"), (F.col("jobs") >= jobs).alias("meets_jobs"),
        (F.col("gdp") / F.greatest(F.col("n") * 2e6, F.lit(1.0)) >= roi).alias("meets_roi"), ((F.col("n") >= 20) & (F.col("p") >= 50)).alias("has_infrastructure"),
        (F.col("gdp") / 1.85 / F.greatest(F.col("jobs"), F.lit(1)) >= wage).alias("raises_wages"),
        (F.col("gdp") / F.col("all_gdp")).alias("gdp_contribution"), (F.col("jobs") / F.col("all_jobs")).alias("jobs_contribution"),
    )


def workforce_needs(clusters: DataFrame, years: int, growth: float = 0.05) -> DataFrame:
    """(cluster_id, occupation, need, future_need, gap, wages): jobs by occupation now and after some years."""
    table = clusters.sparkSession.createDataFrame([(t, n, s, float(w)) for t, rows in OCCUPATIONS.items() for n, s, w in rows], "type string, occupation string, share double, wage double")
    j = clusters.join(F.broadcast(table), "type")
    need, future = F.col("employees") * F.col("share"), F.col("employees") * F.col("share") * (1 + growth) ** years
    return j.select("cluster_id", "occupation", need.alias("need"), future.alias("future_need"), (future - need).alias("gap"), (need * F.col("wage")).alias("wages"))


def cluster_report(clusters: DataFrame, value: str) -> DataFrame:
    """Shares of the total and the place of each cluster, with a priority by thirds of the places."""
    w = Window.orderBy(F.desc(value), "cluster_id")  # clusters are few
    total = clusters.agg(F.sum(value).alias("total__"), F.count(F.lit(1)).alias("n__"))
    ranked = clusters.withColumn("place", F.row_number().over(w)).crossJoin(F.broadcast(total))
    third = F.ceil(F.col("place") * 3 / F.col("n__"))
    return ranked.select("cluster_id", value, (F.col(value) / F.col("total__")).alias("share"), "place", F.when(third == 1, "high").when(third == 2, "medium").otherwise("low").alias("priority"))
