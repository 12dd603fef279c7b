"""Economic projections of businesses and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions import text as T

# Multipliers, growth and revenue per employee of the projections.
GDP_MULTIPLIER, JOB_MULTIPLIER, GROWTH, JOB_SHARE, CONFIDENCE = 1.85, 2.2, 0.06, 0.8, 0.15
BASE_GROWTH = {"logistics": 0.067, "technology": 0.085, "biosciences": 0.072, "manufacturing": 0.038, "animal_health": 0.058}
SIZE_FACTORS = {
    "logistics": (1.2, 1.0, 0.8), "technology": (1.5, 1.2, 0.9), "biosciences": (0.8, 1.3, 1.0), "manufacturing": (1.1, 1.0, 0.95), "animal_health": (1.2, 1.1, 0.9),
}
REVENUE_EACH = {
    "logistics": (180_000, 220_000, 250_000), "technology": (150_000, 300_000, 500_000), "biosciences": (200_000, 400_000, 600_000),
    "manufacturing": (150_000, 200_000, 280_000), "animal_health": (250_000, 350_000, 450_000),
}
#: setting: multipliers of output and jobs, and the share that friction leaves.
SETTINGS = {"calibrated": (1.85, 2.2, 0.8), "no_friction": (1.85, 2.2, 1.0), "uncalibrated": (1.0, 1.0, 1.0)}


def rounded_half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def economic_impact(members: DataFrame, years: int = 5) -> DataFrame:
    """Output and jobs of each cluster after some years, with bounds.

    The job multiplier works on new jobs only. The largest strategic multiplier among the five most frequent
    4-digit codes (ties to the smaller code) scales both; total jobs are direct plus indirect ones."""
    counts = members.groupBy("cluster_id", F.substring("naics_code", 1, 4).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "code")
    top = counts.withColumn("nth", F.row_number().over(w)).where("nth <= 5")
    strategic = (
        F.when(F.col("code").startswith("3254"), 1.25).when(F.col("code").startswith("54"), 1.20).when(F.col("code").rlike("^(484|493|52)"), 1.15).otherwise(1.0)
    )
    best = top.groupBy("cluster_id").agg(F.max(strategic).alias("strategic"))
    base = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("businesses"), F.sum("revenue_estimate").alias("revenue"), F.sum("employees").alias("employees"))
    j = base.join(best, "cluster_id")
    new_jobs = F.col("employees") * ((1 + GROWTH * JOB_SHARE) ** years - 1)
    gdp = F.col("revenue") * (1 + GROWTH) ** years * GDP_MULTIPLIER * F.col("strategic")
    total = rounded_half_even((F.col("employees") + new_jobs * JOB_MULTIPLIER) * F.col("strategic"))
    direct = rounded_half_even((F.col("employees") + new_jobs) * F.col("strategic"))
    out = j.withColumn("gdp_impact", gdp).withColumn("total_jobs", total).withColumn("direct_jobs", direct)
    return out.select(
        "cluster_id", "businesses", "revenue", "employees", "strategic", "gdp_impact", "total_jobs", "direct_jobs",
        F.greatest(F.lit(0), F.col("total_jobs") - F.col("direct_jobs")).alias("indirect_jobs"),
        (F.col("gdp_impact") * (1 - CONFIDENCE)).alias("gdp_lower"), (F.col("gdp_impact") * (1 + CONFIDENCE)).alias("gdp_upper"),
    )


def by_class(industry: Column, size: Column, table: dict[str, tuple]) -> Column:
    out = F.lit(None).cast("double")
    for name, values in table.items():
        value = F.when(size == "small", float(values[0])).when(size == "medium", float(values[1])).otherwise(float(values[2]))
        out = F.when(industry == name, value).otherwise(out)
    return out


def along_curve(curve: Column, now: Column, rate: Column, age: Column, k: Column) -> Column:
    """The value k years on: exponential, logistic to 10 times the value, late logistic to 20 times, or linear."""
    logistic = lambda most, steep, middle: now * most / (1 + F.exp(-rate * steep * (age + k - middle)))
    return (
        F.when(curve == "exponential", now * F.pow(1 + rate, k)).when(curve == "sigmoid", logistic(10, 2.0, 10))
        .when(curve == "delayed_sigmoid", logistic(20, 1.5, 15)).otherwise(now * (1 + rate * k))
    )


def yearly_growth_path(df: DataFrame, years: int, as_of: int) -> DataFrame:
    """(id, year, value, growth, lower, upper) of rows (id, value, rate, age, curve): the value of each following year, its
    growth over the year before (null from 0) and the interval of 95 %.

    The year before is computed from the same row, so no window is needed."""
    long = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(years))))
    at = lambda k: along_curve(F.col("curve"), F.col("value"), F.col("rate"), F.col("age"), k)
    before = F.when(F.col("k") == 1, F.col("value")).otherwise(at(F.col("k") - 1))
    path = long.select("id", (F.lit(as_of) + F.col("k")).alias("year"), at(F.col("k")).alias("value"), before.alias("before"))
    return path.select("id", "year", "value", (F.try_divide("value", "before") - 1).alias("growth"), *interval(F.col("value")))


def interval(value: Column) -> list[Column]:
    """The bounds of 95 % around a projected value."""
    return [(value * (1 - 1.96 * CONFIDENCE)).alias("lower"), (value * (1 + 1.96 * CONFIDENCE)).alias("upper")]


def business_projection(df: DataFrame, years: int, as_of: int) -> DataFrame:
    """(business_id, year, revenue, employees, lower, upper) for each of the following years.

    Growth is that of the industry times factors of size, age and quality; the path is exponential, logistic,
    late logistic or linear by industry."""
    industry, size = T.growth_industry(F.col("naics_code")), T.size_class(F.col("employees"))
    age = F.greatest(F.lit(0), F.lit(as_of) - F.col("year_established"))
    base = df.select("business_id", "revenue_estimate", "employees", "composite_score", industry.alias("industry"), size.alias("size"), age.alias("age"))
    i, a, q = F.col("industry"), F.col("age"), F.col("composite_score")
    maturity = (
        F.when(i == "technology", F.when(a < 3, 1.5).when(a < 7, 1.2).when(a < 15, 1.0).otherwise(0.8))
        .when(i.isin("logistics", "animal_health"), F.when(a < 3, 0.8).when(a < 10, 1.3).otherwise(0.9))
        .when(i == "biosciences", F.when(a < 5, 0.5).when(a < 12, 1.5).otherwise(1.0))
        .otherwise(1.0)
    )
    quality = F.when(q >= 80, 1.3).when(q >= 65, 1.15).when(q >= 50, 1.0).when(q >= 35, 0.85).otherwise(0.7)
    growth = F.lit(0.0)
    for name, g in BASE_GROWTH.items():
        growth = F.when(i == name, g).otherwise(growth)
    rated = base.withColumn("rate", growth * by_class(i, F.col("size"), SIZE_FACTORS) * maturity * quality).withColumn("each", by_class(i, F.col("size"), REVENUE_EACH))
    long = rated.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(years))))
    r, k, now = F.col("rate"), F.col("k"), F.col("revenue_estimate")
    curve = F.when(i == "technology", "exponential").when(i.isin("logistics", "animal_health"), "sigmoid").when(i == "biosciences", "delayed_sigmoid").otherwise("linear")
    out = long.withColumn("revenue", along_curve(curve, now, r, a, k))
    return out.select(
        "business_id", (F.lit(as_of) + F.col("k")).alias("year"), "industry", "revenue",
        F.floor(F.col("employees") * 0.7 + F.floor(F.col("revenue") / F.col("each")) * 0.3).alias("employees"),
        *interval(F.col("revenue")),
    )


def cluster_projection(projected: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, year, revenue, employees, growth): yearly totals and growth over the year before."""
    joined = projected.join(members.select("business_id", "cluster_id"), "business_id")
    totals = joined.groupBy("cluster_id", "year").agg(F.sum("revenue").alias("revenue"), F.sum("employees").alias("employees"))
    before = F.lag("revenue").over(Window.partitionBy("cluster_id").orderBy("year"))
    return totals.withColumn("growth", F.try_divide(F.col("revenue"), before) - 1)


def demand_path(df: DataFrame, size: str, growth: str, years: int) -> DataFrame:
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(years)))).withColumn("demand", F.col(size) * F.pow(1 + F.col(growth), F.col("k")))


def backtest(outcomes: DataFrame) -> DataFrame:
    """One row: mean realisation and the mean absolute error in percent before and after scaling by it; zeros are ignored."""
    usable = outcomes.where("actual <> 0 and projected <> 0")
    rate = usable.agg(F.avg(F.col("actual") / F.col("projected")).alias("rate"))
    error = lambda p: 100 * F.abs(F.col("actual") - p) / F.abs(F.col("actual"))
    joined = usable.crossJoin(F.broadcast(rate))
    return joined.agg(F.max("rate").alias("rate"), F.avg(error(F.col("projected"))).alias("before"), F.avg(error(F.col("projected") * F.col("rate"))).alias("after"))


def what_if(clusters: DataFrame, settings: dict[str, tuple[float, float, float]], base: str) -> DataFrame:
    """(setting, gdp, jobs, gdp_delta, jobs_delta): means over clusters (revenue, employees) under each setting, and their
    differences in percent from the ``base`` setting; 0 where that mean is not positive."""
    rows = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(f).alias("f")) for n, (m, k, f) in settings.items()])
    each = clusters.select("revenue", "employees", F.explode(rows).alias("s")).select("revenue", "employees", "s.*")
    means = each.groupBy("setting").agg(F.avg(F.col("revenue") * F.col("m") * F.col("f")).alias("gdp"), F.avg(F.bround(F.col("employees") * F.col("k") * F.col("f"), 0)).alias("jobs"))
    plain = means.where(F.col("setting") == base).select(F.col("gdp").alias("g0"), F.col("jobs").alias("j0"))
    delta = lambda x, x0: F.when(F.col(x0) > 0, (F.col(x) - F.col(x0)) / F.col(x0) * 100).otherwise(0.0)
    joined = means.crossJoin(F.broadcast(plain))  # one row
    return joined.select("setting", "gdp", "jobs", delta("gdp", "g0").alias("gdp_delta"), delta("jobs", "j0").alias("jobs_delta"))
