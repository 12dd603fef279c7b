"""Queries for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import clusters as K
from regiolith.operators import rollups as R
from regiolith.plans.registry import query
from regiolith.plans.views import view

AS_OF = 2024


def rounded(df, digits=6, **kinds):
    """Doubles rounded, so that the order of sums does not show."""
    return df.select([F.round(c, kinds.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("E3_industry_counts", "select substr(naics_code, 1, 3) code, count(*) n, median(employees) median_employees, round(median(revenue_estimate), 4) median_revenue from business group by 1")
def industry_counts(spark, sf_dir):
    b = view(spark, sf_dir, "business").groupBy(F.substring("naics_code", 1, 3).alias("code"))
    return b.agg(F.count(F.lit(1)).alias("n"), F.median("employees").alias("median_employees"), F.round(F.median("revenue_estimate"), 4).alias("median_revenue"))


@query("E4_infrastructure_totals", "select sum(p_retailprice) filter (where p_type like 'STEEL%') steel, count(*) filter (where p_size > 25) large, count(*) total from part".replace("sum(p_retailprice)", "round(sum(p_retailprice)").replace("'STEEL%')", "'STEEL%'), 2)"))
def infrastructure_totals(spark, sf_dir):
    steel = F.sum(F.when(F.col("p_type").startswith("STEEL"), F.col("p_retailprice")))
    return view(spark, sf_dir, "part").agg(F.round(steel, 2).alias("steel"), F.count_if(F.col("p_size") > 25).alias("large"), F.count(F.lit(1)).alias("total"))


MULTIPLIER = """coalesce(case substr(naics_code, 1, 4) when '3254' then 2.1 when '5415' then 2.3 when '3253' then 1.9 end,
  case substr(naics_code, 1, 3) when '484' then 1.8 when '493' then 1.7 when '332' then 1.6 end, 1.7)"""


@query("E5_weighted_multiplier", f"select cluster_id, round(sum(revenue_estimate * cast({MULTIPLIER} as double)), 2) impact, round(avg(cast({MULTIPLIER} as double)), 6) multiplier from member group by cluster_id")
def weighted_multiplier(spark, sf_dir):
    return rounded(R.weighted_multiplier(view(spark, sf_dir, "member"), R.EMPLOYMENT_MULTIPLIERS, 1.7), impact=2)


@query("D7_prefix_lookup", f"select business_id, cast({MULTIPLIER} as double) multiplier from business")
def prefix_lookup(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    from regiolith.operators.enrich import constant_table

    return R.prefix_lookup(b, "naics_code", constant_table(spark, R.EMPLOYMENT_MULTIPLIERS), 1.7, "multiplier").select("business_id", "multiplier")


@query("E6_crime_by_zip", "select zip, count(*) incidents, round(avg(case category when 'purchase' then 3 when 'click' then 2 else 1 end), 6) severity from crime group by zip")
def crime_by_zip(spark, sf_dir):
    return rounded(R.crime_by_zip(view(spark, sf_dir, "crime")))


@query(
    "E7_community_details",
    """with t as (select cluster_id, count(*) businesses, avg(employees) average_employees, sum(revenue_estimate) revenue, avg(2024 - year_established) average_age,
      count(*) filter (where employees < 50) small, count(*) filter (where employees >= 50 and employees < 500) medium, count(*) filter (where employees >= 500) large from member group by 1),
    c as (select cluster_id, substr(naics_code, 1, 3) code, count(*) n from member group by 1, 2),
    r as (select *, row_number() over (partition by cluster_id order by n desc, code) k from c),
    top as (select cluster_id, string_agg(code, ',' order by k) top_industries from r where k <= 3 group by 1)
    select cluster_id, businesses, round(average_employees, 6) average_employees, round(revenue, 2) revenue, round(average_age, 6) average_age, small, medium, large, top_industries from t join top using (cluster_id)""",
)
def community_details(spark, sf_dir):
    return rounded(R.community_details(view(spark, sf_dir, "member"), AS_OF), revenue=2)


@query(
    "E8_cluster_metrics",
    """select cluster_id, count(*) businesses, cast(sum(employees) as bigint) employees, round(sum(revenue_estimate), 2) revenue, round(avg(2024 - year_established), 6) average_age,
    cast(sum(patent_count * 10 + sbir_awards * 20) as bigint) innovation, count(distinct substr(naics_code, 1, 3)) industries, count(distinct county) counties from member group by cluster_id""",
)
def cluster_metrics(spark, sf_dir):
    return rounded(K.metrics(view(spark, sf_dir, "member"), AS_OF), revenue=2)


@query("E9_distinct_counts", "select state, count(distinct county) counties, count(distinct substr(naics_code, 1, 3)) codes from business group by state")
def distinct_counts(spark, sf_dir):
    return view(spark, sf_dir, "business").groupBy("state").agg(F.count_distinct("county").alias("counties"), F.count_distinct(F.substring("naics_code", 1, 3)).alias("codes"))


SHARES = "with c as (select cluster_id, county k, count(*) n from member group by 1, 2), s as (select cluster_id, k, n, n / sum(n) over (partition by cluster_id) p from c) "


@query("E10_hhi", SHARES + "select cluster_id, round(sum(p * p), 6) hhi from s group by 1")
def hhi(spark, sf_dir):
    return rounded(K.hhi(view(spark, sf_dir, "member"), "cluster_id", F.col("county")))


@query("E11_shannon", SHARES + "select cluster_id, round(case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end, 6) evenness from s group by 1")
def shannon(spark, sf_dir):
    return rounded(K.shannon(view(spark, sf_dir, "member"), "cluster_id", F.col("county")))


@query(
    "E12_gini",
    """with r as (select cluster_id, employees x, row_number() over (partition by cluster_id order by employees) i, count(*) over (partition by cluster_id) n from member where employees > 0)
    select cluster_id, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) gini from r group by 1""",
)
def gini(spark, sf_dir):
    return rounded(K.gini(view(spark, sf_dir, "member"), "cluster_id", "employees"))


@query(
    "E13_patent_portfolio",
    """with t as (select assignee, count(*) patents, cast(sum(citations) as bigint) citations, avg(citations) average_citations, count(*) filter (where citations > 10) breakthroughs, min(grant_year) first_year, max(grant_year) last_year from patent group by 1),
    c as (select assignee, code, count(*) n from (select assignee, cpc1 code from patent union all select assignee, cpc2 from patent) group by 1, 2),
    s as (select assignee, n / sum(n) over (partition by assignee) p from c), d as (select assignee, -sum(p * ln(p)) / ln(3) diversity, max(p) top_share from s group by 1)
    select assignee, patents, citations, round(average_citations, 6) average_citations, breakthroughs, first_year, last_year, round(diversity, 6) diversity, round(top_share, 6) top_share,
      round(patents / (last_year - first_year + 1), 6) velocity, round(breakthroughs / patents, 6) breakthrough_ratio from t join d using (assignee)""",
)
def patent_portfolio(spark, sf_dir):
    return rounded(R.patent_portfolio(view(spark, sf_dir, "patent"), "assignee"))


@query(
    "E14_patent_statistics",
    """select count(*) as "rows", cast(sum(patent_count) as bigint) total, count(*) filter (where patent_count > 0) holders, round(count(*) filter (where patent_count > 0) / count(*), 6) share,
    round(avg(patent_count) filter (where patent_count > 0), 6) per_holder, count(*) filter (where patent_count between 1 and 2) few, count(*) filter (where patent_count between 3 and 4) middling, count(*) filter (where patent_count >= 5) many from business""",
)
def patent_statistics(spark, sf_dir):
    return rounded(R.holder_statistics(view(spark, sf_dir, "business"), "patent_count"))


@query(
    "E15_awards_rollup",
    "select agency, phase, cast(award_year as varchar) award_year, count(*) awards, round(sum(amount), 2) funding, count(distinct company) companies from award group by grouping sets ((agency), (phase), (award_year), ())",
)
def awards_rollup(spark, sf_dir):
    out = R.awards_rollup(view(spark, sf_dir, "award"))
    return rounded(out.withColumn("award_year", F.col("award_year").cast("string")), funding=2)


@query(
    "E16_awards_distribution",
    "select cluster_id, count(award_id) awards, round(coalesce(sum(amount), 0), 2) funding, round(sum(amount) / nullif(count(award_id), 0), 4) average from member left join award using (business_id) group by 1",
)
def awards_distribution(spark, sf_dir):
    m = view(spark, sf_dir, "member").select("cluster_id", "business_id").join(view(spark, sf_dir, "award"), "business_id", "left")
    out = m.groupBy("cluster_id").agg(F.count("award_id").alias("awards"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("funding"))
    return out.select("cluster_id", "awards", F.round("funding", 2).alias("funding"), F.round(F.try_divide("funding", "awards"), 4).alias("average"))


@query(
    "E17_innovation_leaders",
    """with f as (select company, count(*) awards, sum(amount) funding, max(award_year) last_year, bool_or(phase = 'Phase II') reached_second, count(distinct agency) agencies from award group by 1)
    select company, awards, round(funding, 2) funding, last_year, reached_second, agencies, round(least(40.0, awards * 2.0) + least(40.0, funding / 100000) + case when reached_second then 10 else 0 end + least(10, agencies * 2), 4) score
    from f where awards >= 12 or funding >= 3000000""",
)
def innovation_leaders(spark, sf_dir):
    return rounded(R.innovation_leaders(view(spark, sf_dir, "award"), 12, 3e6), funding=2, score=4)


@query("E18_grants_by_topic", "select case when lower(cpc1) like '%steel%' then 'steel' else 'other' end topic, count(*) n, cast(sum(citations) as bigint) citations from patent group by 1")
def grants_by_topic(spark, sf_dir):
    topic = F.when(F.lower("cpc1").contains("steel"), "steel").otherwise("other")
    return view(spark, sf_dir, "patent").groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("citations").alias("citations"))


@query(
    "E19_exports_by_country",
    """with c as (select county country, sum(amount) total from award join business using (business_id) group by 1), s as (select country, total, total / sum(total) over () share from c)
    select country, round(total, 2) total, round(share, 6) share, case when share > 0.05 then 'high' when share > 0.04 then 'medium' else 'low' end band from s order by total desc, country limit 20""",
)
def exports_by_country(spark, sf_dir):
    from pyspark.sql import Window

    a = view(spark, sf_dir, "award").join(view(spark, sf_dir, "business").select("business_id", F.col("county").alias("country")), "business_id")
    s = a.groupBy("country").agg(F.sum("amount").alias("total")).withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))))
    band = F.when(F.col("share") > 0.05, "high").when(F.col("share") > 0.04, "medium").otherwise("low")
    return rounded(s.withColumn("band", band).orderBy(F.desc("total"), "country").limit(20), total=2)


@query(
    "E25_data_profile",
    " union all ".join(
        f"""select '{c}' as "column", count(*) as "rows", count(*) filter (where {c} is null) nulls, count(distinct {c}) "distinct", cast(min({c}) as varchar) least, cast(max({c}) as varchar) most from business"""
        for c in ("business_id", "county", "naics_code", "employees", "year_established")
    ),
)
def data_profile(spark, sf_dir):
    return R.data_profile(view(spark, sf_dir, "business"), ["business_id", "county", "naics_code", "employees", "year_established"])


@query("E26_business_insights", "select substr(naics_code, 1, 3) code, count(*) n, round(avg(revenue_estimate), 4) average from business group by 1 having count(*) >= 3 order by average desc, code limit 5")
def business_insights(spark, sf_dir):
    g = view(spark, sf_dir, "business").groupBy(F.substring("naics_code", 1, 3).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.avg("revenue_estimate").alias("average"))
    return rounded(g.where("n >= 3").orderBy(F.desc("average"), "code").limit(5), 4)


@query("E27_feature_report", " union all ".join(f"select '{c}' feature, count({c}) present, cast(min({c}) as double) least, cast(max({c}) as double) most, round(avg({c}), 6) mean, round(stddev_samp({c}), 4) deviation from business" for c in ("employees", "revenue_estimate", "patent_count")))
def feature_report(spark, sf_dir):
    b = view(spark, sf_dir, "business").select(*[F.col(c).cast("double").alias(c) for c in ("employees", "revenue_estimate", "patent_count")])
    long = b.unpivot([], ["employees", "revenue_estimate", "patent_count"], "feature", "x")
    g = long.groupBy("feature").agg(F.count("x").alias("present"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    return rounded(g, deviation=4)


@query("E28_score_bands", "select case when s >= 90 then 'elite' when s >= 70 then 'high' when s >= 50 then 'medium' else 'low' end band, count(*) n from (select employees % 101 s from business) group by 1")
def score_bands(spark, sf_dir):
    return R.score_bands(view(spark, sf_dir, "business").select((F.col("employees") % 101).alias("s")), "s")


@query("E29_training_stats", "select state, round(corr(employees, revenue_estimate), 6) correlation, round(stddev_samp(employees), 6) deviation from business group by state")
def training_stats(spark, sf_dir):
    g = view(spark, sf_dir, "business").groupBy("state").agg(F.corr("employees", "revenue_estimate").alias("correlation"), F.stddev_samp("employees").alias("deviation"))
    return rounded(g)


@query("E30_top_innovators", "select assignee, count(*) n from patent group by 1 order by n desc, assignee limit 10")
def top_innovators(spark, sf_dir):
    return R.top_groups(view(spark, sf_dir, "patent"), "assignee", 10)


@query("E31_zip_indices", "select zip, round(avg(value) * 100, 6) workforce, round(count(*) * avg(value) / 1000000.0, 8) market from crime group by zip")
def zip_indices(spark, sf_dir):
    g = view(spark, sf_dir, "crime").groupBy("zip").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.select("zip", F.round(F.col("v") * 100, 6).alias("workforce"), F.round(F.col("n") * F.col("v") / 1e6, 8).alias("market"))


@query(
    "F5_top_share",
    SHARES + ", r as (select *, row_number() over (partition by cluster_id order by n desc, k) i from s) select cluster_id, k top, round(p, 6) share from r where i = 1",
)
def top_share(spark, sf_dir):
    return rounded(K.top_share(view(spark, sf_dir, "member"), "cluster_id", F.col("county")))


@query("F6_top_members", "select cluster_id, business_id, place from (select cluster_id, business_id, cast(row_number() over (partition by cluster_id order by employees desc, business_id) as int) place from member) where place <= 3")
def top_members(spark, sf_dir):
    return K.top_members(view(spark, sf_dir, "member"), "cluster_id", [F.desc("employees"), F.asc("business_id")], 3).select("cluster_id", "business_id", "place")


@query("F3_rank_clusters", "select cluster_id, cast(row_number() over (order by r desc, cluster_id) as int) \"rank\" from (select cluster_id, sum(revenue_estimate) r from member group by 1)")
def rank_clusters(spark, sf_dir):
    m = K.metrics(view(spark, sf_dir, "member"), AS_OF)
    return K.ranked(m, [F.desc("revenue"), F.asc("cluster_id")]).select("cluster_id", "rank")


@query(
    "E20_county_impact",
    """with c as (select cluster_id, sum(revenue_estimate) gdp, sum(employees) jobs, sum(patent_count + sbir_awards) / count(*) roi, count(*) n from member group by 1), s as (select cluster_id, county, count(*) k from member group by 1, 2),
    g as (select county, round(sum(gdp * k / n), 2) gdp, round(sum(jobs * k / n), 6) jobs, sum(k) members, round(sum(roi * k) / sum(k), 6) roi from s join c using (cluster_id) group by 1),
    r as (select *, row_number() over (order by gdp, county) a, row_number() over (order by roi, county) b, count(*) over () t from g)
    select county, gdp, jobs, cast(members as bigint) members, roi, concat(cast(cast(ceil(a * 3 / t) as int) as varchar), '-', cast(cast(ceil(b * 3 / t) as int) as varchar)) class, case when gdp >= 1e9 then 'high' when gdp >= 1e8 then 'medium' else 'low' end tier from r""",
)
def county_impact(spark, sf_dir):
    from regiolith.operators.rollups import county_impact as impact

    m = view(spark, sf_dir, "member")
    c = m.groupBy("cluster_id").agg(F.sum("revenue_estimate").alias("gdp"), F.sum("employees").alias("jobs"), (F.sum(F.col("patent_count") + F.col("sbir_awards")) / F.count(F.lit(1))).alias("roi"))
    return impact(c, m)


@query(
    "L10_encoding_bias",
    "select substr(naics_code, 1, 3) class, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(avg(revenue_estimate), 4) mean, round(stddev_samp(revenue_estimate), 3) deviation from business group by 1",
)
def encoding_bias(spark, sf_dir):
    from pyspark.sql import Window

    g = view(spark, sf_dir, "business").groupBy(F.substring("naics_code", 1, 3).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg("revenue_estimate").alias("mean"), F.stddev_samp("revenue_estimate").alias("deviation"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))), mean=4, deviation=3)
