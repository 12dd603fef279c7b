"""Queries for window functions and ranked selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regiolith.operators import communities as C
from regiolith.plans.aggregates import rounded
from regiolith.plans.registry import query
from regiolith.plans.views import view


@query(
    "F2_latest_observation",
    """with r as (select event_type, value, ts, row_number() over (partition by event_type order by ts desc, event_id desc) a, row_number() over (partition by event_type order by ts, event_id) b from events)
    select event_type series, round(max(case when a = 1 then value end), 6) latest, round(max(case when b = 1 then value end), 6) oldest, round(max(case when a = 253 then value end), 6) year_ago from r group by 1""",
)
def latest_observation(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    g = e.withColumn("a", F.row_number().over(w)).groupBy(F.col("event_type").alias("series"))
    order = F.struct("ts", "event_id")
    return rounded(g.agg(F.max_by("value", order).alias("latest"), F.min_by("value", order).alias("oldest"), F.max(F.when(F.col("a") == 253, F.col("value"))).alias("year_ago")))


@query("F4_greedy_chunks", "select business_id, cast(ntile(7) over (order by revenue_estimate desc, business_id) - 1 as int) chunk from business")
def greedy_chunks(spark, sf_dir):
    return C.greedy_chunks(view(spark, sf_dir, "business"), "business_id", [F.desc("revenue_estimate"), F.asc("business_id")], 7)


@query(
    "F7_stratified_top",
    """with s as (select business_id, county, substr(naics_code, 1, 3) code, revenue_estimate, count(*) over (partition by county, substr(naics_code, 1, 3)) n, count(*) over () total from business),
    r as (select *, row_number() over (partition by county, code order by revenue_estimate desc, business_id) i from s) select business_id from r where i <= ceil(300.0 * n / total)""",
)
def stratified_top(spark, sf_dir):
    b = view(spark, sf_dir, "business").withColumn("code", F.substring("naics_code", 1, 3))
    sizes = b.groupBy("county", "code").agg(F.count(F.lit(1)).alias("n"))
    total = b.agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("county", "code").orderBy(F.desc("revenue_estimate"), "business_id")
    joined = b.join(sizes, ["county", "code"]).crossJoin(F.broadcast(total)).withColumn("i", F.row_number().over(w))
    return joined.where(F.col("i") <= F.ceil(F.lit(300.0) * F.col("n") / F.col("total"))).select("business_id")


@query(
    "F8_select_by_composition",
    """with g as (select business_id, revenue_estimate, substr(naics_code, 1, 3) code from business), r as (select *, row_number() over (partition by code order by revenue_estimate desc, business_id) i from g),
    a as (select business_id from r where (code = '484' and i <= 40) or (code = '493' and i <= 30) or (code = '541' and i <= 30)),
    b as (select business_id from business where business_id not in (select business_id from a) order by revenue_estimate desc, business_id limit 20)
    select business_id from a union all select business_id from b""",
)
def select_by_composition(spark, sf_dir):
    b = view(spark, sf_dir, "business").select("business_id", "revenue_estimate", F.substring("naics_code", 1, 3).alias("code"))
    order = [F.desc("revenue_estimate"), F.asc("business_id")]
    a = C.strict_top_by_group(b, F.col("code"), {"484": 40, "493": 30, "541": 30}, order).select("business_id")
    rest = b.join(a, "business_id", "left_anti").orderBy(*order).limit(20).select("business_id")
    return a.unionByName(rest)


@query(
    "F9_percentile_gaps",
    """with q as (select unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) p), v as (select p, (select quantile_cont(employees, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) from business)[row_number() over (order by p)] x from q),
    g as (select cast(p as double) p, x, lead(x) over (order by p) - x gap from v) select p, round(x, 6) x, round(gap, 6) gap from g""",
)
def percentile_gaps(spark, sf_dir):
    points = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
    q = view(spark, sf_dir, "business").agg(F.percentile(F.col("employees").cast("double"), F.array(*map(F.lit, points))).alias("xs"))
    long = q.select(F.posexplode("xs").alias("i", "x")).withColumn("p", F.get(F.array(*map(F.lit, points)), F.col("i")))
    return rounded(long.withColumn("gap", F.lead("x").over(Window.orderBy("i")) - F.col("x")).select("p", "x", "gap"))  # thirteen rows


@query(
    "F10_dynamic_threshold",
    """with s as (select quantile_cont(employees, 0.6) p, count(*) n, max(employees) m from business) select round(least(m * 0.8, greatest(50, p)), 6) threshold, (select count(*) from business where employees >= least(s.m * 0.8, greatest(50, s.p))) passing from s""",
)
def dynamic_threshold(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    s = b.agg(F.percentile(F.col("employees").cast("double"), F.lit(0.6)).alias("p"), F.max("employees").alias("m"))
    t = s.select(F.least(F.col("m") * 0.8, F.greatest(F.lit(50.0), F.col("p"))).alias("threshold"))
    return rounded(b.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.count_if(F.col("employees") >= F.col("threshold")).alias("passing")))


@query("H4_sample_n", "select business_id, county from business order by md5(concat(cast(business_id as varchar), ':42')), business_id limit 100")
def sample_n(spark, sf_dir):
    from regiolith.operators.cleaning import sample_n as sample

    return sample(view(spark, sf_dir, "business").select("business_id", "county"), 100, "business_id")


ADDED = ["kc_score", "kc_zone"]


def enriched(spark, sf_dir):
    """Businesses with two added columns, which four of five have."""
    some = F.col("business_id") % 5 != 0
    b = view(spark, sf_dir, "business").select("business_id", "name", "county")
    return b.withColumn("kc_score", F.when(some, (F.col("business_id") % 97).cast("long"))).withColumn("kc_zone", F.when(some, F.col("county")))


def written(spark, sf_dir):
    from regiolith.sources.exports import write_enriched
    from regiolith.streaming.runs import shared_folder

    folder = shared_folder(spark, "enriched")
    write_enriched(enriched(spark, sf_dir), folder, "2024-06-30T00:00:00", ["business_id"], ADDED)
    return folder


@query("A16_write_enriched", "select business_id, name, county, case when business_id % 5 <> 0 then business_id % 97 end kc_score, case when business_id % 5 <> 0 then county end kc_zone from business")
def write_enriched_table(spark, sf_dir):
    """The whole table, written and read back."""
    return spark.read.parquet(f"{written(spark, sf_dir)}/data")


@query("A16_write_sample", "select business_id, name, county from business order by business_id limit 1000")
def write_sample(spark, sf_dir):
    """The sample for inspection, read back from its CSV."""
    return spark.read.schema("business_id long, name string, county string, kc_score long, kc_zone string").option("header", "true").csv(f"{written(spark, sf_dir)}/sample").select("business_id", "name", "county")


@query("A16_write_metadata", "select '2024-06-30T00:00:00' created_at, count(*) total, 'kc_score,kc_zone' features_added, round(count(*) filter (business_id % 5 <> 0) / count(*), 6) enhancement_rate, 5 columns from business")
def write_metadata(spark, sf_dir):
    schema = "created_at string, total long, features_added array<string>, enhancement_rate double, columns array<string>"
    about = spark.read.schema(schema).json(f"{written(spark, sf_dir)}/metadata")
    return about.select("created_at", "total", F.array_join("features_added", ",").alias("features_added"), "enhancement_rate", F.size("columns").alias("columns"))


def exported(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    two = F.substring(F.first("naics_code"), 1, 1)
    c = m.groupBy("cluster_id").agg(F.concat(F.lit("Cluster "), F.first("cluster_id")).alias("name"), F.when(two == "5", "services").otherwise("goods").alias("type"), F.round(F.avg("patent_count"), 4).alias("score"))
    return c, m


EXPORTED = "c as (select cluster_id, concat('Cluster ', cluster_id) name, case when substr(min(naics_code), 1, 1) = '5' then 'services' else 'goods' end type, round(avg(patent_count), 4) score from member group by 1), g as (select cluster_id, count(*) n, sum(employees) jobs, sum(revenue_estimate) revenue from member group by 1)"


@query("A19_export_lines", "select cluster_id, concat(cluster_id, ': ', cast(count(*) as varchar), ' businesses, ', cast(sum(employees) as varchar), ' employees') line from member group by 1")
def export_lines(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("employees").alias("e"))
    return g.select("cluster_id", F.concat("cluster_id", F.lit(": "), F.col("n").cast("string"), F.lit(" businesses, "), F.col("e").cast("string"), F.lit(" employees")).alias("line"))


@query(
    "A19_export_csv",
    f"""with {EXPORTED}, s as (select cluster_id, sum(cast(revenue_estimate as decimal(18, 2))) cents from member group by 1), r as (select *, row_number() over (partition by cluster_id order by revenue_estimate desc, business_id) i from member)
    select cluster_id, 0 "at", concat(name, ' (', type, '), score ', format('{{:.1f}}', score)) line from c
    union all select cluster_id, 1, concat(cast(n as varchar), ' businesses, ', format('{{:,}}', cast(jobs as bigint)), ' employees, revenue $', format('{{:,}}', cast(round_even(cast(cents as double), 0) as bigint))) from g join s using (cluster_id)
    union all select cluster_id, cast(i + 1 as int), concat(cast(i as varchar), '. ', name, ', ', format('{{:,}}', cast(employees as bigint)), ' employees, $', format('{{:,}}', cast(round_even(revenue_estimate, 0) as bigint))) from r where i <= 5""",
)
def export_csv(spark, sf_dir):
    """Lines of all clusters, written as CSV and read back."""
    from regiolith.sources.exports import cluster_lines
    from regiolith.streaming.runs import shared_folder

    folder = shared_folder(spark, "lines")
    cluster_lines(*exported(spark, sf_dir)).write.option("header", "true").csv(folder)
    return spark.read.schema("cluster_id string, at int, line string").option("header", "true").csv(folder)


@query("A19_export_json", f"with {EXPORTED} select cluster_id, m.business_id, c.name cluster_name, c.type, g.n businesses, cast(jobs as bigint) employees, score, m.county, round(m.revenue_estimate, 2) revenue from member m join c using (cluster_id) join g using (cluster_id)")
def export_json(spark, sf_dir):
    """Documents of all clusters, written as text, read back and taken apart again."""
    from regiolith.sources.exports import cluster_documents
    from regiolith.streaming.runs import shared_folder

    folder = shared_folder(spark, "documents")
    cluster_documents(*exported(spark, sf_dir)).select("document").write.text(folder)
    member = "struct<business_id: bigint, name: string, county: string, employees: int, revenue: double>"
    schema = f"cluster_id string, name string, type string, metrics struct<businesses: bigint, employees: bigint, score: double>, members array<{member}>"
    d = spark.read.text(folder).select(F.from_json("value", schema).alias("d")).select("d.*")
    return d.select("cluster_id", F.explode("members").alias("m"), F.col("name").alias("cluster_name"), "type", "metrics.*").select(
        "cluster_id", "m.business_id", "cluster_name", "type", "businesses", "employees", "score", "m.county", "m.revenue"
    )
