"""Queries for communities and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import communities as C
from regiolith.operators import graph as G
from regiolith.operators import neighbours as N
from regiolith.operators.clusters import consolidate as consolidated
from regiolith.operators.clusters import member_jaccard
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.views import view

EDGE = """(case when a.county = b.county then 0.3::double when a.state = b.state then 0.15::double else 0.0::double end
  + case when a.code = b.code then 0.3::double when substr(a.code, 1, 2) = substr(b.code, 1, 2) then 0.15::double else 0.0::double end
  + 0.2::double * least(a.employees, b.employees) / greatest(a.employees, b.employees)
  + case when (a.code in ('484', '493') and b.code in ('484', '493')) or (a.code in ('311', '445') and b.code in ('311', '445')) or (a.code in ('325', '621') and b.code in ('325', '621')) or (a.code in ('332', '336') and b.code in ('332', '336')) then 0.2::double else 0.0::double end)"""


@query(
    "I1_similarity_edges",
    f"""with n as (select business_id id, county, state, substr(naics_code, 1, 3) code, employees from business where employees > 0)
    select a.id u, b.id v, round({EDGE}, 6) w from n a join n b on a.id < b.id where {EDGE} > 0.56 and (a.state = b.state or a.code = b.code)""",
)
def similarity_edges(spark, sf_dir):
    edges = C.similarity_edges(view(spark, sf_dir, "business"), 0.56)
    return edges.withColumn("w", F.floor(F.col("w") * 1e6 + 0.5) / 1e6)  # as ``round``, which goes by decimals and takes as long as all else here


@query("I3_connected_components", "with e as (select a.business_id u, b.business_id v from business a join business b on a.county = b.county and a.naics_code = b.naics_code), c as (select u node, min(v) component from e group by 1) select node, component from c")
def connected_components(spark, sf_dir):
    from pyspark.sql import Window

    b = view(spark, sf_dir, "business").select("business_id", "county", "naics_code")
    w = Window.partitionBy("county", "naics_code").orderBy("business_id")
    edges = b.select(F.col("business_id").alias("u"), F.coalesce(F.lead("business_id").over(w), F.col("business_id")).alias("v"))
    found = G.connected_components(edges)
    return b.join(found.withColumnRenamed("node", "business_id"), "business_id", "left").select(F.col("business_id").alias("node"), F.coalesce("component", "business_id").alias("component"))


BUYS = " or ".join(f"(a.code = '{k}' and b.code in ({', '.join(repr(v) for v in vs)})) or (b.code = '{k}' and a.code in ({', '.join(repr(v) for v in vs)}))" for k, vs in N.BUYS.items())
NEAR_WEIGHT = f"""(0.4::double / (1 + sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) / 0.2::double) + case when a.code = b.code then 0.3::double else 0.0::double end
  + 0.2::double * least(a.e, b.e) / greatest(a.e, b.e) + case when {BUYS} then 0.1::double else 0.0::double end)"""


@query(
    "I1_nearest_neighbours",
    f"""with n as (select business_id id, latitude, longitude, substr(naics_code, 1, 3) code, greatest(employees, 1)::double e from business), w as (select a.id u, b.id v, {NEAR_WEIGHT} w from n a join n b on a.id <> b.id)
    select u, v, round(w, 6) w, cast(nth as int) nth from (select *, row_number() over (partition by u order by round(w, 12) desc, v) nth from w) where nth <= 10""",
)
def nearest_neighbours(spark, sf_dir):
    return rounded(N.nearest(view(spark, sf_dir, "business"), 10))


@query("I2_communities")
def communities(spark, sf_dir):
    """Communities of the graph of nearest neighbours, 15 businesses or more each, with the modularity of the division."""
    return rounded(G.sized_communities(N.neighbour_edges(view(spark, sf_dir, "business"), 10), 15))


@query(
    "I4_natural_communities",
    """with b as (select business_id, county, substr(naics_code, 1, 3) code, case when employees < 50 then 'small' when employees < 500 then 'medium' else 'large' end size from business),
    c as (select distinct county, code from b),
    t(lead, code) as (values ('511', '518'), ('511', '519'), ('511', '541'), ('518', '511'), ('518', '519'), ('518', '541'), ('493', '484'), ('493', '488'), ('493', '492'), ('484', '493'), ('484', '488'), ('484', '492'),
      ('336', '332'), ('336', '333'), ('336', '811'), ('311', '493'), ('311', '484'), ('311', '445'), ('325', '3254'), ('325', '3391'), ('325', '621')),
    f as (select c.county, c.code, min(t.lead) lead from c join t on t.code = c.code join c l on l.county = c.county and l.code = t.lead where t.lead < c.code group by 1, 2),
    g as (select * from f where (county, lead) not in (select (county, code) from f)),
    p as (select business_id, b.county, concat(b.county, '_', coalesce(g.lead, b.code), '_', size) community from b left join g on g.county = b.county and g.code = b.code),
    m as (select business_id, case when count(*) over (partition by community) >= 10 then community else concat(county, '_mixed') end community from p)
    select business_id, community from (select *, count(*) over (partition by community) k from m) where k >= 10""",
)
def natural_communities(spark, sf_dir):
    return C.natural_communities(view(spark, sf_dir, "business"), 10)


POTENTIAL = "p as (select cluster_id, count(*) * 1.0::double + count(distinct substr(naics_code, 1, 3)) * 5.0::double + 2.0::double * sum(revenue_estimate) / 1000000.0::double potential, count(distinct county) counties, count(*) n from member group by 1)"


@query("I7_community_potential", f"with {POTENTIAL} select cluster_id, round(potential, 6) potential from p")
def community_potential(spark, sf_dir):
    return rounded(C.community_potential(view(spark, sf_dir, "member")))


OBJECTIVES = "o as (select cluster_id, sum(patent_count) innovation, sum(employees) jobs, count(distinct county) counties from member group by 1)"


@query(
    "I8_pareto_front",
    f"with {OBJECTIVES} select a.cluster_id from o a where not exists (select 1 from o b where b.innovation >= a.innovation and b.jobs >= a.jobs and b.counties <= a.counties and (b.innovation > a.innovation or b.jobs > a.jobs or b.counties < a.counties))",
)
def pareto_front(spark, sf_dir):
    o = view(spark, sf_dir, "member").groupBy("cluster_id").agg(F.sum("patent_count").alias("innovation"), F.sum("employees").alias("jobs"), F.count_distinct("county").alias("counties"))
    return C.pareto_front(o, "cluster_id", ["innovation", "jobs"], ["counties"]).select("cluster_id")


@query("G11_spatial_groups")
def spatial_groups(spark, sf_dir):
    from regiolith.operators.density import density_groups

    points = view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "latitude", "longitude")
    return density_groups(points, 3.0, 5)


@query("G12_spatial_kmeans")
def spatial_kmeans(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "latitude", "longitude")
    features = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(points)
    return KMeans(k=20, seed=42, maxIter=20).fit(features).transform(features).select("id", F.col("prediction").alias("group"))


@query("I10_consolidate")
def consolidate(spark, sf_dir):
    """Whole clusters beside those of their larger members, which are much the same."""
    from regiolith.plans.scores import cluster_type

    m = view(spark, sf_dir, "member").withColumn("type", cluster_type())
    m = m.unionByName(m.where("employees >= 100").withColumn("cluster_id", F.concat("cluster_id", F.lit(":larger"))))
    c = m.groupBy("cluster_id").agg(F.min("type").alias("type"), F.replace(F.first("cluster_id"), F.lit(":"), F.lit(" ")).alias("name"), F.sum("patent_count").alias("score"))
    return rounded(consolidated(m, c, AS_OF), 2)


@query(
    "J17_pair_synergy",
    """with g as (select cluster_id, count(*) n, sum(patent_count) patents from member group by 1), c as (select distinct cluster_id, county from member),
    s as (select x.cluster_id a, y.cluster_id b, count(*) shared from c x join c y on x.county = y.county and x.cluster_id < y.cluster_id group by 1, 2)
    select a, b, round(least(25.0, (p.n + q.n) / 10.0) + least(25.0, shared * 5.0) + least(25.0, (p.patents + q.patents) / 20.0), 6) synergy from s join g p on p.cluster_id = a join g q on q.cluster_id = b""",
)
def pair_synergy(spark, sf_dir):
    m = view(spark, sf_dir, "member")
    g = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("patent_count").alias("patents"))
    s = member_jaccard(m, "cluster_id", "county").select("a", "b", "shared")
    p, q = g.select([F.col(c).alias(f"{c}_a") for c in g.columns]), g.select([F.col(c).alias(f"{c}_b") for c in g.columns])
    j = s.join(p, F.col("a") == F.col("cluster_id_a")).join(q, F.col("b") == F.col("cluster_id_b"))
    score = F.least(F.lit(25.0), (F.col("n_a") + F.col("n_b")) / 10.0) + F.least(F.lit(25.0), F.col("shared") * 5.0) + F.least(F.lit(25.0), (F.col("patents_a") + F.col("patents_b")) / 20.0)
    return rounded(j.select("a", "b", score.alias("synergy")))


@query(
    "I11_cluster_type",
    """with v as (select cluster_id, case when substr(naics_code, 1, 3) in ('484', '493') then 'logistics' when substr(naics_code, 1, 3) in ('541', '511') then 'technology' when substr(naics_code, 1, 3) in ('325', '621') then 'biosciences' else 'manufacturing' end kind, case when length(naics_code) >= 4 then 1.5::double else 1.0::double end w from member),
    s as (select cluster_id, kind, sum(w) votes, sum(sum(w)) over (partition by cluster_id) total from v group by 1, 2), r as (select *, row_number() over (partition by cluster_id order by votes desc, kind) i from s)
    select cluster_id, case when votes / total >= 0.5 then kind else 'mixed' end type, round(votes / total, 6) share from r where i = 1""",
)
def cluster_type(spark, sf_dir):
    from pyspark.sql import Window

    code = F.substring("naics_code", 1, 3)
    kind = F.when(code.isin("484", "493"), "logistics").when(code.isin("541", "511"), "technology").when(code.isin("325", "621"), "biosciences").otherwise("manufacturing")
    v = view(spark, sf_dir, "member").select("cluster_id", kind.alias("kind"), F.when(F.length("naics_code") >= 4, 1.5).otherwise(1.0).alias("w"))
    s = v.groupBy("cluster_id", "kind").agg(F.sum("w").alias("votes")).withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("cluster_id")))
    best = s.withColumn("i", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("votes"), "kind"))).where("i = 1")
    return rounded(best.select("cluster_id", F.when(F.col("share") >= 0.5, F.col("kind")).otherwise("mixed").alias("type"), "share"))
