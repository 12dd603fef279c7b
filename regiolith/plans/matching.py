"""Queries for record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import matching as M
from regiolith.plans.aggregates import rounded
from regiolith.plans.registry import query
from regiolith.plans.text import MATCH
from regiolith.plans.views import view


def targets(spark, sf_dir):
    return view(spark, sf_dir, "messy").select(F.col("business_id").alias("id"), F.col("raw_name").alias("name"), F.col("raw_phone").alias("phone"), F.col("raw_address").alias("address"))


def sources(spark, sf_dir):
    b = view(spark, sf_dir, "business")
    return b.select(F.col("business_id").alias("id"), "name", F.concat(F.lit("816555"), (1000 + F.col("business_id") % 9000).cast("string")).alias("phone"), F.lit("").alias("address"))


SOURCE = "select business_id s_id, name s_raw, concat('816555', cast(1000 + business_id % 9000 as varchar(20))) s_phone from business"


@query(
    "D1_match_entities",
    rf"""with s as ({SOURCE}), sn as (select s_id, s_phone, trim(regexp_replace(regexp_replace(lower(s_raw), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) s_name from s),
    t as (select business_id id, {MATCH} name, regexp_replace(raw_phone, '\D', '', 'g') p from messy),
    a as (select id target_id, min(s_id) source_id from t join sn on name = s_name where name <> '' group by id),
    b as (select id target_id, min(s_id) source_id from t join sn on case when length(p) = 10 then p when length(p) = 11 and p like '1%' then substr(p, 2) end = s_phone where id not in (select target_id from a) group by id)
    select target_id, source_id, 1.0::double score, 'exact_name' tier from a union all select target_id, source_id, 0.95::double, 'phone' from b""",
)
def match_entities(spark, sf_dir):
    out = M.match_entities(sources(spark, sf_dir), targets(spark, sf_dir))
    return out.where(F.col("tier").isin("exact_name", "phone"))


@query("D1_match_all_tiers")
def match_all_tiers(spark, sf_dir):
    return rounded(M.match_entities(sources(spark, sf_dir), targets(spark, sf_dir), 0.7))


@query("D2_merge_matched")
def merge_matched(spark, sf_dir):
    s, t = sources(spark, sf_dir), targets(spark, sf_dir)
    return M.merge_matched(t, s, M.match_entities(s, t), ["name", "phone"], "matched_").select("id", "matched_name", "matched_score", "matched_tier")


@query("D4_indel_ratio")
def indel_ratio(spark, sf_dir):
    both = view(spark, sf_dir, "messy").join(view(spark, sf_dir, "business").select("business_id", "name"), "business_id")
    return both.select("business_id", F.round(M.indel_ratio_column()("raw_name", "name"), 6).alias("ratio"))


@query("D5_sequence_ratio")
def sequence_ratio(spark, sf_dir):
    both = view(spark, sf_dir, "messy").join(view(spark, sf_dir, "business").select("business_id", "name"), "business_id")
    return both.select("business_id", F.round(M.sequence_ratio_column()("raw_name", "name"), 6).alias("ratio"))


def businesses(spark, sf_dir):
    return view(spark, sf_dir, "business").withColumnRenamed("business_id", "id")


@query(
    "D6_dedup_fuzzy",
    """with recursive keyed as (select business_id id, county, revenue_estimate, substr(name, 1, i - 1) || substr(name, i + 1) k from business, range(1, 19) r(i)),
    edges as (select distinct x.id u, y.id v from keyed x join keyed y on x.county = y.county and x.k = y.k), reach as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u),
    grouped as (select u id, min(v) g from reach group by u)
    select id, county from (select b.business_id id, b.county, row_number() over (partition by g order by revenue_estimate desc nulls last, b.business_id) nth from business b join grouped on grouped.id = b.business_id) where nth = 1""",
)
def dedup_fuzzy(spark, sf_dir):
    """All names have 18 characters, so a ratio of 90 asks for 17 in common, which is what the SQL joins on."""
    return M.dedup_fuzzy(businesses(spark, sf_dir)).select("id", "county")


@query("D8_dedup_geo")
def dedup_geo(spark, sf_dir):
    return M.dedup_geo(businesses(spark, sf_dir), 0.5, 85.0).select("id", "county")


@query(
    "D9_count_awards",
    "select business_id, count(award_id) awards, round(coalesce(sum(amount), 0), 2) funding from (select business_id, name from business) b left join (select award_id, company, amount from award) a on contains(b.name, a.company) group by business_id",
)
def count_awards(spark, sf_dir):
    a = view(spark, sf_dir, "award")
    companies = a.groupBy("company").agg(F.count("award_id").alias("awards"), F.sum("amount").alias("funding"), F.min("award_id").alias("id"))
    b = view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "name")
    pairs = M.contained_names(b, companies.select("id", F.col("company").alias("name")))
    joined = pairs.join(companies.withColumnRenamed("id", "right_id"), "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum("awards").alias("awards"), F.sum("funding").alias("funding"))
    return b.join(joined, "id", "left").select(F.col("id").alias("business_id"), F.coalesce("awards", F.lit(0)).alias("awards"), F.round(F.coalesce("funding", F.lit(0.0)), 2).alias("funding"))


@query(
    "D10_match_patents",
    """with b as (select s_suppkey id, replace(s_name, '#', ' ') name, s_suppkey % 4 = 3 short from supplier), p as (select distinct patent_id, replace(assignee, '#', ' ') org from patent)
    select id supplier_id, count(distinct patent_id) patents from b left join p on case when short then starts_with(org, name[1:17]) else org = name end group by 1""",
)
def match_patents(spark, sf_dir):
    """Names as they are, with a legal form, in lower case, and without their last digit, which only the last tier finds."""
    name, n = F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")), F.col("s_suppkey") % 4
    spelled = F.when(n == 1, F.concat(name, F.lit(", Inc."))).when(n == 2, F.lower(name)).when(n == 3, F.substring(name, 1, 17)).otherwise(name)
    s = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), spelled.alias("name"))
    p = view(spark, sf_dir, "patent").select("patent_id", F.replace("assignee", F.lit("#"), F.lit(" ")).alias("assignee"))
    return M.match_patents(s, p).withColumnRenamed("id", "supplier_id")


@query("D11_attach_counts", "select s_suppkey supplier_id, coalesce(n, 0) patents from supplier left join (select assignee, count(*) n from patent where citations > 45 group by 1) on assignee = s_name")
def attach_counts(spark, sf_dir):
    n = view(spark, sf_dir, "patent").where("citations > 45").groupBy(F.col("assignee").alias("s_name")).count()
    return view(spark, sf_dir, "supplier").join(n, "s_name", "left").select(F.col("s_suppkey").alias("supplier_id"), F.coalesce("count", F.lit(0)).alias("patents"))


@query(
    "D12_enrich_hierarchical",
    """with z as (select zip, avg(value) safety from crime where zip < 12 group by zip), k as (select n_name county, 40.0::double + n_nationkey safety from nation where n_regionkey <> 4),
    b as (select business_id id, county, business_id % 20 zip from business), v as (select business_id id from business where business_id % 5 = 0)
    select b.id, round(case when v.id is not null and z.zip is not null then least(100.0, z.safety * 1.1) else coalesce(z.safety, k.safety, 60.0) end, 6) safety,
      case when v.id is not null and z.zip is not null then 'direct' when z.zip is not null then 'zip' when k.county is not null then 'county' else 'default' end source
    from b left join z on z.zip = b.zip left join k on k.county = b.county left join v on v.id = b.id""",
)
def enrich_hierarchical(spark, sf_dir):
    z = view(spark, sf_dir, "crime").where("zip < 12").groupBy("zip").agg(F.avg("value").alias("safety"))
    k = view(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_name").alias("county"), (F.lit(40.0) + F.col("n_nationkey")).alias("safety"))
    b = view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "county", (F.col("business_id") % 20).cast("int").alias("zip"))
    out = M.enrich_hierarchical(b, z, k, b.where("id % 5 = 0"), ["safety"], 60.0)
    return rounded(out.select("id", "safety", "source"))


@query(
    "D13_zip_features",
    """with c as (select zip, count(*) incidents from crime group by 1), p as (select business_id % 30 zip, count(*) permits from business group by 1), all_zips as (select zip from c union select zip from p), m as (select max(incidents) m from c)
    select z.zip, round(100 * (1 - coalesce(c.incidents, 0) / m.m), 6) safety, coalesce(p.permits, 0) permits, round(0.6 * 100 * (1 - coalesce(c.incidents, 0) / m.m) + 0.4 * coalesce(p.permits, 0), 6) score
    from all_zips z left join c on c.zip = z.zip left join p on p.zip = z.zip, m""",
)
def zip_features(spark, sf_dir):
    c = view(spark, sf_dir, "crime").select(F.col("zip").cast("long").alias("zip")).groupBy("zip").agg(F.count(F.lit(1)).alias("incidents"))
    p = view(spark, sf_dir, "business").groupBy((F.col("business_id") % 30).alias("zip")).agg(F.count(F.lit(1)).alias("permits"))
    out = c.join(p, "zip", "full").crossJoin(F.broadcast(c.agg(F.max("incidents").alias("m"))))
    safety = 100 * (1 - F.coalesce("incidents", F.lit(0)) / F.col("m"))
    permits = F.coalesce("permits", F.lit(0))
    return rounded(out.select("zip", safety.alias("safety"), permits.alias("permits"), (0.6 * safety + 0.4 * permits).alias("score")))


@query(
    "D16_cluster_features",
    "select cluster_id, round(avg(value), 6) safety, round(avg(case when value is not null then 1 else 0 end), 6) quality from member left join (select zip, avg(value) as value from crime where zip < 15 group by zip) on zip = business_id % 20 group by cluster_id",
)
def cluster_features(spark, sf_dir):
    z = view(spark, sf_dir, "crime").where("zip < 15").groupBy(F.col("zip").cast("long").alias("zip")).agg(F.avg("value").alias("value"))
    m = view(spark, sf_dir, "member").withColumn("zip", F.col("business_id") % 20).join(z, "zip", "left")
    return rounded(m.groupBy("cluster_id").agg(F.avg("value").alias("safety"), F.avg(F.col("value").isNotNull().cast("int")).alias("quality")))


@query("D20_cluster_pairs", "with c as (select distinct cluster_id from member) select x.cluster_id a, y.cluster_id b from c x join c y on x.cluster_id < y.cluster_id")
def cluster_pairs(spark, sf_dir):
    c = view(spark, sf_dir, "member").select("cluster_id").distinct()  # clusters, not their members
    return c.withColumnRenamed("cluster_id", "a").join(c.withColumnRenamed("cluster_id", "b"), F.col("a") < F.col("b"))
