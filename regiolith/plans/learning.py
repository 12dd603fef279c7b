"""Queries for models on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import clusters as K
from regiolith.operators import learning as L
from regiolith.plans.aggregates import AS_OF, rounded
from regiolith.plans.registry import query
from regiolith.plans.views import view

M = """m as (select cluster_id, count(*) businesses, sum(employees) employees, sum(revenue_estimate) revenue, avg(2024 - year_established) average_age, sum(patent_count * 10 + sbir_awards * 20) innovation,
 count(distinct substr(naics_code, 1, 3)) industries, count(distinct county) counties from member group by 1)"""


def features(spark, sf_dir, keys=("county",)):
    m = view(spark, sf_dir, "member")
    return K.metrics(m, AS_OF)


def wide(spark, sf_dir):
    """A row for each county, industry and size class, so that there are rows to learn from."""
    m = view(spark, sf_dir, "member").withColumn("cluster_id", F.concat_ws(":", "county", F.substring("naics_code", 1, 3)))
    return K.metrics(m, AS_OF).withColumn("target", F.log1p("revenue") + F.col("counties"))


@query("L1_cluster_features", f"with {M} select cluster_id, round(ln(1 + revenue), 6) log_revenue, round(ln(1 + employees), 6) log_employees, round(average_age, 6) average_age, cast(innovation as bigint) innovation, round(industries / businesses, 6) diversity from m")
def cluster_features(spark, sf_dir):
    m = features(spark, sf_dir)
    return rounded(m.select("cluster_id", F.log1p("revenue").alias("log_revenue"), F.log1p(F.col("employees").cast("double")).alias("log_employees"), "average_age", "innovation", (F.col("industries") / F.col("businesses")).alias("diversity")))


@query("L2_train_outcomes")
def train_outcomes(spark, sf_dir):
    model, _ = L.train(wide(spark, sf_dir), "target", "cluster_id")
    return L.importances(model, spark)


SETS = {"all": L.FEATURES, "place": ["average_age", "industries", "counties"]}


@query("L2_fold_scores")
def fold_scores(spark, sf_dir):
    """Three families on all features and on those of place only, by predictions out of the fold."""
    return rounded(L.fold_scores(wide(spark, sf_dir), "target", "cluster_id", SETS, folds=3, small=True))


@query("L3_predict_outcomes")
def predict_outcomes(spark, sf_dir):
    """Rows without an innovation score are the fallback's, rows without an age the rule's."""
    from regiolith.streaming.runs import shared_folder

    df = wide(spark, sf_dir)
    folders = {name: shared_folder(spark, f"outcomes-{name}") for name in ("model", "fallback")}
    for name, features in (("model", L.FEATURES), ("fallback", SETS["place"])):
        L.save_version(L.staged(features, L.families("target", small=True)["forest"]).fit(df), features, folders[name])
    part = F.crc32(F.col("cluster_id").cast("binary")) % 10
    asked = df.withColumn("innovation", F.when(part > 2, F.col("innovation"))).withColumn("average_age", F.when(part > 0, F.col("average_age")))
    chain = [(name, L.load_version(spark, folder)) for name, folder in folders.items()]
    out = L.predicted(asked, chain, F.log1p("revenue") + 1)
    return rounded(out.select("cluster_id", "target", "prediction", "source", "quality", "confidence"))


@query(
    "L6_validate_predictions",
    """with d as (select state, employees t, 10.0::double + business_id % 300 p from business), m as (select state, avg(t) m from d group by 1)
    select d.state, count(*) n, round(avg(abs(t - p)), 6) mae, round(1 - sum((t - p) * (t - p)) / sum(pow(t - m, 2)), 6) r2 from d join m on m.state = d.state group by 1""",
)
def validate_predictions(spark, sf_dir):
    d = view(spark, sf_dir, "business").select("state", F.col("employees").cast("double").alias("t"), (F.lit(10.0) + F.col("business_id") % 300).alias("p"))
    return rounded(L.validation(d, "t", "p", "state"))


RANK = "0.25::double * revenue / 1e9 + 0.25::double * employees / 1000.0 + 0.25::double * innovation / 1000.0 + 0.25::double * industries"


@query("L7_rerank", f"with {M} select cluster_id, round({RANK}, 6) score, cast(row_number() over (order by round({RANK}, 6) desc, cluster_id) as int) \"rank\" from m")
def rerank(spark, sf_dir):
    score = 0.25 * F.col("revenue") / 1e9 + 0.25 * F.col("employees") / 1000.0 + 0.25 * F.col("innovation") / 1000.0 + 0.25 * F.col("industries")
    m = features(spark, sf_dir).select("cluster_id", F.round(score, 6).alias("score"))
    return K.ranked(m, [F.desc("score"), F.asc("cluster_id")])


@query("L9_prediction_intervals", f"with {M} select cluster_id, round(revenue * 0.8::double, 2) low, round(revenue * 1.2::double, 2) high, case when businesses >= 50 then 'high' when businesses >= 20 then 'medium' else 'low' end confidence from m")
def prediction_intervals(spark, sf_dir):
    band = F.when(F.col("businesses") >= 50, "high").when(F.col("businesses") >= 20, "medium").otherwise("low")
    return rounded(features(spark, sf_dir).select("cluster_id", (F.col("revenue") * 0.8).alias("low"), (F.col("revenue") * 1.2).alias("high"), band.alias("confidence")), 2)
