"""Outcome models on cluster features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["employees", "revenue", "average_age", "innovation", "industries", "counties"]


def hash_split(df: DataFrame, key: str, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key, the same on every run."""
    part = F.pmod(F.xxhash64(key), F.lit(100))
    return df.where(part < percent), df.where(part >= percent)


def train(df: DataFrame, target: str, key: str, features: list[str] = FEATURES) -> tuple[PipelineModel, float]:
    """The better of two tree families by R2 on the held-out rows."""
    fit, test = hash_split(df.where(F.col(target).isNotNull()), key)
    best, score = None, float("-inf")
    for family in (RandomForestRegressor(featuresCol="scaled", labelCol=target, numTrees=20, seed=42), GBTRegressor(featuresCol="scaled", labelCol=target, maxIter=10, seed=42)):
        stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), family]
        model = Pipeline(stages=stages).fit(fit)
        r2 = RegressionEvaluator(labelCol=target, metricName="r2").evaluate(model.transform(test))
        if best is None or r2 > score:
            best, score = model, r2
    return best, score


def importances(model: PipelineModel, spark, features: list[str] = FEATURES) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    total = sum(values) or 1.0
    return spark.createDataFrame([(n, float(v) / total) for n, v in zip(features, values)], "feature string, importance double")


def debiased(found: DataFrame, scale: list[str], most: int = 20) -> DataFrame:
    """Importances (feature, importance) without the features of scale, as shares of the rest; the largest of them."""
    rest = found.where(~F.col("feature").isin(scale))
    total = rest.agg(F.sum("importance").alias("total__"))
    shares = rest.crossJoin(F.broadcast(total)).select("feature", F.coalesce(F.try_divide("importance", "total__"), F.lit(0.0)).alias("importance"))
    return shares.orderBy(F.desc("importance"), "feature").limit(most)


def validation(df: DataFrame, target: str, prediction: str, group: str) -> DataFrame:
    """Rows, mean absolute error and R2 of predictions by group."""
    mean = df.groupBy(group).agg(F.avg(target).alias("mean__"))
    error = F.col(target) - F.col(prediction)
    return df.join(mean, group).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.sum(error * error), F.sum(F.pow(F.col(target) - F.col("mean__"), 2)))).alias("r2"),
    )


FOLDS = 5


def families(target: str, small: bool = False) -> dict[str, object]:
    """The tree families that are compared."""
    from pyspark.ml.regression import DecisionTreeRegressor

    common = {"featuresCol": "scaled", "labelCol": target, "seed": 42}
    return {
        "forest": RandomForestRegressor(numTrees=10 if small else 40, **common), "boosted": GBTRegressor(maxIter=5 if small else 20, **common), "tree": DecisionTreeRegressor(**common),
    }


def staged(features: list[str], family) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), family])


def with_fold(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """Adds the fold of each row by a hash of its key, the same on every run and wherever the row lies."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def fold_scores(df: DataFrame, target: str, key: str, sets: dict[str, list[str]], folds: int = FOLDS, small: bool = False) -> DataFrame:
    """(feature_set, family, rows, r2, mae, chosen): scores of predictions that no model has seen the row for.

    Each fold is predicted by a model of the other ones; the score is that of all predictions together. Rows without the
    target or a feature take no part. The choice is the highest R2 to four places, then the smaller set, then the name."""
    every = sorted({c for features in sets.values() for c in features})
    known = with_fold(df.where(F.col(target).isNotNull()).dropna(subset=every), key, folds).select("fold", F.col(target).cast("double").alias(target), *every).cache()
    rows = []
    spark = df.sparkSession
    try:
        for name, features in sets.items():
            for family, estimator in families(target, small).items():
                found = None
                for fold in range(folds):
                    model = staged(features, estimator).fit(known.where(F.col("fold") != fold))
                    part = model.transform(known.where(F.col("fold") == fold)).select(target, "prediction")
                    found = part if found is None else found.unionByName(part)
                error = F.col(target) - F.col("prediction")
                s = found.agg(F.count(F.lit(1)), F.sum(error * error), F.sum(F.abs(error)), F.var_pop(target)).first()  # one row
                spread = (s[3] or 0.0) * s[0]
                rows.append((name, family, len(features), s[0], 1 - (s[1] or 0.0) / spread if spread else 0.0, (s[2] or 0.0) / max(s[0], 1)))
    finally:
        known.unpersist()
    best = min(rows, key=lambda r: (-round(r[4], 4), r[2], r[0], r[1]))
    out = [(n, f, k, r2, mae, (n, f) == (best[0], best[1])) for n, f, _, k, r2, mae in rows]
    return spark.createDataFrame(out, "feature_set string, family string, rows long, r2 double, mae double, chosen boolean")


def trained(df: DataFrame, target: str, key: str, sets: dict[str, list[str]], folds: int = FOLDS, small: bool = False) -> tuple[PipelineModel, list[str], DataFrame]:
    """The chosen family on the chosen features, fitted on all rows, with those features and the table of scores."""
    scores = fold_scores(df, target, key, sets, folds, small)
    pick = scores.where("chosen").first()
    features = sets[pick["feature_set"]]
    known = df.where(F.col(target).isNotNull()).dropna(subset=features)
    return staged(features, families(target, small)[pick["family"]]).fit(known), features, scores


def save_version(model: PipelineModel, features: list[str], folder: str) -> int:
    """Writes a model as the next version of a folder, with the names of its features; a version is whole once its names are there."""
    spark = SparkSession.active()
    version = max(versions(spark, folder), default=0) + 1
    model.write().overwrite().save(f"{folder}/version={version}/model")
    spark.createDataFrame([(i, c) for i, c in enumerate(features)], "at int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}/features")
    return version


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions of a folder, by its file system wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/features/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(str(f.getPath()).split("/version=")[-1].split("/")[0]) for f in found or [])


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> tuple[PipelineModel, list[str]] | None:
    """A version, the latest if none is named; None if the folder has none."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        return None
    place = f"{folder}/version={version or known[-1]}"
    names = [r["feature"] for r in spark.read.parquet(f"{place}/features").orderBy("at").collect()]
    return PipelineModel.load(f"{place}/model"), names


# How far a prediction of each kind is trusted.
TRUST = {"model": 0.85, "fallback": 0.70, "rule": 0.50}


def predicted(df: DataFrame, chain: list[tuple[str, tuple[PipelineModel, list[str]] | None]], rule) -> DataFrame:
    """Adds prediction, source, quality and confidence to rows.

    The models of the chain are asked in order: the first one counts that has been saved and whose features the row has; the
    rule, a column, counts where none does. Quality is the share of all features that the row has, and a prediction is trusted
    by its source as far as the row's data are whole."""
    every = sorted({c for _, found in chain if found for c in found[1]})
    out = df
    if every:
        out = out.withColumn("quality", sum((F.col(c).isNotNull().cast("double") for c in every), F.lit(0.0)) / len(every))
    else:
        out = out.withColumn("quality", F.lit(0.0))
    value, source = None, None
    for name, found in chain:
        if not found:
            continue
        model, features = found
        whole = F.lit(True)
        for c in features:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        # rows without a feature are given 0 for it, so that one pass serves all; what the model says of them is not used
        filled = out.withColumns({f"own__{c}": F.col(c) for c in features} | {f"whole__{name}": whole}).withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
        made = model.transform(filled).drop("raw", "scaled").withColumnRenamed("prediction", f"said__{name}")
        out = made.withColumns({c: F.col(f"own__{c}") for c in features}).drop(*[f"own__{c}" for c in features])
        hit = F.col(f"whole__{name}")
        value = F.when(hit, F.col(f"said__{name}")) if value is None else value.when(hit, F.col(f"said__{name}"))
        source = F.when(hit, name) if source is None else source.when(hit, name)
    value, source = (rule, F.lit("rule")) if value is None else (value.otherwise(rule), source.otherwise("rule"))
    out = out.withColumn("prediction", value).withColumn("source", source)
    trust = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in TRUST.items()], F.lit(TRUST["rule"]))
    return out.withColumn("confidence", trust * (0.5 + 0.5 * F.col("quality"))).select(*df.columns, "prediction", "source", "quality", "confidence")
