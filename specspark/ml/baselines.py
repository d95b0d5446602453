"""Feature tables and classical models: each returns a fitted pipeline and is given its columns by name."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_pipeline(numeric: list[str], categorical: list[str], out: str = "features") -> Pipeline:
    """Medians for missing numbers, one-hot categories (unseen ones are kept apart), standard scale."""
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled)]
    if categorical:
        indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot)]
        filled = filled + hot
    stages += [VectorAssembler(inputCols=filled, outputCol=f"{out}_raw"), StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=False)]
    return Pipeline(stages=stages)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add weight: rows over (classes times rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return df.join(counts.crossJoin(F.broadcast(totals)), label).withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def fit_linear_forest(df: DataFrame, label: str = "label", features: str = "features", trees: int = 50, seed: int = 1):
    """A linear SVM, one against the rest, and a random forest, both with balanced classes."""
    weighed = balanced_weights(df, label)
    svm = OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), featuresCol=features, labelCol=label, weightCol="weight")
    forest = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="weight", numTrees=trees, seed=seed)
    return svm.fit(weighed), forest.fit(weighed)


def fit_boosted(df: DataFrame, label: str = "label", features: str = "features", rounds: int = 20, seed: int = 1):
    return GBTClassifier(featuresCol=features, labelCol=label, weightCol="weight", maxIter=rounds, seed=seed).fit(balanced_weights(df, label))


def fit_counts(df: DataFrame, label: str, features: str = "features", seed: int = 1):
    """A ridge and a forest regression of a count."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=1.0).fit(df), RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=30, seed=seed).fit(df)


def fit_logistic_cv(df: DataFrame, vector: str, label: str = "label", folds: int = 3, seed: int = 1):
    """Logistic regression on vectors with the penalty chosen by cross-validation."""
    data = df.withColumn("features", array_to_vector(vector))
    model = LogisticRegression(labelCol=label, maxIter=50)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.001, 0.01, 0.1]).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(data)


def fit_mlp_probe(train: DataFrame, val: DataFrame, vector: str, label: str, dim: int, classes: int, seeds: tuple[int, ...] = (1, 2)):
    """The one of some small networks that is most often right on ``val``."""
    t, v = (x.withColumn("features", array_to_vector(vector)) for x in (train, val))
    models = [MultilayerPerceptronClassifier(labelCol=label, layers=[dim, 32, classes], seed=s, maxIter=60).fit(t) for s in seeds]
    return max(models, key=lambda m: m.transform(v).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
